"""Ranked lexical search: the best documents of every item, by an exact dual-tree search.

A document is a vector over the items' terms; its coordinate is what a term adds
to a score before the term's weight. A batch of documents is ordered by the
term that counts most in each and cut into a tree; items are ordered by their
terms and cut into a tree once. A node holds the largest value that any
of its leaves has in each coordinate, so the product of a document node with an
item node bounds the score of every pair below them. Where it lies under the
weakest kth score of the node's items, the whole batch of pairs is dropped;
otherwise both nodes are opened. At the leaves the product is the score itself.

1. One pass cuts every text into terms and writes the sparse vectors over the
   items' terms, with the numbers that the weights need.
2. Items' first kth scores come from a fixed share of the documents (any k
   documents bound the kth score from below, so this drops nothing).
3. Every task searches its documents and passes on at most k per item, none
   under the item's bound; a ranked window, which Spark cuts to k per task before the
   shuffle, keeps the best.

Items are taken in blocks of at most ``BLOCK_ITEMS``, about ``BLOCK_BYTES`` of text, so what a task
holds is bounded; each block meets all documents. Scores are whole numbers.

Defined results: a null text has no terms; an item without terms, or whose terms
no document has, gives no rows; each row of items is an item and each row of
documents a document, so rows with equal ids are ranked side by side; equal scores
are ranked by ascending id, a null id last; an empty table gives no rows; long
texts are read whole; other columns of any name are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblode.llm.registry import case, documents
from joblode.llm.tokens import narrow
from joblode.session import staged

TOP = 10
BLOCK_ITEMS, BLOCK_BYTES = 2048, 8 << 20
# Children of a node; documents that one tree holds.
FAN, TREE = 8, 4096
# One document in so many gives the first bounds.
SHARE = 32
# Fixed values of the score: scale, and share of the length in it.
SCALE, LENGTH_PERCENT = 1_000_000_000, 90

# Bytes of terms, A-Z lower-cased; all others are blanks. Bytes from 128 on belong to other scripts.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split(b" ")


def found(text: str | None) -> list[bytes]:
    return [t for t in terms(text) if t]


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with a term: how many, and which of the vocabulary how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, lengths, known, counts = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = found(text)
                ids = np.fromiter(map(number, own, repeat(-1)), "int32", len(own))
                ids, held = np.unique(ids[ids >= 0], return_counts=True)
                sizes.append(len(own))
                lengths.append(len(ids))
                known.append(ids)
                counts.append(held)
            at = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.empty(0, "int32"), *known]), pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.empty(0, "int64"), *counts]), pa.int64()))],
                names=["doc_id", "n", "terms", "counts"])
    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>").filter("n > 0")


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the entries of some rows of a ragged table."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Level:
    """Nodes as sparse rows: (node, term) -> value."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, count: int):
        self.term, self.value, self.count = term, value, count
        self.size = np.bincount(node, minlength=count)
        self.start = np.cumsum(self.size) - self.size
        self.node = node

    def above(self, width: int) -> Level:
        """Nodes of ``FAN`` nodes of this level, each with the largest value of every term."""
        key = (self.node // FAN) * width + self.term
        order = np.argsort(key, kind="stable")
        key, value = key[order], self.value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, "int64")
        most = np.maximum.reduceat(value, first) if len(first) else value
        return Level(key[first] // width, key[first] % width, most, -(-self.count // FAN))

    def row(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.start[node], self.start[node] + self.size[node])
        return self.term[own], self.value[own]


def tree(leaves: Level, width: int) -> list[Level]:
    """Levels from the leaves to the root."""
    levels = [leaves]
    while levels[-1].count > 1:
        levels.append(levels[-1].above(width))
    return levels


class Items:
    """A tree over items, and each item's best documents so far."""

    def __init__(self, sets: list[np.ndarray], weights: np.ndarray, floors: np.ndarray, k: int):
        # Neighbours share their most frequent terms, which are those of least weight.
        order = sorted(range(len(sets)), key=lambda i: [(weights[t], t) for t in sorted(sets[i], key=lambda t: (weights[t], t))[:3]])
        self.order, self.weights, self.k = np.array(order, "int64"), weights, k
        own = [sets[i] for i in order]
        sizes = np.array([len(s) for s in own], "int64")
        term = np.concatenate([np.empty(0, "int64"), *own]).astype("int64")
        self.levels = tree(Level(np.repeat(np.arange(len(own)), sizes), term, weights[term], len(own)), len(weights))
        self.best: list[list] = [[] for _ in own]
        self.first = floors[self.order]
        self.kth = self.first.copy()
        self.bounds()

    def bounds(self) -> None:
        """The weakest kth score below every node; a score of 0 never counts."""
        self.floor = [np.maximum(self.kth, 1)]
        for level in self.levels[1:]:
            self.floor.append(np.minimum.reduceat(self.floor[-1], np.arange(level.count) * FAN))

    def products(self, level: int, nodes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Products of item nodes with the document node that ``dense`` holds."""
        at = self.levels[level]
        sizes = at.size[nodes]
        places = gather(at.start[nodes], sizes)
        adds = np.concatenate([[0], np.cumsum(at.value[places] * dense[at.term[places]])])
        ends = np.cumsum(sizes)
        return adds[ends] - adds[ends - sizes]

    def add(self, items: np.ndarray, scores: np.ndarray, doc: tuple) -> None:
        for item, score in zip(items.tolist(), scores.tolist()):
            best = self.best[item]
            if len(best) < self.k:
                heapq.heappush(best, (score, *doc))
            elif (score, *doc) > best[0]:
                heapq.heapreplace(best, (score, *doc))
            else:
                continue
            if len(best) == self.k:
                self.kth[item] = max(self.kth[item], best[0][0])
                self.floor[0][item] = max(self.kth[item], 1)


def search_tree(items: Items, ids: list, leaves: Level, width: int) -> None:
    """Meets a tree of documents with the tree of items."""
    levels = tree(leaves, width)
    dense = np.zeros(width, "int64")
    top = len(items.levels) - 1
    stack = [(len(levels) - 1, 0, top, np.arange(items.levels[top].count))]
    while stack:
        at, node, level, nodes = stack.pop()
        known, values = levels[at].row(node)
        dense[known] = values
        scores = items.products(level, nodes, dense)
        # A pair may also tie with the kth score and win by its id.
        open_ = scores >= items.floor[level][nodes]
        while level > 0 and at == 0 and open_.any():  # a document: down to the items
            nodes, level = children(nodes[open_], items.levels[level - 1].count), level - 1
            scores = items.products(level, nodes, dense)
            open_ = scores >= items.floor[level][nodes]
        dense[known] = 0
        if not open_.any():
            continue
        nodes = nodes[open_]
        if at == 0:
            doc = ids[node]
            items.add(nodes, scores[open_], (doc is not None, -doc if doc is not None else 0))
            continue
        if level > 0:
            nodes, level = children(nodes, items.levels[level - 1].count), level - 1
        stack += [(at - 1, c, level, nodes) for c in range(min((node + 1) * FAN, levels[at - 1].count) - 1, node * FAN - 1, -1)]
    items.bounds()


def children(nodes: np.ndarray, count: int) -> np.ndarray:
    out = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    return out[out < count]


def coordinates(count: np.ndarray, n: np.ndarray, docs: int, all_terms: int) -> np.ndarray:
    """What each entry adds before its weight; ``n``: terms of its document."""
    m = np.array([100 - LENGTH_PERCENT + (LENGTH_PERCENT * x * docs) // all_terms for x in n.tolist()], "int64")
    return (SCALE * count) // (1000 * count + 8 * m)


def best_of(rows: DataFrame, sets: list[np.ndarray], weights: np.ndarray, floors: np.ndarray, docs: int, all_terms: int,
            k: int) -> DataFrame:
    """(item, doc_id, score): at most k per item and task, none under the item's floor. ``rows``: of :func:`vectors`."""
    shared = rows.sparkSession.sparkContext.broadcast((sets, weights, floors))
    width = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value, k)
        for whole in batches:
            for start in range(0, whole.num_rows, TREE):
                batch = whole.slice(start, TREE)
                lists = batch.column("terms")
                sizes = lists.value_lengths().to_numpy().astype("int64")
                term, count = lists.flatten().to_numpy().astype("int64"), batch.column("counts").flatten().to_numpy()
                per_doc = coordinates(count, np.repeat(batch.column("n").to_numpy(), sizes), docs, all_terms)
                row = np.repeat(np.arange(batch.num_rows), sizes)
                # Documents are neighbours if the same term counts most in them.
                heavy = np.lexsort((-per_doc * weights[term], row))
                first = (np.cumsum(sizes) - sizes)[sizes > 0]
                main = np.full(batch.num_rows, width)
                main[sizes > 0] = term[heavy[first]]
                order = np.argsort(main, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                moved = np.argsort(place[row], kind="stable")
                ids = batch.column("doc_id").to_pylist()
                search_tree(items, [ids[i] for i in order],
                            Level(place[row][moved], term[moved], per_doc[moved], batch.num_rows), width)
        out = [(int(items.order[i]), -neg if has else None, score)
               for i, best in enumerate(items.best) for score, has, neg in best]
        if out:
            item, doc, score = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                names=["item", "doc_id", "score"])
    return rows.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame:
    """(item, rank, doc_id, score): ``item`` is the place in ``texts``."""
    spark = docs.sparkSession
    own = [sorted(set(found(t))) for t in texts]
    names = sorted({t for s in own for t in s})
    number = {t: i for i, t in enumerate(names)}
    rows = staged(vectors(docs, number), "search-vectors")
    docs_with, all_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(names), "int64")
    frequency = rows.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()  # at most the items' terms
    held[frequency["t"].to_numpy()] = frequency["count"].to_numpy()
    weights = np.floor(1000 * np.log((2 * docs_with + 2) / (2 * held + 1))).astype("int64")
    sets = [np.array([number[t] for t in s if held[number[t]]], "int64") for s in own]
    floors = np.zeros(len(sets), "int64")
    if docs_with:
        some = rows.filter(F.pmod(F.xxhash64("doc_id", "n", "counts"), F.lit(SHARE)) == 0)
        weakest = (ranked(best_of(some, sets, weights, floors, docs_with, all_terms, k), k)
                   .filter(F.col("rank") == k).select("item", "score").collect())  # a number per item
        for item, score in weakest:
            floors[item] = score
    return ranked(best_of(rows, sets, weights, floors, docs_with, max(all_terms, 1), k), k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 of every row of ``items``."""
    spark, own = docs.sparkSession, narrow(docs, id_col, text_col)
    asked = staged(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"),
                                F.monotonically_increasing_id().alias("no")), "search-items")
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    kind, out = dict(asked.dtypes)["item_id"], None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("no"), F.lit(blocks)) == b).orderBy("no").collect()
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {kind}")
        hits = search_block(own, [r["text"] for r in block], k).join(F.broadcast(names), "item")
        hits = hits.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = hits if out is None else out.unionByName(hits)
    return out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
b AS (SELECT item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS all_terms FROM d WHERE len(terms) > 0),
i AS (SELECT item_id, unnest(terms) AS term FROM b),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
       WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, docs),
p AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank
      FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@case("op11_lexical_search", SQL)
def op11(spark, sf_dir):
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
