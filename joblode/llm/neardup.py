"""Near-duplicates by BagMinHash: banded weighted-Jaccard signatures, verified by multiset overlap.

A text's multiset holds its five-word shingles (a shorter text is one shingle).
Two texts are linked if the weighted Jaccard similarity of their multisets is at
least ``SIMILARITY``; a class is a connected component of links, and one
document of each class, the one with the least id, is kept.

1. Equal texts are one node, so copies cost nothing further.
2. Each node's signature is cut into bands; nodes that agree in a whole band
   share a bucket. A linked pair shares none with a chance of 3 in a million.
3. Stars: each node is compared with the least node of each of its buckets, so
   a bucket of any size costs one pair per node. Links give components.
4. Rest: buckets that still hold nodes of different components are finished
   exactly. Shingles are ordered by how many of these nodes hold them, rare ones
   first; a linked pair must share one of the rarest n - need + 1 shingles of
   both (prefix filter), and lengths, positions and parity marks must allow the
   overlap: two multisets differ in at least as many elements as in marks.
   Stars over the elements join most of them first.
   Only nodes of different components are paired, over shingles that different
   components hold: neither all pairs of a group nor a cap on any.

Every candidate is verified on the whole multisets.

Defined results: a null text counts as empty; texts without words are equal to
those with the same text only; of a class, the row with the least id is kept (a
null id is larger than any), of equal ids exactly one row; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.llm.bagminhash import bands, mix, signatures
from joblode.llm.components import components
from joblode.llm.registry import case, documents
from joblode.llm.tokens import narrow
from joblode.session import staged

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
# Words whose hashes a worker keeps, for as long as it lives; shingles that go through one signature step.
CACHE, STEP = 100_000, 100_000
# Node numbers, of 8 bytes each, that are sent to every task.
BROADCAST_IDS = 2_000_000
# Counters of the shingle frequencies by which the prefix filter orders.
COUNTERS = 1 << 20
# Parity bits of a multiset, in 64-bit numbers.
MARKS = 8
# Rounds of stars over prefix elements before the rest is paired.
STARS = 2


def text_key(text: str) -> Column:
    """Equal for equal texts."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


class Words(dict):
    """Hashes of words, kept up to ``CACHE`` of them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = Words()


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a text and how often each stands."""
    words = (text or "").split()
    if not words:
        return np.empty(0, "uint64"), np.empty(0, "int64")
    hashes = np.fromiter(map(_WORDS.__getitem__, words), "uint64", len(words))
    size = min(SHINGLE, len(hashes))
    out = np.zeros(len(hashes) - size + 1, "uint64")
    for k in range(size):
        out = mix(out ^ hashes[k:len(hashes) - size + 1 + k])
    return np.unique(out, return_counts=True)


def elements(text: str | None) -> np.ndarray:
    """The multiset as a set: the k-th copy of a shingle is an element of its own. Sorted."""
    found, counts = shingles(text)
    if not len(found) or counts.max() == 1:
        return found.astype("int64")
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.repeat(found, counts)
    return np.sort(np.where(copy == 0, out, mix(out ^ mix(copy.astype("uint64")))).astype("int64"))


def marks(own: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements that fall on each of 64 * ``MARKS`` places."""
    odd = np.bincount((own % (64 * MARKS)), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype("uint8"), bitorder="little").view("int64")


def _signed(texts: list[str | None], n_bands: int, rows: int) -> tuple[list[int], list[np.ndarray]]:
    """(multiset sizes, band hashes) of texts; a text without words has no bands."""
    sizes, out = [], [np.empty(0, "int64")] * len(texts)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> None:
        if held:
            doc = np.repeat(np.arange(len(held)), [len(e) for _, e, _ in held])
            sig = signatures(doc, np.concatenate([e for _, e, _ in held]), np.concatenate([w for *_, w in held]),
                             len(held), n_bands * rows)
            for (at, _, _), b in zip(held, bands(sig, rows).astype("int64")):
                out[at] = b
            held.clear()

    for at, text in enumerate(texts):
        found, counts = shingles(text)
        sizes.append(int(counts.sum()))
        if len(found):
            held.append((at, found, counts))
            count += len(found)
            if count >= STEP:
                flush()
                count = 0
    flush()
    return sizes, out


def signed_rows(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(row, doc_id, key, n, bands) of each document; equal keys are equal texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = _signed(batch.column("text").to_pylist(), n_bands, rows)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()),
                pa.array(np.concatenate(found) if found else np.empty(0, "int64")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), lists],
                names=["row", "doc_id", "key", "n", "bands"])
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                        text_key("text").alias("key"), "text")
    return keyed.mapInArrow(run, "row long, doc_id long, key string, n long, bands array<long>")


def semi(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids``: few ids go to every task, many are joined by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, "left_semi")


def alike(least: float) -> Column:
    """Whether the multisets ``ea`` and ``eb`` reach the similarity."""
    both = F.size(F.array_intersect("ea", "eb"))
    return both >= F.lit(least) * (F.size("ea") + F.size("eb") - both) - 1e-9


def sizes_allow(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) that reach the similarity. ``sets``: node, elements."""
    first = pairs.join(sets.select(F.col("node").alias("u"), F.col("elements").alias("ea")), "u")
    return (first.join(sets.select(F.col("node").alias("v"), F.col("elements").alias("eb")), "v")
            .filter(alike(least)).select("u", "v"))


def with_component(nodes: DataFrame, least: DataFrame, node: str = "node") -> DataFrame:
    """Adds ``comp``: the least node of the node's component, itself if it has no link."""
    known = least.select(F.col("node").alias(node), F.col("least").alias("_least"))
    return nodes.join(known, node, "left").withColumn("comp", F.coalesce("_least", node)).drop("_least")


def element_table(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, elements, marks), one or more equal rows per node. ``rows``: node, node_key and one of the node's ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [elements(t) for t in batch.column("text").to_pylist()]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()),
                pa.array(np.concatenate(found) if found else np.empty(0, "int64")))
            parity = pa.array([marks(f).tolist() for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists, parity], names=["node", "elements", "marks"])
    few = rows.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", text_key("text").alias("key"), "text")
    found = texts.join(F.broadcast(rows) if few else rows,
                       texts["doc_id"].eqNullSafe(rows["doc"]) & (texts["key"] == rows["node_key"]))
    return found.select("node", "text").mapInArrow(run, "node long, elements array<long>, marks array<long>")


def rare_first(mixed: DataFrame, least: float) -> DataFrame:
    """(node, comp, n, at, element): the elements of each node's prefix in global order, from 0.

    ``mixed``: node, comp, elements, marks. The order is by a table of ``COUNTERS`` counters that all
    elements are counted in: a fixed size, and any counts give the same links.
    """
    spark = mixed.sparkSession
    place = F.pmod(F.col("e"), F.lit(COUNTERS)).cast("int")
    counted = mixed.select(F.explode("elements").alias("e")).groupBy(place.alias("c")).count().toArrow()
    counters = np.zeros(COUNTERS, "int64")
    counters[counted["c"].to_numpy()] = counted["count"].to_numpy()
    shared = spark.sparkContext.broadcast(counters.clip(max=2**31 - 1).astype("int32"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            node, comp, size, at, chosen = [], [], [], [], []
            for row, part, own in zip(batch.column("node").to_pylist(), batch.column("comp").to_pylist(),
                                      batch.column("elements")):
                own = own.values.to_numpy()
                prefix = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
                first = own[np.lexsort((own, held[own % COUNTERS]))[:prefix]]
                chosen.append(first)
                node.append(np.full(len(first), row))
                comp.append(np.full(len(first), part))
                size.append(np.full(len(first), len(own)))
                at.append(np.arange(len(first)))
            if node:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype("int64")) for c in (node, comp, size, at, chosen)],
                    names=["node", "comp", "n", "at", "element"])
    return mixed.select("node", "comp", "elements").mapInArrow(
        run, "node long, comp long, n long, at long, element long")


def between_components(tokens: DataFrame) -> DataFrame:
    """The rows whose element nodes of different components hold."""
    shared = tokens.groupBy("element").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b")
    return tokens.join(shared.select("element"), "element", "left_semi")


def rest_links(mixed: DataFrame, sets: DataFrame, known: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(links, components so far) that finish the open buckets. ``known``: (node, least) of the first stars.

    ``STARS`` rounds link each node to the least node of each of its prefix elements, one pair per row;
    what they leave in different components is paired by :func:`rest_pairs`.
    """
    tokens = staged(between_components(staged(rare_first(mixed, least), "prefixes")), "shared-prefixes")
    for _ in range(STARS):
        centers = tokens.groupBy("element").agg(F.min(F.struct("node", "comp", "n")).alias("c"))
        pairs = tokens.join(centers, "element").filter((F.col("comp") != F.col("c.comp")) & sizes_allow("n", "c.n", least))
        links = verified(pairs.select(F.col("node").alias("u"), F.col("c.node").alias("v")).distinct(), sets, least)
        before = known.select(F.col("node").alias("u"), F.col("least").alias("v"))
        known = components(links.unionByName(before))
        tokens = staged(between_components(with_component(tokens.drop("comp"), known)), "shared-prefixes")
    return verified(rest_pairs(tokens, mixed, least), sets, least), known


def rest_pairs(tokens: DataFrame, mixed: DataFrame, least: float) -> DataFrame:
    """(u, v): all pairs of nodes of different components that the prefix, length and position filters let through."""
    tokens = staged(tokens.join(mixed.select("node", *[F.get("marks", k).alias(f"m{k}") for k in range(MARKS)]), "node"),
                    "marked-prefixes")
    a = tokens.select("element", F.col("node").alias("u"), F.col("comp").alias("cu"), F.col("n").alias("nu"),
                      F.col("at").alias("pu"), *[F.col(f"m{k}").alias(f"a{k}") for k in range(MARKS)])
    b = tokens.select(F.col("element").alias("_e"), F.col("node").alias("v"), F.col("comp").alias("cv"),
                      F.col("n").alias("nv"), F.col("at").alias("pv"),
                      *[F.col(f"m{k}").alias(f"b{k}") for k in range(MARKS)])
    # The first shared element allows at most what is left of both behind it.
    most = 1 + F.least(F.col("nu") - F.col("pu") - 1, F.col("nv") - F.col("pv") - 1)
    need = F.lit(least) / (1 + least) * (F.col("nu") + F.col("nv")) - 1e-9
    unlike = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(MARKS)])
    joined = a.join(b, (F.col("element") == F.col("_e")) & (F.col("u") > F.col("v")) & (F.col("cu") != F.col("cv"))
                    & sizes_allow("nu", "nv", least) & (most >= need)
                    & (F.col("nu") + F.col("nv") - unlike >= 2 * need))
    return joined.select("u", "v").distinct()


def near_groups(docs: DataFrame, least: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, class_id, group_size, kept): one row per row of ``docs``; ``key``: :func:`text_key`.

    ``class_id``: the least id of the row's class; ``group_size``: rows of the class.
    """
    docs = narrow(docs, id_col, text_col)
    signed = staged(signed_rows(docs, n_bands, rows), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    nodes = staged(signed.groupBy("key").agg(first, F.min("row").alias("node"), F.count("*").alias("copies"),
                                             F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    # Buckets of more than one node, each with its least node.
    entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    centers = (entries.groupBy("bucket").agg(F.min("node").alias("center"), F.min_by("n", "node").alias("center_n"),
                                             F.count("*").alias("held"))
               .filter("held > 1").drop("held"))
    entries = staged(entries.join(centers, "bucket"), "buckets")
    candidates = entries.select("node").distinct()
    wanted = nodes.join(candidates, "node", "left_semi").select(
        "node", F.col("key").alias("node_key"), F.col("first.doc_id").alias("doc"))
    sets = element_table(docs, staged(wanted, "wanted"))
    if not signed.groupBy("doc_id").agg(F.count("*").alias("held")).filter("held > 1").isEmpty():
        sets = sets.dropDuplicates(["node"])  # an id may name several rows with this text
    sets = staged(sets, "sets")

    stars = (entries.filter("node <> center").filter(sizes_allow("n", "center_n", least))
             .select(F.col("node").alias("u"), F.col("center").alias("v")).distinct())
    links = staged(verified(stars, sets, least), "star-links")
    least_of = components(links)

    placed = staged(with_component(entries.select("bucket", "node"), least_of), "placed")
    open_buckets = placed.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b")
    open_nodes = staged(placed.join(open_buckets.select("bucket"), "bucket", "left_semi")
                        .select("node", "comp").distinct(), "open-nodes")
    mixed = staged(sets.join(open_nodes, "node"), "mixed")
    more, least_of = rest_links(mixed, sets, least_of, least)
    more = staged(more, "rest-links")
    if not more.isEmpty():
        least_of = components(more.unionByName(least_of.select(F.col("node").alias("u"), F.col("least").alias("v"))))

    whole = with_component(nodes.select("key", "node", "copies", "first"), least_of)
    classes = whole.groupBy("comp").agg(F.min("first").alias("best"), F.sum("copies").alias("group_size"))
    known = staged(whole.join(classes, "comp").select("key", "best", "group_size"), "classes")
    return signed.select("row", "doc_id", "key").join(known, "key").select(
        "doc_id", "key", F.col("best.doc_id").alias("class_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"))


@case("op7_near_dedup")
def op7(spark, sf_dir):
    return near_groups(documents(spark, sf_dir)).drop("key")
