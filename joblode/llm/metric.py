"""Jaccard join in the metric space of shingle sets: regions around pivots, boundary windows, recursion.

A text's set holds the hashes of its distinct three-word shingles, A-Z lower-cased. One
minus the Jaccard similarity is a metric d; two texts are linked if d is at most
``1 - SIMILARITY`` (e below). Classes are connected components of links.

1. Equal sets are one node, so copies cost nothing further.
2. Regions. Nodes that agree in a key (two minima of hashes) meet one pivot of the
   key, round after round with other keys. A node within e of a pivot is linked to it
   and joins the region of the nearest pivot that it has met; what is near none is a pivot
   of its own. So a region is one class already, however many rows it holds, and its
   radius r, the largest distance of a member, is at most e.
3. Windows. A link between members of the regions of p and q needs
   d(p, q) <= r(p) + e + r(q). Such pivots must share one of their rarest shingles
   (prefix, length and position filters for just that distance): in a space as sparse as
   this nearly all distances are 1, and only shared shingles tell the others.
   Only pivots of different classes are paired, and parity marks, as many as a set has
   elements, rule out most pairs before any whole set is made or moved.
4. Boundary. For near pivots whose classes still differ, a member x of p goes over to
   q if d(x, q) <= e + r(q); the triangle inequality rules out those with
   d(x, p) < d(p, q) - e - r(q), and parities of element counts most others, before any set
   is compared. Links with q itself are found here.
5. Recursion. What went over between two regions with members is joined by the same
   steps with other keys; at ``DEPTH`` every node is its own region, so step 3 finds
   all that is left.

Nothing is sampled or capped: keys and pivots decide how much work is saved, not which
links are found. Every link is verified on whole sets.

Defined results: a null text counts as empty; a text without words has an empty
set and a class of its own; one or two words are one shingle; ids may repeat and be null:
a class has its least id, null only if it has none; other columns of any name
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.llm.bagminhash import mix
from joblode.llm.components import components
from joblode.llm.registry import case, documents
from joblode.llm.tokens import narrow
from joblode.session import staged

SHINGLE = 3
SIMILARITY = 0.9
REACH = 1 - SIMILARITY
# Keys that each depth deals nodes out by; depths of regions before every node is its own.
LEVELS, DEPTH = 3, 2
SLACK = 1e-9
# Counters of shingles, by which prefixes are ordered.
COUNTERS = 1 << 18
# Places of the filter on shingles of regions with members: so many for each shingle, and their bits within bounds.
PLACES_EACH, LEAST_BITS, MOST_BITS = 16, 22, 28
# Parity bits of a set, in 64-bit numbers: of every set, and the most that a large set has.
MARKS, MOST_MARKS = 8, 1 << 18
# Bytes of a text that are hashed at once, and of texts that are shingled at once.
STEP = 1 << 20
# Bytes that are sent to every task to pick rows; more are joined by a shuffle. A row has five numbers at most.
BROADCAST_BYTES, ROW_BYTES, ID_BYTES = 16 << 20, 40, 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20_240_101).integers(1 << 62, size=2 * LEVELS * DEPTH, dtype="uint64") * np.uint64(2) + np.uint64(1)


def _powers(count: int, made: list = [np.ones(1, "uint64")]) -> np.ndarray:  # noqa: B006
    if len(made[0]) < count:
        made[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * count, _BASE))])
    return made[0]


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased, in order."""
    out, at = [], 0
    while at < len(text):
        raw = np.frombuffer(text, "uint8", min(STEP, len(text) - at), at)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        if at + len(raw) < len(text):  # a part ends with a blank, however long its last word is
            last = np.flatnonzero(blank)
            if len(last):
                raw, blank = raw[:last[-1] + 1], blank[:last[-1] + 1]
            else:
                rest = np.frombuffer(text, "uint8", -1, at)
                ends = np.flatnonzero((rest == 32) | ((rest >= 9) & (rest <= 13)))
                raw = rest[:ends[0] + 1] if len(ends) else rest
                blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        at += len(raw)
        turns = np.diff(np.concatenate([[0], (~blank).view("int8"), [0]]).astype("int8"))
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        if not len(starts):
            continue
        letters, sizes = raw[~blank].astype("uint64"), ends - starts
        letters += np.where((letters >= 65) & (letters <= 90), np.uint64(33), np.uint64(1))
        first = np.cumsum(sizes) - sizes
        letters *= _powers(int(sizes.max()))[np.arange(len(letters)) - np.repeat(first, sizes)]
        out.append(mix(np.add.reduceat(letters, first) ^ (sizes.astype("uint64") << np.uint64(48))))
    return np.concatenate(out) if out else np.empty(0, "uint64")


def sets_of(texts: list[str | None]) -> list[np.ndarray]:
    """The set of each text: hashes in ascending order."""
    out: list[np.ndarray] = []
    held: list[np.ndarray] = []
    count = 0

    def flush() -> None:
        sizes = np.array([len(w) for w in held], "int64")
        words = np.concatenate([np.empty(0, "uint64"), *held])
        doc = np.repeat(np.arange(len(held)), sizes)
        first = np.cumsum(sizes) - sizes
        # Words that a shingle takes at each place: all three, or what a shorter text has.
        take = np.minimum(sizes, SHINGLE)
        starts = np.arange(len(words))
        starts = starts[starts <= (first + sizes - take)[doc]]
        own = doc[starts]
        shingle = mix(words[starts])
        for k in range(1, SHINGLE):
            more = take[own] > k
            shingle[more] = mix(shingle[more] ^ words[starts[more] + k])
        order = np.lexsort((shingle, own))
        shingle, own = shingle[order], own[order]
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (own[1:] != own[:-1])
        shingle, own = shingle[new], own[new]
        out.extend(np.split(shingle, np.cumsum(np.bincount(own, minlength=len(held)))[:-1]) if held else [])
        held.clear()

    for text in texts:
        held.append(word_hashes((text or "").encode("utf-8", "surrogatepass")))
        count += len(held[-1])
        if count >= STEP // 4:
            flush()
            count = 0
    flush()
    return out


def keys_of(sets: list[np.ndarray]) -> np.ndarray:
    """Keys of sets that are not empty, one row per set."""
    sizes = np.array([len(s) for s in sets])
    all_, first = np.concatenate(sets), np.cumsum(sizes) - sizes
    least = [np.minimum.reduceat(all_ * seed, first) for seed in _SEEDS]
    return np.stack([mix(a ^ mix(b)) for a, b in zip(least[::2], least[1::2])], 1).view("int64")


def marks_of(own: np.ndarray, numbers: int = MARKS) -> np.ndarray:
    """Parities of the numbers of elements that fall on each of 64 * ``numbers`` places."""
    odd = np.bincount((own >> np.uint64(40)).astype("int64") % (64 * numbers), minlength=64 * numbers) & 1
    return np.packbits(odd.astype("uint8"), bitorder="little").view("int64")


def fine_marks_of(own: np.ndarray) -> np.ndarray:
    """Parities on one to two places for each element: few places tell large sets not apart. The numbers are a
    power of two, so the exclusive or of both halves is what half of them would be."""
    return marks_of(own, min(MOST_MARKS, max(MARKS, 1 << (len(own) // 64).bit_length())))


def ragged(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()),
                                    pa.array(np.concatenate([np.empty(0, "int64"), *rows]), kind))


def text_tag(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def read_sets(docs: DataFrame) -> DataFrame:
    """(row, doc_id, tag, n, key, keys) of each document; besides, (place, held): shingles of a task by counter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, "int64")
        for batch in batches:
            sets = sets_of(batch.column("text").to_pylist())
            full = [s for s in sets if len(s)]
            keys = iter(keys_of(full) if full else ())
            for s in full:
                counters += np.bincount(s % np.uint64(COUNTERS), minlength=COUNTERS) if len(s) > COUNTERS // 16 else 0
            short = [s for s in full if len(s) <= COUNTERS // 16]
            if short:
                counters += np.bincount(np.concatenate(short) % np.uint64(COUNTERS), minlength=COUNTERS)
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("tag"),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())), none, none],
                names=["row", "doc_id", "tag", "n", "key", "keys", "place", "held"])
        place = np.flatnonzero(counters)
        for at in range(0, len(place), 1 << 16):
            some = place[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(len(some), t) for t in (*[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64()))],
                 pa.array(some, pa.int32()), pa.array(counters[some].clip(max=2**31 - 1), pa.int32())],
                names=["row", "doc_id", "tag", "n", "key", "keys", "place", "held"])
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_tag("text").alias("tag"), "text")
    return own.mapInArrow(run, "row long, doc_id long, tag long, n long, key binary, keys array<long>, place int, held int")


def counters_of(read: DataFrame) -> np.ndarray:
    """All documents' shingles by counter: a table of fixed size."""
    counted = read.filter("place IS NOT NULL").groupBy("place").agg(F.sum("held").alias("held")).toArrow()
    out = np.zeros(COUNTERS, "int64")
    out[counted["place"].to_numpy()] = counted["held"].to_numpy()
    return out


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns of ``rows`` (with node, doc, tag) and the text. ``docs``: without repeated rows."""
    few = rows.count() * ROW_BYTES <= BROADCAST_BYTES
    texts = docs.select("doc_id", text_tag("text").alias("_tag"), "text")
    found = texts.join(F.broadcast(rows) if few else rows,
                       texts["doc_id"].eqNullSafe(rows["doc"]) & (texts["_tag"] == rows["tag"]))
    return found.select(*rows.columns, "text")


def set_table(docs: DataFrame, rows: DataFrame, elements: bool = True) -> DataFrame:
    """(node, n, marks, fine, elements); without ``elements`` a small part of it. ``rows``: node, doc, tag."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column("text").to_pylist())
            listed = [[marks_of(s) for s in sets], [fine_marks_of(s) for s in sets]]
            listed += [[s.view("int64") for s in sets]] if elements else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), *[ragged(x, pa.int64()) for x in listed]],
                names=["node", "n", "marks", "fine", "elements"][:2 + len(listed)])
    return texts_of(docs, rows).select("node", "text").mapInArrow(
        run, "node long, n long, marks array<long>, fine array<long>" + ", elements array<long>" * elements)


def signs_of(sets: DataFrame, node: str, prefix: str) -> DataFrame:
    """(node, size, parities) of sets, under names of their own."""
    return sets.select(F.col("node").alias(node), F.col("n").cast("int").alias(f"{prefix}n"),
                       *[F.get("marks", k).alias(f"{prefix}{k}") for k in range(MARKS)])


def may_reach(a: str, b: str, least: Column, unlike: Column | None = None) -> Column:
    """Whether sizes and parities allow the similarity: sets differ in at least as many elements as in parities."""
    if unlike is None:
        unlike = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(MARKS)])
    m, n = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(m, n) >= least * F.greatest(m, n) - SLACK) & (m + n - unlike >= least * (m + n + unlike) - SLACK)


def fine_unlike(a: str, b: str) -> Column:
    """How many parities of two lists of fine marks differ; the longer one is folded to the length of the other."""
    numbers = F.least(F.size(a), F.size(b))

    def folded(marks: str, at: Column) -> Column:
        return F.aggregate(F.sequence(at, F.size(marks) - 1, numbers), F.lit(0).cast("long"),
                           lambda x, k: x.bitwiseXOR(F.get(marks, k)))
    return F.aggregate(F.sequence(F.lit(0), numbers - 1), F.lit(0),
                       lambda x, at: x + F.bit_count(folded(a, at).bitwiseXOR(folded(b, at))))


def possible(pairs: DataFrame, sets: DataFrame, least: Column) -> DataFrame:
    """The pairs (u, v) whose sizes and parities allow the similarity."""
    both = pairs.join(signs_of(sets, "u", "a"), "u").join(signs_of(sets, "v", "b"), "v")
    return both.filter(may_reach("a", "b", least)).select(*pairs.columns)


def sets_in(sets: DataFrame, pairs: DataFrame, node: str) -> DataFrame:
    """The sets that the pairs name in ``node``: a set is large, and only those are shuffled."""
    ids = pairs.select(F.col(node).alias("node")).distinct()
    return sets.join(F.broadcast(ids), "node", "left_semi") if ids.count() * ID_BYTES <= BROADCAST_BYTES else sets


def finely_possible(pairs: DataFrame, sets: DataFrame, least: Column) -> DataFrame:
    """The pairs (u, v) whose fine marks allow the similarity. A set's fine marks are a small part of its elements,
    so large sets that only share a shingle are told apart before their elements are shuffled for each pair."""
    def signs(node: str, prefix: str) -> DataFrame:
        return sets_in(sets, pairs, node).select(F.col("node").alias(node), F.col("n").alias(f"{prefix}n"),
                                                 F.col("fine").alias(f"{prefix}f"))
    both = pairs.join(signs("u", "a"), "u").join(signs("v", "b"), "v")
    return both.filter(may_reach("a", "b", least, fine_unlike("af", "bf"))).select(*pairs.columns)


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds dist, the distance, and linked to the pairs (u, v)."""
    pairs = staged(pairs, "measured-pairs")
    a = sets_in(sets, pairs, "u").select(F.col("node").alias("u"), F.col("elements").alias("_ea"))
    b = sets_in(sets, pairs, "v").select(F.col("node").alias("v"), F.col("elements").alias("_eb"))
    out = pairs.join(a, "u").join(b, "v").withColumn("_both", F.size(F.array_intersect("_ea", "_eb")))
    all_ = F.size("_ea") + F.size("_eb") - F.col("_both")
    return out.withColumns({"dist": 1 - F.col("_both") / all_, "linked": 100 * F.col("_both") >= round(100 * SIMILARITY) * all_}).drop(
        "_ea", "_eb", "_both")


def with_class(nodes: DataFrame, known: DataFrame | None, node: str = "node") -> DataFrame:
    """Adds comp: the least node of the node's class so far."""
    if known is None:
        return nodes.withColumn("comp", F.col(node))
    least = known.select(F.col("node").alias(node), F.col("least").alias("_least"))
    return nodes.join(least, node, "left").withColumn("comp", F.coalesce("_least", node)).drop("_least")


def classes(links: DataFrame, known: DataFrame | None) -> DataFrame:
    links = links.select("u", "v")
    if known is not None:
        links = links.unionByName(known.select(F.col("node").alias("u"), F.col("least").alias("v")))
    return components(links)


def shared_key(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes that share a key of this depth with another node."""
    own = F.slice("keys", depth * LEVELS + 1, LEVELS)
    entries = nodes.select("node", F.posexplode(own).alias("at", "k"))
    many = entries.groupBy("at", "k").agg(F.count("*").alias("held")).filter("held > 1").drop("held")
    return entries.join(many, ["at", "k"], "left_semi").select("node").distinct()


def regions(nodes: DataFrame, sets: DataFrame, depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, pivot, dist, members, ...) of ``nodes`` (node, n, keys), and the links found."""
    state = nodes.withColumns({"pivot": F.col("node"), "dist": F.lit(0.0), "members": F.lit(0).cast("long")})
    links = []
    for level in range(LEVELS):
        keyed = state.withColumn("k", F.get("keys", F.lit(depth * LEVELS + level)))
        # The pivot of a key is the one with most members, of equal ones the least.
        best = F.max(F.struct("members", (-F.col("node")).alias("neg"), "n")).alias("best")
        centers = keyed.filter("pivot = node").groupBy("k").agg(best).select(
            "k", (-F.col("best.neg")).alias("v"), F.col("best.n").alias("vn"))
        sizes = F.least("n", "vn") >= SIMILARITY * F.greatest("n", "vn") - SLACK
        pairs = keyed.join(centers, "k").filter((F.col("node") != F.col("v")) & (F.col("pivot") != F.col("v")) & sizes)
        pairs = pairs.select(F.col("node").alias("u"), "v", "pivot", "members", F.col("dist").alias("old"))
        pairs = possible(pairs, sets, F.lit(SIMILARITY - SLACK))
        near = staged(measured(pairs, sets).filter("linked"), "region-links")
        links.append(near.select("u", "v"))
        moves = near.filter("members = 0 AND (pivot = u OR dist < old)").select(
            F.col("u").alias("node"), F.col("v").alias("_to"), F.col("dist").alias("_far"))
        moved = state.drop("members").join(moves, "node", "left").withColumns(
            {"pivot": F.coalesce("_to", "pivot"), "dist": F.coalesce("_far", "dist")}).drop("_to", "_far")
        held = moved.filter("pivot <> node").groupBy(F.col("pivot").alias("node")).agg(F.count("*").alias("members"))
        state = staged(moved.join(held, "node", "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long"))),
                       "regions")
    return state, links


def prefix_of(n: np.ndarray | int, least: float):
    """How many of the rarest elements two sets of similarity ``least`` share one of."""
    return n - np.ceil(least * n - SLACK).astype("int64") + 1


def prefixes(pivots: DataFrame, counters: np.ndarray, extra: bool, places: np.ndarray | None = None) -> DataFrame:
    """(node, comp, n, r, at, element): each pivot's prefix in global order, rarest element first.

    ``pivots``: node, comp, r and text or elements. The prefix serves the largest distance that a pivot of
    this radius may have to another; without ``extra`` no other has members. What serves only a pivot
    with members is left out if ``places``, a bit per place of their elements, has it not.
    """
    spark = pivots.sparkSession
    # Orders of magnitude in steps of a sixteenth: one byte per counter.
    rank = np.minimum(np.log2(counters + 1) * 16, 255).astype("uint8")
    shared = spark.sparkContext.broadcast((rank, places))
    by_text = "text" in pivots.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, places = shared.value
        for batch in batches:
            sets = (sets_of(batch.column("text").to_pylist()) if by_text
                    else [x.values.to_numpy().view("uint64") for x in batch.column("elements")])
            node, comp, far = (batch.column(c).to_numpy() for c in ("node", "comp", "r"))
            chosen, ats = [], []
            for own, r in zip(sets, far):
                count = prefix_of(len(own), SIMILARITY - r - (REACH if extra else 0))
                order = np.lexsort((own, rank[(own % np.uint64(COUNTERS)).astype("int64")]))[:count]
                first, at = own[order], np.arange(len(order))
                if places is not None and r == 0:
                    spot = (first % np.uint64(8 * len(places))).astype("int64")
                    keep = (at < prefix_of(len(own), SIMILARITY)) | ((places[spot >> 3] >> (spot & 7).astype("uint8")) & 1 > 0)
                    first, at = first[keep], at[keep]
                chosen.append(first.view("int64"))
                ats.append(at)
            sizes = [len(c) for c in chosen]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node, sizes)), pa.array(np.repeat(comp, sizes)),
                     pa.array(np.repeat([len(s) for s in sets], sizes), pa.int32()), pa.array(np.repeat(far, sizes)),
                     pa.array(np.concatenate(ats), pa.int32()), pa.array(np.concatenate(chosen))],
                    names=["node", "comp", "n", "r", "at", "element"])
    return pivots.select("node", "comp", "r", "text" if by_text else "elements").mapInArrow(
        run, "node long, comp long, n int, r double, at int, element long")


def places_of(tokens: DataFrame) -> np.ndarray:
    """A bit for each place that an element falls on. The table grows with the elements, so that as few
    places are taken by chance at any size; the driver sees numbers of 64 places."""
    bits = min(MOST_BITS, max(LEAST_BITS, (PLACES_EACH * tokens.count()).bit_length()))
    place = F.pmod(F.col("element"), F.lit(1 << bits))
    held = tokens.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(pmod(element, {1 << bits}L) & 63))")).alias("held")).toArrow()
    out = np.zeros((1 << bits) // 64, "<i8")
    out[held["w"].to_numpy()] = held["held"].to_numpy()
    return out.view("uint8")


def near_pivots(tokens: DataFrame) -> DataFrame:
    """(u, v, ru, rv): pairs of different classes whose filters allow r(u) + e + r(v)."""
    a = tokens.select(F.col("element"), *[F.col(c).alias(f"{c}_u") for c in ("node", "comp", "n", "r", "at")])
    b = tokens.select(F.col("element").alias("_e"), *[F.col(c).alias(f"{c}_v") for c in ("node", "comp", "n", "r", "at")])
    least = F.lit(SIMILARITY) - F.col("r_u") - F.col("r_v") - SLACK
    sizes = F.least("n_u", "n_v") >= least * F.greatest("n_u", "n_v") - SLACK
    within = (F.col("at_u") <= F.col("n_u") * (1 - least) + SLACK) & (F.col("at_v") <= F.col("n_v") * (1 - least) + SLACK)
    # The first shared element allows at most what is left of both behind it.
    most = 1 + F.least(F.col("n_u") - F.col("at_u") - 1, F.col("n_v") - F.col("at_v") - 1)
    enough = most >= least / (1 + least) * (F.col("n_u") + F.col("n_v")) - SLACK
    joined = a.join(b, (F.col("element") == F.col("_e")) & (F.col("node_u") > F.col("node_v"))
                    & (F.col("comp_u") != F.col("comp_v")) & sizes & within & enough)
    return joined.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), F.col("r_u").alias("ru"), F.col("r_v").alias("rv")).distinct()


def boundary(near: DataFrame, state: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, q, rq, dist, linked): members that may have a link into the region of q, which is near their pivot's.

    ``near``: p, q, rp, rq, dist; ``state``: of :func:`regions`.
    """
    asked = near.join(signs_of(sets, "q", "b"), "q")
    members = state.filter("pivot <> node").select(F.col("node").alias("x"), F.col("pivot").alias("_p"), F.col("dist").alias("dx"))
    met = asked.join(members.join(signs_of(sets, "x", "a"), "x"),
                     (F.col("p") == F.col("_p")) & (F.col("dx") >= F.col("dist") - REACH - F.col("rq") - SLACK)
                     & may_reach("a", "b", F.lit(SIMILARITY) - F.col("rq") - SLACK))
    pairs = met.select(F.col("x").alias("u"), F.col("q").alias("v"), "rq").distinct()
    return measured(pairs, sets).filter(F.col("dist") <= REACH + F.col("rq") + SLACK)


def region_links(nodes: DataFrame, docs: DataFrame, sets: DataFrame | None, counters: np.ndarray, known: DataFrame | None,
                 depth: int = 0) -> DataFrame | None:
    """(node, least): classes after all links among ``nodes`` (node, doc, tag, n, keys). ``sets``: theirs, if written."""
    state = None
    if depth < DEPTH:
        close = staged(nodes.join(shared_key(nodes, depth), "node", "left_semi"), "close-nodes")
        own = sets if sets is not None else staged(set_table(docs, close.select("node", "doc", "tag")), "sets")
        state, links = regions(close.select("node", "n", "keys"), own, depth)
        found = reduce(DataFrame.unionByName, links)
        if not found.isEmpty():
            known = classes(found, known)
        radius = state.groupBy(F.col("pivot").alias("node")).agg(F.max("dist").alias("r"))
        # What no region took in stays as it was: a pivot without members.
        gone = state.filter("pivot <> node").select("node")
        pivots = nodes.join(gone, "node", "left_anti").join(radius, "node", "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    else:
        own, pivots = sets, nodes.withColumn("r", F.lit(0.0))
    pivots = staged(with_class(pivots.select("node", "doc", "tag", "r"), known), "pivots")

    def tokens(some: DataFrame, extra: bool, places: np.ndarray | None = None) -> DataFrame:
        source = texts_of(docs, some) if sets is None else some.join(sets.select("node", "elements"), "node")
        return prefixes(source, counters, extra, places)
    full = pivots.filter("r > 0")
    extra = not full.isEmpty()
    if extra:
        of_full = staged(tokens(full, True), "region-prefixes")
        own_tokens = of_full.unionByName(tokens(pivots.filter("r = 0"), True, places_of(of_full)))
    else:
        own_tokens = tokens(pivots, False)
    # Written as one table: one shuffle of it serves both sides of the join.
    pairs = near_pivots(staged(own_tokens, "prefixes"))
    pairs = staged(pairs, "near-pivots")
    if sets is None:
        lacking = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        lacking = staged(nodes.join(lacking, "node", "left_semi").join(own.select("node"), "node", "left_anti").select(
            "node", "doc", "tag"), "lacking")
        signs = own.drop("elements").unionByName(staged(set_table(docs, lacking, elements=False), "more-marks"))
    else:
        signs = own
    least = F.lit(SIMILARITY) - F.col("ru") - F.col("rv") - SLACK
    pairs = staged(possible(pairs, signs, least), "possible-pairs")
    pairs = staged(finely_possible(pairs, signs, least), "fine-pairs")
    if sets is None:
        # Pairs by a shared shingle grow faster than the input; whole sets are made only for those that marks let through.
        asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        own = own.unionByName(staged(set_table(docs, staged(lacking.join(asked, "node", "left_semi"), "asked")), "more-sets"))
    near = staged(measured(pairs, own).filter(F.col("dist") <= REACH + F.col("ru") + F.col("rv") + SLACK), "near-measured")
    links = near.filter("linked").select("u", "v")
    if not links.isEmpty():
        known = classes(links, known)
    if not extra:
        return known
    open_ = near.filter("ru > 0 OR rv > 0").drop("linked")
    open_ = with_class(with_class(open_, known, "u").withColumnRenamed("comp", "cu"), known, "v").filter("cu <> comp")
    turned = open_.select(F.col("u").alias("p"), F.col("v").alias("q"), F.col("ru").alias("rp"), F.col("rv").alias("rq"), "dist")
    other = open_.select(F.col("v").alias("p"), F.col("u").alias("q"), F.col("rv").alias("rp"), F.col("ru").alias("rq"), "dist")
    over = staged(boundary(turned.unionByName(other).filter("rp > 0"), state, own), "boundary")
    links = over.filter("linked").select("u", "v")
    if not links.isEmpty():
        known = classes(links, known)
    # Members that went over to a region with members of another class; the region's own boundary goes the other way.
    rest = with_class(with_class(over.filter("rq > 0").select("u", "v"), known, "u").withColumnRenamed("comp", "cu"), known, "v")
    rest = rest.filter("cu <> comp").select(F.col("u").alias("node")).distinct()
    rest = staged(nodes.join(rest, "node", "left_semi"), "boundary-nodes")
    if rest.isEmpty():
        return known
    return region_links(rest, docs, staged(own.join(rest.select("node"), "node", "left_semi"), "boundary-sets"), counters, known, depth + 1)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, group_size): one row per row of ``docs``.

    ``group_size``: rows of the class.
    """
    docs = narrow(docs, id_col, text_col)
    read = staged(read_sets(docs), "metric-sets")
    rows = read.filter("row IS NOT NULL").select("row", "doc_id", "tag", "n", "key", "keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")
    nodes = staged(rows.filter("n > 0").groupBy("key").agg(
        F.min(F.struct("row", "doc_id", "tag", "n", "keys")).alias("one"), first, F.count("*").alias("copies")).select(
        "key", "first", "copies", F.col("one.row").alias("node"), F.col("one.doc_id").alias("doc"), "one.tag", "one.n", "one.keys"),
        "metric-nodes")
    if not rows.groupBy("doc_id", "tag").agg(F.count("*").alias("held")).filter("held > 1").isEmpty():
        docs = staged(docs.dropDuplicates(["doc_id", "text"]), "distinct-rows")
    known = region_links(nodes.select("node", "doc", "tag", "n", "keys"), docs, None, counters_of(read), None)
    whole = with_class(nodes.select("key", "node", "first", "copies"), known)
    least = whole.groupBy("comp").agg(F.min("first").alias("best"), F.sum("copies").alias("group_size"))
    placed = staged(whole.join(least, "comp").select("key", F.col("best.doc_id").alias("component_id"), "group_size"), "metric-classes")
    # Only copies and linked texts meet their class; the rest is its own.
    several = placed.filter("group_size > 1")
    own = F.col("group_size").isNull()
    return rows.select("doc_id", "n", "key").join(several, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))


@case("op12_jaccard_join")
def op12(spark, sf_dir):
    return jaccard_classes(documents(spark, sf_dir))
