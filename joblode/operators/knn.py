"""Exact cosine search.

Scores are rounded to six digits before they are compared, so that equal vectors
tie whatever the order of summation, and ties go to the smaller vector id.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6

# A query table up to this many numbers is shared with every task; beyond it
# queries and vectors are paired block by block in a shuffle.
SHARED_NUMBERS = 4 << 20
BLOCK_VECTORS = 1 << 15
# Most numbers of a block, of queries or of vectors, and the groups of blocks for each core.
HELD_NUMBERS = 8 << 20
GROUPS_PER_CORE = 4
# Vectors that are scored at once against one query.
ONE_SLICE = 1 << 10


def where_column(where: Column | Mapping[str, str] | None) -> Column | None:
    """A predicate given as a column, or as equality on metadata keys."""
    if where is None or isinstance(where, Column):
        return where
    test = F.lit(True)
    for key, value in where.items():
        test = test & (F.try_element_at(F.col("metadata"), F.lit(key)) == F.lit(str(value)))
    return test


def searched(vectors: DataFrame, where: Column | Mapping[str, str] | None) -> DataFrame:
    """Rows that a search looks at."""
    test = where_column(where)
    return vectors if test is None else vectors.filter(test)


def scored(vectors: DataFrame, query: Sequence[float],
           where: Column | Mapping[str, str] | None) -> DataFrame:
    """Those rows with their ``score``, NULL for rows without a vector.

    NULLs are to be dropped after the top-n, where they come last: a filter right
    here would be pushed down and score every row twice.
    """
    return searched(vectors, where).withColumn(
        "score", ranked_score(cosine("embedding", query)))


def ranked_score(score: Column) -> Column:
    """A score as results are ordered by it."""
    return F.round(score, DIGITS)


def cosine(column: str, query: Sequence[float]) -> Column:
    """Cosine similarity to one vector; 0 if either has no length, NULL for NULL."""
    target = list(map(float, query))

    step = ONE_SLICE

    def score(arrays):
        import numpy as np
        import pyarrow as pa
        given = arrays.is_valid().to_numpy(zero_copy_only=False)
        vector, length = np.asarray(target), np.sqrt(np.dot(target, target))
        scores = np.zeros(len(arrays))
        # In slices: a whole batch of wide vectors in double precision is many times the batch.
        for at in range(0, len(arrays), step):
            rows = np.asarray(arrays[at:at + step].drop_null().flatten(), dtype=np.float64)
            on = np.flatnonzero(given[at:at + step]) + at
            if len(rows) != len(on) * len(target):
                raise ValueError(f"vectors are not all {len(target)} wide")
            rows = rows.reshape(-1, len(target))
            lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * length
            dots = rows @ vector
            scores[on] = np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)
        return pa.array(scores, mask=~given)

    return F.arrow_udf(score, "double")(F.col(column))


def query_vector(query: DataFrame) -> list[float]:
    """The vector of a one-row query table."""
    rows = query.select("embedding").limit(2).collect()
    if len(rows) != 1 or rows[0][0] is None:
        raise ValueError("the query must be exactly one vector")
    return list(rows[0][0])


def search(vectors: DataFrame, query: Sequence[float] | DataFrame, n_results: int = 10,
           where: Column | Mapping[str, str] | None = None) -> DataFrame:
    """The ``n_results`` nearest vectors of one query, with ``score`` and ``rank``.

    Only the embedding travels to Python; the top-n carries the other columns.
    """
    if isinstance(query, DataFrame):
        query = query_vector(query)
    best = scored(vectors, query, where).orderBy(F.desc("score"), "vector_id").limit(
        n_results).filter(F.col("score").isNotNull())
    # At most n_results rows are left to number.
    return best.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("score"), F.col("vector_id"))))


def _scorer(k: int, id_type):
    """Functions that merge vectors into the best ``k`` per query.

    Tiles of queries and vectors meet in a product of single precision. What the error of
    that product could still let into a query's best ``k`` is scored again in double, so
    results are those of double precision. Memory stays at the queries and a slice of
    vectors, whatever the number of vectors or of ties. ``asked`` names the queries that
    look at some vectors; all do without it.
    """
    digits, tile_queries, tile_vectors, slice_vectors = DIGITS, 512, 1024, 1 << 14

    def unit(embeddings, count, width):
        import numpy as np
        rows = np.asarray(embeddings.flatten(), dtype=np.float64)
        if len(rows) != count * width:
            raise ValueError(f"vectors are not all {width} wide")
        rows = rows.reshape(count, width)
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
        return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)

    def copies(rows):
        """A number for each row, the same for equal rows."""
        import numpy as np
        return np.unique(np.ascontiguousarray(rows).view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)[1].ravel()

    def true_places(mask):
        """The places of the few true values, looked for eight at once."""
        import numpy as np
        if len(mask) % 8:
            return np.flatnonzero(mask)
        some = (np.flatnonzero(mask.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
        return some[mask[some]]

    def start(queries, distinct=False):
        """``distinct``: equal queries are one, as they may be if all meet the same vectors."""
        import numpy as np
        embeddings = queries["embedding"].combine_chunks()
        width = max(1, len(embeddings.flatten()) // max(1, len(queries)))
        rows, member = unit(embeddings, len(queries), width), np.arange(len(queries))
        if distinct:
            member = copies(rows)
            held = np.empty(member.max() + 1, np.int64)
            held[member] = np.arange(len(member))
            rows = rows[held]
        return {"matrix": rows, "single": rows.astype(np.float32), "member": member, "pending": [], "count": 0,
                "s": np.full((len(rows), k), -np.inf), "i": None,
                # The error of sums of ``width`` products of unit vectors, and what rounding may add to a score.
                "slack": np.float32((width + 8) * 2.0**-23 + 2 * 10.0**-digits)}

    def merge(best):
        import numpy as np
        if not best["pending"]:
            return
        q, s, i = (np.concatenate(c) for c in zip(*best["pending"]))
        best["pending"], best["count"] = [], 0
        if best["i"] is None:
            best["i"] = np.zeros(best["s"].shape, i.dtype)
        elif best["i"].dtype.itemsize < i.dtype.itemsize:
            best["i"] = best["i"].astype(i.dtype)
        touched = np.unique(q)
        old, nth = np.nonzero(best["s"][touched] > -np.inf)
        old = touched[old]
        q, s, i = np.concatenate([old, q]), np.concatenate([best["s"][old, nth], s]), np.concatenate([best["i"][old, nth], i])
        order = np.lexsort((-s, q))
        q, s = q[order], s[order]
        same = (q[1:] == q[:-1]) & (s[1:] == s[:-1])
        tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        order[tied] = order[tied][np.lexsort((i[order[tied]], -s[tied], q[tied]))]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        top = nth < k
        best["s"][q[top], nth[top]], best["i"][q[top], nth[top]] = s[top], i[order[top]]

    def add(best, ids, embeddings, asked=None):
        for at in range(0, len(ids), slice_vectors):
            add_slice(best, ids[at:at + slice_vectors], embeddings[at:at + slice_vectors], asked)

    def add_slice(best, ids, embeddings, asked):
        import numpy as np
        matrix, single = best["matrix"], best["single"]
        if k < 1 or not len(matrix) or asked is not None and not len(asked):
            return
        rows = unit(embeddings, len(ids), matrix.shape[1])
        names = ids.to_numpy(zero_copy_only=False)
        names = names.astype("U") if names.dtype == object else names
        if len(rows) > k:
            # Of equal vectors only the k with the least ids can be among the best.
            order = np.argsort(names, kind="stable")
            same = copies(rows[order])
            by = np.argsort(same, kind="stable")
            nth = np.arange(len(by)) - np.searchsorted(same[by], same[by])
            keep = np.sort(order[by[nth < k]])
            rows, names = rows[keep], names[keep]
        if asked is not None and len(asked) < len(matrix):
            single = single[asked]
        else:
            asked = np.arange(len(matrix))
        most = max(1 << 18, len(asked) * k // 2)
        small = rows.astype(np.float32)
        for v in range(0, len(rows), tile_vectors):
            part = small[v:v + tile_vectors].T
            for q in range(0, len(single), tile_queries):
                own = asked[q:q + tile_queries]
                scores = single[q:q + tile_queries] @ part
                floor = best["s"][own, k - 1]
                bar = floor.astype(np.float32) - best["slack"]
                if scores.shape[1] > k and (open_ := np.flatnonzero(np.isneginf(floor))).size:
                    enough = np.partition(scores[open_], -k, axis=1)[:, -k]
                    bar[open_] = np.where(np.isnan(enough), -np.inf, enough - 2 * best["slack"])
                hit = true_places((scores >= bar[:, None]).ravel())
                if not len(hit):
                    continue
                hq, hr = np.divmod(hit, scores.shape[1])
                hq, hr = own[hq], hr + v
                exact = np.round(np.einsum("ij,ij->i", matrix[hq], rows[hr]), digits)
                on = exact >= best["s"][hq, k - 1]
                best["pending"].append((hq[on], exact[on], names[hr[on]]))
                best["count"] += int(on.sum())
                if best["count"] >= most:
                    merge(best)
            if best["count"] and np.isneginf(best["s"][asked, k - 1]).any():
                merge(best)

    def result(queries, best):
        import numpy as np
        import pyarrow as pa
        merge(best)
        own = best["s"][best["member"]] > -np.inf
        q, nth = np.nonzero(own)
        at = best["member"][q]
        found = [] if best["i"] is None else best["i"][at, nth].tolist()
        return pa.table({"query_id": queries["query_id"].combine_chunks().take(pa.array(q)),
                         "vector_id": pa.array(found, id_type), "score": pa.array(best["s"][at, nth])})

    return start, add, result


def _block_counts(queries: int, vectors: int, width: int, shared_numbers: int, block_vectors: int, cores: int) -> tuple[int, int]:
    """Into how many blocks queries and vectors are split.

    Every query is copied to all blocks of vectors and every vector to all blocks of
    queries, so there are few: enough to keep the cores busy, and as many as a block's
    bound asks for. The smallest blocks worth a group are the parameters of the search.
    """
    most = max(1, HELD_NUMBERS // width)
    busy = GROUPS_PER_CORE * cores
    q_blocks = min(-(-queries // max(1, shared_numbers // width)), math.ceil(math.sqrt(busy * queries / max(1, vectors))))
    q_blocks = max(1, q_blocks, -(-queries // most))
    v_blocks = max(1, min(-(-vectors // block_vectors), -(-busy // q_blocks)), -(-vectors // most))
    return q_blocks, v_blocks


def _arrow_type(kind: T.DataType):
    import pyarrow as pa
    if isinstance(kind, T.StringType):
        return pa.string()
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return pa.int64() if isinstance(kind, T.LongType) else pa.int32()
    raise ValueError(f"ids must be texts or whole numbers, not {kind.simpleString()}")


def search_batch(vectors: DataFrame, queries: DataFrame, n_results: int = 10,
                 where: Column | Mapping[str, str] | None = None, *,
                 shared_numbers: int = SHARED_NUMBERS,
                 block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """The nearest vectors of every query ``(query_id, embedding)``, ids unique.

    Gives ``query_id, vector_id, score, rank``. No pairs are emitted: each task
    keeps the best ``n_results`` per query and only those are shuffled to be
    ranked. Query tables too large to share are split into blocks, and so are the
    vectors; a pair of blocks is one group of a shuffle, of bounded size. Blocks are as
    large as ``HELD_NUMBERS`` allows, since every row is copied to all blocks of the other table.
    """
    found = searched(vectors, where).select("vector_id", "embedding").filter(
        F.col("embedding").isNotNull())
    queries = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    id_type = _arrow_type(found.schema["vector_id"].dataType)
    query_type = _arrow_type(queries.schema["query_id"].dataType)
    out = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                        T.StructField("vector_id", found.schema["vector_id"].dataType),
                        T.StructField("score", T.DoubleType())])
    size = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    n_queries, width = size[0], max(1, size[1] or 1)
    start, add, result = _scorer(n_results, id_type)

    if n_queries * width <= shared_numbers:
        shared = found.sparkSession.sparkContext.broadcast(queries.toArrow())

        def scan(batches):
            table = shared.value
            if not len(table):
                return
            best = start(table, distinct=True)
            for batch in batches:
                add(best, batch.column(0), batch.column(1))
            yield from result(table, best).to_batches()

        # Every task ends with its own best per query; the rank below keeps the best in each task again.
        partial = found.mapInArrow(scan, out)
    else:
        q_blocks, v_blocks = _block_counts(n_queries, found.count(), width, shared_numbers, block_vectors,
                                           found.sparkSession.sparkContext.defaultParallelism)

        def placed(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int):
            return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own))).withColumn(
                other, F.explode(F.sequence(F.lit(0).cast("bigint"),
                                            F.lit(n_other - 1).cast("bigint"))))

        def pair(of_vectors, of_queries):
            if not len(of_queries) or not len(of_vectors):
                return none()
            best = start(of_queries, distinct=True)
            for batch in of_vectors.to_batches():
                add(best, batch.column("vector_id"), batch.column("embedding"))
            return result(of_queries, best)

        def none():
            import pyarrow as pa
            return pa.table({"query_id": pa.array([], query_type),
                             "vector_id": pa.array([], id_type),
                             "score": pa.array([], pa.float64())})

        partial = (placed(found, "vector_id", "_v", v_blocks, "_q", q_blocks)
                   .groupBy("_v", "_q")
                   .cogroup(placed(queries, "query_id", "_q", q_blocks, "_v", v_blocks)
                            .groupBy("_v", "_q"))
                   .applyInArrow(pair, out))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vector_id"))
    return partial.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= n_results)


def _bundles(sizes: dict[int, int], n_bundles: int) -> dict[str, list[int]]:
    """Groups of vectors put together until they are a block's size; a larger group is dealt out to blocks of its own.

    ``group`` ascending, with its ``first`` block and into how many ``parts`` it goes.
    """
    target = max(1, -(-sum(sizes.values()) // n_bundles))
    out: dict[str, list[int]] = {"group": [], "first": [], "parts": []}
    at, room = -1, 0
    for group, n in sorted(sizes.items()):
        parts = -(-n // target)
        if parts > 1 or n > room:
            at, room = at + 1, 0 if parts > 1 else target
        for name, value in (("group", group), ("first", at), ("parts", parts)):
            out[name].append(value)
        at, room = at + parts - 1, max(0, room - n)
    return out


def _by_group(groups):
    """A function that gives, of a list of group numbers for each query, the queries of a group."""
    import numpy as np
    named = groups.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(groups)), groups.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    order = np.argsort(named, kind="stable")
    named, owner = named[order], owner[order]
    return lambda g: owner[np.searchsorted(named, g):np.searchsorted(named, g, side="right")]


def search_grouped(vectors: DataFrame, queries: DataFrame, n_results: int = 10, *, shared_numbers: int = SHARED_NUMBERS,
                   block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """Like :func:`search_batch`, but a query meets only vectors of its groups.

    ``vectors`` ``(vector_id, embedding, group)``, ``queries`` ``(query_id, embedding, groups)``:
    ``groups`` lists different numbers. Groups that no query names are not read. A query
    table that can be shared is, and the vectors are not shuffled. Otherwise vectors are
    put into blocks, several small groups to a block and a large group into several, and a
    query goes once to each block that holds one of its groups. The driver sees a count
    for each group.
    """
    queries = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding", "groups")
    each = queries.select(F.explode("groups").alias("group"))
    asking = {r["group"]: r["n"] for r in each.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = vectors.select("vector_id", "embedding", "group").filter(
        F.col("embedding").isNotNull() & F.col("group").isin(list(asking)))
    id_type = _arrow_type(found.schema["vector_id"].dataType)
    query_type = _arrow_type(queries.schema["query_id"].dataType)
    out = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                        T.StructField("vector_id", found.schema["vector_id"].dataType),
                        T.StructField("score", T.DoubleType())])
    size = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    n_queries, width = size[0], max(1, size[1] or 1)
    start, add, result = _scorer(n_results, id_type)

    def add_groups(best, asked_by, batch):
        import numpy as np
        import pyarrow as pa
        group = batch.column("group").to_numpy(zero_copy_only=False)
        order = np.argsort(group, kind="stable")
        ends = np.flatnonzero(np.diff(group[order])) + 1
        for some in np.split(order, ends) if len(order) else ():
            part = batch.take(pa.array(some))
            add(best, part.column("vector_id"), part.column("embedding"), asked_by(group[some[0]]))

    if (n_queries * width) + sum(asking.values()) <= shared_numbers:
        shared = found.sparkSession.sparkContext.broadcast(queries.toArrow())

        def scan(batches):
            table = shared.value
            if not len(table):
                return
            best, asked_by = start(table), _by_group(table["groups"].combine_chunks())
            for batch in batches:
                add_groups(best, asked_by, batch)
            yield from result(table, best).to_batches()

        partial = found.mapInArrow(scan, out)
    else:
        sizes = {r["group"]: r["n"] for r in found.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
        q_blocks, v_blocks = _block_counts(n_queries, sum(sizes.values()), width, shared_numbers, block_vectors,
                                           found.sparkSession.sparkContext.defaultParallelism)
        bundles = _bundles(sizes, v_blocks)

        def block(groups, hashes):
            import numpy as np
            import pyarrow as pa
            group, first, parts = (np.asarray(bundles[c], np.int64) for c in ("group", "first", "parts"))
            at = np.searchsorted(group, groups.to_numpy(zero_copy_only=False))
            return pa.array((first[at] + hashes.to_numpy(zero_copy_only=False) % parts[at]).astype(np.int32))

        def blocks(lists):
            """Of each query's groups: the block and those of its groups that the block holds, a list for each block."""
            import numpy as np
            import pyarrow as pa
            group, first, parts = (np.asarray(bundles[c], np.int64) for c in ("group", "first", "parts"))
            named = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = np.searchsorted(group, named)
            known = np.flatnonzero(group[np.minimum(at, len(group) - 1)] == named) if len(group) else np.empty(0, np.int64)
            named, row, at = named[known], row[known], at[known]
            times = parts[at]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            held = np.repeat(first[at], times) + nth
            named, row = np.repeat(named, times), np.repeat(row, times)
            order = np.lexsort((held, row))
            named, row, held = named[order], row[order], held[order]
            new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(held) != 0))) if len(row) else np.empty(0, np.int64)
            inner = np.append(new, len(row))
            values = np.insert(named, new, held[new]).astype(np.int32)  # the block's number stands first
            several = pa.ListArray.from_arrays(pa.array((inner + np.arange(len(inner))).astype(np.int32)), pa.array(values))
            ends = np.append(0, np.cumsum(np.bincount(row[new], minlength=len(lists)))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), several)

        def pair(of_vectors, of_queries):
            import pyarrow as pa
            if not len(of_queries) or not len(of_vectors):
                return pa.table({"query_id": pa.array([], query_type), "vector_id": pa.array([], id_type),
                                 "score": pa.array([], pa.float64())})
            best, asked_by = start(of_queries), _by_group(of_queries["_own"].combine_chunks())
            add_groups(best, asked_by, of_vectors.combine_chunks().to_batches()[0])
            return result(of_queries, best)

        placed = found.withColumn("_v", F.arrow_udf(block, "int")(
            F.col("group"), F.xxhash64("vector_id").bitwiseAND((1 << 62) - 1))).withColumn(
            "_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))))
        asked = queries.select("query_id", "embedding", F.explode(F.arrow_udf(blocks, "array<array<int>>")("groups")).alias("_all")).select(
            "query_id", "embedding", F.expr("slice(_all, 2, size(_all) - 1)").alias("_own"), F.get("_all", F.lit(0)).alias("_v"),
            F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("_q"))
        partial = placed.groupBy("_v", "_q").cogroup(asked.groupBy("_v", "_q")).applyInArrow(pair, out)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vector_id"))
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_results)
