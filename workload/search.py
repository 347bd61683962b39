"""Embeddings, exact and approximate search, and the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblode.operators import ann, knn
from joblode.operators import vectors as V
from joblode.operators.aggregates import count_rows
from joblode.operators.embed import embedding_width, hashing_embedder
from joblode.operators.trained import train_cells
from joblode.plans.ingest import load_vectors
from joblode.session import scratch, staged
from joblode.sources import tables as B
from workload.registry import case
from workload.texts import VECTOR_TEXTS
from workload.views import JOBS, VECTORS, jobs, table, vectors

WIDTH = 384

# Hash of words in SQL: the 32-bit MurmurHash3 of the UTF-8 bytes, seed 42.
_M = "4294967295"


def _rot(x: str, n: int) -> str:
    return f"((({x} << {n}) | ({x} >> {32 - n})) & {_M})"


def _byte(at: str) -> str:
    return f"CAST('0x' || substr(h, 2 * ({at}) + 1, 2) AS UBIGINT)"


def sql_hashed(texts: str, key: str) -> str:
    """Tables ``counts(key, dim, n)`` and ``unit(key, dim, w)`` of a table of texts."""
    mix1 = f"(({{k}} * 3432918353) & {_M})"
    return f"""words AS (SELECT {key}, unnest(string_split_regex(lower(coalesce(nullif(
      trim(document), ''), ' ')), '[^\\p{{L}}\\p{{N}}+#]+')) AS word FROM {texts}),
  vocabulary AS (SELECT word, h, len(h) // 2 AS size FROM (
    SELECT word, lower(hex(encode(word))) AS h FROM (SELECT DISTINCT word FROM words WHERE word <> ''))),
  blocks AS (SELECT word, h, size, list_transform(range(0, size // 4), lambda i:
    {_byte('4 * i')} | ({_byte('4 * i + 1')} << 8) | ({_byte('4 * i + 2')} << 16)
    | ({_byte('4 * i + 3')} << 24)) AS ks,
    CASE WHEN size % 4 >= 1 THEN {_byte('size - size % 4')} ELSE 0::UBIGINT END
    | CASE WHEN size % 4 >= 2 THEN {_byte('size - size % 4 + 1')} << 8 ELSE 0::UBIGINT END
    | CASE WHEN size % 4 >= 3 THEN {_byte('size - size % 4 + 2')} << 16 ELSE 0::UBIGINT END AS tail
    FROM vocabulary),
  body AS (SELECT word, size, tail, list_reduce(list_transform(ks, lambda k:
    (({_rot(mix1.format(k='k'), 15)}) * 461845907) & {_M}), lambda a, k:
    ({_rot('xor(a, k)', 13)} * 5 + 3864292196) & {_M}, 42::UBIGINT) AS b FROM blocks),
  ended AS (SELECT word, xor(xor(b, CASE WHEN size % 4 > 0 THEN
    ({_rot(mix1.format(k='tail'), 15)} * 461845907) & {_M} ELSE 0::UBIGINT END), size::UBIGINT) AS a FROM body),
  f1 AS (SELECT word, (xor(a, a >> 16) * 2246822507) & {_M} AS a FROM ended),
  f2 AS (SELECT word, (xor(a, a >> 13) * 3266489909) & {_M} AS a FROM f1),
  hashed AS (SELECT word, CAST(xor(a, a >> 16) AS BIGINT) AS a FROM f2),
  placed AS (SELECT word, ((CASE WHEN a >= 2147483648 THEN a - 4294967296 ELSE a END) % {WIDTH} + {WIDTH})
    % {WIDTH} AS dim FROM hashed),
  counts AS (SELECT {key}, dim, count(*) AS n FROM words JOIN placed USING (word) GROUP BY {key}, dim),
  unit AS (SELECT {key}, dim, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS w
    FROM counts)"""


@case("hash_embed", f"""WITH texts AS (SELECT doc_id, text AS document FROM documents),
  {sql_hashed('texts', 'doc_id')} SELECT doc_id, CAST(dim AS INTEGER) AS dim,
    round(CAST(w AS DOUBLE), 6) AS weight FROM unit""")
def _(spark, sf):
    made = hashing_embedder(WIDTH)(table(spark, sf, "documents", heavy=True).select(
        "doc_id", F.col("text").alias("document")))
    return made.select("doc_id", F.posexplode_outer("embedding").alias("dim", "w")).filter(
        "w <> 0").select("doc_id", "dim", F.round(F.col("w").cast("double"), 6).alias("weight"))


@case("embedding_width", """SELECT CAST(min(len(embedding)) AS INTEGER) AS min_width,
  CAST(max(len(embedding)) AS INTEGER) AS max_width FROM embeddings""")
def _(spark, sf):
    return embedding_width(vectors(spark, sf))


@case("vector_count", f"WITH {VECTORS} SELECT count(*) AS n FROM vectors")
def _(spark, sf):
    return count_rows(vectors(spark, sf))


def _asked(spark, sf):
    """The newest vector of the table, as a query."""
    e = table(spark, sf, "embeddings")
    return e.orderBy(F.desc("vec_id")).limit(1)


_ASKED = """asked AS (SELECT CAST(embedding AS DOUBLE[]) AS query FROM embeddings
  ORDER BY vec_id DESC LIMIT 1)"""
_RANK = "CAST(row_number() OVER (ORDER BY score DESC, vector_id) AS INTEGER) AS rank"


def _one(where: str, n: int) -> str:
    return f"""WITH {VECTORS}, {_ASKED}, scored AS (SELECT vector_id, job_id, document,
    round(list_cosine_similarity(wide, query), 6) AS score FROM vectors, asked {where})
  SELECT vector_id, job_id, document, score, {_RANK} FROM scored
  ORDER BY score DESC, vector_id LIMIT {n}"""


@case("knn_one", _one("", 10))
def _(spark, sf):
    return knn.search(vectors(spark, sf), _asked(spark, sf)).select(
        "vector_id", "job_id", "document", "score", "rank")


@case("knn_filtered", _one("WHERE label = '3'", 7))
def _(spark, sf):
    return knn.search(vectors(spark, sf), _asked(spark, sf), 7, where={"label": "3"}).select(
        "vector_id", "job_id", "document", "score", "rank")


@case("knn_predicate", _one("WHERE field IN ('title', 'role')", 5))
def _(spark, sf):
    return knn.search(vectors(spark, sf), _asked(spark, sf), 5,
                      where=F.col("field").isin("title", "role")).select(
        "vector_id", "job_id", "document", "score", "rank")


_BATCH = f"""WITH {VECTORS}, pairs AS (SELECT e.vec_id AS query_id, v.vector_id,
    round(list_cosine_similarity(v.wide, CAST(e.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings e, vectors v), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, vector_id) AS rank FROM pairs)
  SELECT query_id, vector_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5"""


def _queries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


@case("knn_batch", _BATCH)
def _(spark, sf):
    return knn.search_batch(vectors(spark, sf), _queries(spark, sf), 5)


@case("knn_batch_blocks", _BATCH)
def _(spark, sf):
    """The same by shuffled blocks, as for query tables too large to share."""
    return knn.search_batch(vectors(spark, sf), _queries(spark, sf), 5, shared_numbers=1 << 13,
                            block_vectors=1 << 11)


# Hyperplanes of the given vectors, which are 64 wide.
PLANES = ann.hyperplanes(64)


def _cells(spark, sf):
    """The vectors laid out by cell, written in two loads."""
    path, rows = scratch(spark, "cells"), vectors(spark, sf)
    B.upsert_vectors(spark, path, rows, unique=True, planes=PLANES)
    B.upsert_vectors(spark, path, rows.filter("type = 'full'"), unique=True, planes=PLANES)
    return B.read_vectors(spark, path)


def _sql_cell(vector: str) -> str:
    return "(" + " + ".join(f"CASE WHEN list_dot_product({vector}, {list(p)}::DOUBLE[]) >= 0 THEN {1 << n} ELSE 0 END"
                            for n, p in enumerate(PLANES)) + ")"


@case("ann_recall", f"""WITH {VECTORS}, v AS (SELECT vector_id, wide, {_sql_cell('wide')} AS cell FROM vectors),
  asked AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM embeddings WHERE vec_id % 50 = 0),
  a AS (SELECT *, {_sql_cell('query')} AS home FROM asked),
  pairs AS (SELECT query_id, vector_id, round(list_cosine_similarity(wide, query), 6) AS score,
    bit_count(xor(cell, home)) <= 4 AS near FROM a, v),
  exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM pairs),
  approx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank
    FROM pairs WHERE near)
  SELECT e.query_id, count(*) AS exact, count(x.vector_id) AS found FROM exact e LEFT JOIN approx x
    ON x.query_id = e.query_id AND x.vector_id = e.vector_id AND x.rank <= 10 WHERE e.rank <= 10 GROUP BY e.query_id""")
def _(spark, sf):
    """How many of the exact ten nearest the pruned search finds, for every fiftieth vector."""
    cells, asked = _cells(spark, sf), _queries(spark, sf).filter("query_id % 50 = 0")
    exact = staged(knn.search_batch(cells, asked, 10).select("query_id", "vector_id"), "exact")
    near = staged(ann.search_cells_batch(cells, PLANES, asked, 10, flips=4).select("query_id", "vector_id"), "near")
    return exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "vector_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"))


@case("ann_all_cells", _one("", 10))
def _(spark, sf):
    """With every cell in reach the pruned search is exact."""
    return ann.search_cells(_cells(spark, sf), PLANES, _asked(spark, sf), 10, flips=6).select(
        "vector_id", "job_id", "document", "score", "rank")


def _trained(spark, rows):
    """The vectors laid out by cells trained from them, with the cells."""
    path, rows = scratch(spark, "trained-cells"), staged(rows, "vectors")
    cells = train_cells(rows)
    B.upsert_vectors(spark, path, rows, unique=True, planes=cells)
    return B.read_vectors(spark, path), cells


def _recall(stored, cells, asked):
    """Of each query: the ten nearest, how many of them the search at its default finds, and the rows it reads."""
    # Searches end before what is joined to them begins: a broadcast that waits for one's tasks runs out of time.
    near = staged(ann.search_cells_batch(stored, cells, asked, 10).select("query_id", "vector_id"), "near")
    exact = staged(knn.search_batch(stored, asked, 10).select("query_id", "vector_id"), "exact")
    counted = exact.join(near.withColumn("hit", F.lit(1)), ["query_id", "vector_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"))
    # A row for each cell.
    sizes = staged(stored.groupBy(F.col("bucket").alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
    read = staged(asked.select("query_id", F.explode(cells.cells_near("embedding")).alias("cell")).join(
        F.broadcast(sizes), "cell").groupBy("query_id").agg(F.sum("n").alias("rows_read")), "rows-read")
    every = sizes.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"))
    return counted.join(read, "query_id").join(F.broadcast(every)).select("query_id", "exact", "found", "rows_read", "rows")


@case("trained_recall")
def _(spark, sf):
    """Over the given vectors, which are close to random: every fiftieth against all."""
    stored, cells = _trained(spark, vectors(spark, sf))
    return _recall(stored, cells, _queries(spark, sf).filter("query_id % 50 = 0"))


@case("trained_recall_text")
def _(spark, sf):
    """Over the hashed words of all documents: every fiftieth against all."""
    made = hashing_embedder(WIDTH)(table(spark, sf, "documents", heavy=True).select(
        F.col("doc_id").cast("string").alias("vector_id"), F.col("doc_id").cast("string").alias("job_id"),
        F.lit("full").alias("type"), F.lit(None).cast("string").alias("field"), F.col("text").alias("document"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata")))
    stored, cells = _trained(spark, made)
    asked = stored.withColumn("query_id", F.col("vector_id").cast("long")).filter("query_id % 50 = 0")
    return _recall(stored, cells, asked.select("query_id", "embedding"))


@case("trained_all_cells", _BATCH)
def _(spark, sf):
    """With every cell in reach the search by blocks of cells is exact."""
    stored, cells = _trained(spark, vectors(spark, sf))
    return ann.search_cells_batch(stored, cells, _queries(spark, sf), 5, flips=len(cells), shared_numbers=1 << 13,
                                  block_vectors=1 << 6)


_QUERY = "Senior python backend sql react developer, DevOps in en"
_SEMANTIC = f"""WITH {JOBS}, {VECTOR_TEXTS}, texts AS (SELECT vector_id, document FROM vector_texts
    UNION ALL SELECT '?', '{_QUERY}'), {sql_hashed('texts', 'vector_id')},
  dots AS (SELECT v.vector_id, sum(CAST(v.w AS DOUBLE) * q.w) AS dot FROM unit v JOIN unit q ON q.dim = v.dim
    WHERE q.vector_id = '?' AND v.vector_id <> '?' GROUP BY v.vector_id),
  norms AS (SELECT vector_id, sqrt(sum(CAST(w AS DOUBLE) * w)) AS norm FROM unit GROUP BY vector_id),
  scored AS (SELECT t.vector_id, t.job_id, round(coalesce(d.dot / (n.norm * qn.norm), 0), 6) AS score
    FROM vector_texts t LEFT JOIN dots d USING (vector_id) LEFT JOIN norms n USING (vector_id),
    (SELECT norm FROM norms WHERE vector_id = '?') qn)"""
_FOUND = "j.id, j.title, j.company, j.role, j.location, j.url, j.description, h.score, h.rank"


@case("semantic_search", f"""{_SEMANTIC}, hits AS (SELECT job_id, score,
    {_RANK} FROM scored ORDER BY score DESC, vector_id LIMIT 12)
  SELECT {_FOUND} FROM hits h JOIN jobs j ON j.id = h.job_id""")
def _(spark, sf):
    all_jobs = jobs(spark, sf, heavy=True)
    return V.semantic_search_jobs(all_jobs, V.build_vectors(all_jobs), _QUERY, 12,
                                  hashing_embedder(WIDTH))


@case("semantic_search_cells", f"""{_SEMANTIC}, hits AS (SELECT job_id, score,
    {_RANK} FROM scored ORDER BY score DESC, vector_id LIMIT 12)
  SELECT {_FOUND} FROM hits h JOIN jobs j ON j.id = h.job_id""")
def _(spark, sf):
    """Over a table laid out by cell, with all cells in reach."""
    path, all_jobs = scratch(spark, "vectors-table"), jobs(spark, sf, heavy=True)
    planes = ann.hyperplanes(WIDTH, bits=3)
    B.upsert_vectors(spark, path, V.build_vectors(all_jobs), unique=True, planes=planes)
    return V.semantic_search_jobs(all_jobs, B.read_vectors(spark, path), _QUERY, 12, hashing_embedder(WIDTH),
                                  planes=planes, flips=3)


@case("semantic_search_distinct", f"""{_SEMANTIC}, best AS (SELECT job_id, max(score) AS score
    FROM scored GROUP BY job_id), hits AS (SELECT *, CAST(row_number() OVER (
    ORDER BY score DESC, job_id) AS INTEGER) AS rank FROM best ORDER BY score DESC, job_id LIMIT 12)
  SELECT {_FOUND} FROM hits h JOIN jobs j ON j.id = h.job_id""")
def _(spark, sf):
    all_jobs = jobs(spark, sf, heavy=True)
    return V.semantic_search_jobs(all_jobs, V.build_vectors(all_jobs), _QUERY, 12,
                                  hashing_embedder(WIDTH), distinct_jobs=True)


def _marked(spark, sf):
    """Full vectors of the labelled documents of good quality."""
    good = table(spark, sf, "labels").filter("quality = 1")
    return good.select(F.col("doc_id").cast("string").alias("job_id"), F.lit("full").alias("type"))


@case("missing_vectors", f"""WITH {JOBS} SELECT id, title FROM jobs
  WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)""")
def _(spark, sf):
    return V.missing_vectors(jobs(spark, sf), _marked(spark, sf)).select("id", "title")


@case("backfill_vectors", f"""WITH {JOBS}, {VECTOR_TEXTS} SELECT vector_id, job_id, type, field, document
  FROM vector_texts""")
def _(spark, sf):
    """A table that holds the vectors of some postings, brought up to date."""
    path, jobs_path = scratch(spark, "vectors-table"), scratch(spark, "jobs-table")
    B.insert_jobs(spark, jobs_path, jobs(spark, sf, heavy=True), as_of="2024-03-10 02:00:00")
    some = _marked(spark, sf).select(F.col("job_id").alias("id"))
    load_vectors(spark, jobs_path, path, ids=some)
    load_vectors(spark, jobs_path, path)
    return B.read_vectors(spark, path).select("vector_id", "job_id", "type", "field", "document")


@case("upsert_last_wins", f"""WITH {VECTORS} SELECT vector_id, document || ' 2' AS document FROM vectors""")
def _(spark, sf):
    """Three rows of each id in one load over a stored one: the last to arrive stays."""
    path = scratch(spark, "vectors-table")
    rows = vectors(spark, sf)
    B.upsert_vectors(spark, path, rows, unique=True)
    thrice = rows.withColumn("seen", F.explode(F.array(F.lit(1), F.lit(2), F.lit(0)))).withColumn(
        "document", F.concat_ws(" ", "document", F.col("seen").cast("string")))
    B.upsert_vectors(spark, path, thrice, arrival=("seen",))
    return B.read_vectors(spark, path).select("vector_id", "document")


@case("upsert_vectors", f"""WITH {VECTORS}, new AS (SELECT vector_id, job_id, 'new ' || document AS document,
    embedding FROM vectors WHERE CAST(label AS INTEGER) >= 5), old AS (SELECT vector_id, job_id, document, embedding
    FROM vectors WHERE CAST(label AS INTEGER) < 8)
  SELECT vector_id, job_id, document, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM new UNION ALL
  SELECT vector_id, job_id, document, round(CAST(embedding[1] AS DOUBLE), 6) FROM old
  WHERE vector_id NOT IN (SELECT vector_id FROM new)""")
def _(spark, sf):
    """Labels below 8 stored, then labels from 5 on upserted over them with new texts."""
    path = scratch(spark, "vectors-table")
    rows = vectors(spark, sf)
    label = F.col("metadata")["label"].cast("int")
    B.upsert_vectors(spark, path, rows.filter(label < 8))
    B.upsert_vectors(spark, path, rows.filter(label >= 5).withColumn(
        "document", F.concat(F.lit("new "), "document")))
    return B.read_vectors(spark, path).select(
        "vector_id", "job_id", "document",
        F.round(F.get("embedding", 0).cast("double"), 6).alias("first"))
