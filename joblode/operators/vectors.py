"""Building the vector rows of postings, and finding postings without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions.jobtext import field_text, full_text, metadata, vector_id
from joblode.operators.ann import Planes, near_cells
from joblode.operators.embed import DEFAULT_WIDTH, Embedder, hashing_embedder
from joblode.operators.keys import fits_broadcast, rows_with_ids, unknown_rows
from joblode.operators.knn import query_vector, scored, search
from joblode.schemas import VECTOR_SCHEMA
from joblode.session import staged

# A top-n up to this many rows is broadcast to the postings.
BROADCAST_HITS = 10_000


def vector_texts(jobs: DataFrame) -> DataFrame:
    """One row per text to embed: the whole posting and each field that says something.

    ``vector_id, job_id, type, field, document, metadata``; a narrow plan.
    """
    def part(kind: str, name: str | None, text):
        return F.struct(F.lit(kind).alias("type"), F.lit(name).cast("string").alias("field"),
                        text.alias("document"))

    parts = F.array(part("full", None, full_text()),
                    *[part("field", f, field_text(f)) for f in K.FIELD_VECTORS])
    said = F.filter(parts, lambda p: (p["type"] == "full") | (p["document"] != ""))
    rows = jobs.select(F.col("id").alias("job_id"), metadata().alias("_meta"), F.inline(said))
    own = F.when(F.col("type") == "full",
                 F.create_map(F.lit("job_id"), F.col("job_id"), F.lit("type"), F.col("type"))
                 ).otherwise(F.create_map(
                     F.lit("job_id"), F.col("job_id"), F.lit("type"), F.col("type"),
                     F.lit("field"), F.col("field")))
    return rows.select(vector_id(F.col("job_id"), F.coalesce("field", "type")).alias("vector_id"),
                       "job_id", "type", "field", "document",
                       F.map_concat(own, F.col("_meta")).alias("metadata"))


def build_vectors(jobs: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Vector rows of postings."""
    embed = embedder or hashing_embedder()
    return embed(vector_texts(jobs)).select(*VECTOR_SCHEMA.names)


def missing_vectors(jobs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Postings whose full-text vector is not in the vector table.

    Ids alone are compared; the postings themselves meet only the ids that are missing.
    """
    have = vectors.filter(F.col("type") == "full").select(F.col("job_id").alias("id"))
    ids = staged(unknown_rows(jobs.select("id"), have), "missing-ids")
    return rows_with_ids(jobs, F.broadcast(ids) if fits_broadcast(ids) else ids)


def hits_to_jobs(hits: DataFrame, jobs: DataFrame, columns: tuple[str, ...],
                 n_hits: int | None = None) -> DataFrame:
    """Postings of ranked hits, in rank order; hits without a posting are dropped."""
    ranked = hits.select("job_id", "rank", "score")
    if n_hits is not None and n_hits <= BROADCAST_HITS:
        ranked = F.broadcast(ranked)
    rows = jobs.select(*columns).join(ranked, jobs["id"] == ranked["job_id"])
    return rows.drop("job_id").orderBy("rank")


def semantic_search_jobs(jobs: DataFrame, vectors: DataFrame, query: str, n_results: int = 5,
                         embedder: Embedder | None = None, where=None,
                         distinct_jobs: bool = False, planes: Planes | None = None,
                         flips: int | None = None) -> DataFrame:
    """Postings nearest to a text.

    With ``planes``, those of the vector table, only cells near the text's are read.

    A posting with several near vectors is listed once for each of them, unless
    ``distinct_jobs`` keeps the best vector of every posting only.
    """
    embed = embedder or hashing_embedder(_width(vectors))
    asked = embed(vectors.sparkSession.createDataFrame([(query.strip() or " ",)],
                                                       "document string"))
    asked = query_vector(asked)
    if planes is not None:
        vectors = near_cells(vectors, planes, asked, flips)
    if distinct_jobs:
        best = (scored(vectors, asked, where).groupBy("job_id")
                .agg(F.max("score").alias("score"))
                .orderBy(F.desc("score"), "job_id").limit(n_results)
                .filter(F.col("score").isNotNull()))
        hits = best.withColumn("rank", F.row_number().over(
            Window.orderBy(F.desc("score"), F.col("job_id"))))
    else:
        hits = search(vectors, asked, n_results, where)
    return hits_to_jobs(hits, jobs, ("id", "title", "company", "role", "location", "url",
                                     "description"), n_results)


def _width(vectors: DataFrame) -> int:
    row = vectors.select(F.size("embedding")).filter("embedding is not null").limit(1).first()
    return row[0] if row else DEFAULT_WIDTH
