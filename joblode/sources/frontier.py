"""Addresses to crawl, and what is known of stored pages by their address."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions.text import nonempty
from joblode.operators.keys import BROADCAST_ROWS, fits_broadcast


def keyword_seeds(spark: SparkSession, keywords: Sequence[str] = K.KEYWORDS) -> DataFrame:
    """``keyword_ord, keyword`` in order of priority."""
    return spark.createDataFrame(list(enumerate(keywords)), "keyword_ord int, keyword string")


def search_url(keyword: Column, offset: Column, recency: str | None = K.SEARCH_RECENCY,
               base: str = K.SEARCH_BASE, place: str = K.SEARCH_PLACE) -> Column:
    """Address of a results page; blanks alone are escaped."""
    url = F.concat(F.lit(f"{base}?keywords="), F.replace(keyword, F.lit(" "), F.lit("%20")),
                   F.lit(f"&location={place}&sortBy=DD&start="), offset.cast("string"))
    return F.concat(url, F.lit(f"&f_TPR={recency}")) if recency else url


def detail_url(job_id: Column, base: str = K.DETAIL_BASE) -> Column:
    return F.concat(F.lit(base), job_id)


def search_frontier(keywords: DataFrame, offsets: Sequence[int] = (0,),
                    recency: str | None = K.SEARCH_RECENCY) -> DataFrame:
    """Every keyword with every offset, by exploding the offsets in place."""
    paged = keywords.select("*", F.explode(F.array(*map(F.lit, offsets))).alias("offset"))
    return paged.withColumn("url", search_url(F.col("keyword"), F.col("offset"), recency))


def result_pages(pages: DataFrame, keywords: DataFrame, n_keywords: int | None = None) -> DataFrame:
    """Stored result pages ``(url, html)`` with ``keyword, keyword_ord, page`` of their address.

    A keyword may hold ``&``: it ends where the next parameter begins. Pages of a
    keyword are numbered by their offsets, of which 0 is page 0 whether stored or not.
    The seed list is joined on the keyword; it is broadcast if its size is known
    to be small. Only (keyword, offset) pairs are grouped, never pages.
    """
    keyword = nonempty(F.regexp_extract("url", r"[?&]keywords=(.*?)(?:&\w+=|#|$)", 1))
    start = F.regexp_extract("url", r"[?&]start=(\d+)", 1).try_cast("int")
    if n_keywords is not None and n_keywords <= BROADCAST_ROWS:
        keywords = F.broadcast(keywords)
    found = pages.withColumns({
        "keyword": F.replace(keyword, F.lit("%20"), F.lit(" ")),
        "_start": F.coalesce(start, F.lit(0))})
    found = found.join(keywords, "keyword")
    offsets = found.select("keyword_ord", "_start").distinct()
    own = Window.partitionBy("keyword_ord")
    pages_of = offsets.withColumn("page", F.row_number().over(own.orderBy("_start")) - F.when(
        F.min("_start").over(own) == 0, 1).otherwise(0))
    if n_keywords is not None and fits_broadcast(offsets, "keyword_ord"):
        pages_of = F.broadcast(pages_of)
    return found.join(pages_of, ["keyword_ord", "_start"]).select("keyword", "keyword_ord", "page", "html")


def detail_pages(pages: DataFrame, base: str = K.DETAIL_BASE) -> DataFrame:
    """Stored posting pages ``(url, html)`` as ``id, html``."""
    return pages.filter(F.col("url").startswith(base)).select(
        F.substring("url", len(base) + 1, 1 << 30).alias("id"), "html")
