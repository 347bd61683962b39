"""Schemas of the tables that the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_LIST = T.ArrayType(_S)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STUB_SCHEMA = _struct(
    ("id", _S), ("title", _S), ("company", _S), ("location", _S), ("url", _S),
    ("raw_description", _S), ("posted_at", _S), ("keyword", _S),
    ("keyword_ord", T.IntegerType()), ("page", T.IntegerType()), ("position", T.IntegerType()),
)

EXTRACTION_SCHEMA = _struct(
    ("role", _S), ("seniority", _S), ("description", _S), ("yearsexperience", T.IntegerType()),
    ("skills_must", _LIST), ("skills_nice", _LIST), ("past_experience", _LIST),
)

# ``scraped_at`` carries no zone, so results do not depend on the session's.
JOBS_SCHEMA = _struct(
    ("id", _S), ("title", _S), ("role", _S), ("seniority", _S), ("company", _S),
    ("location", _S), ("url", _S), ("description", _S), ("skills_must", _LIST),
    ("skills_nice", _LIST), ("yearsexperience", T.IntegerType()), ("past_experience", _LIST),
    ("keyword", _S), ("source", _S), ("posted_at", T.DateType()),
    ("scraped_at", T.TimestampNTZType()),
)

VECTOR_SCHEMA = _struct(
    ("vector_id", _S), ("job_id", _S), ("type", _S), ("field", _S), ("document", _S),
    ("embedding", T.ArrayType(T.FloatType())), ("metadata", T.MapType(_S, _S)),
)

# A posting as the extraction stage hands it on: all but the load time.
STAGED_COLUMNS = tuple(n for n in JOBS_SCHEMA.names if n != "scraped_at")

# The same as a stage file, with the order in which cards were seen.
EXTRACTED_SCHEMA = T.StructType([*[JOBS_SCHEMA[n] for n in STAGED_COLUMNS], *STUB_SCHEMA.fields[-3:]])
