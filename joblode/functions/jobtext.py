"""Texts and metadata that describe a posting to the vector table."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode import constants as K
from joblode.functions.text import strip, truthy_items

_LIST_COLUMNS = {"skills_must", "skills_nice", "past_experience"}


def _listed(name: str) -> Column:
    return F.coalesce(F.array_join(truthy_items(F.col(name)), ", "), F.lit(""))


def full_text() -> Column:
    """The whole posting by the fixed layout; an absent value prints as ``None``."""
    parts = []
    for piece in re.split(r"(\{\w+\*?\})", K.FULL_TEXT):
        slot = re.fullmatch(r"\{(\w+)(\*?)\}", piece)
        if not slot:
            parts.append(F.lit(piece))
        elif slot[2]:
            parts.append(_listed(slot[1]))
        else:
            parts.append(F.coalesce(F.col(slot[1]).cast("string"), F.lit("None")))
    return strip(F.concat(*parts))


def field_text(name: str) -> Column:
    """The text of one column; empty if there is nothing to say."""
    if name in _LIST_COLUMNS:
        return _listed(name)
    return F.coalesce(strip(F.col(name).cast("string")), F.lit(""))


def metadata() -> Column:
    """MAP of a posting's scalar values as text; lists are joined, absent values empty."""
    pairs: list[Column] = []
    for name in K.METADATA_SCALARS:
        pairs += [F.lit(name), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    for name in K.METADATA_LISTS:
        shown = F.transform(F.col(name), lambda x: F.coalesce(x, F.lit("None")))
        pairs += [F.lit(name), F.coalesce(F.array_join(shown, ", "), F.lit(""))]
    pairs += [F.lit("posted_at"), F.coalesce(F.col("posted_at").cast("string"), F.lit(""))]
    return F.create_map(*pairs)


def vector_id(job_id: Column, part: Column) -> Column:
    return F.concat_ws("_", job_id, part)


def job_of_vector(vector_id_: Column) -> Column:
    """The vector id without its last ``_`` part."""
    return F.regexp_replace(vector_id_, r"_[^_]*$", "")
