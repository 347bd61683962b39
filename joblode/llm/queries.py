"""Registers the queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from joblode.llm import (audit, bases, curve, dualtree, exact, idfiles, licenses, metric, neardup, packing, pii,  # noqa: F401
                         quality, ratio, tokens)
from joblode.llm.registry import ORACLE, QUERIES  # noqa: F401

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
