"""Embedders: functions that add an ``embedding ARRAY<FLOAT>`` for a text column."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.functions.text import nonempty, strip

Embedder = Callable[..., DataFrame]

DEFAULT_WIDTH = 384
# What separates the words that are hashed.
WORD_BREAK = r"[^\p{L}\p{N}+#]+"


def _cleaned(text: str):
    return F.coalesce(nonempty(strip(F.col(text))), F.lit(" "))


def hashing_embedder(width: int = DEFAULT_WIDTH) -> Embedder:
    """Word counts hashed to ``width`` places, scaled to length 1, by MLlib.

    Repeatable, needs no model and stays in the JVM. A text without words gets
    the zero vector.
    """
    def embed(df: DataFrame, text: str = "document", out: str = "embedding") -> DataFrame:
        words = F.filter(F.split(F.lower(_cleaned(text)), WORD_BREAK), lambda w: w != "")
        counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=width).transform(
            df.withColumn("_words", words))
        unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counted)
        return unit.withColumn(out, vector_to_array("_unit", "float32")).drop(
            "_words", "_counts", "_unit")
    return embed


def model_embedder(load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]
                   ) -> Embedder:
    """An embedder around a user's model.

    ``load`` runs once per Python worker process and returns a function from a
    batch of texts to their vectors. Only the text column travels to Python.
    """
    key = uuid.uuid4().hex

    def embed(df: DataFrame, text: str = "document", out: str = "embedding") -> DataFrame:
        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held = sys.modules.setdefault("_joblode_models", types.ModuleType("_joblode_models"))
            if not hasattr(held, key):
                setattr(held, key, load())
            model = getattr(held, key)
            for texts in batches:
                yield pd.Series([list(map(float, v)) for v in model(list(texts))], dtype=object)
        return df.withColumn(out, vectors(_cleaned(text)))
    return embed


def embedding_width(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Least and greatest width; they differ if vectors of several models are mixed."""
    return vectors.agg(F.min(F.size(column)).alias("min_width"),
                       F.max(F.size(column)).alias("max_width"))
