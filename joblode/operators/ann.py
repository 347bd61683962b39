"""Approximate cosine search by partition pruning.

Vectors are laid out by cell: on which side of a few hyperplanes they lie. The
hyperplanes are drawn from a seed and are a parameter. A search reads only the
cells near the query's, so the scan is pruned to those folders, and the scores
inside are exact. More hyperplanes suit larger tables.

Cells may also be trained from the vectors (``trained.train_cells``); wherever
hyperplanes are given here, trained cells can be.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.functions.text import let
from joblode.operators.knn import query_vector, search, search_grouped
from joblode.operators.trained import TrainedCells

Planes = Sequence[Sequence[float]] | TrainedCells


def hyperplanes(width: int, bits: int = 6, seed: int = 7) -> list[list[float]]:
    """``bits`` random directions for vectors of this width."""
    draw = random.Random(seed)
    return [[draw.gauss(0, 1) for _ in range(width)] for _ in range(bits)]


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cell_of(vector: Column | str, planes: Planes) -> Column:
    """The cell of a vector: a bit for each hyperplane; NULL for NULL."""
    if isinstance(planes, TrainedCells):
        return planes.cell_of(vector)
    sides = [F.when(dot(vector, F.lit(np.array(p, "float64"))) >= 0, 1 << n).otherwise(0) for n, p in enumerate(planes)]
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.when(vector.isNotNull(), reduce(lambda a, b: a + b, sides)).cast("int")


def layout_of(planes: Planes) -> tuple[str, int]:
    """What a table calls these cells, and how many there are."""
    return (planes.name, len(planes)) if isinstance(planes, TrainedCells) else ("cell", 1 << len(planes))


def flip_masks(bits: int, flips: int) -> list[int]:
    """Differences of the cells that are up to ``flips`` sides away."""
    return [sum(1 << b for b in chosen) for n in range(flips + 1) for chosen in combinations(range(bits), n)]


def default_flips(bits: int) -> int:
    """Sides that a search may cross if it does not say: two thirds of them, rounded up.

    Vectors close to random, the hardest ones, need that many for 0.9 of the ten nearest.
    """
    return -(-2 * bits // 3)


def near_cells(vectors: DataFrame, planes: Planes, query: Sequence[float], flips: int | None = None,
               cell: str = "bucket") -> DataFrame:
    """The vectors in the query's cell and those up to ``flips`` sides away; see ``default_flips``.

    Of trained cells, the ``flips`` nearest ones; by default as many as were measured to be enough.
    """
    if isinstance(planes, TrainedCells):
        return vectors.filter(F.col(cell).isin(planes.order(query)[:planes.probes if flips is None else flips]))
    flips = default_flips(len(planes)) if flips is None else flips
    home = sum(1 << n for n, p in enumerate(planes) if sum(x * y for x, y in zip(p, query)) >= 0)
    return vectors.filter(F.col(cell).isin([home ^ m for m in flip_masks(len(planes), flips)]))


def search_cells(vectors: DataFrame, planes: Planes, query: Sequence[float] | DataFrame, n_results: int = 10,
                 where: Column | Mapping[str, str] | None = None, flips: int | None = None, cell: str = "bucket") -> DataFrame:
    """Nearest vectors within the near cells."""
    if isinstance(query, DataFrame):
        query = query_vector(query)
    return search(near_cells(vectors, planes, query, flips, cell), query, n_results, where)


def search_cells_batch(vectors: DataFrame, planes: Planes, queries: DataFrame, n_results: int = 10,
                       flips: int | None = None, cell: str = "bucket", **bounds: int) -> DataFrame:
    """``query_id, vector_id, score, rank``: the nearest vectors of every query within its near cells.

    Blocks of queries and of a cell's vectors meet in matrix products; no pairs become rows.
    ``bounds`` are those of ``knn.search_grouped``.
    """
    if isinstance(planes, TrainedCells):
        groups = planes.cells_near("embedding", flips)
    else:
        masks = F.array(*map(F.lit, flip_masks(len(planes), default_flips(len(planes)) if flips is None else flips)))
        groups = let(cell_of("embedding", planes), lambda home: F.transform(masks, lambda m: home.bitwiseXOR(m)))
    asked = queries.select("query_id", "embedding", groups.alias("groups"))
    return search_grouped(vectors.withColumn("group", F.col(cell)), asked, n_results, **bounds)
