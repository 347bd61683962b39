"""Cells trained from the vectors, for approximate cosine search.

The centroids come from k-means over a bounded sample; every vector lies in the cell
of the centroid nearest to it, and a search reads the cells whose centroids are
nearest to the query. How many is measured: so many that a sample of stored vectors
finds the asked share of its nearest neighbours.

Vectors without length lie in the first cell, NULL ones in none. Equal vectors share a
cell, so a cell may hold any share of the table; searches split it (``knn.search_grouped``).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode.operators.knn import search_batch
from joblode.session import staged

# A table has as many cells as the root of its rows says, within these bounds.
MIN_CELLS = 16
MAX_CELLS = 1 << 14
# Expected size of the training sample, for each cell, and of the sample of measured queries.
SAMPLE_PER_CELL = 64
MEASURED_QUERIES = 256
# Share of the nearest neighbours that the default number of cells is to find.
RECALL = 0.95


@dataclass(frozen=True, eq=False)
class TrainedCells:
    """Unit centroids, a row each, and how many cells a search reads if it does not say."""

    centroids: np.ndarray
    probes: int

    def __len__(self) -> int:
        return len(self.centroids)

    @property
    def name(self) -> str:
        """Tells these centroids from others in a table's layout."""
        return f"trained_{zlib.crc32(np.ascontiguousarray(self.centroids, '<f8').tobytes()):08x}"

    def order(self, query: Sequence[float]) -> list[int]:
        """All cells, the nearest to the query first."""
        return np.argsort(-(self.centroids @ np.asarray(query, "float64")), kind="stable").tolist()

    def cell_of(self, vector: Column | str) -> Column:
        """The cell of a vector; NULL for NULL."""
        return F.element_at(self.cells_near(vector, 1), 1)

    def cells_near(self, vector: Column | str, probes: int | None = None) -> Column:
        """The nearest cells of a vector, nearest first; NULL for NULL."""
        centroids = self.centroids.T
        n = min(len(self), self.probes if probes is None else probes)

        def near(arrays):
            import numpy as np
            import pyarrow as pa
            given = arrays.is_valid().to_numpy(zero_copy_only=False)
            width, n_cells = centroids.shape
            rows = np.asarray(arrays.drop_null().flatten(), dtype=np.float64)
            if len(rows) != given.sum() * width:
                raise ValueError(f"vectors are not all {width} wide")
            rows = rows.reshape(-1, width)
            found, step = np.empty((len(rows), n), np.int32), max(1, (1 << 21) // n_cells)
            for at in range(0, len(rows), step):
                away = -(rows[at:at + step] @ centroids)
                found[at:at + step] = away.argmin(axis=1)[:, None] if n == 1 else np.argsort(away, axis=1, kind="stable")[:, :n]
            ends = np.concatenate([[0], np.cumsum(given * n)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()), mask=pa.array(~given))

        return F.arrow_udf(near, "array<int>")(F.col(vector) if isinstance(vector, str) else vector)

    def save(self, spark: SparkSession, path: str) -> None:
        """Written beside the vectors, so that later loads and searches use the same cells."""
        rows = [(n, row, self.probes) for n, row in enumerate(self.centroids.tolist())]
        spark.createDataFrame(rows, "cell int, centroid array<double>, probes int").write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TrainedCells:
        rows = spark.read.parquet(path).orderBy("cell").collect()
        return cls(np.array([r["centroid"] for r in rows]), rows[0]["probes"])


def _hash_sample(vectors: DataFrame, expected: int, rows: int, salt: int) -> DataFrame:
    """About ``expected`` of the rows, by a hash of the id: the same ones at each try, sorted by no one."""
    share = min(1.0, expected / max(1, rows))
    return vectors.filter(F.pmod(F.xxhash64("vector_id", F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30)))


def train_cells(vectors: DataFrame, n_cells: int | None = None, *, recall: float = RECALL, n_results: int = 10,
                seed: int = 7, sample_per_cell: int = SAMPLE_PER_CELL, queries: int = MEASURED_QUERIES) -> TrainedCells:
    """Cells for a table of vectors ``(vector_id, embedding)``.

    ``n_cells`` is the most that are made: fewer different vectors give fewer. A table
    without vectors raises ``ValueError``.
    """
    given = vectors.filter(F.col("embedding").isNotNull()).select("vector_id", "embedding")
    rows = given.count()
    n_cells = max(2, n_cells or min(MAX_CELLS, max(MIN_CELLS, math.isqrt(rows))))
    sample = _hash_sample(given, sample_per_cell * n_cells, rows, 1).select(array_to_vector("embedding").alias("_given"))
    unit = Normalizer(inputCol="_given", outputCol="_unit", p=2.0).transform(sample)
    # Copies count once: a hot vector is one point, and points are far enough apart to begin from.
    points = staged(unit.select(F.transform(vector_to_array("_unit"), lambda x: F.round(x, 6)).alias("point")).distinct(),
                    "cell-points")
    few = points.limit(n_cells + 1).count()
    if not few:
        raise ValueError("there are no vectors to train cells from")
    if few <= n_cells:
        centres = np.array(sorted(r["point"] for r in points.collect()))
    else:
        model = KMeans(k=n_cells, seed=seed, featuresCol="unit").fit(points.select(array_to_vector("point").alias("unit")))
        centres = np.array(model.clusterCenters(), "float64")
    norms = np.linalg.norm(centres, axis=1, keepdims=True)
    cells = TrainedCells(np.divide(centres, norms, out=np.zeros_like(centres), where=norms > 0), len(centres))
    asked = staged(_hash_sample(given, queries, rows, 2).withColumnRenamed("vector_id", "query_id"), "cell-queries")
    return TrainedCells(cells.centroids, measured_probes(given, cells, asked, recall, n_results))


def measured_probes(vectors: DataFrame, cells: TrainedCells, queries: DataFrame, recall: float = RECALL,
                    n_results: int = 10) -> int:
    """The fewest cells that hold ``recall`` of the exact nearest neighbours of some stored vectors.

    ``queries`` ``(query_id, embedding)`` are rows of the table; a query is no neighbour of
    itself. One scan finds the neighbours, one their cells; the driver sees their cells
    and the queries. Without queries all cells are read.
    """
    near = search_batch(vectors, queries, n_results + 1).filter("query_id <> vector_id and rank <= {n}".format(
        n=n_results + 1)).select("query_id", "vector_id")
    near = staged(near, "cell-neighbours")
    found = vectors.join(F.broadcast(near), "vector_id").select("query_id", cells.cell_of("embedding").alias("cell")).collect()
    if not found:
        return len(cells)
    place = {r["query_id"]: np.argsort(cells.order(r["embedding"])) for r in queries.collect()}
    places = np.sort([place[r["query_id"]][r["cell"]] for r in found])
    return int(places[min(len(places), math.ceil(recall * len(places))) - 1]) + 1
