"""Hand-over files between stages of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_name(run_id: str) -> str:
    """A run id fit for a file name."""
    return run_id.translate(str.maketrans(":+", "__"))


def run_name_column(run_id: Column) -> Column:
    return F.translate(run_id, ":+", "__")


def stage_path(base: str, run_id: str, name: str) -> str:
    return f"{base.rstrip('/')}/{run_name(run_id)}_{name}"


def write_stage(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, dates as ISO text; NULLs are kept as such."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def stage_done(spark: SparkSession, path: str) -> bool:
    """Whether a stage's file was written to its end."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_stage(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stage by its schema, so that no pass over the data infers one."""
    return spark.read.schema(schema).json(path)
