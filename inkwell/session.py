"""Session helpers: tables, checkpoints and sizes."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir and read back, so lost executors cost nothing.

    Where no folder is named, a temporary one is used in local mode only: on a cluster it would lie on one machine, so that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="inkwell-"))
    return df.checkpoint()


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, for scans the size of the files; 0 if it knows none (then it says some exabytes)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


def shuffle_parts(spark: SparkSession, size: int = 0, per_part: int = 16 << 20) -> int:
    """Partitions for size bytes, never fewer than spark.sql.shuffle.partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_part))


def once_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first by order. Rows with a null key stay apart unless they agree in every ordered column."""
    from pyspark.sql import Window

    other = F.when(F.col(key).isNull(), F.xxhash64(*order))
    w = Window.partitionBy(F.col(key), other).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(w)).filter("__first = 1").drop("__first")


def settled(df: DataFrame) -> DataFrame:
    """df behind a generator of one row each: the optimizer neither pushes filters through it nor merges projections across it, so long expressions are computed once and not copied."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
