"""Session helpers: time columns as integers, durable cuts of lineage, table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an estimated plan size under which a side may be hinted for broadcast.
BROADCAST_BOUND = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without zone; the session's zone is to be UTC."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(f"`{name}`").cast("timestamp"))


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back, so that it survives the loss of executors.

    The folder is spark.checkpoint.dir; only where that is unset on one machine a temporary one is made.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager)


def _shared(spark: SparkSession) -> str:
    """The folder that all machines see: of spark.checkpoint.dir, which is set for the context if it wasn't."""
    sc = spark.sparkContext
    named, used = sc.getConf().get("spark.checkpoint.dir"), sc._jsc.sc().getCheckpointDir()
    if used.isEmpty():
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        used = sc._jsc.sc().getCheckpointDir()
    return used.get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables, beside the checkpoints."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def spread(spark: SparkSession) -> int:
    """Number of partitions a full shuffle gets."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan's size; unknown sizes come out huge."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, bound: int = BROADCAST_BOUND) -> DataFrame:
    """`df` with a broadcast hint if its estimated size is within `bound`; else unchanged, and Spark shuffles it."""
    return F.broadcast(df) if estimated_bytes(df) <= bound else df


def spread_out(df: DataFrame) -> DataFrame:
    """`df` over all cores, for work that costs far more than moving a row: repartitioned if a scan of few or large
    files gives fewer partitions than there are cores, else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < cores else df


__all__ = ["BROADCAST_BOUND", "durable", "estimated_bytes", "finite", "micros", "shared_folder", "small", "spread", "spread_out", "table"]
