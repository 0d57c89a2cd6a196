"""Chronological splits and folds of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import DAY_US, row_positions


def stratified_split(windows: DataFrame, label: list[str], order: list[str], train: float = 0.85, val: float = 0.10) -> DataFrame:
    """`windows` with split: per label in order the first int(n * train) rows train, the next int(n * val) val, the
    rest test. `order` is a time or whole number and a column that breaks ties."""
    placed = row_positions(windows, order[0], order[-1], label, _width(windows, order[0]))
    first = F.floor(F.col("n_rows") * F.lit(float(train)))
    second = first + F.floor(F.col("n_rows") * F.lit(float(val)))
    split = F.when(F.col("row_pos") < first, "train").when(F.col("row_pos") < second, "val").otherwise("test")
    return placed.withColumn("split", split).drop("row_pos", "n_rows")


def _width(df: DataFrame, order: str) -> int:
    """Bucket width for row_positions: a month of time, or 65,536 numbers."""
    return 31 * DAY_US if df.schema[order].dataType.typeName().startswith("timestamp") else 65_536


def drop_touched(split: DataFrame, touched: DataFrame, on: list[str]) -> DataFrame:
    """Train and val windows that an event touches are left out; test windows stay."""
    bad = touched.where("touched").select(*on).withColumn("_touched", F.lit(True))
    return split.join(bad, on, "left").where("_touched IS NULL OR split = 'test'").drop("_touched")


def blocked_folds(windows: DataFrame, key: list[str], order: str, folds: int = 5, gap: int = 2) -> DataFrame:
    """(<key>, <order>, fold, role): each fold's block is `test`, the windows within `gap` of it `gap`, others `pool`.

    The first n mod folds blocks are one longer. The folds are joined as a fixed dimension of `folds` rows per key.
    """
    placed = row_positions(windows, order, order, key, _width(windows, order))
    q, r, p = F.expr(f"n_rows div {folds}"), F.col("n_rows") % folds, F.col("row_pos")
    # as ntile: the first r blocks hold q + 1 windows each
    block = F.when(p < r * (q + 1), F.floor(p / (q + 1))).otherwise(r + F.floor((p - r * (q + 1)) / F.greatest(q, F.lit(1))))
    tiled = placed.select(*key, order, p.alias("_p"), block.cast("int").alias("_block"))
    bounds = tiled.groupBy(*key, F.col("_block").alias("fold")).agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    role = F.when(F.col("_block") == F.col("fold"), "test").when(F.col("_p").between(F.col("_lo") - gap, F.col("_hi") + gap), "gap").otherwise("pool")
    return tiled.join(bounds, key).select(*key, order, F.col("fold").cast("int").alias("fold"), role.alias("role"))


def rolling_folds(windows: DataFrame, key: list[str], start: str, order: str, min_history: int = 2, max_train: int = 6, gap: int = 2, period: Column | None = None) -> DataFrame:
    """(<key>, test_period, role, n_windows): of period i >= min_history the windows are `test`, those of i - 1 but
    for its last `gap` windows `val`, those of the `max_train` periods before `train`."""
    label = F.date_format(start, "yyyy-MM") if period is None else period
    named = row_positions(windows.withColumn("_period", label), order, order, [*key, "_period"], _width(windows, order))
    # periods are few: they are numbered in a table of their own
    periods = named.select(*key, "_period").distinct().withColumn("_i", F.dense_rank().over(Window.partitionBy(*key).orderBy("_period")) - 1)
    numbered = named.withColumn("_back", F.col("n_rows") - F.col("row_pos")).join(periods, [*key, "_period"])
    folds = periods.where(F.col("_i") >= min_history).select(*key, F.col("_i").alias("_test"), F.col("_period").alias("test_period"))
    i, t = F.col("_i"), F.col("_test")
    role = F.when(i == t, "test").when((i == t - 1) & (F.col("_back") > gap), "val").when((i <= t - 2) & (i >= F.greatest(F.lit(0), t - 1 - max_train)), "train")
    # counted per period and closeness to its end first, so that folds meet few rows
    held = numbered.groupBy(*key, "_i", F.least("_back", F.lit(gap + 1)).alias("_back")).agg(F.count("*").alias("_n"))
    return held.join(folds, key).withColumn("role", role).where("role IS NOT NULL").groupBy(*key, "test_period", "role").agg(F.sum("_n").alias("n_windows"))


def interleaved_days(windows: DataFrame, key: list[str], start: str, every: int = 5) -> DataFrame:
    """`windows` with part: those of every 5th distinct day `val`, others `train`."""
    dated = windows.withColumn("_day", F.to_date(start))
    days = dated.select(*key, "_day").distinct().withColumn("_d", F.dense_rank().over(Window.partitionBy(*key).orderBy("_day")))
    return dated.join(days, [*key, "_day"]).withColumn("part", F.when((F.col("_d") - 1) % every == every - 1, "val").otherwise("train")).drop("_day", "_d")


def hash_sample(rows: DataFrame, on: list[str], share: float) -> DataFrame:
    """A sample that doesn't depend on order or partitioning: rows whose key's hash falls into the share."""
    return rows.where(F.pmod(F.xxhash64(*on), F.lit(1_000_000)) < int(share * 1_000_000))
