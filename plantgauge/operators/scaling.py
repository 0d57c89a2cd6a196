"""Robust scaling fitted on the first share of each key's rows, and tail compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import KEY


def fit_robust(rows: DataFrame, sensors: list[str], train_pct: float = 0.7, key: str = KEY) -> DataFrame:
    """(key, sensor, center, scale): median and interquartile range, nulls skipped, of the first int(n * pct) rows of
    a key; a scale of 0 or null is 1, a center of null 0."""
    train = rows.where(F.col("row_pos") < F.floor(F.col("n_rows") * F.lit(float(train_pct))))
    packed = [F.struct(F.lit(s).alias("sensor"), F.percentile(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).alias(f"_{s}") for s in sensors]
    q = train.groupBy(key).agg(*packed).select(key, F.inline(F.array(*[f"_{s}" for s in sensors])))
    iqr = F.col("q")[2] - F.col("q")[0]
    return q.select(key, "sensor", F.coalesce(F.col("q")[1], F.lit(0.0)).alias("center"), F.when(iqr > 0, iqr).otherwise(1.0).alias("scale"))


def compress(z: Column, scale: float | None) -> Column:
    """scale * asinh(z / scale); unchanged without a scale."""
    return z if scale is None else scale * F.asinh(z / scale)


def apply_scaling(rows: DataFrame, scaler: DataFrame, sensors: list[str], tail: float | None = None, key: str = KEY, send: bool = False) -> DataFrame:
    """The wide rows with every sensor scaled. The scaler (one row per key and sensor) is pivoted to one row per key,
    so the rows are joined once, on the key. With `send` that one row per key goes to all executors, and the rows stay
    where they are instead of being put together by key."""
    wide = scaler.groupBy(F.col(key).alias("_key")).agg(*[F.max(F.when(F.col("sensor") == s, F.struct("center", "scale"))).alias(f"_{s}") for s in sensors])
    joined = rows.join(F.broadcast(wide) if send else wide, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumns({s: compress((F.col(s) - F.col(f"_{s}.center")) / F.col(f"_{s}.scale"), tail) for s in sensors}).drop("_key", *[f"_{s}" for s in sensors])


def fit_winsorised(rows: DataFrame, sensors: list[str], key: str = KEY) -> DataFrame:
    """(key, sensor, center, scale): the median; the larger of the interquartile range and the population deviation
    of the values clipped to their 1st and 99th percentile, nulls taken as the median; 0 is 1."""
    qs = "percentile({x}, array(0.01D, 0.25D, 0.5D, 0.75D, 0.99D))"
    q = rows.groupBy(F.col(key).alias("_key")).agg(*[F.expr(qs.replace("{x}", s)).alias(f"_{s}") for s in sensors])
    joined = rows.select(key, *sensors).join(q, F.col(key).eqNullSafe(F.col("_key")))
    clipped = {s: F.least(F.greatest(F.coalesce(F.col(s), F.col(f"_{s}")[2]), F.col(f"_{s}")[0]), F.col(f"_{s}")[4]) for s in sensors}
    parts = [F.struct(F.lit(s).alias("sensor"), F.first(f"_{s}").alias("q"), F.stddev_pop(c).alias("sd")).alias(f"p_{s}") for s, c in clipped.items()]
    each = joined.groupBy(key).agg(*parts).select(key, F.inline(F.array(*[f"p_{s}" for s in sensors])))
    wide = F.greatest(F.col("q")[3] - F.col("q")[1], F.col("sd"))
    return each.select(key, "sensor", F.col("q")[2].alias("center"), F.when(wide > 0, wide).otherwise(1.0).alias("scale"))
