"""Reconstruction errors, window scores, contributions and diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import KEY, mean_of


def row_error(rows: DataFrame, sensors: list[str], rebuilt: dict[str, Column] | None = None) -> DataFrame:
    """`rows` with row_error: mean squared difference to the reconstruction over the sensors that hold a value; the
    level model, the default, reconstructs 0."""
    gaps = [F.pow(F.col(s) - (rebuilt[s] if rebuilt else F.lit(0.0)), F.lit(2)) for s in sensors]
    return rows.withColumn("row_error", mean_of(gaps))


def window_scores(rows: DataFrame, key: str = KEY, percentile: float = 0.95) -> DataFrame:
    """(key, window_id, score): linear percentile of the row errors."""
    return rows.groupBy(key, "window_id").agg(F.percentile("row_error", percentile).alias("score"))


def sensor_errors(rows: DataFrame, sensors: list[str], key: str = KEY) -> DataFrame:
    """(key, window_id, sensor, error): mean squared residual per window and sensor; null if it holds no value."""
    packed = [F.struct(F.lit(s).alias("sensor"), F.avg(F.pow(F.col(s), F.lit(2))).alias("error")).alias(f"_{s}") for s in sensors]
    return rows.groupBy(key, "window_id").agg(*packed).select(key, "window_id", F.inline(F.array(*[f"_{s}" for s in sensors])))


def total_error(errors: DataFrame, key: str = KEY) -> DataFrame:
    """(key, n_cells, mse) over all windows and sensors."""
    return errors.groupBy(key).agg(F.count("error").alias("n_cells"), F.avg("error").alias("mse"))


def contributions(errors: DataFrame, top_k: int | None = None, key: str = KEY) -> DataFrame:
    """(key, window_id, sensor, rank, pct): the sensors of largest error and their share of the total in percent.

    Without top_k, min(10, max(1, n div 5)) of the n sensors. Ties go by name. Windows with no error have no row.
    """
    by = Window.partitionBy(key, "window_id")
    ranked = errors.withColumn("error", F.coalesce("error", F.lit(0.0))).withColumns({"rank": F.row_number().over(by.orderBy(F.col("error").desc(), "sensor")), "_total": F.sum("error").over(by), "_n": F.count("*").over(by)})
    k = F.lit(top_k) if top_k else F.least(F.lit(10), F.greatest(F.lit(1), F.expr("_n div 5")))
    return ranked.where((F.col("_total") > 0) & (F.col("rank") <= k)).select(key, "window_id", "sensor", "rank", (F.col("error") / F.col("_total") * 100).alias("pct"))


def baselines(errors: DataFrame, where: Column | None = None, key: str = KEY) -> DataFrame:
    """(key, sensor, baseline): mean error over the chosen windows."""
    rows = errors if where is None else errors.where(where)
    return rows.groupBy(key, "sensor").agg(F.avg("error").alias("baseline"))


def diagnosis(errors: DataFrame, base: DataFrame, masked: DataFrame | None = None, flag: float = 3.0, share_pct: float = 10.0, key: str = KEY) -> DataFrame:
    """(key, window_id, n_sensors, n_flagged, flagged_pct, is_anomaly, worst_sensor, worst_ratio).

    A sensor is flagged above `flag` times its baseline (one of 0 or less is 1e-10); a window is an anomaly above
    `share_pct` percent of its sensors. Masked sensors (key, window_id, sensor) don't count.
    """
    b = base.select(F.col(key).alias("_key"), F.col("sensor").alias("_s"), "baseline")
    rows = errors.join(b, F.col(key).eqNullSafe(F.col("_key")) & (F.col("sensor") == F.col("_s")), "left")
    if masked is not None:
        rows = rows.join(masked.select(key, "window_id", "sensor"), [key, "window_id", "sensor"], "left_anti")
    ratio = F.coalesce("error", F.lit(0.0)) / F.when(F.col("baseline") > 0, F.col("baseline")).otherwise(1e-10)
    rated = rows.withColumn("_r", ratio)
    out = rated.groupBy(key, "window_id").agg(F.count("*").alias("n_sensors"), F.count_if(F.col("_r") > flag).alias("n_flagged"), F.max(F.struct("_r", "sensor")).alias("_w"))
    pct = F.col("n_flagged") * 100.0 / F.col("n_sensors")
    return out.select(key, "window_id", "n_sensors", "n_flagged", pct.alias("flagged_pct"), (pct > share_pct).alias("is_anomaly"), F.col("_w.sensor").alias("worst_sensor"), F.col("_w._r").alias("worst_ratio"))


def top_sensor_mode(rows: DataFrame, sensors: list[str], key: str = KEY) -> DataFrame:
    """(key, window_id, sensor, n_rows): the sensor that is most often the largest in a row; ties by name."""
    best = F.greatest(*[F.abs(s) for s in sensors])
    first = F.coalesce(*[F.when(F.abs(s) == best, F.lit(s)) for s in sensors])
    counted = rows.withColumn("sensor", first).where("sensor IS NOT NULL").groupBy(key, "window_id", "sensor").agg(F.count("*").alias("n_rows"))
    place = F.row_number().over(Window.partitionBy(key, "window_id").orderBy(F.col("n_rows").desc(), "sensor"))
    return counted.withColumn("_r", place).where("_r = 1").drop("_r")


def signed_residuals(rows: DataFrame, sensors: list[str], top: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """(key, window_id, mean_residual, weighted_sign, majority): mean of the residuals, their squares' weighted mean
    sign, and positive, negative or mixed by the majority of sensors; over the sensors in `top` if given."""
    packed = [F.struct(F.lit(s).alias("sensor"), F.sum(s).alias("s1"), F.sum(F.pow(F.col(s), F.lit(2))).alias("s2"), F.sum(F.col(s) * F.col(s) * F.signum(s)).alias("s3"), F.count(s).alias("n")).alias(f"_{s}") for s in sensors]
    each = rows.groupBy(key, "window_id").agg(*packed).select(key, "window_id", F.inline(F.array(*[f"_{s}" for s in sensors])))
    if top is not None:
        each = each.join(top.select(key, "window_id", "sensor"), [key, "window_id", "sensor"], "left_semi")
    up, down, k = F.count_if(F.col("s1") > 0), F.count_if(F.col("s1") < 0), F.count("*")
    majority = F.when(up * 2 > k, "positive").when(down * 2 > k, "negative").otherwise("mixed")
    return each.groupBy(key, "window_id").agg((F.sum("s1") / F.nullif(F.sum("n"), F.lit(0))).alias("mean_residual"), (F.sum("s3") / F.nullif(F.sum("s2"), F.lit(0.0))).alias("weighted_sign"), majority.alias("majority"))


def directional_scores(rows: DataFrame, sensors: list[str], alpha: float, direction: float = 1.0, key: str = KEY) -> DataFrame:
    """(key, window_id, score): row errors whose squares weigh 1 + alpha * direction * sign, then the percentile."""
    terms = [(1 + F.lit(alpha * direction) * F.signum(s)) * F.pow(F.col(s), F.lit(2)) for s in sensors]
    return window_scores(rows.withColumn("row_error", mean_of(terms)), key)
