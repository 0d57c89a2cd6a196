"""Scoring of a whole timeline: running check, quality, fill, scaling, masking, errors, score and zone in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import alerts, limits, scaling, scoring, windows
from .windows import KEY


def score_timeline(rows: DataFrame, sensors: list[str], speed: str, threshold: float, train_pct: float = 0.7, tail: float | None = 20.0, low: float = 90.0, high: float = 99.0, rebuilt: dict[str, Column] | None = None, key: str = KEY) -> DataFrame:
    """(key, window_id, status, usable, n_masked, score, zone, top_sensor), a row per window.

    status is `not_running`, `rejected` (too many masked sensors) or `scored`; windows that aren't scored have no
    score and no zone. Short gaps are filled within the window before scaling; masked sensors count neither in the row
    errors nor for the top sensor. The limits are the key's percentiles over its scored windows. `rebuilt` has a
    reconstruction per sensor of the scaled rows; without it the level model reconstructs 0.
    """
    scaler = scaling.fit_robust(rows, sensors, train_pct, key)
    quality = windows.window_quality(rows, sensors, key=key)
    running = windows.running_windows(rows, speed, threshold, key=key)
    state = quality.join(running, [key, "window_id"]).select(
        F.col(key).alias("_key"), F.col("window_id").alias("_w"), F.when(~F.col("running"), "not_running").when(~F.col("usable"), "rejected").otherwise("scored").alias("status"), "n_masked", F.split("masked_sensors", ",").alias("_masked")
    )
    scaled = scaling.apply_scaling(windows.bounded_fill(rows, sensors, key=key), scaler, sensors, tail, key)
    joined = scaled.join(state, F.col(key).eqNullSafe(F.col("_key")) & (F.col("window_id") == F.col("_w")))
    kept = joined.withColumns({s: F.when(~F.array_contains("_masked", F.lit(s)), F.col(s)) for s in sensors}).drop("_key", "_w")
    live = kept.where("status = 'scored'")
    scores = durable(scoring.window_scores(scoring.row_error(live, sensors, rebuilt), key))  # one row per window, read twice
    top = scoring.contributions(scoring.sensor_errors(live, sensors, key).withColumn("error", F.round("error", 9)), 1, key).select(key, "window_id", F.col("sensor").alias("top_sensor"))
    lim = limits.percentile_limits(scores, [key], low=low, high=high).select(key, "green_yellow", "yellow_red")
    zoned = scores.join(lim, key).withColumn("zone", alerts.zone(F.col("score"), F.col("green_yellow"), F.col("yellow_red"))).select(key, "window_id", "score", "zone")
    out = state.withColumnsRenamed({"_key": key, "_w": "window_id"}).drop("_masked").withColumn("usable", F.col("status") == "scored")
    return out.join(zoned, [key, "window_id"], "left").join(top, [key, "window_id"], "left").select(key, "window_id", "status", "usable", "n_masked", "score", "zone", "top_sensor")
