"""Zones, alert levels with persistence, and episodes, over windows in the order of a position column.

Frames look back a bounded number of windows, so blocks of positions are handled apart with an overlap; runs are
collapsed within blocks, and only runs that touch a block's edge meet their neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import cumulative
from .windows import overlapped

SEVERITY = {"green": 0, "yellow": 1, "red": 2}


def severity(level: Column) -> Column:
    return F.when(level == "red", 2).when(level == "yellow", 1).otherwise(0)


def level_name(ordinal: Column) -> Column:
    return F.when(ordinal == 2, "red").when(ordinal == 1, "yellow").otherwise("green")


def zone(score: Column, green_yellow: Column, yellow_red: Column) -> Column:
    """red or yellow at or above its limit; green else, also without a score."""
    clean = F.when(F.isnan(score), None).otherwise(score)
    return F.when(clean >= yellow_red, "red").when(clean >= green_yellow, "yellow").otherwise("green")


def alert_timeline(zones: DataFrame, keys: list[str], pos: str = "pos", to_yellow: int = 2, to_red: int = 3, yellow_run: int = 4, mixed_hours: float | None = None, window_minutes: float = 30.0) -> DataFrame:
    """`zones` (with `zone` and a gapless position per key) with alert_level.

    red after `to_red` red windows in a row; yellow after `to_yellow` red ones, after `yellow_run` yellow ones, or if
    the last round(hours * 60 / minutes) windows hold both and 2 * red + yellow >= 4; else green.
    """
    span = max(1, round(mixed_hours * 60 / window_minutes)) if mixed_hours else 0
    back = max(to_red, to_yellow, yellow_run, span) - 1
    spread = overlapped(zones, pos, back)
    order = Window.partitionBy(*keys, "_blk").orderBy(pos)

    def count(level: str, k: int) -> Column:
        return F.sum((F.col("zone") == level).cast("int")).over(order.rowsBetween(-(k - 1), 0))

    level = F.when(count("red", to_red) >= to_red, "red").when(count("red", to_yellow) >= to_yellow, "yellow").when(count("yellow", yellow_run) >= yellow_run, "yellow")
    if span:
        red, yellow = count("red", span), count("yellow", span)
        level = level.when((red >= 1) & (yellow >= 1) & (2 * red + yellow >= 4), "yellow")
    return spread.withColumn("alert_level", level.otherwise("green")).where("_own").drop("_blk", "_own")


def latest_alert(zones: DataFrame, keys: list[str], pos: str = "pos", **rules) -> DataFrame:
    """(<keys>, alert_level, consecutive_red, consecutive_yellow, n_windows, reason) of each key's last window."""
    timed = alert_timeline(zones, keys, pos, **rules)

    def streak(level: str) -> Column:
        return F.max(pos) - F.coalesce(F.max(F.when(F.col("zone") != level, F.col(pos))), F.lit(-1))

    last = timed.groupBy(*keys).agg(F.max_by("alert_level", pos).alias("alert_level"), streak("red").alias("consecutive_red"), streak("yellow").alias("consecutive_yellow"), F.count("*").alias("n_windows"))
    reason = F.when(F.col("consecutive_red") > 0, F.format_string("%d red in a row", "consecutive_red")).when(F.col("consecutive_yellow") > 0, F.format_string("%d yellow in a row", "consecutive_yellow")).otherwise("last window green")
    return last.withColumn("reason", reason)


def runs(df: DataFrame, keys: list[str], on: Column, pos: str = "pos", keep: dict[str, tuple[str, str]] | None = None, block: int = 4096) -> DataFrame:
    """(<keys>, start_pos, end_pos, n, <keep>) of each maximal run of neighbouring positions where `on` holds.

    `keep` maps a name to (SQL over a row, how to combine: min, max or sum). Positions must be gapless per key.
    """
    keep = keep or {}
    held = df.where(F.coalesce(on, F.lit(False))).select(*keys, F.col(pos).alias("_p"), *[F.expr(e).alias(n) for n, (e, _) in keep.items()]).withColumn("_blk", F.expr(f"_p div {block}"))
    combine = {"min": F.min, "max": F.max, "sum": F.sum}
    local = Window.partitionBy(*keys, "_blk").orderBy("_p")
    opened = held.withColumn("_open", F.coalesce((F.col("_p") - F.lag("_p").over(local) != 1).cast("int"), F.lit(1)))
    parts = (
        opened.withColumn("_seg", F.sum("_open").over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_blk", "_seg")
        .agg(F.min("_p").alias("start_pos"), F.max("_p").alias("end_pos"), F.count("*").alias("n"), *[combine[how](n).alias(n) for n, (_, how) in keep.items()])
    )
    edge = (F.col("start_pos") == F.col("_blk") * block) | (F.col("end_pos") == F.col("_blk") * block + block - 1)
    parts = parts.withColumn("_part", F.when(edge, None).otherwise(F.col("_blk")))
    across = Window.partitionBy(*keys, "_part").orderBy("start_pos")
    opened = parts.withColumn("_open", F.coalesce((F.col("start_pos") - F.lag("end_pos").over(across) != 1).cast("int"), F.lit(1)))
    named = opened.withColumn("_run", F.sum("_open").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    whole = named.groupBy(*keys, "_part", "_run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.sum("n").alias("n"), *[combine[how](n).alias(n) for n, (_, how) in keep.items()])
    return whole.drop("_part", "_run")


def episodes(levels: DataFrame, keys: list[str], pos: str = "pos", start: str = "window_start", end: str = "window_end") -> DataFrame:
    """(<keys>, start_window_idx, end_window_idx, start_time, end_time, peak_level, n_windows) of each run of windows
    whose alert_level isn't green."""
    rank = "CASE alert_level WHEN 'red' THEN 2 WHEN 'yellow' THEN 1 ELSE 0 END"
    found = runs(levels, keys, F.col("alert_level") != "green", pos, {"start_time": (start, "min"), "end_time": (end, "max"), "peak": (rank, "max")})
    return found.select(*keys, F.col("start_pos").alias("start_window_idx"), F.col("end_pos").alias("end_window_idx"), "start_time", "end_time", level_name(F.col("peak")).alias("peak_level"), F.col("n").alias("n_windows"))


def level_runs(levels: DataFrame, keys: list[str], level: str = "red", pos: str = "pos") -> DataFrame:
    """(<keys>, n_runs): runs of one alert level."""
    return runs(levels, keys, F.col("alert_level") == level, pos).groupBy(*keys).agg(F.count("*").alias("n_runs"))


def persistent_alarm(scores: DataFrame, keys: list[str], alarm: Column, persistence: int = 3, pos: str = "pos") -> DataFrame:
    """`scores` with alarm: raised only where the last `persistence` windows raise it, never in the first ones."""
    spread = overlapped(scores.withColumn("_a", F.coalesce(alarm, F.lit(False)).cast("int")), pos, persistence - 1)
    frame = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(-(persistence - 1), 0)
    held = (F.min("_a").over(frame) == 1) & (F.col(pos) >= persistence - 1)
    return spread.withColumn("alarm", held).where("_own").drop("_blk", "_own", "_a")


def episode_stats(found: DataFrame, active: DataFrame, keys: list[str], start: str = "start_time", end: str = "end_time") -> DataFrame:
    """(<keys>, n_episodes, n_active, min_h, median_h, max_h): durations; the median is the upper one.

    `active` is (<keys>, n_active) of active windows per key.
    """
    hours = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 3.6e9
    counts = found.groupBy(*keys, hours.alias("_h")).agg(F.count("*").alias("_c"))
    ranked = cumulative(counts, keys, "_h", ["_c"])
    upper = F.min(F.when(F.col("_c_upto") > F.floor(F.col("_c_all") / 2), F.col("_h")))
    stats = ranked.groupBy(*keys).agg(F.max("_c_all").alias("n_episodes"), F.min("_h").alias("min_h"), upper.alias("median_h"), F.max("_h").alias("max_h"))
    return stats.join(active, keys, "left").select(*keys, "n_episodes", F.coalesce("n_active", F.lit(0)).alias("n_active"), "min_h", "median_h", "max_h")


def near_events(windows: DataFrame, keys: list[str], event: Column, k: int, pos: str = "pos") -> DataFrame:
    """`windows` with near_event: an event within `k` windows on either side."""
    spread = overlapped(windows.withColumn("_e", F.coalesce(event, F.lit(False)).cast("int")), pos, k, k)
    frame = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(-k, k)
    return spread.withColumn("near_event", F.max("_e").over(frame) == 1).where("_own").drop("_blk", "_own", "_e")


def startup_margin(windows: DataFrame, keys: list[str], running: Column, k: int, pos: str = "pos") -> DataFrame:
    """`windows` with starting: the first `k` running windows after one that isn't; what lies before the first
    window counts as not running."""
    spread = overlapped(windows.withColumn("_off", (~F.coalesce(running, F.lit(False))).cast("int")), pos, k)
    frame = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(-k, -1)
    starting = (F.col("_off") == 0) & ((F.coalesce(F.max("_off").over(frame), F.lit(1)) == 1) | (F.col(pos) < k))
    return spread.withColumn("starting", starting).where("_own").drop("_blk", "_own", "_off")


def smoothed(scores: DataFrame, keys: list[str], score: str = "score", factor: float = 0.2, pos: str = "pos", block: int = 4096) -> DataFrame:
    """`scores` with ewma: a[0] = x[0], a[i] = factor * x[i] + (1 - factor) * a[i-1]; a null x keeps a.

    Three passes: each block of positions is folded to (decay, sum); the folds are chained per key, one small row per
    block; and each block is run again from what it starts with.
    """
    blocked = scores.select("*", F.expr(f"{pos} div {block}").alias("_blk"))
    names = [*keys, "_blk"]
    kinds = {f.name: f.dataType.simpleString() for f in blocked.schema.fields}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in names)

    def run(x: np.ndarray, a: float) -> np.ndarray:
        out = np.empty(len(x))
        for i, v in enumerate(x.tolist()):
            if v == v:
                a = factor * v + (1 - factor) * a if a == a else v
            out[i] = a
        return out

    def ordered(part: pa.Table) -> tuple[pa.Table, np.ndarray]:
        part = part.take(pa.array(np.argsort(part[pos].to_numpy(), kind="stable")))
        return part, part[score].to_numpy(zero_copy_only=False).astype(float) if part[score].null_count < part.num_rows else np.full(part.num_rows, np.nan)

    def first(part: pa.Table) -> pa.Table:
        part, x = ordered(part)
        held = x[~np.isnan(x)]
        # a block that starts from a leaves fold + decay * a; one that starts from nothing, as if from its first value
        fold = run(held, 0.0)[-1] if len(held) else 0.0
        one = {k: part[k].slice(0, 1) for k in names} | {"decay": [(1 - factor) ** len(held)], "fold": [fold], "first": pa.array([held[0] if len(held) else None], pa.float64())}
        return pa.table(one)

    def chain(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.argsort(part["_blk"].to_numpy())))
        a, starts = None, []
        for decay, fold, x0 in zip(part["decay"].to_pylist(), part["fold"].to_pylist(), part["first"].to_pylist(), strict=True):
            starts.append(a)
            a = a if x0 is None else fold + decay * (x0 if a is None else a)
        return pa.table({k: part[k] for k in names} | {"start": pa.array(starts, pa.float64())})

    def again(part: pa.Table, start: pa.Table) -> pa.Table:
        part, x = ordered(part)
        a = start["start"][0].as_py() if start.num_rows else None
        return part.drop_columns(["_blk"]).append_column("ewma", pa.array(run(x, np.nan if a is None else a), pa.float64(), from_pandas=True))

    folds = blocked.select(*names, pos, score).groupBy(*names).applyInArrow(first, f"{head}, decay double, fold double, first double")
    starts = folds.groupBy(*keys).applyInArrow(chain, f"{head}, start double")
    schema = T.StructType([*scores.schema.fields, T.StructField("ewma", T.DoubleType())])
    return blocked.groupBy(*names).cogroup(starts.groupBy(*names)).applyInArrow(again, schema)
