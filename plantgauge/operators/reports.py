"""Composite reports: latency of alarms, simulated suppression, sufficiency of data, variants and model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import pointwise, ratio, resembling


def node_latency(alarms: DataFrame, node_windows: DataFrame, keys: list[str], alarm: Column, before: int = 12, pos: str = "pos") -> DataFrame:
    """(<keys>, node_id, first_pos, last_pos, latency, n_before): windows from a node's start to the first alarm in
    [start - 1, end + 1] (null if none), and alarms in the `before` windows up to two before the start.

    A node's reach is spread over its positions and met by an equi-join, so only alarms near nodes take part.
    """
    spans = node_windows.groupBy(*keys, "node_id").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"))
    reach = spans.withColumn(pos, F.explode(F.sequence(F.col("first_pos") - before, F.col("last_pos") + 1)))
    hits = alarms.where(F.coalesce(alarm, F.lit(False))).select(*keys, pos)
    met = reach.join(hits, [*keys, pos])
    near, early = F.col(pos) >= F.col("first_pos") - 1, F.col(pos) <= F.col("first_pos") - 2
    per = met.groupBy(*keys, "node_id").agg(F.min(F.when(near, F.col(pos))).alias("_a"), F.count_if(early).alias("_b"))
    out = spans.join(per, [*keys, "node_id"], "left")
    return out.select(*keys, "node_id", "first_pos", "last_pos", (F.col("_a") - F.col("first_pos")).alias("latency"), F.coalesce("_b", F.lit(0)).alias("n_before"))


def suppression(rows: DataFrame, keys: list[str], truth: Column, flagged: Column, suppressed: Column, usable: Column) -> DataFrame:
    """(<keys>, before_precision, before_recall, after_precision, after_recall, n_suppressed) if flagged windows of
    one kind were taken for green."""
    gone = F.coalesce(flagged & suppressed, F.lit(False))
    a = pointwise(rows, keys, truth, flagged, usable).select(*keys, F.col("precision").alias("before_precision"), F.col("recall").alias("before_recall"))
    b = pointwise(rows, keys, truth, flagged & ~gone, usable).select(*keys, F.col("precision").alias("after_precision"), F.col("recall").alias("after_recall"))
    n = rows.where(usable).groupBy(*keys).agg(F.count_if(gone).alias("n_suppressed"))
    return a.join(b, keys).join(n, keys)


def recall_by(events: DataFrame, keys: list[str], detected: Column) -> DataFrame:
    """(<keys>, n, n_detected, recall)."""
    out = events.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(detected).alias("n_detected"))
    return out.withColumn("recall", ratio(F.col("n_detected"), F.col("n")))


def sufficiency(split: DataFrame, coverage: DataFrame, keys: list[str], size: int = 120, seconds: int = 15, least_days: float = 30.0, least_nodes: int = 1) -> DataFrame:
    """(<keys>, train_days, n_test_nodes, enough): whether training holds enough days and the test split a node.

    `coverage` is (<keys>, n_test_nodes)."""
    days = F.count_if(F.col("split") == "train") * (size * seconds / 86_400)
    out = split.groupBy(*keys).agg(days.alias("train_days")).join(coverage, keys, "left").withColumn("n_test_nodes", F.coalesce("n_test_nodes", F.lit(0)))
    return out.withColumn("enough", (F.col("train_days") >= least_days) & (F.col("n_test_nodes") >= least_nodes))


def variant_report(runs: DataFrame, variant: str = "variant", metric: str = "metric", base: str = "baseline") -> DataFrame:
    """(variant, n, mean, std, gain, verdict): over seeds; a gain within the base's two deviations is noise.

    The base is one row, joined by a constant."""
    stats = runs.groupBy(F.col(variant).alias("variant")).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    one = stats.where(F.col("variant") == base).select(F.lit(1).alias("_one"), F.col("mean").alias("_m"), F.coalesce("std", F.lit(0.0)).alias("_s"))
    j = stats.withColumn("_one", F.lit(1)).join(one, "_one", "left").withColumn("gain", F.col("mean") - F.col("_m"))
    verdict = F.when(F.col("variant") == base, "base").when(F.abs("gain") <= 2 * F.col("_s"), "noise").when(F.col("gain") > 0, "better").otherwise("worse")
    return j.select("variant", "n", "mean", "std", "gain", verdict.alias("verdict"))


def chosen_model(losses: DataFrame, keys: list[str], model: str = "model", loss: str = "val_loss") -> DataFrame:
    """(<keys>, model, val_loss): the model of least loss per fold; ties by name, as simpler ones come first."""
    best = F.min(F.struct(F.col(loss).alias("l"), F.col(model).alias("m")))
    return losses.where(F.col(loss).isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.m").alias("model"), F.col("_b.l").alias("val_loss"))


def label_free(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(<keys>, n_windows, n_usable, n_scored, n_alerts, alert_share) without any labels."""
    flagged = F.col("usable") & (F.col("zone") != "green")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.count_if("usable").alias("n_usable"), F.count("score").alias("n_scored"), F.count_if(flagged).alias("n_alerts"))
    return out.withColumn("alert_share", ratio(F.col("n_alerts"), F.col("n_usable")))


def as_of(rows: DataFrame, events: DataFrame, keys: list[str], width: int, at: str = "us", position: str = "row_pos") -> DataFrame:
    """`events` (keys, event_id, <at>) with the position of the first row at or after the time; beyond the last row its
    position. Rows and events meet in time buckets; what later buckets start with is combined per key."""
    r = rows.select(*keys, F.col(at).alias("t"), F.col(position).alias("p"), F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("o"))
    e = events.select(*keys, F.col(at).alias("t"), F.lit(None).cast("long").alias("p"), F.col("event_id").cast("long"), F.lit(0).alias("o"))
    both = r.unionByName(e).withColumn("_b", F.floor(F.col("t") / width))
    by = Window.partitionBy(*keys)
    per = both.groupBy(*keys, "_b").agg(F.min("p").alias("_lo"), F.max("p").alias("_hi"))
    ahead = per.select(*keys, "_b", F.min("_lo").over(by.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_next"), F.max("_hi").over(by).alias("_end"))
    found = both.withColumn("_near", F.min("p").over(Window.partitionBy(*keys, "_b").orderBy("t", "o").rowsBetween(0, Window.unboundedFollowing)))
    return found.where("event_id IS NOT NULL").join(ahead, [*keys, "_b"]).select(*keys, "event_id", F.coalesce("_near", "_next", "_end").alias(position))


def episode_false_alarms(episodes: DataFrame, windows: DataFrame, signatures: DataFrame, keys: list[str], threshold: float = 0.3, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """((<keys>, n_episodes, n_false, false_rate), (<keys>, start_window_idx, resembles_slug, jaccard)).

    An episode is a false alarm if none of its windows (with pos, active and top_sensors) is active; false alarms
    whose sensors resemble a known rule are told apart, never taken out of the rate. Episodes are spread over their
    windows and met by an equi-join.
    """
    spread = episodes.select(*keys, "start_window_idx", F.explode(F.sequence("start_window_idx", "end_window_idx")).alias(pos))
    met = spread.join(windows.select(*keys, pos, "active", "top_sensors"), [*keys, pos], "left")
    each = met.groupBy(*keys, "start_window_idx").agg(F.max(F.coalesce("active", F.lit(False))).alias("_on"), F.array_distinct(F.flatten(F.collect_set(F.coalesce("top_sensors", F.array().cast("array<string>"))))).alias("sensors"))
    rates = each.groupBy(*keys).agg(F.count("*").alias("n_episodes"), F.count_if(~F.col("_on")).alias("n_false")).withColumn("false_rate", ratio(F.col("n_false"), F.col("n_episodes")))
    return rates, resembling(each.where("NOT _on").select(*keys, "start_window_idx", "sensors"), signatures, [*keys, "start_window_idx"], threshold)


def rule_direction_quality(rows: DataFrame, direction: str, flagged: Column) -> DataFrame:
    """(direction, n, n_flagged, recall, precision): recall within a direction's windows; precision over those and
    the windows without any rule."""
    f = F.coalesce(flagged, F.lit(False))
    counts = rows.groupBy(F.col(direction).alias("direction")).agg(F.count("*").alias("n"), F.count_if(f).alias("n_flagged"))
    none = counts.where("direction = 'none'").select(F.lit(1).alias("_one"), F.col("n_flagged").alias("_none"))
    j = counts.where("direction <> 'none'").withColumn("_one", F.lit(1)).join(none, "_one", "left")
    return j.select("direction", "n", "n_flagged", ratio(F.col("n_flagged"), F.col("n")).alias("recall"), ratio(F.col("n_flagged"), F.col("n_flagged") + F.coalesce("_none", F.lit(0))).alias("precision"))


def sign_shares(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(<keys>, n, share_up, share_down) of the rows that hold a value."""
    held = rows.where(F.col(value).isNotNull())
    return held.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(value) > 0).cast("int")).alias("share_up"), F.avg((F.col(value) < 0).cast("int")).alias("share_down"))
