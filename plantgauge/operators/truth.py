"""Labelled events against windows: interval, range, band and nearest joins, and what is true of a window.

Range joins go over time buckets: either side is spread over the buckets that it touches, met by an equi-join, and
checked exactly; no side is broadcast, and no pair of rows meets outside a shared bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import micros

HOUR_US = 3_600_000_000


def clean_labels(labels: DataFrame) -> DataFrame:
    """(label_id, node_id, equipment_id, s, e, rule_slug, severity, sensors): each label once, times in microseconds;
    labels without a node or time, or that end before they start, are left out."""
    rows = labels.select("label_id", "node_id", F.col("equipment_tag").alias("equipment_id"), micros(labels, "start_time").alias("s"), micros(labels, "end_time").alias("e"), "rule_slug", "severity", "sensors")
    return rows.where("node_id IS NOT NULL AND s IS NOT NULL AND e >= s").dropDuplicates(["label_id"])


def node_table(labels: DataFrame) -> DataFrame:
    """(equipment_id, node_id, slug, severity, sensors, s, e, hours): per node the slug of its first label, the peak
    severity, the sorted distinct sensors, the outer times and their distance."""
    return labels.groupBy("equipment_id", "node_id").agg(
        F.min_by("rule_slug", F.struct("s", "label_id")).alias("slug"), F.max("severity").alias("severity"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("sensors", F.array().cast("array<string>")))))).alias("sensors"),
        F.min("s").alias("s"), F.max("e").alias("e"), ((F.max("e") - F.min("s")) / 3.6e9).alias("hours"),
    )


def buckets(start: str | Column, end: str | Column, width: int) -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int = 6 * HOUR_US, half_open: bool = False) -> DataFrame:
    """Pairs of a left (ls, le) and a right (rs, re) row of equal keys whose intervals meet, each pair once.

    Closed intervals by default; with `half_open` the ends are outside. A pair is told in the bucket where the later
    of the two starts.
    """
    a = left.withColumn("_b", buckets("ls", "le", width))
    b = right.withColumn("_b", buckets("rs", "re", width))
    meets = (F.col("rs") < F.col("le")) & (F.col("ls") < F.col("re")) if half_open else (F.col("rs") <= F.col("le")) & (F.col("ls") <= F.col("re"))
    return a.join(b, [*keys, "_b"]).where(meets & (F.col("_b") == F.floor(F.greatest("ls", "rs") / width))).drop("_b")


def nearest_events(windows: DataFrame, nodes: DataFrame, keys: list[str], width: int = 24 * HOUR_US) -> DataFrame:
    """`windows` (keys, window_id, ls, le) with nearest_node_id, overlap and signed_hours (+ ahead, - behind).

    An overlapping node (the first by start, then id) is at 0; else the node with the least gap, ahead and behind
    alike by start and id; null without any node. Two as-of look-ups (the last end before, the first start after)
    instead of all pairs: both sides are put in one order, and what each time bucket hands on is combined per key.
    """
    n = nodes.select(*keys, "node_id", F.col("s").alias("rs"), F.col("e").alias("re"))
    hit = overlap_join(windows.select(*keys, "window_id", "ls", "le"), n, keys).groupBy(*keys, "window_id").agg(F.min(F.struct("rs", "node_id")).alias("_hit"))
    none = F.lit(None).cast("long")

    def as_of(at: str, when: Column, value: Column, ahead: bool) -> DataFrame:
        """Per window the best node not past `at`: the latest end before, or the earliest start after."""
        w = windows.select(*keys, "window_id", F.col(at).alias("t"), F.lit(None).cast(value_type).alias("v"), F.lit(0 if ahead else 1).alias("kind"))
        e = n.select(*keys, none.alias("window_id"), when.alias("t"), value.alias("v"), F.lit(1 if ahead else 0).alias("kind"))
        both = w.unionByName(e).withColumn("_b", F.floor(F.col("t") / width))
        best = F.min if ahead else F.max
        per = both.groupBy(*keys, "_b").agg(best("v").alias("_v"))
        beyond = Window.partitionBy(*keys).orderBy("_b")
        frame = beyond.rowsBetween(1, Window.unboundedFollowing) if ahead else beyond.rowsBetween(Window.unboundedPreceding, -1)
        handed = per.select(*keys, "_b", best("_v").over(frame).alias("_far"))
        order = Window.partitionBy(*keys, "_b").orderBy("t", "kind")
        near = order.rowsBetween(0, Window.unboundedFollowing) if ahead else order.rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_near", best("v").over(near)).where("window_id IS NOT NULL").join(handed, [*keys, "_b"])
        return found.select(*keys, "window_id", F.coalesce("_near", "_far").alias("_ahead" if ahead else "_behind"))

    # of nodes with one end the one that starts first counts, so the start goes in reversed into the largest struct
    value_type = "struct<t:bigint,s:bigint,id:bigint>"
    after = as_of("le", F.col("rs"), F.struct(F.col("rs").alias("t"), F.col("rs").alias("s"), F.col("node_id").alias("id")), True)
    before = as_of("ls", F.col("re"), F.struct(F.col("re").alias("t"), (-F.col("rs")).alias("s"), (-F.col("node_id")).alias("id")), False)
    joined = windows.join(hit, [*keys, "window_id"], "left").join(after, [*keys, "window_id"], "left").join(before, [*keys, "window_id"], "left")
    ga, gb = F.col("_ahead.t") - F.col("le"), F.col("ls") - F.col("_behind.t")
    first = F.col("_ahead").isNotNull() & (F.col("_behind").isNull() | (ga < gb) | ((ga == gb) & (F.col("_ahead.s") < -F.col("_behind.s"))))
    signed = F.when(F.col("_hit").isNotNull(), 0.0).when(first, ga / 3.6e9).when(F.col("_behind").isNotNull(), -(gb / 3.6e9))
    node = F.when(F.col("_hit").isNotNull(), F.col("_hit.node_id")).when(first, F.col("_ahead.id")).when(F.col("_behind").isNotNull(), -F.col("_behind.id"))
    return joined.withColumn("nearest_node_id", node).withColumn("overlap", F.col("_hit").isNotNull()).withColumn("signed_hours", signed).drop("_hit", "_ahead", "_behind")


def label_rows(rows: DataFrame, labels: DataFrame, width: int = HOUR_US) -> DataFrame:
    """(equipment_id, window_id, label_id, node_id, rule_slug, severity, sensors): labels and the windows of which a
    row's time lies in them, each pair once. `rows` has equipment_id, window_id and us."""
    points = rows.select("equipment_id", "window_id", F.col("us").alias("ls"), F.col("us").alias("le"))
    spans = labels.select("equipment_id", "label_id", "node_id", "rule_slug", "severity", "sensors", F.col("s").alias("rs"), F.col("e").alias("re"))
    return overlap_join(points, spans, ["equipment_id"], width).select("equipment_id", "window_id", "label_id", "node_id", "rule_slug", "severity", "sensors").dropDuplicates(["equipment_id", "window_id", "label_id"])


def window_truth(rows: DataFrame, touched: DataFrame, active: str = "n_active_nodes") -> DataFrame:
    """(equipment_id, window_id, n_active_nodes, is_anomaly, max_event_level, all_rule_slugs, all_sensors, node_ids):
    peak of active nodes, whether any, and of the touching labels the peak severity and sorted sets (empty if none)."""
    base = rows.groupBy("equipment_id", "window_id").agg(F.coalesce(F.max(active), F.lit(0)).alias("n_active_nodes"))
    sets = touched.groupBy("equipment_id", "window_id").agg(
        F.max("severity").alias("max_event_level"), F.array_sort(F.collect_set("rule_slug")).alias("_slugs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("sensors", F.array().cast("array<string>")))))).alias("_sensors"), F.array_sort(F.collect_set("node_id")).alias("_nodes")
    )
    none = F.array().cast("array<string>")
    return base.join(sets, ["equipment_id", "window_id"], "left").select(
        "equipment_id", "window_id", "n_active_nodes", (F.col("n_active_nodes") > 0).alias("is_anomaly"), "max_event_level",
        F.coalesce("_slugs", none).alias("all_rule_slugs"), F.coalesce("_sensors", none).alias("all_sensors"), F.coalesce("_nodes", F.array().cast("array<bigint>")).alias("node_ids"),
    )


def split_coverage(touched: DataFrame, split: DataFrame) -> DataFrame:
    """(split, n_full, n_partial): nodes whose windows all lie in the split, and those of which some do."""
    pairs = touched.select("equipment_id", "node_id", "window_id").distinct().join(split.select("equipment_id", "window_id", "split"), ["equipment_id", "window_id"], "left")
    each = pairs.groupBy("equipment_id", "node_id", "split").agg(F.count("*").alias("n"))
    total = each.groupBy("equipment_id", "node_id").agg(F.sum("n").alias("total"))
    whole = each.join(total, ["equipment_id", "node_id"]).where("split IS NOT NULL")
    return whole.groupBy("split").agg(F.count_if(F.col("n") == F.col("total")).alias("n_full"), F.count_if(F.col("n") < F.col("total")).alias("n_partial"))


def rule_catalog(pairs: DataFrame, slug: str = "rule_slug", sensor: str = "sensor") -> DataFrame:
    """(rule_slug, sensors): nulls dropped, distinct, sorted."""
    return pairs.where(F.col(slug).isNotNull() & F.col(sensor).isNotNull()).groupBy(F.col(slug).alias("rule_slug")).agg(F.array_sort(F.collect_set(sensor)).alias("sensors"))


def expand_sensors(rows: DataFrame, catalog: DataFrame, on: list[str], slugs: str = "all_rule_slugs", valid: list[str] | None = None) -> DataFrame:
    """(<on>, expected_sensors): union of the catalog's sensors of a row's slugs, within `valid` if given; slugs that
    the catalog doesn't hold add nothing."""
    each = rows.select(*on, F.explode_outer(slugs).alias("rule_slug")).join(catalog, "rule_slug", "left")
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sensors", F.array().cast("array<string>"))))))
    out = each.groupBy(*on).agg(union.alias("expected_sensors"))
    return out if valid is None else out.withColumn("expected_sensors", F.array_intersect("expected_sensors", F.array(*[F.lit(v) for v in valid])))


def within_band(windows: DataFrame, events: DataFrame, keys: list[str], tolerance: int, pos: str = "window_id") -> DataFrame:
    """Windows within `tolerance` of an event's window: the events' bands are spread out and met by an equi-join."""
    bands = events.select(*keys, F.explode(F.sequence(F.col(pos) - tolerance, F.col(pos) + tolerance)).alias(pos)).distinct()
    return windows.join(bands, [*keys, pos], "left_semi")


def distance_to_event(windows: DataFrame, keys: list[str], event: Column, pos: str = "window_id", block: int = 4096) -> DataFrame:
    """`windows` with event_distance: windows to the nearest event window on either side; null without any."""
    rows = windows.withColumn("_e", F.when(event, F.col(pos))).withColumn("_blk", F.expr(f"{pos} div {block}"))
    per = rows.groupBy(*keys, "_blk").agg(F.max("_e").alias("_hi"), F.min("_e").alias("_lo"))
    order = Window.partitionBy(*keys).orderBy("_blk")
    far = per.select(*keys, "_blk", F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_b"), F.min("_lo").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_a"))
    near = Window.partitionBy(*keys, "_blk").orderBy(pos)
    last = F.coalesce(F.max("_e").over(near.rowsBetween(Window.unboundedPreceding, 0)), F.col("_b"))
    first = F.coalesce(F.min("_e").over(near.rowsBetween(0, Window.unboundedFollowing)), F.col("_a"))
    return rows.join(far, [*keys, "_blk"]).withColumn("event_distance", F.least(F.col(pos) - last, first - F.col(pos))).drop("_e", "_blk", "_a", "_b")


def event_direction(rows: DataFrame, nodes: DataFrame, sensors: list[str], before_hours: float = 3.0, lag_seconds: int = 15, least: int = 30, width: int = HOUR_US) -> DataFrame:
    """(equipment_id, node_id, n_up, n_down, direction): per sensor named by the node its mean during the event less
    that of the hours before (up to `lag_seconds` before the start, at least `least` rows); the majority of sensors
    makes `spike` or `dip`, a tie `ambiguous_tie`, no sensor with data `ambiguous_no_data`."""
    points = rows.select("equipment_id", F.col("us").alias("ls"), F.col("us").alias("le"), *sensors)
    spans = nodes.select("equipment_id", "node_id", "s", "e", F.col("sensors").alias("_named"), (F.col("s") - int(before_hours * HOUR_US)).alias("rs"), F.col("e").alias("re"))
    met = overlap_join(points, spans, ["equipment_id"], width)
    during = F.col("ls") >= F.col("s")
    earlier = F.col("ls") <= F.col("s") - lag_seconds * 1_000_000
    parts = [F.struct(F.lit(s).alias("sensor"), F.avg(F.when(during, F.col(s))).alias("d"), F.avg(F.when(earlier, F.col(s))).alias("b"), F.count(F.when(earlier, F.col(s))).alias("n")).alias(f"_{s}") for s in sensors]
    each = met.groupBy("equipment_id", "node_id", "_named").agg(*parts).select("equipment_id", "node_id", "_named", F.inline(F.array(*[f"_{s}" for s in sensors]))).where(F.array_contains("_named", F.col("sensor")) & (F.col("n") >= least) & F.col("d").isNotNull())
    votes = each.groupBy("equipment_id", "node_id").agg(F.count_if(F.col("d") > F.col("b")).alias("_up"), F.count_if(F.col("d") < F.col("b")).alias("_down"))
    out = nodes.select("equipment_id", "node_id").join(votes, ["equipment_id", "node_id"], "left").select("equipment_id", "node_id", F.coalesce("_up", F.lit(0)).alias("n_up"), F.coalesce("_down", F.lit(0)).alias("n_down"), F.col("_up").isNotNull().alias("_any"))
    direction = F.when(~F.col("_any"), "ambiguous_no_data").when(F.col("n_up") > F.col("n_down"), "spike").when(F.col("n_up") < F.col("n_down"), "dip").otherwise("ambiguous_tie")
    return out.withColumn("direction", direction).drop("_any")


def rule_direction(slugs: Column, high: list[str], low: list[str]) -> Column:
    """high, low, both, unclassified_only or none by which rules are among the slugs."""
    up, down = F.arrays_overlap(slugs, F.array(*[F.lit(x) for x in high])), F.arrays_overlap(slugs, F.array(*[F.lit(x) for x in low]))
    return F.when(F.size(slugs) <= 0, "none").when(up & down, "both").when(up, "high").when(down, "low").otherwise("unclassified_only")


def aligned_rows(windows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Inner join by window key that must find every window: an error if one is missing."""
    missing = windows.join(table.select(*on), on, "left_anti").limit(1).count()
    if missing:
        raise ValueError(f"windows without a row in the other table, by {on}")
    return windows.join(table, on)
