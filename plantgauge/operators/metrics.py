"""Detection quality: confusion, ranking, correlation, attribution and event metrics. Null means not computable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import cumulative, exact_percentiles
from ..session import durable
from .alerts import persistent_alarm, runs


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r))


def pointwise(rows: DataFrame, keys: list[str], truth: Column, flagged: Column, usable: Column | None = None) -> DataFrame:
    """(<keys>, tp, fp, fn, tn, precision, recall, f1, accuracy) over usable rows."""
    rows = rows.where(F.coalesce(usable, F.lit(False))) if usable is not None else rows
    t, f = F.coalesce(truth, F.lit(False)), F.coalesce(flagged, F.lit(False))
    counts = rows.groupBy(*keys).agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & ~f).alias("tn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("*", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"))


def _by_score(rows: DataFrame, keys: list[str], score: str, truth: Column) -> DataFrame:
    """Per distinct score the positives and negatives, and their counts at or above it. Ties are one row."""
    grouped = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys, F.col(score).alias("_s")).agg(F.count_if(truth).alias("_p"), F.count_if(~truth).alias("_n"))
    s = cumulative(grouped, keys, "_s", ["_p", "_n"], descending=True)
    return s.select(*keys, "_s", "_p", "_n", F.col("_p_upto").alias("_tp"), F.col("_n_upto").alias("_fp"), F.col("_p_all").alias("_pos"), F.col("_n_all").alias("_neg"))


def average_precision(rows: DataFrame, keys: list[str], score: str, truth: Column) -> DataFrame:
    """(<keys>, average_precision): sum over distinct scores of the gain in recall times precision; null with one class."""
    s = _by_score(rows, keys, score, F.coalesce(truth, F.lit(False)))
    gain = F.sum(F.col("_p") / F.nullif(F.col("_pos"), F.lit(0)) * (F.col("_tp") / (F.col("_tp") + F.col("_fp"))))
    return s.groupBy(*keys).agg(F.when((F.max("_pos") > 0) & (F.max("_neg") > 0), gain).alias("average_precision"))


def roc_auc(rows: DataFrame, keys: list[str], score: str, truth: Column) -> DataFrame:
    """(<keys>, roc_auc): chance that a positive outscores a negative, ties half; null with one class."""
    s = _by_score(rows, keys, score, F.coalesce(truth, F.lit(False)))
    wins = F.sum(F.col("_p") * (F.col("_neg") - F.col("_fp") + F.col("_n") / 2.0))
    return s.groupBy(*keys).agg((wins / F.nullif(F.max(F.col("_pos") * F.col("_neg")), F.lit(0))).alias("roc_auc"))


def average_rank(rows: DataFrame, keys: list[str], column: str, name: str, weight: str | None = None) -> DataFrame:
    """`rows` with the 1-based rank of a column, ties sharing their mean: counted per distinct value, then joined. Rows
    stand for `weight` rows each if a column is given."""
    counts = cumulative(rows.groupBy(*keys, F.col(column).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c")), keys, "_v", ["_c"])
    ranks = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_v", (F.col("_c_upto") - (F.col("_c") - 1) / 2.0).alias(name))
    on = F.col(column) == F.col("_v")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(ranks, on).drop("_v", *[f"_k{i}" for i in range(len(keys))])


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(<keys>, n, rho): correlation of average ranks; null below two rows or without variance.

    Rows are counted per pair of values first, so ties are one row each in the joins with the ranks.
    """
    held = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double"))).groupBy(*keys, a, b).agg(F.count("*").alias("_n"))
    ranked = average_rank(average_rank(durable(held), keys, a, "_ra", "_n"), keys, b, "_rb", "_n")
    # ranks are 1 to n, so they are taken about (n + 1) / 2, their mean
    total = ranked.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).agg(F.sum("_n").alias("_all"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    x, y = (F.col(c) - (F.col("_all") + 1) / 2.0 for c in ("_ra", "_rb"))
    xy, xx, yy = (F.sum(F.col("_n") * c) for c in (x * y, x * x, y * y))
    each = ranked.join(total, on).groupBy(*keys).agg(F.sum("_n").alias("n"), xy.alias("_xy"), xx.alias("_xx"), yy.alias("_yy"))
    rho = F.when((F.col("n") >= 2) & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy")))
    return each.select(*keys, "n", rho.alias("rho"))


def score_percentiles(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(<keys>, n, p50, p90, p95, p99, p100), linear."""
    return exact_percentiles(rows, keys, score, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p100": 1.0})


def zone_shares(rows: DataFrame, keys: list[str], zone: str = "zone") -> DataFrame:
    """(<keys>, green, yellow, red, non_green, yellow_share, red_share); shares of the non-green windows."""
    counts = rows.groupBy(*keys).agg(*[F.count_if(F.col(zone) == z).alias(z) for z in ("green", "yellow", "red")]).withColumn("non_green", F.col("yellow") + F.col("red"))
    return counts.select("*", ratio(F.col("yellow"), F.col("non_green")).alias("yellow_share"), ratio(F.col("red"), F.col("non_green")).alias("red_share"))


def weekly_metrics(rows: DataFrame, keys: list[str], start: str, score: str, zone: str = "zone") -> DataFrame:
    """(<keys>, week_start, n_windows, n_days, mean, max, min, std (population), green, yellow, red, alert_rate)."""
    clean = F.when(F.isnan(score), None).otherwise(F.col(score))
    rows = rows.withColumn("week_start", F.to_date(F.date_trunc("week", start))).withColumn("_x", clean)
    return rows.groupBy(*keys, "week_start").agg(
        F.count("*").alias("n_windows"), F.countDistinct(F.to_date(start)).cast("long").alias("n_days"), *[F.coalesce(f("_x"), F.lit(0.0)).alias(n) for n, f in (("mean_score", F.avg), ("max_score", F.max), ("min_score", F.min), ("std_score", F.stddev_pop))],
        *[F.count_if(F.col(zone) == z).alias(z) for z in ("green", "yellow", "red")], F.avg(F.col(zone).isin("yellow", "red").cast("int")).alias("alert_rate"),
    )


def window_false_alarms(rows: DataFrame, keys: list[str], flagged: Column, active: Column) -> DataFrame:
    """(<keys>, n_flagged_windows, n_false_alarm_windows, window_false_alarm_rate)."""
    f, a = F.coalesce(flagged, F.lit(False)), F.coalesce(active, F.lit(False))
    out = rows.groupBy(*keys).agg(F.count_if(f).alias("n_flagged_windows"), F.count_if(f & ~a).alias("n_false_alarm_windows"))
    return out.withColumn("window_false_alarm_rate", ratio(F.col("n_false_alarm_windows"), F.col("n_flagged_windows")))


def resembling(profiles: DataFrame, signatures: DataFrame, keys: list[str], threshold: float = 0.3, sensors: str = "sensors") -> DataFrame:
    """(<keys>, resembles_slug, jaccard): per profile the signature of largest Jaccard similarity, at least the
    threshold; ties by slug. Only profiles and signatures that share a sensor meet."""
    a = profiles.select(*keys, F.array_distinct(sensors).alias("_a"))
    b = signatures.select("rule_slug", F.array_distinct("sensors").alias("_b"))
    shared = a.select(*keys, F.size("_a").alias("_na"), F.explode("_a").alias("_x")).join(b.select("rule_slug", F.size("_b").alias("_nb"), F.explode("_b").alias("_x")), "_x")
    scored = shared.groupBy(*keys, "rule_slug").agg((F.count("*") / (F.max("_na") + F.max("_nb") - F.count("*"))).alias("_j"))
    best = scored.groupBy(*keys).agg(F.min(F.struct(-F.col("_j"), F.col("rule_slug"))).alias("_m"))
    return best.select(*keys, F.col("_m.rule_slug").alias("resembles_slug"), F.round(-F.col("_m.col1"), 3).alias("jaccard"), (-F.col("_m.col1")).alias("_j")).where(F.col("_j") >= threshold).drop("_j")


def attribution(rows: DataFrame, keys: list[str], ranked: str, truth: str, concurrency: str | None = None, low: int = 1) -> DataFrame:
    """(<keys>, part, n_windows, map, rank_percentile): mean average precision of the ranked sensors and the mean
    place (0 best, 1 last) of the true ones; windows without a true sensor in the ranking are skipped.

    With a concurrency column also the parts `low` (at most `low` active nodes) and `high`.
    """
    base = rows.withColumn("_ranked", F.array_distinct(ranked)).withColumn("_hits", F.transform("_ranked", lambda s: F.coalesce(F.array_contains(truth, s), F.lit(False)))).where(F.exists("_hits", lambda h: h))
    terms = "transform(filter(sequence(0, size(_hits) - 1), i -> _hits[i]), i -> size(filter(slice(_hits, 1, i + 1), h -> h)) / (i + 1))"
    places = "transform(filter(sequence(0, size(_hits) - 1), i -> _hits[i]), i -> if(size(_hits) > 1, i / (size(_hits) - 1), 0D))"
    mean = "aggregate({0}, 0D, (a, x) -> a + x) / size({0})"
    each = base.withColumn("_ap", F.expr(mean.format(terms))).withColumn("_rp", F.expr(mean.format(places)))
    part = F.array(F.lit("overall")) if concurrency is None else F.array(F.lit("overall"), F.when(F.col(concurrency) <= low, "low").otherwise("high"))
    return each.withColumn("part", F.explode(part)).groupBy(*keys, "part").agg(F.count("*").alias("n_windows"), F.avg("_ap").alias("map"), F.avg("_rp").alias("rank_percentile"))


def event_metrics(scores: DataFrame, node_windows: DataFrame, keys: list[str], alarm: Column, tolerance: int = 1, persistence: int = 1, pos: str = "pos", hours_per_window: float = 0.5) -> DataFrame:
    """(<keys>, n_windows, n_alarm_windows, n_nodes, nodes_detected, event_recall, window_precision, composite_f1,
    n_alarm_episodes, tp_episodes, episode_precision, false_alarms_per_day).

    `node_windows` is (<keys>, node_id, <pos>). A node is evaluable if a window within the tolerance of one of its
    windows is scored, and detected if one of those alarms. An episode is true if one of its windows is near an event.
    """
    alarmed = persistent_alarm(scores, keys, alarm, persistence, pos)
    bands = node_windows.select(*keys, "node_id", F.explode(F.sequence(F.col(pos) - tolerance, F.col(pos) + tolerance)).alias(pos)).distinct()
    near = bands.select(*keys, pos).distinct().withColumn("_near", F.lit(True))
    marked = alarmed.join(near, [*keys, pos], "left").withColumn("_near", F.coalesce("_near", F.lit(False)))
    nodes = bands.join(alarmed.select(*keys, pos, "alarm"), [*keys, pos]).groupBy(*keys, "node_id").agg(F.max("alarm").alias("_hit"))
    per_node = nodes.groupBy(*keys).agg(F.count("*").alias("_nodes"), F.count_if("_hit").alias("_det"))
    eps = runs(marked, keys, F.col("alarm"), pos, {"_tp": ("cast(_near as int)", "max")}).groupBy(*keys).agg(F.count("*").alias("_eps"), F.sum("_tp").alias("_tpe"))
    win = marked.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.count_if("alarm").alias("n_alarm_windows"), F.count_if(F.col("alarm") & F.col("_near")).alias("_tpw"))
    j = win.join(per_node, keys, "left").join(eps, keys, "left").fillna(0, ["_nodes", "_det", "_eps", "_tpe"])
    recall, precision = ratio(F.col("_det"), F.col("_nodes")), ratio(F.col("_tpw"), F.col("n_alarm_windows"))
    return j.select(
        *keys, "n_windows", "n_alarm_windows", F.col("_nodes").alias("n_nodes"), F.col("_det").alias("nodes_detected"), recall.alias("event_recall"), precision.alias("window_precision"), F.coalesce(f1(precision, recall), F.lit(0.0)).alias("composite_f1"),
        F.col("_eps").alias("n_alarm_episodes"), F.col("_tpe").alias("tp_episodes"), ratio(F.col("_tpe"), F.col("_eps")).alias("episode_precision"), ((F.col("_eps") - F.col("_tpe")) / (F.col("n_windows") * hours_per_window / 24)).alias("false_alarms_per_day"),
    )


def slug_rows(truth: DataFrame, keys: list[str], slugs: str, flagged: Column, any_active: Column) -> DataFrame:
    """(<keys>, rule_slug, n_windows, n_flagged, recall), a row per slug and `any_slug` by its own flag."""
    f = F.coalesce(flagged, F.lit(False))
    base = truth.withColumn("_f", f)
    each = base.select(*keys, "_f", F.explode(F.array_distinct(slugs)).alias("rule_slug"))
    total = base.where(F.coalesce(any_active, F.lit(False))).select(*keys, "_f", F.lit("any_slug").alias("rule_slug"))
    out = each.unionByName(total).groupBy(*keys, "rule_slug").agg(F.count("*").alias("n_windows"), F.count_if("_f").alias("n_flagged"))
    return out.withColumn("recall", ratio(F.col("n_flagged"), F.col("n_windows")))


def histogram(rows: DataFrame, keys: list[str], value: Column, low: float, width: float, bins: int) -> DataFrame:
    """(<keys>, bin, n): fixed bins, the last one closed; values outside are left out."""
    top = low + width * bins
    place = F.least(F.floor((value - low) / width), F.lit(bins - 1))
    return rows.where((value >= low) & (value <= top)).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
