"""Queries over windows, scores, alerts, labelled events and drift, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hours_between, jaccard, json_number, month_label
from ..operators import alerts, columns, limits, metrics, monitor, scaling, scoring, splits, truth, windows
from ..session import micros, table
from .base import ALERTED, EQ, LABELS, ROWS, SCALED, SCORED, SENSORS, SERIES, labels, rounded, scored, window_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scaled_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = window_rows(spark, d)
    return scaling.apply_scaling(rows, scaling.fit_robust(rows, SENSORS), SENSORS, 20.0)


def alerted(spark: SparkSession, d: str) -> DataFrame:
    return alerts.alert_timeline(scored(spark, d), SERIES, mixed_hours=3.0)


# --- columns -------------------------------------------------------------------------------------------------------


@query(
    "SELECT sensor, count(*) FILTER (NOT isfinite(v)) AS n_non_finite, count(*) FILTER (v IS NULL) AS n_null FROM (SELECT sensor, v FROM combined UNPIVOT INCLUDE NULLS (v FOR sensor IN ("
    + ", ".join(SENSORS)
    + "))) GROUP BY sensor"
)
def non_finite_counts(spark: SparkSession, d: str) -> DataFrame:
    return columns.non_finite_counts(table(spark, d, "combined"), SENSORS)


@query(ROWS + "SELECT equipment_id, sensor, round(var_samp(value), 6) AS variance, coalesce(var_samp(value) <= 1e-5, false) AS dropped FROM long GROUP BY ALL")
def low_variance_columns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(columns.low_variance(window_rows(spark, d), SENSORS))


@query(
    ROWS
    + """, each AS (SELECT equipment_id, sensor, window_id, CASE WHEN count(*) > count(value) THEN 1 ELSE 0 END AS n, CASE WHEN coalesce(max(value) - min(value), 0) <= 1e-9 THEN 1 ELSE 0 END AS s FROM long GROUP BY ALL)
SELECT equipment_id, sensor, count(*) AS n_windows, round(avg(n) * 100, 6) AS null_pct, round(avg(s) * 100, 6) AS stuck_pct, avg(n) * 100 <= 50 AND avg(s) * 100 <= 100 AS kept FROM each GROUP BY ALL"""
)
def null_stuck_pct(spark: SparkSession, d: str) -> DataFrame:
    return rounded(columns.null_or_stuck(window_rows(spark, d), SENSORS))


@query("SELECT DISTINCT equipment_tag AS equipment_id, unnest(sensors) AS sensor FROM event_labels WHERE sensors IS NOT NULL")
def event_sensor_columns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "event_labels")
    return e.select(F.col("equipment_tag").alias(EQ), F.explode("sensors").alias("sensor")).distinct()


@query(ROWS + "SELECT equipment_id, sensor, round(avg(CASE WHEN value IS NULL THEN 100.0 ELSE 0 END), 6) AS null_pct, avg(CASE WHEN value IS NULL THEN 100.0 ELSE 0 END) > 5 AS dropped FROM long GROUP BY ALL")
def sparse_columns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(columns.sparse_columns(window_rows(spark, d), SENSORS, 5.0))


@query("SELECT DISTINCT sensor, upper(sensor) LIKE '%_03%' OR upper(sensor) LIKE 'SENSOR_00%' OR upper(sensor) LIKE '%9' AS matches FROM filter_results")
def tag_policies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filter_results").select("sensor").distinct().withColumn("matches", columns.tag_is(F.col("sensor"), ("_03",), ("sensor_00",), ("9",)))


# --- windows -------------------------------------------------------------------------------------------------------


@query(ROWS + "SELECT equipment_id, window_id, min(timestamp) AS start_time, max(timestamp) AS end_time, min(row_pos) AS start_idx, max(row_pos) + 1 AS end_idx FROM win GROUP BY ALL")
def window_metadata(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_metadata(window_rows(spark, d))


@query(ROWS + "SELECT equipment_id, window_id, " + ", ".join(f"round(avg({s}), 6) AS {s}" for s in SENSORS) + " FROM win GROUP BY ALL")
def window_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.window_means(window_rows(spark, d), SENSORS))


@query(ROWS + ", each AS (SELECT equipment_id, window_id, sensor, max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS h FROM long GROUP BY ALL) SELECT equipment_id, window_id, round(sum(h) * 100.0 / 10, 6) AS dropout_pct, sum(h) * 100.0 / 10 > 5 AS dropped FROM each GROUP BY ALL")
def sensor_dropout(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.sensor_dropout(window_rows(spark, d), SENSORS))


@query(ROWS + "SELECT equipment_id, window_id, round(max(sensor_00) - min(sensor_00), 6) AS speed_span, coalesce(max(sensor_00) - min(sensor_00) > 0.15 * 60, false) AS transient FROM win GROUP BY ALL")
def transient_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.transient_windows(window_rows(spark, d), "sensor_00", 60.0))


@query(
    ROWS
    + "SELECT equipment_id, window_id, round(avg(CASE WHEN sensor_00 > 60 THEN 100.0 WHEN sensor_00 IS NOT NULL THEN 0 END), 6) AS running_pct, coalesce(avg(CASE WHEN sensor_00 > 60 THEN 100.0 WHEN sensor_00 IS NOT NULL THEN 0 END) >= 50, false) AS running FROM win GROUP BY ALL"
)
def running_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.running_windows(window_rows(spark, d), "sensor_00", 60.0))


@query(ROWS + ", med AS (SELECT equipment_id, median(sensor_01) AS m FROM win GROUP BY ALL) SELECT equipment_id, window_id, bool_and(coalesce(sensor_01 > 0.9 * m, false)) AS fully_running FROM win JOIN med USING (equipment_id) GROUP BY ALL")
def running_mask(spark: SparkSession, d: str) -> DataFrame:
    return windows.running_mask(window_rows(spark, d), "sensor_01", 0.9)


@query(ROWS + "SELECT equipment_id, window_id, coalesce(max(n_active_nodes) > 0, false) AS touched FROM win GROUP BY ALL")
def event_touched(spark: SparkSession, d: str) -> DataFrame:
    return windows.event_touched(window_rows(spark, d))


@query(
    ROWS
    + """, f AS (SELECT equipment_id, window_id, sensor, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY equipment_id, window_id, sensor ORDER BY row_in_window ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS v, value FROM long)
SELECT equipment_id, window_id, sensor, count(value) AS n_before, count(v) AS n_after, round(sum(v), 4) AS total FROM f GROUP BY ALL"""
)
def bounded_ffill(spark: SparkSession, d: str) -> DataFrame:
    rows = window_rows(spark, d)
    filled = windows.bounded_fill(rows.withColumns({f"raw_{s}": F.col(s) for s in SENSORS}), SENSORS)
    parts = [F.struct(F.lit(s).alias("sensor"), F.count(f"raw_{s}").alias("n_before"), F.count(s).alias("n_after"), F.sum(s).alias("total")).alias(f"_{s}") for s in SENSORS]
    return rounded(filled.groupBy(EQ, "window_id").agg(*parts).select(EQ, "window_id", F.inline(F.array(*[f"_{s}" for s in SENSORS]))), 4)


@query(
    ROWS
    + """, f AS (SELECT equipment_id, sensor, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY equipment_id, sensor ORDER BY row_pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS v FROM long)
SELECT equipment_id, sensor, count(v) AS n_after, round(sum(v), 4) AS total FROM f GROUP BY ALL"""
)
def global_ffill(spark: SparkSession, d: str) -> DataFrame:
    filled = windows.bounded_fill(window_rows(spark, d), SENSORS, across=True)
    parts = [F.struct(F.lit(s).alias("sensor"), F.count(s).alias("n_after"), F.sum(s).alias("total")).alias(f"_{s}") for s in SENSORS]
    return rounded(filled.groupBy(EQ).agg(*parts).select(EQ, F.inline(F.array(*[f"_{s}" for s in SENSORS]))), 4)


@query(
    ROWS
    + """, f AS (SELECT equipment_id, sensor, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY equipment_id, sensor ORDER BY row_pos), first_value(value IGNORE NULLS) OVER (PARTITION BY equipment_id, sensor ORDER BY row_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM long)
SELECT equipment_id, sensor, count(v) AS n_after, round(sum(v), 4) AS total FROM f GROUP BY ALL"""
)
def fill_both_ways(spark: SparkSession, d: str) -> DataFrame:
    filled = windows.fill_both_ways(window_rows(spark, d), SENSORS)
    parts = [F.struct(F.lit(s).alias("sensor"), F.count(s).alias("n_after"), F.sum(s).alias("total")).alias(f"_{s}") for s in SENSORS]
    return rounded(filled.groupBy(EQ).agg(*parts).select(EQ, F.inline(F.array(*[f"_{s}" for s in SENSORS]))), 4)


_QUALITY = (
    ROWS
    + """, f AS (SELECT equipment_id, window_id, sensor, value, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY equipment_id, window_id, sensor ORDER BY row_in_window ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS v FROM long),
each AS (SELECT equipment_id, window_id, sensor, count(*) - count(value) AS n, (count(*) - count(value)) * 100.0 / count(*) > 5 OR count(*) > count(v) AS masked FROM f GROUP BY ALL),
quality AS (SELECT equipment_id, window_id, count(*) FILTER (masked) * 100.0 / 10 <= 30 AS usable, CAST(sum(n) AS BIGINT) AS n_nulls, CAST(count(*) FILTER (masked) AS INTEGER) AS n_masked, coalesce(string_agg(sensor, ',' ORDER BY sensor) FILTER (masked), '') AS masked_sensors FROM each GROUP BY ALL)
"""
)


@query(_QUALITY + "SELECT * FROM quality")
def window_quality(spark: SparkSession, d: str) -> DataFrame:
    return windows.window_quality(window_rows(spark, d), SENSORS)


@query(
    _QUALITY
    + "SELECT l.equipment_id, l.window_id, round(sum(CASE WHEN list_contains(string_split(q.masked_sensors, ','), l.sensor) THEN 0 ELSE value END), 4) AS total FROM long l LEFT JOIN quality q USING (equipment_id, window_id) GROUP BY ALL"
)
def masked_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = window_rows(spark, d)
    masked = windows.mask_to_zero(windows.long_form(rows, SENSORS), windows.window_quality(rows, SENSORS))
    return rounded(masked.groupBy(EQ, "window_id").agg(F.sum("value").alias("total")), 4)


@query(
    ROWS
    + """, dif AS (SELECT *, value - lag(value) OVER (PARTITION BY equipment_id, window_id, sensor ORDER BY row_in_window) AS dx FROM long),
each AS (SELECT equipment_id, window_id, sensor, stddev_pop(dx) AS v, avg(abs(value)) AS m, avg(dx) AS t, avg(value) AS l FROM dif GROUP BY ALL)
SELECT equipment_id, window_id, round(avg(v), 6) AS volatility, round(avg(m), 6) AS magnitude, round(avg(t), 6) AS drift, round(avg(l), 6) AS level FROM each GROUP BY ALL"""
)
def window_volatility(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.window_volatility(window_rows(spark, d), SENSORS))


@query(ROWS + "SELECT equipment_id, window_id, sensor, round(CASE WHEN count(value) >= 2 THEN avg(value) FILTER (row_in_window >= 80) - avg(value) FILTER (row_in_window < 40) END, 6) AS trend FROM long GROUP BY ALL")
def window_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.window_trend(window_rows(spark, d), SENSORS))


@query(
    ROWS
    + """, own AS (SELECT equipment_id, window_id, sensor, avg(value) AS m FROM long GROUP BY ALL),
back AS (SELECT o.equipment_id, o.window_id, o.sensor, avg(l.value) AS b FROM own o JOIN long l ON l.equipment_id = o.equipment_id AND l.sensor = o.sensor AND l.row_pos < o.window_id * 120 AND l.row_pos >= o.window_id * 120 - 180 GROUP BY ALL)
SELECT equipment_id, window_id, sensor, round(m - b, 6) AS change FROM own LEFT JOIN back USING (equipment_id, window_id, sensor)"""
)
def lookback_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.lookback_change(window_rows(spark, d), SENSORS, 180))


# --- scaling and scores --------------------------------------------------------------------------------------------


@query(SCALED + "SELECT equipment_id, sensor, round(center, 6) AS center, round(scale, 6) AS scale FROM scaler")
def robust_scaler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scaling.fit_robust(window_rows(spark, d), SENSORS))


@query(SCALED + "SELECT equipment_id, window_id, sensor, round(avg(x), 6) AS mean_scaled, round(max(abs(x)), 6) AS max_scaled FROM z GROUP BY ALL")
def scaled_compressed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(windows.per_sensor(scaled_rows(spark, d), SENSORS, ("mean_scaled", "avg({x})"), ("max_scaled", "max(abs({x}))")))


@query(
    ROWS
    + """, q AS (SELECT equipment_id, sensor, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.99) AS p99 FROM long GROUP BY ALL),
w AS (SELECT equipment_id, sensor, any_value(p50) AS center, any_value(p75 - p25) AS iqr, stddev_pop(least(greatest(coalesce(value, p50), p1), p99)) AS sd FROM long JOIN q USING (equipment_id, sensor) GROUP BY ALL)
SELECT equipment_id, sensor, round(center, 6) AS center, round(CASE WHEN greatest(iqr, sd) > 0 THEN greatest(iqr, sd) ELSE 1 END, 6) AS scale FROM w"""
)
def winsorised_scaler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scaling.fit_winsorised(window_rows(spark, d), SENSORS))


def _level(spark: SparkSession, d: str) -> DataFrame:
    return scoring.window_scores(scoring.row_error(scaled_rows(spark, d), SENSORS))


@query(SCALED + "SELECT equipment_id, window_id, round(score, 6) AS score FROM score")
def window_scores_level(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_level(spark, d))


@query(SCALED + "SELECT equipment_id, count(error) AS n_cells, round(avg(error), 6) AS mse FROM err GROUP BY ALL")
def total_error(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.total_error(scoring.sensor_errors(scaled_rows(spark, d), SENSORS)))


@query(
    SCALED
    + """, e9 AS (SELECT equipment_id, window_id, sensor, round(coalesce(error, 0), 9) AS error FROM err),
r AS (SELECT *, row_number() OVER (PARTITION BY equipment_id, window_id ORDER BY error DESC, sensor) AS rank, sum(error) OVER (PARTITION BY equipment_id, window_id) AS total FROM e9)
SELECT equipment_id, window_id, sensor, CAST(rank AS INTEGER) AS rank, round(error / total * 100, 6) AS pct FROM r WHERE total > 0 AND rank <= 2"""
)
def sensor_contributions(spark: SparkSession, d: str) -> DataFrame:
    errors = scoring.sensor_errors(scaled_rows(spark, d), SENSORS)
    return rounded(scoring.contributions(errors.withColumn("error", F.round("error", 9))))


@query(
    SCALED
    + """, base AS (SELECT equipment_id, sensor, avg(error) AS b FROM err GROUP BY ALL),
r AS (SELECT equipment_id, window_id, sensor, coalesce(error, 0) / CASE WHEN b > 0 THEN b ELSE 1e-10 END AS q FROM err LEFT JOIN base USING (equipment_id, sensor))
SELECT equipment_id, window_id, count(*) AS n_sensors, count(*) FILTER (q > 3) AS n_flagged, round(count(*) FILTER (q > 3) * 100.0 / count(*), 6) AS flagged_pct, count(*) FILTER (q > 3) * 100.0 / count(*) > 10 AS is_anomaly,
  last(sensor ORDER BY q, sensor) AS worst_sensor, round(max(q), 6) AS worst_ratio FROM r GROUP BY ALL"""
)
def error_ratio_flags(spark: SparkSession, d: str) -> DataFrame:
    errors = scoring.sensor_errors(scaled_rows(spark, d), SENSORS)
    return rounded(scoring.diagnosis(errors, scoring.baselines(errors)))


@query(
    SCALED
    + """, best AS (SELECT equipment_id, window_id, row_in_window, first(sensor ORDER BY abs(x) DESC NULLS LAST, sensor) AS sensor FROM z WHERE x IS NOT NULL GROUP BY ALL),
c AS (SELECT equipment_id, window_id, sensor, count(*) AS n_rows FROM best GROUP BY ALL)
SELECT equipment_id, window_id, sensor, n_rows FROM c QUALIFY row_number() OVER (PARTITION BY equipment_id, window_id ORDER BY n_rows DESC, sensor) = 1"""
)
def top_sensor_mode(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_sensor_mode(scaled_rows(spark, d), SENSORS)


@query(
    SCALED
    + """, e AS (SELECT equipment_id, window_id, sensor, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * sign(x)) AS s3, count(x) AS n FROM z GROUP BY ALL)
SELECT equipment_id, window_id, round(sum(s1) / nullif(sum(n), 0), 6) AS mean_residual, round(sum(s3) / nullif(sum(s2), 0), 6) AS weighted_sign,
  CASE WHEN count(*) FILTER (s1 > 0) * 2 > count(*) THEN 'positive' WHEN count(*) FILTER (s1 < 0) * 2 > count(*) THEN 'negative' ELSE 'mixed' END AS majority FROM e GROUP BY ALL"""
)
def signed_residuals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.signed_residuals(scaled_rows(spark, d), SENSORS))


@query(SCALED + ", r AS (SELECT equipment_id, window_id, row_in_window, avg((1 + 0.5 * sign(x)) * x * x) AS e FROM z GROUP BY ALL) SELECT equipment_id, window_id, round(quantile_cont(e, 0.95), 6) AS score FROM r GROUP BY ALL")
def directional_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scoring.directional_scores(scaled_rows(spark, d), SENSORS, 0.5))


# --- limits and alerts ---------------------------------------------------------------------------------------------


@query(SCORED + "SELECT equipment_id, count(x) AS n, round(quantile_cont(x, 0.9), 6) AS green_yellow, round(quantile_cont(x, 0.99), 6) AS yellow_red, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT equipment_id, ln(1 + score) AS x FROM s) GROUP BY ALL")
def limits_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(limits.percentile_limits(scored(spark, d).withColumn("x", F.log1p("score")), [EQ], "x"))


_LOGS = SCORED + ", l AS (SELECT equipment_id, ln(greatest(score, 2.2250738585072014e-308)) AS x FROM s WHERE score IS NOT NULL), q AS (SELECT equipment_id, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY ALL)"


@query(_LOGS + ", m AS (SELECT equipment_id, any_value(n) AS n, any_value(q2) AS q2, quantile_cont(abs(x - q2), 0.5) AS mad FROM l JOIN q USING (equipment_id) GROUP BY ALL) SELECT equipment_id, n, round(exp(q2 + 1.2815515655446008 * 1.4826 * mad), 6) AS green_yellow, round(exp(q2 + 2.3263478740408408 * 1.4826 * mad), 6) AS yellow_red FROM m")
def limits_robust_mad(spark: SparkSession, d: str) -> DataFrame:
    return rounded(limits.robust_limits(scored(spark, d), [EQ]))


@query(_LOGS + " SELECT equipment_id, n, round(exp(q3 + (1.2815515655446008 - 0.6745) / 1.349 * (q3 - q1)), 6) AS green_yellow, round(exp(q3 + (2.3263478740408408 - 0.6745) / 1.349 * (q3 - q1)), 6) AS yellow_red FROM q")
def limits_robust_iqr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(limits.robust_limits(scored(spark, d), [EQ], spread="iqr"))


@query()
def limits_tail_fit(spark: SparkSession, d: str) -> DataFrame:
    return limits.tail_limits(scored(spark, d), [EQ])


@query(
    SCORED
    + """, g AS (SELECT equipment_id, quantile_cont(score, 0.6) AS a, quantile_cont(score, 0.85) AS b FROM s GROUP BY ALL)
SELECT equipment_id, count(*) FILTER (score < a OR score IS NULL) AS green, count(*) FILTER (score >= a AND score < b) AS yellow, count(*) FILTER (score >= b) AS red, count(*) FILTER (score >= a) AS non_green,
  round(count(*) FILTER (score >= a AND score < b) / nullif(count(*) FILTER (score >= a), 0), 6) AS yellow_share, round(count(*) FILTER (score >= b) / nullif(count(*) FILTER (score >= a), 0), 6) AS red_share FROM s JOIN g USING (equipment_id) GROUP BY ALL"""
)
def zones(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    lim = limits.percentile_limits(s, [EQ], low=60.0, high=85.0)
    named = s.join(lim.select(EQ, "green_yellow", "yellow_red"), EQ).withColumn("zone", alerts.zone(F.col("score"), F.col("green_yellow"), F.col("yellow_red")))
    return rounded(metrics.zone_shares(named, [EQ]))


@query(
    _LOGS
    + """, m AS (SELECT equipment_id, any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3, quantile_cont(abs(x - q2), 0.5) AS mad FROM l JOIN q USING (equipment_id) GROUP BY ALL),
p90 AS (SELECT equipment_id, quantile_cont(score, 0.9) AS a, quantile_cont(score, 0.99) AS b FROM s GROUP BY ALL),
lim AS (SELECT equipment_id, 'percentile' AS method, a, b FROM p90 UNION ALL SELECT equipment_id, 'robust_mad', exp(q2 + 1.2815515655446008 * 1.4826 * mad), exp(q2 + 2.3263478740408408 * 1.4826 * mad) FROM m
  UNION ALL SELECT equipment_id, 'robust_iqr', exp(q3 + (1.2815515655446008 - 0.6745) / 1.349 * (q3 - q1)), exp(q3 + (2.3263478740408408 - 0.6745) / 1.349 * (q3 - q1)) FROM m)
SELECT equipment_id, method, count(*) FILTER (score < a OR score IS NULL) AS green, count(*) FILTER (score >= a AND score < b) AS yellow, count(*) FILTER (score >= b) AS red FROM s JOIN lim USING (equipment_id) GROUP BY ALL"""
)
def limit_comparison(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    methods = {"percentile": limits.percentile_limits(s, [EQ]), "robust_mad": limits.robust_limits(s, [EQ]), "robust_iqr": limits.robust_limits(s, [EQ], spread="iqr")}
    lim = None
    for name, one in methods.items():
        one = one.select(EQ, F.lit(name).alias("method"), "green_yellow", "yellow_red")
        lim = one if lim is None else lim.unionByName(one)
    named = s.join(lim, EQ).withColumn("zone", alerts.zone(F.col("score"), F.col("green_yellow"), F.col("yellow_red")))
    return metrics.zone_shares(named, [EQ, "method"]).select(EQ, "method", "green", "yellow", "red")


@query(
    SCORED
    + """, pr AS (SELECT equipment_id, avg(CASE WHEN zone = 'red' THEN 1.0 ELSE 0 END) AS p FROM s GROUP BY ALL),
w AS (SELECT equipment_id, least(greatest(100 * (1 - p), 50), 99.9) AS red, p FROM pr),
v AS (SELECT equipment_id, least(greatest(100 * (1 - 3 * p), 50), red - 0.1) AS yellow, red FROM w),
k AS (SELECT equipment_id, least(score, 1e6) AS x, row_number() OVER (PARTITION BY equipment_id ORDER BY score) - 1 AS r, count(*) OVER (PARTITION BY equipment_id) AS n FROM s WHERE score IS NOT NULL)
SELECT equipment_id, round(yellow, 6) AS yellow_pct, round(red, 6) AS red_pct, round(sum(CASE WHEN abs(r - yellow / 100 * (n - 1)) < 1 THEN x * (1 - abs(r - yellow / 100 * (n - 1))) ELSE 0 END), 4) AS green_yellow,
  round(sum(CASE WHEN abs(r - red / 100 * (n - 1)) < 1 THEN x * (1 - abs(r - red / 100 * (n - 1))) ELSE 0 END), 4) AS yellow_red FROM k JOIN v USING (equipment_id) GROUP BY equipment_id, yellow, red"""
)
def prevalence_limits(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("score", F.when(F.col("score").isNotNull(), F.least("score", F.lit(1e6))))
    share = s.groupBy(EQ).agg(F.avg((F.col("zone") == "red").cast("int")).alias("prevalence"))
    out = limits.prevalence_limits(s, [EQ], share)
    return out.select(EQ, F.round("yellow_pct", 6).alias("yellow_pct"), F.round("red_pct", 6).alias("red_pct"), F.round("green_yellow", 4).alias("green_yellow"), F.round("yellow_red", 4).alias("yellow_red"))


_RATIOS = SCALED + """, base AS (SELECT equipment_id, sensor, avg(error) AS b FROM err GROUP BY ALL),
rat AS (SELECT equipment_id, window_id, sensor, coalesce(error, 0) / CASE WHEN b > 0 THEN b ELSE 1e-10 END AS q FROM err LEFT JOIN base USING (equipment_id, sensor)),
grid AS (SELECT 0.2::DOUBLE + unnest(range(50)) * 0.2::DOUBLE AS threshold),
hit AS (SELECT equipment_id, window_id, threshold, count(*) FILTER (q > threshold) > 1.0 AS h FROM rat, grid GROUP BY ALL)
"""


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    errors = scoring.sensor_errors(scaled_rows(spark, d), SENSORS)
    base = scoring.baselines(errors)
    return errors.join(base, [EQ, "sensor"]).select(EQ, "window_id", "sensor", (F.coalesce("error", F.lit(0.0)) / F.when(F.col("baseline") > 0, F.col("baseline")).otherwise(1e-10)).alias("ratio"))


@query(_RATIOS + "SELECT equipment_id, round(threshold, 6) AS threshold, round(count(*) FILTER (h) * 100.0 / count(*), 6) AS anomaly_pct FROM hit GROUP BY equipment_id, threshold")
def elbow_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(limits.anomaly_curve(_ratios(spark, d), [EQ], 0.2, 10.0, 0.2))


@query()
def elbow_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(limits.elbow(limits.anomaly_curve(_ratios(spark, d), [EQ], 0.2, 10.0, 0.2), [EQ]))


@query(ALERTED + "SELECT equipment_id, run_no, window_id, pos, zone, alert_level FROM alert")
def alert_timeline(spark: SparkSession, d: str) -> DataFrame:
    return alerted(spark, d).select(*SERIES, "window_id", "pos", "zone", "alert_level")


@query(ALERTED + "SELECT equipment_id, run_no, start_window_idx, end_window_idx, start_time, end_time, peak_level, n_windows FROM episode")
def alert_episodes(spark: SparkSession, d: str) -> DataFrame:
    return alerts.episodes(alerted(spark, d), SERIES)


@query(
    ALERTED
    + """SELECT equipment_id, run_no, last(alert_level ORDER BY pos) AS alert_level, last(cr ORDER BY pos) AS consecutive_red, last(cy ORDER BY pos) AS consecutive_yellow, count(*) AS n_windows,
  CASE WHEN last(cr ORDER BY pos) > 0 THEN last(cr ORDER BY pos) || ' red in a row' WHEN last(cy ORDER BY pos) > 0 THEN last(cy ORDER BY pos) || ' yellow in a row' ELSE 'last window green' END AS reason FROM alert GROUP BY ALL"""
)
def latest_alert(spark: SparkSession, d: str) -> DataFrame:
    return alerts.latest_alert(scored(spark, d), SERIES, mixed_hours=3.0)


@query(ALERTED + ", r AS (SELECT *, coalesce(lag(alert_level) OVER (PARTITION BY equipment_id, run_no ORDER BY pos), '') AS before FROM alert) SELECT equipment_id, run_no, count(*) AS n_runs FROM r WHERE alert_level = 'red' AND before <> 'red' GROUP BY ALL")
def level_runs(spark: SparkSession, d: str) -> DataFrame:
    return alerts.level_runs(alerted(spark, d), SERIES)


@query(
    ALERTED
    + """, h AS (SELECT equipment_id, run_no, (epoch_us(end_time) - epoch_us(start_time)) / 3.6e9 AS h FROM episode),
act AS (SELECT equipment_id, run_no, count(*) AS n_active FROM alert WHERE alert_level <> 'green' GROUP BY ALL)
SELECT equipment_id, run_no, count(*) AS n_episodes, any_value(n_active) AS n_active, round(min(h), 6) AS min_h, round(list_sort(list(h))[count(*) // 2 + 1], 6) AS median_h, round(max(h), 6) AS max_h FROM h JOIN act USING (equipment_id, run_no) GROUP BY ALL"""
)
def episode_stats(spark: SparkSession, d: str) -> DataFrame:
    timed = alerted(spark, d)
    active = timed.where("alert_level <> 'green'").groupBy(*SERIES).agg(F.count("*").alias("n_active"))
    return rounded(alerts.episode_stats(alerts.episodes(timed, SERIES), active, SERIES))


@query(
    SCORED
    + """, a AS (SELECT *, min(CASE WHEN score > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY equipment_id, run_no ORDER BY pos ROWS 1 PRECEDING) = 1 AND pos >= 1 AS alarm FROM p),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY equipment_id, run_no ORDER BY pos) AS g FROM a WHERE alarm)
SELECT equipment_id, run_no, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n FROM i GROUP BY equipment_id, run_no, g"""
)
def alarm_islands(spark: SparkSession, d: str) -> DataFrame:
    alarmed = alerts.persistent_alarm(scored(spark, d), SERIES, F.col("score") > 1.5, 2)
    return alerts.runs(alarmed, SERIES, F.col("alarm"))


@query(
    SCORED
    + """, e AS (SELECT *, max(CASE WHEN zone = 'red' THEN 1 ELSE 0 END) OVER (PARTITION BY equipment_id, run_no ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) = 1 AS near_event,
  coalesce(usable, false) AND (coalesce(max(CASE WHEN coalesce(usable, false) THEN 0 ELSE 1 END) OVER (PARTITION BY equipment_id, run_no ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 1) = 1 OR pos < 4) AS starting FROM p)
SELECT equipment_id, run_no, count(*) FILTER (near_event) AS n_near, count(*) FILTER (starting) AS n_starting FROM e GROUP BY ALL"""
)
def near_event_windows(spark: SparkSession, d: str) -> DataFrame:
    near = alerts.near_events(scored(spark, d), SERIES, F.col("zone") == "red", 4)
    marked = alerts.startup_margin(near, SERIES, F.col("usable"), 4)
    return marked.groupBy(*SERIES).agg(F.count_if("near_event").alias("n_near"), F.count_if("starting").alias("n_starting"))


@query(
    SCORED
    + """, l AS (SELECT equipment_id, run_no, list(ln(1 + score) ORDER BY pos) AS xs FROM p GROUP BY ALL)
SELECT equipment_id, run_no, round(list_reduce(list_filter(xs, lambda x: x IS NOT NULL), lambda a, x: 0.2 * x + 0.8 * a), 6) AS last_ewma FROM l WHERE len(list_filter(xs, lambda x: x IS NOT NULL)) > 0"""
)
def ewma_scores(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("score", F.log1p("score"))
    smooth = alerts.smoothed(s, SERIES, block=64)
    return rounded(smooth.groupBy(*SERIES).agg(F.max_by("ewma", "pos").alias("last_ewma")).where("last_ewma IS NOT NULL"))


# --- splits --------------------------------------------------------------------------------------------------------


@query(
    SCORED
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY equipment_id, labels ORDER BY window_start, window_id) - 1 AS i, count(*) OVER (PARTITION BY equipment_id, labels) AS n FROM s)
SELECT window_id, CASE WHEN i < floor(n * 0.85::DOUBLE) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_split(scored(spark, d), [EQ, "labels"], ["window_start", "window_id"]).select("window_id", "split")


_SPLIT = ROWS + """, w AS (SELECT equipment_id, window_id, coalesce(max(n_active_nodes) > 0, false) AS touched FROM win GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY window_id) - 1 AS i, count(*) OVER (PARTITION BY equipment_id) AS n FROM w),
sp AS (SELECT equipment_id, window_id, touched, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM i)
"""


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    touched = windows.event_touched(window_rows(spark, d))
    return splits.stratified_split(touched.select(EQ, "window_id"), [EQ], ["window_id"], 0.7, 0.15), touched


@query(_SPLIT + "SELECT equipment_id, window_id, split FROM sp WHERE NOT touched OR split = 'test'")
def untouched_split(spark: SparkSession, d: str) -> DataFrame:
    split, touched = _split(spark, d)
    return splits.drop_touched(split, touched, [EQ, "window_id"])


@query(
    ROWS
    + """, w AS (SELECT DISTINCT equipment_id, window_id FROM win),
b AS (SELECT *, ntile(3) OVER (PARTITION BY equipment_id ORDER BY window_id) - 1 AS block, row_number() OVER (PARTITION BY equipment_id ORDER BY window_id) - 1 AS p FROM w),
f AS (SELECT equipment_id, block AS fold, min(p) AS lo, max(p) AS hi FROM b GROUP BY ALL)
SELECT equipment_id, window_id, CAST(fold AS INTEGER) AS fold, CASE WHEN block = fold THEN 'test' WHEN p BETWEEN lo - 1 AND hi + 1 THEN 'gap' ELSE 'pool' END AS role FROM b JOIN f USING (equipment_id)"""
)
def blocked_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.blocked_folds(window_rows(spark, d).select(EQ, "window_id").distinct(), [EQ], "window_id", 3, 1)


@query(
    """WITH m AS (SELECT o_orderkey, o_custkey % 3 AS grp, strftime(o_orderdate, '%Y-%m') AS period, o_orderdate FROM orders),
n AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY period) - 1 AS i FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY grp, i ORDER BY o_orderkey DESC) AS back FROM n),
f AS (SELECT DISTINCT grp, i AS t, period AS test_period FROM b WHERE i >= 2),
r AS (SELECT b.grp, test_period, CASE WHEN i = t THEN 'test' WHEN i = t - 1 AND back > 2 THEN 'val' WHEN i <= t - 2 AND i >= greatest(0, t - 1 - 6) THEN 'train' END AS role FROM b JOIN f ON b.grp = f.grp)
SELECT grp, test_period, role, count(*) AS n_windows FROM r WHERE role IS NOT NULL GROUP BY ALL"""
)
def rolling_folds(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("grp", F.expr("o_custkey % 3"))
    return splits.rolling_folds(o, ["grp"], "o_orderdate", "o_orderkey")


@query(SCORED + "SELECT equipment_id, CASE WHEN (dense_rank() OVER (PARTITION BY equipment_id ORDER BY CAST(window_start AS DATE)) - 1) % 5 = 4 THEN 'val' ELSE 'train' END AS part, window_id FROM s")
def interleaved_days(spark: SparkSession, d: str) -> DataFrame:
    return splits.interleaved_days(scored(spark, d), [EQ], "window_start").select(EQ, "part", "window_id")


# --- labelled events -----------------------------------------------------------------------------------------------


@query("WITH " + LABELS + "SELECT equipment_id, node_id, slug, severity, s AS start_us, e AS end_us, round((e - s) / 3.6e9, 6) AS hours FROM node")
def node_spans(spark: SparkSession, d: str) -> DataFrame:
    return rounded(truth.node_table(labels(spark, d)).select(EQ, "node_id", "slug", "severity", F.col("s").alias("start_us"), F.col("e").alias("end_us"), "hours"))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).where("zone <> 'green' AND usable")
    return s.select(EQ, "window_id", micros(s, "window_start").alias("ls"), micros(s, "window_end").alias("le"))


_NEAREST = SCORED + "," + LABELS + """,
f AS (SELECT equipment_id, window_id, epoch_us(window_start) AS ls, epoch_us(window_end) AS le FROM s WHERE zone <> 'green' AND usable),
c AS (SELECT f.*, node_id, n.s, n.e, n.s <= le AND n.e >= ls AS hit, CASE WHEN n.s <= le AND n.e >= ls THEN 0 WHEN n.s > le THEN n.s - le ELSE n.e - ls END AS gap FROM f LEFT JOIN node n USING (equipment_id)),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY equipment_id, window_id ORDER BY coalesce(hit, false) DESC, abs(gap), s, node_id) = 1)
"""


@query(_NEAREST + "SELECT equipment_id, window_id, node_id AS nearest_node_id, coalesce(hit, false) AS overlap, round(gap / 3.6e9, 6) AS signed_hours FROM best")
def nearest_event(spark: SparkSession, d: str) -> DataFrame:
    found = truth.nearest_events(_flagged(spark, d), truth.node_table(labels(spark, d)), [EQ])
    return rounded(found.select(EQ, "window_id", "nearest_node_id", "overlap", "signed_hours"))


@query(_NEAREST + ", h AS (SELECT equipment_id, least(floor((gap / 3.6e9 + 24) / 4), 11) AS bin, gap / 3.6e9 AS g FROM best WHERE NOT hit) SELECT equipment_id, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM h WHERE g >= -24 AND g <= 24 GROUP BY ALL")
def lead_histogram(spark: SparkSession, d: str) -> DataFrame:
    found = truth.nearest_events(_flagged(spark, d), truth.node_table(labels(spark, d)), [EQ]).where("NOT overlap")
    return metrics.histogram(found, [EQ], F.col("signed_hours"), -24.0, 4.0, 12)


@query(
    ALERTED + "," + LABELS
    + """SELECT e.equipment_id, e.run_no, e.start_window_idx, n.node_id FROM episode e JOIN node n ON n.equipment_id = e.equipment_id AND n.s <= epoch_us(e.end_time) AND n.e >= epoch_us(e.start_time)"""
)
def episode_node_overlap(spark: SparkSession, d: str) -> DataFrame:
    eps = alerts.episodes(alerted(spark, d), SERIES)
    left = eps.select(*SERIES, "start_window_idx", micros(eps, "start_time").alias("ls"), micros(eps, "end_time").alias("le"))
    right = truth.node_table(labels(spark, d)).select(EQ, "node_id", F.col("s").alias("rs"), F.col("e").alias("re"))
    return truth.overlap_join(left, right, [EQ]).select(*SERIES, "start_window_idx", "node_id")


@query(
    ALERTED + "," + LABELS
    + """, o AS (SELECT e.equipment_id, e.run_no, e.start_window_idx, n.node_id FROM episode e JOIN node n ON n.equipment_id = e.equipment_id AND n.s <= epoch_us(e.end_time) AND n.e >= epoch_us(e.start_time)),
a AS (SELECT equipment_id, count(*) AS n_episodes FROM episode GROUP BY ALL), b AS (SELECT equipment_id, count(*) AS n_nodes FROM node GROUP BY ALL),
m AS (SELECT equipment_id, count(DISTINCT (run_no, start_window_idx)) AS matched, count(DISTINCT node_id) AS caught FROM o GROUP BY ALL)
SELECT equipment_id, n_episodes, n_nodes, coalesce(matched, 0) AS n_matched, coalesce(caught, 0) AS n_caught, round(coalesce(matched, 0) / n_episodes, 6) AS episode_precision, round(coalesce(caught, 0) / n_nodes, 6) AS node_recall
FROM a JOIN b USING (equipment_id) LEFT JOIN m USING (equipment_id)"""
)
def episode_metrics(spark: SparkSession, d: str) -> DataFrame:
    eps = alerts.episodes(alerted(spark, d), SERIES)
    nodes = truth.node_table(labels(spark, d))
    left = eps.select(*SERIES, "start_window_idx", micros(eps, "start_time").alias("ls"), micros(eps, "end_time").alias("le"))
    met = truth.overlap_join(left, nodes.select(EQ, "node_id", F.col("s").alias("rs"), F.col("e").alias("re")), [EQ])
    m = met.groupBy(EQ).agg(F.countDistinct("run_no", "start_window_idx").alias("m"), F.countDistinct("node_id").alias("c"))
    a, b = eps.groupBy(EQ).agg(F.count("*").alias("n_episodes")), nodes.groupBy(EQ).agg(F.count("*").alias("n_nodes"))
    j = a.join(b, EQ).join(m, EQ, "left").select(EQ, "n_episodes", "n_nodes", F.coalesce("m", F.lit(0)).alias("n_matched"), F.coalesce("c", F.lit(0)).alias("n_caught"))
    return rounded(j.select("*", (F.col("n_matched") / F.col("n_episodes")).alias("episode_precision"), (F.col("n_caught") / F.col("n_nodes")).alias("node_recall")))


_TOUCH = ROWS + "," + LABELS + ", touch AS (SELECT DISTINCT w.equipment_id, w.window_id, l.label_id, l.node_id, l.rule_slug, l.severity, l.sensors FROM win w JOIN lab l ON l.equipment_id = w.equipment_id AND w.us BETWEEN l.s AND l.e)\n"


@query(_TOUCH + "SELECT DISTINCT equipment_id, window_id, node_id FROM touch")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return truth.label_rows(window_rows(spark, d), labels(spark, d)).select(EQ, "window_id", "node_id").distinct()


@query(
    _TOUCH
    + """, base AS (SELECT equipment_id, window_id, coalesce(max(n_active_nodes), 0) AS n_active_nodes FROM win GROUP BY ALL),
sets AS (SELECT equipment_id, window_id, max(severity) AS max_event_level, list_sort(list_distinct(list(rule_slug))) AS slugs, list_sort(list_distinct(flatten(list(coalesce(sensors, []))))) AS sensors, list_sort(list_distinct(list(node_id))) AS nodes FROM touch GROUP BY ALL)
SELECT equipment_id, window_id, n_active_nodes, n_active_nodes > 0 AS is_anomaly, max_event_level, coalesce(array_to_string(slugs, ','), '') AS all_rule_slugs, coalesce(array_to_string(sensors, ','), '') AS all_sensors, coalesce(array_to_string(nodes, ','), '') AS node_ids
FROM base LEFT JOIN sets USING (equipment_id, window_id)"""
)
def window_truth(spark: SparkSession, d: str) -> DataFrame:
    rows = window_rows(spark, d)
    t = truth.window_truth(rows, truth.label_rows(rows, labels(spark, d)))
    return t.select(EQ, "window_id", "n_active_nodes", "is_anomaly", "max_event_level", F.array_join("all_rule_slugs", ",").alias("all_rule_slugs"), F.array_join("all_sensors", ",").alias("all_sensors"), F.array_join(F.col("node_ids").cast("array<string>"), ",").alias("node_ids"))


@query(
    _TOUCH
    + """, w AS (SELECT DISTINCT equipment_id, window_id FROM win),
i AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY window_id) - 1 AS i, count(*) OVER (PARTITION BY equipment_id) AS n FROM w),
sp AS (SELECT equipment_id, window_id, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM i),
t AS (SELECT DISTINCT equipment_id, node_id, window_id FROM touch),
c0 AS (SELECT equipment_id, node_id, split, count(*) AS n FROM t LEFT JOIN sp USING (equipment_id, window_id) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY equipment_id, node_id) AS total FROM c0)
SELECT split, count(*) FILTER (n = total) AS n_full, count(*) FILTER (n < total) AS n_partial FROM c WHERE split IS NOT NULL GROUP BY split"""
)
def split_coverage(spark: SparkSession, d: str) -> DataFrame:
    split, _ = _split(spark, d)
    return truth.split_coverage(truth.label_rows(window_rows(spark, d), labels(spark, d)), split)


_CATALOG = """cat AS (SELECT rule_slug, list_sort(list_distinct(list(x))) AS sensors FROM (SELECT rule_slug, unnest(sensors) AS x FROM event_labels) WHERE rule_slug IS NOT NULL AND x IS NOT NULL GROUP BY ALL)"""


@query("WITH " + _CATALOG + "SELECT rule_slug, array_to_string(sensors, ',') AS sensors FROM cat")
def rule_catalog(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "event_labels").select("rule_slug", F.explode("sensors").alias("sensor"))
    return truth.rule_catalog(pairs).select("rule_slug", F.array_join("sensors", ",").alias("sensors"))


@query(
    "WITH " + _CATALOG
    + """, ev AS (SELECT DISTINCT record_id, all_rule_slugs FROM eval_windows),
x AS (SELECT record_id, unnest(CASE WHEN len(all_rule_slugs) > 0 THEN all_rule_slugs ELSE [NULL] END) AS rule_slug FROM ev)
SELECT record_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(sensors, []))))), ','), '') AS expected_sensors FROM x LEFT JOIN cat USING (rule_slug) GROUP BY record_id"""
)
def catalog_expansion(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "event_labels").select("rule_slug", F.explode("sensors").alias("sensor"))
    rows = table(spark, d, "eval_windows").select("record_id", "all_rule_slugs").dropDuplicates(["record_id"])
    return truth.expand_sensors(rows, truth.rule_catalog(pairs), ["record_id"]).select("record_id", F.array_join("expected_sensors", ",").alias("expected_sensors"))


_HIGH, _LOW = ["bearing-temp-high", "vib-1x-rising", "winding-temp-trend"], ["suction-pressure-low", "lube-oil-dp"]


@query(
    f"""SELECT DISTINCT record_id, CASE WHEN len(all_rule_slugs) = 0 OR all_rule_slugs IS NULL THEN 'none' WHEN list_has_any(all_rule_slugs, {_HIGH}) AND list_has_any(all_rule_slugs, {_LOW}) THEN 'both' WHEN list_has_any(all_rule_slugs, {_HIGH}) THEN 'high'
  WHEN list_has_any(all_rule_slugs, {_LOW}) THEN 'low' ELSE 'unclassified_only' END AS direction FROM eval_windows"""
)
def rule_direction(spark: SparkSession, d: str) -> DataFrame:
    slugs = F.coalesce("all_rule_slugs", F.array().cast("array<string>"))
    return table(spark, d, "eval_windows").select("record_id", truth.rule_direction(slugs, _HIGH, _LOW).alias("direction")).distinct()


@query(
    SCORED
    + """, ev AS (SELECT DISTINCT equipment_id, run_no, pos FROM p WHERE zone = 'red'),
b AS (SELECT DISTINCT equipment_id, run_no, pos + unnest(range(-2, 3)) AS pos FROM ev) SELECT p.window_id FROM p SEMI JOIN b USING (equipment_id, run_no, pos)"""
)
def band_join(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return truth.within_band(s, s.where("zone = 'red'").select(*SERIES, "pos"), SERIES, 2, "pos").select("window_id")


@query(
    SCORED
    + """, e AS (SELECT *, max(CASE WHEN zone = 'red' THEN pos END) OVER (PARTITION BY equipment_id, run_no ORDER BY pos) AS b, min(CASE WHEN zone = 'red' THEN pos END) OVER (PARTITION BY equipment_id, run_no ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM p)
SELECT window_id, least(pos - b, a - pos) AS event_distance FROM e"""
)
def event_distance(spark: SparkSession, d: str) -> DataFrame:
    return truth.distance_to_event(scored(spark, d), SERIES, F.col("zone") == "red", "pos").select("window_id", "event_distance")


@query(
    ROWS + "," + LABELS
    + """, nd AS (SELECT n.*, (SELECT list_sort(list_distinct(flatten(list(coalesce(l.sensors, []))))) FROM lab l WHERE l.node_id = n.node_id AND l.equipment_id = n.equipment_id) AS named FROM node n),
m AS (SELECT nd.equipment_id, nd.node_id, l.sensor, avg(value) FILTER (us >= nd.s) AS d, avg(value) FILTER (us <= nd.s - 15000000) AS b, count(value) FILTER (us <= nd.s - 15000000) AS n
  FROM nd JOIN long l ON l.equipment_id = nd.equipment_id AND list_contains(nd.named, l.sensor) AND l.us BETWEEN nd.s - 10800000000 AND nd.e GROUP BY ALL),
v AS (SELECT equipment_id, node_id, count(*) FILTER (d > b) AS up, count(*) FILTER (d < b) AS dn FROM m WHERE n >= 30 AND d IS NOT NULL GROUP BY ALL)
SELECT equipment_id, node_id, coalesce(up, 0) AS n_up, coalesce(dn, 0) AS n_down, CASE WHEN up IS NULL THEN 'ambiguous_no_data' WHEN up > dn THEN 'spike' WHEN up < dn THEN 'dip' ELSE 'ambiguous_tie' END AS direction FROM nd LEFT JOIN v USING (equipment_id, node_id)"""
)
def direction_vote(spark: SparkSession, d: str) -> DataFrame:
    return truth.event_direction(window_rows(spark, d), truth.node_table(labels(spark, d)), SENSORS)


# --- metrics -------------------------------------------------------------------------------------------------------

_TRUTH = SCORED + "," + LABELS + """,
t AS (SELECT p.*, EXISTS (SELECT 1 FROM node n WHERE n.equipment_id = p.equipment_id AND n.s <= epoch_us(p.window_end) AND n.e >= epoch_us(p.window_start)) AS active,
  (SELECT count(*) FROM node n WHERE n.equipment_id = p.equipment_id AND n.s <= epoch_us(p.window_end) AND n.e >= epoch_us(p.window_start)) AS n_active FROM p)
"""


def with_truth(spark: SparkSession, d: str) -> DataFrame:
    """Scored windows with n_active (nodes that overlap) and active."""
    s = scored(spark, d)
    left = s.select(EQ, "window_id", micros(s, "window_start").alias("ls"), micros(s, "window_end").alias("le"))
    right = truth.node_table(labels(spark, d)).select(EQ, "node_id", F.col("s").alias("rs"), F.col("e").alias("re"))
    hits = truth.overlap_join(left, right, [EQ]).groupBy("window_id").agg(F.count("*").alias("n_active"))
    return s.join(hits, "window_id", "left").withColumn("n_active", F.coalesce("n_active", F.lit(0))).withColumn("active", F.col("n_active") > 0)


@query(
    _TRUTH
    + """, c AS (SELECT equipment_id, count(*) FILTER (active AND f) AS tp, count(*) FILTER (NOT active AND f) AS fp, count(*) FILTER (active AND NOT f) AS fn, count(*) FILTER (NOT active AND NOT f) AS tn FROM (SELECT *, zone <> 'green' AS f FROM t WHERE usable) GROUP BY ALL)
SELECT equipment_id, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(CASE WHEN tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0) > 0 THEN 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / (tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0)) END, 6) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM c"""
)
def pointwise_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.pointwise(with_truth(spark, d), [EQ], F.col("active"), F.col("zone") != "green", F.col("usable")))


@query(
    _TRUTH
    + """, g AS (SELECT equipment_id, score, count(*) FILTER (active) AS p, count(*) FILTER (NOT active) AS n FROM t WHERE score IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(p) OVER (PARTITION BY equipment_id ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY equipment_id ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY equipment_id) AS np, sum(n) OVER (PARTITION BY equipment_id) AS nn FROM g)
SELECT equipment_id, round(CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum(p / nullif(np, 0) * (tp / (tp + fp))) END, 6) AS average_precision FROM c GROUP BY ALL"""
)
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.average_precision(with_truth(spark, d), [EQ], "score", F.col("active")))


@query(
    _TRUTH
    + """, g AS (SELECT equipment_id, score, count(*) FILTER (active) AS p, count(*) FILTER (NOT active) AS n FROM t WHERE score IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY equipment_id ORDER BY score) - n AS below, sum(p) OVER (PARTITION BY equipment_id) AS np, sum(n) OVER (PARTITION BY equipment_id) AS nn FROM g)
SELECT equipment_id, round(sum(p * (below + n / 2.0)) / nullif(max(np * nn), 0), 6) AS roc_auc FROM c GROUP BY ALL"""
)
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_auc(with_truth(spark, d), [EQ], "score", F.col("active")))


@query(
    _TRUTH
    + """, r AS (SELECT equipment_id, rank() OVER (PARTITION BY equipment_id ORDER BY score) + (count(*) OVER (PARTITION BY equipment_id, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY equipment_id ORDER BY n_active) + (count(*) OVER (PARTITION BY equipment_id, n_active) - 1) / 2.0 AS b FROM t WHERE score IS NOT NULL)
SELECT equipment_id, count(*) AS n, round(CASE WHEN count(*) >= 2 AND min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END, 6) AS rho FROM r GROUP BY ALL"""
)
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.spearman(with_truth(spark, d), [EQ], "score", "n_active"))


@query(SCORED + "SELECT equipment_id, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, round(max(x), 6) AS p100 FROM (SELECT equipment_id, ln(1 + score) AS x FROM s WHERE score IS NOT NULL) GROUP BY ALL")
def score_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.score_percentiles(scored(spark, d).withColumn("x", F.log1p("score")), [EQ], "x"))


@query(
    SCORED
    + """SELECT equipment_id, CAST(date_trunc('week', window_start) AS DATE) AS week_start, count(*) AS n_windows, count(DISTINCT CAST(window_start AS DATE)) AS n_days, round(coalesce(avg(x), 0), 6) AS mean_score, round(coalesce(max(x), 0), 6) AS max_score, round(coalesce(min(x), 0), 6) AS min_score, round(coalesce(stddev_pop(x), 0), 6) AS std_score,
  count(*) FILTER (zone = 'green') AS green, count(*) FILTER (zone = 'yellow') AS yellow, count(*) FILTER (zone = 'red') AS red, round(avg(CASE WHEN zone IN ('yellow', 'red') THEN 1.0 ELSE 0 END), 6) AS alert_rate FROM (SELECT *, ln(1 + score) AS x FROM s) GROUP BY ALL"""
)
def weekly_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.weekly_metrics(scored(spark, d).withColumn("x", F.log1p("score")), [EQ], "window_start", "x"))


@query(
    _TRUTH
    + "SELECT equipment_id, count(*) FILTER (f) AS n_flagged_windows, count(*) FILTER (f AND NOT active) AS n_false_alarm_windows, round(count(*) FILTER (f AND NOT active) / nullif(count(*) FILTER (f), 0), 6) AS window_false_alarm_rate FROM (SELECT *, zone <> 'green' AND usable AS f FROM t) GROUP BY ALL"
)
def window_false_alarms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.window_false_alarms(with_truth(spark, d), [EQ], (F.col("zone") != "green") & F.col("usable"), F.col("active")))


@query(
    SCORED
    + """, a AS (SELECT window_id, list_distinct(top_sensors) AS ss FROM s WHERE zone <> 'green' AND top_sensors IS NOT NULL), """
    + _CATALOG
    + """, j AS (SELECT window_id, rule_slug, len(list_intersect(ss, sensors)) / len(list_distinct(list_concat(ss, sensors))) AS j FROM a, cat WHERE list_has_any(ss, sensors))
SELECT window_id, rule_slug AS resembles_slug, round(j, 3) AS jaccard FROM j QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY j DESC, rule_slug) = 1 AND j >= 0.3"""
)
def resembling_slugs(spark: SparkSession, d: str) -> DataFrame:
    profiles = scored(spark, d).where("zone <> 'green' AND top_sensors IS NOT NULL").select("window_id", F.col("top_sensors").alias("sensors"))
    pairs = table(spark, d, "event_labels").select("rule_slug", F.explode("sensors").alias("sensor"))
    return metrics.resembling(profiles, truth.rule_catalog(pairs), ["window_id"])


@query(
    SCORED + "," + LABELS
    + """, hit AS (SELECT p.window_id, any_value(p.equipment_id) AS equipment_id, any_value(p.zone) AS zone, list_distinct(list(l.rule_slug)) AS slugs, any_value(p.usable) AS usable FROM p JOIN lab l ON l.equipment_id = p.equipment_id AND l.s <= epoch_us(p.window_end) AND l.e >= epoch_us(p.window_start) GROUP BY p.window_id),
each AS (SELECT unnest(slugs) AS rule_slug, zone <> 'green' AND usable AS f FROM hit UNION ALL SELECT 'any_slug', zone <> 'green' AND usable FROM hit)
SELECT rule_slug, count(*) AS n_windows, count(*) FILTER (f) AS n_flagged, round(count(*) FILTER (f) / count(*), 6) AS recall FROM each GROUP BY ALL"""
)
def slug_rows(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    left = s.select(EQ, "window_id", micros(s, "window_start").alias("ls"), micros(s, "window_end").alias("le"))
    lab = labels(spark, d).select(EQ, "rule_slug", F.col("s").alias("rs"), F.col("e").alias("re"))
    slugs = truth.overlap_join(left, lab, [EQ]).groupBy("window_id").agg(F.collect_set("rule_slug").alias("slugs"))
    rows = s.join(slugs, "window_id").withColumn("all", F.lit(1))
    return rounded(metrics.slug_rows(rows, [], "slugs", (F.col("zone") != "green") & F.col("usable"), F.lit(True)))


@query(
    SCORED + "," + LABELS
    + """, tr AS (SELECT p.window_id, list_distinct(flatten(list(coalesce(l.sensors, [])))) AS truth, count(DISTINCT l.node_id) AS n_active FROM p JOIN lab l ON l.equipment_id = p.equipment_id AND l.s <= epoch_us(p.window_end) AND l.e >= epoch_us(p.window_start) GROUP BY p.window_id),
u AS (SELECT p.window_id, p.equipment_id, unnest(top_sensors) AS sensor, generate_subscripts(top_sensors, 1) AS ix FROM p WHERE top_sensors IS NOT NULL),
d AS (SELECT window_id, equipment_id, sensor, row_number() OVER (PARTITION BY window_id ORDER BY min(ix)) AS i, count(*) OVER (PARTITION BY window_id) AS k FROM u GROUP BY window_id, equipment_id, sensor),
h AS (SELECT d.*, n_active, row_number() OVER (PARTITION BY window_id ORDER BY i) AS hit FROM d JOIN tr USING (window_id) WHERE list_contains(truth, sensor)),
w AS (SELECT window_id, equipment_id, any_value(n_active) AS n_active, avg(hit / i) AS ap, avg(CASE WHEN k > 1 THEN (i - 1) / (k - 1) ELSE 0 END) AS rp FROM h GROUP BY ALL),
pt AS (SELECT *, 'overall' AS part FROM w UNION ALL SELECT *, CASE WHEN n_active <= 1 THEN 'low' ELSE 'high' END FROM w)
SELECT equipment_id, part, count(*) AS n_windows, round(avg(ap), 6) AS map, round(avg(rp), 6) AS rank_percentile FROM pt GROUP BY ALL"""
)
def attribution_map(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    left = s.select(EQ, "window_id", micros(s, "window_start").alias("ls"), micros(s, "window_end").alias("le"))
    lab = labels(spark, d).select(EQ, "node_id", F.coalesce("sensors", F.array().cast("array<string>")).alias("sensors"), F.col("s").alias("rs"), F.col("e").alias("re"))
    tr = truth.overlap_join(left, lab, [EQ]).groupBy("window_id").agg(F.array_distinct(F.flatten(F.collect_set("sensors"))).alias("truth"), F.countDistinct("node_id").alias("n_active"))
    return rounded(metrics.attribution(s.where("top_sensors IS NOT NULL").join(tr, "window_id"), [EQ], "top_sensors", "truth", "n_active"))


@query(
    SCORED + "," + LABELS
    + """, nw AS (SELECT DISTINCT p.equipment_id, p.run_no, n.node_id, p.pos FROM p JOIN node n ON n.equipment_id = p.equipment_id AND n.s <= epoch_us(p.window_end) AND n.e >= epoch_us(p.window_start)),
band AS (SELECT DISTINCT equipment_id, run_no, node_id, pos + unnest(range(-1, 2)) AS pos FROM nw),
a AS (SELECT *, min(CASE WHEN score > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY equipment_id, run_no ORDER BY pos ROWS 1 PRECEDING) = 1 AND pos >= 1 AS alarm FROM p),
m AS (SELECT a.equipment_id, a.run_no, a.pos, alarm, b.pos IS NOT NULL AS near FROM a LEFT JOIN (SELECT DISTINCT equipment_id, run_no, pos FROM band) b USING (equipment_id, run_no, pos)),
nh AS (SELECT b.equipment_id, b.run_no, b.node_id, bool_or(alarm) AS hit FROM band b JOIN a USING (equipment_id, run_no, pos) GROUP BY ALL),
nn AS (SELECT equipment_id, run_no, count(*) AS n_nodes, count(*) FILTER (hit) AS nodes_detected FROM nh GROUP BY ALL),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY equipment_id, run_no ORDER BY pos) AS g FROM m WHERE alarm),
ep AS (SELECT equipment_id, run_no, g, bool_or(near) AS tp FROM i GROUP BY ALL),
en AS (SELECT equipment_id, run_no, count(*) AS eps, count(*) FILTER (tp) AS tpe FROM ep GROUP BY ALL),
wn AS (SELECT equipment_id, run_no, count(*) AS n_windows, count(*) FILTER (alarm) AS n_alarm_windows, count(*) FILTER (alarm AND near) AS tpw FROM m GROUP BY ALL),
z AS (SELECT equipment_id, run_no, n_windows, n_alarm_windows, tpw, coalesce(n_nodes, 0) AS n_nodes, coalesce(nodes_detected, 0) AS nodes_detected, coalesce(eps, 0) AS eps, coalesce(tpe, 0) AS tpe FROM wn LEFT JOIN nn USING (equipment_id, run_no) LEFT JOIN en USING (equipment_id, run_no)),
y AS (SELECT *, nodes_detected / nullif(n_nodes, 0) AS er, tpw / nullif(n_alarm_windows, 0) AS wp FROM z)
SELECT equipment_id, run_no, n_windows, n_alarm_windows, n_nodes, nodes_detected, round(er, 6) AS event_recall, round(wp, 6) AS window_precision, round(coalesce(CASE WHEN wp + er > 0 THEN 2 * wp * er / (wp + er) END, 0), 6) AS composite_f1, eps AS n_alarm_episodes, tpe AS tp_episodes,
  round(tpe / nullif(eps, 0), 6) AS episode_precision, round((eps - tpe) / (n_windows * 0.5 / 24), 6) AS false_alarms_per_day FROM y"""
)
def event_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    left = s.select(*SERIES, "pos", micros(s, "window_start").alias("ls"), micros(s, "window_end").alias("le"))
    nodes = truth.node_table(labels(spark, d)).select(EQ, "node_id", F.col("s").alias("rs"), F.col("e").alias("re"))
    node_windows = truth.overlap_join(left, nodes, [EQ]).select(*SERIES, "node_id", "pos")
    return rounded(metrics.event_metrics(s.select(*SERIES, "pos", "score"), node_windows, SERIES, F.col("score") > 1.5, 1, 2))


@query(
    _TRUTH
    + """, c AS (SELECT CASE WHEN labels <= 0 THEN 'low' ELSE 'high' END AS part, count(*) FILTER (active AND f) AS tp, count(*) FILTER (NOT active AND f) AS fp, count(*) FILTER (active AND NOT f) AS fn FROM (SELECT *, zone <> 'green' AS f FROM t WHERE usable AND labels IS NOT NULL) GROUP BY ALL)
SELECT part, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c"""
)
def direction_breakdown(spark: SparkSession, d: str) -> DataFrame:
    rows = with_truth(spark, d).where("labels IS NOT NULL").withColumn("part", F.when(F.col("labels") <= 0, "low").otherwise("high"))
    return rounded(metrics.pointwise(rows, ["part"], F.col("active"), F.col("zone") != "green", F.col("usable")).select("part", "tp", "fp", "fn", "precision", "recall"))


@query(
    SCORED
    + """, f AS (SELECT equipment_id, unnest(string_split(quality_flags, ',')) AS flag FROM s WHERE quality_flags IS NOT NULL AND quality_flags <> '') SELECT equipment_id, trim(flag) AS flag, count(*) AS n FROM f WHERE trim(flag) <> '' GROUP BY ALL"""
)
def quality_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    flags = scored(spark, d).where("quality_flags IS NOT NULL AND quality_flags <> ''").select(EQ, F.explode(F.split("quality_flags", ",")).alias("flag")).withColumn("flag", F.trim("flag")).where("flag <> ''")
    return flags.groupBy(EQ, "flag").agg(F.count("*").alias("n"))


@query(
    SCORED
    + """, c AS (SELECT equipment_id, sensor, count(*) AS n_windows FROM (SELECT equipment_id, unnest(list_distinct(top_sensors)) AS sensor FROM s WHERE zone <> 'green') GROUP BY ALL)
SELECT equipment_id, sensor, n_windows FROM c QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY n_windows DESC, sensor) <= 3"""
)
def implicated_sensors(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    each = scored(spark, d).where("zone <> 'green'").select(EQ, F.explode(F.array_distinct("top_sensors")).alias("sensor")).groupBy(EQ, "sensor").agg(F.count("*").alias("n_windows"))
    place = F.row_number().over(Window.partitionBy(EQ).orderBy(F.col("n_windows").desc(), "sensor"))
    return each.withColumn("_r", place).where("_r <= 3").drop("_r")


# --- drift ---------------------------------------------------------------------------------------------------------

_RECENT = "window_start >= TIMESTAMP '2018-01-16 00:00:00'"


@query(
    SCORED
    + f""", g AS (SELECT equipment_id, score, count(*) FILTER (NOT {_RECENT}) AS a, count(*) FILTER ({_RECENT}) AS b FROM s WHERE score IS NOT NULL GROUP BY ALL),
c AS (SELECT equipment_id, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER (PARTITION BY equipment_id) AS na, sum(b) OVER (PARTITION BY equipment_id) AS nb FROM g WINDOW o AS (PARTITION BY equipment_id ORDER BY score))
SELECT equipment_id, CAST(max(na) AS BIGINT) AS n_base, CAST(max(nb) AS BIGINT) AS n_recent, round(max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))), 6) AS ks FROM c GROUP BY ALL"""
)
def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(monitor.ks_statistic(scored(spark, d), [EQ], "score", F.expr(_RECENT)))


@query(
    SCORED
    + """, dy AS (SELECT equipment_id, CAST(window_start AS DATE) AS day, avg(ln(1 + score)) AS error FROM s WHERE score IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER o AS i, avg(error) OVER (PARTITION BY equipment_id ORDER BY day ROWS 6 PRECEDING) AS m FROM dy WINDOW o AS (PARTITION BY equipment_id ORDER BY day))
SELECT equipment_id, count(*) AS n_days, round(coalesce(regr_slope(CASE WHEN i >= 7 THEN m END, CASE WHEN i >= 7 THEN i END), 0), 6) AS trend_slope, round(regr_r2(CASE WHEN i >= 7 THEN m END, CASE WHEN i >= 7 THEN i END), 6) AS r_squared FROM r GROUP BY ALL"""
)
def rolling_trend(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("x", F.log1p("score"))
    return rounded(monitor.rolling_trend(monitor.daily_errors(s, [EQ], "window_start", "x"), [EQ]))


@query()
def retrain_check(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("x", F.log1p("score"))
    return rounded(monitor.retrain_check(s, [EQ], "window_start", "x", F.expr(_RECENT), weeks=3))


# --- small functions -----------------------------------------------------------------------------------------------


@query(
    "SELECT DISTINCT label_id, strftime(start_time, '%Y-%m') AS month, round((epoch_us(end_time) - epoch_us(start_time)) / 3.6e9, 6) AS hours, round(duration_minutes, 4) AS minutes, round(len(list_intersect(sensors, ['sensor_06', 'sensor_07'])) / nullif(len(list_distinct(list_concat(sensors, ['sensor_06', 'sensor_07']))), 0), 6) AS likeness FROM event_labels"
)
def label_scalars(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "event_labels")
    pair = F.array(F.lit("sensor_06"), F.lit("sensor_07"))
    likeness = F.when(F.col("sensors").isNotNull(), jaccard(F.col("sensors"), pair)).otherwise(F.lit(None))
    return rounded(e.select("label_id", month_label(F.col("start_time")).alias("month"), hours_between(micros(e, "start_time"), micros(e, "end_time")).alias("hours"), json_number(F.col("duration_minutes")).alias("minutes"), likeness.alias("likeness"))).distinct()


@query(SCORED + "SELECT equipment_id, window_id FROM s WHERE zone = 'red' INTERSECT SELECT equipment_id, window_id FROM s WHERE usable EXCEPT SELECT equipment_id, window_id FROM s WHERE labels = -1")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    pick = lambda where: s.where(where).select(EQ, "window_id")
    return pick("zone = 'red'").intersect(pick("usable")).subtract(pick("labels = -1"))
