"""Composite reports as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, metrics, pipeline, reports, splits, truth, windows
from ..session import durable, micros, table
from .base import ALERTED, EQ, LABELS, ROWS, SCORED, SENSORS, SERIES, labels, rounded, scored, window_rows
from .reference import _CATALOG, _HIGH, _LOW, _TRUTH, _split, alerted, with_truth

_NODE_POS = ", nw AS (SELECT p.equipment_id, p.run_no, n.node_id, p.pos FROM p JOIN node n ON n.equipment_id = p.equipment_id AND n.s <= epoch_us(p.window_end) AND n.e >= epoch_us(p.window_start))"


def _node_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = scored(spark, d)
    left = s.select(*SERIES, "pos", micros(s, "window_start").alias("ls"), micros(s, "window_end").alias("le"))
    nodes = truth.node_table(labels(spark, d)).select(EQ, "node_id", "slug", F.col("s").alias("rs"), F.col("e").alias("re"))
    return s, truth.overlap_join(left, nodes, [EQ]).select(*SERIES, "node_id", "slug", "pos")


def node_latency(spark: SparkSession, d: str) -> DataFrame:
    s, nw = _node_windows(spark, d)
    return reports.node_latency(s, nw, SERIES, F.col("score") > 1.5)


def suppressed_alerts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.suppression(with_truth(spark, d), [EQ], F.col("active"), F.col("zone") != "green", F.coalesce(F.col("labels") == 0, F.lit(False)), F.col("usable")))


def recall_by_direction(spark: SparkSession, d: str) -> DataFrame:
    s, nw = _node_windows(spark, d)
    hit = nw.join(s.select(*SERIES, "pos", (F.col("zone") != "green").alias("_f")), [*SERIES, "pos"]).groupBy(EQ, "node_id", "slug").agg(F.max("_f").alias("detected"))
    named = hit.withColumn("direction", truth.rule_direction(F.array_compact(F.array("slug")), _HIGH, _LOW))
    return rounded(reports.recall_by(named, ["direction"], F.col("detected")))


def data_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    split, _ = _split(spark, d)
    touched = truth.label_rows(window_rows(spark, d), labels(spark, d))
    nodes = touched.join(split.where("split = 'test'").select(EQ, "window_id"), [EQ, "window_id"]).groupBy(EQ).agg(F.countDistinct("node_id").alias("n_test_nodes"))
    return rounded(reports.sufficiency(split, nodes, [EQ], least_days=1.0))


def label_free_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.label_free(scored(spark, d), [EQ]))


def event_row_positions(spark: SparkSession, d: str) -> DataFrame:
    """The first row at or after the start of each label of the machine."""
    rows = window_rows(spark, d)
    events = labels(spark, d).select(EQ, F.col("label_id").alias("event_id"), F.col("s").alias("us"))
    return reports.as_of(rows, events, [EQ], 86_400_000_000).where("row_pos IS NOT NULL")


def variant_report(spark: SparkSession, d: str) -> DataFrame:
    """Scoring runs as seeds, regimes as variants."""
    runs = scored(spark, d).where("labels IS NOT NULL AND score IS NOT NULL").groupBy("labels", "run_no").agg(F.avg(F.log1p("score")).alias("metric"))
    return rounded(reports.variant_report(runs.withColumn("variant", F.when(F.col("labels") == 0, "baseline").otherwise(F.concat(F.lit("regime "), F.col("labels").cast("string"))))))


def chosen_models(spark: SparkSession, d: str) -> DataFrame:
    """Per machine the regime of least mean log score."""
    losses = scored(spark, d).where("labels IS NOT NULL AND score IS NOT NULL").groupBy(EQ, F.col("labels").alias("model")).agg(F.round(F.avg(F.log1p("score")), 6).alias("val_loss"))
    return reports.chosen_model(losses, [EQ])


def detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Confusion, PR-AUC and ROC-AUC of usable windows over all machines, for any flag and for red alone."""
    rows = with_truth(spark, d).where("usable").withColumn("flag", F.explode(F.array(F.lit("any"), F.lit("red"))))
    flagged = F.when(F.col("flag") == "red", F.col("zone") == "red").otherwise(F.col("zone") != "green")
    out = metrics.pointwise(rows, ["flag"], F.col("active"), flagged)
    out = out.join(metrics.average_precision(rows, ["flag"], "score", F.col("active")), "flag").join(metrics.roc_auc(rows, ["flag"], "score", F.col("active")), "flag")
    return rounded(out.select("flag", "tp", "fp", "fn", "tn", "precision", "recall", "average_precision", "roc_auc"))


def sampled_windows(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the windows by hash: the sampling operator itself."""
    return splits.hash_sample(scored(spark, d).select("window_id", EQ), ["window_id"], 0.1)


def score_timeline(spark: SparkSession, d: str) -> DataFrame:
    # read by five parts of the plan, so numbered rows are written once, as a stored table would hold them
    return rounded(pipeline.score_timeline(durable(window_rows(spark, d)), SENSORS, "sensor_00", 40.0))


def _episode_alarms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    eps = alerts.episodes(alerted(spark, d), SERIES)
    pairs = table(spark, d, "event_labels").select("rule_slug", F.explode("sensors").alias("sensor"))
    return reports.episode_false_alarms(eps, with_truth(spark, d), truth.rule_catalog(pairs), SERIES)


def episode_false_alarms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_episode_alarms(spark, d)[0])


def resembling_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _episode_alarms(spark, d)[1]


def rule_direction_quality(spark: SparkSession, d: str) -> DataFrame:
    """Anomalies of the evaluation windows as flags, by the direction of their rules."""
    rows = table(spark, d, "eval_windows").select("record_id", "split", "all_rule_slugs").dropDuplicates(["record_id"])
    named = rows.withColumn("direction", truth.rule_direction(F.coalesce("all_rule_slugs", F.array().cast("array<string>")), _HIGH, _LOW))
    return rounded(reports.rule_direction_quality(named, "direction", F.col("split") == "test"))


def trend_signs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.sign_shares(windows.window_trend(window_rows(spark, d), SENSORS), ["sensor"], "trend"))


QUERIES = {f.__name__: f for f in (score_timeline, episode_false_alarms, resembling_episodes, rule_direction_quality, trend_signs, node_latency, suppressed_alerts, recall_by_direction, data_sufficiency, label_free_summary, event_row_positions, variant_report, chosen_models, detection_metrics, sampled_windows)}

_TEST = """, w AS (SELECT DISTINCT equipment_id, window_id FROM win),
i AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY window_id) - 1 AS i, count(*) OVER (PARTITION BY equipment_id) AS n FROM w),
sp AS (SELECT equipment_id, window_id, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM i)"""
_PR = "round(count(*) FILTER (active AND {f}) / nullif(count(*) FILTER ({f}), 0), 6) AS {n}_precision, round(count(*) FILTER (active AND {f}) / nullif(count(*) FILTER (active), 0), 6) AS {n}_recall"
_ACTIVE = ALERTED + "," + LABELS + """,
t AS (SELECT p.*, EXISTS (SELECT 1 FROM node n WHERE n.equipment_id = p.equipment_id AND n.s <= epoch_us(p.window_end) AND n.e >= epoch_us(p.window_start)) AS active FROM p),
ew AS (SELECT e.equipment_id, e.run_no, e.start_window_idx, bool_or(t.active) AS active, list_distinct(flatten(list(coalesce(t.top_sensors, [])))) AS ss
  FROM episode e JOIN t ON t.equipment_id = e.equipment_id AND t.run_no = e.run_no AND t.pos BETWEEN e.start_window_idx AND e.end_window_idx GROUP BY ALL)
"""
SQL = {
    "score_timeline": ROWS
    + """,
scaler AS (SELECT equipment_id, sensor, coalesce(quantile_cont(value, 0.5), 0) AS center, CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 0 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1 END AS scale
  FROM long JOIN (SELECT DISTINCT equipment_id, n_rows FROM placed) USING (equipment_id) WHERE row_pos < floor(n_rows * 0.7::DOUBLE) GROUP BY ALL),
f AS (SELECT equipment_id, window_id, row_in_window, sensor, value, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY equipment_id, window_id, sensor ORDER BY row_in_window ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS v FROM long),
mask AS (SELECT equipment_id, window_id, sensor, (count(*) - count(value)) * 100.0 / count(*) > 5 OR count(*) > count(v) AS masked FROM f GROUP BY ALL),
q AS (SELECT equipment_id, window_id, CAST(count(*) FILTER (masked) AS INTEGER) AS n_masked FROM mask GROUP BY ALL),
run AS (SELECT equipment_id, window_id, coalesce(avg(CASE WHEN sensor_00 > 40 THEN 100.0 WHEN sensor_00 IS NOT NULL THEN 0 END) >= 50, false) AS running FROM win GROUP BY ALL),
st AS (SELECT equipment_id, window_id, n_masked, CASE WHEN NOT running THEN 'not_running' WHEN n_masked * 100.0 / 10 > 30 THEN 'rejected' ELSE 'scored' END AS status FROM q JOIN run USING (equipment_id, window_id)),
x AS (SELECT f.equipment_id, f.window_id, f.row_in_window, f.sensor, 20 * asinh((v - center) / scale / 20) AS x FROM f JOIN st USING (equipment_id, window_id) JOIN mask USING (equipment_id, window_id, sensor) LEFT JOIN scaler ON scaler.equipment_id = f.equipment_id AND scaler.sensor = f.sensor WHERE status = 'scored' AND NOT masked),
r AS (SELECT equipment_id, window_id, row_in_window, avg(x * x) AS e FROM x GROUP BY ALL),
sc AS (SELECT equipment_id, window_id, quantile_cont(e, 0.95) AS score FROM r GROUP BY ALL),
lim AS (SELECT equipment_id, quantile_cont(score, 0.9) AS a, quantile_cont(score, 0.99) AS b FROM sc GROUP BY ALL),
se AS (SELECT equipment_id, window_id, sensor, round(coalesce(avg(x * x), 0), 9) AS e FROM x GROUP BY ALL),
top AS (SELECT equipment_id, window_id, first(sensor ORDER BY e DESC, sensor) AS top_sensor FROM se GROUP BY ALL HAVING sum(e) > 0)
SELECT st.equipment_id, st.window_id, status, status = 'scored' AS usable, n_masked, round(score, 6) AS score, CASE WHEN status = 'scored' THEN CASE WHEN score >= b THEN 'red' WHEN score >= a THEN 'yellow' ELSE 'green' END END AS zone, top_sensor
FROM st LEFT JOIN sc USING (equipment_id, window_id) LEFT JOIN lim USING (equipment_id) LEFT JOIN top USING (equipment_id, window_id)""",
    "episode_false_alarms": _ACTIVE + "SELECT equipment_id, run_no, count(*) AS n_episodes, count(*) FILTER (NOT active) AS n_false, round(count(*) FILTER (NOT active) / count(*), 6) AS false_rate FROM ew GROUP BY ALL",
    "resembling_episodes": _ACTIVE + "," + _CATALOG
    + """, j AS (SELECT equipment_id, run_no, start_window_idx, rule_slug, len(list_intersect(ss, sensors)) / len(list_distinct(list_concat(ss, sensors))) AS j FROM ew, cat WHERE NOT active AND list_has_any(ss, sensors))
SELECT equipment_id, run_no, start_window_idx, rule_slug AS resembles_slug, round(j, 3) AS jaccard FROM j QUALIFY row_number() OVER (PARTITION BY equipment_id, run_no, start_window_idx ORDER BY j DESC, rule_slug) = 1 AND j >= 0.3""",
    "rule_direction_quality": f"""WITH e AS (SELECT DISTINCT record_id, split = 'test' AS f, CASE WHEN len(all_rule_slugs) = 0 OR all_rule_slugs IS NULL THEN 'none' WHEN list_has_any(all_rule_slugs, {_HIGH}) AND list_has_any(all_rule_slugs, {_LOW}) THEN 'both' WHEN list_has_any(all_rule_slugs, {_HIGH}) THEN 'high'
  WHEN list_has_any(all_rule_slugs, {_LOW}) THEN 'low' ELSE 'unclassified_only' END AS direction FROM eval_windows),
c AS (SELECT direction, count(*) AS n, count(*) FILTER (f) AS k FROM e GROUP BY ALL)
SELECT direction, n, k AS n_flagged, round(k / n, 6) AS recall, round(k / nullif(k + coalesce((SELECT k FROM c WHERE direction = 'none'), 0), 0), 6) AS precision FROM c WHERE direction <> 'none'""",
    "trend_signs": ROWS
    + """, t AS (SELECT sensor, CASE WHEN count(value) >= 2 THEN avg(value) FILTER (row_in_window >= 80) - avg(value) FILTER (row_in_window < 40) END AS t FROM long GROUP BY equipment_id, window_id, sensor)
SELECT sensor, count(t) AS n, round(avg(CASE WHEN t > 0 THEN 1.0 ELSE 0 END), 6) AS share_up, round(avg(CASE WHEN t < 0 THEN 1.0 ELSE 0 END), 6) AS share_down FROM t WHERE t IS NOT NULL GROUP BY sensor""",
    "node_latency": SCORED + "," + LABELS + _NODE_POS
    + """, sp AS (SELECT equipment_id, run_no, node_id, min(pos) AS first_pos, max(pos) AS last_pos FROM nw GROUP BY ALL), al AS (SELECT equipment_id, run_no, pos FROM p WHERE score > 1.5)
SELECT sp.equipment_id, sp.run_no, node_id, first_pos, last_pos, min(pos - first_pos) FILTER (pos >= first_pos - 1 AND pos <= last_pos + 1) AS latency, count(pos) FILTER (pos <= first_pos - 2) AS n_before
FROM sp LEFT JOIN al ON al.equipment_id = sp.equipment_id AND al.run_no = sp.run_no AND al.pos BETWEEN first_pos - 12 AND last_pos + 1 GROUP BY sp.equipment_id, sp.run_no, node_id, first_pos, last_pos""",
    "suppressed_alerts": _TRUTH
    + f"""SELECT equipment_id, {_PR.format(f="f", n="before")}, {_PR.format(f="(f AND NOT gone)", n="after")}, count(*) FILTER (gone) AS n_suppressed
FROM (SELECT *, zone <> 'green' AS f, zone <> 'green' AND coalesce(labels = 0, false) AS gone FROM t WHERE usable) GROUP BY ALL""",
    "recall_by_direction": SCORED + "," + LABELS + _NODE_POS.replace("n.node_id, p.pos", "n.node_id, n.slug, p.zone")
    + f""", h AS (SELECT equipment_id, node_id, slug, bool_or(zone <> 'green') AS det FROM nw GROUP BY ALL)
SELECT CASE WHEN slug IS NULL THEN 'none' WHEN slug IN {tuple(_HIGH)} THEN 'high' WHEN slug IN {tuple(_LOW)} THEN 'low' ELSE 'unclassified_only' END AS direction, count(*) AS n, count(*) FILTER (det) AS n_detected, round(count(*) FILTER (det) / count(*), 6) AS recall FROM h GROUP BY ALL""",
    "data_sufficiency": ROWS + "," + LABELS + _TEST
    + """, tn AS (SELECT w.equipment_id, count(DISTINCT l.node_id) AS k FROM win w JOIN lab l ON l.equipment_id = w.equipment_id AND w.us BETWEEN l.s AND l.e JOIN sp ON sp.equipment_id = w.equipment_id AND sp.window_id = w.window_id AND split = 'test' GROUP BY ALL)
SELECT equipment_id, round(count(*) FILTER (split = 'train') * (120 * 15 / 86400.0::DOUBLE), 6) AS train_days, coalesce(any_value(k), 0) AS n_test_nodes, count(*) FILTER (split = 'train') * (120 * 15 / 86400.0::DOUBLE) >= 1 AND coalesce(any_value(k), 0) >= 1 AS enough FROM sp LEFT JOIN tn USING (equipment_id) GROUP BY ALL""",
    "label_free_summary": SCORED
    + "SELECT equipment_id, count(*) AS n_windows, count(*) FILTER (usable) AS n_usable, count(score) AS n_scored, count(*) FILTER (usable AND zone <> 'green') AS n_alerts, round(count(*) FILTER (usable AND zone <> 'green') / nullif(count(*) FILTER (usable), 0), 6) AS alert_share FROM s GROUP BY ALL",
    "event_row_positions": ROWS + "," + LABELS
    + """, ends AS (SELECT equipment_id, max(row_pos) AS z FROM win GROUP BY ALL)
SELECT lab.equipment_id, label_id AS event_id, coalesce((SELECT min(row_pos) FROM win WHERE win.equipment_id = lab.equipment_id AND win.us >= lab.s), z) AS row_pos FROM lab JOIN ends USING (equipment_id)""",
    "variant_report": SCORED
    + """, r AS (SELECT CASE WHEN labels = 0 THEN 'baseline' ELSE 'regime ' || labels END AS variant, run_no, avg(ln(1 + score)) AS m FROM s WHERE labels IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
v AS (SELECT variant, count(*) AS n, avg(m) AS mean, stddev_samp(m) AS std FROM r GROUP BY ALL), b AS (SELECT mean AS bm, coalesce(std, 0) AS bs FROM v WHERE variant = 'baseline')
SELECT variant, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - bm, 6) AS gain, CASE WHEN variant = 'baseline' THEN 'base' WHEN abs(mean - bm) <= 2 * bs THEN 'noise' WHEN mean > bm THEN 'better' ELSE 'worse' END AS verdict FROM v LEFT JOIN b ON true""",
    "chosen_models": SCORED
    + """, r AS (SELECT equipment_id, labels AS model, round(avg(ln(1 + score)), 6) AS val_loss FROM s WHERE labels IS NOT NULL AND score IS NOT NULL GROUP BY ALL) SELECT equipment_id, model, val_loss FROM r QUALIFY row_number() OVER (PARTITION BY equipment_id ORDER BY val_loss, model) = 1""",
    "detection_metrics": _TRUTH
    + """, u AS (SELECT *, 'any' AS flag, zone <> 'green' AS f FROM t WHERE usable UNION ALL SELECT *, 'red', zone = 'red' FROM t WHERE usable),
g AS (SELECT flag, score, count(*) FILTER (active) AS p, count(*) FILTER (NOT active) AS n FROM u WHERE score IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(p) OVER (PARTITION BY flag ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY flag ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY flag) AS np, sum(n) OVER (PARTITION BY flag) AS nn FROM g),
a AS (SELECT flag, round(sum(p / np * (tp / (tp + fp))), 6) AS average_precision, round(sum(p * (nn - fp + n / 2.0)) / max(np * nn), 6) AS roc_auc FROM c GROUP BY ALL),
k AS (SELECT flag, count(*) FILTER (active AND f) AS tp, count(*) FILTER (NOT active AND f) AS fp, count(*) FILTER (active AND NOT f) AS fn, count(*) FILTER (NOT active AND NOT f) AS tn FROM u GROUP BY ALL)
SELECT flag, k.tp, k.fp, k.fn, k.tn, round(k.tp / nullif(k.tp + k.fp, 0), 6) AS precision, round(k.tp / nullif(k.tp + k.fn, 0), 6) AS recall, average_precision, roc_auc FROM k JOIN a USING (flag)""",
}
