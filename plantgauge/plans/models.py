"""Queries over fitted models, regimes and cleaning, and the operators of the earlier generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ablation, cleaning, legacy, limits, metrics, models, scaling, scoring, truth
from ..session import table
from ..sources.synthetic import event_sensor_names, synthetic_plant
from .base import EQ, ROWS, SENSORS, rounded, window_rows
from .reference import _TRUTH, SCALED, scaled_rows, with_truth

N = 16


def regime_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(regime, window_id, x): the complete mean vectors of the cleaned training windows, each record once."""
    rows = table(spark, d, "cleaned_windows").select(F.col("cleaned_regime_labels").alias("regime"), F.col("record_id").alias("window_id"), F.col("sensor_means").alias("x"))
    whole = rows.where(F.col("x").isNotNull() & (F.size("x") == N) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    return whole.where("regime IS NOT NULL AND window_id IS NOT NULL").dropDuplicates(["window_id"])


_VECTORS = f"""
WITH v AS (SELECT DISTINCT record_id, cleaned_regime_labels AS regime, sensor_means AS x FROM cleaned_windows
  WHERE sensor_means IS NOT NULL AND len(sensor_means) = {N} AND len(list_filter(sensor_means, lambda y: y IS NULL OR isnan(y))) = 0 AND cleaned_regime_labels IS NOT NULL),
m AS (SELECT regime, {", ".join(f"avg(x[{i + 1}]) AS m{i}" for i in range(N))} FROM v GROUP BY ALL)
"""


def window_covariance(spark: SparkSession, d: str) -> DataFrame:
    """Per regime and pair of sensors the sample covariance."""
    stats = models.moments(regime_vectors(spark, d), "regime")
    each = stats.select("regime", "n", F.posexplode("cov").alias("p", "cov"))
    return rounded(each.select("regime", "n", F.expr(f"p div {N}").alias("i"), F.expr(f"p % {N}").alias("j"), "cov"), 4)


def component_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.pca_outliers(regime_vectors(spark, d), key="regime"))


def latent_sizes(spark: SparkSession, d: str) -> DataFrame:
    return models.latent_size(models.moments(regime_vectors(spark, d), "regime"), key="regime")


def mahalanobis_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.mahalanobis_outliers(regime_vectors(spark, d), key="regime"))


def isolation_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.isolation_outliers(regime_vectors(spark, d), key="regime"))


def cleaning_log(spark: SparkSession, d: str) -> DataFrame:
    """What each detector of the chain removes per regime."""
    return cleaning.run_cleaning(regime_vectors(spark, d), ["isolation_forest", "pca", "mahalanobis"])[1]


def removal_check(spark: SparkSession, d: str) -> DataFrame:
    rows = regime_vectors(spark, d)
    return rounded(cleaning.removal_check(rows, cleaning.run_cleaning(rows, ["mahalanobis"])[0]))


def window_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the training windows by their mean vectors, numbered by their first mean."""
    rows = regime_vectors(spark, d).drop("regime")
    return models.regimes(rows).select("window_id", "regime")


def component_regimes(spark: SparkSession, d: str) -> DataFrame:
    rows = regime_vectors(spark, d).drop("regime").withColumn("plant", F.lit(1))
    return models.regimes_by_components(rows, key="plant").select("window_id", "regime")


def residual_statistics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.residual_statistics(scaled_rows(spark, d), SENSORS, F.expr("row_pos < floor(n_rows * 0.7D)")))


def network_windows(spark: SparkSession, d: str) -> DataFrame:
    """Window scores of a reconstruction network trained on the first 70 % of each machine's rows."""
    rows = scaled_rows(spark, d).withColumn("split", F.expr("CASE WHEN row_pos < floor(n_rows * 0.7D) THEN 'train' WHEN row_pos < floor(n_rows * 0.85D) THEN 'val' ELSE 'test' END"))
    net, _ = models.fit_network_everywhere(rows, SENSORS, latent=3)
    errors = models.network_errors(rows, SENSORS, net)
    return rounded(errors.groupBy(EQ, "window_id").agg(F.count("*").alias("n_rows"), F.percentile("row_error", 0.95).alias("score")))


def network_grid(spark: SparkSession, d: str) -> DataFrame:
    """As `scaled_rows`, but rows aren't put together by machine: a large one would hold up each epoch."""
    rows = window_rows(spark, d)
    rows = scaling.apply_scaling(rows, scaling.fit_robust(rows, SENSORS), SENSORS, 20.0, send=True).withColumn("split", F.expr("CASE WHEN row_pos < floor(n_rows * 0.7D) THEN 'train' WHEN row_pos < floor(n_rows * 0.85D) THEN 'val' ELSE 'test' END"))
    return rounded(models.grid_search(rows, SENSORS, epochs=50))


def legacy_network(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds of the earlier network (16, 8 and 4 wide): sensors' errors as ratios to those in training, the share
    of windows with more than a tenth of their sensors above each threshold, its knee and where it gets stable."""
    rows = scaled_rows(spark, d).withColumn("split", F.expr("CASE WHEN row_pos < floor(n_rows * 0.7D) THEN 'train' WHEN row_pos < floor(n_rows * 0.85D) THEN 'val' ELSE 'test' END"))
    net = models.Network(len(SENSORS), 4, [16, 8])
    models.fit_networks(rows, SENSORS, [net], [1e-3], epochs=50)
    errors = models.network_sensor_errors(rows, SENSORS, net)
    fitted = rows.where("split = 'train'").select(EQ, "window_id").distinct()
    base = scoring.baselines(errors.join(fitted, [EQ, "window_id"], "left_semi"))
    ratios = errors.join(base, [EQ, "sensor"]).select(EQ, "window_id", "sensor", (F.col("error") / F.greatest("baseline", F.lit(1e-10))).alias("ratio"))
    return rounded(limits.elbow(limits.anomaly_curve(ratios, [EQ], 10.0, 800.0, 10.0), [EQ]))


def mahalanobis_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per regime the mean squared distance of the rows that the covariance is of: sensors * (n - 1) / n."""
    far = models.mahalanobis_outliers(regime_vectors(spark, d), key="regime")
    return rounded(far.groupBy("regime").agg(F.count("*").alias("n"), F.avg(F.pow("distance", F.lit(2))).alias("mean_d2")), 3)


def component_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per regime the total variance: what the components' scores and the reconstruction errors hold together."""
    rows = regime_vectors(spark, d)
    scored_ = models.component_scores(rows, models.principal_components(models.moments(rows, "regime"), key="regime"), "regime")
    total = F.avg(models.dot(F.col("scores"), F.col("scores")) + N * F.col("error"))
    return rounded(scored_.groupBy("regime").agg(F.count("*").alias("n"), total.alias("variance")), 3)


def detector_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per regime the windows that the forest, the components, the clusters and the cleaning chain have seen."""
    rows = regime_vectors(spark, d)
    seen = {"isolation_forest": models.isolation_outliers(rows, key="regime"), "pca": models.pca_outliers(rows, key="regime"), "clusters": models.regimes(rows.withColumnRenamed("regime", "was")).withColumnRenamed("regime", "cluster").withColumnRenamed("was", "regime")}
    out = cleaning.run_cleaning(rows, ["pca", "mahalanobis"])[1].where("step_no = 1").select("regime", F.lit("cleaning").alias("detector"), F.col("n_before").alias("n_seen"))
    for name, df in seen.items():
        out = out.unionByName(df.groupBy("regime").agg(F.count("*").alias("n_seen")).select("regime", F.lit(name).alias("detector"), "n_seen"))
    return out


def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Variants of limits and flags against labelled events, each over all scoring runs."""

    def judged(config: dict) -> DataFrame:
        return with_truth(spark, d).select(EQ, "run_no", "score", "usable", "active")

    def limited(config: dict) -> DataFrame:
        t = stages.get(config, (), judged)
        return t.join(limits.percentile_limits(t, [EQ], "score", **config["limits"]).select(EQ, "green_yellow", "yellow_red"), EQ)

    def evaluate(config: dict, stages: ablation.Stages) -> DataFrame:
        rows = stages.get(config, ("limits",), limited)
        flagged = F.col("score") >= F.col("yellow_red" if config["flag"] == "red" else "green_yellow")
        found = metrics.pointwise(rows, ["run_no"], F.col("active"), flagged, F.col("usable") if config["usable_only"] else None)
        return found.select(F.col("run_no").alias("seed"), F.col("f1").alias("metric"))

    stages = ablation.Stages()
    base = {"limits": {"low": 90.0, "high": 99.0}, "flag": "any", "usable_only": True}
    variants = {"lower limit": (1, {"limits": {"low": 85.0}}), "higher limit": (1, {"limits": {"low": 95.0}}), "red only": (2, {"flag": "red"}), "unusable too": (3, {"usable_only": False})}
    return rounded(ablation.run_ablation(base, variants, evaluate, stages))


def synthetic_summary(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a synthetic plant by what was injected: an anomaly goes before a shutdown."""
    rows, events = synthetic_plant(spark, tags=8, days=10, seconds=60, shutdowns=2)
    spans = rows.select(EQ, F.expr("row_id div 120").alias("window_id")).distinct().select(EQ, "window_id", (F.col("window_id") * 120).alias("ls"), (F.col("window_id") * 120 + 120).alias("le"))
    named = event_sensor_names(events).select(F.lit("SYN-001").alias(EQ), "type", F.col("start_idx").alias("rs"), F.col("end_idx").alias("re"))
    met = truth.overlap_join(spans, named, [EQ], 1000, half_open=True)
    rank = F.max(F.when(F.col("type") == "shutdown", 1).otherwise(2))
    kinds = met.groupBy(EQ, "window_id").agg(rank.alias("k"))
    all_ = spans.join(kinds, [EQ, "window_id"], "left").withColumn("kind", F.expr("CASE k WHEN 2 THEN 'anomaly' WHEN 1 THEN 'shutdown' ELSE 'normal' END"))
    return all_.groupBy("kind").agg(F.count("*").alias("n_windows"))


def correlation_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(legacy.correlation_change(window_rows(spark, d), SENSORS, 48))


def plain_scaler(spark: SparkSession, d: str) -> DataFrame:
    return rounded(legacy.plain_scaler(window_rows(spark, d), SENSORS))


def legacy_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows left per machine by the earlier row filter."""
    rows, _ = legacy.cleaned_rows(window_rows(spark, d), F.col("sensor_00") > 50, SENSORS, 50.0, [])
    return rows.groupBy(EQ).agg(F.count("*").alias("n_rows"))


def time_holdout(spark: SparkSession, d: str) -> DataFrame:
    return legacy.time_holdout(window_rows(spark, d)).groupBy(EQ).agg(F.count_if("held_out").alias("n_held_out"), F.count("*").alias("n_rows"))


def wavelet_contamination(spark: SparkSession, d: str) -> DataFrame:
    return rounded(legacy.wavelet_contamination(window_rows(spark, d), SENSORS))


QUERIES = {
    f.__name__: f
    for f in (
        window_covariance, component_errors, latent_sizes, mahalanobis_windows, isolation_windows, cleaning_log, removal_check, window_regimes, component_regimes, residual_statistics,
        network_windows, network_grid, legacy_network, mahalanobis_summary, component_summary, detector_counts, ablation_grid, synthetic_summary, correlation_change, plain_scaler, legacy_rows, time_holdout, wavelet_contamination,
    )
}

_PAIRS = [(a, b) for i, a in enumerate(SENSORS) for b in SENSORS[i + 1 :]]


def _corr(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    return f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER ({both}) * stddev_pop({b}) FILTER ({both}), 0), 0)"


_F1 = "CASE WHEN tp > 0 THEN 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / (tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0)) END"
_VARIANTS = {"baseline": (0, "q90", "usable"), "lower limit": (1, "q85", "usable"), "higher limit": (1, "q95", "usable"), "red only": (2, "q99", "usable"), "unusable too": (3, "q90", "true")}

SQL = {
    "mahalanobis_summary": _VECTORS + f"SELECT regime, count(*) AS n, round({N} * (count(*) - 1) / count(*)::DOUBLE, 3) AS mean_d2 FROM v GROUP BY regime",
    "component_summary": _VECTORS + f"SELECT regime, count(*) AS n, round({' + '.join(f'var_pop(x[{i + 1}])' for i in range(N))}, 3) AS variance FROM v GROUP BY regime",
    "detector_counts": _VECTORS + "SELECT regime, detector, count(*) AS n_seen FROM v, (VALUES ('isolation_forest'), ('pca'), ('clusters'), ('cleaning')) AS k(detector) GROUP BY ALL",
    "ablation_grid": _TRUTH
    + f""", lim AS (SELECT equipment_id, quantile_cont(score, 0.85) AS q85, quantile_cont(score, 0.9) AS q90, quantile_cont(score, 0.95) AS q95, quantile_cont(score, 0.99) AS q99 FROM s GROUP BY ALL),
e AS (SELECT t.*, q85, q90, q95, q99 FROM t JOIN lim USING (equipment_id)),
u AS ({" UNION ALL ".join(f"SELECT {tier} AS tier, '{name}' AS variant, run_no, active, coalesce(score >= {q}, false) AS f FROM e WHERE {which}" for name, (tier, q, which) in _VARIANTS.items())}),
c AS (SELECT tier, variant, run_no, count(*) FILTER (active AND f) AS tp, count(*) FILTER (NOT active AND f) AS fp, count(*) FILTER (active AND NOT f) AS fn FROM u GROUP BY ALL),
v AS (SELECT tier, variant, count(*) AS n, avg({_F1}) AS mean, stddev_samp({_F1}) AS std FROM c GROUP BY ALL), b AS (SELECT mean AS bm, coalesce(std, 0) AS bs FROM v WHERE variant = 'baseline')
SELECT tier, variant, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - bm, 6) AS gain, CASE WHEN variant = 'baseline' THEN 'base' WHEN abs(mean - bm) <= 2 * bs THEN 'noise' WHEN mean > bm THEN 'better' ELSE 'worse' END AS verdict FROM v LEFT JOIN b ON true""",
    "window_covariance": _VECTORS
    + " UNION ALL ".join(
        f"SELECT regime, count(*) AS n, {i} AS i, CAST({j} AS INTEGER) AS j, round(covar_samp(x[{i + 1}], x[{j + 1}]), 4) AS cov FROM v GROUP BY regime" for i in range(N) for j in range(N)
    ),
    "residual_statistics": SCALED
    + """, st AS (SELECT z.equipment_id, sensor, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM z JOIN (SELECT DISTINCT equipment_id, n_rows FROM placed) USING (equipment_id) WHERE row_pos < floor(n_rows * 0.7::DOUBLE) GROUP BY ALL),
zz AS (SELECT equipment_id, window_id, row_in_window, sensor, x * x AS r2, (x - m) / sd AS zs FROM z JOIN st USING (equipment_id, sensor)),
r AS (SELECT equipment_id, window_id, row_in_window, avg(r2) AS r2, avg(zs * zs) AS z2, max(abs(zs)) AS mz, last(sensor ORDER BY abs(zs), sensor) FILTER (zs IS NOT NULL) AS top FROM zz GROUP BY ALL)
SELECT equipment_id, window_id, round(avg(r2), 6) AS mse, round(avg(z2), 6) AS mean_z2, round(max(mz), 6) AS max_z, last(top ORDER BY mz, top) FILTER (mz IS NOT NULL) AS top_sensor FROM r GROUP BY ALL""",
    "correlation_change": ROWS
    + f""", c AS (SELECT equipment_id, us // 172800000000 AS period, count(*) AS n_rows, {", ".join(f"{_corr(a, b)} AS c{k}" for k, (a, b) in enumerate(_PAIRS))} FROM win GROUP BY ALL),
l AS (SELECT *, lag(period) OVER o AS before, {", ".join(f"lag(c{k}) OVER o AS l{k}" for k in range(len(_PAIRS)))} FROM c WINDOW o AS (PARTITION BY equipment_id ORDER BY period))
SELECT equipment_id, period, n_rows, round(CASE WHEN before IS NOT NULL THEN sqrt(2 * ({" + ".join(f"(c{k} - l{k}) ** 2" for k in range(len(_PAIRS)))})) END, 6) AS change FROM l""",
    "plain_scaler": ROWS + "SELECT equipment_id, sensor, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM long GROUP BY ALL",
    "legacy_rows": ROWS
    + f""", running AS (SELECT * FROM win WHERE sensor_00 > 50),
share AS (SELECT {", ".join(f"avg(CASE WHEN {s} IS NULL THEN 100.0 ELSE 0 END) AS p_{s}" for s in SENSORS)} FROM running),
kept AS (SELECT equipment_id, {", ".join(f"CASE WHEN p_{s} <= 50 THEN {s} END AS {s}" for s in SENSORS)} FROM running, share WHERE {" AND ".join(f"(p_{s} > 50 OR {s} IS NOT NULL)" for s in SENSORS)})
SELECT equipment_id, count(*) AS n_rows FROM (SELECT DISTINCT * FROM kept) GROUP BY ALL""",
    "time_holdout": ROWS + ", q AS (SELECT equipment_id, quantile_cont(us::DOUBLE, 0.8) AS c FROM win GROUP BY ALL) SELECT equipment_id, count(*) FILTER (us > c) AS n_held_out, count(*) AS n_rows FROM win JOIN q USING (equipment_id) GROUP BY ALL",
}
