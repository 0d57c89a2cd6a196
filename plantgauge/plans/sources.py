"""Queries that go through the readers and writers: what is written comes back as it was, compared with SQL over the
original tables; and the operators on columns and keys that stand between a file and an analysis."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns, models, scaling, truth
from ..session import shared_folder, table
from ..sources import files
from .base import EQ, ROWS, SCALED, SCORED, SENSORS, SERIES, labels, rounded, scored, window_rows

#: Sensors that the labels name, or that a table of the plant's rows would have.
NAMED = tuple(SENSORS)


def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Window scores written as CSV, lists joined by commas, and read with a schema."""
    path = shared_folder(spark, "scores") + ".csv"
    kept = scored(spark, d).select("window_id", *SERIES, "window_start", "score", "zone", "top_sensors")
    files.write_scores(kept, path)
    back = files.read_table(spark, path, "window_start", schema="window_id long, equipment_id string, run_no long, window_start timestamp, score double, zone string, top_sensors string")
    named = F.when(F.coalesce(F.length("top_sensors"), F.lit(0)) > 0, F.size(F.split("top_sensors", ","))).otherwise(0)
    return rounded(back.groupBy(*SERIES, "zone").agg(F.count("*").alias("n_windows"), F.count("score").alias("n_scores"), F.sum("score").alias("total"), F.min("window_start").alias("first_start"), F.sum(named).alias("n_named")))


def list_columns(spark: SparkSession, d: str) -> DataFrame:
    """Parquet with lists: how often each node is active, of rows delivered once."""
    rows = files.read_table(spark, os.path.join(d, "combined.parquet"))
    once = rows.where("row_id IS NOT NULL").groupBy("row_id", EQ).agg(F.max("active_node_ids").alias("nodes"))
    return once.select(EQ, F.explode("nodes").alias("node_id")).groupBy(EQ, "node_id").agg(F.count("*").alias("n_rows"))


def timestamped_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table whose time column has another name: first, last and missing times."""
    rows = files.read_table(spark, os.path.join(d, "event_labels.parquet"), "when", renamed_from="start_time")
    return rows.groupBy(F.col("equipment_tag").alias(EQ)).agg(F.count("*").alias("n_rows"), F.count_if(F.col("when").isNull()).alias("n_without"), F.min("when").alias("first_time"), F.max("when").alias("last_time"))


def saved_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of rows written as arrays and read back."""
    path = shared_folder(spark, "windows")
    files.write_windows(window_rows(spark, d), path, SENSORS)
    back = files.read_windows(spark, path, SENSORS)
    means = [F.struct(F.lit(s).alias("sensor"), F.count(s).alias("n"), F.round(F.avg(s), 3).alias("mean")).alias(s) for s in SENSORS]
    return back.groupBy(EQ, "window_id").agg(*means).select(EQ, "window_id", F.inline(F.array(*SENSORS)))


def saved_scaler(spark: SparkSession, d: str) -> DataFrame:
    """A fitted scaler saved with its metadata, loaded again."""
    path = shared_folder(spark, "model")
    files.save_artefacts(path, {"sensors": SENSORS, "train_pct": 0.7}, scaler=scaling.fit_robust(window_rows(spark, d), SENSORS))
    metadata, tables = files.load_artefacts(spark, path)
    return rounded(tables["scaler"].where(F.col("sensor").isin(metadata["sensors"])))


def score_sink(spark: SparkSession, d: str) -> DataFrame:
    """Window scores written as Parquet and read back."""
    path = shared_folder(spark, "scores")
    files.write_scores(scored(spark, d), path)
    return rounded(spark.read.parquet(path).select("window_id", *SERIES, "pos", "score", "zone", "top_sensors"))


def report_sink(spark: SparkSession, d: str) -> DataFrame:
    """Counts per zone and regime written as JSON lines and read back."""
    path = shared_folder(spark, "report")
    files.write_report(scored(spark, d).groupBy("labels", "zone").agg(F.count("*").alias("n_windows"), F.avg("score").alias("mean_score")), path, 9)
    return spark.read.schema("labels int, zone string, n_windows long, mean_score double").json(path)


def health_log(spark: SparkSession, d: str) -> DataFrame:
    """Weekly figures of each machine, logged twice; the log holds both runs."""
    path = shared_folder(spark, "health")
    s = scored(spark, d).withColumn("week_start", F.date_format(F.date_trunc("week", "window_start"), "yyyy-MM-dd"))
    zones = [F.count_if(F.col("zone") == z).alias(z) for z in ("green", "yellow", "red")]
    weekly = s.groupBy(EQ, "week_start").agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), *zones)
    for _ in range(2):
        files.append_health(weekly, path)
    logged = files.read_health(spark, path).groupBy(EQ, "week_start").agg(F.count("*").alias("n_logged"), *[F.max(c).alias(c) for c in ("mean_score", "max_score", "min_score", "green", "yellow", "red")])
    return rounded(logged, 9)


def label_export(spark: SparkSession, d: str) -> DataFrame:
    """The index of the flagged windows that were written with their rows for labelling."""
    rows = window_rows(spark, d)
    zones = F.expr("CASE WHEN window_id % 7 = 0 THEN 'red' WHEN window_id % 5 = 0 THEN 'yellow' ELSE 'green' END")
    windows = rows.groupBy(EQ, "window_id").agg(F.round(F.avg("sensor_00"), 6).alias("score"), F.count("sensor_00").alias("_n")).select(EQ, "window_id", "score", zones.alias("zone"), (F.col("_n") >= 60).alias("usable"))
    path = shared_folder(spark, "labelling")
    files.export_windows(windows, rows, SENSORS, path)
    packed = spark.read.text(os.path.join(path, "windows")).select(EQ, "window_id", F.from_json("value", "score double, zone string, rows array<struct<row_in_window: int>>").alias("w"))
    index = spark.read.schema("equipment_id string, window_id long, score double, zone string").json(os.path.join(path, "index"))
    return index.join(packed.select(EQ, F.col("window_id").cast("long").alias("window_id"), F.size("w.rows").alias("n_rows")), [EQ, "window_id"])


def cleaning_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of what cleaning left per regime, written and read back: its table cells."""
    rows = table(spark, d, "cleaned_windows").where("record_id IS NOT NULL").groupBy("cleaned_regime_labels").agg(F.countDistinct("record_id").alias("n_windows"))
    path = shared_folder(spark, "page")
    files.write_page(spark, path, "Cleaning", {"Windows by regime": rows.orderBy("cleaned_regime_labels")})
    found = F.regexp_extract_all("value", F.lit("<tr><td>([^<]*)</td><td>([^<]*)</td></tr>"), F.lit(1)), F.regexp_extract_all("value", F.lit("<tr><td>([^<]*)</td><td>([^<]*)</td></tr>"), F.lit(2))
    return spark.read.text(path).select(F.inline(F.arrays_zip(found[0].alias("regime"), found[1].alias("n_windows"))))


def detected_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the plant's rows that are sensors by kind, and what the schema lacks of a fuller list."""
    rows = table(spark, d, "combined")
    found = columns.sensor_columns(rows, exclude=("row_id", "export_id", "n_active_nodes"))
    errors = columns.validate(rows, expected=(*NAMED, "sensor_99", "equipment_id"))
    return spark.createDataFrame([("sensor", c) for c in found] + [("error", e) for e in errors], "kind string, name string")


def event_sensors(spark: SparkSession, d: str) -> DataFrame:
    """The sensors of the plant's rows that any event names."""
    rows = table(spark, d, "combined")
    kept = columns.restrict_to_event_sensors(columns.sensor_columns(rows), labels(spark, d))
    return columns.event_sensors(labels(spark, d)).where(F.col("sensor").isin(kept))


def aligned_windows(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned windows joined to what is known of their regimes, by keys that all have to be found."""
    once = table(spark, d, "cleaned_windows").where("record_id IS NOT NULL AND cleaned_regime_labels IS NOT NULL").select("record_id", EQ, "cleaned_regime_labels").distinct()
    sizes = once.groupBy(EQ, "cleaned_regime_labels").agg(F.count("*").alias("n_alike"))
    return truth.aligned_rows(once, sizes, [EQ, "cleaned_regime_labels"])


def trimmed_scores(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each machine's scores without the worst two percent."""
    kept = models.trimmed(scored(spark, d).where("score IS NOT NULL"), "score", 2.0)
    return rounded(kept.groupBy(EQ).agg(F.count("*").alias("n_kept"), F.max("score").alias("most"), F.avg("score").alias("mean_score")))


QUERIES = {
    f.__name__: f
    for f in (csv_scan, list_columns, timestamped_scan, saved_windows, saved_scaler, score_sink, report_sink, health_log, label_export, cleaning_page, detected_columns, event_sensors, aligned_windows, trimmed_scores)
}

_CLEAN = "(SELECT DISTINCT record_id, equipment_id, cleaned_regime_labels FROM cleaned_windows WHERE record_id IS NOT NULL AND cleaned_regime_labels IS NOT NULL)"
SQL = {
    "csv_scan": SCORED
    + "SELECT equipment_id, run_no, zone, count(*) AS n_windows, count(score) AS n_scores, round(sum(score), 6) AS total, min(window_start) AS first_start, CAST(sum(coalesce(len(top_sensors), 0)) AS BIGINT) AS n_named FROM p GROUP BY ALL",
    "list_columns": "WITH once AS (SELECT row_id, equipment_id, max(active_node_ids) AS nodes FROM combined WHERE row_id IS NOT NULL GROUP BY ALL) SELECT equipment_id, node_id, count(*) AS n_rows FROM (SELECT equipment_id, unnest(nodes) AS node_id FROM once) GROUP BY ALL",
    "timestamped_scan": "SELECT equipment_tag AS equipment_id, count(*) AS n_rows, count(*) FILTER (start_time IS NULL) AS n_without, min(start_time) AS first_time, max(start_time) AS last_time FROM event_labels GROUP BY ALL",
    "saved_windows": ROWS + "SELECT equipment_id, window_id, sensor, count(value) AS n, round(avg(CAST(CAST(value AS FLOAT) AS DOUBLE)), 3) AS mean FROM long GROUP BY ALL",
    "saved_scaler": SCALED + "SELECT equipment_id, sensor, round(center, 6) AS center, round(scale, 6) AS scale FROM scaler",
    "score_sink": SCORED + "SELECT window_id, equipment_id, run_no, pos, round(score, 6) AS score, zone, top_sensors FROM p",
    "report_sink": SCORED + "SELECT labels, zone, count(*) AS n_windows, round(avg(score), 9) AS mean_score FROM p GROUP BY ALL",
    "health_log": SCORED
    + """SELECT equipment_id, strftime(date_trunc('week', window_start), '%Y-%m-%d') AS week_start, CAST(2 AS BIGINT) AS n_logged, round(avg(score), 9) AS mean_score, round(max(score), 9) AS max_score,
  round(min(score), 9) AS min_score, count(*) FILTER (zone = 'green') AS green, count(*) FILTER (zone = 'yellow') AS yellow, count(*) FILTER (zone = 'red') AS red FROM p GROUP BY ALL""",
    "label_export": ROWS
    + """, w AS (SELECT equipment_id, window_id, round(avg(sensor_00), 6) AS score, count(sensor_00) AS n, count(*) AS n_rows FROM win GROUP BY ALL)
SELECT equipment_id, window_id, score, CASE WHEN window_id % 7 = 0 THEN 'red' ELSE 'yellow' END AS zone, CAST(n_rows AS INTEGER) AS n_rows FROM w WHERE n >= 60 AND (window_id % 7 = 0 OR window_id % 5 = 0)""",
    "cleaning_page": "SELECT coalesce(CAST(cleaned_regime_labels AS VARCHAR), '') AS regime, CAST(count(DISTINCT record_id) AS VARCHAR) AS n_windows FROM cleaned_windows WHERE record_id IS NOT NULL GROUP BY cleaned_regime_labels",
    "detected_columns": """SELECT 'sensor' AS kind, column_name AS name FROM (DESCRIBE combined) WHERE column_type = 'DOUBLE'
UNION ALL VALUES ('error', 'Missing sensor column: sensor_99'), ('error', 'Not numeric: equipment_id (string)')""",
    "event_sensors": f"SELECT DISTINCT sensor FROM (SELECT unnest(sensors) AS sensor FROM event_labels WHERE node_id IS NOT NULL AND start_time IS NOT NULL AND end_time >= start_time) WHERE sensor IN ({', '.join(repr(s) for s in SENSORS)})",
    "aligned_windows": f"WITH once AS {_CLEAN} SELECT record_id, equipment_id, cleaned_regime_labels, count(*) OVER (PARTITION BY equipment_id, cleaned_regime_labels) AS n_alike FROM once",
    "trimmed_scores": SCORED
    + ", q AS (SELECT equipment_id, quantile_cont(score, 0.98) AS c FROM s WHERE score IS NOT NULL GROUP BY ALL) SELECT equipment_id, count(*) AS n_kept, round(max(score), 6) AS most, round(avg(score), 6) AS mean_score FROM s JOIN q USING (equipment_id) WHERE score <= c GROUP BY ALL",
}
