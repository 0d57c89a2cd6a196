"""Tables that the reference queries start from, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import finite_table
from ..operators.truth import clean_labels
from ..operators.windows import row_positions, windowed
from ..session import micros, table

SENSORS = [f"sensor_{i:02d}" for i in range(10)]
EQ = "equipment_id"
SERIES = [EQ, "run_no"]
MONTH_US = 31 * 86_400_000_000


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def sensor_rows(spark: SparkSession, d: str) -> DataFrame:
    """Historian rows, each delivered once, within the range of their export; non-finite values are null."""
    c, x = table(spark, d, "combined"), table(spark, d, "exports")
    rows = c.select("row_id", "export_id", EQ, "timestamp", micros(c, "timestamp").alias("us"), "n_active_nodes", *SENSORS).where("us IS NOT NULL")
    ranges = x.select("export_id", micros(x, "range_start").alias("r0"), micros(x, "range_end").alias("r1"))
    inside = finite_table(rows.join(ranges, "export_id").where("us >= r0 AND us < r1"), SENSORS)
    # copies agree but for their arrival; grouped by what identifies a row, hashed and combined map-side
    return inside.groupBy("row_id", EQ, "timestamp", "us", "n_active_nodes").agg(*[F.max(s).alias(s) for s in SENSORS])


def window_rows(spark: SparkSession, d: str) -> DataFrame:
    return windowed(sensor_rows(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Window scores, each window once, with pos in its run of scoring; NaN is null, a zone that is missing green."""
    w = table(spark, d, "window_scores")
    once = w.where("window_id IS NOT NULL").select("window_id", *SERIES, "window_start", "window_end", F.when(F.isnan("window_score"), None).otherwise(F.col("window_score")).alias("score"), "labels", F.coalesce("zone", F.lit("green")).alias("zone"), "usable", "top_sensors", "quality_flags").dropDuplicates(["window_id"])
    return row_positions(once, "window_start", "window_id", SERIES, MONTH_US).withColumnRenamed("row_pos", "pos").drop("n_rows")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return clean_labels(table(spark, d, "event_labels"))


_FINITE = ", ".join(f"CASE WHEN isfinite(c.{s}) THEN c.{s} END AS {s}" for s in SENSORS)
_ALL = ", ".join(SENSORS)
ROWS = f"""
WITH once AS (
  SELECT DISTINCT c.row_id, c.equipment_id, c.timestamp, epoch_us(c.timestamp) AS us, c.n_active_nodes, {_FINITE}
  FROM combined c JOIN exports x USING (export_id) WHERE c.timestamp >= x.range_start AND c.timestamp < x.range_end),
placed AS (SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY timestamp, row_id) - 1 AS row_pos, count(*) OVER (PARTITION BY equipment_id) AS n_rows FROM once),
win AS (SELECT *, row_pos // 120 AS window_id, row_pos % 120 AS row_in_window FROM placed WHERE row_pos < n_rows // 120 * 120),
long AS (SELECT equipment_id, window_id, row_in_window, row_pos, us, sensor, value FROM win UNPIVOT INCLUDE NULLS (value FOR sensor IN ({_ALL})))
"""
SCALED = (
    ROWS
    + """,
scaler AS (
  SELECT equipment_id, sensor, coalesce(quantile_cont(value, 0.5), 0) AS center,
    CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 0 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1 END AS scale
  FROM long JOIN (SELECT DISTINCT equipment_id, n_rows FROM placed) USING (equipment_id) WHERE row_pos < floor(n_rows * 0.7::DOUBLE) GROUP BY ALL),
z AS (SELECT l.*, 20 * asinh((value - center) / scale / 20) AS x FROM long l LEFT JOIN scaler USING (equipment_id, sensor)),
row_err AS (SELECT equipment_id, window_id, row_in_window, avg(x * x) AS e FROM z GROUP BY ALL),
score AS (SELECT equipment_id, window_id, quantile_cont(e, 0.95) AS score FROM row_err GROUP BY ALL),
err AS (SELECT equipment_id, window_id, sensor, avg(x * x) AS error FROM z GROUP BY ALL)
"""
)
SCORED = """
WITH s AS (
  SELECT DISTINCT window_id, run_no, equipment_id, window_start, window_end, CASE WHEN NOT isnan(window_score) THEN window_score END AS score, labels,
    coalesce(zone, 'green') AS zone, usable, top_sensors, quality_flags FROM window_scores),
p AS (SELECT *, row_number() OVER (PARTITION BY equipment_id, run_no ORDER BY window_start, window_id) - 1 AS pos FROM s)
"""
ALERTED = (
    SCORED
    + """,
streak AS (
  SELECT *, pos - coalesce(max(CASE WHEN zone <> 'red' THEN pos END) OVER o, -1) AS cr, pos - coalesce(max(CASE WHEN zone <> 'yellow' THEN pos END) OVER o, -1) AS cy,
    sum(CASE WHEN zone = 'red' THEN 1 ELSE 0 END) OVER k AS r, sum(CASE WHEN zone = 'yellow' THEN 1 ELSE 0 END) OVER k AS y
  FROM p WINDOW o AS (PARTITION BY equipment_id, run_no ORDER BY pos), k AS (PARTITION BY equipment_id, run_no ORDER BY pos ROWS 5 PRECEDING)),
alert AS (SELECT *, CASE WHEN cr >= 3 THEN 'red' WHEN cr >= 2 OR cy >= 4 OR (r >= 1 AND y >= 1 AND 2 * r + y >= 4) THEN 'yellow' ELSE 'green' END AS alert_level FROM streak),
isle AS (SELECT *, pos - row_number() OVER (PARTITION BY equipment_id, run_no ORDER BY pos) AS g FROM alert WHERE alert_level <> 'green'),
episode AS (
  SELECT equipment_id, run_no, min(pos) AS start_window_idx, max(pos) AS end_window_idx, min(window_start) AS start_time, max(window_end) AS end_time,
    CASE WHEN max(CASE alert_level WHEN 'red' THEN 2 ELSE 1 END) = 2 THEN 'red' ELSE 'yellow' END AS peak_level, count(*) AS n_windows FROM isle GROUP BY equipment_id, run_no, g)
"""
)
LABELS = """
lab AS (
  SELECT DISTINCT label_id, node_id, equipment_tag AS equipment_id, epoch_us(start_time) AS s, epoch_us(end_time) AS e, rule_slug, severity, sensors
  FROM event_labels WHERE node_id IS NOT NULL AND start_time IS NOT NULL AND end_time >= start_time),
node AS (
  SELECT equipment_id, node_id, first(rule_slug ORDER BY s, label_id) AS slug, max(severity) AS severity, min(s) AS s, max(e) AS e FROM lab GROUP BY ALL)
"""
