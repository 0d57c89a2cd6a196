"""Queries p2, p3 and p6: implausible measurements, regular grids, continuous periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.periods import periods_and_gaps
from ..operators.regrid import empty_slots, regular_grid
from ..operators.spikes import implausible
from ..session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "filter_results")).select("result_id", "field")


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of implausible values per source, field and reason."""
    return implausible(table(spark, d, "filter_results")).groupBy("equipment_id", "sensor", "field", "reason").agg(F.count("*").alias("n_values"))


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """One value per sensor, export and grid slot, with the slot's state."""
    return regular_grid(table(spark, d, "combined"), table(spark, d, "exports")).withColumn("slot_start", F.timestamp_micros("slot_start_us")).drop("slot_start_us")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return empty_slots(regular_grid(table(spark, d, "combined"), table(spark, d, "exports")))


def p3_slots(spark: SparkSession, d: str) -> DataFrame:
    """Per export and slot when it begins and the number of readings in it."""
    grid = regular_grid(table(spark, d, "combined"), table(spark, d, "exports"))
    return grid.select("export_id", "slot_no", "slot_start_us", "n_readings")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = periods_and_gaps(table(spark, d, "event_labels"))
    return found.select("node_id", "kind", F.expr("start_us div 1000000").alias("start_s"), F.expr("end_us div 1000000").alias("end_s"))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per node the number of periods and gaps and the seconds that they cover."""
    length = F.expr("(end_us - start_us) div 1000000")
    return periods_and_gaps(table(spark, d, "event_labels")).groupBy("node_id").agg(
        F.count_if(F.col("kind") == "period").alias("n_periods"),
        F.count_if(F.col("kind") == "gap").alias("n_gaps"),
        F.sum(F.when(F.col("kind") == "period", length).otherwise(0)).alias("covered_s"),
        F.sum(F.when(F.col("kind") == "gap", length).otherwise(0)).alias("gap_s"),
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_reasons, p3_grid, p3_found, p3_slots, p6_found, p6_coverage)}

_PERIODS = """
WITH clean AS (
  SELECT DISTINCT node_id, epoch_us(start_time) AS s, epoch_us(end_time) AS e FROM event_labels
  WHERE node_id IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL AND end_time >= start_time),
top AS (SELECT *, max(e) OVER (PARTITION BY node_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM clean),
isle AS (SELECT *, sum(CASE WHEN t IS NULL OR s > t THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM top),
period AS (SELECT node_id, k, min(s) AS s, max(e) AS e FROM isle GROUP BY node_id, k),
gap AS (SELECT node_id, lag(e) OVER (PARTITION BY node_id ORDER BY s) AS s, s AS e FROM period),
both_kinds AS (SELECT node_id, 'period' AS kind, s, e FROM period UNION ALL SELECT node_id, 'gap', s, e FROM gap WHERE s IS NOT NULL)
"""

SQL = {
    "p3_found": """
WITH slots AS (
  SELECT export_id, unnest(range(CAST(ceil((epoch_us(range_end) - epoch_us(range_start)) / (frequency_seconds * 1000000.0)) AS BIGINT))) AS slot_no FROM exports),
held AS (
  SELECT DISTINCT c.export_id, (epoch_us(c.timestamp) - epoch_us(x.range_start)) // (x.frequency_seconds * 1000000) AS slot_no
  FROM combined c JOIN exports x USING (export_id) WHERE c.timestamp >= x.range_start AND c.timestamp < x.range_end)
SELECT export_id, slot_no FROM slots ANTI JOIN held USING (export_id, slot_no)""",
    "p3_slots": """
WITH slots AS (
  SELECT export_id, epoch_us(range_start) AS r0, frequency_seconds * 1000000 AS step, unnest(range(CAST(ceil((epoch_us(range_end) - epoch_us(range_start)) / (frequency_seconds * 1000000.0)) AS BIGINT))) AS slot_no FROM exports),
held AS (
  SELECT export_id, slot_no, count(*) AS n FROM (
    SELECT DISTINCT c.export_id, c.row_id, c.timestamp, (epoch_us(c.timestamp) - epoch_us(x.range_start)) // (x.frequency_seconds * 1000000) AS slot_no
    FROM combined c JOIN exports x USING (export_id) WHERE c.timestamp >= x.range_start AND c.timestamp < x.range_end) GROUP BY ALL)
SELECT export_id, slot_no, r0 + slot_no * step AS slot_start_us, coalesce(n, 0) AS n_readings FROM slots LEFT JOIN held USING (export_id, slot_no)""",
    "p6_found": _PERIODS + "SELECT node_id, kind, s // 1000000 AS start_s, e // 1000000 AS end_s FROM both_kinds",
    "p6_coverage": _PERIODS
    + """SELECT node_id, count(*) FILTER (kind = 'period') AS n_periods, count(*) FILTER (kind = 'gap') AS n_gaps,
  CAST(sum(CASE WHEN kind = 'period' THEN (e - s) // 1000000 ELSE 0 END) AS BIGINT) AS covered_s,
  CAST(sum(CASE WHEN kind = 'gap' THEN (e - s) // 1000000 ELSE 0 END) AS BIGINT) AS gap_s FROM both_kinds GROUP BY node_id""",
}
