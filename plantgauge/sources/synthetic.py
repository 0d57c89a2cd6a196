"""A synthetic plant: a load cycle, groups of sensors that follow it, drift, shutdowns and injected anomalies."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_plant(spark: SparkSession, tags: int = 160, days: int = 240, seconds: int = 15, start: str = "2025-01-01", anomaly_pct: float = 3.0, shutdowns: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(table, events): the table has row_id, equipment_id, timestamp and tag_001 ...; events has type, start_idx,
    end_idx (half-open row ranges) and sensors (0-based).

    Every row is computed from its number, so any size is made in parallel. Same distribution, not the same bits, at
    another partitioning.
    """
    n = days * 86_400 // seconds
    stop = n // max(shutdowns * 20, 1)
    bad = max(1, int(n * anomaly_pct / 100 / 200))
    length = 200
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    part = F.col("row_id") * float(seconds) / 86_400
    load = 0.7 + 0.2 * F.sin(2 * math.pi * part) + 0.1 * F.sin(2 * math.pi * part / 7)
    shutdown_at = [(i + 1) * n // (shutdowns + 1) for i in range(shutdowns)]
    down = F.lit(False)
    for s in shutdown_at:
        down = down | F.col("row_id").between(s, s + stop - 1)
    # anomalies start at places spread evenly over the rows, each on three neighbouring sensors
    events = [("shutdown", s, s + stop, list(range(tags))) for s in shutdown_at]
    for i in range(bad):
        a = (2 * i + 1) * n // (2 * bad)
        events.append((("spike", "drift")[i % 2], a, min(a + length, n), [(i * 7 + j) % tags for j in range(min(3, tags))]))
    which = F.floor(F.col("row_id") * bad / n)
    begin = F.floor((2 * which + 1) * n / (2 * bad))
    inside = F.col("row_id").between(begin, begin + length - 1)
    rows = rows.withColumns({"_load": F.when(down, 0.0).otherwise(load), "_i": which, "_in": inside, "_at": (F.col("row_id") - begin) / length})
    columns = {}
    for t in range(tags):
        group, gain = t % 8, 5 + (t * 37 % 40)
        value = 50.0 + gain * F.col("_load") + 0.5 * group + F.col("row_id") / n * (t % 5) + F.randn(seed + t)
        hit = F.col("_in") & (F.pmod(F.lit(t) - F.col("_i") * 7, F.lit(tags)) < min(3, tags))
        columns[f"tag_{t + 1:03d}"] = F.when(hit, value + F.when(F.col("_i") % 2 == 0, 40.0).otherwise(30 * F.col("_at"))).otherwise(value).cast("double")
    time = F.timestamp_seconds(F.unix_timestamp(F.lit(start), "yyyy-MM-dd") + F.col("row_id") * seconds)
    table = rows.withColumn("timestamp", time).withColumn("equipment_id", F.lit("SYN-001")).withColumns(columns)
    return table.select("row_id", "equipment_id", "timestamp", *columns), spark.createDataFrame(events, "type string, start_idx long, end_idx long, sensors array<int>")


def event_sensor_names(events: DataFrame) -> DataFrame:
    """`events` with the sensors' names: index i is tag_{i + 1}, three digits."""
    return events.withColumn("sensors", F.transform("sensors", lambda i: F.format_string("tag_%03d", i + 1)))
