"""Sensor columns: which there are, which are kept, and their clean values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import finite
from .windows import KEY

#: Fixed value: the historian's sentinel for a failed reading, compared after a cast to float.
SENTINEL = 1709896.75


def sensor_columns(df: DataFrame, timestamp: str = "timestamp", exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric and boolean columns but for the timestamp and the excluded, sorted."""
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name != timestamp and f.name not in exclude)


def validate(df: DataFrame, timestamp: str = "timestamp", expected: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with the schema: no timestamp, missing sensors, sensors that aren't numeric."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    errors = [] if timestamp in kinds else [f"Missing timestamp column: {timestamp}"]
    errors += [f"Missing sensor column: {s}" for s in expected if s not in kinds]
    errors += [f"Not numeric: {s} ({kinds[s].simpleString()})" for s in expected if s in kinds and not isinstance(kinds[s], (T.NumericType, T.BooleanType))]
    return errors


def finite_table(df: DataFrame, sensors: list[str], sentinel: float | None = None) -> DataFrame:
    """NaN, infinite and (if given) sentinel values as null; all sensors as double."""
    out = {}
    for s in sensors:
        c = finite(F.col(s))
        out[s] = c if sentinel is None else F.when(c.cast("float") == F.lit(sentinel).cast("float"), None).otherwise(c)
    return df.withColumns(out)


def non_finite_counts(df: DataFrame, sensors: list[str]) -> DataFrame:
    """(sensor, n_non_finite, n_null) in one pass."""
    parts = [F.struct(F.lit(s).alias("sensor"), F.count_if(F.isnan(s) | (F.abs(s) == float("inf"))).alias("n_non_finite"), F.count_if(F.col(s).isNull()).alias("n_null")).alias(s) for s in sensors]
    return df.agg(*parts).select(F.inline(F.array(*sensors)))


def low_variance(df: DataFrame, sensors: list[str], threshold: float = 1e-5, key: str = KEY) -> DataFrame:
    """(key, sensor, variance, dropped): sample variance at or below the threshold drops; no variance keeps."""
    parts = [F.struct(F.lit(s).alias("sensor"), F.var_samp(s).alias("variance")).alias(s) for s in sensors]
    stats = df.groupBy(key).agg(*parts).select(key, F.inline(F.array(*sensors)))
    return stats.withColumn("dropped", F.coalesce(F.col("variance") <= float(threshold), F.lit(False)))


def null_or_stuck(rows: DataFrame, sensors: list[str], max_null_pct: float = 50.0, max_stuck_pct: float = 100.0, atol: float = 1e-9, key: str = KEY) -> DataFrame:
    """(key, sensor, n_windows, null_pct, stuck_pct, kept): shares of complete windows with any null, and of those
    that don't move by more than `atol` (all-null windows don't move)."""
    packed = [F.struct(F.lit(s).alias("sensor"), F.max(F.col(s).isNull().cast("int")).alias("null"), (F.coalesce(F.max(s) - F.min(s), F.lit(0.0)) <= atol).cast("int").alias("stuck")).alias(f"_{s}") for s in sensors]
    each = rows.groupBy(key, "window_id").agg(*packed).select(key, F.inline(F.array(*[f"_{s}" for s in sensors])))
    pct = each.groupBy(key, "sensor").agg(F.count("*").alias("n_windows"), (F.avg("null") * 100).alias("null_pct"), (F.avg("stuck") * 100).alias("stuck_pct"))
    return pct.withColumn("kept", (F.col("null_pct") <= max_null_pct) & (F.col("stuck_pct") <= max_stuck_pct))


def event_sensors(labels: DataFrame, equipment: str | None = None) -> DataFrame:
    """(sensor): the sensors that any event names, of one equipment if given."""
    rows = labels if equipment is None else labels.where(F.col("equipment_tag") == equipment)
    return rows.select(F.explode("sensors").alias("sensor")).where("sensor IS NOT NULL").distinct()


def restrict_to_event_sensors(columns: list[str], labels: DataFrame, equipment: str | None = None) -> list[str]:
    """The columns that an event names; an error if the equipment has no event or nothing is left.

    The driver holds at most as many names as there are columns.
    """
    if equipment is not None and labels.where(F.col("equipment_tag") == equipment).isEmpty():
        raise ValueError(f"no event of {equipment}")
    kept = {r.sensor for r in event_sensors(labels, equipment).where(F.col("sensor").isin(columns)).collect()}
    if not kept:
        raise ValueError("no column is named by an event")
    return [c for c in columns if c in kept]


def sparse_columns(df: DataFrame, sensors: list[str], max_null_pct: float = 50.0, key: str = KEY) -> DataFrame:
    """(key, sensor, null_pct, dropped) over all rows."""
    parts = [F.struct(F.lit(s).alias("sensor"), (F.avg(F.col(s).isNull().cast("int")) * 100).alias("null_pct")).alias(s) for s in sensors]
    return df.groupBy(key).agg(*parts).select(key, F.inline(F.array(*sensors))).withColumn("dropped", F.col("null_pct") > max_null_pct)


def tag_is(tag: Column, contains: tuple[str, ...] = (), starts: tuple[str, ...] = (), ends: tuple[str, ...] = ()) -> Column:
    """Whether a tag name holds, starts with or ends with one of the given parts, in any case."""
    up = F.upper(tag)
    tests = [up.contains(x.upper()) for x in contains] + [up.startswith(x.upper()) for x in starts] + [up.endswith(x.upper()) for x in ends]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
