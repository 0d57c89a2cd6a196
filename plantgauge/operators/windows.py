"""Row positions, fixed-size windows of rows, and what is said of one window at a time.

The shape used throughout: a wide table has the key (`equipment_id`), `timestamp`, an id that breaks ties, and one
double column per sensor. `windowed` adds row_pos, window_id and row_in_window. `long_form` has one row per
(key, window_id, row_in_window, sensor, value). Nulls stand for missing values; NaN and infinite values are made null
first (`columns.finite_table`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import micros

KEY = "equipment_id"
SIZE = 120
DAY_US = 86_400_000_000


def keys_of(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def row_positions(df: DataFrame, order: str = "timestamp", tie: str = "row_id", key: str | list[str] = KEY, bucket_us: int = DAY_US) -> DataFrame:
    """`df` with row_pos, the 0-based place of each row within its key, by time and then by `tie`; and n_rows.

    Rows are numbered within time buckets (`order` may be a number too, in buckets of `bucket_us`), and the buckets'
    counts are summed up in a small table, so a key of any length is spread over tasks. Rows without a timestamp are
    left out.
    """
    keys = keys_of(key)
    place = micros(df, order) if isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col(order).cast("long")
    rows = df.withColumn("_us", place).where("_us IS NOT NULL").withColumn("_bucket", F.floor(F.col("_us") / bucket_us))
    counts = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    names = [f"_k{i}" for i in range(len(keys))]
    by_key = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_n").over(by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*names, "_b", before.alias("_before"), F.sum("_n").over(by_key).alias("n_rows"))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_us", tie)) - 1
    on = F.col("_bucket") == F.col("_b")
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    joined = rows.withColumn("_within", within).join(offsets, on)
    return joined.withColumn("row_pos", (F.col("_before") + F.col("_within")).cast("long")).drop("_us", "_bucket", *names, "_b", "_before", "_within")


def overlapped(df: DataFrame, pos: str, back: int, ahead: int = 0, block: int = 4096) -> DataFrame:
    """`df` with _blk: each row in its block of positions, and again in the next or previous block where a frame of
    `back` rows before or `ahead` rows after a row of that block reaches it. Rows with _own are in their own block."""
    block = max(block, 8 * max(back, ahead, 1))
    at = f"{pos} % {block}"
    own = f"({pos} div {block})"
    more = [f"if({at} >= {block - back}, {own} + 1, null)"] if back else []
    more += [f"if({at} < {ahead} and {own} > 0, {own} - 1, null)"] if ahead else []
    spread = df.withColumn("_blk", F.explode(F.expr(f"array_compact(array({', '.join([own, *more])}))")))
    return spread.withColumn("_own", F.expr(f"_blk = {own}"))


def windowed(df: DataFrame, size: int = SIZE, drop_incomplete: bool = True, **places: str) -> DataFrame:
    """`row_positions` with window_id = row_pos div size and row_in_window; the unfinished last window left out."""
    rows = row_positions(df, **places)
    if drop_incomplete:
        rows = rows.where(F.expr(f"row_pos < n_rows div {size} * {size}"))
    return rows.withColumn("window_id", F.expr(f"row_pos div {size}")).withColumn("row_in_window", F.expr(f"cast(row_pos % {size} as int)"))


def window_metadata(rows: DataFrame, key: str = KEY) -> DataFrame:
    """(key, window_id, start_time, end_time, start_idx, end_idx), end_idx exclusive."""
    return rows.groupBy(key, "window_id").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.min("row_pos").alias("start_idx"), (F.max("row_pos") + 1).alias("end_idx"))


def long_form(rows: DataFrame, sensors: list[str], key: str = KEY) -> DataFrame:
    """One row per window row and sensor, nulls kept."""
    return rows.unpivot([key, "window_id", "row_in_window"], sensors, "sensor", "value")


def per_sensor(rows: DataFrame, sensors: list[str], *aggregates: tuple[str, str], key: str = KEY) -> DataFrame:
    """Per (key, window, sensor) the given aggregates, each (name, SQL over `x`), of a wide table in one pass.

    The table isn't unpivoted first: a window's aggregates of all sensors are one row, taken apart afterwards.
    """
    packed = [F.struct(F.lit(s).alias("sensor"), *[F.expr(sql.replace("{x}", s)).alias(name) for name, sql in aggregates]).alias(f"_{s}") for s in sensors]
    wide = rows.groupBy(key, "window_id").agg(*packed)
    return wide.select(key, "window_id", F.inline(F.array(*[f"_{s}" for s in sensors])))


def window_means(rows: DataFrame, sensors: list[str], key: str = KEY) -> DataFrame:
    """(key, window_id, <sensor means>), nulls skipped."""
    return rows.groupBy(key, "window_id").agg(*[F.avg(s).alias(s) for s in sensors])


def sensor_dropout(rows: DataFrame, sensors: list[str], threshold_pct: float = 5.0, key: str = KEY) -> DataFrame:
    """(key, window_id, dropout_pct, dropped): the share of sensors with any null; dropped above the threshold."""
    holes = sum((F.max(F.col(s).isNull().cast("int")) for s in sensors), F.lit(0))
    pct = holes * F.lit(100.0) / F.lit(len(sensors))
    return rows.groupBy(key, "window_id").agg(pct.alias("dropout_pct")).withColumn("dropped", F.col("dropout_pct") > threshold_pct)


def transient_windows(rows: DataFrame, speed: str, operating_range: float, threshold_pct: float = 15.0, key: str = KEY) -> DataFrame:
    """(key, window_id, speed_span, transient): a window whose speed moves by more than the share of its range."""
    span = F.max(speed) - F.min(speed)
    return rows.groupBy(key, "window_id").agg(span.alias("speed_span")).withColumn("transient", F.coalesce(F.col("speed_span") > threshold_pct / 100 * operating_range, F.lit(False)))


def running_windows(rows: DataFrame, sensor: str, threshold: float, min_pct: float = 50.0, key: str = KEY) -> DataFrame:
    """(key, window_id, running_pct, running): share of valid rows above the threshold; no valid row: not running."""
    pct = F.avg(F.when(F.col(sensor) > threshold, 100.0).when(F.col(sensor).isNotNull(), 0.0))
    return rows.groupBy(key, "window_id").agg(pct.alias("running_pct")).withColumn("running", F.coalesce(F.col("running_pct") >= min_pct, F.lit(False)))


def running_mask(rows: DataFrame, sensor: str, share: float = 0.5, key: str = KEY) -> DataFrame:
    """(key, window_id, fully_running): every row above `share` times the key's median; a null row isn't running."""
    medians = rows.groupBy(F.col(key).alias("_key")).agg(F.percentile(sensor, 0.5).alias("_median"))
    flagged = rows.join(medians, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_on", F.coalesce(F.col(sensor) > share * F.col("_median"), F.lit(False)))
    return flagged.groupBy(key, "window_id").agg(F.min("_on").alias("fully_running"))


def event_touched(rows: DataFrame, active: str = "n_active_nodes", key: str = KEY) -> DataFrame:
    """(key, window_id, touched): any row with an active node. The column must be there."""
    if active not in rows.columns:
        raise ValueError(f"no column {active}")
    return rows.groupBy(key, "window_id").agg(F.coalesce(F.max(active) > 0, F.lit(False)).alias("touched"))


def bounded_fill(rows: DataFrame, sensors: list[str], limit: int = 3, across: bool = False, key: str = KEY) -> DataFrame:
    """Nulls filled by the last value of at most `limit` rows before, within a window, or across a key's windows.

    Of a longer gap the first `limit` rows are filled. Filling across windows looks back `limit` rows at most, so the
    rows are cut into blocks of windows that overlap by as much, not sorted per key.
    """
    if not across:
        frame = Window.partitionBy(key, "window_id").orderBy("row_in_window").rowsBetween(-limit, -1)
        return rows.withColumns({s: F.coalesce(s, F.last(s, True).over(frame)) for s in sensors})
    spread = overlapped(rows, "row_pos", limit)
    frame = Window.partitionBy(key, "_blk").orderBy("row_pos").rowsBetween(-limit, -1)
    filled = spread.withColumns({s: F.coalesce(s, F.last(s, True).over(frame)) for s in sensors})
    return filled.where("_own").drop("_blk", "_own")


def fill_both_ways(rows: DataFrame, sensors: list[str], key: str = KEY, block: int = 4096) -> DataFrame:
    """Nulls filled by the last value before, else by the first after, without bound.

    Blocks of rows are filled on their own; what a block hands on is combined in a small table per key.
    """
    blocked = rows.withColumn("_blk", F.expr(f"row_pos div {block}"))
    ends = blocked.groupBy(F.col(key).alias("_key"), F.col("_blk").alias("_b")).agg(
        *[F.max_by(s, F.when(F.col(s).isNotNull(), F.col("row_pos"))).alias(f"_l_{s}") for s in sensors], *[F.min_by(s, F.when(F.col(s).isNotNull(), F.col("row_pos"))).alias(f"_f_{s}") for s in sensors]
    )
    order = Window.partitionBy("_key").orderBy("_b")
    handed = ends.select(
        "_key", "_b",
        *[F.last(f"_l_{s}", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before_{s}") for s in sensors],
        *[F.first(f"_f_{s}", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias(f"_after_{s}") for s in sensors],
    )
    within = Window.partitionBy(key, "_blk").orderBy("row_pos")
    back, ahead = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(0, Window.unboundedFollowing)
    joined = blocked.join(handed, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_blk") == F.col("_b")))
    filled = joined.withColumns({s: F.coalesce(F.last(s, True).over(back), F.col(f"_before_{s}"), F.first(s, True).over(ahead), F.col(f"_after_{s}")) for s in sensors})
    return filled.select(*rows.columns)


def window_quality(rows: DataFrame, sensors: list[str], max_null_pct: float = 5.0, max_consecutive: int = 3, max_dominant_pct: float = 30.0, key: str = KEY) -> DataFrame:
    """(key, window_id, usable, n_nulls, n_masked, masked_sensors): a sensor is masked if its raw null share is above
    `max_null_pct` or nulls remain after the bounded fill; a window is unusable if more than `max_dominant_pct` of the
    sensors are masked."""
    raw = rows.withColumns({f"_raw_{s}": F.col(s).isNull().cast("int") for s in sensors})
    filled = bounded_fill(raw, sensors, max_consecutive, key=key)
    stats = filled.groupBy(key, "window_id").agg(
        F.count("*").alias("_n"), *[F.sum(f"_raw_{s}").alias(f"_null_{s}") for s in sensors], *[F.count_if(F.col(s).isNull()).alias(f"_left_{s}") for s in sensors]
    )
    masks = [F.when((F.col(f"_null_{s}") * 100.0 / F.col("_n") > max_null_pct) | (F.col(f"_left_{s}") > 0), F.lit(s)) for s in sensors]
    masked = F.array_compact(F.array(*masks))
    return stats.select(
        key, "window_id", (F.size(masked) * 100.0 / len(sensors) <= max_dominant_pct).alias("usable"), sum((F.col(f"_null_{s}") for s in sensors), F.lit(0)).alias("n_nulls"), F.size(masked).alias("n_masked"), F.array_join(masked, ",").alias("masked_sensors")
    )


def mask_to_zero(long: DataFrame, quality: DataFrame, key: str = KEY) -> DataFrame:
    """The long form with the values of masked sensors set to 0."""
    masks = quality.select(F.col(key).alias("_key"), F.col("window_id").alias("_w"), F.split("masked_sensors", ",").alias("_masked"))
    return long.join(masks, F.col(key).eqNullSafe(F.col("_key")) & (F.col("window_id") == F.col("_w")), "left").withColumn("value", F.when(F.array_contains("_masked", F.col("sensor")), 0.0).otherwise(F.col("value"))).drop("_key", "_w", "_masked")


def window_volatility(rows: DataFrame, sensors: list[str], key: str = KEY) -> DataFrame:
    """(key, window_id, volatility, magnitude, drift, level): means over sensors of the population deviation of row
    differences, of |x|, of the differences, and of x."""
    order = Window.partitionBy(key, "window_id").orderBy("row_in_window")
    with_diff = rows.withColumns({f"_d_{s}": F.col(s) - F.lag(s).over(order) for s in sensors})
    parts = with_diff.groupBy(key, "window_id").agg(
        *[F.stddev_pop(f"_d_{s}").alias(f"_v_{s}") for s in sensors], *[F.avg(F.abs(s)).alias(f"_m_{s}") for s in sensors], *[F.avg(f"_d_{s}").alias(f"_t_{s}") for s in sensors], *[F.avg(s).alias(f"_l_{s}") for s in sensors]
    )
    return parts.select(key, "window_id", *[mean_of([f"_{c}_{s}" for s in sensors]).alias(n) for c, n in (("v", "volatility"), ("m", "magnitude"), ("t", "drift"), ("l", "level"))])


def mean_of(columns: list[str | Column]) -> Column:
    """Row-wise mean of the columns, nulls skipped; null if all are."""
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    held = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(held > 0, total / held)


def window_trend(rows: DataFrame, sensors: list[str], size: int = SIZE, key: str = KEY) -> DataFrame:
    """(key, window_id, sensor, trend): mean of the last third less that of the first; null below two valid rows."""
    third = size // 3
    first, last = f"avg(if(row_in_window < {third}, {{x}}, null))", f"avg(if(row_in_window >= {size - third}, {{x}}, null))"
    return per_sensor(rows, sensors, ("trend", f"if(count({{x}}) >= 2, {last} - {first}, null)"), key=key)


def lookback_change(rows: DataFrame, sensors: list[str], k: int, size: int = SIZE, key: str = KEY) -> DataFrame:
    """(key, window_id, sensor, change): the window's mean less the mean of the k rows before it; null where none."""
    reach = -(-k // size)
    spread = rows.withColumn("_of", F.explode(F.expr(f"sequence(window_id, window_id + {reach})")))
    parts = [
        F.struct(F.lit(s).alias("sensor"), (F.avg(F.when(F.col("window_id") == F.col("_of"), F.col(s))) - F.avg(F.when((F.col("row_pos") < F.col("_of") * size) & (F.col("row_pos") >= F.col("_of") * size - k), F.col(s)))).alias("change")).alias(f"_{s}")
        for s in sensors
    ]
    whole = spread.groupBy(key, "_of").agg(F.count_if(F.col("window_id") == F.col("_of")).alias("_own"), *parts).where("_own > 0")
    return whole.select(key, F.col("_of").alias("window_id"), F.inline(F.array(*[f"_{s}" for s in sensors])))
