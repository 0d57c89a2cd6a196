"""Implausible measurements per source: impossible values, spikes and stuck stretches, from an undecimated wavelet.

What is usual is defined per source, but no source is ever gathered in one task: its values are numbered by time and
cut into blocks of rows with a margin, blocks send counts and sums ahead, and what they add up to per source is handed
back to the blocks. Two passes over the blocks:

1. Detail coefficients of the values are counted in fine logarithmic buckets; their medians are the source's scales.
2. Coefficients above `cut` scales propose spikes. The series without the proposed values is smoothed by the same
   wavelet, and what it leaves sums up to the source's usual spread; proposed values that turn out to be within
   `times` of it are ordinary and widen it. Stretches of zero detail are stuck values.

A proposed value is a spike if it then is off the level of its time by `times` the spread, in a short stretch of such
values between ordinary ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, finite, micros
from .windows import overlapped

IMPOSSIBLE, SPIKE, STUCK = "impossible", "spike", "stuck"
#: A struct of the keys is itself never null, so it joins on equality where a key is null.
SOURCE = ["source", "field"]
KEYS = "struct<equipment_id:string,sensor:string>"
WEEK_US = 7 * 86_400_000_000
#: Detail coefficients are counted in buckets whose bounds grow by this factor; zeros in a bucket below all.
STEP, ZERO = 1.002, -(10**6)


def wavelet_details(x: np.ndarray, levels: int) -> list[np.ndarray]:
    """Detail coefficients of the undecimated transform with the kernel (1, 2, 1)/4, finest first."""
    details, smooth = [], x
    for j in range(levels):
        step = 2**j
        padded = np.pad(smooth, step, mode="reflect" if len(x) > step else "edge")
        coarser = (padded[: -2 * step] + 2 * smooth + padded[2 * step :]) / 4
        details.append(smooth - coarser)
        smooth = coarser
    return details


def robust_scale(x: np.ndarray) -> float:
    """Median absolute deviation, scaled to a normal standard deviation."""
    return 1.4826 * float(np.median(np.abs(x - np.median(x)))) if len(x) else 0.0


def runs_of(marks: np.ndarray) -> np.ndarray:
    """(start, end) of each run of True, the end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    return edges.reshape(-1, 2)


def medians_about(x: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The median of the up to `width` values about each of the places `at`."""
    half = width // 2
    padded = np.concatenate((np.full(half, np.nan), x, np.full(half, np.nan)))
    return np.nanmedian(np.lib.stride_tricks.sliding_window_view(padded, width)[at], axis=1) if len(at) else np.zeros(0)


def proposed(x: np.ndarray, scales: np.ndarray, cut: float) -> np.ndarray:
    """Where a detail coefficient is above `cut` of its level's scales."""
    marks = np.zeros(len(x), bool)
    for d, s in zip(wavelet_details(x, len(scales)), scales, strict=True):
        marks |= np.abs(d) > cut * max(s, 1e-9)
    return marks


def left_over(x: np.ndarray, faulty: np.ndarray, levels: int) -> np.ndarray:
    """What the wavelet's smooth of the series without its faulty values (interpolated over) leaves of `x`."""
    clean, at = x.copy(), np.arange(len(x))
    if not faulty.all():
        clean[faulty] = np.interp(at[faulty], at[~faulty], x[~faulty])
    return x - clean + sum(wavelet_details(clean, levels))


def _in_order(part: pa.Table, block: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's rows in order of position, their values, and which are its own."""
    part = part.take(pa.array(np.argsort(part["row_pos"].to_numpy())))
    return part, part["v"].to_numpy(), part["row_pos"].to_numpy() // block == part["_blk"][0].as_py()


def _usual(blocks: DataFrame, levels: int, block: int) -> DataFrame:
    """(<source>, _blk, scales array<double>, changes), one row per block: per level the median of the source's
    coefficients' sizes, to the width of a bucket and scaled to a normal standard deviation; and in how many of its
    steps the source changes."""

    def count(part: pa.Table) -> pa.Table:
        part, x, own = _in_order(part, block)
        pos = part["row_pos"].to_numpy()
        changes = (np.diff(x) != 0) & own[1:] & (pos[1:] > 0)
        level, bucket, n = [[-1]], [part["n_rows"].to_numpy()[:1]], [[changes.sum()]]
        for j, d in enumerate(wavelet_details(x, levels)):
            size = np.abs(d[own])
            k = np.where(size > 1e-12, np.ceil(np.log(np.maximum(size, 1e-12)) / np.log(STEP)), ZERO)
            names, counts = np.unique(k.astype(np.int64), return_counts=True)
            level.append(np.full(len(names), j))
            bucket.append(names)
            n.append(counts)
        held = {k: pa.array([part[k][0].as_py()] * sum(map(len, n)), part[k].type) for k in SOURCE}
        return pa.table(held | {"level": pa.array(np.concatenate(level), pa.int64()), "bucket": np.concatenate(bucket), "n": pa.array(np.concatenate(n), pa.int64())})

    counts = blocks.groupBy(*SOURCE, "_blk").applyInArrow(count, f"source {KEYS}, field string, level long, bucket long, n long")
    # at most some thousand buckets a source and level, whatever its rows
    per = counts.groupBy(*SOURCE, "level", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*SOURCE, "level")
    placed = per.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    median = F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("bucket")))
    size = placed.groupBy(*SOURCE, "level").agg(F.when(median == ZERO, 0.0).otherwise(1.4826 * F.pow(F.lit(STEP), median)).alias("scale"), F.max("bucket").alias("most"), F.max("total").alias("total"))
    arranged = F.transform(F.sort_array(F.collect_list(F.when(F.col("level") >= 0, F.struct("level", "scale")))), lambda s: s.scale)
    whole = size.groupBy(*SOURCE).agg(arranged.alias("scales"), F.max(F.when(F.col("level") < 0, F.col("total"))).alias("changes"), F.max(F.when(F.col("level") < 0, F.col("most"))).alias("n_rows"))
    return _per_block(whole, block)


def _per_block(per_source: DataFrame, block: int) -> DataFrame:
    """A table with one row and n_rows per source, with one for each block of the source instead: what is joined to
    blocks of values is joined on source and block, so that no source's values meet in one task."""
    return per_source.withColumn("_blk", F.explode(F.expr(f"sequence(0L, (n_rows - 1) div {block})"))).drop("n_rows")


def _numbered(results: DataFrame, fields: tuple[str, ...], lowest: float, highest: float) -> tuple[DataFrame, DataFrame]:
    """(<source>, result_id, v, row_pos, n_rows) of the possible values of each field, numbered by time per source; and
    (<source>, result_id, v) of the impossible ones.

    Rows are numbered within weeks, and the weeks' counts are summed up in a small table. All of it takes place where
    the one shuffle by source and week has put the rows.
    """
    week = [F.col("source"), F.col("week")]
    rows = (
        results.select("result_id", F.struct(F.col("equipment_id").cast("string"), F.col("sensor").cast("string")).cast(KEYS).alias("source"), micros(results, "timestamp").alias("us"), *[finite(f).alias(f) for f in fields])
        .where("us IS NOT NULL AND result_id IS NOT NULL")
        .withColumn("week", F.floor(F.col("us") / WEEK_US))
        .repartition("source", "week")
        .groupBy("source", "week", "us", "result_id")
        .agg(*[F.max(f).alias(f) for f in fields])
    )
    ok = {f: F.coalesce(F.col(f).between(lowest, highest), F.lit(False)) for f in fields}
    order = Window.partitionBy(*week).orderBy("us", "result_id").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({f"_n_{f}": F.sum(c.cast("long")).over(order) for f, c in ok.items()})
    counts = rows.groupBy(*week).agg(*[F.sum(c.cast("long")).alias(f"_c_{f}") for f, c in ok.items()])
    whole = Window.partitionBy("source")
    before = whole.orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "week", *[F.coalesce(F.sum(f"_c_{f}").over(before), F.lit(0)).alias(f"_b_{f}") for f in fields], *[F.sum(f"_c_{f}").over(whole).alias(f"_a_{f}") for f in fields])
    one = [F.struct(F.lit(f).alias("field"), F.col(f).alias("v"), (F.col(f"_n_{f}") + F.col(f"_b_{f}") - 1).alias("row_pos"), F.col(f"_a_{f}").alias("n_rows"), ok[f].alias("ok")) for f in fields]
    placed = within.join(offsets, ["source", "week"]).select("source", "result_id", F.inline(F.array(*one)))
    wrong = rows.select("source", "result_id", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v"), ok[f].alias("ok")) for f in fields])))
    return placed.where("ok").drop("ok"), wrong.where("v IS NOT NULL AND NOT ok").drop("ok")


def implausible(
    results: DataFrame,
    fields: tuple[str, ...] = ("null_pct", "stuck_pct"),
    lowest: float = 0.0,
    highest: float = 100.0,
    times: float = 8.0,
    floor: float = 5.0,
    longest: int = 3,
    least_stuck: int = 6,
    levels: int = 3,
    cut: float = 6.0,
    width: int = 9,
    block: int = 4096,
) -> DataFrame:
    """(result_id, equipment_id, sensor, field, value, reason) of the values that can't be true.

    Reasons: `impossible` (outside [lowest, highest]); `spike` (a detail coefficient above `cut` of the source's
    scales, off the median of the `width` values about it by `times` the source's spread, or by `floor` where nine in
    ten values of the source lie on the smooth, in a stretch of at most `longest` such values that begins after the
    first and ends before the last value of the source); `stuck` (one of `least_stuck` or more equal values in a row,
    zero finest detail, where the source changes in more than half of its other steps). A value gets the first that
    holds.

    A source is (equipment_id, sensor), null keys included, ordered by timestamp and result_id. Rows of one result_id
    count once. Null, NaN and infinite values, and rows without a timestamp or id, are no cases and are skipped over;
    impossible values are left out before spikes and stuck stretches are sought. Sources of fewer than five values
    have no spikes. `block` is the number of a source's values in a task's hands at once. An empty table gives no
    rows. Other columns are ignored.
    """
    margin = max(2 ** (levels + 1), width, least_stuck) + 2 * longest
    block = max(block, 8 * margin)
    each, out = _numbered(results, fields, lowest, highest)
    blocks = overlapped(each, "row_pos", margin, margin, block).drop("_own").repartition(*SOURCE, "_blk")
    names = ["kind", *SOURCE, "_blk", "result_id", "row_pos", "value", "size", "n", "squares", "flat", "changes", "n_rows"]
    schema = f"kind string, source {KEYS}, field string, _blk long, result_id long, row_pos long, value double, size double, n long, squares double, flat long, changes long, n_rows long"

    def judge(part: pa.Table, usual: pa.Table) -> pa.Table:
        part, x, own = _in_order(part, block)
        pos, n_rows, changes = part["row_pos"].to_numpy(), part["n_rows"][0].as_py(), usual["changes"][0].as_py()
        faulty = proposed(x, np.array(usual["scales"][0].as_py()), cut)
        rest = left_over(x, faulty, levels)[own & ~faulty]
        out = {k: [] for k in names}

        def say(kind: str, at: np.ndarray, **values) -> None:
            for k in names:
                out[k].append(np.broadcast_to(np.asarray(values.get(k, 0)), len(at)))
            out["kind"][-1] = np.full(len(at), kind, object)
            out["result_id"][-1], out["row_pos"][-1], out["value"][-1] = part["result_id"].to_numpy()[at], pos[at], x[at]
            out["n_rows"][-1] = np.full(len(at), n_rows)

        steps = np.diff(x) != 0
        first = np.flatnonzero(own)[:1]
        say("block", first, n=len(rest), squares=float((rest**2).sum()), flat=int((np.abs(rest) <= 1e-6).sum()))
        if n_rows >= 5:
            at = np.flatnonzero(faulty & own)
            say("proposed", at, size=np.abs(x[at] - medians_about(x, at, width)))
        # a run that reaches over the block's own rows is as long as its pieces together
        low, high = np.argmax(own), len(own) - 1 - np.argmax(own[::-1])
        runs = runs_of(~steps)
        runs = runs[(runs[:, 1] - runs[:, 0] + 1 >= least_stuck) & (runs[:, 1] >= low) & (runs[:, 0] <= high)]
        kept = np.clip(runs, low, high)
        whole = (kept == runs).all(1)
        fits = ~whole | (2 * changes > n_rows - (runs[:, 1] - runs[:, 0] + 1))
        kept, whole = kept[fits], whole[fits]
        size = kept[:, 1] - kept[:, 0] + 1
        at = np.repeat(kept[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())
        say("stuck", at, n=np.repeat(size, size), size=pos[np.repeat(kept[:, 0], size)].astype(float))
        out["kind"][-1][np.repeat(~whole, size)] = "piece"
        out["changes"][-1] = np.full(len(at), changes)
        held = {k: np.concatenate(v) for k, v in out.items() if k not in (*SOURCE, "_blk")}
        size = len(held["kind"])
        held |= {k: [part[k][0].as_py()] * size for k in (*SOURCE, "_blk")}
        kinds = {"kind": pa.string(), **{k: part[k].type for k in SOURCE}, "value": pa.float64(), "size": pa.float64(), "squares": pa.float64()}
        return pa.table({k: pa.array(held[k], kinds.get(k, pa.int64())) for k in names})

    usual = _usual(blocks, levels, block).groupBy(*SOURCE, "_blk")
    # read once for the sums and again for the values that they judge: a small share of the rows
    told = durable(blocks.groupBy(*SOURCE, "_blk").cogroup(usual).applyInArrow(judge, schema))
    sums = told.where("kind = 'block'").groupBy(*SOURCE).agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.sum("flat").alias("flat"), F.max("n_rows").alias("n_rows"))
    # without an ordinary value there is nothing to be off; what was proposed and is no fault counts as ordinary
    spread = _widened(sums.where("n > 0"), told.where("kind = 'proposed'"), times)
    bound = F.when(F.col("flat") >= 0.9 * F.col("n"), F.lit(float(floor))).otherwise(times * F.col("spread")).alias("bound")
    bounds = _per_block(spread.select(*SOURCE, F.col("n_rows"), bound), block)
    off = told.where("kind = 'proposed'").join(bounds, [*SOURCE, "_blk"]).where("size >= bound").select(told.columns)
    spike = _short_stretches(off, longest, block)
    stuck = told.where("kind = 'stuck'").unionByName(_joined_pieces(told.where("kind = 'piece'")).where("2 * changes > n_rows - n"))
    found = spike.select(*SOURCE, "result_id", "value", F.lit(SPIKE).alias("reason")).unionByName(stuck.select(*SOURCE, "result_id", "value", F.lit(STUCK).alias("reason")))
    # of both reasons the first in the alphabet is the one that counts
    one = found.groupBy(*SOURCE, "result_id").agg(F.first("value").alias("value"), F.min("reason").alias("reason"))
    wrong = out.select(*SOURCE, "result_id", F.col("v").alias("value"), F.lit(IMPOSSIBLE).alias("reason"))
    return wrong.unionByName(one).select("result_id", "source.equipment_id", "source.sensor", "field", "value", "reason")


def _widened(sums: DataFrame, proposed_: DataFrame, times: float) -> DataFrame:
    """`sums` with spread: the deviation about the level of all values but the faults, which are off by `times` of it.

    It starts from the values that weren't proposed, and the others are taken in by size as long as they are nearer
    than `times` of the deviation so far. Sizes are summed in fine buckets, so a source's table is small.
    """
    size = F.greatest(F.col("size"), F.lit(1e-12))
    more = proposed_.groupBy(*SOURCE, F.ceil(F.log(size) / float(np.log(STEP))).alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.col("size") ** 2).alias("squares"), F.min("size").alias("from_"))
    steps = sums.select(*SOURCE, F.lit(2 * ZERO).cast("long").alias("bucket"), "n", "squares", F.lit(0.0).alias("from_")).unionByName(more)
    order = Window.partitionBy(*SOURCE).orderBy("bucket")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    reached = steps.withColumn("spread", F.sqrt(F.sum("squares").over(upto) / F.sum("n").over(upto))).withColumn("next", F.lead("from_").over(order))
    ends = reached.where(F.col("next").isNull() | (F.col("next") >= times * F.col("spread")))
    return sums.join(ends.groupBy(*SOURCE).agg(F.min_by("spread", "bucket").alias("spread")), SOURCE)


def _short_stretches(faults: DataFrame, longest: int, block: int) -> DataFrame:
    """Of the rows those in stretches of at most `longest` neighbouring positions that end before the source does."""
    spread = overlapped(faults.drop("_blk"), "row_pos", longest + 1, longest + 1, block)
    order = Window.partitionBy(*SOURCE, "_blk").orderBy("row_pos")
    before = [F.coalesce((F.col("row_pos") - F.lag("row_pos", i).over(order) == i).cast("int"), F.lit(0)) for i in range(1, longest + 1)]
    after = [F.coalesce((F.lead("row_pos", i).over(order) - F.col("row_pos") == i).cast("int"), F.lit(0)) for i in range(1, longest + 1)]
    placed = spread.withColumn("_before", sum(before, F.lit(0))).withColumn("_after", sum(after, F.lit(0)))
    return placed.where(f"_own AND _before + _after < {longest} AND row_pos - _before > 0 AND row_pos + _after < n_rows - 1")


def _joined_pieces(pieces: DataFrame) -> DataFrame:
    """The values of stretches that lie in several blocks, with the length of the whole stretch as n.

    A piece is named by its first position (`size`); only one row a piece meets the other pieces of its source.
    """
    ends = pieces.groupBy(*SOURCE, "_blk", "size").agg(F.max("row_pos").alias("last"), F.first("n").alias("n"))
    order = Window.partitionBy(*SOURCE).orderBy("size")
    # neighbouring pieces in neighbouring blocks are one stretch: both reach over the edge between
    next_ = (F.col("size") - F.lag("last").over(order) == 1) & (F.col("_blk") != F.lag("_blk").over(order))
    opened = ends.withColumn("_open", F.when(next_, 0).otherwise(1))
    named = opened.withColumn("_run", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = named.groupBy(*SOURCE, "_run").agg(F.sum("n").alias("n"), F.collect_list("size").alias("_sizes")).select(*SOURCE, "n", F.explode("_sizes").alias("size"))
    return pieces.drop("n").join(whole, [*SOURCE, "size"]).select(*pieces.columns)
