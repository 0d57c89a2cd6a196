"""Irregular readings onto a declared regular grid, with singular-spectrum imputation of the empty slots.

Each series is cut into blocks of `block` slots that overlap their neighbours by `margin` slots, so that the
longest series is spread over many tasks and a task holds one bounded block. The readings are averaged per slot in
the JVM, and one pass over Arrow batches imputes each block. Blocks with far more readings than slots are found by a
count and averaged before they are put together, so that no task is handed an unbounded number of readings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import finite, micros

OBSERVED, FILLED, MISSING = "observed", "filled", "missing"


def _gap_groups(hole: np.ndarray, lag: int, least: int = 48) -> list[np.ndarray]:
    """The missing places in groups that no window of `lag` slots joins, small neighbours together."""
    at = np.flatnonzero(hole)
    cuts = [0]
    for end in [*np.flatnonzero(np.diff(at) >= lag) + 1, len(at)]:
        if end == len(at) or end - cuts[-1] >= least:
            cuts.append(int(end))
    return [at[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


def _ssa_row(y: np.ndarray, hole: np.ndarray, lag: int, rank: int, max_iter: int, tol: float) -> np.ndarray | None:
    """`y` (mean 0) with the entries at `hole` replaced by the converged fill; None if it doesn't converge."""
    n, k = len(y), len(y) - lag + 1
    scale = max(float(y.std()), 1e-12)
    known = np.where(hole, 0, y)
    # the form below by diagonal and place: sums of a diagonal of `off` up to one offset less those before another
    d, place = np.arange(lag + 1)[:, None], np.arange(n)
    upto, before_it = d * (lag + 1) + np.clip(np.minimum(place, lag - 1 - d) + 1, 0, None), d * (lag + 1) + np.maximum(place - k + 1, 0)
    row = np.arange(lag)
    inside = row[:, None] + row < lag
    diagonals = np.where(inside, row * lag + row + row[:, None], 0)
    groups = [(g, np.minimum(np.abs(g[:, None] - g), lag) * n + np.minimum(g[:, None], g)) for g in _gap_groups(hole, lag)]
    at = np.flatnonzero(hole)
    near = at[:, None] + np.arange(1 - lag, lag)
    held = np.where((near >= 0) & (near < n), known[np.clip(near, 0, n - 1)], 0)
    near = np.abs(np.arange(1 - lag, lag)) * n + np.clip(np.minimum(near, at[:, None]), 0, None)
    sums = np.zeros((lag + 1, lag + 1))
    pull, before = np.zeros(n), None
    for _ in range(max_iter):
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(y, k))
        _, vectors = np.linalg.eigh(windows @ windows.T)
        lead = vectors[:, -rank:]
        off = np.eye(lag) - lead @ lead.T
        # what the windows leave outside the subspace, summed, is a quadratic form of y
        sums[:lag, 1:] = np.cumsum(np.where(inside, off.take(diagonals), 0), 1)
        form = sums.take(upto) - sums.take(before_it)
        pull[at] = -(form.take(near) * held).sum(1)
        new = y.copy()
        for g, pairs in groups:
            a = form.take(pairs)
            a.flat[:: len(g) + 1] += 1e-6  # a pull to the last fill, which keeps it solvable and moves no fixed point
            new[g] = np.linalg.solve(a, pull[g] + 1e-6 * y[g])
        moved = float(np.abs(new - y).max()) / scale
        y = new
        if not np.isfinite(moved):
            return None
        # what is still to come at the pace of the last two passes
        if moved == 0 or (before is not None and moved < before and moved / (1 - moved / before) < tol):
            return y
        before = moved
    return None


def ssa_fill(x: np.ndarray, lag: int, rank: int, max_iter: int, tol: float) -> np.ndarray:
    """The rows of `x` (channel x slot, NaN where missing) with the missing entries imputed.

    Iterated: embed each row into its Hankel trajectory matrix of `lag` rows, keep the leading `rank` singular
    vectors, and put in place of the missing entries what leaves least of all windows outside of these: there further
    passes of averaged anti-diagonals move nothing, so it has the fixed points of the plain iteration and needs few
    passes. It ends when what is still to come, told from the pace of the last passes, is under `tol` standard
    deviations; the missing entries of a row that isn't there after `max_iter` passes stay NaN. Rows with fewer than
    `lag` + 1 values are filled by interpolation alone; rows without any value stay NaN.
    """
    out = x.copy()
    gaps = np.isnan(x)
    n = x.shape[1]
    at = np.arange(n)
    held = (~gaps).sum(1)
    for c in np.flatnonzero((held > 0) & (held < n)):
        out[c, gaps[c]] = np.interp(at[gaps[c]], at[~gaps[c]], x[c, ~gaps[c]])
    if n < 2 * lag:
        return out
    for c in np.flatnonzero((held > lag) & (held < n)):
        mean = out[c].mean()
        filled = _ssa_row(out[c] - mean, gaps[c], lag, rank, max_iter, tol)
        out[c, gaps[c]] = np.nan if filled is None else filled[gaps[c]] + mean
    return out


def _long_gaps(empty: np.ndarray, longest: int) -> np.ndarray:
    """Marks the entries of runs of True that are longer than `longest`."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], empty, [False])).astype(np.int8)))
    marks = np.zeros(len(empty), bool)
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        marks[a:b] = b - a > longest
    return marks


def regular_grid(
    readings: DataFrame,
    exports: DataFrame,
    sensors: list[str] | None = None,
    block: int = 1024,
    margin: int = 64,
    lag: int = 16,
    rank: int = 3,
    max_gap: int = 64,
    max_iter: int = 500,
    tol: float = 1e-4,
    dense: int = 64,
) -> DataFrame:
    """One row per export and grid slot: (export_id, slot_no, slot_start_us, state, n_readings, n_filled, <sensors>).

    `readings` has export_id, row_id, timestamp and the sensors; `exports` export_id, frequency_seconds, range_start
    and range_end. Slot k spans [range_start + k*frequency, range_start + (k+1)*frequency), up to range_end. A slot
    is `observed` if any reading's timestamp falls into it, whatever its sensors hold; else `filled` if at least one
    sensor could be imputed, else `missing`. n_filled counts the sensors that were imputed, in observed slots too.

    Defined cases: readings with a null timestamp, outside the range, or of an export that is not declared fall into
    no slot. Rows with the same row_id and timestamp count once. NaN and infinite values are null. A sensor's value
    is the mean of its distinct readings in the slot. A gap longer than `max_gap` slots, or a sensor without values
    in a block, stays null, as do the gaps of a sensor whose imputation in a block doesn't converge. `dense` is the
    number of readings per slot from which on a block's readings are averaged beforehand; it changes no result. Exports with a null bound, a frequency of 0 or less or an empty range have no slots;
    repeated export rows are taken together (earliest start, latest end, smallest frequency). Columns beyond the
    named ones are ignored.
    """
    named = {"export_id", "row_id", "timestamp", "ingested_at", "equipment_id", "active_node_ids", "n_active_nodes"}
    if sensors is None:
        sensors = sorted(f.name for f in readings.schema.fields if f.name.startswith("sensor_") and f.name not in named)
    declared = (
        exports.select("export_id", micros(exports, "range_start").alias("r0"), micros(exports, "range_end").alias("r1"), (F.col("frequency_seconds").cast("long") * 1_000_000).alias("step"))
        .groupBy("export_id")
        .agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("step").alias("step"))
        .where("export_id IS NOT NULL AND r0 < r1 AND step > 0")
        .withColumn("slots", F.expr("(r1 - r0 + step - 1) div step"))
    )
    skeleton = declared.select("export_id", F.explode(F.expr(f"sequence(0L, (slots - 1) div {block})")).alias("blk"), "r0", "step", "slots")

    inside = (
        readings.select("export_id", "row_id", micros(readings, "timestamp").alias("us"), *[finite(s).alias(s) for s in sensors])
        .where("us IS NOT NULL")
        .join(declared, "export_id")
        .where("us >= r0 AND us < r1")
        .withColumn("slot", F.expr("(us - r0) div step"))
        .withColumn("own", F.expr(f"slot div {block}"))
    )

    def in_blocks(rows: DataFrame) -> DataFrame:
        """The rows in their block, and again in those whose margin they lie in."""
        at = f"slot % {block}"
        more = f"if({at} < {margin} and own > 0, own - 1, null), if({at} >= {block - margin} and own < (slots - 1) div {block}, own + 1, null)"
        return rows.withColumn("blk", F.explode(F.expr(f"array_compact(array(own, {more}))")))

    def averaged(rows: DataFrame, *keys: str) -> DataFrame:
        once = rows.groupBy(*keys, "slot", "row_id", "us").agg(*[F.max(s).alias(s) for s in sensors])
        return once.groupBy(*keys, "slot").agg(F.count("*").alias("n"), *[F.avg(s).alias(s) for s in sensors])

    # The two aggregates are clustered by what the shuffle is keyed on, so neither shuffles again.
    sparse = lambda rows: averaged(in_blocks(rows).select("export_id", "blk", "slot", "row_id", "us", *sensors).repartition("export_id", "blk"), "export_id", "blk")
    crowded = inside.groupBy("export_id", "own").agg(F.count("*").alias("_n")).where(F.col("_n") > dense * block).select("export_id", "own")
    if crowded.isEmpty():
        per_slot = sparse(inside)
    else:
        # their readings are spread by all that tells them apart, and one row per slot goes on
        slots = averaged(inside.join(crowded, ["export_id", "own"], "left_semi"), "export_id", "own", "slots")
        early = in_blocks(slots).select("export_id", "blk", "slot", "n", *sensors)
        per_slot = sparse(inside.join(crowded, ["export_id", "own"], "left_anti")).select("export_id", "blk", "slot", "n", *sensors).unionByName(early)

    types = ", ".join(f"{s} double" for s in sensors)
    schema = f"export_id long, slot_no long, slot_start_us long, state string, n_readings long, n_filled int, {types}"

    def impute(held: pa.Table, frame: pa.Table) -> pa.Table:
        if not frame.num_rows:
            return pa.table({f: [] for f in ("export_id", "slot_no", "slot_start_us", "state", "n_readings", "n_filled", *sensors)})
        export, blk, r0, step, slots = (frame[c][0].as_py() for c in ("export_id", "blk", "r0", "step", "slots"))
        first, last = max(0, blk * block - margin), min(slots, (blk + 1) * block + margin)
        x = np.full((len(sensors), last - first), np.nan)
        n = np.zeros(last - first, np.int64)
        if held.num_rows:
            at = held["slot"].to_numpy() - first
            n[at] = held["n"].to_numpy()
            for c, s in enumerate(sensors):
                x[c, at] = held[s].to_numpy()
        filled = ssa_fill(x, lag, rank, max_iter, tol)
        for c in range(len(sensors)):
            empty = np.isnan(x[c])
            if empty.any():
                filled[c, _long_gaps(empty, max_gap)] = np.nan
        core = slice(blk * block - first, min(slots, (blk + 1) * block) - first)
        gained = (np.isnan(x) & ~np.isnan(filled)).sum(0)[core]
        n, filled = n[core], filled[:, core]
        state = np.where(n > 0, OBSERVED, np.where(gained > 0, FILLED, MISSING))
        slot = np.arange(blk * block, blk * block + len(n), dtype=np.int64)
        columns = {"export_id": np.full(len(n), export, np.int64), "slot_no": slot, "slot_start_us": r0 + slot * step, "state": pa.array(state.astype(object), pa.string()), "n_readings": n, "n_filled": gained.astype(np.int32)}
        return pa.table(columns | {s: pa.array(filled[c], pa.float64(), from_pandas=True) for c, s in enumerate(sensors)})

    return per_slot.groupBy("export_id", "blk").cogroup(skeleton.groupBy("export_id", "blk")).applyInArrow(impute, schema)


def empty_slots(grid: DataFrame) -> DataFrame:
    """(export_id, slot_no) of the slots into which no reading falls."""
    return grid.where(F.col("state") != OBSERVED).select("export_id", "slot_no")
