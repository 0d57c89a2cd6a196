"""Union of intervals per entity and the gaps between them, by a global range sort and a prefix of summaries.

Rows are range-sorted by (entity, start, end), so an entity of any size is spread over many partitions. Each
partition reports its first row and its trailing open period; the reports (one small row per partition) are combined
in order on the driver, and a second pass over the same partitions starts from the carried state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, micros

LOWEST = np.iinfo(np.int64).min


def _running_end(node: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest `end` so far within each stretch of equal `node` (rows sorted by node)."""
    rank = np.empty(len(end), np.int64)
    order = np.lexsort((end, node))
    rank[order] = np.arange(len(end))
    return end[order][np.maximum.accumulate(rank)]


def _islands(node: np.ndarray, start: np.ndarray, end: np.ndarray, carry: tuple[int, int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, period start, period end) of the rows, the carried open period included as the first."""
    if carry is not None:
        node, start, end = (np.concatenate(([v], a)) for v, a in zip(carry, (node, start, end), strict=True))
    top = _running_end(node, end)
    opens = np.ones(len(node), bool)
    opens[1:] = (node[1:] != node[:-1]) | (start[1:] > top[:-1])
    first = np.flatnonzero(opens)
    last = np.concatenate((first[1:], [len(node)])) - 1
    return node[first], start[first], top[last]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(i).to_numpy() for i in range(3))


def combine(summaries: list[tuple]) -> dict[int, tuple[tuple[int, int, int] | None, bool]]:
    """Per partition the open period carried in, and whether the partition's own last period goes on after it.

    `summaries`: (partition, first node, first start, last node, start and end of the last period) of the partitions
    that hold rows, in any order.
    """
    ordered = sorted(summaries)
    carries: dict[int, tuple] = {}
    carry = None
    for part, node0, _, node1, s1, e1 in ordered:
        carries[part] = carry
        if carry is not None and carry[0] == node1 and node0 == node1 and s1 <= carry[2]:
            carry = (node1, carry[1], max(carry[2], e1))
        else:
            carry = (node1, s1, e1)
    out, later = {}, None
    for part, node0, start0, *_ in reversed(ordered):
        after = carries[later[0]] if later else None
        out[part] = (carries[part], bool(later) and after is not None and after[0] == later[1] and later[2] <= after[2])
        later = (part, node0, start0)
    return out


def periods_and_gaps(labels: DataFrame, entity: str = "node_id", start: str = "start_time", end: str = "end_time", partitions: int | None = None) -> DataFrame:
    """(<entity>, kind, start_us, end_us): kind `period` for the unions of an entity's intervals, `gap` between two.

    Touching intervals join; an interval of length 0 counts. Rows with a null entity or time, or that end before
    they start, are left out; repeated intervals count once (they are removed before the sort, map-side first). An
    empty table gives no rows. Only the three named columns are read. The driver holds one summary row per partition.
    """
    spark = labels.sparkSession
    clean = (
        labels.select(F.col(entity).cast("long").alias("node"), micros(labels, start).alias("s"), micros(labels, end).alias("e"))
        .where("node IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND e >= s")
        .groupBy("node", "s")
        .agg(F.max("e").alias("e"))  # of intervals with one start, the longest covers the others
    )
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Checkpointed: both passes must see the same partitions, also after an executor is lost.
    ranged = durable(clean.repartitionByRange(n, "node", "s").sortWithinPartitions("node", "s"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = open_ = None
        for node, s, e in _batches(batches):
            first = first or (int(node[0]), int(s[0]))
            nodes, starts, ends = _islands(node, s, e, open_)
            open_ = (int(nodes[-1]), int(starts[-1]), int(ends[-1]))
        if first:
            values = (TaskContext.get().partitionId(), *first, *open_)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], names=["p", "n0", "s0", "n1", "s1", "e1"])

    reports = ranged.mapInArrow(summarise, "p long, n0 long, s0 long, n1 long, s1 long, e1 long").collect()
    state = combine([tuple(r) for r in reports])

    def emit(node: np.ndarray, s: np.ndarray, e: np.ndarray, done: int) -> pa.RecordBatch:
        """Periods of the first `done` islands, and the gaps before each island that follows one of its node."""
        same = np.flatnonzero(node[1:] == node[:-1])
        nodes = np.concatenate((node[:done], node[1:][same]))
        kinds = pa.array(["period"] * done + ["gap"] * len(same), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(nodes), kinds, pa.array(np.concatenate((s[:done], e[:-1][same]))), pa.array(np.concatenate((e[:done], s[1:][same])))], names=[entity, "kind", "start_us", "end_us"])

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        carry, goes_on = state.get(TaskContext.get().partitionId(), (None, False))
        open_, fresh = carry, True
        for node, s, e in _batches(batches):
            nodes, starts, ends = _islands(node, s, e, open_)
            # A period carried in whose end the partition before has already told isn't told again.
            told = int(fresh and carry is not None and not (node[0] == carry[0] and s[0] <= carry[2]))
            out = emit(nodes, starts, ends, len(nodes) - 1)
            if told:
                keep = np.ones(out.num_rows, bool)
                keep[0] = False
                out = out.filter(pa.array(keep))
            yield out
            open_, fresh = (int(nodes[-1]), int(starts[-1]), int(ends[-1])), False
        if not fresh and not goes_on:
            yield emit(*(np.array([v], np.int64) for v in open_), 1)

    return ranged.mapInArrow(rescan, f"{entity} long, kind string, start_us long, end_us long")
