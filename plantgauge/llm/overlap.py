"""Same and near-same records across splits, by joining chunk digests of normalised records.

A record is normalised to cells of its values and cut into chunks in two ways. The rolling-hash cut gives
content-defined chunks; those shared across splits sum up to a record's overlap fraction. A cut after a content hash
can't promise to keep a chunk whole when any value may move by the tolerance or be null, so pairs are found with
anchored chunks besides: the positions fall into so few groups that two records with enough positions in common share
four in one group, and the query side looks up every cell that a value within the tolerance may lie in. No near
pair is missed. Records that share four cells by chance grow with both sides; digests carry a signature of the other
positions, so that where they meet such pairs are dropped in the join itself and never travel. Every pair that is
left is checked on its values.

Exact copies are one class throughout; classes are expanded to records only in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK = 1e-9
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h + _MIX[0]
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def content_chunks(cells: np.ndarray, there: np.ndarray, seed: int, mask: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined chunks of each row of `cells`: (row, digest, number of positions).

    A rolling hash over a position's cell and the one before cuts the row where its low bits (`mask`) are 0; absent
    positions are left out of the sequence.
    """
    rows, width = cells.shape
    with np.errstate(over="ignore"):
        token = mix(cells.astype(np.int64).view(np.uint64) * np.uint64(64) + np.arange(width, dtype=np.uint64) + np.uint64(seed << 40))
        before = np.zeros(rows, np.uint64)
        digest, length = np.zeros(rows, np.uint64), np.zeros(rows, np.int64)
        out: list[tuple] = []
        for p in range(width):
            on = there[:, p]
            digest = np.where(on, mix(digest ^ token[:, p]), digest)
            length = length + on
            rolled = mix(before * np.uint64(31) + token[:, p])
            cut = (on & ((rolled & np.uint64(mask)) == 0)) if p < width - 1 else length > 0
            cut &= length > 0
            at = np.flatnonzero(cut)
            out.append((at, digest[at], length[at]))
            digest, length = np.where(cut, np.uint64(0), digest), np.where(cut, 0, length)
            before = np.where(on, token[:, p], before)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def anchored_chunks(values: np.ndarray, width: float, tolerance: float, least_common: int, probe: bool, anchors: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of the anchored chunks, of `anchors` positions each, of each row (NaN where absent).

    With `probe`, of every combination of cells within the tolerance of the values; else of the values' own cells.
    """
    n = values.shape[1]
    groups = max((least_common - 1) // (anchors - 1), 1)
    of = np.arange(n) * groups // max(n, 1)
    reach = tolerance + SLACK if probe else 0.0
    low, high = (np.floor((values + d) / width) for d in (-reach, reach))
    out: list[tuple] = []
    with np.errstate(over="ignore", invalid="ignore"):
        for k, chosen in enumerate(t for g in range(groups) for t in combinations(np.flatnonzero(of == g), anchors)):
            full = ~np.isnan(values[:, chosen]).any(1)
            spans = [(low[:, p], high[:, p]) for p in chosen]
            widest = [int(np.max(h[full] - lo[full], initial=0)) for lo, h in spans]
            for steps in product(*(range(w + 1) for w in widest)):
                ok = full.copy()
                digest = np.full(len(values), k + 1, np.uint64)
                for (lo, h), s in zip(spans, steps, strict=True):
                    ok &= lo + s <= h
                    digest = mix(digest ^ np.where(ok, lo + s, 0).astype(np.int64).view(np.uint64))
                at = np.flatnonzero(ok)
                out.append((at, digest[at]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


#: Signatures hold so many positions a number, a byte each: six bits of a value's cell, one that marks it as absent.
PER_LONG = 7
_LOW, _SIX, _HIGH, _ABSENT = (int.from_bytes(bytes([b]) * PER_LONG) for b in (0x01, 0x3F, 0x80, 0x40))


def signatures(values: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per row from its first positions, for `alike`. Cells are twice the tolerance wide and counted
    modulo 64, so values within the tolerance are in the same or a neighbouring cell."""
    out = []
    for k in range(2):
        part = values[:, k * PER_LONG : (k + 1) * PER_LONG]
        cells = np.where(np.isnan(part), _ABSENT & 0xFF, np.floor(np.nan_to_num(part) / (2 * tolerance + SLACK)) % 64).astype(np.int64)
        out.append((cells << (8 * np.arange(part.shape[1]))).sum(1))
    return out[0], out[1]


def alike(a: str, b: str) -> str:
    """SQL: no position of the two signatures, held by both, is more than a cell apart. All positions are compared at
    once: per byte 1 + a - b modulo 64 is 0, 1 or 2."""
    r = f"((({a} & {_SIX}L) | {_HIGH}L) - ({b} & {_SIX}L) + {_LOW}L)"
    held = f"~((({a} | {b}) & {_ABSENT}L) - shiftright(({a} | {b}) & {_ABSENT}L, 6) | (({a} | {b}) & {_ABSENT}L))"
    return f"((({r} & {_LOW * 0x3C}L) | ({r} & shiftleft({r}, 1) & {_LOW * 0x02}L)) & {held}) = 0"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as a matrix, NaN where a list or an element is null or absent."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.full((len(column), width), np.nan)
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    at = np.repeat(np.arange(len(column)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _identified(records: DataFrame, record: str, means: str) -> DataFrame:
    """(record_id, h1, h2, means, held): two content hashes name the class of exact copies; non-finite is null."""
    clean = F.transform(means, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x.cast("double") + 0.0))
    rows = records.select(F.col(record).cast("long").alias("record_id"), clean.alias("means")).where("record_id IS NOT NULL")
    return rows.withColumn("held", F.coalesce(F.size(F.filter("means", lambda x: x.isNotNull())), F.lit(0))).select(
        "record_id", "means", "held", F.xxhash64("means").alias("h1"), F.xxhash64(F.lit(7), F.transform("means", lambda x: F.coalesce(x, F.lit(float("inf"))) * 3 + 1)).alias("h2")
    )


def _classes(rows: DataFrame, least_common: int) -> DataFrame:
    """One row per class of exact copies with values enough to be near to anything; combined map-side."""
    return rows.where(F.col("held") >= least_common).groupBy("h1", "h2").agg(F.first("means").alias("means"))


def _digests(classes: DataFrame, width: int, cell: float, tolerance: float, least_common: int, probe: bool) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(2), width)
            row, digest = anchored_chunks(v, cell, tolerance, least_common, probe)
            cells = np.floor(np.nan_to_num(v) / cell)
            crow, cdigest, length = content_chunks(cells, ~np.isnan(v), 1)
            long_ = length >= 3
            row, digest = np.concatenate((row, crow[long_])), np.concatenate((digest, cdigest[long_]))
            if len(row):
                order = np.lexsort((row, digest))
                row, digest = row[order], digest[order]
                keep = np.ones(len(row), bool)
                keep[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
                at = pa.array(row[keep])
                signs = [pa.array(s[row[keep]]) for s in signatures(v, tolerance)]
                yield pa.RecordBatch.from_arrays([pa.array(digest[keep].view(np.int64)), b.column(0).take(at), b.column(1).take(at), *signs], names=["digest", "h1", "h2", "s1", "s2"])

    return classes.select("h1", "h2", "means").mapInArrow(cut, "digest long, h1 long, h2 long, s1 long, s2 long")


def near(a: str, b: str, tolerance: float, least_common: int) -> str:
    """SQL: at least `least_common` positions are held by both arrays and all of those differ by `tolerance` at most."""
    gaps = f"filter(zip_with({a}, {b}, (x, y) -> abs(x - y)), d -> d IS NOT NULL)"
    return f"size({gaps}) >= {least_common} AND array_max({gaps}) <= {tolerance + SLACK!r}"


def cross_split_pairs(train: DataFrame, held_out: DataFrame, train_window: str = "cleaned_window_ids", out_window: str = "window_ids", means: str = "sensor_means", tolerance: float = 0.05, least_common: int = 10, cell: float = 0.4) -> DataFrame:
    """(train_id, out_id, how): pairs of a training and a held-out record that are the same window or near-same.

    how is `window` (same equipment_id and window number), `values` (at least `least_common` positions non-null in
    both, all within `tolerance`) or `both`. Null, NaN and infinite elements, null arrays and positions beyond the
    shorter array are absent. Rows of one record_id count once for each content they hold; rows without a record_id,
    and null equipment or window numbers, make no pair. Empty tables give no rows. Extra columns are ignored.
    """
    a, b = _identified(train, "record_id", means), _identified(held_out, "record_id", means)
    ca, cb = _classes(a, least_common), _classes(b, least_common)
    width = max(x or 0 for x in (d.agg(F.max(F.size("means"))).first()[0] for d in (ca, cb)))
    width = max(width, least_common)
    da = _digests(ca, width, cell, tolerance, least_common, False)
    db = _digests(cb, width, cell, tolerance, least_common, True).withColumnsRenamed({"h1": "g1", "h2": "g2", "s1": "t1", "s2": "t2"})
    # digests travel without the values; few pairs meet, and only those fetch them
    # (a record makes many digests, which Spark's size estimate doesn't see: the join isn't to be a broadcast)
    pairs = da.hint("merge").join(db, "digest").where(f"{alike('s1', 't1')} AND {alike('s2', 't2')}").select("h1", "h2", "g1", "g2").distinct()
    others = cb.withColumnsRenamed({"h1": "g1", "h2": "g2", "means": "others"})
    met = pairs.join(ca, ["h1", "h2"]).join(others, ["g1", "g2"]).where(near("means", "others", tolerance, least_common)).select("h1", "h2", "g1", "g2")
    member_a = a.select(F.col("record_id").alias("train_id"), "h1", "h2").distinct()
    member_b = b.select(F.col("record_id").alias("out_id"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).distinct()
    by_value = met.join(member_a, ["h1", "h2"]).join(member_b, ["g1", "g2"]).select("train_id", "out_id", F.lit(2).alias("k"))
    named = [train.select(F.col("record_id").cast("long").alias("train_id"), F.col("equipment_id").alias("eq"), F.col(train_window).alias("win")).distinct(), held_out.select(F.col("record_id").cast("long").alias("out_id"), F.col("equipment_id").alias("eq"), F.col(out_window).alias("win")).distinct()]
    by_name = named[0].join(named[1], ["eq", "win"]).where("train_id IS NOT NULL AND out_id IS NOT NULL").select("train_id", "out_id", F.lit(1).alias("k"))
    kinds = F.create_map(*[F.lit(x) for x in (1, "window", 2, "values", 3, "both")])
    return by_value.unionByName(by_name).distinct().groupBy("train_id", "out_id").agg(F.sum("k").cast("int").alias("k")).select("train_id", "out_id", kinds[F.col("k")].alias("how"))


def overlap_fractions(train: DataFrame, held_out: DataFrame, means: str = "sensor_means", cell: float = 0.4) -> DataFrame:
    """(record_id, positions, shared, fraction): of each held-out record the share of its positions that lie in
    content-defined chunks which some training record has too.

    Records without any value have 0 positions, 0 shared and a null fraction. Rows of one record_id and content count
    once.
    """
    a, b = _identified(train, "record_id", means), _identified(held_out, "record_id", means)
    ca, cb = _classes(a, 1), _classes(b, 1)
    width = max([x or 0 for x in (d.agg(F.max(F.size("means"))).first()[0] for d in (ca, cb))] + [1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(2), width)
            row, digest, length = content_chunks(np.floor(np.nan_to_num(v) / cell), ~np.isnan(v), 1)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(length), b.column(0).take(at), b.column(1).take(at)], names=["digest", "length", "h1", "h2"])

    schema = "digest long, length long, h1 long, h2 long"
    held = ca.select("h1", "h2", "means").mapInArrow(cut, schema).select("digest").distinct()
    shared = cb.select("h1", "h2", "means").mapInArrow(cut, schema).join(held, "digest", "left_semi").groupBy("h1", "h2").agg(F.sum("length").alias("shared"))
    rows = b.select("record_id", "h1", "h2", F.col("held").cast("long").alias("positions")).distinct()
    return rows.join(shared, ["h1", "h2"], "left").select("record_id", "positions", F.coalesce("shared", F.lit(0)).alias("shared"), F.expr("coalesce(shared, 0) / nullif(positions, 0)").alias("fraction"))
