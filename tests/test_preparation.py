"""Regular grids, implausible values and continuous periods against brute force, and their edge cases."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from plantgauge.operators.periods import combine, periods_and_gaps
from plantgauge.operators.regrid import empty_slots, regular_grid, ssa_fill
from plantgauge.operators.spikes import implausible, left_over, proposed, robust_scale, runs_of, wavelet_details

T0 = datetime(2024, 1, 1)
LABELS = "label_id long, node_id long, start_time timestamp, end_time timestamp, extra string"


def brute_periods(rows):
    out = set()
    by = {}
    for _, n, s, e, *_ in rows:
        if n is not None and s is not None and e is not None and e >= s:
            by.setdefault(n, []).append((s, e))
    for n, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(n, "period", a, b) for a, b in merged}
        out |= {(n, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:], strict=False)}
    return out


def at(x):
    return None if x is None else T0 + timedelta(seconds=int(x))


def found_periods(spark, rows, **kw):
    df = spark.createDataFrame([(i, n, at(s), at(e), "x") for i, n, s, e in rows], LABELS)
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    got = [(r.node_id, r.kind, r.start_us // 10**6 - base, r.end_us // 10**6 - base) for r in periods_and_gaps(df, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_periods_match_brute_force_at_any_partitioning(spark, partitions):
    rng = np.random.default_rng(partitions)
    # node 1 holds most rows, long intervals reach over many others
    rows = [(i, int(rng.choice([1, 1, 1, 2, 3, 4])), int(s := rng.integers(0, 4000)), int(s + rng.choice([0, 3, 10, 60, 900], p=[0.2, 0.3, 0.3, 0.18, 0.02]))) for i in range(400)]
    rows += rows[:40]
    assert found_periods(spark, rows, partitions=partitions) == brute_periods(rows)


def test_periods_edges(spark):
    rows = [(1, 7, 0, 10), (2, 7, 10, 20), (3, 7, 30, 30), (4, 7, None, 5), (5, 7, 50, 40), (6, None, 0, 1), (7, 8, 5, None)]
    assert found_periods(spark, rows) == {(7, "period", 0, 20), (7, "gap", 20, 30), (7, "period", 30, 30)}
    assert found_periods(spark, []) == set()


def test_carried_period_swallows_whole_partitions():
    state = combine([(0, 1, 0, 1, 0, 100), (1, 1, 5, 1, 50, 60), (3, 1, 70, 1, 200, 210), (4, 2, 0, 2, 0, 5)])
    assert state == {0: (None, True), 1: ((1, 0, 100), True), 3: ((1, 0, 100), False), 4: ((1, 200, 210), False)}


def grid(spark, readings, exports, **kw):
    r = spark.createDataFrame(readings, "row_id long, export_id long, timestamp timestamp, sensor_00 double, note string")
    e = spark.createDataFrame(exports, "export_id long, frequency_seconds int, range_start timestamp, range_end timestamp, note string")
    return regular_grid(r, e, **kw)


def test_grid_marks_and_fills_slots(spark):
    readings = [(i, 1, at(10 * i + 3), float(np.sin(i / 5)), "a") for i in range(100) if i not in (40, 41, 70)]
    readings += [readings[0], (900, 1, None, 1.0, "a"), (901, 1, at(-5), 1.0, "a"), (902, 1, at(1000), 1.0, "a"), (903, 9, at(5), 1.0, "a"), (904, 1, at(8), float("nan"), "a")]
    exports = [(1, 10, at(0), at(1000), "b"), (2, 10, at(0), at(25), "b"), (3, 0, at(0), at(25), "b"), (4, 10, at(5), at(5), "b"), (5, 10, None, at(5), "b")]
    rows = {(r.export_id, r.slot_no): r for r in grid(spark, readings, exports).collect()}
    assert len(rows) == 103
    assert {k for k, r in rows.items() if r.state == "filled"} == {(1, 40), (1, 41), (1, 70)}
    assert {k for k, r in rows.items() if r.state == "missing"} == {(2, 0), (2, 1), (2, 2)}
    assert rows[1, 0].n_readings == 2 and abs(rows[1, 0].sensor_00) < 1e-12
    for k in (40, 41, 70):
        assert abs(rows[1, k].sensor_00 - np.sin(k / 5)) < 0.1
    assert rows[2, 0].sensor_00 is None


def test_grid_is_the_same_in_blocks(spark):
    readings = [(i, 1, at(10 * i + 3), float(i % 7), "a") for i in range(0, 500, 3)]
    exports = [(1, 10, at(0), at(5000), "b")]
    a = {(r.export_id, r.slot_no, r.state != "observed") for r in grid(spark, readings, exports).collect()}
    b = {(r.export_id, r.slot_no, r.state != "observed") for r in grid(spark, readings, exports, block=64, margin=16).collect()}
    assert a == b and len(a) == 500
    assert {r.slot_no for r in empty_slots(grid(spark, readings, exports, block=64, margin=16)).collect()} == {k for k in range(500) if k % 3}


def test_grid_of_crowded_slots(spark):
    # most readings in two slots at the edge of a block; averaged beforehand or not, the grid is the same
    rng = np.random.default_rng(3)
    places = np.concatenate((rng.integers(640, 660, 900), rng.integers(0, 2000, 300)))
    readings = [(i, 1, at(p), float(rng.normal()), "a") for i, p in enumerate(places)]
    readings += readings[:50] + [(5000 + i, 2, at(10 * i), 1.0, "a") for i in range(0, 60, 2)]
    exports = [(1, 10, at(0), at(2000), "b"), (2, 10, at(0), at(600), "b")]
    a, b = ({(r.export_id, r.slot_no): (r.state, r.n_readings, r.n_filled, r.sensor_00 and round(r.sensor_00, 9)) for r in grid(spark, readings, exports, block=64, margin=16, dense=d).collect()} for d in (1, 10**6))
    assert a == b and len(a) == 260 and max(n for _, n, *_ in a.values()) > 300


def test_hidden_slots_come_back(spark):
    """Values of known slots that are hidden are met, within what the series' own noise allows."""
    rng = np.random.default_rng(6)
    n = 2200
    t = np.arange(n)
    clean = 20 + 3 * np.sin(2 * np.pi * t / 36) + np.sin(2 * np.pi * t / 11)
    x = clean + 0.1 * rng.normal(size=n)
    hidden = np.zeros(n, bool)
    for a in rng.choice(np.arange(60, n - 60, 45), 30, replace=False):
        hidden[a : a + int(rng.integers(1, 14))] = True
    readings = [(int(i), 1, at(10 * i + int(rng.integers(0, 10))), float(x[i]), "a") for i in t[~hidden]]
    got = {r.slot_no: r for r in grid(spark, readings, [(1, 10, at(0), at(10 * n), "b")], lag=40, rank=5).collect()}
    off = np.array([got[i].sensor_00 - clean[i] for i in t[hidden]])
    line = np.interp(t[hidden], t[~hidden], x[~hidden]) - clean[hidden]
    assert all(got[i].state == "filled" for i in t[hidden]) and np.sqrt((off**2).mean()) < 0.25 < np.sqrt((line**2).mean())
    assert all(got[i].sensor_00 == pytest.approx(x[i]) and got[i].state == "observed" for i in t[~hidden])


def test_grid_of_empty_tables(spark):
    assert grid(spark, [], []).count() == 0
    assert [r.state for r in grid(spark, [], [(1, 10, at(0), at(20), "b")]).collect()] == ["missing"] * 2


def test_singular_spectrum_fill_beats_interpolation():
    t = np.arange(400)
    x = np.sin(t / 3)[None, :] + 0.01 * np.random.default_rng(0).normal(size=(1, 400))
    gone = x.copy()
    gone[0, 200:208] = np.nan
    error = np.abs(ssa_fill(gone, 16, 3, 30, 1e-4) - x)[0, 200:208].mean()
    line = np.abs(np.interp(t, t[~np.isnan(gone[0])], gone[0][~np.isnan(gone[0])]) - x[0])[200:208].mean()
    assert error < line / 2
    assert np.isnan(ssa_fill(np.full((1, 50), np.nan), 16, 3, 5, 0.1)).all()


@pytest.mark.parametrize(("period", "gap"), [(20, 12), (40, 30)])
def test_grid_fills_long_gaps_to_convergence(spark, period, gap):
    t = np.arange(1152)
    clean = np.sin(2 * np.pi * t / period)
    x = clean + 0.05 * np.random.default_rng(0).normal(size=1152)
    gone = np.zeros(1152, bool)
    for a in range(100, 1100, 250):
        gone[a : a + gap] = True
    readings = [(int(i), 1, at(10 * i + 3), float(x[i]), "a") for i in t[~gone]]
    got = {r.slot_no: r for r in grid(spark, readings, [(1, 10, at(0), at(11520), "b")], block=2048).collect()}
    assert all(got[i].state == "filled" for i in t[gone])
    assert np.sqrt(np.mean([(got[i].sensor_00 - clean[i]) ** 2 for i in t[gone]])) < 0.15 * clean.std()
    assert np.isnan(ssa_fill(np.where(gone, np.nan, x)[None], 16, 3, 2, 1e-4)[0, gone]).all()  # not converged, not told as filled


RESULTS = "result_id long, equipment_id string, sensor string, timestamp timestamp, null_pct double, stuck_pct double"


def reasons(spark, x, step=None, **kw):
    """{place: reason} of one source's values."""
    step = np.ones(len(x)) if step is None else step
    rows = [(i, "A", "s", at(600 * t), None if np.isnan(v) else float(v), None) for i, (v, t) in enumerate(zip(x, np.cumsum(step), strict=True))]
    return {r.result_id: r.reason for r in implausible(spark.createDataFrame(rows, RESULTS), **kw).collect()}


def brute_reasons(x, cut=6.0, width=9, levels=3, least=6):
    """The same over the whole source at once."""
    n, out = len(x), {}
    same = np.diff(x) == 0
    for a, b in runs_of(same):
        if b - a + 1 >= least and (~same).sum() > (len(same) - (b - a)) / 2:
            out |= dict.fromkeys(range(a, b + 1), "stuck")
    faulty = proposed(x, np.array([robust_scale(np.concatenate((d, -d))) for d in wavelet_details(x, levels)]), cut)
    rest = left_over(x, faulty, levels)[~faulty]
    level = np.array([np.median(x[max(i - width // 2, 0) : i + width // 2 + 1]) for i in range(n)])
    size = np.abs(x - level)
    squares, count = (rest**2).sum(), len(rest)
    for s in np.sort(size[faulty]):
        if s >= 8 * np.sqrt(squares / count):
            break
        squares, count = squares + s**2, count + 1
    bound = 5.0 if (np.abs(rest) <= 1e-6).mean() >= 0.9 else 8 * np.sqrt(squares / count)
    for a, b in runs_of(faulty & (size >= bound)):
        if b - a <= 3 and a > 0 and b < n:
            out |= dict.fromkeys(range(a, b), "spike")
    return out


def test_spikes_and_stuck_values(spark):
    rng = np.random.default_rng(1)
    x = 50 + rng.normal(size=300) + 5 * np.sin(np.arange(300) / 40)
    spiky = x.copy()
    spiky[[50, 120, 121, 200, 201, 202]] += [14, -14, -13, 20, 22, 21]
    spiky[250:] += 30  # a lasting change is no spike
    assert reasons(spark, spiky) == dict.fromkeys((50, 120, 121, 200, 201, 202), "spike")
    assert reasons(spark, x) == {}
    flat = np.full(100, 3.0)
    flat[[40, 60]] = [9.0, 6.0]  # six points off is a spike, three aren't
    assert reasons(spark, flat) == {40: "spike"}
    held = x.copy()
    held[30:37] = held[30]
    assert reasons(spark, held) == dict.fromkeys(range(30, 37), "stuck")
    assert reasons(spark, np.repeat(np.arange(20.0), 7)) == {}  # it seldom changes anyway
    assert reasons(spark, np.array([50.0, 99.0, 50.0, 50.0])) == {}


def test_the_details_decide(spark):
    rng = np.random.default_rng(5)
    x = 50 + rng.normal(size=400)
    x[[90, 200, 310]] += 15
    assert reasons(spark, x) == dict.fromkeys((90, 200, 310), "spike")
    assert reasons(spark, x, cut=1e9) == {}  # no coefficient counts: nothing is proposed
    assert reasons(spark, x, cut=0.0) == {}  # every one does: there is no ordinary value left to tell the spread


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_give_what_the_whole_source_gives(spark, seed):
    rng = np.random.default_rng(seed)
    n = 1500
    x = np.round(50 + rng.normal(size=n) * 2, 2)
    at_ = rng.choice(np.arange(20, n - 20), 30, replace=False)
    x[at_] += rng.choice([-1, 1], 30) * rng.uniform(14, 30, 30)
    for a, size in ((230, 6), (252, 9), (500, 300), (1020, 30), (1050, 40), (1490, 10)):  # over the edges of blocks of 256, one next to another
        x[a : a + size] = x[a]
    want = brute_reasons(np.clip(x, 0, 100))
    assert sum(r == "stuck" for r in want.values()) == 395 and sum(r == "spike" for r in want.values()) > 10
    burst = np.where(np.arange(n) % 1400 < 5, 5000, 1 / 600)  # nearly all rows within some minutes
    for kw in ({}, {"block": 64}):
        assert reasons(spark, np.clip(x, 0, 100), **kw) == want
        assert reasons(spark, np.clip(x, 0, 100), burst, **kw) == want


def test_blocks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from plantgauge.operators import spikes

    sizes = []
    real = spikes._usual
    monkeypatch.setattr(spikes, "_usual", lambda blocks, *a: sizes.extend(r["count"] for r in blocks.groupBy("source", "field", "_blk").count().collect()) or real(blocks, *a))
    x = 50 + np.random.default_rng(0).normal(size=3000)
    reasons(spark, x, np.where(np.arange(3000) == 10, 10**5, 1e-3), block=256)
    assert sum(sizes) >= 3000 and max(sizes) <= 256 + 2 * 22


def test_implausible_edges(spark):
    schema = "result_id long, equipment_id string, sensor string, timestamp timestamp, null_pct double, stuck_pct double, reason string"
    rng = np.random.default_rng(2)
    rows = [(i, "A", "s", at(600 * i), 40 + float(rng.normal()), 10.0, "x") for i in range(200)]
    rows[20] = (20, "A", "s", at(12000), 101.0, -1.0, "x")
    rows[30] = (30, "A", "s", at(18000), 90.0, None, "x")
    rows += [rows[30], rows[20], (500, None, None, at(0), float("nan"), 200.0, "x"), (501, "A", "s", None, 500.0, 500.0, "x"), (None, "A", "s", at(0), 500.0, 1.0, "x")]
    got = {(r.result_id, r.field, r.reason) for r in implausible(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(20, "null_pct", "impossible"), (20, "stuck_pct", "impossible"), (30, "null_pct", "spike"), (500, "stuck_pct", "impossible")}
    blocked = {(r.result_id, r.field, r.reason) for r in implausible(spark.createDataFrame(rows, schema), block=64).collect()}
    assert blocked == got
    assert implausible(spark.createDataFrame([], schema)).count() == 0


def test_implausible_judges_a_source_whole(spark):
    schema = "result_id long, equipment_id string, sensor string, timestamp timestamp, null_pct double, stuck_pct double"
    rng = np.random.default_rng(3)
    n = 6000
    x = 50 + rng.normal(size=n) * np.where(np.arange(n) < n // 2, 0.2, 2.0)
    x[2000:2300] = x[2000]  # stuck for longer than many a block and its margins
    x[700] += 6  # usual for the source, whose second half is noisy, if not for the quiet first
    when = 600 * np.arange(n) + np.where(np.arange(n) >= 4000, 600 * 4000, 0)  # a silence
    x[4001] += 40  # a spike beside it
    x[5000:5006] = x[5000]
    rows = spark.createDataFrame([(i, "A", "s", at(when[i]), float(x[i]), None) for i in range(n)], schema)
    want = {(i, "stuck") for i in (*range(2000, 2300), *range(5000, 5006))} | {(4001, "spike")}
    for kw in ({}, {"block": 64}):
        assert {(r.result_id, r.reason) for r in implausible(rows, **kw).collect()} == want
