"""Windows, alerts, limits, event joins, metrics, drift, models and functions on small inputs with known results."""

import math
import time
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantgauge.functions import stats
from plantgauge.operators import alerts, cleaning, columns, legacy, limits, metrics, models, monitor, reports, scaling, scoring, splits, truth, windows

T0 = datetime(2025, 1, 1)


def table(spark, values, names=("a", "b"), seconds=15):
    rows = [(i, "E1", T0 + timedelta(seconds=seconds * i), *v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "row_id long, equipment_id string, timestamp timestamp, " + ", ".join(f"{n} double" for n in names))


def zones(spark, levels, key="E1"):
    return spark.createDataFrame([(key, i, z, T0 + timedelta(minutes=30 * i), T0 + timedelta(minutes=30 * i + 29)) for i, z in enumerate(levels)], "k string, pos long, zone string, window_start timestamp, window_end timestamp")


def levels_by_hand(seq, span):
    """The rules told in words, on every prefix anew."""
    out = []
    for i in range(len(seq)):
        past = seq[: i + 1]
        red = yellow = 0
        while red < len(past) and past[-1 - red] == "red":
            red += 1
        while yellow < len(past) and past[-1 - yellow] == "yellow":
            yellow += 1
        r, y = (past[-span:].count(z) if span else 0 for z in ("red", "yellow"))
        out.append("red" if red >= 3 else "yellow" if red >= 2 or yellow >= 4 or (r and y and 2 * r + y >= 4) else "green")
    return out


@pytest.mark.parametrize("hours", [None, 3.0])
def test_alert_levels_equal_the_rule_on_every_prefix(spark, hours):
    seq = list(np.random.default_rng(5).choice(["green", "yellow", "red"], 300))
    got = alerts.alert_timeline(zones(spark, seq), ["k"], mixed_hours=hours).orderBy("pos").collect()
    assert [r.alert_level for r in got] == levels_by_hand(seq, 6 if hours else 0)


def test_runs_are_the_same_in_blocks(spark):
    seq = list(np.random.default_rng(6).choice(["green", "red"], 400, p=[0.2, 0.8]))
    df = zones(spark, seq)
    cut = [sorted((r.start_pos, r.end_pos, r.n) for r in alerts.runs(df, ["k"], F.col("zone") == "red", block=b).collect()) for b in (4, 7, 4096)]
    assert cut[0] == cut[1] == cut[2]
    assert sum(n for *_, n in cut[0]) == seq.count("red")


def test_episodes_and_latest_alert(spark):
    df = zones(spark, ["green", "red", "red", "red", "green", "yellow"])
    timed = alerts.alert_timeline(df, ["k"])
    (e,) = alerts.episodes(timed, ["k"]).collect()
    assert (e.start_window_idx, e.end_window_idx, e.peak_level, e.n_windows) == (2, 3, "red", 2)
    last = alerts.latest_alert(df, ["k"]).first()
    assert (last.alert_level, last.consecutive_red, last.consecutive_yellow, last.n_windows) == ("green", 0, 1, 6)
    assert alerts.episodes(alerts.alert_timeline(zones(spark, []), ["k"]), ["k"]).count() == 0


def test_ewma_in_blocks(spark):
    x = [None, 1.0, 4.0, None, 2.0, 8.0, 3.0, 3.0, 9.0]
    want, a = [], None
    for v in x:
        a = a if v is None else v if a is None else 0.2 * v + 0.8 * a
        want.append(a)
    df = spark.createDataFrame([("E", i, v) for i, v in enumerate(x)], "k string, pos long, score double")
    for block in (2, 3, 100):
        got = [r.ewma for r in alerts.smoothed(df, ["k"], block=block).orderBy("pos").collect()]
        assert got == pytest.approx(want, nan_ok=True) if None not in got else [g is None for g in got] == [w is None for w in want]
        assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None])


def test_row_positions_do_not_depend_on_buckets(spark):
    df = table(spark, [(float(i), None) for i in range(250)]).orderBy(F.rand(3))
    for bucket in (10**6, 10**8, 10**12):
        got = windows.row_positions(df, bucket_us=bucket).orderBy("row_id").collect()
        assert [r.row_pos for r in got] == list(range(250)) and {r.n_rows for r in got} == {250}
    assert windows.windowed(df, 120).count() == 240
    assert windows.windowed(df, 120, drop_incomplete=False).count() == 250


def test_bounded_fill(spark):
    gap = [1.0, None, None, None, None, None, 7.0, None]
    rows = windows.windowed(table(spark, [(v, 1.0) for v in gap]), 8)
    assert [r.a for r in windows.bounded_fill(rows, ["a"]).orderBy("row_pos").collect()] == [1, 1, 1, 1, None, None, 7, 7]
    lead = windows.windowed(table(spark, [(v, 1.0) for v in [None, None, 3.0, None]]), 2)
    assert [r.a for r in windows.bounded_fill(lead, ["a"]).orderBy("row_pos").collect()] == [None, None, 3, 3]
    assert [r.a for r in windows.bounded_fill(lead, ["a"], across=True).orderBy("row_pos").collect()] == [None, None, 3, 3]
    assert [r.a for r in windows.fill_both_ways(lead, ["a"], block=1).orderBy("row_pos").collect()] == [3, 3, 3, 3]


def test_quality_dropout_and_columns(spark):
    rng = np.random.default_rng(0)
    vals = [(None if i < 20 else float(rng.normal()), float(i % 2)) for i in range(120)]
    rows = windows.windowed(table(spark, vals), 120)
    q = windows.window_quality(rows, ["a", "b"]).first()
    assert (q.usable, q.n_nulls, q.masked_sensors) == (False, 20, "a")
    assert windows.sensor_dropout(rows, ["a", "b"]).first().dropped
    ns = {r.sensor: r for r in columns.null_or_stuck(rows, ["a", "b"]).collect()}
    assert ns["a"].null_pct == 100 and not ns["a"].kept and ns["b"].kept
    low = {r.sensor: r.dropped for r in columns.low_variance(table(spark, [(1.0, None), (1.0, None), (1.0, None)]), ["a", "b"]).collect()}
    assert low == {"a": True, "b": False}
    assert columns.sensor_columns(rows, exclude=("row_id",))[:2] == ["a", "b"]
    assert columns.validate(rows, "ts", ("a", "z")) == ["Missing timestamp column: ts", "Missing sensor column: z"]
    with pytest.raises(ValueError):
        windows.event_touched(rows)


def test_scaling_and_scores(spark):
    rows = windows.windowed(table(spark, [(float(i), 5.0) for i in range(120)]), 120)
    scaler = {r.sensor: (r.center, r.scale) for r in scaling.fit_robust(rows, ["a", "b"], 1.0).collect()}
    assert scaler["a"] == (59.5, 59.5) and scaler["b"] == (5.0, 1.0)
    z = scaling.apply_scaling(rows, scaling.fit_robust(rows, ["a", "b"], 1.0), ["a", "b"], 20.0)
    assert z.orderBy("row_pos").first().a == pytest.approx(20 * math.asinh(-1 / 20))
    score = scoring.window_scores(scoring.row_error(z, ["a", "b"])).first().score
    x = 20 * np.arcsinh((np.arange(120) - 59.5) / 59.5 / 20)
    assert score == pytest.approx(np.percentile(x**2 / 2, 95))
    top = scoring.contributions(scoring.sensor_errors(z, ["a", "b"])).collect()
    assert [(r.sensor, r["rank"], r.pct) for r in top] == [("a", 1, 100.0)]


def test_limits(spark):
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(size=4000))
    df = spark.createDataFrame([("E", float(v)) for v in x], "k string, score double")
    p = limits.percentile_limits(df, ["k"]).first()
    assert (p.green_yellow, p.yellow_red) == pytest.approx(tuple(np.percentile(x, [90, 99])))
    for spread in ("mad", "iqr"):
        r = limits.robust_limits(df, ["k"], spread=spread).first()
        assert r.green_yellow == pytest.approx(np.exp(1.2816), rel=0.1) and r.yellow_red == pytest.approx(np.exp(2.3263), rel=0.15)
    with pytest.raises(ValueError):
        limits.robust_limits(df, ["k"], spread="x")
    tail = limits.tail_limits(df, ["k"]).first()
    assert tail.fitted and tail.yellow_red == pytest.approx(np.percentile(x, 99), rel=0.1)
    assert not limits.tail_limits(df.limit(50), ["k"]).first().fitted
    nan = spark.createDataFrame([(float("nan"),), (None,), (5.0,)], "s double").select(alerts.zone(F.col("s"), F.lit(1.0), F.lit(5.0)).alias("z"))
    assert [r.z for r in nan.collect()] == ["green", "green", "red"]


def test_elbow_curve_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    ratios = rng.uniform(0, 100, (50, 10))
    df = spark.createDataFrame([("E", w, f"s{j}", float(ratios[w, j])) for w in range(50) for j in range(10)], "k string, window_id long, sensor string, ratio double")
    got = limits.anomaly_curve(df, ["k"], 1, 101, 5).orderBy("threshold").collect()
    grid = np.arange(1, 101 + 5, 5.0)
    assert [r.threshold for r in got] == list(grid)
    assert [r.anomaly_pct for r in got] == pytest.approx([((ratios > t).sum(1) > 1.0).mean() * 100 for t in grid])
    found = limits.elbow(limits.anomaly_curve(df, ["k"], 1, 101, 5), ["k"]).first()
    assert found.flag_threshold in grid and found.stable_threshold in grid


def test_interval_joins_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    a = [("k", i, int(s), int(s + rng.integers(0, 50))) for i, s in enumerate(rng.integers(0, 2000, 60))]
    b = [("k", i, int(s), int(s + rng.integers(0, 400))) for i, s in enumerate(rng.integers(0, 2000, 30))]
    left = spark.createDataFrame(a, "key string, window_id long, ls long, le long")
    right = spark.createDataFrame(b, "key string, node_id long, rs long, re long")
    for half in (False, True):
        got = sorted((r.window_id, r.node_id) for r in truth.overlap_join(left, right, ["key"], 100, half).collect())
        want = sorted((x[1], y[1]) for x in a for y in b if (y[2] < x[3] and x[2] < y[3] if half else y[2] <= x[3] and y[3] >= x[2]))
        assert got == want
    nodes = right.select("key", "node_id", F.col("rs").alias("s"), F.col("re").alias("e"))
    for width in (50, 1000, 10**9):
        near = {r.window_id: (r.nearest_node_id, r.signed_hours) for r in truth.nearest_events(left, nodes, ["key"], width).collect()}
        for _, w, s, e in a:
            cand = [(0 if y[2] <= e and y[3] >= s else (y[2] - e if y[2] > e else y[3] - s), y[2], y[1]) for y in b]
            hits = sorted((c for c in cand if c[0] == 0), key=lambda c: c[1:])
            best = hits[0] if hits else min(cand, key=lambda c: (abs(c[0]), c[1], c[2]))
            assert near[w][0] == best[2] and near[w][1] == pytest.approx(best[0] / 3.6e9)
    none = truth.nearest_events(left, nodes.where("false"), ["key"]).collect()
    assert {(r.nearest_node_id, r.overlap, r.signed_hours) for r in none} == {(None, False, None)}


def test_alignment_raises_on_a_missing_window(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "window_id long") for ids in ((1, 2), (1,)))
    assert truth.aligned_rows(b, a, ["window_id"]).count() == 1
    with pytest.raises(ValueError):
        truth.aligned_rows(a, b, ["window_id"])


def test_ranking_metrics(spark):
    rng = np.random.default_rng(9)
    score, y = rng.integers(0, 20, 200).astype(float), rng.random(200) < 0.3
    df = spark.createDataFrame([("k", float(s), bool(t), float(s + t)) for s, t in zip(score, y, strict=True)], "k string, s double, y boolean, v double")
    pos, neg = score[y], score[~y]
    pairs = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, ["k"], "s", F.col("y")).first().roc_auc == pytest.approx(pairs)
    ap = last = 0.0
    for t in sorted(set(score), reverse=True):
        on = score >= t
        recall, precision = (y & on).sum() / y.sum(), (y & on).sum() / on.sum()
        ap, last = ap + (recall - last) * precision, recall
    assert metrics.average_precision(df, ["k"], "s", F.col("y")).first().average_precision == pytest.approx(ap)
    one = df.where("y")
    assert metrics.average_precision(one, ["k"], "s", F.col("y")).first().average_precision is None
    assert metrics.roc_auc(one, ["k"], "s", F.col("y")).first().roc_auc is None
    assert metrics.spearman(df.withColumn("c", F.lit(1.0)), ["k"], "s", "c").first().rho is None
    assert metrics.spearman(df, ["k"], "s", "s").first().rho == pytest.approx(1)


def test_attribution_known_values(spark):
    rows = [(1, ["a", "b", "c", "d"], ["a"]), (2, ["a", "b", "c", "d"], ["d"]), (3, ["a", "b"], ["z"]), (4, ["a"], ["a"])]
    df = spark.createDataFrame(rows, "w long, ranked array<string>, truth array<string>")
    got = {r.w: (r.map, r.rank_percentile) for r in metrics.attribution(df, ["w"], "ranked", "truth").collect()}
    assert got == {1: (1.0, 0.0), 2: (0.25, 1.0), 4: (1.0, 0.0)}


def test_drift(spark):
    rng = np.random.default_rng(10)
    a, b = rng.normal(size=300), rng.normal(5, 1, 300)
    df = spark.createDataFrame([("k", float(v), False) for v in a] + [("k", float(v), True) for v in b], "k string, v double, recent boolean")
    both = np.sort(np.concatenate((a, b)))
    want = np.abs(np.searchsorted(np.sort(a), both, "right") / 300 - np.searchsorted(np.sort(b), both, "right") / 300).max()
    got = monitor.ks_test(monitor.ks_statistic(df, ["k"], "v", F.col("recent"))).first()
    assert got.ks == pytest.approx(want) and got.is_drifted
    daily = spark.createDataFrame([("k", (T0 + timedelta(days=i)).date(), float(i)) for i in range(30)] + [("m", T0.date(), 1.0)], "k string, day date, error double")
    trend = {r.k: r for r in monitor.trend_test(monitor.rolling_trend(daily, ["k"])).collect()}
    assert trend["k"].trend_slope == pytest.approx(1) and trend["k"].is_increasing
    assert trend["m"].trend_slope == 0 and not trend["m"].is_increasing


def test_distribution_functions():
    assert stats.chi2_quantile(0.975, 10) == pytest.approx(20.4832, abs=1e-3)
    assert stats.chi2_quantile(0.5, 1) == pytest.approx(0.4549, abs=1e-3)
    assert stats.t_two_sided(2.2281, 10) == pytest.approx(0.05, abs=1e-4)
    assert stats.ks_p_value(0.1, 1000, 1000) == pytest.approx(9.07e-5, rel=0.02)
    assert stats.ks_p_value(0.0, 10, 10) == 1
    x = np.random.default_rng(11).pareto(4, 20000)  # shape 1/4, scale 1/4
    assert stats.gpd_fit(x) == pytest.approx((0.25, 0.25), rel=0.15)
    assert stats.gpd_limit(1.0, 0.0, 2.0, 0.1, 0.99) == pytest.approx(1 + 2 * math.log(10))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    x[7] += 60
    x[30] -= 60
    return x, spark.createDataFrame([("r", i, [float(v) for v in row]) for i, row in enumerate(x)], "regime string, window_id long, x array<double>")


def test_moments_and_components(vectors):
    x, df = vectors
    m = models.moments(df.repartition(5), "regime").first()
    assert np.allclose(np.array(m.cov).reshape(5, 5), np.cov(x.T), atol=1e-8) and np.allclose(m["mean"], x.mean(0))
    found = models.component_scores(df, models.principal_components(models.moments(df, "regime"), components=2, key="regime"), "regime").orderBy("window_id").collect()
    _, vecs = np.linalg.eigh(np.cov(x.T))
    v = vecs[:, ::-1][:, :2]
    d = x - x.mean(0)
    assert [r.error for r in found] == pytest.approx((((d - d @ v @ v.T) ** 2).mean(1)).tolist(), abs=1e-8)


def test_detectors_find_injected_windows(vectors):
    _, df = vectors
    for step, run in cleaning.STEPS.items():
        got = {r.window_id for r in run(df, key="regime").where("outlier").collect()}
        assert step == "pca" or {7, 30} <= got
    kept, log = cleaning.run_cleaning(df, ["isolation_forest", "mahalanobis"])
    said = log.orderBy("step_no").collect()
    assert said[0].n_before == 300 and said[1].n_before == 300 - said[0].n_removed
    assert kept.count() == 300 - sum(r.n_removed for r in said)
    with pytest.raises(ValueError):
        cleaning.run_cleaning(df, ["unknown"])
    few = df.limit(5)
    assert cleaning.run_cleaning(few, ["mahalanobis"])[0].count() == 5


def test_regimes_are_ordered(spark):
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, [float(c * 10 + rng.normal()), 0.0]) for i, c in enumerate([2, 0, 1] * 30)], "window_id long, x array<double>")
    got = {r.window_id: r.regime for r in models.regimes(df, starts=3).collect()}
    assert all(got[i] == [2, 0, 1][i % 3] for i in got)


def test_network_learns_and_is_repeatable():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(600, 2)) @ rng.normal(size=(2, 6))
    nets = [models.Network(6, 2, [8]) for _ in range(2)]
    first = [models.train_network(n, x[:500], x[500:], epochs=80, batch=64, rate=3e-3) for n in nets]
    assert first[0] == first[1]
    assert first[0][-1]["val_loss"] < 0.5 * first[0][0]["val_loss"]
    assert nets[0].encode(x).shape == (600, 2)
    assert models.hidden_widths(160, 12) == [80, 40, 20]
    # gradients against differences
    net = models.Network(4, 2, [3])
    y = rng.normal(size=(5, 4))
    _, gw, _ = net.gradients(y)
    w, h = net.w[0], 1e-6
    w[1, 2] += h
    up = net.loss(y)
    w[1, 2] -= 2 * h
    down = net.loss(y)
    assert gw[0][1, 2] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-7)


def trained_rows(spark, n=300):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 4))
    rows = [("val" if i % 5 == 0 else "train", *map(float, r)) for i, r in enumerate(x)]
    rows += [("train", None, 1.0, 1.0, 1.0), ("test", 9e9, 1.0, 1.0, 1.0), (None, 9e9, 1.0, 1.0, 1.0)]
    return x, spark.createDataFrame(rows, "split string, a double, b double, c double, d double")


def test_data_parallel_training_lowers_the_loss(spark):
    _, df = trained_rows(spark)
    net, history = models.fit_network_everywhere(df.repartition(3), ["a", "b", "c", "d"], latent=2, epochs=40, rate=0.02, batch=32)
    assert 10 < len(history) <= 40 and min(h["val_loss"] for h in history) < 0.3 * history[0]["val_loss"]
    x, _ = trained_rows(spark)
    assert net.loss(x[::5]) == pytest.approx(min(h["val_loss"] for h in history))  # the best weights, on all validation rows


def test_one_partition_trains_as_arrays_do(spark):
    x, df = trained_rows(spark)
    net, history = models.fit_network_everywhere(df.coalesce(1), ["a", "b", "c", "d"], latent=2, epochs=4, batch=32)
    own = models.Network(4, 2, seed=42)
    adam, train, val = models.Adam(own), np.delete(x, slice(None, None, 5), 0), x[::5]
    for e, h in enumerate(history):
        losses = adam.epoch(own, train, 32, 1e-3, 1e-5, np.random.default_rng((42, e, 0)))
        assert h["train_loss"] == pytest.approx(np.mean(losses)) and h["val_loss"] == pytest.approx(own.loss(val))
    assert len(history) == 4 and all(np.allclose(a, b) for a, b in zip(net.w, own.w, strict=True))


def test_training_without_rows_and_early_stop(spark):
    _, df = trained_rows(spark)
    assert models.fit_network_everywhere(df.where("split = 'none'"), ["a", "b", "c", "d"], latent=2, epochs=3)[1] == []
    _, history = models.fit_network_everywhere(df, ["a", "b", "c", "d"], latent=2, epochs=30, rate=0.0, patience=4)
    assert len(history) == 5  # nothing gets better after the first


def test_networks_side_by_side_train_as_each_alone_does_and_faster():
    x = np.random.default_rng(16).normal(size=(4000, 10))
    specs = [(a, w, r) for a, w in ((2, None), (3, None), (4, None), (3, [16, 8]), (4, [16, 8])) for r in (1e-3, 3e-3, 1e-2)]
    rates = [r for *_, r in specs]
    alone, common = ([models.Network(10, a, w) for a, w, _ in specs] for _ in range(2))
    adams, others = ([models.Adam(n) for n in nets] for nets in (alone, common))
    stacks = models.Stack.of(list(zip(range(len(specs)), common, others, rates, strict=True)))
    assert [i for i, _ in stacks] == [list(range(9)), list(range(9, 15))]  # by hidden widths, whatever the code's
    for e in range(2):  # the last of its mini-batches is smaller
        began = time.process_time()
        losses = [v for _, s in stacks for v in s.epoch(x.T, 256, 1e-5, np.random.default_rng(e))]
        took, began = time.process_time() - began, time.process_time()
        own = [np.mean(a.epoch(n, x, 256, r, 1e-5, np.random.default_rng(e))) for n, a, r in zip(alone, adams, rates, strict=True)]
        assert took < (time.process_time() - began) / 2
        assert losses == pytest.approx(own)
    for _, s in stacks:
        s.hand_back()
    for n, a, m, b in zip(alone, adams, common, others, strict=True):
        assert a.step == b.step == 32 and all(np.allclose(p, q) for p, q in zip((*n.w, *n.b, *a.m, *a.v), (*m.w, *m.b, *b.m, *b.v), strict=True))
    assert [v for _, s in stacks for v in s.loss(x.T)] == pytest.approx([n.loss(x) for n in alone])


def test_networks_side_by_side_drop_out_in_training_only():
    x = np.vstack([np.random.default_rng(17).normal(size=(10, 5000)), np.ones(5000)])
    nets = [models.Network(10, 4, dropout=d) for d in (0.0, 0.3, 0.1)]
    stack = models.Stack(nets, [models.Adam(n) for n in nets], [1e-3] * 3)
    whole = [a.copy() for *_, a in stack.forward(x)[1] if a is not None]
    for a, b in zip([a for *_, a in stack.forward(x, np.random.default_rng(1))[1] if a is not None][:1], whole, strict=False):
        on = b > 0
        assert [round(1 - (a[i][on[i]] > 0).mean(), 1) for i in range(3)] == [0.0, 0.3, 0.1]
        assert all(np.allclose(a[i][a[i] > 0], (b[i] / (1 - d))[a[i] > 0]) for i, d in enumerate((0.0, 0.3, 0.1)))
    assert np.allclose(stack.loss(x[:-1]), [n.loss(x[:-1].T) for n in nets])


def test_grid_of_networks_over_all_rows(spark):
    _, df = trained_rows(spark)
    grid = models.grid_search(df, ["a", "b", "c", "d"], (1, 2), (1e-3, 2e-2), (0.0,), epochs=15, batch=32).collect()
    assert [(r.latent, r.rate) for r in grid] == [(1, 1e-3), (1, 2e-2), (2, 1e-3), (2, 2e-2)]
    assert [r.best for r in grid] == [r.val_loss == min(g.val_loss for g in grid) for r in grid] and grid[3].best


def test_splits(spark):
    df = spark.createDataFrame([("E", i, i % 2) for i in range(100)], "k string, window_id long, y int")
    n = {(r.y, r.split): r["count"] for r in splits.stratified_split(df, ["y"], ["window_id"], 0.7, 0.15).groupBy("y", "split").count().collect()}
    assert n[0, "train"] == 35 and n[0, "val"] == 7 and n[0, "test"] == 8
    folds = splits.blocked_folds(df, ["k"], "window_id", 7, 2).where("role = 'test'").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in folds] == [len(x) for x in np.array_split(np.arange(100), 7)]
    a = {r.window_id for r in splits.hash_sample(df, ["window_id"], 0.3).collect()}
    assert a == {r.window_id for r in splits.hash_sample(df.repartition(7), ["window_id"], 0.3).collect()} and 10 < len(a) < 50


def test_as_of_positions(spark):
    rows = spark.createDataFrame([("k", t, p) for p, t in enumerate([0, 10, 20, 500])], "k string, us long, row_pos long")
    events = spark.createDataFrame([("k", i, t) for i, t in enumerate([-5, 10, 11, 21, 900])], "k string, event_id long, us long")
    for width in (7, 100, 10**6):
        got = {r.event_id: r.row_pos for r in reports.as_of(rows, events, ["k"], width).collect()}
        assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


def test_legacy(spark):
    a = np.corrcoef(np.random.default_rng(1).normal(size=(5, 50)))
    assert legacy.compare_correlations(a, a)[0] == 0
    rows = windows.windowed(table(spark, [(float(i % 3), float(i)) for i in range(240)]), 120)
    kept, names = legacy.cleaned_rows(rows, F.col("b") > 100, ["a", "b"], 50.0, [])
    assert names == ["a", "b"] and kept.count() == 139
    assert legacy.time_holdout(rows.withColumn("us", F.col("row_pos")), 0.8).where("held_out").count() == 48


def test_ablation_builds_common_stages_once(spark):
    from plantgauge.operators.ablation import Stages, run_ablation

    df = spark.createDataFrame([(r, float(v)) for r in range(3) for v in range(10)], "seed int, x double")

    def scaled(config):
        return df.withColumn("x", F.col("x") * config["scale"])

    def evaluate(config, stages):
        rows = stages.get(config, ("scale",), scaled)
        return rows.groupBy("seed").agg(F.avg((F.col("x") > config["cut"]).cast("double")).alias("metric"))

    stages = Stages()
    got = {r.variant: r for r in run_ablation({"scale": 1.0, "cut": 4.0}, {"low": (1, {"cut": 2.0}), "high": (1, {"cut": 8.0}), "double": (2, {"scale": 2.0})}, evaluate, stages).collect()}
    assert stages.built == 2
    assert {k: (r.tier, r.n, round(r.mean, 6), r.verdict) for k, r in got.items()} == {"baseline": (0, 3, 0.5, "base"), "low": (1, 3, 0.7, "better"), "high": (1, 3, 0.1, "worse"), "double": (2, 3, 0.7, "better")}


def test_tail_fit_of_buckets_equals_that_of_scores():
    x = np.random.default_rng(3).pareto(4, 4000)
    values, counts = np.unique(np.round(x, 2), return_counts=True)
    assert stats.gpd_fit(values, counts) == pytest.approx(stats.gpd_fit(np.repeat(values, counts)))


def test_a_hot_key_in_forest_scores_and_ranks(spark):
    rng = np.random.default_rng(21)
    rows = [("hot" if i % 10 else "cold", i, [float(v) for v in rng.normal(size=3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, window_id long, x array<double>")
    a, b = ({r.window_id: (round(r.score, 9), r.outlier) for r in models.isolation_outliers(df, trees=10, task_rows=n, key="k").collect()} for n in (30, 10**6))
    assert a == b and len(a) == 400
    ties = spark.createDataFrame([("hot", float(i % 3), float(i % 4)) for i in range(600)] + [("one", 1.0, 2.0), (None, 1.0, 2.0), (None, 2.0, 3.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)], "k string, a double, b double")
    got = {r.k: (r.n, r.rho) for r in metrics.spearman(ties, ["k"], "a", "b").collect()}
    assert got["one"] == (1, None) and got["flat"] == (2, None) and got[None] == (2, pytest.approx(1.0))
    assert got["hot"] == (600, pytest.approx(0.0, abs=1e-12))


def test_smoothing_over_blocks_without_values(spark):
    x = [None, None, 3.0, None, None, None, 5.0, 1.0, None, 2.0]
    df = spark.createDataFrame([(None, i, v, "e") for i, v in enumerate(x)], "k string, pos long, score double, extra string")
    want, a = [], None
    for v in x:
        a = a if v is None else v if a is None else 0.2 * v + 0.8 * a
        want.append(a)
    for block in (1, 2, 3, 100):
        rows = alerts.smoothed(df, ["k"], block=block).orderBy("pos").collect()
        assert [r.ewma for r in rows] == [w if w is None else pytest.approx(w) for w in want] and rows[0].extra == "e"


def test_durations_of_many_episodes(spark):
    rows = [("E", 60 * i, 60 * i + 3600 * ((7 * i) % 11 + 1)) for i in range(40)]
    found = spark.createDataFrame([(k, datetime.fromtimestamp(s, UTC), datetime.fromtimestamp(e, UTC)) for k, s, e in rows], "k string, start_time timestamp, end_time timestamp")
    r = alerts.episode_stats(found, spark.createDataFrame([("E", 5)], "k string, n_active long"), ["k"]).first()
    hours = sorted((e - s) / 3600 for _, s, e in rows)
    assert (r.n_episodes, r.n_active, r.min_h, r.median_h, r.max_h) == (40, 5, hours[0], hours[20], hours[-1])
