"""Cross-split overlap against all pairs."""

import numpy as np
import pytest

from plantgauge.llm.overlap import alike, anchored_chunks, content_chunks, cross_split_pairs, overlap_fractions, signatures

A = "record_id long, equipment_id string, cleaned_window_ids long, sensor_means array<double>, digest string"
B = "record_id long, equipment_id string, window_ids long, sensor_means array<double>, digest string"


def data(seed, n=150):
    rng = np.random.default_rng(seed)
    base = rng.normal(50, 6, (n, 16)).round(3)
    other = rng.normal(50, 6, (n, 16)).round(3)
    k = n // 3
    other[:k] = (base[:k] + rng.uniform(-0.05, 0.05, (k, 16))).round(3)
    other[k : k + 5] = base[0]
    far = min(10, n - k - 5)
    other[k + 5 : k + 5 + far] = base[:far] + 0.0502  # just too far
    x, y = (np.where(rng.random((n, 16)) < 0.12, np.nan, v) for v in (base, other))
    x[:10], y[:10] = base[:10], other[:10]
    rows = lambda m, first: [(first + i, f"E{i % 4}", i, [None if np.isnan(v) else float(v) for v in r], "d") for i, r in enumerate(m)]
    a, b = rows(x, 1), rows(y, 1001)
    b = [(r, "F" if i % 7 else e, w, m, s) for i, (r, e, w, m, s) in enumerate(b)]
    return a + a[:9] + [(900, "E0", None, None, "d"), (901, None, 3, [float("nan")] * 16, "d"), (None, "E0", 0, [1.0] * 16, "d")], b + b[:9] + [(1900, "E0", None, None, "d"), (1901, None, 3, [], "d")]


def brute(a, b):
    out = set()
    for ra, ea, wa, ma, _ in a:
        for rb, eb, wb, mb, _ in b:
            if ra is None or rb is None:
                continue
            d = [abs(x - y) for x, y in zip(ma or [], mb or [], strict=False) if x is not None and y is not None and x == x and y == y]
            if (len(d) >= 10 and max(d) <= 0.05 + 1e-9) or (ea is not None and ea == eb and wa is not None and wa == wb):
                out.add((ra, rb))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_match_all_pairs(spark, seed):
    a, b = data(seed)
    got = [(r.train_id, r.out_id) for r in cross_split_pairs(spark.createDataFrame(a, A), spark.createDataFrame(b, B)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(a, b)
    assert len(got) > 40


def test_empty_tables(spark):
    none_a, none_b = spark.createDataFrame([], A), spark.createDataFrame([], B)
    assert cross_split_pairs(none_a, none_b).count() == 0
    a, b = data(1, 12)
    assert cross_split_pairs(spark.createDataFrame(a, A), none_b).count() == 0
    assert overlap_fractions(none_a, spark.createDataFrame(b, B)).where("shared > 0").count() == 0


def test_groups_of_copies_meet_as_classes(spark):
    copy = [float(i) for i in range(16)]
    a = spark.createDataFrame([(i, "E", i, copy, "d") for i in range(40)], A)
    b = spark.createDataFrame([(100 + i, "F", i, copy, "d") for i in range(30)], B)
    assert cross_split_pairs(a, b).count() == 1200


def test_anchored_chunks_always_share_one():
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 100, (400, 16))
    y = x + rng.uniform(-0.05, 0.05, x.shape)
    for v in (x, y):
        for r in v:
            r[rng.choice(16, 3, replace=False)] = np.nan
    row, digest = anchored_chunks(x, 0.4, 0.05, 10, False)
    prow, pdigest = anchored_chunks(y, 0.4, 0.05, 10, True)
    for i in range(400):
        assert set(digest[row == i]) & set(pdigest[prow == i])


def test_content_chunks_move_with_the_content():
    cells = np.random.default_rng(5).integers(0, 250, (50, 16)).astype(float)
    there = np.ones((50, 16), bool)
    row, digest, length = content_chunks(cells, there, 1)
    assert np.bincount(row, length).tolist() == [16] * 50
    changed = cells.copy()
    changed[:, 0] += 1
    other = content_chunks(changed, there, 1)[1]
    assert len(set(digest) & set(other)) > 0.5 * len(set(digest))


def test_fractions(spark):
    a, b = data(6)
    got = {r.record_id: r for r in overlap_fractions(spark.createDataFrame(a, A), spark.createDataFrame(b, B)).collect()}
    assert got[1901].fraction is None and got[1901].positions == 0
    assert all(0 <= r.fraction <= 1 for r in got.values() if r.positions)
    same = [float(i) for i in range(16)]
    one = overlap_fractions(spark.createDataFrame([(1, "E", 1, same, "d")], A), spark.createDataFrame([(2, "E", 2, same, "d")], B)).first()
    assert one.fraction == 1.0


def test_signatures_keep_what_is_near(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-40, 90, (3000, 16))
    y = x + rng.uniform(-0.05, 0.05, x.shape)
    y[1000:2000, 3] += rng.choice([-1, 1], 1000) * rng.uniform(0.25, 6.0, 1000)  # out of the neighbouring cells
    y[2000:] = rng.uniform(-40, 90, (1000, 16))
    for v in (x, y):
        v[rng.random(v.shape) < 0.1] = np.nan
    (a1, a2), (b1, b2) = signatures(x, 0.05), signatures(y, 0.05)
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(zip(a1, a2, b1, b2, strict=True))], "i int, s1 long, s2 long, t1 long, t2 long")
    got = {r.i for r in df.where(f"{alike('s1', 't1')} AND {alike('s2', 't2')}").collect()}
    cell = lambda v: np.floor(v / 0.1) % 64
    off = (cell(x) - cell(y))[:, :14] % 64
    want = set(np.flatnonzero((np.isin(off, (0, 1, 63)) | np.isnan(off)).all(1)))
    assert got == want and got >= set(range(1000)) and len(got & set(range(2000, 3000))) < 5
