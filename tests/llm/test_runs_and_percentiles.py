"""Collapsed runs and exact percentiles against brute force."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantgauge.llm.multiselect import clean_scores, day_summaries, from_summaries, multi_select
from plantgauge.llm.runs import collapse_runs, level_of

T0 = datetime(2024, 1, 1)
SCHEMA = "episode_id long, run_id long, start_window_idx long, start_time timestamp, end_time timestamp, peak_level string, chunk string, seg string"


def episodes(rows):
    return [(e, r, i, T0 + timedelta(minutes=30 * (i or 0)), T0 + timedelta(minutes=30 * (i or 0) + 30), lv, "c", "s") for e, r, i, lv in rows]


def brute(rows, reach=6):
    out = []
    by = {}
    for e, r, i, lv in set(rows):
        if i is not None:
            by.setdefault(r, []).append((i, e, lv))
    for r, held in by.items():
        cur = None
        for i, _, lv in sorted(held):
            if cur and lv and cur[1] == lv and i - cur[3] <= reach:
                cur[3], cur[4] = i, cur[4] + 1
            else:
                cur = [r, lv, i, i, 1]
                out.append(cur)
    return sorted(tuple(x) for x in out if x[1])


@pytest.mark.parametrize("chunk", [1, 3, 50, 4096])
def test_runs_match_brute_force_at_any_chunk(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows = [(k, int(rng.choice([1, 1, 1, 2, 3])), None if rng.random() < 0.03 else int(rng.integers(0, 300)), [None, "red", "yellow"][rng.choice(3, p=[0.1, 0.3, 0.6])]) for k in range(300)]
    df = spark.createDataFrame(episodes(rows + rows[:30]), SCHEMA)
    got = collapse_runs(df, F.col("peak_level"), chunk=chunk)
    assert sorted((r.run_id, r.level, r.first_idx, r.last_idx, r.n_events) for r in got.where("level IS NOT NULL").collect()) == brute(rows)


def test_levels_however_written(spark):
    red = ["red", "RED", " Red", "r3d", "R E D", "redd", "rd", "ＲＥＤ", "rde", "r.e.d!"]
    yellow = ["yellow", "Yellow ", "ye11ow", "yel-low", "yelow", "yellwo", "YELLOW!", "yelllow"]
    none = ["", None, "n/a", "  ", "green", "none", "-"]
    df = spark.createDataFrame([(x, w) for w, xs in (("red", red), ("yellow", yellow), (None, none)) for x in xs], "x string, want string").withColumn("got", level_of(F.col("x")))
    assert [(r.x, r.got) for r in df.collect() if r.got != r.want] == []


def test_runs_of_an_empty_table_and_missing_times(spark):
    assert collapse_runs(spark.createDataFrame([], SCHEMA), F.col("peak_level")).count() == 0
    one = spark.createDataFrame([(1, 1, 5, None, None, "red", "c", "s"), (None, 1, 6, None, None, "red", "c", "s"), (2, None, 6, None, None, "red", "c", "s")], SCHEMA)
    (r,) = collapse_runs(one, F.col("peak_level")).collect()
    assert (r.n_events, r.duration_s) == (1, None)


def by_rank(x, mille):
    return sorted(x)[-(-mille * len(x) // 1000) - 1]


@pytest.mark.parametrize("finish", [1, 8, 4096])
def test_percentiles_match_sorting(spark, finish):
    rng = np.random.default_rng(7)
    groups = {"a": np.round(rng.lognormal(0, 3, 900), 2), "b": np.array([5.0]), None: rng.integers(0, 3, 100).astype(float), "c": -rng.lognormal(0, 9, 40)}
    rows = [(g, float(v), "x", 1) for g, x in groups.items() for v in x] + [("d", None, "x", 1), ("d", float("nan"), "x", 1)]
    df = spark.createDataFrame(rows, "g string, v double, t string, w int").repartition(5)
    got = {r.g: r for r in multi_select(df, ["g"], finish=finish).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g].n == len(x)
        assert (got[g].p50, got[g].p90, got[g].p95, got[g].p99) == tuple(by_rank(x, m) for m in (500, 900, 950, 990))


def test_percentiles_of_an_empty_table(spark):
    assert multi_select(spark.createDataFrame([], "g string, v double, w int"), ["g"]).count() == 0


def scores(spark, rows):
    return spark.createDataFrame(rows, "window_id long, equipment_id string, labels int, window_start timestamp, scored_at timestamp, window_score double, n long")


def test_single_days_combine_within_the_stated_error(spark):
    rng = np.random.default_rng(8)
    x = rng.lognormal(0, 4, 600)
    x[:20] = 0
    rows = [(i, "E", 1, T0 + timedelta(hours=i), T0, float(v), 0) for i, v in enumerate(x)]
    rows += [(3, "E", 1, T0, T0 + timedelta(1), 99.0, 0), (None, "E", 1, T0, T0, 1.0, 0), (900, "E", 1, T0, T0, None, 0), (901, "E", 1, T0, T0, float("nan"), 0)]
    clean = clean_scores(scores(spark, rows))
    assert clean.count() == 600 and clean.where("window_id = 3").first().v == x[3]
    days = day_summaries(clean, ["equipment_id"])
    assert days.select("day").distinct().count() == 25
    parts = days.where("day < '2024-01-10'").unionByName(days.where("day >= '2024-01-10'"))
    r = from_summaries(parts, ["equipment_id"]).first()
    for name, mille in (("p50", 500), ("p90", 900), ("p95", 950), ("p99", 990)):
        assert abs(r[name] - by_rank(x, mille)) <= r.max_rel_error * by_rank(x, mille) * (1 + 1e-9)
    edge = day_summaries(spark.createDataFrame([("E", v) for v in (0.0, -2.0, math.inf)], "equipment_id string, v double").withColumn("day", F.lit(1)), ["equipment_id"])
    assert sorted(x.p50 for x in from_summaries(edge, ["equipment_id"]).collect()) == [0.0]
