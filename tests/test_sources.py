"""Readers, writers, configuration, the synthetic plant and the live operators."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantgauge.operators import alerts, windows
from plantgauge.sources import files
from plantgauge.sources.synthetic import event_sensor_names, synthetic_plant
from plantgauge.streaming import live

T0 = datetime(2025, 1, 1)


def test_tables_of_csv_and_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,x\n2025-01-01 00:00:15,1.5\nnot a time,2\n")
    df = files.read_table(spark, str(tmp_path / "a.csv"), "timestamp", renamed_from="time", schema="time string, x double")
    assert [(r.timestamp is None, r.x) for r in df.collect()] == [(False, 1.5), (True, 2.0)]
    spark.createDataFrame([(T0, ["a"]), (T0, [])], "timestamp timestamp, tags array<string>").write.parquet(str(tmp_path / "b.parquet"))
    assert sorted(r.tags for r in files.read_table(spark, str(tmp_path / "b.parquet")).collect()) == [[], ["a"]]
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path / "b.parquet"), "time")


def test_catalogs(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"r1": ["b", "a", None, "a"], "r2": []}))
    (tmp_path / "c.csv").write_text("rule_slug,external_tag\nr1,b\nr1,a\nr1,\n,z\n")
    for name in ("c.json", "c.csv"):
        assert [(r.rule_slug, r.sensors) for r in files.read_catalog(spark, str(tmp_path / name)).collect()] == [("r1", ["a", "b"])]
    (tmp_path / "d.csv").write_text("rule,tag\nx,y\n")
    with pytest.raises(ValueError):
        files.read_catalog(spark, str(tmp_path / "d.csv"))


def test_windows_artefacts_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([("E", i // 3, i % 3, float(i), None) for i in range(6)], "equipment_id string, window_id long, row_in_window int, a double, b double")
    files.write_windows(rows, str(tmp_path / "w"), ["a", "b"])
    back = files.read_windows(spark, str(tmp_path / "w"), ["a", "b"])
    assert sorted((r.window_id, r.row_in_window, r.a, r.b) for r in back.collect()) == sorted((r.window_id, r.row_in_window, r.a, r.b) for r in rows.collect())
    files.save_artefacts(str(tmp_path / "m"), {"x": float("nan"), "s": {"b", "a"}}, limits=rows.limit(1))
    metadata, tables = files.load_artefacts(spark, str(tmp_path / "m"))
    assert metadata["x"] is None and metadata["s"] == ["a", "b"] and tables["limits"].count() == 1
    log = str(tmp_path / "health")
    assert files.read_health(spark, log).count() == 0
    week = spark.createDataFrame([("E", "2025-01-06", 1.0, 7)], "equipment_id string, week_start string, mean_score double, n_days long")
    files.append_health(week, log)
    files.append_health(week, log)
    got = files.read_health(spark, log).collect()
    assert len(got) == 2 and got[0].mean_score == 1.0 and got[0].logged_at and got[0].red is None
    np.save(tmp_path / "w.npy", np.arange(24.0).reshape(2, 3, 4))
    npy = files.read_npy_windows(spark, str(tmp_path / "w.npy")).orderBy("window_id", "row_in_window").collect()
    assert len(npy) == 6 and npy[-1]["values"] == [20, 21, 22, 23]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("E", 1, 2.0, "red", True, ["a", "b"]), ("E", 2, float("nan"), "green", True, None)], "equipment_id string, window_id long, score double, zone string, usable boolean, top array<string>")
    files.write_scores(df, str(tmp_path / "s.csv"))
    assert "a,b" in {r.top for r in spark.read.option("header", True).csv(str(tmp_path / "s.csv")).collect()}
    files.write_report(df, str(tmp_path / "r"), 4)
    assert sorted(str(r.score) for r in spark.read.json(str(tmp_path / "r")).collect()) == ["2.0", "None"]
    rows = spark.createDataFrame([("E", 1, 0, T0, 5.0)], "equipment_id string, window_id long, row_in_window int, timestamp timestamp, a double")
    index = files.export_windows(df, rows, ["a"], str(tmp_path / "x"))
    assert [r.window_id for r in index.collect()] == [1]
    with pytest.raises(ValueError):
        files.export_windows(df, rows.where("false"), ["a"], str(tmp_path / "y"))


def test_pages(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1.23456, ["x", "y"]), (None, float("nan"), None)], "name string, score double, top array<string>")
    text = files.write_page(spark, str(tmp_path / "p"), "Alerts & more", {"Scores": df, "None": df.where("false")})
    assert "<h1>Alerts &amp; more</h1>" in text and "<tr><td>a&lt;b</td><td>1.2346</td><td>x, y</td></tr><tr><td></td><td></td><td></td></tr>" in text
    assert spark.read.text(str(tmp_path / "p")).first().value == text
    with pytest.raises(ValueError):
        files.write_page(spark, str(tmp_path / "q"), "t", {"Scores": df}, most=1)


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"t": "1e-5", "n": "x"}, "b": [1]}))
    c = files.read_config(str(tmp_path / "c.json"))
    assert c["a"]["t"] == 1e-5
    assert files.merged(c, {"a": {"n": 2}}) == {"a": {"t": 1e-5, "n": 2}, "b": [1]}
    assert files.config_hash(c, ("a",)) == files.config_hash(files.merged(c, {"b": 2}), ("a",)) and len(files.config_hash(c, ("a",))) == 12
    assert files.json_safe({"a": math.inf, "b": {3, 1}, "c": np.float64(0.12345)}, 2) == {"a": None, "b": [1, 3], "c": 0.12}


def test_synthetic_plant(spark):
    rows, events = synthetic_plant(spark, tags=4, days=4, seconds=60, shutdowns=1)
    assert rows.count() == 5760 and len(rows.columns) == 7
    stop = events.where("type = 'shutdown'").first()
    inside = F.col("row_id").between(stop.start_idx, stop.end_idx - 1)
    down, up = (rows.where(c).agg(F.avg("tag_004")).first()[0] for c in (inside, ~inside))
    assert down < up - 5
    assert event_sensor_names(events.where("type <> 'shutdown'")).first().sensors[0].startswith("tag_")


def stream(spark, tmp_path, batches, schema):
    """Each batch becomes a file, read one at a time in order of name."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_live_alerts_equal_the_batch(spark, tmp_path):
    seq = list(np.random.default_rng(3).choice(["green", "yellow", "red"], 60))
    rows = [("E", i, z) for i, z in enumerate(seq)]
    live_rows = drain(live.live_alerts(stream(spark, tmp_path, [rows[:20], rows[20:41], rows[41:]], "equipment_id string, pos long, zone string"), span=6), "alerts")
    batch = alerts.alert_timeline(spark.createDataFrame(rows, "equipment_id string, pos long, zone string"), ["equipment_id"], mixed_hours=3.0)
    assert sorted((r.pos, r.alert_level) for r in live_rows) == sorted((r.pos, r.alert_level) for r in batch.collect())


def test_live_episodes_close_on_green(spark, tmp_path):
    rows = [("E", i, z) for i, z in enumerate(["green", "red", "yellow", "green", "yellow", "green", "red"])]
    got = drain(live.live_episodes(stream(spark, tmp_path, [rows[:2], rows[2:]], "equipment_id string, pos long, alert_level string")), "episodes")
    assert sorted((r.start_pos, r.end_pos, r.peak_level, r.n_windows) for r in got) == [(1, 2, "red", 2), (4, 4, "yellow", 1)]


def test_live_windows_equal_the_batch(spark, tmp_path):
    rows = [(i, "E", T0 + timedelta(seconds=15 * i), float(i)) for i in range(25)]
    schema = "row_id long, equipment_id string, timestamp timestamp, a double"
    got = drain(live.live_windows(stream(spark, tmp_path, [rows[:7], rows[7:18], rows[18:]], schema), "a", 6), "windows")
    batch = windows.windowed(spark.createDataFrame(rows, schema), 6).groupBy("window_id").agg(F.avg("a").alias("m")).collect()
    assert sorted((r.window_id, r["mean"]) for r in got) == sorted((r.window_id, r.m) for r in batch)


def test_timed_windows(spark, tmp_path):
    rows = [("E", T0 + timedelta(minutes=10 * i), float(i)) for i in range(12)]
    got = drain(live.timed_windows(stream(spark, tmp_path, [rows[:6], rows[6:]], "equipment_id string, timestamp timestamp, a double"), "a"), "timed")
    assert sorted(r["mean"] for r in got)[:2] == [1.0, 4.0]
