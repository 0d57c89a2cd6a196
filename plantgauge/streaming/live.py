"""Live forms: count-based windows, alert levels and episodes with state per equipment, and time-based windows.

State per equipment is bounded: less than a window of rows, or the last few zones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_windows(stream: DataFrame, sensor: str, size: int = 120, key: str = "equipment_id") -> DataFrame:
    """(key, window_id, start_us, end_us, mean, n) per complete window of `size` rows, as rows arrive.

    A micro-batch's rows are ordered by time; rows that arrive after a later one was counted in are left out, as
    windows are defined on rows in order of time. Rows without a time are left out.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, last, us, xs = state.get if state.exists else (0, -(2**62), [], [])
        us, xs = list(us), list(xs)
        new = pd.concat(list(batches)).dropna(subset=["us"]).sort_values("us", kind="stable")
        out = []
        for u, x in zip(new["us"], new["x"], strict=True):
            if u < last:
                continue
            last = int(u)
            us.append(last)
            xs.append(float(x))
            if len(us) == size:
                held = [v for v in xs if v == v]
                out.append((k[0], window, us[0], us[-1], sum(held) / len(held) if held else None, len(held)))
                window, us, xs = window + 1, [], []
        state.update((window, last, us, xs))
        yield pd.DataFrame(out, columns=[key, "window_id", "start_us", "end_us", "mean", "n"])

    rows = stream.select(key, F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), F.col(sensor).cast("double").alias("x"))
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} string, window_id long, start_us long, end_us long, mean double, n long", "window long, last long, us array<bigint>, xs array<double>", "append", GroupStateTimeout.NoTimeout
    )


def next_level(zone: str, recent: list[str], red: int, yellow: int, to_yellow: int = 2, to_red: int = 3, yellow_run: int = 4, span: int = 0) -> tuple[str, list[str], int, int]:
    """One step of the alert rules: (level, recent zones, red streak, yellow streak)."""
    red, yellow = (red + 1, 0) if zone == "red" else (0, yellow + 1) if zone == "yellow" else (0, 0)
    recent = [*recent, zone][-span:] if span else []
    r, y = recent.count("red"), recent.count("yellow")
    if red >= to_red:
        return "red", recent, red, yellow
    on = red >= to_yellow or yellow >= yellow_run or (r >= 1 and y >= 1 and 2 * r + y >= 4)
    return ("yellow" if on else "green"), recent, red, yellow


def live_alerts(stream: DataFrame, key: str = "equipment_id", pos: str = "pos", **rules: Any) -> DataFrame:
    """(key, pos, zone, alert_level) of zones as they arrive, with the same rules as alerts.alert_timeline.

    `stream` has the key, pos (a long that grows) and zone. Positions not above the last one are left out.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, red, yellow, recent = state.get if state.exists else (-1, 0, 0, [])
        recent, out = list(recent), []
        new = pd.concat(list(batches)).sort_values("pos", kind="stable")
        for p, z in zip(new["pos"], new["zone"], strict=True):
            if p <= last:
                continue
            level, recent, red, yellow = next_level(z, recent, red, yellow, **rules)
            last = int(p)
            out.append((k[0], last, z, level))
        state.update((last, red, yellow, recent))
        yield pd.DataFrame(out, columns=[key, "pos", "zone", "alert_level"])

    rows = stream.select(key, F.col(pos).cast("long").alias("pos"), "zone")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, pos long, zone string, alert_level string", "last long, red int, yellow int, recent array<string>", "append", GroupStateTimeout.NoTimeout)


def live_episodes(stream: DataFrame, key: str = "equipment_id", pos: str = "pos") -> DataFrame:
    """(key, start_pos, end_pos, peak_level, n_windows) of each run of windows that aren't green, when a green one
    closes it. `stream` has the key, pos and alert_level."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, first, peak, n = state.get if state.exists else (-1, -1, 0, 0)
        out = []
        new = pd.concat(list(batches)).sort_values("pos", kind="stable")
        for p, level in zip(new["pos"], new["level"], strict=True):
            if p <= last:
                continue
            rank = {"red": 2, "yellow": 1}.get(level, 0)
            if rank:
                first, peak, n = (int(p) if n == 0 else first), max(peak, rank), n + 1
            elif n:
                out.append((k[0], first, last, ("green", "yellow", "red")[peak], n))
                first, peak, n = -1, 0, 0
            last = int(p)
        state.update((last, first, peak, n))
        yield pd.DataFrame(out, columns=[key, "start_pos", "end_pos", "peak_level", "n_windows"])

    rows = stream.select(key, F.col(pos).cast("long").alias("pos"), F.col("alert_level").alias("level"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} string, start_pos long, end_pos long, peak_level string, n_windows long", "last long, first long, peak int, n long", "append", GroupStateTimeout.NoTimeout)


def timed_windows(stream: DataFrame, sensor: str, every: str = "30 minutes", late: str = "10 minutes", key: str = "equipment_id") -> DataFrame:
    """(key, start_time, end_time, mean, n) per tumbling window of time, closed once the watermark has passed it.

    Where data has gaps these are not the windows of rows."""
    grouped = stream.withWatermark("timestamp", late).groupBy(key, F.window("timestamp", every))
    return grouped.agg(F.avg(sensor).alias("mean"), F.count(sensor).alias("n")).select(key, F.col("window.start").alias("start_time"), F.col("window.end").alias("end_time"), "mean", "n")
