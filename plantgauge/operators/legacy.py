"""Operators of the earlier generation: plain scalers, row filters, correlation change, holdout by time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_percentiles
from ..functions.stats import t_two_sided
from .spikes import robust_scale, wavelet_details
from .windows import KEY


def cleaned_rows(rows: DataFrame, running: Column, sensors: list[str], max_null_pct: float, on: list[str], key: str = KEY) -> tuple[DataFrame, list[str]]:
    """Rows where the machine runs, without sparse columns, incomplete and repeated rows; and the columns kept.

    The driver sees one row of shares."""
    on_rows = rows.where(F.coalesce(running, F.lit(False)))
    shares = on_rows.agg(*[(F.avg(F.col(s).isNull().cast("int")) * 100).alias(s) for s in sensors]).first()
    kept = [s for s in sensors if (shares[s] or 0.0) <= max_null_pct]
    return on_rows.select(key, *on, *kept).dropna(subset=kept).dropDuplicates([key, *kept]), kept


def plain_scaler(rows: DataFrame, sensors: list[str], key: str = KEY) -> DataFrame:
    """(key, sensor, mean, std, low, high): population deviation; for standard and min-max scaling."""
    parts = [F.struct(F.lit(s).alias("sensor"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("low"), F.max(s).alias("high")).alias(f"_{s}") for s in sensors]
    return rows.groupBy(key).agg(*parts).select(key, F.inline(F.array(*[f"_{s}" for s in sensors])))


def correlation_change(rows: DataFrame, sensors: list[str], hours: int = 12, time: str = "us", key: str = KEY) -> DataFrame:
    """(key, period, n_rows, change): Frobenius norm of the difference of a period's correlation matrix to that of
    the period before; pairs without variance count as 0. Sums and products are aggregated map-side."""
    width = hours * 3_600_000_000
    pairs = [(a, b) for i, a in enumerate(sensors) for b in sensors[i + 1 :]]
    sums = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        sums.append((F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias(f"{a}~{b}"))
    each = rows.groupBy(key, F.floor(F.col(time) / width).alias("period")).agg(F.count("*").alias("n_rows"), *sums)
    order = Window.partitionBy(key).orderBy("period")
    terms = [F.pow(F.coalesce(F.col(f"`{a}~{b}`"), F.lit(0.0)) - F.coalesce(F.lag(f"`{a}~{b}`").over(order), F.lit(0.0)), F.lit(2)) for a, b in pairs]
    change = F.when(F.lag("period").over(order).isNotNull(), F.sqrt(2 * sum(terms, F.lit(0.0))))
    return each.select(key, "period", "n_rows", change.alias("change"))


def time_holdout(rows: DataFrame, share: float = 0.8, time: str = "us", key: str = KEY) -> DataFrame:
    """`rows` with held_out: those after the linear time quantile `share` of their key."""
    cut = exact_percentiles(rows, [key], time, {"_cut": share}).select(F.col(key).alias("_key"), "_cut")
    return rows.join(cut, F.col(key).eqNullSafe(F.col("_key"))).withColumn("held_out", F.col(time) > F.col("_cut")).drop("_key", "_cut")


def wavelet_contamination(rows: DataFrame, sensors: list[str], times: float = 3.0, levels: int = 3, block: int = 4096, key: str = KEY) -> DataFrame:
    """(key, sensor, n, contamination): share of values with a detail coefficient over `times` robust scales, by blocks
    of rows in order of row_pos."""
    kind = rows.schema[key].dataType.simpleString()

    def judge(g: pd.DataFrame) -> pd.DataFrame:
        g, n, found = g.sort_values("row_pos"), [], []
        for s in sensors:
            x = g[s].dropna().to_numpy()
            off = np.zeros(len(x), bool)
            for d in wavelet_details(x, levels) if len(x) > 2 else []:
                off |= np.abs(d) > times * max(robust_scale(d), 1e-12)
            n.append(len(x))
            found.append(int(off.sum()))
        return pd.DataFrame({key: [g[key].iloc[0]] * len(sensors), "sensor": sensors, "n": n, "off": found})

    parts = rows.select(key, "row_pos", *sensors, F.expr(f"row_pos div {block}").alias("_blk")).groupBy(key, "_blk").applyInPandas(judge, f"{key} {kind}, sensor string, n long, off long")
    return parts.groupBy(key, "sensor").agg(F.sum("n").alias("n"), (F.sum("off") / F.nullif(F.sum("n"), F.lit(0))).alias("contamination"))


def compare_correlations(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(Euclidean distance, Welch's t, p-value) of the upper triangles of two correlation matrices."""
    i = np.triu_indices(len(a), 1)
    x, y = a[i], b[i]
    vx, vy = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
    if vx + vy == 0:
        return float(np.linalg.norm(x - y)), 0.0, 1.0
    t = (x.mean() - y.mean()) / math.sqrt(vx + vy)
    dof = (vx + vy) ** 2 / (vx**2 / (len(x) - 1) + vy**2 / (len(y) - 1))
    return float(np.linalg.norm(x - y)), float(t), t_two_sided(t, dof)
