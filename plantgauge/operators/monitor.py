"""Drift: trends of daily errors, two-sample tests, and when to retrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import cumulative, exact_percentiles
from ..functions.stats import ks_p_value, t_two_sided


def daily_errors(rows: DataFrame, keys: list[str], start: str, score: str) -> DataFrame:
    """(<keys>, day, error): mean finite score of each day."""
    clean = F.when(F.isnan(score), None).otherwise(F.col(score))
    return rows.groupBy(*keys, F.to_date(start).alias("day")).agg(F.avg(clean).alias("error")).where("error IS NOT NULL")


def rolling_trend(daily: DataFrame, keys: list[str], days: int = 7) -> DataFrame:
    """(<keys>, n_days, trend_slope, r_squared): least squares over the rolling means of `days` days, by position;
    slope 0 and no r_squared below that many days."""
    order = Window.partitionBy(*keys).orderBy("day")
    rolled = daily.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.avg("error").over(order.rowsBetween(-(days - 1), 0)))
    y, x = F.when(F.col("_i") >= days, F.col("_m")), F.when(F.col("_i") >= days, F.col("_i").cast("double"))
    return rolled.groupBy(*keys).agg(F.count("*").alias("n_days"), F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("trend_slope"), F.regr_r2(y, x).alias("r_squared"))


def trend_test(trend: DataFrame, days: int = 7, significance: float = 0.05) -> DataFrame:
    """`trend` with p_value of the slope and is_increasing, by Student's t on n - 2 degrees."""

    @F.pandas_udf("double")
    def p(r2, n):  # noqa: ANN001, ANN202
        out = []
        for r, k in zip(r2, n, strict=True):
            dof = k - days + 1 - 2
            out.append(None if r is None or r != r or dof <= 0 else 0.0 if r >= 1 else t_two_sided((r * dof / (1 - r)) ** 0.5, dof))
        import pandas as pd

        return pd.Series(out, dtype="float64")

    return trend.withColumn("p_value", p("r_squared", "n_days")).withColumn("is_increasing", F.coalesce((F.col("trend_slope") > 0) & (F.col("p_value") < significance), F.lit(False)))


def ks_statistic(rows: DataFrame, keys: list[str], value: str, recent: Column) -> DataFrame:
    """(<keys>, n_base, n_recent, ks): largest distance of the two samples' distribution functions; null if either is
    empty."""
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count_if(~recent).alias("_a"), F.count_if(recent).alias("_b"))
    shares = cumulative(counts, keys, "_v", ["_a", "_b"])
    gap = F.abs(F.col("_a_upto") / F.nullif(F.col("_a_all"), F.lit(0)) - F.col("_b_upto") / F.nullif(F.col("_b_all"), F.lit(0)))
    return shares.groupBy(*keys).agg(F.max("_a_all").alias("n_base"), F.max("_b_all").alias("n_recent"), F.max(gap).alias("ks"))


def ks_test(statistic: DataFrame, significance: float = 0.01) -> DataFrame:
    """`statistic` with p_value (asymptotic) and is_drifted."""

    @F.pandas_udf("double")
    def p(ks, n, m):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([None if k is None or k != k else ks_p_value(k, int(a), int(b)) for k, a, b in zip(ks, n, m, strict=True)], dtype="float64")

    return statistic.withColumn("p_value", p("ks", "n_base", "n_recent")).withColumn("is_drifted", F.coalesce(F.col("p_value") < significance, F.lit(False)))


def retrain_check(rows: DataFrame, keys: list[str], start: str, score: str, recent: Column, weeks: int = 6, multiplier: float = 2.0, significance: float = 0.01) -> DataFrame:
    """(<keys>, trend_hit, drift_hit, base_rate, recent_rate, rate_hit, retrain): an increasing trend over at least
    `weeks` weeks, a drifted distribution, or a share above the base's P90 of over `multiplier` times the base's."""
    trend = trend_test(rolling_trend(daily_errors(rows, keys, start, score), keys)).select(*keys, (F.col("is_increasing") & (F.col("n_days") >= weeks * 7)).alias("trend_hit"))
    drift = ks_test(ks_statistic(rows, keys, score, recent), significance).select(*keys, F.col("is_drifted").alias("drift_hit"))
    held = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_recent", recent)
    p90 = exact_percentiles(held.where("NOT _recent"), keys, score, {"_p90": 0.9}).drop("n")
    above = (F.col(score) > F.col("_p90")).cast("int")
    rates = held.join(p90, keys).groupBy(*keys).agg(F.avg(F.when(~F.col("_recent"), above)).alias("base_rate"), F.avg(F.when(F.col("_recent"), above)).alias("recent_rate"))
    j = rates.join(trend, keys).join(drift, keys).withColumn("rate_hit", F.coalesce(F.col("recent_rate") > F.col("base_rate") * multiplier, F.lit(False)))
    return j.select(*keys, "trend_hit", "drift_hit", "base_rate", "recent_rate", "rate_hit", (F.col("trend_hit") | F.col("drift_hit") | F.col("rate_hit")).alias("retrain"))
