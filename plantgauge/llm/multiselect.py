"""Exact percentiles per group by distributed multi-select, and day summaries that can be added up.

Each round, every partition proposes the median of its active values; the weighted median of the proposals is the
pivot of a range; the active weights are counted below, at and above it; and the sides that hold no wanted rank are
discarded. All targets of a group whose ranks still lie in the same range share it, so ranges are disjoint and a value
is in one at most. One pass a round: while it counts, a partition already proposes a median for either side. Values
stay in the partitions that they are in; only counts and proposals are shuffled. Once no active range holds more than
`finish` values, the ranges are ranked outright.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_BOUND, durable

PER_MILLE = {"p50": 500, "p90": 900, "p95": 950, "p99": 990}


def _weighted_median(proposals: str, total: str) -> Column:
    """The proposal at which the running weight reaches half of `total`."""
    return F.expr(
        f"""aggregate(array_sort(filter({proposals}, x -> x.m IS NOT NULL)), named_struct('c', 0L, 'm', cast(null as double)),
        (a, x) -> named_struct('c', a.c + x.w, 'm', if(a.m IS NULL AND 2 * (a.c + x.w) >= {total}, x.m, a.m))).m"""
    )


def _within(data: DataFrame, ranges: DataFrame, n: int, salts: int = 32) -> DataFrame:
    """The values that lie in an active range, with the range's columns.

    `n` ranges go out whole if they are small; else both sides are salted, so that a group of any size is spread.
    """
    inside = (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    if n * 512 <= BROADCAST_BOUND:
        return data.join(F.broadcast(ranges), "g").where(inside)
    salted = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return data.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(salts))).join(salted, ["g", "_salt"]).where(inside).drop("_salt")


def multi_select(values: DataFrame, keys: list[str], value: str = "v", weight: str = "w", targets: dict[str, int] | None = None, finish: int = 4096) -> DataFrame:
    """(<keys>, n, <target>...): per group the weighted size and, of each target in per mille, the exact value at rank
    ceil(target * n / 1000), counted from 1 in ascending order.

    Null keys are a group of their own. Null and NaN values and weights of 0 or less don't count; infinities do. Groups without any
    value don't come out. Ties count each. The error is 0. No column but the named ones is read.
    """
    targets = targets or PER_MILLE
    # a struct of the keys is itself never null, so it joins on equality where a key is null
    group = F.struct(*[F.col(k) for k in keys]).alias("g")
    data = durable(values.select(group, F.col(value).cast("double").alias("v"), F.col(weight).cast("long").alias("w")).where("v IS NOT NULL AND NOT isnan(v) AND w > 0"))
    proposals = data.groupBy("g", F.spark_partition_id().alias("pid")).agg(F.percentile_approx("v", 0.5, 200).alias("m"), F.sum("w").alias("w"), F.count("*").alias("rows"))
    sizes = proposals.groupBy("g").agg(F.collect_list(F.struct("m", "w")).alias("props"), F.sum("w").alias("n"), F.sum("rows").alias("rows"))
    wanted = F.array(*[F.struct(F.lit(t).alias("t"), F.expr(f"({m} * n + 999) div 1000 - 1").alias("r")) for t, m in targets.items()])
    missing = F.lit(None).cast("double")
    state = durable(sizes.select("g", "n", F.lit("all").alias("side"), missing.alias("lo"), missing.alias("hi"), F.lit(0).cast("long").alias("below"), _weighted_median("props", "n").alias("p"), "rows", wanted.alias("targets")))
    answers, stored = [], None
    while True:
        ranges = state.where("side <> 'eq'")
        most, active, count = ranges.agg(F.max("rows"), F.sum("rows"), F.count("*")).first()
        if not count:
            break
        live = _within(data, ranges, count)
        if most <= finish:
            order = Window.partitionBy("g", "below").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            ranked = live.select("g", "n", "below", "targets", "v", "w").withColumn("upto", F.sum("w").over(order) + F.col("below"))
            answers.append(ranked.select("g", "n", F.col("v").alias("answer"), F.explode(F.expr("filter(targets, x -> upto > x.r AND upto - w <= x.r)")).alias("x")))
            break
        if stored is not None and 2 * active < stored:
            # The discarded ranges are left behind, so the stored rows shrink as the search goes on.
            data = durable(live.select("g", "v", "w"))
            live = _within(data, ranges, count)
        stored = active if stored is None or 2 * active < stored else stored
        part = live.groupBy("g", "below", "p", F.spark_partition_id().alias("pid")).agg(
            F.sum(F.expr("if(v < p, w, 0L)")).alias("lt"),
            F.sum(F.expr("if(v = p, w, 0L)")).alias("eq"),
            F.sum(F.expr("if(v > p, w, 0L)")).alias("gt"),
            F.sum(F.expr("if(v < p, 1L, 0L)")).alias("n_lt"),
            F.sum(F.expr("if(v > p, 1L, 0L)")).alias("n_gt"),
            F.percentile_approx(F.expr("if(v < p, v, null)"), 0.5, 200).alias("m_lt"),
            F.percentile_approx(F.expr("if(v > p, v, null)"), 0.5, 200).alias("m_gt"),
        )
        per = part.groupBy("g", "below").agg(
            *[F.sum(c).alias(c) for c in ("lt", "eq", "gt", "n_lt", "n_gt")],
            F.collect_list(F.struct(F.col("m_lt").alias("m"), F.col("lt").alias("w"))).alias("props_lt"),
            F.collect_list(F.struct(F.col("m_gt").alias("m"), F.col("gt").alias("w"))).alias("props_gt"),
        )
        names = ("side", "lo", "hi", "below", "p", "rows", "targets")
        split = [
            (F.lit("lt"), F.col("lo"), F.col("p"), F.col("below"), _weighted_median("props_lt", "lt"), F.col("n_lt"), F.expr("filter(targets, x -> x.r < below + lt)")),
            (F.lit("eq"), F.col("p"), F.col("p"), F.col("below"), F.col("p"), F.lit(0).cast("long"), F.expr("filter(targets, x -> x.r >= below + lt AND x.r < below + lt + eq)")),
            (F.lit("gt"), F.col("p"), F.col("hi"), F.expr("below + lt + eq"), _weighted_median("props_gt", "gt"), F.col("n_gt"), F.expr("filter(targets, x -> x.r >= below + lt + eq)")),
        ]
        sides = F.inline(F.array(*[F.struct(*[c.alias(n) for c, n in zip(x, names, strict=True)]) for x in split]))
        state = durable(per.join(ranges.drop("side", "rows"), ["g", "below"]).select("g", "n", sides).where("size(targets) > 0"))
        answers.append(state.where("side = 'eq'").select("g", "n", F.col("p").alias("answer"), F.explode("targets").alias("x")))
    found = state.select("g", "n", missing.alias("answer"), F.explode("targets").alias("x")).where("false")
    for a in answers:
        found = found.unionByName(a)
    return found.groupBy("g").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("x.t") == t, F.col("answer"))).alias(t) for t in targets]).select(*[F.col("g")[k].alias(k) for k in keys], "n", *targets)


def clean_scores(scores: DataFrame) -> DataFrame:
    """(window_id, equipment_id, labels, day, v): scores that are neither null nor NaN, each window_id once.

    Of rows with one window_id that differ, the one scored first counts (then the smaller score); rows without a
    window_id are left out. `day` is the date of window_start.
    """
    rows = scores.select("window_id", "equipment_id", "labels", F.to_date("window_start").alias("day"), F.col("window_score").cast("double").alias("v"), "scored_at").where("window_id IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    # One shuffle for both steps. Copies mostly differ in scored_at alone: hashing leaves one row of them, then few are compared.
    one = rows.repartition("window_id").groupBy("window_id", "equipment_id", "labels", "day", "v").agg(F.min("scored_at").alias("scored_at"))
    return one.groupBy("window_id").agg(F.min(F.struct("scored_at", "v", "equipment_id", "labels", "day")).alias("x")).select("window_id", "x.equipment_id", "x.labels", "x.day", "x.v")


def day_summaries(scores: DataFrame, keys: list[str], day: str = "day", value: str = "v", error: float = 0.005) -> DataFrame:
    """(<keys>, day, bucket, n): counts in buckets whose bounds grow by (1 + error) / (1 - error).

    Summaries of any days or partitions are combined by adding the counts of equal buckets; a percentile read from
    them is off by at most `error` of its value. Bucket k > 0 and k < 0 hold positive and negative values with
    |k| - 2**20 the logarithm's ceiling; bucket 0 holds 0. Infinite values fall into the buckets +-2**21.
    """
    base = math.log((1 + error) / (1 - error))
    v = F.col(value)
    k = (F.ceil(F.log(F.abs(v)) / F.lit(base)) + F.lit(2**20)).cast("long")
    k = F.when(v == 0, F.lit(0).cast("long")).when(F.abs(v) == float("inf"), F.lit(2**21).cast("long")).otherwise(k)
    return scores.where(v.isNotNull() & ~F.isnan(v)).withColumn("bucket", F.when(v < 0, -k).otherwise(k)).groupBy(*keys, day, "bucket").agg(F.count("*").alias("n"))


def from_summaries(summaries: DataFrame, keys: list[str], targets: dict[str, int] | None = None, error: float = 0.005) -> DataFrame:
    """Percentiles of the days in `summaries` together, by multi-select over the buckets; off by `error` at most."""
    gamma = (1 + error) / (1 - error)
    middle = F.pow(F.lit(gamma), F.abs(F.col("bucket")) - F.lit(2**20)) * F.lit(2 / (gamma + 1))
    middle = F.when(F.col("bucket") == 0, 0.0).when(F.abs(F.col("bucket")) == 2**21, float("inf")).otherwise(middle)
    values = summaries.withColumn("v", F.when(F.col("bucket") < 0, -middle).otherwise(middle)).withColumnRenamed("n", "w")
    return multi_select(values, keys, targets=targets).withColumn("max_rel_error", F.lit(error))
