"""Running totals and exact percentiles over groups of any size.

A group is cut into about `parts` ranges of its order column at approximate percentiles; totals run within the
ranges, and the ranges' totals are added up in a small table. So no group is sorted in one task, and none is held in
one aggregation buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def cumulative(df: DataFrame, keys: list[str], by: str, columns: list[str], descending: bool = False, parts: int = 64) -> DataFrame:
    """`df` with <column>_upto, the sum over the rows of the same keys up to this one's `by` (equal ones included),
    and <column>_all, the sum over all of them. Rows with a null `by` are left out; null keys are keys."""
    # read three times below, so written once; where `df` is a table of counts it is small against its source
    rows = durable(df.where(F.col(by).isNotNull())).withColumn("_one", F.lit(1))
    names = [f"_g{i}" for i in range(len(keys) + 1)]
    cuts = F.percentile_approx(by, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 16 * parts)
    bounds = rows.groupBy(*[F.col(k).alias(n) for k, n in zip([*keys, "_one"], names, strict=True)]).agg(cuts.alias("_cuts"))
    on = _same([*keys, "_one"], names)
    placed = rows.join(bounds, on).drop(*names).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(by)))).drop("_cuts")
    per = placed.groupBy(*[F.col(k).alias(n) for k, n in zip([*keys, "_one"], names, strict=True)], F.col("_part").alias("_cum_part")).agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    whole = Window.partitionBy(*names)
    before = whole.orderBy(F.col("_cum_part").desc() if descending else F.col("_cum_part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    handed = per.select(*names, "_cum_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns], *[F.sum(f"_s_{c}").over(whole).alias(f"{c}_all") for c in columns])
    order = Window.partitionBy(*keys, "_part").orderBy(F.col(by).desc() if descending else F.col(by).asc())
    within = placed.withColumns({f"_w_{c}": F.sum(c).over(order) for c in columns})
    joined = within.join(handed, on & (F.col("_part") == F.col("_cum_part")))
    return joined.withColumns({f"{c}_upto": F.col(f"_w_{c}") + F.col(f"_b_{c}") for c in columns}).drop("_one", "_part", "_cum_part", *names, *[f"_w_{c}" for c in columns], *[f"_b_{c}" for c in columns])


def _same(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """(<keys>, n, <name>...): linear percentiles of the values that are neither null nor NaN, as `percentile` gives
    them; groups without any don't come out."""
    held = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = held.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    placed = cumulative(counts, keys, "_v", ["_c"])

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_c_upto") > rank) & (F.col("_c_upto") - F.col("_c") <= rank), F.col("_v")))

    picks = []
    for name, f in fractions.items():
        place = (F.col("_c_all") - 1) * F.lit(float(f))
        low = F.floor(place)
        picks += [at(low).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - low).alias(f"_f_{name}")]
    out = placed.groupBy(*keys).agg(F.max("_c_all").alias("n"), *picks)
    # the same arithmetic as Spark's percentile: equal neighbours stay as they are
    mixed = [F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}")).otherwise((1 - F.col(f"_f_{n}")) * F.col(f"_lo_{n}") + F.col(f"_f_{n}") * F.col(f"_hi_{n}")).alias(n) for n in fractions]
    return out.select(*keys, "n", *mixed)
