"""Outlier windows removed per regime by a chain of detectors, each fitted on what the ones before left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .models import isolation_outliers, mahalanobis_outliers, pca_outliers

STEPS = {"isolation_forest": isolation_outliers, "pca": pca_outliers, "mahalanobis": mahalanobis_outliers}


def run_cleaning(rows: DataFrame, steps: list[str], group: str = "regime", least: int = 10, options: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, log): the vectors (<group>, window_id, x) that no step rejects, and (step, <group>, n_before, n_removed).

    A step is one plan over all groups. A group with fewer than `least` windows keeps them all, also before a later
    step. What a step leaves is written to the checkpoint folder, as the next is fitted on it.
    """
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise ValueError(f"unknown cleaning step: {unknown[0]}")
    kept, log = rows, None
    for i, step in enumerate(steps):
        sizes = kept.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n_before"))
        large = kept.join(sizes.where(F.col("n_before") >= least).select("_g"), F.col(group).eqNullSafe(F.col("_g")), "left_semi")
        found = STEPS[step](large, key=group, **(options or {}).get(step, {})).where("outlier").select(F.col(group).alias("_og"), F.col("window_id").alias("_ow"))
        marked = durable(kept.join(found, F.col(group).eqNullSafe(F.col("_og")) & (F.col("window_id") == F.col("_ow")), "left").withColumn("_out", F.col("_ow").isNotNull()).drop("_og", "_ow"))
        said = marked.groupBy(group).agg(F.count("*").alias("n_before"), F.count_if("_out").alias("n_removed")).select(F.lit(i + 1).alias("step_no"), F.lit(step).alias("step"), group, "n_before", "n_removed")
        log = said if log is None else log.unionByName(said)
        kept = marked.where("NOT _out").drop("_out")
    if log is None:
        log = rows.groupBy(group).agg(F.count("*").alias("n_before")).select(F.lit(0).alias("step_no"), F.lit("none").alias("step"), group, "n_before", F.lit(0).cast("long").alias("n_removed"))
    return kept, log


def removal_check(before: DataFrame, kept: DataFrame, group: str = "regime", most_pct: float = 40.0) -> DataFrame:
    """(<group>, n_before, n_kept, removed_pct, too_many): a warning, not a rejection."""
    a = before.groupBy(group).agg(F.count("*").alias("n_before"))
    b = kept.groupBy(group).agg(F.count("*").alias("n_kept"))
    pct = (F.col("n_before") - F.coalesce("n_kept", F.lit(0))) * 100.0 / F.col("n_before")
    return a.join(b, group, "left").select(group, "n_before", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), pct.alias("removed_pct"), (pct > most_pct).alias("too_many"))
