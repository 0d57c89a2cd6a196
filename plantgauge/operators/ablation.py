"""Variants of a configuration, each run and compared with the base over repeated runs.

Variants are told as changes of the base's leaves. What several variants have in common is built once: a stage is
named by the hash of the parts of the configuration that it depends on, and kept in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ..sources.files import config_hash, merged
from .reports import variant_report


class Stages:
    """Tables by the parts of the configuration that they depend on."""

    def __init__(self) -> None:
        self.held: dict[str, DataFrame] = {}
        self.built = 0

    def get(self, config: dict[str, Any], parts: tuple[str, ...], build: Callable[[dict[str, Any]], DataFrame]) -> DataFrame:
        name = f"{build.__name__}-{config_hash(config, parts)}"
        if name not in self.held:
            self.held[name] = durable(build(config))
            self.built += 1
        return self.held[name]


def run_ablation(base: dict[str, Any], variants: dict[str, tuple[int, dict[str, Any]]], evaluate: Callable[[dict[str, Any], Stages], DataFrame], stages: Stages | None = None) -> DataFrame:
    """(tier, variant, n, mean, std, gain, verdict): every variant, `name: (tier, changes)`, and the base run.

    `evaluate` makes of a configuration a table (seed, metric) with a row per repeated run; null metrics count as runs
    but not towards the mean. The base is variant `baseline` of tier 0. See `reports.variant_report` for the verdict.
    """
    stages = stages or Stages()
    runs = None
    for name, (tier, over) in {"baseline": (0, {}), **variants}.items():
        one = evaluate(merged(base, over), stages).select(F.lit(tier).alias("tier"), F.lit(name).alias("variant"), "seed", "metric")
        runs = one if runs is None else runs.unionByName(one)
    tiers = F.create_map(*[F.lit(x) for name, tier in {"baseline": 0, **{n: t for n, (t, _) in variants.items()}}.items() for x in (name, tier)])
    return variant_report(runs).select(tiers[F.col("variant")].alias("tier"), "*")
