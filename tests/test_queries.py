"""Every registered query of the core against its SQL on the smallest data set, and at another partitioning."""

import inspect
import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect, rows_of

SF = "/root/testdata/sf0.001"
CORE = [k for m in entry._modules() if ".llm" not in m.__name__ for k in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [k for k in CORE if k in entry.oracle_sql()])
def test_query_equals_its_sql(spark, con, name):
    said = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert said.startswith("same"), said


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["p2_found", "p3_grid", "p6_found", "window_quality", "alert_episodes", "nearest_event", "event_metrics"])
def test_partitioning_does_not_show(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = entry.queries()[name](spark, SF)
            got.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
        assert got[0] == got[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_models_are_fitted_whole(spark, monkeypatch):
    from plantgauge.operators import models
    from plantgauge.plans import models as plans
    from plantgauge.plans.base import SENSORS

    given = {}
    real = models.fit_network_everywhere
    monkeypatch.setattr(models, "fit_network_everywhere", lambda rows, *a, **kw: given.update(rows=rows.where("split = 'train'").dropna(subset=SENSORS).count(), **kw) or real(rows, *a, **(kw | {"epochs": 1})))
    larger = SF.replace("0.001", "0.01")  # the smallest has no complete training rows
    plans.network_windows(spark, larger)
    trained = plans.scaled_rows(spark, larger).where("row_pos < floor(n_rows * 0.7D)").dropna(subset=SENSORS).count()
    assert given["rows"] == trained > 0 and "epochs" not in given and inspect.signature(models.fit_networks).parameters["epochs"].default == 150
    starts = []
    monkeypatch.setattr(models, "regimes", lambda rows, *a, **kw: starts.append(kw.get("starts", 10)) or rows.withColumn("regime", rows["window_id"]))
    plans.window_regimes(spark, SF)
    plans.component_regimes(spark, SF)
    assert starts == [10, 10]
    assert models.isolation_outliers.__defaults__[1] == 200


def test_rows_of_the_grid_stay_where_they_are(spark, monkeypatch):
    from plantgauge.operators import models
    from plantgauge.plans import models as plans
    from plantgauge.plans.base import EQ, SENSORS

    monkeypatch.setattr(models, "grid_search", lambda rows, *a, **kw: rows)
    got, expected = plans.network_grid(spark, SF), plans.scaled_rows(spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join LeftOuter" in x and "_key" in x and "rightHint=(strategy=broadcast)" in x], plan
    sides = [plans.rounded(df.select(EQ, "window_id", "row_in_window", *SENSORS)) for df in (got, expected)]
    assert sides[0].count() > 0 and sides[0].exceptAll(sides[1]).isEmpty() and sides[1].exceptAll(sides[0]).isEmpty()
