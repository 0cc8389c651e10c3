"""Queries that must do the whole job: no row, draw or pair is left out."""

from __future__ import annotations

import inspect

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import calibration, resampling, strength
from tidemark.plans import catalogue, records
from tidemark.plans.adapters import matches
from tidemark.session import table

Q = catalogue.REGISTRY.queries


def test_every_match_gets_a_status(spark, data):
    ids = rows(matches(spark, data).select("match_id"))
    assert rows(Q["interval_match"](spark, data).select("left_id")) == ids
    keys = matches(spark, data).select("league", "home", "away", F.floor(F.col("kick") / 24).alias("day")).distinct()
    assert keys.exceptAll(Q["reconcile_one_to_one"](spark, data).where("status <> 'right_only'").select(*keys.columns)).count() == 0


def test_every_order_is_compared(spark, data):
    orders = table(spark, data, "orders")
    assert Q["record_diff"](spark, data).where("change <> 'new'").count() == orders.count()
    assert {r["change"] for r in Q["record_diff"](spark, data).select("change").distinct().collect()} == {"new", "missing", "modified", "unchanged"}
    assert Q["field_difference_stats"](spark, data).first()["n"] == orders.count()


@pytest.mark.parametrize("name", ["interval_match", "reconcile_one_to_one", "record_diff", "field_difference_stats", "insert_only_merge"])
def test_no_modulo_filter(name):
    assert "%" not in inspect.getsource(getattr(records, name))


def test_rho_keeps_within_the_bounds_of_high_scores(spark):
    low = [(1, 1, 0, 1.0, 1.0)] * 5 + [(2, 0, 0, 1.0, 1.0)] * 5 + [(3, 1, 1, 1.0, 1.0)] * 5
    high = [(1, 5, 4, 4.0, 1.5), (2, 6, 0, 0.8, 5.0), (3, 3, 3, 3.0, 3.0)]
    got = {r["league"]: r["rho"] for r in strength.fit_low_score_rho(spark.createDataFrame(low + high, "league long, gh long, ga long, lam double, mu double")).collect()}
    assert got[1] == pytest.approx(1 / 6, abs=1e-4)
    assert got[2] == pytest.approx(-0.2, abs=1e-4)
    assert got[3] == pytest.approx(-1 / 3, abs=1e-4)


def test_bootstrap_takes_as_many_draws_as_the_reference(spark):
    """A p value is a multiple of 2 / draws: one of 10,000 is finer than any of 1,000."""
    df = spark.createDataFrame([("g", i, 0.22 + (-1.0) ** i) for i in range(100)], "g string, id long, v double")
    p = resampling.bootstrap_means(df, "g", "v", "id").first()["p_value"]
    assert 0 < p < 0.1 and round(p * 5000, 6) == round(p * 5000) and round(p * 500, 6) != round(p * 500)


def test_forecasts_are_fitted_as_they_are(spark):
    df = spark.createDataFrame([("g", 0.30001, 0), ("g", 0.30002, 1), ("g", 0.30003, 1), ("g", 0.7, 1), ("g", 0.7, 0)], "g string, p double, y int")
    assert rows(calibration.isotonic_curve(df, "g", "p", "y").select("x")) == [(0.30001,), (0.30002,), (0.30003,), (0.7,)]
    near = spark.createDataFrame([("g", 0.00001 * k, int(k >= 5 and k != 7)) for k in range(1, 10)] + [("g", 0.00008, 0)], "g string, p double, y int")
    assert calibration.logistic_recalibration(near, "g", "p", "y").first()["slope"] > 0.5
