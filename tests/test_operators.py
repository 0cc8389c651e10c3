"""Operators of the history, forecast and record queries."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import grid, keys, odds, scoring
from tidemark.operators import calibration, ledger, pit, reconcile, resampling, strength
from tidemark.sources import calendars, embedded, exports


def test_number_text(spark):
    got = spark.createDataFrame([("02",), (" 2.00",), ("2",), ("",), (None,), ("x",)], "s string").select(keys.number_text(F.col("s")).alias("n")).collect()
    assert len({r["n"] for r in got[:3]}) == 1
    assert [r["n"] for r in got[3:]] == [None, None, "x"]


def test_grid_sums(spark):
    row = spark.range(1).select(grid.pmf(F.lit(1.4)).alias("h"), grid.pmf(F.lit(0.9)).alias("a"))
    got = row.select(grid.outcome_probabilities(F.col("h"), F.col("a")).alias("o"), grid.total_distribution(F.col("h"), F.col("a")).alias("t"), grid.handicap_probabilities(grid.difference_distribution(F.col("h"), F.col("a")), -0.25).alias("q")).first()
    p = lambda r, k: math.exp(-r) * r**k / math.factorial(k)
    cells = {(i, j): p(1.4, i) * p(0.9, j) for i in range(21) for j in range(21)}
    total = sum(cells.values())
    assert got["o"]["home"] == pytest.approx(sum(v for (i, j), v in cells.items() if i > j) / total)
    assert sum(got["o"]) == pytest.approx(1)
    assert got["t"][2] == pytest.approx(sum(v for (i, j), v in cells.items() if i + j == 2) / total)
    assert sum(got["q"]) == pytest.approx(1)


def test_null_rate_gives_null(spark):
    h = grid.pmf(F.lit(None).cast("double"))
    assert spark.range(1).select(grid.outcome_probabilities(h, h).alias("o")).first()["o"] is None


def test_right_closed_bins(spark):
    got = spark.createDataFrame([(0.0,), (0.1,), (0.1000001,), (1.0,), (None,)], "p double").select(scoring.right_closed_bin(F.col("p"), 10).alias("b")).collect()
    assert [r["b"] for r in got[:4]] == [0, 0, 1, 9]


def test_invalid_prices(spark):
    got = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (2.0,), (None,)], "p double").select(odds.valid_price(F.col("p")).alias("v")).collect()
    assert [r["v"] for r in got] == [None, None, None, 2.0, None]


@pytest.mark.parametrize("strict", [False, True])
def test_running_sums_at_equal_times(spark, strict):
    facts = spark.createDataFrame([("k", 5, 1.0), ("k", 5, 2.0), ("k", 7, 4.0), ("k", None, 9.0)], "key string, known int, v double")
    decisions = spark.createDataFrame([("k", 5, 1), ("k", 6, 2), ("z", 9, 3), ("k", 1, 4)], "key string, at int, id int")
    got = {r["id"]: r["s"] for r in pit.running_as_of(facts, decisions, ["key"], "known", "at", {"s": "v"}, strict).collect()}
    assert got == {1: 0.0 if strict else 3.0, 2: 3.0, 3: 0.0, 4: 0.0}


def test_one_to_one_statuses(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (4, 40), (None, 50)], "k int, id int")
    right = spark.createDataFrame([(1, 11), (2, 22), (3, 33), (None, 51)], "k int, id int")
    got = rows(reconcile.one_to_one(left, right, ["k"], "id", "id"))
    assert got == sorted([(1, 10, 11, "matched"), (2, None, None, "duplicate"), (3, None, 33, "right_only"), (4, 40, None, "left_only")], key=repr)


def test_merge_refuses_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    good = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    bad = spark.createDataFrame([(1, "a"), (2, "x")], "k int, v string")
    assert reconcile.insert_only_merge(old, good, "k", ["v"]).count() == 3
    with pytest.raises(Exception, match="merge refused"):
        reconcile.insert_only_merge(old, bad, "k", ["v"]).collect()


def test_interval_match_boundaries(spark):
    left = spark.createDataFrame([(1, "h", 0), (2, "h", 100), (3, "x", 0)], "id int, k string, t int")
    right = spark.createDataFrame([(7, "h", 12), (8, "h", 95), (9, "h", 112), (6, "h", 13)], "r int, k string, t int")
    got = {r["left_id"]: (r["status"], r["candidates"]) for r in reconcile.interval_match(left, right, ["k"], "t", "t", "id", "r", 12).collect()}
    assert got == {1: ("MATCHED", 1), 2: ("AMBIGUOUS", 2), 3: ("UNMATCHED", 0)}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(50)], "x int, y string")
    one = reconcile.content_fingerprint(a).first()
    assert reconcile.content_fingerprint(a.orderBy(F.col("x").desc()).repartition(3)).first() == one
    assert reconcile.content_fingerprint(a.where("x > 0")).first()["fingerprint"] != one["fingerprint"]
    assert reconcile.content_fingerprint(a.where("false")).first()["rows"] == 0


def test_elo_is_streamed_in_order(spark):
    rng = random.Random(2)
    data = [(i, i % 3, rng.randint(0, 5), rng.randint(6, 9), rng.randint(0, 3), rng.randint(0, 3), i // 2) for i in range(200)]
    df = spark.createDataFrame(data, "match_id long, league long, home long, away long, gh long, ga long, kick long")
    got = {r["match_id"]: r["expected"] for r in strength.elo_ratings(df).collect()}
    for league in range(3):
        rating = {}
        for m, lg, h, a, gh, ga, k in sorted((d for d in data if d[1] == league), key=lambda d: (d[6], d[0])):
            e = 1 / (1 + 10 ** (-(rating.get(h, 1500) + 100 - rating.get(a, 1500)) / 400))
            assert got[m] == pytest.approx(e)
            s = 1 if gh > ga else 0.5 if gh == ga else 0
            rating[h], rating[a] = rating.get(h, 1500) + 20 * (s - e), rating.get(a, 1500) - 20 * (s - e)


def test_pava():
    assert calibration.pava(np.array([1.0, 0.0, 2.0, 1.0]), np.ones(4)).tolist() == [0.5, 0.5, 1.5, 1.5]


def test_quantile_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    got = {r["x"]: r["part"] for r in calibration.quantile_bin(df, "x", 5).collect()}
    edges = np.percentile(np.arange(1, 11), [20, 40, 60, 80])
    assert got == {float(i): int((edges < i).sum()) for i in range(1, 11)}


def test_fisher_and_chi2():
    assert resampling.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert resampling.chi2_two_by_two(30, 20, 20, 30) == pytest.approx(0.0455002639)


def test_bootstrap_is_repeatable_and_near(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(rng.normal(0.3, 1, 600))] + [("g", 1000, None)], "g string, id long, v double")
    a = resampling.bootstrap_means(df, "g", "v", "id", draws=400).first()
    b = resampling.bootstrap_means(df.repartition(3), "g", "v", "id", draws=400).first()
    assert (a["low"], a["high"]) == pytest.approx((b["low"], b["high"]))
    assert a["n"] == 600 and a["low"] < a["mean"] < a["high"]
    assert a["high"] - a["low"] == pytest.approx(2 * 1.96 / math.sqrt(600), rel=0.25)


def test_dyadic_variance_by_pairs(spark):
    rng = random.Random(4)
    data = [(rng.randint(0, 4), rng.randint(0, 4), rng.random(), rng.random()) for _ in range(40)]
    data = [(a, b, x, y) for a, b, x, y in data if a != b]
    got = resampling.dyadic_slope(spark.createDataFrame(data, "l int, r int, x double, y double"), "x", "y", "l", "r").first()
    x, y = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    g = (x - x.mean()) * (y - y.mean() - slope * (x - x.mean()))
    meat = sum(g[i] * g[j] for i in range(len(g)) for j in range(len(g)) if {data[i][0], data[i][1]} & {data[j][0], data[j][1]})
    assert got["slope"] == pytest.approx(slope)
    assert got["slope_variance"] == pytest.approx(meat / ((x - x.mean()) ** 2).sum() ** 2)


def test_drawdown_starts_at_the_opening_balance(spark):
    bets = spark.createDataFrame([(1, -10.0), (2, 5.0), (3, 20.0), (4, -15.0)], "t int, p double").withColumn("k", F.lit("a"))
    path = ledger.running_balance(bets, ["k"], ["t"], "p", 100.0)
    assert [round(r["drawdown"], 4) for r in path.orderBy("t").collect()] == [-0.1, -0.05, 0.0, round(100 / 115 - 1, 4)]


def test_unknown_side_raises(spark):
    t = spark.createDataFrame([("w", "hold", 1.0, 1)], "w string, side string, size double, t int")
    with pytest.raises(Exception, match="unknown side"):
        ledger.positions_as_of(t, ["w"], "t", F.lit(5), F.col("side"), "size").collect()


def test_csv_quarantine(spark):
    lines = spark.createDataFrame([("1,a,2.5",), ("x,b,1",), ("",)], "value string")
    got = exports.parse_csv(lines, "value", "k long, s string, p double").collect()
    assert got[0]["k"] == 1 and got[0]["_bad"] is None
    assert got[1]["_bad"] == "x,b,1"


def test_embedded_literal_round_trip(spark):
    bodies = ['{"a": "Névé \\"x\\""}', "{}", "日本 'q'"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", embedded.literal_of(embedded.as_page("b")).alias("c"))
    assert all(r["b"] == r["c"] for r in df.collect())
    assert embedded.unescape(r"\x7B\"k\": 1\x7D") == '{"k": 1}'


def test_calendar_lines():
    text = "= Cup\n# Fri Aug/14 - Sat May/22 2027\n» Round 1\n[Fri Aug/14]\n  18:00  A FC (FRA) v B United  2-1 (1-0)\n  C v D [postponed]\n  E v F 3-2 a.e.t.\n▪ Semi-finals\n[Sat Jan/2]\n G v H\n 20.30 I v J 4-3 pen. 1-1\nnonsense\n[Foo/99]\n K v L"
    got = calendars.parse_text(text)
    assert [(r[1], r[2].isoformat() if r[2] else None, *r[3:]) for r in got] == [
        ("Round 1", "2026-08-14", "18:00", "A FC", "FRA", "B United", None, 2, 1, None, None),
        ("Round 1", "2026-08-14", "18:00", "C", None, "D", None, None, None, "postponed", None),
        ("Round 1", "2026-08-14", "18:00", "E", None, "F", None, None, None, "a.e.t", None),
        ("Semi-finals", "2027-01-02", None, "G", None, "H", None, None, None, None, None),
        ("Semi-finals", "2027-01-02", "20:30", "I", None, "J 4-3", None, None, None, "pen", None),
        ("Semi-finals", "2027-01-02", None, None, None, None, None, None, None, None, "unreadable"),
        ("Semi-finals", None, None, None, None, None, None, None, None, None, "bad date"),
        ("Semi-finals", None, None, "K", None, "L", None, None, None, None, "no date"),
    ]
