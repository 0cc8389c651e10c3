"""Models, value arithmetic, resampling, walk-forward fits and imports against direct computation."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import odds
from tidemark.operators import calibration, features, models, pit, ranks, resampling, strength
from tidemark.plans import intake

MATCH = "match_id long, league long, home long, away long, kick long, known long, gh long, ga long"


def league(n=60, seed=1, teams=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        h, a = rng.sample(range(teams), 2)
        out.append((i, i % 2, h, a, 10 * i, 10 * i + 2, rng.randint(0, 4), rng.randint(0, 3)))
    return out


def fitted(train):
    """Base, factor and per team (attack, defence) by the plain formulas."""
    n = len(train)
    base = sum(m[6] + m[7] for m in train) / (2 * n)
    away = sum(m[7] for m in train)
    factor = sum(m[6] for m in train) / away if away else 1.0
    team = {}
    for t in {x for m in train for x in (m[2], m[3])}:
        s = [m[6] if m[2] == t else m[7] for m in train if t in (m[2], m[3])]
        c = [m[7] if m[2] == t else m[6] for m in train if t in (m[2], m[3])]
        team[t] = (max(sum(s) / len(s) / base, 1e-9), max(sum(c) / len(c) / base, 1e-9))
    return base, factor, team


def test_strengths_use_the_plain_home_factor_on_the_home_rate_only(spark):
    data = league()
    m = spark.createDataFrame(data, MATCH)
    d = m.select("match_id", "league", "home", "away", F.col("kick").alias("at"))
    got = {r["match_id"]: r for r in strength.strengths_as_of(m, d).collect()}
    for i, lg, h, a, kick, *_ in data:
        train = [x for x in data if x[1] == lg and x[5] <= kick]
        if not train:
            assert got[i]["lam"] is None and got[i]["mu"] is None
            continue
        base, factor, team = fitted(train)
        (ah, dh), (aa, da) = team.get(h, (1.0, 1.0)), team.get(a, (1.0, 1.0))
        assert got[i]["lam"] == pytest.approx(base * ah * da * factor)
        assert got[i]["mu"] == pytest.approx(base * aa * dh)


def test_hand_worked_strengths(spark):
    """Two matches 3-1 and 1-1: base 1.5, factor 2, attack of the first home side 2, defence 2 / 3."""
    m = spark.createDataFrame([(1, 0, 1, 2, 0, 0, 3, 1), (2, 0, 3, 4, 0, 0, 1, 1)], MATCH)
    t = {r["team"]: r for r in models.team_strengths(m).collect()}
    assert (t[1]["base"], t[1]["factor"]) == (1.5, 2.0)
    assert t[1]["attack"] == pytest.approx(2.0) and t[1]["defence"] == pytest.approx(2 / 3)
    # Raw home factor: 3 / (1.5 x 2 x 2) = 0.5; drawn to 2 by ten pseudo matches: (0.5 + 20) / 11.
    assert t[1]["raw_factor"] == pytest.approx(0.5) and t[1]["home_factor"] == pytest.approx(20.5 / 11)
    assert t[2]["raw_factor"] == 2.0 and t[2]["home_factor"] == pytest.approx(2.0)


def test_gamma_model_freezes_base_and_factor(spark):
    data = league(40, 3)
    got = {(r["league"], r["team"]): (r["attack"], r["defence"]) for r in strength.sequential_gamma(spark.createDataFrame(data, MATCH)).collect()}
    for lg in (0, 1):
        train = [x for x in data if x[1] == lg]
        base, factor, _ = fitted(train)
        s = {}
        for _, _, h, a, _, _, gh, ga in train:
            x, y = s.setdefault(h, [10.0] * 4), s.setdefault(a, [10.0] * 4)
            ah, dh, aa, da = x[0] / x[1], x[2] / x[3], y[0] / y[1], y[2] / y[3]
            x[0] += gh; x[1] += base * da * factor; y[2] += gh; y[3] += base * ah * factor  # noqa: E702
            y[0] += ga; y[1] += base * dh; x[2] += ga; x[3] += base * aa  # noqa: E702
        for t, x in s.items():
            assert got[lg, t] == pytest.approx((x[0] / x[1], x[2] / x[3]))


def test_cumulated_totals_match_a_scan(spark):
    rng = random.Random(4)
    facts = [(rng.randrange(3), rng.choice([None, *range(20)]), rng.randrange(5)) for _ in range(200)]
    asked = [(k, t) for k in (0, 1, 2, 9) for t in range(-1, 21)] * 2 + [(None, 3), (1, None)]
    f, d = spark.createDataFrame(facts, "k long, known long, v long"), spark.createDataFrame(asked, "k long, at long")
    for strict in (False, True):
        got = pit.running_as_of(f, d, ["k"], "known", "at", {"s": "v"}, strict).collect()
        assert len(got) == len(asked)
        for r in got:
            ok = lambda t: t is not None and r["at"] is not None and (t < r["at"] if strict else t <= r["at"])  # noqa: B023, E731
            assert r["s"] == sum(v for k, t, v in facts if k == r["k"] and ok(t))


def test_corrected_outcomes_equal_the_corrected_grid(spark):
    lam, mu, rho = 1.4, 0.9, -0.08
    got = spark.range(1).select(models.corrected_one_x_two(F.lit(lam), F.lit(mu), F.lit(rho)).alias("p")).first()["p"]
    p = np.outer(*[[math.exp(-r) * r**k / math.factorial(k) for k in range(21)] for r in (lam, mu)])
    p[0, 0] *= 1 - lam * mu * rho
    p[0, 1] *= 1 + lam * rho
    p[1, 0] *= 1 + mu * rho
    p[1, 1] *= 1 - rho
    p /= p.sum()
    assert got == pytest.approx([np.tril(p, -1).sum(), np.trace(p), np.triu(p, 1).sum()])


def test_last_meeting_known_and_seen_from_the_home_side(spark):
    m = spark.createDataFrame([(1, 0, 1, 2, 0, 2, 2, 0), (2, 0, 2, 1, 10, 12, 1, 1), (3, 0, 1, 2, 20, 99, 0, 3)], MATCH)
    d = spark.createDataFrame([(7, 0, 2, 1, 5), (8, 0, 1, 2, 30), (9, 0, 1, 2, 1), (10, 0, 1, 3, 30), (11, 0, 1, 2, 200)], "match_id long, league long, home long, away long, at long")
    got = {r["match_id"]: r["met"] for r in models.last_meeting_as_of(m, d).collect()}
    assert got == {7: [0, 0, 1], 8: [0, 1, 0], 9: None, 10: None, 11: [0, 0, 1]}


def test_elo_lookup_takes_the_nearest_filled_bin_the_lower_on_ties(spark):
    bins = spark.createDataFrame([(0, 3, 0.35, 4, 0.5, 0.3, 0.2), (0, 5, 0.55, 4, 0.7, 0.2, 0.1)], "league long, bin int, mid double, n long, home double, draw double, away double")
    e = spark.createDataFrame([(0, 0.45), (0, 0.46), (0, 0.1), (1, 0.6)], "league long, expected double")
    got = {(r["league"], r["expected"]): r["home"] for r in models.elo_lookup(e, bins).collect()}
    assert got == {(0, 0.45): 0.5, (0, 0.46): 0.7, (0, 0.1): 0.5, (1, 0.6): 0.6}


def test_value_arithmetic(spark):
    r = spark.range(1).select(
        odds.expected_value(F.lit(0.5), F.lit(2.2)).alias("ev"), odds.expected_value(F.lit(1.5), F.lit(2.2)).alias("no_p"), odds.expected_value(F.lit(0.5), F.lit(1.0)).alias("no_price"),
        odds.closing_line_value(F.lit(2.2), F.lit(2.0)).alias("clv"), odds.kelly_fraction(F.lit(0.5), F.lit(2.2)).alias("kelly"), odds.fair_price(F.lit(0.0)).alias("inf"), odds.fair_price(F.lit(0.25)).alias("four"),
        odds.limited_stake(F.lit(90.0), F.lit(1000.0), 0.05, 40.0).alias("cap"), odds.limited_stake(F.lit(-3.0), F.lit(1000.0), 0.05, 40.0).alias("none"),
    ).first()
    assert r["ev"] == pytest.approx(0.1) and r["no_p"] is None and r["no_price"] is None
    assert r["clv"] == pytest.approx(-100 / 11) and r["kelly"] == pytest.approx(1 / 12)
    assert (r["inf"], r["four"], r["cap"], r["none"]) == (math.inf, 4.0, 40.0, 0.0)


def test_bootstrap_intervals_agree_with_theory(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=800)
    y = 0.5 * x + rng.normal(size=800)
    df = spark.createDataFrame([("g", i, float(a), float(b), bool(i % 2)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [("g", -1, None, 1.0, True)], "g string, id long, x double, y double, side boolean")
    r = resampling.bootstrap_correlation(df, "g", "x", "y", "id", 2000).first()
    want = np.corrcoef(x, y)[0, 1]
    assert r["n"] == 800 and r["estimate"] == pytest.approx(want) and r["low"] < want < r["high"]
    assert r["high"] - r["low"] == pytest.approx(2 * 1.96 * (1 - want**2) / math.sqrt(800), rel=0.2)
    d = resampling.bootstrap_difference(df, "g", "y", F.col("side"), "id", 2000).first()
    a, b = np.append(y[1::2], 1.0), y[::2]
    assert d["estimate"] == pytest.approx(a.mean() - b.mean())
    assert d["high"] - d["low"] == pytest.approx(2 * 1.96 * math.sqrt(a.var() / len(a) + b.var() / len(b)), rel=0.15)
    gap = resampling.bootstrap_correlation_difference(df, "g", "x", "y", F.col("side"), "id", 1000).first()
    assert gap["estimate"] == pytest.approx(np.corrcoef(x[1::2], y[1::2])[0, 1] - np.corrcoef(x[::2], y[::2])[0, 1])
    p = resampling.permutation_correlation_difference(df, "g", "x", "y", F.col("side"), "id", 1000).first()
    assert p["estimate"] == pytest.approx(gap["estimate"]) and 0.02 < p["p_value"] <= 1
    assert resampling.bootstrap_means(df.where("false"), "g", "x", "id", 100).count() == 0


def test_groups_are_weighed_in_blocks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 100)
    df = spark.createDataFrame([("big" if i < 2000 else None, i, 1.0) for i in range(2050)], "grp string, id long, v double")
    b = resampling.blocked(df, "id")
    assert b.count() == 2050 and max(r["count"] for r in b.groupBy("grp", "b").count().collect()) < 200


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.07338803), (0.5, 3, 0.65145), (12.0, 30, 5.5e-13), (0.0, 5, 1.0)])
def test_t_tail(t, df, p):
    assert resampling.t_tail(t, df) == pytest.approx(p, rel=2e-2)
    assert resampling.t_tail(-t, df) == pytest.approx(p, rel=2e-2)


def test_power_formulas():
    assert resampling.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert resampling.sample_needed(0.3) == pytest.approx(84.9, abs=0.2)
    assert resampling.power_of(0.3, 0.3 / (1.959964 + 0.841621)) == pytest.approx(0.8, abs=1e-3)


def test_walk_forward_fit_sees_earlier_periods_only(spark):
    rng = np.random.default_rng(5)
    data = [("g", t, i, float(x), int(rng.random() < 1 / (1 + math.exp(-2 * x)))) for i, (t, x) in enumerate((t, rng.normal()) for t in range(200))]
    df = spark.createDataFrame([*data, ("g", None, 900, 1.0, 1), ("g", 5, 901, None, 1)], "g string, at long, id long, x double, y int")
    got = {r["id"]: r for r in calibration.walk_forward_logistic(df, "g", "at", 20, ["x"], "y", "id", least=50).collect()}
    assert len(got) == 200 and got[30]["p"] is None and got[60]["trained_on"] == 60
    x, y = np.array([d[3] for d in data]), np.array([d[4] for d in data])
    b = calibration.irls(np.column_stack([np.ones(160), x[:160]]), y[:160].astype(float), np.ones(160))
    assert got[165]["p"] == pytest.approx(1 / (1 + math.exp(-(b[0] + b[1] * x[165]))), abs=1e-6)
    o = {r["id"]: r["p"] for r in calibration.walk_forward_logistic(df.withColumn("two", 2 * F.col("x")), "g", "at", 20, [], "y", "id", offset="two", least=50).collect()}
    assert o[165] is not None and abs(o[165] - 1 / (1 + math.exp(-2 * x[165]))) < 0.15


def test_curve_is_read_between_and_beyond_its_points(spark):
    curve = spark.createDataFrame([("1", 0.2, 0.1), ("1", 0.4, 0.5)], "grp string, x double, fitted double")
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 0.3), (1, 0.9), (2, 0.3), (1, None)], "league long, p double")
    got = {(r["league"], r["p"]): r["calibrated"] for r in calibration.apply_isotonic(df, curve, "league", "p").collect()}
    assert got == {(1, 0.1): 0.1, (1, 0.2): 0.1, (1, 0.3): pytest.approx(0.3), (1, 0.9): 0.5, (2, 0.3): None, (1, None): None}


def test_quantiles_from_ranges(spark):
    x = np.random.default_rng(0).integers(0, 40, 501).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    r = spark.range(1).select(*[c.alias(f"q{i}") for i, c in enumerate([*ranks.quantiles(df, "x", [0.0, 0.3, 1.0]), ranks.nearest_rank(df, "x", 0.99)])]).first()
    assert list(r) == pytest.approx([x.min(), np.quantile(x, 0.3), x.max(), np.sort(x)[round(0.99 * 500)]])
    assert spark.range(1).select(*ranks.quantiles(df.where("false"), "x", [0.5])).first()[0] is None


def test_stored_features_extended_by_later_days(spark):
    rng = random.Random(6)
    days = [("w", "a", d, rng.randint(1, 3), rng.randint(0, 9), d) for d in range(20) if d % 3]
    cols = "w string, a string, day int, n int, total int, last_at int"
    df = spark.createDataFrame(days, cols)
    whole = features.cumulative(df, "w", "a")
    grown = features.extended(features.cumulative(df.where("day < 11"), "w", "a"), df.where("day >= 11"), "w", "a")
    assert rows(grown) == rows(whole)
    with pytest.raises(Exception, match="within the stored days"):
        features.extended(whole, df.where("day = 4"), "w", "a").collect()


def test_settlement_never_overdraws(spark):
    bets = spark.createDataFrame([(1, i, i, "home", 0.9, 2.0, i % 3 == 0) for i in range(40)] + [(2, 1, 1, "home", -0.5, 2.0, True), (2, 2, 2, "home", None, 2.0, True)], "league long, at long, match_id long, selection string, f double, price double, won boolean")
    got = intake.settle_in_order(bets, "league", ["at", "match_id", "selection"], 100.0, 1.0, 1e9).collect()
    assert len(got) == 42 and min(r["balance"] for r in got) >= 0
    assert all(r["refused"] and r["balance"] == 100.0 for r in got if r["match_id"] in (1, 2) and r["stake"] == 0.0 and r["balance"] == 100.0)


def test_seasons_repeat_and_differ(spark):
    a = intake.synthetic_season(spark, 3)
    assert a.count() == 3 * 380 and rows(a) == rows(intake.synthetic_season(spark, 3))
    g = a.agg(F.avg("gh"), F.avg("lam"), F.avg("ga"), F.avg("mu")).first()
    assert g[0] == pytest.approx(g[1], abs=0.15) and g[2] == pytest.approx(g[3], abs=0.15)
