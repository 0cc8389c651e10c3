"""Team strengths as of each decision time, without refitting: running sums instead of training sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import ordered_scan
from tidemark.operators.pit import cumulated, running_as_of

#: Least strength ratio.
FLOOR = 1e-9


def long_form(matches: DataFrame, scored: str = "gh", conceded: str = "ga") -> DataFrame:
    """Two rows per match: match_id, league, team, at_home, scored, conceded, kick, known."""
    def side(team: str, home: bool, f: str, a: str) -> DataFrame:
        return matches.select("match_id", "league", F.col(team).alias("team"), F.lit(home).alias("at_home"), F.col(f).cast("double").alias("scored"), F.col(a).cast("double").alias("conceded"), "kick", "known")

    return side("home", True, scored, conceded).unionByName(side("away", False, conceded, scored))


def strength_ratio(total: Column, n: Column, base: Column) -> Column:
    """A team's goals per match over the league's base, at least FLOOR; 1 without history."""
    return F.when(n > 0, F.greatest(F.try_divide(total / n, F.greatest(base, F.lit(FLOOR))), F.lit(FLOOR))).otherwise(1.0)


def home_factor(home_goals: Column, away_goals: Column) -> Column:
    """Home over away goals, at least FLOOR; 1 while the away sides have none."""
    return F.when(away_goals > 0, F.greatest(home_goals / away_goals, F.lit(FLOOR))).otherwise(1.0)


def strengths_as_of(matches: DataFrame, decisions: DataFrame, scored: str = "gh", conceded: str = "ga", strict: bool = False) -> DataFrame:
    """Decisions (match_id, league, home, away, at) with lam and mu from everything known by `at`.

    base = league goals per side and match; attack and defence = a team's own
    rate over the base, 1 without history; lam = base x attack x the other
    side's defence x home factor, mu = base x attack x defence.  With no league
    history both are NULL.
    """
    league_facts = matches.select("league", "known", F.col(scored).cast("double").alias("h"), F.col(conceded).cast("double").alias("a"), F.lit(1).alias("one"))
    d = running_as_of(league_facts, decisions, ["league"], "known", "at", {"lg_h": "h", "lg_a": "a", "lg_n": "one"}, strict)
    teams = long_form(matches, scored, conceded).select("league", "team", "known", "scored", "conceded", F.lit(1).alias("one"))
    asked = decisions.select("league", "at", F.explode(F.array("home", "away")).alias("team"))
    line = cumulated(teams, asked, ["league", "team"], "known", "at", {"for": "scored", "against": "conceded", "n": "one"}, strict)
    for side in ("home", "away"):
        own = line.select("league", F.col("team").alias(side), "at", *[F.col(c).alias(f"{side}_{c}") for c in ("for", "against", "n")])
        d = d.join(own, ["league", side, "at"], "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("home_n", "away_n")})
    base = F.when(F.col("lg_n") > 0, F.greatest((F.col("lg_h") + F.col("lg_a")) / (2 * F.col("lg_n")), F.lit(FLOOR)))
    ratio = lambda total, n: strength_ratio(F.col(total), F.col(n), base)
    lam = base * ratio("home_for", "home_n") * ratio("away_against", "away_n") * home_factor(F.col("lg_h"), F.col("lg_a"))
    mu = base * ratio("away_for", "away_n") * ratio("home_against", "home_n")
    return d.select(*decisions.columns, "lg_n", "home_n", "away_n", lam.alias("lam"), mu.alias("mu"))


def decayed_rates(matches: DataFrame, at: int, half_life: float) -> DataFrame:
    """league, team: weighted scored and conceded rates at one decision time, facts halving in weight per half life."""
    w = F.pow(F.lit(0.5), (F.lit(at) - F.col("kick")) / half_life)
    rows = long_form(matches).where(F.col("known") <= at).withColumn("w", w)
    return rows.groupBy("league", "team").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("w") * F.col("scored")) / F.sum("w")).alias("scored_rate"), (F.sum(F.col("w") * F.col("conceded")) / F.sum("w")).alias("conceded_rate"))


def recent_form(matches: DataFrame, last: int, shrink: float) -> DataFrame:
    """Per team the mean of its last matches, shrunk towards its long-run mean by `shrink` pseudo matches."""
    w = Window.partitionBy("league", "team").orderBy(F.col("kick").desc(), F.col("match_id").desc())
    rows = long_form(matches).withColumn("recency", F.row_number().over(w))
    recent = F.sum(F.when(F.col("recency") <= last, F.col("scored")))
    n = F.sum(F.when(F.col("recency") <= last, 1).otherwise(0))
    return rows.groupBy("league", "team").agg(n.alias("n_recent"), F.avg("scored").alias("long_run"), ((recent + shrink * F.avg("scored")) / (n + shrink)).alias("form"))


def last_meeting(matches: DataFrame) -> DataFrame:
    """Each match with the result of the pair's meeting before it, seen from this home side: 1, 0, -1 or NULL."""
    lo, hi = F.least("home", "away"), F.greatest("home", "away")
    w = Window.partitionBy("league", lo, hi).orderBy("kick", "match_id")
    before = F.lag(F.struct(F.col("home").alias("h"), F.sign(F.col("gh") - F.col("ga")).alias("r"))).over(w)
    return matches.select("match_id", before.alias("b"), "home").select("match_id", F.when(F.col("b.h") == F.col("home"), F.col("b.r")).otherwise(-F.col("b.r")).cast("int").alias("last_result"))


ELO = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("league", T.LongType()), T.StructField("home_before", T.DoubleType()), T.StructField("away_before", T.DoubleType()), T.StructField("expected", T.DoubleType())])


def elo_ratings(matches: DataFrame, k: float = 20.0, advantage: float = 100.0, start: float = 1500.0) -> DataFrame:
    """Ratings before each match and the home side's expected score.

    The two sides share state, so a league is one ordered recurrence; it is
    streamed, and leagues run in parallel.
    """

    def step(rating: dict, row: tuple) -> tuple:
        m, lg, h, a, gh, ga, _ = row
        rh, ra = rating.get(h, start), rating.get(a, start)
        e = 1 / (1 + 10 ** (-(rh + advantage - ra) / 400))
        s = 1.0 if gh > ga else 0.5 if gh == ga else 0.0
        rating[h], rating[a] = rh + k * (s - e), ra - k * (s - e)
        return m, lg, rh, ra, e

    return ordered_scan(matches.select("match_id", "league", "home", "away", "gh", "ga", "kick"), "league", ["kick", "match_id"], dict, step, ELO)


GAMMA = T.StructType([T.StructField("league", T.LongType()), T.StructField("team", T.LongType()), T.StructField("attack", T.DoubleType()), T.StructField("defence", T.DoubleType()), T.StructField("base", T.DoubleType()), T.StructField("factor", T.DoubleType())])
GAMMA_ONLINE = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("lam", T.DoubleType()), T.StructField("mu", T.DoubleType())])


def league_levels(matches: DataFrame) -> DataFrame:
    """league, base (goals per side and match), factor (home advantage)."""
    h, a = F.sum(F.col("gh").cast("double")), F.sum(F.col("ga").cast("double"))
    return matches.groupBy("league").agg(F.greatest((h + a) / (2 * F.count(F.lit(1))), F.lit(FLOOR)).alias("base"), home_factor(h, a).alias("factor"))


def sequential_gamma(matches: DataFrame, prior: float = 10.0) -> DataFrame:
    """Attack and defence per team after the given matches, learnt match by match: gamma means with prior mean 1.

    Base and home factor are those of all given matches.  A match adds its goals to
    the shape of the scorer's attack and the other side's defence, and to their
    rates what the opponent's mean before the match lets expect.  A league is one
    ordered recurrence, streamed; the teams' means follow its last match.
    """
    rows = matches.join(league_levels(matches), "league").select("match_id", "league", "home", "away", "gh", "ga", "base", "factor", "kick")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        league, state, level = None, {}, (0.0, 0.0)

        def done() -> list[tuple]:
            return [(league, t, x[0] / x[1], x[2] / x[3], *level) for t, x in state.items()]

        for pdf in batches:
            out: list[tuple] = []
            for lg, h, a, gh, ga, base, factor in zip(*(pdf[c] for c in ("league", "home", "away", "gh", "ga", "base", "factor")), strict=True):
                if lg != league:
                    out += done() if state else []
                    league, state, level = lg, {}, (base, factor)
                x, y = state.setdefault(h, [prior] * 4), state.setdefault(a, [prior] * 4)
                home_attack, home_defence, away_attack, away_defence = x[0] / x[1], x[2] / x[3], y[0] / y[1], y[2] / y[3]
                x[0] += gh
                x[1] += base * away_defence * factor
                x[2] += ga
                x[3] += base * away_attack
                y[0] += ga
                y[1] += base * home_defence
                y[2] += gh
                y[3] += base * home_attack * factor
            if out:
                yield pd.DataFrame(out, columns=[f.name for f in GAMMA.fields])
        if state:
            yield pd.DataFrame(done(), columns=[f.name for f in GAMMA.fields])

    return rows.repartition("league").sortWithinPartitions("league", "kick", "match_id").mapInPandas(run, GAMMA)


def rates_from(fixtures: DataFrame, teams: DataFrame, levels: DataFrame) -> DataFrame:
    """Fixtures (league, home, away) with lam and mu from a table of attack and defence per team; unknown teams count 1."""
    d = fixtures.join(levels.select("league", "base", "factor"), "league")
    for side in ("home", "away"):
        d = d.join(teams.select("league", F.col("team").alias(side), F.col("attack").alias(f"{side}_attack"), F.col("defence").alias(f"{side}_defence")), ["league", side], "left")
    one = lambda c: F.coalesce(c, F.lit(1.0))
    lam = F.col("base") * one("home_attack") * one("away_defence") * F.col("factor")
    return d.select(*fixtures.columns, lam.alias("lam"), (F.col("base") * one("away_attack") * one("home_defence")).alias("mu"))


def sequential_gamma_online(matches: DataFrame, prior: float = 10.0) -> DataFrame:
    """Expected goals before each match from attack and defence that learn match by match, with nothing later used.

    As sequential_gamma, but base and home factor too are those of the matches so far (with `prior` goals each side to begin with).
    """

    def step(state: dict, row: tuple) -> tuple:
        m, _, h, a, gh, ga, _ = row
        home_goals, away_goals, sides = state.get("base", (prior, prior, 2 * prior))
        base, factor = (home_goals + away_goals) / sides, home_goals / away_goals
        rates = [state.setdefault(x, [prior, prior]) for x in (("att", h), ("def", h), ("att", a), ("def", a))]
        ah, dh, aa, da = (x[0] / x[1] for x in rates)
        for rate, scored, exposure in zip(rates, (gh, ga, ga, gh), (base * da * factor, base * aa, base * dh, base * ah * factor), strict=True):
            rate[0] += scored
            rate[1] += exposure
        state["base"] = (home_goals + gh, away_goals + ga, sides + 2)
        return m, base * ah * da * factor, base * aa * dh

    return ordered_scan(matches.select("match_id", "league", "home", "away", "gh", "ga", "kick"), "league", ["kick", "match_id"], dict, step, GAMMA_ONLINE)


RHO = T.StructType([T.StructField("league", T.LongType()), T.StructField("rho", T.DoubleType()), T.StructField("n", T.LongType())])


def golden_minimum(f, lo: float, hi: float, tol: float = 1e-7) -> float:  # noqa: ANN001
    """Place of the minimum of a unimodal function on [lo, hi]."""
    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def fit_low_score_rho(rated: DataFrame) -> DataFrame:
    """Maximum likelihood rho per league from (league, gh, ga, lam, mu).

    rho lies where no match of the league, whatever its score, gets a negative
    cell; where there is no such place it is 0.  Only the four low cells carry
    likelihood; matches of equal cell and rates are first combined.
    """
    both = rated.where((F.col("lam") > 0) & (F.col("mu") > 0))
    bounds = both.groupBy("league").agg(F.max(F.greatest(-1 / F.col("lam"), -1 / F.col("mu"))).alias("lo"), F.min(F.least(F.lit(1.0), 1 / (F.col("lam") * F.col("mu")))).alias("hi"))
    cell = F.col("gh") * 2 + F.col("ga")
    low = rated.where((F.col("gh") <= 1) & (F.col("ga") <= 1) & F.col("lam").isNotNull()).groupBy("league", cell.alias("cell"), "lam", "mu").agg(F.count(F.lit(1)).alias("n"))
    low = low.join(bounds, "league", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lam, mu, n, c = (pdf[x].to_numpy(dtype=float) for x in ("lam", "mu", "n", "cell"))
        ok = (lam > 0) & (mu > 0)
        lam, mu, n, c = lam[ok], mu[ok], n[ok], c[ok]
        rho = 0.0
        if len(lam):
            lo, hi = float(pdf["lo"].iloc[0]) + 1e-9, float(pdf["hi"].iloc[0]) - 1e-9
            slope = np.choose(c.astype(int), [-lam * mu, lam, mu, -np.ones(len(lam))])
            if lo < hi:
                rho = golden_minimum(lambda r: -float((n * np.log(np.maximum(1 + slope * r, 1e-300))).sum()), lo, hi)
        return pd.DataFrame({"league": [pdf["league"].iloc[0]], "rho": [rho], "n": [int(n.sum())]})

    return low.groupBy("league").applyInPandas(run, RHO)
