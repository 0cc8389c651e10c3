"""Outcome models fitted on what was known: at one time for later fixtures, or at every fixture's own decision time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.functions.scoring import right_closed_bin
from tidemark.operators import strength
from tidemark.operators.pit import running_as_of

OUTCOMES = ("home", "draw", "away")


def outcome(goals_home: Column, goals_away: Column) -> Column:
    """0, 1 or 2: home side, draw or away side; NULL without a score."""
    return F.when(goals_home > goals_away, 0).when(goals_home == goals_away, 1).when(goals_home < goals_away, 2)


def one_x_two(lam: Column, mu: Column) -> Column:
    """Array (home, draw, away) of two independent Poisson counts; NULL where a rate is."""
    o = grid.outcome_probabilities(grid.pmf(lam), grid.pmf(mu))
    return F.when(lam.isNotNull() & mu.isNotNull(), F.array(*[o[c] for c in OUTCOMES]))


def corrected_one_x_two(lam: Column, mu: Column, rho: Column) -> Column:
    """As one_x_two with the low-score factor on the four low cells, scaled anew."""
    h, a = grid.pmf(lam), grid.pmf(mu)
    o = grid.outcome_probabilities(h, a)
    mass = F.aggregate(h, F.lit(0.0), lambda s, x: s + x) * F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def more(x: int, y: int) -> Column:
        return F.get(h, F.lit(x)) * F.get(a, F.lit(y)) * (grid.low_score_factor(F.lit(x), F.lit(y), lam, mu, rho) - 1)

    raw = [o["home"] * mass + more(1, 0), o["draw"] * mass + more(0, 0) + more(1, 1), o["away"] * mass + more(0, 1)]
    total = raw[0] + raw[1] + raw[2]
    return F.when(lam.isNotNull() & mu.isNotNull(), F.array(*[x / total for x in raw]))


def blended(p: Column, q: Column, weight: Column) -> Column:
    """(1 - weight) p + weight q, cell by cell."""
    return F.zip_with(p, q, lambda a, b: (1 - weight) * a + weight * b)


def outcome_shares_as_of(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with `naive`: the league's shares of home, draw and away known by then; NULL before the first result."""
    flags = {f"_{n}": (outcome(F.col("gh"), F.col("ga")) == i).cast("int") for i, n in enumerate(OUTCOMES)}
    facts = matches.select("league", "known", F.lit(1).alias("_one"), *[c.alias(n) for n, c in flags.items()])
    d = running_as_of(facts, decisions, ["league"], "known", "at", {"_n": "_one", **{f"{n}_sum": n for n in flags}})
    shares = F.array(*[F.col(f"{n}_sum") / F.col("_n") for n in flags])
    return d.select(*decisions.columns, F.when(F.col("_n") > 0, shares).alias("naive"))


def last_meeting_as_of(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with `met`: the pair's latest meeting known by then as (1, 0, 0), (0, 1, 0) or (0, 0, 1) from the home side's view.

    Meetings are first reduced to the latest per pair and instant of becoming
    known, so a pair that meets often costs one row per instant.
    """
    lo, hi = F.least("home", "away").alias("lo"), F.greatest("home", "away").alias("hi")
    last = F.max(F.struct("kick", "match_id", "home", F.sign(F.col("gh") - F.col("ga")).cast("int").alias("r"))).alias("m")
    facts = matches.where("known is not null").groupBy("league", lo, hi, F.col("known").alias("_t")).agg(last)
    asked = decisions.where("at is not null").select("league", lo, hi, F.col("at").alias("_t")).distinct().withColumn("_asked", F.lit(True))
    line = facts.unionByName(asked, allowMissingColumns=True).groupBy("league", "lo", "hi", "_t").agg(F.max("m").alias("m"), F.bool_or("_asked").alias("_asked"))
    seen = F.max("m").over(Window.partitionBy("league", "lo", "hi").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
    line = line.select("league", "lo", "hi", "_t", "_asked", seen.alias("m")).where("_asked").select("league", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("_t").alias("at"), "m")
    d = decisions.withColumns({"_lo": F.least("home", "away"), "_hi": F.greatest("home", "away")}).join(line, ["league", "_lo", "_hi", "at"], "left")
    r = F.when(F.col("m.home") == F.col("home"), F.col("m.r")).otherwise(-F.col("m.r"))
    hot = F.array(*[(r == x).cast("double") for x in (1, 0, -1)])
    return d.select(*decisions.columns, F.when(F.col("m").isNotNull(), hot).alias("met"))


def team_strengths(matches: DataFrame, shrink: float = 10.0) -> DataFrame:
    """league, team, attack, defence, base, factor, n_home, raw_factor, home_factor from the given matches.

    raw_factor is the mean of a team's home goals over what neutral ground
    would let expect (the league's factor where it has no home match);
    home_factor is drawn towards the league's by `shrink` pseudo matches.
    """
    levels = strength.league_levels(matches)
    long = strength.long_form(matches)
    n = F.count(F.lit(1))
    teams = long.groupBy("league", "team").agg(F.sum("scored").alias("s"), F.sum("conceded").alias("c"), n.alias("n")).join(levels, "league")
    teams = teams.select("league", "team", "base", "factor", strength.strength_ratio(F.col("s"), F.col("n"), F.col("base")).alias("attack"), strength.strength_ratio(F.col("c"), F.col("n"), F.col("base")).alias("defence"))
    other = teams.select("league", F.col("team").alias("away"), F.col("defence").alias("away_defence"))
    per = matches.groupBy("league", "home", "away").agg(F.sum(F.col("gh").cast("double")).alias("g"), n.alias("n"))
    per = per.join(other, ["league", "away"]).groupBy("league", F.col("home").alias("team")).agg(F.sum(F.col("g") / F.col("away_defence")).alias("x"), F.sum("n").alias("n_home"))
    t = teams.join(per, ["league", "team"], "left").withColumn("n_home", F.coalesce("n_home", F.lit(0)))
    raw = F.when(F.col("n_home") > 0, F.col("x") / (F.col("base") * F.col("attack") * F.col("n_home"))).otherwise(F.col("factor"))
    t = t.withColumn("raw_factor", raw)
    return t.select("league", "team", "attack", "defence", "base", "factor", "n_home", "raw_factor", ((F.col("n_home") * F.col("raw_factor") + shrink * F.col("factor")) / (F.col("n_home") + shrink)).alias("home_factor"))


def form_strengths(matches: DataFrame, last: int, shrink: float) -> DataFrame:
    """league, team, attack, defence of each team's last matches, drawn towards its long run by `shrink` pseudo matches."""
    levels = strength.league_levels(matches)
    w = Window.partitionBy("league", "team").orderBy(F.col("kick").desc(), F.col("match_id").desc())
    rows = strength.long_form(matches).withColumn("recent", F.row_number().over(w) <= last)
    mean = lambda c, only: F.avg(F.when(F.col("recent"), F.col(c)) if only else F.col(c))
    agg = rows.groupBy("league", "team").agg(F.count_if("recent").alias("n"), *[mean(c, only).alias(f"{c}_{'recent' if only else 'all'}") for c in ("scored", "conceded") for only in (True, False)]).join(levels, "league")
    ratio = lambda c: F.greatest(F.col(c) / F.col("base"), F.lit(strength.FLOOR))
    drawn = lambda c: (F.col("n") * ratio(f"{c}_recent") + shrink * ratio(f"{c}_all")) / (F.col("n") + shrink)
    return agg.select("league", "team", drawn("scored").alias("attack"), drawn("conceded").alias("defence"))


def elo_bins(rated: DataFrame, bins: int = 10) -> DataFrame:
    """league, bin, mid, n, home, draw, away: what came of matches by the home side's expected score (filled bins only)."""
    b = right_closed_bin(F.col("expected"), bins)
    o = outcome(F.col("gh"), F.col("ga"))
    return rated.groupBy("league", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), *[F.avg((o == i).cast("double")).alias(n) for i, n in enumerate(OUTCOMES)]).select("league", "bin", ((F.col("bin") + 0.5) / bins).alias("mid"), "n", *OUTCOMES)


def elo_lookup(expected: DataFrame, bins: DataFrame) -> DataFrame:
    """Rows (league, expected) with the shares of the filled bin nearest to their expected score, the lower on ties.

    A league's bins travel as one array of at most as many entries as there are
    bins; without any, the expected score itself is the home share and draws have none.
    """
    lists = bins.groupBy("league").agg(F.sort_array(F.collect_list(F.struct("bin", "mid", *OUTCOMES))).alias("_bins"))
    near = F.array_min(F.transform("_bins", lambda b: F.struct(F.round(F.abs(b["mid"] - F.col("expected")), 12).alias("gap"), b["bin"].alias("bin"), b["home"].alias("home"), b["draw"].alias("draw"), b["away"].alias("away"))))
    d = expected.join(lists, "league", "left").withColumn("_b", near)
    plain = {"home": F.col("expected"), "draw": F.lit(0.0), "away": 1 - F.col("expected")}
    return d.select(*expected.columns, *[F.coalesce(F.col("_b")[c], x).alias(c) for c, x in plain.items()])
