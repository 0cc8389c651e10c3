"""Queries on point-in-time reads, strengths and score distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.operators import pit, strength
from tidemark.plans import registry
from tidemark.plans.adapters import MATCHES_SQL, QUOTES_SQL, matches, quotes
from tidemark.session import table

R = registry.new()
#: A decision time of the match history, as hour number, and how long before kick-off decisions fall.
AT, LEAD = 245_000, 2


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles cut to so many places, with one zero (adding 0 turns -0 into 0)."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@R.query("pit_scan", f"WITH {MATCHES_SQL} SELECT match_id, known, gh, ga FROM matches WHERE known <= {AT} ORDER BY known, match_id")
def pit_scan(spark: SparkSession, sf: str) -> DataFrame:
    return pit.as_of_scan(matches(spark, sf), "known", F.lit(AT), ["match_id"]).select("match_id", "known", "gh", "ga")


@R.query("latest_quote_as_of", f"WITH {MATCHES_SQL}, {QUOTES_SQL} SELECT match_id, bookmaker, known, p1 FROM quotes WHERE known <= {AT} QUALIFY known = max(known) OVER (PARTITION BY match_id)")
def latest_quote_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return pit.latest_as_of(quotes(spark, sf), ["match_id"], "known", F.lit(AT)).select("match_id", "bookmaker", "known", "p1")


@R.query("last_quote_before", f"WITH {MATCHES_SQL}, {QUOTES_SQL} SELECT match_id, max(bookmaker) AS bookmaker, max(known) AS known FROM (SELECT * FROM quotes WHERE known < {AT} QUALIFY known = max(known) OVER (PARTITION BY match_id)) GROUP BY 1")
def last_quote_before(spark: SparkSession, sf: str) -> DataFrame:
    last = pit.latest_as_of(quotes(spark, sf), ["match_id"], "known", F.lit(AT), strict=True)
    return last.groupBy("match_id").agg(F.max("bookmaker").alias("bookmaker"), F.max("known").alias("known"))


@R.query("quote_granularity", f"WITH {MATCHES_SQL}, {QUOTES_SQL}, c AS (SELECT m.match_id, count(DISTINCT q.known) AS n FROM matches m LEFT JOIN quotes q ON m.match_id = q.match_id AND q.known < m.kick GROUP BY 1) SELECT CASE WHEN n = 0 THEN 'none' WHEN n <= 2 THEN 'sparse' ELSE 'dense' END AS label, count(*) AS matches FROM c GROUP BY 1")
def quote_granularity(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf).select("match_id", "kick")
    q = quotes(spark, sf).select("match_id", F.col("known").alias("q_known"))
    n = m.join(q, "match_id", "left").groupBy("match_id").agg(F.count_distinct(F.when(F.col("q_known") < F.col("kick"), F.col("q_known"))).alias("n"))
    return n.groupBy(F.when(F.col("n") == 0, "none").when(F.col("n") <= 2, "sparse").otherwise("dense").alias("label")).agg(F.count(F.lit(1)).alias("matches"))


SCD_SQL = """
f AS (SELECT club_id, CAST(valid_from AS DATE) AS valid_from, arg_min(elo, row(valid_from, rating_id)) AS elo FROM club_ratings GROUP BY 1, 2),
w AS (SELECT club_id, valid_from, coalesce(CAST(lead(valid_from) OVER (PARTITION BY club_id ORDER BY valid_from) - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS valid_to, elo FROM f)"""


def rating_windows(spark: SparkSession, sf: str) -> DataFrame:
    return pit.scd2_windows(table(spark, sf, "club_ratings"), "club_id", "valid_from", ["elo"], "rating_id")


@R.query("scd2_windows", f"WITH {SCD_SQL} SELECT club_id, valid_from, valid_to, elo FROM w")
def scd2_windows(spark: SparkSession, sf: str) -> DataFrame:
    return rating_windows(spark, sf)


@R.query("scd2_lookup", f"WITH {SCD_SQL} SELECT obs_id, elo FROM shadow_observations s JOIN clubs c ON s.home_team = c.club_name LEFT JOIN w ON w.club_id = c.club_id AND CAST(s.kickoff_utc AS DATE) BETWEEN w.valid_from AND w.valid_to")
def scd2_lookup(spark: SparkSession, sf: str) -> DataFrame:
    notes = table(spark, sf, "shadow_observations").select("obs_id", "home_team", "kickoff_utc")
    clubs = table(spark, sf, "clubs").select("club_id", F.col("club_name").alias("home_team"))
    return pit.scd2_lookup(notes.join(clubs, "home_team"), rating_windows(spark, sf), "club_id", F.to_date("kickoff_utc"), ["elo"]).select("obs_id", "elo")


TEAM_SQL = "lf AS (SELECT match_id, league, home AS team, TRUE AS at_home, gh AS scored, ga AS conceded, kick, known FROM matches UNION ALL SELECT match_id, league, away, FALSE, ga, gh, kick, known FROM matches)"


@R.query("rest_hours", f"WITH {MATCHES_SQL}, {TEAM_SQL} SELECT match_id, team, kick - max(kick) OVER (PARTITION BY team ORDER BY kick RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rest FROM lf")
def rest_hours(spark: SparkSession, sf: str) -> DataFrame:
    return pit.previous_event(strength.long_form(matches(spark, sf)), "team", "kick", "match_id").select("match_id", "team", (F.col("kick") - F.col("previous_at")).alias("rest"))


@R.query("congestion_counts", f"WITH {MATCHES_SQL}, {TEAM_SQL} SELECT match_id, team, " + ", ".join(f"count(*) OVER (PARTITION BY team ORDER BY kick RANGE BETWEEN {d * 24} PRECEDING AND 1 PRECEDING) AS in_{d}d" for d in (7, 14, 21)) + " FROM lf")
def congestion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pit.counts_before(strength.long_form(matches(spark, sf)), "team", "kick", {f"in_{d}d": d * 24 for d in (7, 14, 21)}).select("match_id", "team", "in_7d", "in_14d", "in_21d")


@R.query("rolling_win_rate", f"WITH {MATCHES_SQL}, {TEAM_SQL} SELECT match_id, team, CASE WHEN count(*) OVER w = 10 THEN round(avg(CAST(scored > conceded AS INT)) OVER w, 6) END AS rate FROM lf WINDOW w AS (PARTITION BY team ORDER BY kick, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def rolling_win_rate(spark: SparkSession, sf: str) -> DataFrame:
    lf = strength.long_form(matches(spark, sf))
    return lf.select("match_id", "team", F.round(pit.last_n_rate(lf, "team", "kick", "match_id", F.col("scored") > F.col("conceded"), 10), 6).alias("rate"))


@R.query("last_meeting", f"WITH {MATCHES_SQL}, p AS (SELECT *, least(home, away) AS lo, greatest(home, away) AS hi FROM matches), b AS (SELECT match_id, home, lag(home) OVER w AS bh, lag(sign(gh - ga)) OVER w AS br FROM p WINDOW w AS (PARTITION BY league, lo, hi ORDER BY kick, match_id)) SELECT match_id, CAST(CASE WHEN bh = home THEN br ELSE -br END AS INT) AS last_result FROM b")
def last_meeting(spark: SparkSession, sf: str) -> DataFrame:
    return strength.last_meeting(matches(spark, sf))


def strength_sql(lag: int) -> str:
    """SQL of strengths_as_of on goals; decisions fall `lag` hours before kick-off."""
    side = lambda s: f"""{s}c AS (SELECT league, team, known, sum(s) AS s, sum(c) AS c, sum(n) AS n FROM (SELECT league, team, known, sum(sum(scored)) OVER x AS s, sum(sum(conceded)) OVER x AS c, sum(count(*)) OVER x AS n FROM lf GROUP BY league, team, known WINDOW x AS (PARTITION BY league, team ORDER BY known)) GROUP BY ALL)"""
    return f"""{MATCHES_SQL}, {TEAM_SQL}, {side('t')},
lc AS (SELECT league, known, sum(sum(gh)) OVER x AS h, sum(sum(ga)) OVER x AS a, sum(count(*)) OVER x AS n FROM matches GROUP BY league, known WINDOW x AS (PARTITION BY league ORDER BY known)),
dc AS (SELECT match_id, league, home, away, kick - {lag} AS at, gh, ga FROM matches),
j1 AS (SELECT dc.*, lc.h, lc.a, coalesce(lc.n, 0) AS lg_n FROM dc ASOF LEFT JOIN lc ON dc.league = lc.league AND dc.at >= lc.known),
j2 AS (SELECT j1.*, tc.s AS hs, tc.c AS hc, coalesce(tc.n, 0) AS home_n FROM j1 ASOF LEFT JOIN tc ON j1.league = tc.league AND j1.home = tc.team AND j1.at >= tc.known),
j3 AS (SELECT j2.*, tc.s AS as_, tc.c AS ac, coalesce(tc.n, 0) AS away_n FROM j2 ASOF LEFT JOIN tc ON j2.league = tc.league AND j2.away = tc.team AND j2.at >= tc.known),
k AS (SELECT *, CASE WHEN lg_n > 0 THEN greatest((h + a) / (2.0 * lg_n), 1e-9) END AS base, CASE WHEN a > 0 THEN greatest(h / a, 1e-9) ELSE 1 END AS hfa FROM j3),
rated AS (SELECT match_id, league, lg_n, home_n, away_n, gh, ga,
  base * (CASE WHEN home_n > 0 THEN greatest(hs / home_n / greatest(base, 1e-9), 1e-9) ELSE 1 END) * (CASE WHEN away_n > 0 THEN greatest(ac / away_n / greatest(base, 1e-9), 1e-9) ELSE 1 END) * hfa AS lam,
  base * (CASE WHEN away_n > 0 THEN greatest(as_ / away_n / greatest(base, 1e-9), 1e-9) ELSE 1 END) * (CASE WHEN home_n > 0 THEN greatest(hc / home_n / greatest(base, 1e-9), 1e-9) ELSE 1 END) AS mu FROM k)"""


def rated(spark: SparkSession, sf: str, scored: str = "gh", conceded: str = "ga", known: str = "known") -> DataFrame:
    m = matches(spark, sf)
    decisions = m.select("match_id", "league", "home", "away", (F.col("kick") - LEAD).alias("at"), "gh", "ga")
    facts = m.drop("known").withColumnRenamed(known, "known") if known != "known" else m
    return strength.strengths_as_of(facts, decisions, scored, conceded)


@R.query("strengths_as_of", f"WITH {strength_sql(LEAD)} SELECT match_id, CAST(lg_n AS BIGINT) AS lg_n, CAST(home_n AS BIGINT) AS home_n, CAST(away_n AS BIGINT) AS away_n, round(lam, 6) AS lam, round(mu, 6) AS mu FROM rated")
def strengths_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rated(spark, sf).select("match_id", F.col("lg_n").cast("long").alias("lg_n"), F.col("home_n").cast("long").alias("home_n"), F.col("away_n").cast("long").alias("away_n"), "lam", "mu"))


GRID_SQL = "g AS (SELECT r.*, i.i, j.j, exp(-lam) * pow(lam, i.i) / factorial(CAST(i.i AS INT)) * exp(-mu) * pow(mu, j.j) / factorial(CAST(j.j AS INT)) AS p FROM rated r, range(0, 21) i(i), range(0, 21) j(j) WHERE lam IS NOT NULL)"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Rated matches with the pmf arrays h and a; matches without league history are left out."""
    return rated(spark, sf).where("lam is not null").withColumns({"h": grid.pmf(F.col("lam")), "a": grid.pmf(F.col("mu"))})


@R.query("outcome_probabilities", f"WITH {strength_sql(LEAD)}, {GRID_SQL} SELECT match_id, round(sum(p) FILTER (i > j) / nullif(sum(p), 0), 6) AS home, round(sum(p) FILTER (i = j) / nullif(sum(p), 0), 6) AS draw, round(sum(p) FILTER (i < j) / nullif(sum(p), 0), 6) AS away FROM g GROUP BY 1")
def outcome_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(predictions(spark, sf).select("match_id", grid.outcome_probabilities(F.col("h"), F.col("a")).alias("o")).select("match_id", "o.*"))


@R.query("total_goals", f"WITH {strength_sql(LEAD)}, {GRID_SQL} SELECT match_id, " + ", ".join(f"round(sum(p) FILTER (i + j = {k}) / nullif(sum(p), 0), 6) AS p{k}" for k in range(6)) + ", round(sum(p) FILTER (i + j > 2) / nullif(sum(p), 0), 6) AS over_2_5, round(sum(p) FILTER (i + j > 4) / nullif(sum(p), 0), 6) AS over_4_5 FROM g GROUP BY 1")
def total_goals(spark: SparkSession, sf: str) -> DataFrame:
    d = predictions(spark, sf).select("match_id", grid.total_distribution(F.col("h"), F.col("a")).alias("d"))
    return rounded(d.select("match_id", *[F.get("d", F.lit(k)).alias(f"p{k}") for k in range(6)], grid.over_probability(F.col("d"), 2.5).alias("over_2_5"), grid.over_probability(F.col("d"), 4.5).alias("over_4_5")))


@R.query("handicap_probabilities", f"WITH {strength_sql(LEAD)}, {GRID_SQL} SELECT match_id, " + ", ".join(f"round((sum(p) FILTER (i - j + ({a}) > 0) + sum(p) FILTER (i - j + ({b}) > 0)) / 2 / nullif(sum(p), 0), 6) AS home_{n}, round((coalesce(sum(p) FILTER (i - j + ({a}) = 0), 0) + coalesce(sum(p) FILTER (i - j + ({b}) = 0), 0)) / 2 / nullif(sum(p), 0), 6) AS push_{n}" for n, a, b in (("m1", -1, -1), ("m0_25", -0.5, 0), ("p0_5", 0.5, 0.5))) + " FROM g GROUP BY 1")
def handicap_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    d = predictions(spark, sf).select("match_id", grid.difference_distribution(F.col("h"), F.col("a"), 20).alias("d"))
    parts = {n: grid.handicap_probabilities(F.col("d"), line) for n, line in (("m1", -1.0), ("m0_25", -0.25), ("p0_5", 0.5))}
    return rounded(d.select("match_id", *[x[c].alias(f"{c}_{n}") for n, x in parts.items() for c in ("home", "push")]))


@R.query("low_score_cells", f"WITH {strength_sql(LEAD)}, {GRID_SQL}, t AS (SELECT *, p * CASE WHEN i = 0 AND j = 0 THEN 1 - lam * mu * -0.05 WHEN i = 0 AND j = 1 THEN 1 + lam * -0.05 WHEN i = 1 AND j = 0 THEN 1 + mu * -0.05 WHEN i = 1 AND j = 1 THEN 1.05 ELSE 1 END AS q FROM g) SELECT match_id, " + ", ".join(f"round(sum(q) FILTER (i = {i} AND j = {j}) / nullif(sum(q), 0), 6) AS p{i}{j}" for i, j in ((0, 0), (1, 0), (0, 1), (1, 1))) + " FROM t GROUP BY 1")
def low_score_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = predictions(spark, sf).select("match_id", grid.corrected_low_scores(F.col("h"), F.col("a"), F.col("lam"), F.col("mu"), F.lit(-0.05)).alias("c"))
    return rounded(c.select("match_id", *[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(("p00", "p10", "p01", "p11"))]))


CHECKS_SQL = f"WITH {strength_sql(LEAD)}, {GRID_SQL}, d AS (SELECT match_id, [" + ", ".join(f"sum(p) FILTER (i + j = {k}) / sum(p)" for k in range(6)) + ", sum(p) FILTER (i + j > 5) / sum(p)] AS d, [" + ", ".join(f"sum(p) FILTER (i + j > {k}) / sum(p)" for k in range(5)) + "] AS o FROM g GROUP BY 1) SELECT count(*) AS matches, count(*) FILTER (abs(list_sum(d) - 1) > 1e-6 OR list_min(d) < -1e-6) AS bad_sums, count(*) FILTER (o[1] < o[2] - 1e-9 OR o[2] < o[3] - 1e-9 OR o[3] < o[4] - 1e-9 OR o[4] < o[5] - 1e-9) AS bad_orders, count(*) FILTER (" + " OR ".join(f"abs(o[{k + 1}] - list_sum(d[{k + 2}:])) > 1e-6" for k in range(5)) + ") AS bad_tails FROM d"


@R.query("distribution_checks", CHECKS_SQL)
def distribution_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Matches whose distributions break a rule: sums to one, overs fall with the line, overs equal tail sums."""
    d = predictions(spark, sf).select("match_id", grid.total_distribution(F.col("h"), F.col("a")).alias("d"))
    d = d.withColumn("o", F.array(*[grid.over_probability(F.col("d"), x + 0.5) for x in range(5)]))
    tails = [F.abs(F.get("o", F.lit(k)) - F.aggregate(F.slice("d", k + 2, 7), F.lit(0.0), lambda s, x: s + x)) > 1e-6 for k in range(5)]
    checks = d.select((~grid.is_distribution(F.col("d"))).alias("bad_sum"), (~grid.is_non_increasing(F.col("o"))).alias("bad_order"), F.greatest(*tails).alias("bad_tail"))
    return checks.agg(F.count(F.lit(1)).alias("matches"), F.count_if("bad_sum").alias("bad_sums"), F.count_if("bad_order").alias("bad_orders"), F.count_if("bad_tail").alias("bad_tails"))


@R.query("naive_frequencies", f"WITH {MATCHES_SQL} SELECT league, count(*) AS n, round(avg(CAST(gh > ga AS INT)), 6) AS home, round(avg(CAST(gh = ga AS INT)), 6) AS draw, round(avg(CAST(gh < ga AS INT)), 6) AS away FROM matches WHERE known <= {AT} GROUP BY 1")
def naive_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf).where(F.col("known") <= AT)
    f = lambda c: F.avg(c.cast("double"))
    return rounded(m.groupBy("league").agg(F.count(F.lit(1)).alias("n"), f(F.col("gh") > F.col("ga")).alias("home"), f(F.col("gh") == F.col("ga")).alias("draw"), f(F.col("gh") < F.col("ga")).alias("away")))


@R.query("decayed_rates", f"WITH {MATCHES_SQL}, {TEAM_SQL}, w AS (SELECT *, pow(0.5, ({AT} - kick) / 8760.0) AS w FROM lf WHERE known <= {AT}) SELECT league, team, count(*) AS n, round(sum(w * scored) / sum(w), 6) AS scored_rate, round(sum(w * conceded) / sum(w), 6) AS conceded_rate FROM w GROUP BY 1, 2")
def decayed_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(strength.decayed_rates(matches(spark, sf), AT, 8760.0))


@R.query("recent_form", f"WITH {MATCHES_SQL}, {TEAM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY kick DESC, match_id DESC) AS i FROM lf) SELECT league, team, count(*) FILTER (i <= 5) AS n_recent, round(avg(scored), 6) AS long_run, round((sum(scored) FILTER (i <= 5) + 3 * avg(scored)) / (count(*) FILTER (i <= 5) + 3), 6) AS form FROM r GROUP BY 1, 2")
def recent_form(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(strength.recent_form(matches(spark, sf), 5, 3.0))


@R.query("elo_ratings")
def elo_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return strength.elo_ratings(matches(spark, sf))


@R.query("sequential_gamma")
def sequential_gamma(spark: SparkSession, sf: str) -> DataFrame:
    return strength.sequential_gamma(matches(spark, sf).where(F.col("known") <= AT))


@R.query("sequential_gamma_online")
def sequential_gamma_online(spark: SparkSession, sf: str) -> DataFrame:
    return strength.sequential_gamma_online(matches(spark, sf))


@R.query("low_score_rho")
def low_score_rho(spark: SparkSession, sf: str) -> DataFrame:
    return strength.fit_low_score_rho(rated(spark, sf))
