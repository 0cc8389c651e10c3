"""Further queries: pivots, splits, paired tests, identifiers and small cleaning steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring, times
from tidemark.functions.keys import norm_key
from tidemark.operators import reconcile, strength
from tidemark.plans import registry
from tidemark.plans.adapters import MATCHES_SQL, QUOTES_SQL, WAGERS_SQL, matches, quotes, wagers
from tidemark.plans.forecasts import LONG_SQL, OVER_SQL, long_quotes, overs
from tidemark.plans.history import AT, TEAM_SQL, rounded
from tidemark.session import table

R = registry.new()


@R.query("quotes_pivoted", f"WITH {MATCHES_SQL}, {QUOTES_SQL}, {LONG_SQL} SELECT match_id, " + ", ".join(f"round(max(price) FILTER (bookmaker = {b} AND sel = 1), 6) AS b{b}" for b in range(1, 8)) + " FROM nq GROUP BY 1")
def quotes_pivoted(spark: SparkSession, sf: str) -> DataFrame:
    """Best home price per match with one column per bookmaker (the column list is fixed, so no extra pass)."""
    home = long_quotes(spark, sf).where("sel = 1")
    wide = quotes(spark, sf).select("match_id").distinct().join(home.groupBy("match_id").pivot("bookmaker", list(range(1, 8))).agg(F.max("price")), "match_id", "left")
    return rounded(wide.select("match_id", *[F.col(str(b)).alias(f"b{b}") for b in range(1, 8)]))


@R.query("time_thirds", f"WITH {MATCHES_SQL}, t AS (SELECT league, gh + ga AS g, ntile(3) OVER (PARTITION BY league ORDER BY kick, match_id) AS third FROM matches) SELECT league, CAST(third AS INT) AS third, count(*) AS n, round(avg(g), 6) AS mean_goals FROM t GROUP BY 1, 2")
def time_thirds(spark: SparkSession, sf: str) -> DataFrame:
    t = matches(spark, sf).select("league", (F.col("gh") + F.col("ga")).alias("g"), F.ntile(3).over(Window.partitionBy("league").orderBy("kick", "match_id")).alias("third"))
    return rounded(t.groupBy("league", "third").agg(F.count(F.lit(1)).alias("n"), F.avg("g").alias("mean_goals")))


PAIRED_SQL = f"WITH {OVER_SQL}, b AS (SELECT league, avg(y) AS base FROM ov WHERE p IS NOT NULL GROUP BY 1), d AS (SELECT ov.league, pow(p - y, 2) - pow(base - y, 2) AS d FROM ov JOIN b ON ov.league = b.league WHERE p IS NOT NULL) SELECT league, count(*) AS n, round(avg(d), 6) + 0.0 AS mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t FROM d GROUP BY 1"


@R.query("paired_score_t", PAIRED_SQL)
def paired_score_t(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score of the model against the league's base rate: mean difference and its t statistic."""
    o = overs(spark, sf).where("p is not null")
    base = F.avg("y").over(Window.partitionBy("league"))
    d = o.withColumn("d", scoring.binary_brier(F.col("p"), F.col("y")) - scoring.binary_brier(base, F.col("y")))
    t = F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count(F.lit(1))))
    return d.groupBy("league").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("d"), 6) + F.lit(0.0)).alias("mean_difference"), F.round(t, 4).alias("t"))


@R.query("error_percentiles", f"WITH {OVER_SQL}, e AS (SELECT league, abs(p - y) AS e FROM ov WHERE p IS NOT NULL) SELECT league, round(quantile_cont(e, 0.1), 6) AS p10, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.9), 6) AS p90, round(avg(CAST(e > 0.5 AS INT)), 6) AS over_half FROM e GROUP BY 1")
def error_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = overs(spark, sf).where("p is not null").select("league", F.abs(F.col("p") - F.col("y")).alias("e"))
    q = F.percentile("e", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = e.groupBy("league").agg(q.alias("q"), F.avg((F.col("e") > 0.5).cast("double")).alias("over_half"))
    return rounded(out.select("league", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "over_half"))


@R.query("bin_concentration", f"WITH {OVER_SQL}, b AS (SELECT least(greatest(CAST(ceil(p * 10) AS INT) - 1, 0), 9) AS bin, count(*) AS n FROM ov WHERE p IS NOT NULL GROUP BY 1) SELECT CAST(r AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM b), 6) AS share FROM range(10) t(r) LEFT JOIN b ON r = bin")
def bin_concentration(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and share per bin, empty bins kept."""
    b = overs(spark, sf).where("p is not null").groupBy(scoring.right_closed_bin(F.col("p"), 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(10).select(F.col("id").cast("int").alias("bin")).join(b, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return rounded(every.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


@R.query("record_ids", "SELECT obs_id, substr(sha256(concat(coalesce(competition, ''), '|', coalesce(season, ''), '|', coalesce(home_team, ''), '|', coalesce(away_team, ''), '|', coalesce(strftime(kickoff_utc, '%Y-%m-%dT%H:%M:%S'), ''), '|', coalesce(primary_model, ''))), 1, 16) AS id FROM shadow_observations")
def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic ids from the fields of a record; NULL counts as an empty field, not as a missing one."""
    s = table(spark, sf, "shadow_observations")
    parts = [F.coalesce(c, F.lit("")) for c in (F.col("competition"), F.col("season"), F.col("home_team"), F.col("away_team"), F.date_format("kickoff_utc", "yyyy-MM-dd'T'HH:mm:ss"), F.col("primary_model"))]
    return s.select("obs_id", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16).alias("id"))


@R.query("first_price_per_time", f"WITH {WAGERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY market, date_trunc('hour', t_at) ORDER BY t_at, trade_id) AS i FROM wagers) SELECT market, date_trunc('hour', t_at) AS hour, round(price, 6) AS price, trade_id FROM r WHERE i = 1")
def first_price_per_time(spark: SparkSession, sf: str) -> DataFrame:
    w = wagers(spark, sf).withColumn("hour", F.date_trunc("hour", "at").cast("timestamp_ntz"))
    first = reconcile.keep_first(w, [F.col("market"), F.col("hour")], ["at", "trade_id"])
    return first.select("market", "hour", F.round("price", 6).alias("price"), "trade_id")


@R.query("before_and_after_decision", f"WITH {WAGERS_SQL} SELECT wallet, count(*) FILTER (t_at < TIMESTAMP '2024-01-15') AS accepted, count(*) FILTER (t_at >= TIMESTAMP '2024-01-15') AS rejected FROM wagers GROUP BY 1")
def before_and_after_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Trades usable at a decision time and those that came at or after it, per wallet."""
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return wagers(spark, sf).groupBy("wallet").agg(F.count_if(F.col("at") < at).alias("accepted"), F.count_if(F.col("at") >= at).alias("rejected"))


@R.query("unknown_teams", "SELECT home_team AS team, count(*) AS n FROM ligue1_results WHERE home_team IS NOT NULL AND lower(trim(home_team)) NOT IN (SELECT lower(trim(club_name)) FROM clubs) GROUP BY 1")
def unknown_teams(spark: SparkSession, sf: str) -> DataFrame:
    """Team texts that are no club name as they stand (anti join)."""
    known = table(spark, sf, "clubs").select(norm_key(F.col("club_name")).alias("k"))
    r = table(spark, sf, "ligue1_results").where("home_team is not null").select(F.col("home_team").alias("team"), F.coalesce(norm_key(F.col("home_team")), F.lit("")).alias("k"))
    return r.join(known, "k", "left_anti").groupBy("team").agg(F.count(F.lit(1)).alias("n"))


@R.query("weighting_schemes", f"WITH {MATCHES_SQL}, {TEAM_SQL}, k AS (SELECT *, ({AT} - kick) / 24.0 AS age, row_number() OVER (PARTITION BY league, team ORDER BY kick DESC, match_id DESC) AS recency FROM lf WHERE known <= {AT}) SELECT league, team, round(avg(scored), 6) AS flat, " + ", ".join(f"round(sum(scored * pow(0.5, age / {h})) / sum(pow(0.5, age / {h})), 6) AS half_{h}d" for h in (30, 90, 365)) + ", round(avg(scored) FILTER (recency <= 10), 6) AS last_10 FROM k GROUP BY 1, 2")
def weighting_schemes(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rate per team under several recency weights, side by side in one aggregate."""
    lf = strength.long_form(matches(spark, sf)).where(F.col("known") <= AT)
    k = lf.select("league", "team", "scored", ((F.lit(AT) - F.col("kick")) / 24.0).alias("age"), F.row_number().over(Window.partitionBy("league", "team").orderBy(F.col("kick").desc(), F.col("match_id").desc())).alias("recency"))
    rates = []
    for h in (30, 90, 365):
        w = times.decay_weight(F.col("age"), float(h))
        rates.append((F.sum(F.col("scored") * w) / F.sum(w)).alias(f"half_{h}d"))
    return rounded(k.groupBy("league", "team").agg(F.avg("scored").alias("flat"), *rates, F.avg(F.when(F.col("recency") <= 10, F.col("scored"))).alias("last_10")))


@R.query("year_repair", "WITH d AS (SELECT fixture_id, fixture_date, CAST(fixture_date AS DATE) - CAST(fixture_id % 3 AS INT) AS near FROM future_fixtures WHERE fixture_date IS NOT NULL), c AS (SELECT fixture_id, fixture_date, make_date(CAST(year(fixture_date) AS BIGINT) + o, CAST(month(near) AS BIGINT), CAST(day(near) AS BIGINT)) AS cand FROM d, (VALUES (-1), (0), (1)) t(o) WHERE NOT (month(near) = 2 AND day(near) = 29)) SELECT fixture_id, CASE WHEN count(*) FILTER (abs(date_diff('day', cand, fixture_date)) <= 5) = 1 THEN min(cand) FILTER (abs(date_diff('day', cand, fixture_date)) <= 5) END AS repaired FROM c GROUP BY 1")
def year_repair(spark: SparkSession, sf: str) -> DataFrame:
    """A date without year takes the only year of three that brings it within five days of a reference."""
    d = table(spark, sf, "future_fixtures").where("fixture_date is not null").select("fixture_id", "fixture_date", F.date_sub("fixture_date", (F.col("fixture_id") % 3).cast("int")).alias("near"))
    d = d.where(~((F.month("near") == 2) & (F.dayofmonth("near") == 29)))
    cands = F.array(*[F.make_date(F.year("fixture_date") + o, F.month("near"), F.dayofmonth("near")) for o in (-1, 0, 1)])
    close = F.filter(cands, lambda c: F.abs(F.datediff(c, F.col("fixture_date"))) <= 5)
    return d.select("fixture_id", F.when(F.size(close) == 1, F.get(close, F.lit(0))).alias("repaired"))


@R.query("outcome_from_prices")
def outcome_from_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The single outcome whose final price is 1, from lists kept as JSON text; NULL where none or several are."""
    m = table(spark, sf, "markets").select("market_id", F.to_json(F.array(F.lit("Yes"), F.lit("No"))).alias("names"), F.when(F.col("outcome") == "Yes", '["1", "0"]').when(F.col("outcome") == "No", '["0", "1.0"]').otherwise("[]").alias("prices"))
    pairs = F.arrays_zip(F.from_json("names", "array<string>").alias("n"), F.from_json("prices", "array<string>").alias("p"))
    hit = F.filter(pairs, lambda x: x["p"].try_cast("double") == 1.0)
    return m.select("market_id", F.when(F.size(hit) == 1, F.get(hit, F.lit(0))["n"]).alias("outcome"))
