"""Queries on reconciliation, merging, cleaning, journals, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import odds, times
from tidemark.functions.keys import norm_key, number_text
from tidemark.operators import reconcile
from tidemark.plans import registry
from tidemark.plans.adapters import MATCHES_SQL, WAGERS_SQL, matches, wagers
from tidemark.session import table
from tidemark.sources import calendars, embedded, exports
from tidemark.streaming import replay

R = registry.new()

# -- reconciliation ------------------------------------------------------------------------------------

@R.query("insert_only_merge", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def insert_only_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    known = table(spark, sf, "orders").where(F.col("o_orderdate") < F.lit("1997-01-01").cast("date")).select(*o.columns)
    return reconcile.insert_only_merge(known, o, "o_orderkey", ["o_orderstatus", "o_totalprice"])


LATE_SQL = f"""{MATCHES_SQL}, l AS (SELECT league, home, away, CAST(floor(kick / 24) AS BIGINT) AS day, match_id FROM matches),
r AS (SELECT league, home, away, CAST(floor((kick + 5) / 24) AS BIGINT) AS day, match_id FROM matches)"""


@R.query("reconcile_one_to_one", f"""WITH {LATE_SQL}, a AS (SELECT league, home, away, day, count(*) AS n, min(match_id) AS i FROM l GROUP BY ALL), b AS (SELECT league, home, away, day, count(*) AS n, min(match_id) AS i FROM r GROUP BY ALL),
f AS (SELECT coalesce(a.league, b.league) AS league, coalesce(a.home, b.home) AS home, coalesce(a.away, b.away) AS away, coalesce(a.day, b.day) AS day, a.n AS nl, b.n AS nr, a.i AS li, b.i AS ri FROM a FULL JOIN b ON a.league = b.league AND a.home = b.home AND a.away = b.away AND a.day = b.day),
s AS (SELECT *, CASE WHEN nl > 1 OR nr > 1 THEN 'duplicate' WHEN nr IS NULL THEN 'left_only' WHEN nl IS NULL THEN 'right_only' ELSE 'matched' END AS status FROM f)
SELECT league, home, away, day, CASE WHEN status IN ('matched', 'left_only') THEN li END AS left_id, CASE WHEN status IN ('matched', 'right_only') THEN ri END AS right_id, status FROM s""")
def reconcile_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    """All matches against a feed of all whose times run five hours late, so that some fall on the next day."""
    m = matches(spark, sf)
    side = lambda late: m.select("league", "home", "away", F.floor((F.col("kick") + late) / 24).cast("long").alias("day"), "match_id")
    return reconcile.one_to_one(side(0), side(5), ["league", "home", "away", "day"], "match_id", "match_id")


def reissued(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All orders, and all of them later: open ones cost 1 more, those in part are issued again under the negative key."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    status = F.col("o_orderstatus")
    return o, o.withColumns({"o_orderkey": F.when(status == "P", -F.col("o_orderkey")).otherwise(F.col("o_orderkey")), "o_totalprice": F.col("o_totalprice") + F.when(status == "O", 1).otherwise(0)})


REISSUED_SQL = "a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders), b AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS k, o_orderstatus AS s, o_totalprice + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS p FROM orders)"


@R.query("record_diff", f"WITH {REISSUED_SQL} SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'missing' WHEN a.s IS NOT DISTINCT FROM b.s AND a.p IS NOT DISTINCT FROM b.p THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.k = b.k")
def record_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = reissued(spark, sf)
    return reconcile.diff(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@R.query("field_difference_stats", f"WITH {REISSUED_SQL}, d AS (SELECT abs(a.p - b.p) AS d FROM a JOIN b ON a.k = abs(b.k)) SELECT count(*) AS n, count(*) FILTER (d > 1e-6) AS changed, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.99), 6) AS p99, round(max(d), 6) AS most FROM d")
def field_difference_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Price changes of all orders, reissued ones against their first issue."""
    old, new = reissued(spark, sf)
    d = old.select("o_orderkey", "o_totalprice").join(new.select(F.abs("o_orderkey").alias("o_orderkey"), F.col("o_totalprice").alias("p2")), "o_orderkey").select(F.abs(F.col("o_totalprice") - F.col("p2")).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 1e-6).alias("changed"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.percentile("d", F.lit(0.99)), 6).alias("p99"), F.round(F.max("d"), 6).alias("most"))


@R.query("interval_match", f"WITH {MATCHES_SQL}, a AS (SELECT match_id, home, kick FROM matches), b AS (SELECT match_id AS r, home, kick + 5 AS k FROM matches), h AS (SELECT a.match_id, r FROM a JOIN b ON a.home = b.home AND abs(a.kick - b.k) <= 12) SELECT a.match_id AS left_id, CASE WHEN count(r) = 0 THEN 'UNMATCHED' WHEN count(r) > 1 THEN 'AMBIGUOUS' ELSE 'MATCHED' END AS status, count(r) AS candidates, min(r) AS first_candidate FROM a LEFT JOIN h USING (match_id) GROUP BY 1")
def interval_match(spark: SparkSession, sf: str) -> DataFrame:
    """Every match against a feed whose times run five hours late, within twelve hours."""
    m = matches(spark, sf).select("match_id", "home", "kick")
    late = m.select(F.col("match_id").alias("r"), "home", (F.col("kick") + 5).alias("k"))
    return reconcile.interval_match(m, late, ["home"], "kick", "k", "match_id", "r", 12)


@R.query("keep_first_delivery", "SELECT prediction_id, obs_id, decision_time FROM shadow_observations QUALIFY row_number() OVER (PARTITION BY lower(trim(prediction_id)) ORDER BY obs_id) = 1")
def keep_first_delivery(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "shadow_observations").select("prediction_id", "obs_id", "decision_time")
    return reconcile.keep_first(s, [norm_key(F.col("prediction_id"))], ["obs_id"])


@R.query("journal_view", "SELECT prediction_id, obs_id, CASE WHEN status = 'SETTLED' THEN 'SETTLED' ELSE 'PENDING' END AS view_status FROM shadow_observations QUALIFY row_number() OVER (PARTITION BY lower(trim(prediction_id)) ORDER BY obs_id DESC) = 1")
def journal_view(spark: SparkSession, sf: str) -> DataFrame:
    """The journal as read: the last line per prediction id holds."""
    s = table(spark, sf, "shadow_observations").select("prediction_id", "obs_id", "status")
    last = reconcile.keep_first(s.withColumn("_back", -F.col("obs_id")), [norm_key(F.col("prediction_id"))], ["_back"])
    return last.select("prediction_id", "obs_id", F.when(F.col("status") == "SETTLED", "SETTLED").otherwise("PENDING").alias("view_status"))


@R.query("name_coverage", "SELECT DISTINCT home_team_openfootball AS name, home_team_openfootball IN (SELECT club_name FROM clubs) AS resolved FROM future_fixtures WHERE home_team_openfootball IS NOT NULL")
def name_coverage(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "future_fixtures").select(F.col("home_team_openfootball").alias("name"))
    return reconcile.coverage(names, table(spark, sf, "clubs"), "name", "club_name")


@R.query("catalogue_union", f"WITH {MATCHES_SQL}, p AS (SELECT match_id, home, away, kick FROM matches WHERE known <= 245000), f AS (SELECT match_id, home, away, kick FROM matches WHERE known > 245000) SELECT match_id, 'played' AS state, kick FROM p UNION ALL SELECT match_id, 'future', kick FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.home = f.home AND p.away = f.away)")
def catalogue_union(spark: SparkSession, sf: str) -> DataFrame:
    """Played matches, and future ones whose pair has not played yet (anti join)."""
    m = matches(spark, sf).select("match_id", "home", "away", "kick", "known")
    played = m.where("known <= 245000")
    future = m.where("known > 245000").join(played.select("home", "away"), ["home", "away"], "left_anti")
    return played.select("match_id", F.lit("played").alias("state"), "kick").unionByName(future.select("match_id", F.lit("future").alias("state"), "kick"))


@R.query("either_key_lookup", "WITH k AS (SELECT lower(trim(market_id)) AS k, market_id AS m FROM markets UNION ALL SELECT lower(trim(condition_id)), market_id FROM markets), u AS (SELECT k, min(m) AS m FROM k WHERE k IS NOT NULL GROUP BY 1) SELECT row_id, m AS market_id FROM trades LEFT JOIN u ON lower(trim(trades.market_id)) = k")
def either_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Trades to markets reachable by market id or condition id."""
    m = table(spark, sf, "markets").select(norm_key(F.col("market_id")).alias("a"), norm_key(F.col("condition_id")).alias("b"), "market_id")
    keys = m.select(F.explode(F.array("a", "b")).alias("k"), "market_id").where("k is not null").groupBy("k").agg(F.min("market_id").alias("m"))
    t = table(spark, sf, "trades").select("row_id", norm_key(F.col("market_id")).alias("k"))
    return t.join(keys, "k", "left").select("row_id", F.col("m").alias("market_id"))


@R.query("season_profile", f"WITH {MATCHES_SQL}, t AS (SELECT league, season, home AS team, 1 AS h, 0 AS a FROM matches UNION ALL SELECT league, season, away, 0, 1 FROM matches), b AS (SELECT league, season, team, abs(sum(h) - sum(a)) AS gap FROM t GROUP BY ALL), g AS (SELECT league, season, count(DISTINCT team) AS teams, max(gap) AS worst_imbalance FROM b GROUP BY ALL) SELECT m.league, m.season, count(*) AS matches, count(*) - count(DISTINCT match_id) AS repeated, count(*) FILTER (gh > 9 OR ga > 9) AS out_of_range, any_value(teams) AS teams, CAST(any_value(worst_imbalance) AS BIGINT) AS worst_imbalance FROM matches m JOIN g ON m.league = g.league AND m.season = g.season GROUP BY m.league, m.season")
def season_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Data-quality profile per league and season."""
    m = matches(spark, sf).select("match_id", "league", "season", "home", "away", "gh", "ga")
    sides = m.select("league", "season", F.explode(F.array(F.struct(F.col("home").alias("team"), F.lit(1).alias("d")), F.struct(F.col("away").alias("team"), F.lit(-1).alias("d")))).alias("x"))
    gap = sides.groupBy("league", "season", "x.team").agg(F.abs(F.sum("x.d")).alias("gap")).groupBy("league", "season").agg(F.count(F.lit(1)).alias("teams"), F.max("gap").alias("worst_imbalance"))
    base = m.groupBy("league", "season").agg(F.count(F.lit(1)).alias("matches"), (F.count(F.lit(1)) - F.count_distinct("match_id")).alias("repeated"), F.count_if((F.col("gh") > 9) | (F.col("ga") > 9)).alias("out_of_range"))
    return base.join(gap, ["league", "season"])


@R.query("functional_names", "SELECT lower(trim(id)) AS id, count(DISTINCT home_id) AS homes FROM (SELECT id, h.id AS home_id FROM epl_2026_datesdata) GROUP BY 1 HAVING count(DISTINCT home_id) > 1")
def functional_names(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that name different home sides over time: where the dimension is not functional."""
    e = table(spark, sf, "epl_2026_datesdata").select(norm_key(F.col("id")).alias("id"), F.col("h.id").alias("home_id"))
    return e.groupBy("id").agg(F.count_distinct("home_id").alias("homes")).where("homes > 1")


@R.query("table_fingerprints")
def table_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in ("nation", "orders", "clubs", "trades"):
        f = reconcile.content_fingerprint(table(spark, sf, name)).select(F.lit(name).alias("table_name"), "rows", "fingerprint")
        out = f if out is None else out.unionByName(f)
    return out


# -- cleaning --------------------------------------------------------------------------------------------


@R.query("price_columns_unpivoted", "WITH f AS (SELECT DISTINCT ON (match_id) * FROM football_data_matches) SELECT match_id, unnest(['1', 'X', '2']) AS selection, unnest([b365h, b365d, b365a]) AS price FROM f WHERE b365h > 1 AND b365d > 1 AND b365a > 1")
def price_columns_unpivoted(spark: SparkSession, sf: str) -> DataFrame:
    """Wide prices to long form, complete triples only."""
    f = table(spark, sf, "football_data_matches").select("match_id", *[odds.valid_price(F.col(c)).alias(n) for c, n in (("b365h", "1"), ("b365d", "X"), ("b365a", "2"))]).dropDuplicates(["match_id"])
    return f.where("`1` is not null and `X` is not null and `2` is not null").unpivot("match_id", ["1", "X", "2"], "selection", "price")


@R.query("text_numbers", "SELECT row_id, CAST(TRY_CAST(goals.h AS DECIMAL(38,12)) AS INT) AS gh, CAST(TRY_CAST(goals.a AS DECIMAL(38,12)) AS INT) AS ga, round(TRY_CAST(xg.h AS DOUBLE), 6) AS xh FROM epl_2026_datesdata WHERE isresult")
def text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records with numbers as text, flattened and typed; what is no number becomes NULL."""
    e = table(spark, sf, "epl_2026_datesdata").where("isresult")
    num = lambda c: number_text(F.col(c)).try_cast("double")
    return e.select("row_id", num("goals.h").cast("int").alias("gh"), num("goals.a").cast("int").alias("ga"), F.round(num("xg.h"), 6).alias("xh"))


@R.query("record_violations", "WITH v AS (SELECT row_id, isresult AND goals.h IS NULL AS no_score, h.id = a.id AS plays_itself, TRY_CAST(xg.h AS DOUBLE) < 0 AS negative FROM epl_2026_datesdata) SELECT count(*) AS records, count(*) FILTER (no_score) AS no_score, count(*) FILTER (plays_itself) AS plays_itself, count(*) FILTER (negative) AS negative FROM v")
def record_violations(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "epl_2026_datesdata").select("isresult", "goals", "h", "a", "xg")
    return e.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("isresult") & F.col("goals.h").isNull()).alias("no_score"), F.count_if(F.col("h.id") == F.col("a.id")).alias("plays_itself"), F.count_if(F.col("xg.h").try_cast("double") < 0).alias("negative"))


@R.query("duplicate_events", f"WITH {WAGERS_SQL}, d AS (SELECT wallet, market, side, size, count(*) AS n FROM wagers GROUP BY ALL) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS repeated FROM d")
def duplicate_events(spark: SparkSession, sf: str) -> DataFrame:
    d = wagers(spark, sf).groupBy("wallet", "market", "side", "size").agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"))


@R.query("known_before_matchday", "WITH k AS (SELECT DISTINCT kickoff_utc FROM football_data_matches), l AS (SELECT kickoff_utc, (kickoff_utc AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS loc FROM k), d AS (SELECT *, CASE isodow(loc) WHEN 6 THEN 1 WHEN 7 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 END AS back FROM l) SELECT kickoff_utc, CASE WHEN back IS NOT NULL THEN (((CAST(CAST(loc AS DATE) - CAST(back AS INT) AS TIMESTAMP) + to_seconds(86399)) AT TIME ZONE 'Europe/London') AT TIME ZONE 'UTC') END AS known_at FROM d")
def known_before_matchday(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "football_data_matches").select("kickoff_utc").distinct()
    return k.select("kickoff_utc", times.known_before_matchday(F.col("kickoff_utc")).alias("known_at"))


# -- sources ---------------------------------------------------------------------------------------------


@R.query("csv_round_trip", "SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as CSV text and read back with a stated schema and a quarantine column."""
    rows = exports.csv_lines(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    back = exports.parse_csv(rows, "value", "o_orderkey long, o_orderstatus string, o_totalprice double")
    return back.where("_bad is null").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.query("json_event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_event_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@R.query("embedded_json_pages")
def embedded_json_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Match lists hidden as escaped JSON in script text, written into pages and read back."""
    e = table(spark, sf, "epl_2026_datesdata").select("row_id", F.to_json(F.struct("id", "isresult", "h", "a", "goals")).alias("body"))
    pages = e.select("row_id", embedded.as_page("body").alias("html"))
    return pages.select("row_id", F.from_json(embedded.literal_of("html"), "id string, isresult boolean, h struct<id:string,title:string>").alias("m")).select("row_id", "m.id", "m.isresult", F.col("m.h.title").alias("home"))


@R.query("calendar_files")
def calendar_files(spark: SparkSession, sf: str) -> DataFrame:
    """Fixtures written as text calendars, one per competition, and parsed back with their exclusions."""
    f = table(spark, sf, "future_fixtures").select("competition", "fixture_date", "home_team_openfootball", "away_team_openfootball", "home_goals", "away_goals", "fixture_id")
    return calendars.parse(calendars.render(f))


# -- streams ---------------------------------------------------------------------------------------------


@R.query("stream_windowed_counts", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf: str) -> DataFrame:
    return replay.windowed_counts(spark, sf)


@R.query("stream_first_deliveries", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY 1, 2")
def stream_first_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    return replay.first_deliveries(spark, sf)
