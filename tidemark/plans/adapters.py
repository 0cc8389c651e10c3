"""The generic tables read as matches, prices and trades; the same facts as SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

#: Hours after kick-off at which a score and its expected goals become known.
SCORE_DELAY, XG_DELAY = 2, 48

#: match_id, league, season, home, away, kick (hour number), known, xg_known, gh, ga, xh, xa
MATCHES_SQL = """
mt0 AS (
  SELECT o_orderkey AS match_id, CAST(n_regionkey AS BIGINT) AS league, CAST(year(o_orderdate) AS BIGINT) AS season, CAST(c_nationkey AS BIGINT) AS home,
    CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS BIGINT) AS away,
    CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 24 + o_orderkey % 24 AS kick
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
mg0 AS (
  SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS gh, count(*) FILTER (l_returnflag = 'N') AS ga,
    coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) / 25 AS xh, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) / 25 AS xa
  FROM lineitem GROUP BY 1),
matches AS (
  SELECT mt0.*, kick + 2 AS known, kick + 48 AS xg_known, coalesce(gh, 0) AS gh, coalesce(ga, 0) AS ga, coalesce(xh, 0) AS xh, coalesce(xa, 0) AS xa
  FROM mt0 LEFT JOIN mg0 ON match_id = l_orderkey)"""


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order read as a match; orders without customer or nation are left out."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    goals = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(*[f for flag, g, x in (("A", "gh", "xh"), ("N", "ga", "xa")) for f in (F.count_if(F.col("l_returnflag") == flag).alias(g), (F.coalesce(F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))), F.lit(0.0)) / 25).alias(x))])
    )
    hour = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.col("o_orderkey") % 24
    base = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("match_id"),
        F.col("n_regionkey").cast("long").alias("league"),
        F.year("o_orderdate").cast("long").alias("season"),
        F.col("c_nationkey").cast("long").alias("home"),
        ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("long").alias("away"),
        hour.alias("kick"),
    )
    full = base.join(goals, F.col("match_id") == F.col("l_orderkey"), "left").drop("l_orderkey")
    full = full.withColumns({"known": F.col("kick") + SCORE_DELAY, "xg_known": F.col("kick") + XG_DELAY})
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("gh", "ga")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("xh", "xa")})


#: match_id, bookmaker, known, p1, p2, p3 (three prices in (1, 15)), part, gross (to tell equal quotes apart)
QUOTES_SQL = """
quotes AS (
  SELECT m.match_id, CAST(l_linenumber AS BIGINT) AS bookmaker, m.kick - (1 + l_linenumber * 7) AS known,
    1.05 + l_quantity % 13 AS p1, 1.05 + CAST(floor(l_extendedprice) AS BIGINT) % 13 AS p2, 1.05 + CAST(round(l_tax * 100) AS BIGINT) % 13 AS p3, l_partkey AS part, l_extendedprice AS gross
  FROM lineitem JOIN matches m ON l_orderkey = m.match_id)"""


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf).select("match_id", "kick")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_partkey")
    return li.join(m, F.col("l_orderkey") == F.col("match_id")).select(
        "match_id",
        F.col("l_linenumber").cast("long").alias("bookmaker"),
        (F.col("kick") - (1 + F.col("l_linenumber") * 7)).alias("known"),
        (1.05 + F.col("l_quantity") % 13).alias("p1"),
        (1.05 + F.floor("l_extendedprice").cast("long") % 13).alias("p2"),
        (1.05 + F.round(F.col("l_tax") * 100).cast("long") % 13).alias("p3"),
        F.col("l_partkey").alias("part"),
        F.col("l_extendedprice").alias("gross"),
    )


#: trade_id, wallet, market, at (timestamp), side, size, price, won, resolved_at
WAGERS_SQL = """
wagers AS (
  SELECT event_id AS trade_id, user_id AS wallet, CAST(json_extract_string(props, '$.k') AS BIGINT) AS market, ts AS t_at,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'buy' ELSE 'sell' END AS side, value AS size,
    (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) / 102.0 AS price
  FROM events),
settled AS (
  SELECT DISTINCT market, market % 3 = 0 AS won, TIMESTAMP '2024-01-01' + to_hours(CAST(market % 20 AS INT) * 24) AS resolved_at FROM wagers)"""


def wagers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("trade_id"),
        F.col("user_id").alias("wallet"),
        k.alias("market"),
        F.col("ts").alias("at"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), "buy").otherwise("sell").alias("side"),
        F.col("value").alias("size"),
        ((k + 1) / 102.0).cast("double").alias("price"),
    )


def settled(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return wagers(spark, sf).select("market").distinct().select("market", (F.col("market") % 3 == 0).alias("won"), (start + F.make_dt_interval((F.col("market") % 20).cast("int"))).alias("resolved_at"))
