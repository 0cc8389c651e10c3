"""Queries of the general data problems 1 to 4 over their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import fingerprint, norm_key, number_text
from tidemark.operators import asof, features, snapshots, timestamps
from tidemark.plans import registry
from tidemark.session import cut, table

R = registry.new()


# -- 1: what changed between full snapshots ---------------------------------------------------


def match_content() -> list[Column]:
    """What counts as content of a match list row; titles do not."""
    numbers = ["h.id", "a.id", "goals.h", "goals.a", "xg.h", "xg.a", "forecast.w", "forecast.d", "forecast.l"]
    raw = F.when(F.trim("datetime_raw") != "", F.col("datetime_raw"))
    return [F.col("isresult"), *[number_text(F.col(c)) for c in numbers], raw]


P1_SQL = """
WITH d AS (
  SELECT lower(trim(feed)) AS feed, snapshot_no, lower(trim(id)) AS id, delivered_at, row_no,
    [CAST(isresult AS VARCHAR), CASE WHEN trim(datetime_raw) <> '' THEN datetime_raw END] AS txt,
    [TRY_CAST(x AS DECIMAL(38,12)) FOR x IN [h.id, a.id, goals.h, goals.a, xg.h, xg.a, forecast.w, forecast.d, forecast.l]] AS num
  FROM epl_2026_datesdata),
l AS (SELECT * FROM d QUALIFY delivered_at = max(delivered_at) OVER (PARTITION BY feed, snapshot_no)),
u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY feed, snapshot_no, id ORDER BY row_no DESC) = 1),
s AS (SELECT feed, snapshot_no, lead(snapshot_no) OVER (PARTITION BY feed ORDER BY snapshot_no) AS nxt, row_number() OVER (PARTITION BY feed ORDER BY snapshot_no) AS seq
      FROM (SELECT DISTINCT feed, snapshot_no FROM d)),
n AS (SELECT u.* FROM u JOIN s USING (feed, snapshot_no) WHERE seq > 1),
o AS (SELECT u.feed, s.nxt AS snapshot_no, u.id, u.txt, u.num FROM u JOIN s USING (feed, snapshot_no) WHERE nxt IS NOT NULL)
SELECT coalesce(n.feed, o.feed) AS feed, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.id, o.id) AS id,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM n FULL JOIN o ON n.feed = o.feed AND n.snapshot_no = o.snapshot_no AND n.id = o.id
WHERE o.id IS NULL OR n.id IS NULL OR n.txt IS DISTINCT FROM o.txt OR n.num IS DISTINCT FROM o.num
"""


@R.query("p1_found", P1_SQL)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "epl_2026_datesdata")
    rows = rows.withColumns({"feed": norm_key(F.col("feed")), "id": norm_key(F.col("id"))})
    return snapshots.snapshot_changes(rows, snapshots.SnapshotSpec(), match_content())


@R.query("p1_change_counts", f"SELECT feed, snapshot_no, change_kind, count(*) AS n FROM ({P1_SQL}) GROUP BY ALL")
def p1_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p1_found(spark, sf).groupBy("feed", "snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n"))


# -- 2: mixed timestamp formats ----------------------------------------------------------------


def timestamp_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All non-blank time texts: source_table, record_key, field_name, text, clock, source, zone."""

    def part(name: str, key: str, field: str, source: str, utc: bool = False) -> DataFrame:
        text = F.col(field)
        return table(spark, sf, name).where(F.btrim(text, F.lit(" \t\r\n")) != "").select(
            F.lit(name).alias("source_table"),
            F.col(key).cast("long").alias("record_key"),
            F.lit(field).alias("field_name"),
            text.alias("text"),
            norm_key(F.col("clock")).alias("clock"),
            F.coalesce(norm_key(F.col(source)), F.lit("")).alias("source"),
            F.lit(utc).alias("utc"),
        )

    return (
        part("future_fixtures", "fixture_id", "kickoff_local_naive", "source_file")
        .unionByName(part("future_fixtures", "fixture_id", "kickoff_utc", "source_file", utc=True))
        .unionByName(part("shadow_observations", "obs_id", "recorded_at", "clock"))
        .unionByName(part("epl_2026_datesdata", "row_id", "datetime_raw", "feed"))
    )


def read_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """timestamp_texts with the chosen reading `pick`; the two lookup tables are fixed and tiny."""
    clocks = table(spark, sf, "clock_zones").select(norm_key(F.col("clock")).alias("clock"), "zone_name", "day_first").dropDuplicates(["clock"])
    abbrevs = table(spark, sf, "zone_abbreviations").select(F.upper(F.trim("abbrev")).alias("letters"), "offset_minutes").dropDuplicates(["letters"])
    rows = timestamp_texts(spark, sf).join(F.broadcast(clocks), "clock", "left")
    rows = rows.withColumn("letters", timestamps.trailing_letters(F.col("text"))).join(F.broadcast(abbrevs), "letters", "left")
    zone = F.when(F.col("utc"), "UTC").otherwise(F.col("zone_name"))
    # The day comes first where no clock is given; a clock the table does not know leaves it open.
    first = F.when(F.col("clock").isNull(), True).otherwise(F.col("day_first"))
    rows = rows.select("source_table", "record_key", "field_name", "source", timestamps.read_text("text", zone, first, "offset_minutes").alias("cands"))
    # The readings are used three times below; Python parses each text once.
    return timestamps.choose(cut(rows), ["source_table", "field_name", "source"], "record_key")


@R.query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return read_timestamps(spark, sf).select("source_table", "record_key", "field_name", timestamps.normalised_text(F.col("pick")).alias("normalised"))


@R.query("p2_resolved")
def p2_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """As p2_found, with the path's instant also for local times that happened twice, and the format read."""
    pick = F.col("pick")
    at = F.when(pick["kind"].isin("instant", "ambiguous"), F.timestamp_micros(pick["us"]).cast("timestamp_ntz"))
    return read_timestamps(spark, sf).select("source_table", "record_key", "field_name", at.alias("at_utc"), pick["fmt"].alias("fmt"), F.coalesce(pick["kind"], F.lit("unreadable")).alias("kind"))


@R.query("p2_kind_rates")
def p2_kind_rates(spark: SparkSession, sf: str) -> DataFrame:
    return p2_resolved(spark, sf).groupBy("source_table", "field_name", "kind").agg(F.count(F.lit(1)).alias("n"))


# -- 3: per-entity feature table ---------------------------------------------------------------

FEATURES_UNTIL = "2027-07-01"


def distinct_trades(spark: SparkSession, sf: str) -> DataFrame:
    """wallet_id, action_code, timestamp_utc, milli: one row per trade that has a wallet and an action."""
    t = table(spark, sf, "trades")
    wallet, action, trade = norm_key(F.col("wallet_id")), norm_key(F.col("action_code")), norm_key(F.col("trade_id"))
    rows = t.where(wallet.isNotNull() & action.isNotNull() & F.col("timestamp_utc").isNotNull())
    by_id = fingerprint(trade)
    by_values = fingerprint(wallet, norm_key(F.col("market_id")), F.col("timestamp_utc"), norm_key(F.col("side")), F.col("price"), F.col("size"))
    keys = tuple(F.when(trade.isNotNull(), a).otherwise(b) for a, b in zip(by_id, by_values, strict=True))
    amount = F.coalesce(F.col("notional"), F.col("price") * F.col("size"), F.lit(0.0))
    # The trip over DECIMAL rounds what the digits say, not their binary neighbour.
    milli = F.round(amount.cast("decimal(38,9)") * 1000, 0).cast("long")
    rows = rows.withColumns({"wallet_id": wallet, "action_code": action, "milli": milli})
    return features.one_row_per_event(rows, keys, ["ingested_at", "row_id"], ["wallet_id", "action_code", "timestamp_utc", "milli"])


def trade_history(spark: SparkSession, sf: str) -> DataFrame:
    days = features.daily(distinct_trades(spark, sf), "wallet_id", "action_code", "timestamp_utc", "milli")
    return features.cumulative(days, "wallet_id", "action_code")


def days_before(end: str) -> Column:
    """Whole days from last_at to the start of day `end`."""
    gap = F.unix_micros(F.lit(f"{end} 00:00:00").cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))
    return F.floor(gap / F.lit(86_400_000_000)).cast("long").alias("days_since_last")


P3_BASE = """
WITH t AS (
  SELECT lower(trim(wallet_id)) AS wallet_id, lower(trim(action_code)) AS action_code, timestamp_utc, ingested_at, row_id,
    CAST(round(CAST(coalesce(notional, price * size, 0) AS DECIMAL(28,9)) * 1000, 0) AS BIGINT) AS milli,
    CASE WHEN nullif(trim(trade_id), '') IS NOT NULL THEN lower(trim(trade_id))
      ELSE concat_ws('|', '#', lower(trim(wallet_id)), lower(trim(market_id)), timestamp_utc, lower(trim(side)), coalesce(CAST(price AS VARCHAR), 'null'), coalesce(CAST(size AS VARCHAR), 'null')) END AS k
  FROM trades WHERE nullif(trim(wallet_id), '') IS NOT NULL AND nullif(trim(action_code), '') IS NOT NULL),
u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY ingested_at, row_id) = 1)
"""
P3_SQL = P3_BASE + """
SELECT wallet_id, action_code, count(*) AS n_trades, CAST(sum(milli) AS BIGINT) AS notional_milli,
  CAST(floor((epoch_us(TIMESTAMP '2027-07-01') - epoch_us(max(timestamp_utc))) / 86400000000.0) AS BIGINT) AS days_since_last
FROM u WHERE timestamp_utc < TIMESTAMP '2027-07-01' GROUP BY ALL
"""


@R.query("p3_found", P3_SQL)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    f = features.as_of_features(trade_history(spark, sf), "wallet_id", "action_code", FEATURES_UNTIL, {"all": None})
    return f.select("wallet_id", "action_code", F.col("n_all").alias("n_trades"), F.col("total_all").alias("notional_milli"), days_before(FEATURES_UNTIL))


P3_WINDOWS = {"7d": 7, "28d": 28, "91d": 91, "all": None}
P3_WINDOW_SQL = P3_BASE + "SELECT wallet_id, action_code, " + ", ".join(
    f"CAST(count(*) FILTER (timestamp_utc >= TIMESTAMP '2027-07-01' - INTERVAL {d or 36500} DAY) AS BIGINT) AS n_{w}, CAST(coalesce(sum(milli) FILTER (timestamp_utc >= TIMESTAMP '2027-07-01' - INTERVAL {d or 36500} DAY), 0) AS BIGINT) AS total_{w}"
    for w, d in P3_WINDOWS.items()
) + " FROM u WHERE timestamp_utc < TIMESTAMP '2027-07-01' GROUP BY ALL"


@R.query("p3_window_features", P3_WINDOW_SQL)
def p3_window_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.as_of_features(trade_history(spark, sf), "wallet_id", "action_code", FEATURES_UNTIL, P3_WINDOWS).drop("last_at")


#: Day from which on `p3_extended` takes the events as new ones.
NEW_FROM = "2027-01-01"


@R.query("p3_extended", P3_SQL)
def p3_extended(spark: SparkSession, sf: str) -> DataFrame:
    """p3_found read off a stored table: cumulated to a day, written, extended by the days after it, without reading old events again."""
    days = features.daily(distinct_trades(spark, sf), "wallet_id", "action_code", "timestamp_utc", "milli")
    stored = cut(features.cumulative(days.where(F.col("day") < NEW_FROM), "wallet_id", "action_code"))
    store = features.extended(stored, days.where(F.col("day") >= NEW_FROM), "wallet_id", "action_code")
    f = features.as_of_features(store, "wallet_id", "action_code", FEATURES_UNTIL, {"all": None})
    return f.select("wallet_id", "action_code", F.col("n_all").alias("n_trades"), F.col("total_all").alias("notional_milli"), days_before(FEATURES_UNTIL))


@R.query("p3_wallet_rows")
def p3_wallet_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per wallet: a map from event type to its count, total and recency."""
    return features.wide_by_entity(p3_found(spark, sf), "wallet_id", "action_code")


# -- 4: attributes as known at event time ------------------------------------------------------

P4_SQL = """
WITH ev AS (
  SELECT 'trades' AS event_table, row_id AS event_id, lower(trim(wallet_id)) AS e, timestamp_utc AS t FROM trades
  UNION ALL SELECT 'shadow_observations', obs_id, lower(trim(home_team)), decision_time FROM shadow_observations),
ver AS (
  SELECT 'trades' AS event_table, stat_id AS version_id, lower(trim(wallet_id)) AS e, as_of AS v, known_at AS k FROM trader_stats_asof
  UNION ALL SELECT 'shadow_observations', rating_id, lower(trim(club_name)), valid_from, known_at FROM club_ratings JOIN clubs USING (club_id)),
lg AS (SELECT event_table, e, k, max(row(v, k, version_id)) OVER (PARTITION BY event_table, e ORDER BY k RANGE UNBOUNDED PRECEDING) AS best FROM ver WHERE v IS NOT NULL AND k IS NOT NULL),
lu AS (SELECT DISTINCT event_table, e, k, best[3] AS version_id FROM lg)
SELECT ev.event_table, ev.event_id, lu.version_id FROM ev ASOF JOIN lu ON ev.event_table = lu.event_table AND ev.e = lu.e AND ev.t >= lu.k
"""


@R.query("p4_found", P4_SQL)
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    trades = table(spark, sf, "trades").select(norm_key(F.col("wallet_id")).alias("who"), F.col("timestamp_utc").alias("at"), F.col("row_id").alias("event_id"))
    stats = table(spark, sf, "trader_stats_asof").select(norm_key(F.col("wallet_id")).alias("who"), "as_of", "known_at", F.col("stat_id").alias("version_id"))
    clubs = table(spark, sf, "clubs").select("club_id", norm_key(F.col("club_name")).alias("who"))
    notes = table(spark, sf, "shadow_observations").select(norm_key(F.col("home_team")).alias("who"), F.col("decision_time").alias("at"), F.col("obs_id").alias("event_id"))
    ratings = table(spark, sf, "club_ratings").join(clubs, "club_id").select("who", F.col("valid_from").alias("as_of"), "known_at", F.col("rating_id").alias("version_id"))
    parts = []
    for name, events, versions in (("trades", trades, stats), ("shadow_observations", notes, ratings)):
        log = asof.change_log(versions, "who", "known_at", ["as_of", "known_at", "version_id"], [])
        found = asof.as_known_join(events, "who", "at", ["event_id"], log)
        parts.append(found.select(F.lit(name).alias("event_table"), "event_id", F.col("best.version_id").alias("version_id")))
    return parts[0].unionByName(parts[1])


P4_STATS_SQL = """
WITH lg AS (SELECT lower(trim(wallet_id)) AS e, known_at AS k, max(row(as_of, known_at, stat_id)) OVER (PARTITION BY lower(trim(wallet_id)) ORDER BY known_at RANGE UNBOUNDED PRECEDING) AS best FROM trader_stats_asof WHERE as_of IS NOT NULL AND known_at IS NOT NULL),
lu AS (SELECT DISTINCT e, k, best[3] AS stat_id FROM lg),
st AS (SELECT DISTINCT ON (stat_id) stat_id, n_trades, n_resolved_trades, volume_notional, realized_pnl, win_rate, open_position_count FROM trader_stats_asof)
SELECT t.row_id, t.timestamp_utc, t.market_id, t.notional, st.* FROM trades t ASOF JOIN lu ON lower(trim(t.wallet_id)) = lu.e AND t.timestamp_utc >= lu.k JOIN st USING (stat_id)
"""


@R.query("p4_trades_with_stats", P4_STATS_SQL)
def p4_trades_with_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Every trade of a wallet with the statistics then known (NULL values where the version has none)."""
    trades = table(spark, sf, "trades").withColumn("who", norm_key(F.col("wallet_id")))
    stats = table(spark, sf, "trader_stats_asof").withColumn("who", norm_key(F.col("wallet_id")))
    values = ["n_trades", "n_resolved_trades", "volume_notional", "realized_pnl", "win_rate", "open_position_count"]
    log = asof.change_log(stats, "who", "known_at", ["as_of", "known_at", "stat_id"], values)
    found = asof.as_known_join(trades, "who", "timestamp_utc", ["row_id", "timestamp_utc", "market_id", "notional"], log)
    return found.select("row_id", "timestamp_utc", "market_id", "notional", *[F.col(f"best.{c}").alias(c) for c in ["stat_id", *values]])
