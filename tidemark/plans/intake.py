"""Queries on imported records, whole seasons made from a seed, ordered settlement and comparisons of fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import grid, odds, scoring
from tidemark.functions.keys import fingerprint, norm_key
from tidemark.operators import models
from tidemark.operators.ordered import ordered_scan
from tidemark.plans import registry
from tidemark.plans.adapters import MATCHES_SQL, matches
from tidemark.plans.forecasts import OVER_SQL, overs, walk_forward_scale
from tidemark.plans.history import AT, GRID_SQL, LEAD, predictions, rounded, strength_sql
from tidemark.plans.models import SCORED_SQL, VALUE_SQL, scored, value_rows
from tidemark.session import table

R = registry.new()

# -- imports -------------------------------------------------------------------------------------------

IMPORT_SQL = """t AS (SELECT row_id, lower(trim(source)) AS src, lower(trim(trade_id)) AS tid, lower(trim(wallet_id)) AS w, lower(trim(market_id)) AS m, lower(trim(side)) AS sd, timestamp_utc AS ts, price, size FROM trades),
v AS (SELECT *, CASE WHEN ts IS NULL THEN 'invalid_timestamp' WHEN nullif(w, '') IS NULL OR nullif(m, '') IS NULL OR nullif(sd, '') IS NULL OR price IS NULL OR size IS NULL THEN 'incomplete' END AS bad, CASE WHEN nullif(tid, '') IS NOT NULL THEN tid ELSE concat_ws('|', '#', w, m, ts, sd, price, size) END AS k FROM t),
d AS (SELECT *, row_number() OVER (PARTITION BY bad IS NULL, k ORDER BY row_id) AS i FROM v)"""


@R.query("trade_import_report", f"WITH {IMPORT_SQL} SELECT nullif(src, '') AS source, CASE WHEN bad IS NOT NULL THEN bad WHEN i > 1 THEN 'duplicate' ELSE 'accepted' END AS code, count(*) AS n FROM d GROUP BY 1, 2")
def trade_import_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivered trade with what became of it: accepted, or the reason it was refused, per source.

    A later row with the id, or without id the values, of an earlier complete one is a duplicate.
    """
    t = table(spark, sf, "trades")
    key = {c: norm_key(F.col(c)) for c in ("trade_id", "wallet_id", "market_id", "side")}
    incomplete = key["wallet_id"].isNull() | key["market_id"].isNull() | key["side"].isNull() | F.col("price").isNull() | F.col("size").isNull()
    bad = F.when(F.col("timestamp_utc").isNull(), "invalid_timestamp").when(incomplete, "incomplete")
    by_id, by_values = fingerprint(key["trade_id"]), fingerprint(key["wallet_id"], key["market_id"], F.col("timestamp_utc"), key["side"], F.col("price"), F.col("size"))
    k = [F.when(key["trade_id"].isNotNull(), a).otherwise(b) for a, b in zip(by_id, by_values, strict=True)]
    rows = t.select("row_id", norm_key(F.col("source")).alias("source"), bad.alias("bad"), k[0].alias("k1"), k[1].alias("k2"))
    refused = rows.where("bad is not null").groupBy("source", F.col("bad").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    # Per key only the first row is accepted; counts per key and source suffice, so no group is sorted.
    per = rows.where("bad is null").groupBy("k1", "k2", "source").agg(F.count(F.lit(1)).alias("c"), F.min("row_id").alias("first"))
    owner = F.min_by("source", "first").over(Window.partitionBy("k1", "k2")).eqNullSafe(F.col("source"))
    marked = per.withColumn("kept", owner.cast("int"))
    both = marked.select("source", F.explode(F.array(F.struct(F.lit("accepted").alias("code"), F.col("kept").cast("long").alias("n")), F.struct(F.lit("duplicate").alias("code"), (F.col("c") - F.col("kept")).alias("n")))).alias("x")).select("source", "x.*")
    return refused.unionByName(both.groupBy("source", "code").agg(F.sum("n").alias("n")).where("n > 0"))


@R.query("market_token_owners", "WITH k AS (SELECT DISTINCT lower(trim(market_id)) AS m, trim(unnest(token_ids)) AS tok FROM markets WHERE market_id IS NOT NULL), o AS (SELECT tok, count(DISTINCT m) AS owners FROM k WHERE tok IS NOT NULL GROUP BY 1) SELECT owners, count(*) AS tokens FROM o GROUP BY 1")
def market_token_owners(spark: SparkSession, sf: str) -> DataFrame:
    """How many markets claim each outcome token; more than one is an inconsistency."""
    k = table(spark, sf, "markets").where("market_id is not null").select(norm_key(F.col("market_id")).alias("m"), F.explode("token_ids").alias("tok")).select("m", F.trim("tok").alias("tok")).where("tok is not null").distinct()
    return k.groupBy("tok").agg(F.count("m").alias("owners")).groupBy("owners").agg(F.count(F.lit(1)).alias("tokens"))


@R.query("market_resolution_states", "WITH m AS (SELECT lower(trim(market_id)) AS m, max(resolution_time) AS r, max(end_time) AS e, max(start_time) AS s, max(outcome) AS o FROM markets WHERE market_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN o IS NULL AND r IS NULL THEN 'open' WHEN o IS NULL THEN 'resolved_without_outcome' WHEN r IS NULL THEN 'outcome_without_time' WHEN r < coalesce(s, r) THEN 'resolved_before_start' ELSE 'resolved' END AS state, count(*) AS n, count(*) FILTER (e < s) AS ends_before_start FROM m GROUP BY 1")
def market_resolution_states(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "markets").where("market_id is not null").groupBy(norm_key(F.col("market_id"))).agg(F.max("resolution_time").alias("r"), F.max("end_time").alias("e"), F.max("start_time").alias("s"), F.max("outcome").alias("o"))
    none, late = F.col("o").isNull(), F.col("r").isNull()
    state = F.when(none & late, "open").when(none, "resolved_without_outcome").when(late, "outcome_without_time").when(F.col("r") < F.col("s"), "resolved_before_start").otherwise("resolved")
    return m.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e") < F.col("s")).alias("ends_before_start"))


@R.query("price_coverage", "WITH f AS (SELECT DISTINCT ON (match_id) * FROM football_data_matches) SELECT competition, season, count(*) AS matches, round(avg(CAST(b365h > 1 AND b365d > 1 AND b365a > 1 AS INT)), 6) AS three_way, round(avg(CAST(p_over_2_5 > 1 AND p_under_2_5 > 1 AS INT)), 6) AS two_way, count(*) FILTER (NOT coalesce(b365h > 1 AND b365d > 1 AND b365a > 1, FALSE) AND NOT coalesce(p_over_2_5 > 1 AND p_under_2_5 > 1, FALSE)) AS without FROM (SELECT competition, season, b365h, b365d, b365a, p_over_2_5, p_under_2_5 FROM f) GROUP BY 1, 2")
def price_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of matches with complete prices per competition and season (NULL prices count as none known)."""
    f = table(spark, sf, "football_data_matches").select("match_id", "competition", "season", "b365h", "b365d", "b365a", "p_over_2_5", "p_under_2_5").dropDuplicates(["match_id"])
    full = lambda *cs: F.expr(" and ".join(f"{c} > 1" for c in cs))
    three, two = full("b365h", "b365d", "b365a"), full("p_over_2_5", "p_under_2_5")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return rounded(f.groupBy("competition", "season").agg(F.count(F.lit(1)).alias("matches"), F.avg(three.cast("int")).alias("three_way"), F.avg(two.cast("int")).alias("two_way"), F.count_if(no(three) & no(two)).alias("without")))


# -- a season from a seed ------------------------------------------------------------------------------

TEAMS, MODULUS = 20, 2147483647
#: Multipliers of two linear congruential generators.
A1, A2 = 48271, 16807
RATES = {"lam": "1.45 * exp(0.35 * (u1 - 0.5)) * exp(0.3 * (0.5 - u2)) * 1.1", "mu": "1.15 * exp(0.35 * (u2 - 0.5)) * exp(0.3 * (0.5 - u1))"}
SEASON_SQL = f"""p AS (SELECT h.i AS home, a.i AS away, h.i * {TEAMS} + a.i + 1 AS k FROM range({TEAMS}) h(i), range({TEAMS}) a(i) WHERE h.i <> a.i),
u AS (SELECT home, away, k, (home + 1) * {A1} % {MODULUS} * {A1} % {MODULUS} / {MODULUS}.0 AS u1, (away + 1) * {A1} % {MODULUS} * {A1} % {MODULUS} / {MODULUS}.0 AS u2, k * {A1} % {MODULUS} * {A1} % {MODULUS} / {MODULUS}.0 AS u3, k * {A2} % {MODULUS} * {A2} % {MODULUS} / {MODULUS}.0 AS u4 FROM p),
r AS (SELECT *, {RATES['lam']} AS lam, {RATES['mu']} AS mu FROM u)"""


def synthetic_season(spark: SparkSession, seasons: int = 1) -> DataFrame:
    """season, home, away, lam, mu, gh, ga, p1, p2, p3: double round robins made from congruential numbers.

    Any number of seasons is made in parallel and the same every time; goals
    are read off the Poisson distribution at the match's own number, prices
    are the true shares with a margin of 5 %.
    """
    n = TEAMS * TEAMS
    rows = spark.range(seasons * n).select((F.col("id") / n).cast("long").alias("season"), (F.col("id") % n / TEAMS).cast("long").alias("home"), (F.col("id") % TEAMS).alias("away")).where("home <> away")
    k = F.col("season") * n + F.col("home") * TEAMS + F.col("away") + 1
    u = lambda x, a: x * a % MODULUS * a % MODULUS / float(MODULUS)
    rows = rows.withColumns({"u1": u(F.col("home") + 1, A1), "u2": u(F.col("away") + 1, A1), "u3": u(k, A1), "u4": u(k, A2)})
    rows = rows.withColumns({name: F.expr(text) for name, text in RATES.items()})
    below = lambda rate, x: F.aggregate(grid.pmf(rate), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda acc, p: F.struct((acc["s"] + p).alias("s"), (acc["n"] + (acc["s"] + p < x).cast("int")).alias("n")), lambda acc: acc["n"])
    rows = rows.withColumns({"gh": below(F.col("lam"), F.col("u3")), "ga": below(F.col("mu"), F.col("u4")), "p": models.one_x_two(F.col("lam"), F.col("mu"))})
    return rows.select("season", "home", "away", "lam", "mu", "gh", "ga", *[(1 / (1.05 * F.get("p", F.lit(i)))).alias(f"p{i + 1}") for i in range(3)])


@R.query("seeded_season", f"WITH {SEASON_SQL}, g AS (SELECT home, away, lam, mu, u3, u4, i.i, j.j, exp(-lam) * pow(lam, i.i) / factorial(CAST(i.i AS INT)) AS a, exp(-mu) * pow(mu, j.j) / factorial(CAST(j.j AS INT)) AS b FROM r, range(0, 21) i(i), range(0, 21) j(j)), ch AS (SELECT home, away, i, any_value(a) AS a FROM g GROUP BY ALL), cu AS (SELECT home, away, sum(a) OVER (PARTITION BY home, away ORDER BY i) AS c FROM ch), gh AS (SELECT cu.home, cu.away, count(*) FILTER (c < u3) AS gh FROM cu JOIN r ON cu.home = r.home AND cu.away = r.away GROUP BY ALL), dh AS (SELECT home, away, j, any_value(b) AS b FROM g GROUP BY ALL), du AS (SELECT home, away, sum(b) OVER (PARTITION BY home, away ORDER BY j) AS c FROM dh), ga AS (SELECT du.home, du.away, count(*) FILTER (c < u4) AS ga FROM du JOIN r ON du.home = r.home AND du.away = r.away GROUP BY ALL), o AS (SELECT home, away, sum(a * b) FILTER (i > j) / sum(a * b) AS h, sum(a * b) FILTER (i = j) / sum(a * b) AS d, sum(a * b) FILTER (i < j) / sum(a * b) AS v FROM g GROUP BY ALL) SELECT CAST(r.home AS BIGINT) AS home, CAST(r.away AS BIGINT) AS away, round(lam, 6) AS lam, round(mu, 6) AS mu, gh, ga, round(1 / (1.05 * h), 6) AS p1, round(1 / (1.05 * d), 6) AS p2, round(1 / (1.05 * v), 6) AS p3 FROM r JOIN gh ON r.home = gh.home AND r.away = gh.away JOIN ga ON r.home = ga.home AND r.away = ga.away JOIN o ON r.home = o.home AND r.away = o.away")
def seeded_season(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(synthetic_season(spark).drop("season"))


# -- settlement and strategies -------------------------------------------------------------------------

EDGES = (0.0, 0.02, 0.05, 0.1)


@R.query("strategy_metrics", f"WITH {VALUE_SQL}, e AS (SELECT unnest([0.0, 0.02, 0.05, 0.1]) AS least_edge), b AS (SELECT least_edge, league, price, won, CASE WHEN won THEN price - 1 ELSE -1.0 END AS profit FROM va, e WHERE edge > least_edge AND ev > 0) SELECT least_edge, league, count(*) AS bets, count(*) FILTER (won) AS won, round(sum(profit), 4) AS profit, round(avg(profit), 6) AS return, round(avg(price), 6) AS mean_price, round(stddev_samp(profit), 6) AS sd FROM b GROUP BY GROUPING SETS ((least_edge), (least_edge, league))")
def strategy_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Flat stakes on selections of positive expected value whose edge exceeds a least one, by league and over all."""
    b = value_rows(spark, sf).where("ev > 0").withColumn("least_edge", F.explode(F.array(*[F.lit(x) for x in EDGES]))).where("edge > least_edge")
    profit = F.when(F.col("won"), F.col("price") - 1).otherwise(-1.0)
    g = b.groupingSets([["least_edge"], ["least_edge", "league"]], "least_edge", "league").agg(F.count(F.lit(1)).alias("bets"), F.count_if("won").alias("won"), F.round(F.sum(profit), 4).alias("profit"), F.avg(profit).alias("return"), F.avg("price").alias("mean_price"), F.stddev_samp(profit).alias("sd"))
    return rounded(g)


LEDGER = T.StructType([T.StructField("match_id", T.LongType()), T.StructField("selection", T.StringType()), T.StructField("stake", T.DoubleType()), T.StructField("balance", T.DoubleType()), T.StructField("refused", T.BooleanType())])


def settle_in_order(bets: DataFrame, key: str, order: list[str], start: float, fraction: float, cap: float) -> DataFrame:
    """Bets (key, match_id, selection, f, price, won) settled one after the other: a share of the growth-optimal stake, never more than the balance.

    A bet without value or balance is refused and changes nothing.  Each key
    is one recurrence over its own balance, streamed.
    """

    def step(state: list, row: tuple) -> tuple:
        m, s, f, price, won = row[:5]
        stake = min(state[0] * max(f or 0.0, 0.0) * fraction, cap, state[0])
        if not stake > 0:
            return m, s, 0.0, state[0], True
        state[0] += stake * (price - 1) if won else -stake
        return m, s, stake, state[0], False

    rows = bets.select("match_id", "selection", "f", "price", "won", key, *[c for c in order if c not in ("match_id", "selection")])
    return ordered_scan(rows, key, order, lambda: [start], step, LEDGER)


@R.query("ordered_settlement")
def ordered_settlement(spark: SparkSession, sf: str) -> DataFrame:
    """Balances along each league's bets with stakes that follow the balance."""
    v = value_rows(spark, sf).where("edge > 0.02 and ev > 0")
    return settle_in_order(v.withColumn("f", odds.kelly_fraction(F.col("model_p"), F.col("price"))), "league", ["at", "match_id", "selection"], 1000.0, 0.25, 50.0)


# -- comparisons of fits -------------------------------------------------------------------------------

BOTH_SQL = f"{SCORED_SQL}, bt AS (SELECT a.match_id, a.brier AS a, b.brier AS b FROM sc a JOIN sc b USING (match_id) WHERE a.model = 'goals' AND b.model = 'expected_goals')"


@R.query("model_complementarity", f"WITH {BOTH_SQL} SELECT count(*) AS n, count(*) FILTER (round(a - b, 9) < 0) AS first_better, count(*) FILTER (round(a - b, 9) > 0) AS second_better, count(*) FILTER (round(a - b, 9) = 0) AS ties, round(corr(a, b), 6) AS error_correlation, round(avg(a - b), 6) + 0.0 AS difference FROM bt")
def model_complementarity(spark: SparkSession, sf: str) -> DataFrame:
    """How often the goal and the expected-goal model each do better, and how their errors go together."""
    s = scored(spark, sf).where("model in ('goals', 'expected_goals')").groupBy("match_id").agg(*[F.max(F.when(F.col("model") == m, F.col("brier"))).alias(n) for m, n in (("goals", "a"), ("expected_goals", "b"))]).where("a is not null and b is not null")
    d = F.round(F.col("a") - F.col("b"), 9)
    return rounded(s.agg(F.count(F.lit(1)).alias("n"), F.count_if(d < 0).alias("first_better"), F.count_if(d > 0).alias("second_better"), F.count_if(d == 0).alias("ties"), F.corr("a", "b").alias("error_correlation"), F.avg(F.col("a") - F.col("b")).alias("difference")))


SCALE_SQL = f"{OVER_SQL}, tt AS (SELECT ov.*, m.kick - {LEAD} AS t_at, m.season FROM ov JOIN matches m USING (match_id)), ws AS (SELECT match_id, season, CASE WHEN count(*) OVER w >= 30 THEN round(sum(gh + ga) OVER w / nullif(sum(lam + mu) OVER w, 0), 6) END AS scale FROM tt WINDOW w AS (PARTITION BY tt.league ORDER BY t_at RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@R.query("scale_stability", f"WITH {SCALE_SQL} SELECT season, count(*) AS n, round(avg(scale), 6) AS mean, round(median(scale), 6) AS median, round(stddev_samp(scale), 6) AS sd, round(min(scale), 6) AS least, round(max(scale), 6) AS most, round(stddev_samp(scale) / avg(scale), 6) AS variation FROM ws WHERE scale IS NOT NULL GROUP BY GROUPING SETS ((), (season))")
def scale_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of the walk-forward scale over all rows and by season."""
    s = walk_forward_scale(spark, sf).where("scale is not null").join(matches(spark, sf).select("match_id", "season"), "match_id")
    g = s.groupingSets([[], ["season"]], "season").agg(F.count(F.lit(1)).alias("n"), F.avg("scale").alias("mean"), F.median("scale").alias("median"), F.stddev_samp("scale").alias("sd"), F.min("scale").alias("least"), F.max("scale").alias("most"), (F.stddev_samp("scale") / F.avg("scale")).alias("variation"))
    return rounded(g)


def seven(lam: str, mu: str) -> str:
    t = f"({lam} + {mu})"
    heads = [f"exp(-{t}) * pow({t}, {k}) / factorial({k})" for k in range(6)]
    return "[" + ", ".join([*heads, "1 - (" + " + ".join(heads) + ")"]) + "]"


@R.query("scaled_totals", f"WITH {SCALE_SQL}, d AS (SELECT league, least(gh + ga, 6) AS t, {seven('lam', 'mu')} AS raw, {seven('scale * lam', 'scale * mu')} AS new, lam + mu AS e, scale, gh + ga AS total FROM ov JOIN ws USING (match_id) WHERE scale IS NOT NULL AND p IS NOT NULL), s AS (SELECT league, list_sum(list_transform(range(7), lambda k: pow(raw[k + 1] - CAST(k = t AS INT), 2))) AS br, list_sum(list_transform(range(7), lambda k: pow(new[k + 1] - CAST(k = t AS INT), 2))) AS bn, -ln(greatest(raw[t + 1], 1e-12)) AS lr, -ln(greatest(new[t + 1], 1e-12)) AS ln_, e - total AS ber, e * scale - total AS ben FROM d) SELECT league, count(*) AS n, round(avg(br), 6) AS brier_raw, round(avg(bn), 6) AS brier_scaled, round(avg(lr), 6) AS log_loss_raw, round(avg(ln_), 6) AS log_loss_scaled, round(avg(ber), 6) + 0.0 AS bias_raw, round(avg(ben), 6) + 0.0 AS bias_scaled, round(avg(abs(ber)), 6) AS mae_raw, round(avg(abs(ben)), 6) AS mae_scaled FROM s GROUP BY 1")
def scaled_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Seven classes of totals before and after the walk-forward scale: Brier score, log loss, bias and absolute error."""
    d = overs(spark, sf).where("p is not null").join(walk_forward_scale(spark, sf).where("scale is not null"), "match_id")
    total = (F.col("gh") + F.col("ga")).cast("long")
    out = {"e_raw": F.col("lam") + F.col("mu"), "e_scaled": F.col("scale") * F.col("lam") + F.col("scale") * F.col("mu")}
    d = d.withColumns({**out, "t": F.least(total, F.lit(6)).cast("int"), "total": total})
    aggs = [F.count(F.lit(1)).alias("n")]
    for n in ("raw", "scaled"):
        e = F.col(f"e_{n}")
        heads = [F.exp(-e) * F.pow(e, F.lit(k)) / F.factorial(F.lit(k)) for k in range(6)]
        p = [*heads, 1 - sum(heads[1:], heads[0])]
        aggs += [F.avg(scoring.multi_brier(p, F.col("t"))).alias(f"brier_{n}"), F.avg(scoring.multi_log_loss(p, F.col("t"))).alias(f"log_loss_{n}"), F.avg(e - F.col("total")).alias(f"bias_{n}"), F.avg(F.abs(e - F.col("total"))).alias(f"mae_{n}")]
    return rounded(d.groupBy("league").agg(*aggs))


@R.query("goodness_of_fit_total", f"WITH {strength_sql(LEAD)}, {GRID_SQL}, e AS (SELECT i, j, sum(p) AS expected FROM g WHERE i < 4 AND j < 4 GROUP BY 1, 2), o AS (SELECT gh AS i, ga AS j, count(*) AS observed FROM rated WHERE lam IS NOT NULL GROUP BY 1, 2), c AS (SELECT expected, coalesce(observed, 0) AS observed FROM e LEFT JOIN o ON e.i = o.i AND e.j = o.j), a AS (SELECT count(*) AS n FROM rated WHERE lam IS NOT NULL), z AS (SELECT * FROM c UNION ALL SELECT (SELECT n FROM a) - sum(expected), (SELECT n FROM a) - sum(observed) FROM c) SELECT count(*) AS cells, CAST(sum(observed) AS BIGINT) AS n, round(sum(pow(observed - expected, 2) / expected), 3) AS statistic, round(min(expected), 4) AS least_expected FROM z")
def goodness_of_fit_total(spark: SparkSession, sf: str) -> DataFrame:
    """Chi-square of the 16 low cells and the rest together."""
    p = predictions(spark, sf)
    cells = [(i, j) for i in range(4) for j in range(4)]
    sums = p.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.sum(F.get("h", F.lit(i)) * F.get("a", F.lit(j))).alias("expected"), F.count_if((F.col("gh") == i) & (F.col("ga") == j)).cast("double").alias("observed")) for i, j in cells]).alias("c"))
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda s, x: s + x[f])
    z = sums.select("n", F.concat("c", F.array(F.struct((F.col("n") - total("expected")).alias("expected"), (F.col("n") - total("observed")).alias("observed")))).alias("c"))
    rows = z.select("n", F.explode("c").alias("c"))
    return rows.groupBy("n").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum(F.pow(F.col("c.observed") - F.col("c.expected"), 2) / F.col("c.expected")), 3).alias("statistic"), F.round(F.min("c.expected"), 4).alias("least_expected"))


@R.query("strength_shift", f"WITH {MATCHES_SQL}, lf AS (SELECT league, home AS team, known, gh AS s, ga AS c FROM matches UNION ALL SELECT league, away, known, ga, gh FROM matches), b AS (SELECT league, greatest(avg(s) FILTER (known <= {AT}), 1e-9) AS nb, greatest(avg(s) FILTER (known <= {AT} - 8760), 1e-9) AS ob FROM lf GROUP BY 1), t AS (SELECT league, team, avg(s) FILTER (known <= {AT}) AS ns, avg(s) FILTER (known <= {AT} - 8760) AS os, avg(c) FILTER (known <= {AT}) AS nc, avg(c) FILTER (known <= {AT} - 8760) AS oc, count(*) FILTER (known <= {AT} AND known > {AT} - 8760) AS added FROM lf GROUP BY 1, 2) SELECT league, team, added, round(greatest(ns / nb, 1e-9), 6) AS attack, round(greatest(ns / nb, 1e-9) - greatest(os / ob, 1e-9), 6) + 0.0 AS attack_shift, round(greatest(nc / nb, 1e-9), 6) AS defence, round(greatest(nc / nb, 1e-9) - greatest(oc / ob, 1e-9), 6) + 0.0 AS defence_shift FROM t JOIN b USING (league)")
def strength_shift(spark: SparkSession, sf: str) -> DataFrame:
    """Attack and defence with the last year's matches and how they differ from those without it; both fits come from one pass."""
    from tidemark.operators.strength import long_form

    lf = long_form(matches(spark, sf))
    new, old = F.col("known") <= AT, F.col("known") <= AT - 8760
    mean = lambda c, t: F.avg(F.when(t, F.col(c)))
    floor = lambda c: F.greatest(c, F.lit(1e-9))
    b = lf.groupBy("league").agg(floor(mean("scored", new)).alias("nb"), floor(mean("scored", old)).alias("ob"))
    t = lf.groupBy("league", "team").agg(*[mean(c, w).alias(f"{n}{c[0]}") for c in ("scored", "conceded") for n, w in (("n", new), ("o", old))], F.count_if(new & ~old).alias("added")).join(b, "league")
    ratio = lambda a, base: floor(F.col(a) / F.col(base))
    return rounded(t.select("league", "team", "added", ratio("ns", "nb").alias("attack"), (ratio("ns", "nb") - ratio("os", "ob")).alias("attack_shift"), ratio("nc", "nb").alias("defence"), (ratio("nc", "nb") - ratio("oc", "ob")).alias("defence_shift")))
