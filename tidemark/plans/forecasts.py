"""Queries on prices, calibration, resampling and ordered ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import grid, odds, scoring
from tidemark.operators import calibration, ledger, resampling
from tidemark.plans import registry
from tidemark.plans.adapters import MATCHES_SQL, QUOTES_SQL, WAGERS_SQL, matches, quotes, settled, wagers
from tidemark.plans.history import GRID_SQL, LEAD, predictions, rounded, strength_sql
from tidemark.session import cut, table

R = registry.new()

# -- prices --------------------------------------------------------------------------------------

FD_SQL = "fd AS (SELECT DISTINCT ON (match_id) match_id, competition, ftr, fthg, ftag, b365h, b365d, b365a, p_over_2_5, p_under_2_5 FROM football_data_matches)"


def regional(spark: SparkSession, sf: str) -> DataFrame:
    """football_data_matches with repeated rows taken once (repeats are equal)."""
    return table(spark, sf, "football_data_matches").select("match_id", "competition", "ftr", "fthg", "ftag", "b365h", "b365d", "b365a", "p_over_2_5", "p_under_2_5").dropDuplicates(["match_id"])


@R.query("without_margin", f"WITH {FD_SQL}, p AS (SELECT match_id, 1/b365h AS h, 1/b365d AS d, 1/b365a AS a FROM fd) SELECT match_id, round(h + d + a - 1, 6) AS hold, round(h / (h + d + a), 6) AS home, round(d / (h + d + a), 6) AS draw, round(a / (h + d + a), 6) AS away FROM p")
def without_margin(spark: SparkSession, sf: str) -> DataFrame:
    prices = [F.col(c) for c in ("b365h", "b365d", "b365a")]
    return rounded(regional(spark, sf).select("match_id", odds.hold(prices).alias("hold"), *[p.alias(n) for p, n in zip(odds.without_margin(prices), ("home", "draw", "away"), strict=True)]))


@R.query("two_way_over", f"WITH {FD_SQL} SELECT match_id, round((1/p_over_2_5) / (1/p_over_2_5 + 1/p_under_2_5), 6) AS p_over FROM fd")
def two_way_over(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regional(spark, sf).select("match_id", odds.without_margin([F.col("p_over_2_5"), F.col("p_under_2_5")])[0].alias("p_over")))


@R.query("shin_probabilities")
def shin_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Margin removed by the insider model: z found by bisection inside the JVM, 50 halvings."""
    q = regional(spark, sf).where("b365h > 1 and b365d > 1 and b365a > 1").withColumn("pi", F.array(*[1 / F.col(c) for c in ("b365h", "b365d", "b365a")]))
    q = q.withColumn("s", F.aggregate("pi", F.lit(0.0), lambda a, x: a + x))

    def at(z):  # noqa: ANN001, ANN202
        return lambda x: (F.sqrt(z * z + 4 * (1 - z) * x * x / F.col("s")) - z) / (2 * (1 - z))

    def total(z):  # noqa: ANN001, ANN202
        return F.aggregate(F.transform("pi", at(z)), F.lit(0.0), lambda a, x: a + x)

    # The sum falls with z from sqrt(s) at 0, so the root of sum = 1 is bracketed by [0, 0.5].
    bracket = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(F.lit(0.0).alias("lo"), F.lit(0.5).alias("hi")), lambda b, _: F.when(total((b["lo"] + b["hi"]) / 2) > 1, F.struct(((b["lo"] + b["hi"]) / 2).alias("lo"), b["hi"].alias("hi"))).otherwise(F.struct(b["lo"].alias("lo"), ((b["lo"] + b["hi"]) / 2).alias("hi"))))
    z = F.when(F.col("s") <= 1 + 1e-9, 0.0).otherwise((F.col("b.lo") + F.col("b.hi")) / 2)
    solved = q.withColumn("b", bracket).withColumn("z", z).withColumn("p", F.transform("pi", at(F.col("z"))))
    return rounded(solved.select("match_id", "z", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("home", "draw", "away"))]))


LONG_SQL = "nq AS (SELECT match_id, bookmaker, known, unnest([1, 2, 3]) AS sel, unnest([p1, p2, p3]) AS price, unnest([1 / p1 / s, 1 / p2 / s, 1 / p3 / s]) AS fair FROM (SELECT *, 1 / p1 + 1 / p2 + 1 / p3 AS s FROM quotes))"


def long_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per quote and selection with the margin removed inside each bookmaker's quote.

    The three prices of a quote lie in one row, so no shuffle is needed.
    """
    q = quotes(spark, sf)
    prices = [F.col(c) for c in ("p1", "p2", "p3")]
    fair = odds.without_margin(prices)
    sel = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("sel"), p.cast("double").alias("price"), f.alias("fair")) for i, (p, f) in enumerate(zip(prices, fair, strict=True))]))
    return q.select("match_id", "bookmaker", "known", sel.alias("x")).select("match_id", "bookmaker", "known", "x.*")


@R.query("consensus", f"WITH {MATCHES_SQL}, {QUOTES_SQL}, {LONG_SQL} SELECT match_id, sel, count(*) AS n, round(avg(fair), 6) AS mean, round(median(fair), 6) AS median, round(min(fair), 6) AS least, round(max(fair), 6) AS most, round(stddev_samp(fair), 6) AS sd FROM nq GROUP BY 1, 2")
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    g = long_quotes(spark, sf).groupBy("match_id", "sel")
    return rounded(g.agg(F.count(F.lit(1)).alias("n"), F.avg("fair").alias("mean"), F.median("fair").alias("median"), F.min("fair").alias("least"), F.max("fair").alias("most"), F.stddev_samp("fair").alias("sd")))


@R.query("gap_to_consensus", f"WITH {MATCHES_SQL}, {QUOTES_SQL}, {LONG_SQL}, g AS (SELECT *, fair - avg(fair) OVER (PARTITION BY match_id, sel) AS gap, count(*) OVER (PARTITION BY match_id, sel) AS n FROM nq) SELECT bookmaker, CASE WHEN n < 2 THEN 'none' WHEN abs(gap) >= 0.10 THEN 'strong' WHEN abs(gap) >= 0.05 THEN 'weak' ELSE 'normal' END AS class, count(*) AS quotes FROM g GROUP BY 1, 2")
def gap_to_consensus(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("match_id", "sel")
    g = long_quotes(spark, sf).select("bookmaker", (F.col("fair") - F.avg("fair").over(w)).alias("gap"), F.count(F.lit(1)).over(w).alias("n"))
    label = F.when(F.col("n") < 2, "none").when(F.abs("gap") >= 0.10, "strong").when(F.abs("gap") >= 0.05, "weak").otherwise("normal")
    return g.groupBy("bookmaker", label.alias("class")).agg(F.count(F.lit(1)).alias("quotes"))


@R.query("price_rank", f"WITH {MATCHES_SQL}, {QUOTES_SQL}, {LONG_SQL} SELECT match_id, sel, bookmaker, row_number() OVER (PARTITION BY match_id, sel ORDER BY price DESC, bookmaker, known, fair) AS rank FROM nq")
def price_rank(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("match_id", "sel").orderBy(F.col("price").desc(), "bookmaker", "known", "fair")
    return long_quotes(spark, sf).select("match_id", "sel", "bookmaker", F.row_number().over(w).cast("long").alias("rank"))


@R.query("best_price_sum", f"WITH {MATCHES_SQL}, {QUOTES_SQL}, {LONG_SQL}, b AS (SELECT match_id, sel, max(price) AS best FROM nq GROUP BY 1, 2) SELECT match_id, round(sum(1 / best), 6) AS total, round(1 - sum(1 / best), 6) AS margin, sum(1 / best) < 1 AS arbitrage FROM b GROUP BY 1 HAVING count(*) = 3")
def best_price_sum(spark: SparkSession, sf: str) -> DataFrame:
    best = long_quotes(spark, sf).groupBy("match_id", "sel").agg(F.max("price").alias("best"))
    total = F.sum(1 / F.col("best"))
    return rounded(best.groupBy("match_id").agg(total.alias("total"), (1 - total).alias("margin"), (total < 1).alias("arbitrage"), F.count(F.lit(1)).alias("n")).where("n = 3").drop("n"))


@R.query("price_movement", f"WITH {MATCHES_SQL}, {QUOTES_SQL}, {LONG_SQL}, oc AS (SELECT match_id, sel, arg_min(price, row(known, bookmaker, price, fair)) AS o, arg_max(price, row(known, bookmaker, price, fair)) AS c, arg_min(fair, row(known, bookmaker, price, fair)) AS fo, arg_max(fair, row(known, bookmaker, price, fair)) AS fc FROM nq GROUP BY 1, 2) SELECT match_id, sel, round(c - o, 6) + 0.0 AS move, round(c / o - 1, 6) + 0.0 AS relative, round(fc - fo, 6) + 0.0 AS fair_move FROM oc")
def price_movement(spark: SparkSession, sf: str) -> DataFrame:
    at = F.struct("known", "bookmaker", "price", "fair")
    g = long_quotes(spark, sf).groupBy("match_id", "sel").agg(*[f(c, at).alias(n) for f, c, n in ((F.min_by, "price", "o"), (F.max_by, "price", "c"), (F.min_by, "fair", "fo"), (F.max_by, "fair", "fc"))])
    return rounded(g.select("match_id", "sel", (F.col("c") - F.col("o")).alias("move"), (F.col("c") / F.col("o") - 1).alias("relative"), (F.col("fc") - F.col("fo")).alias("fair_move")))


@R.query("complete_quoters", "SELECT match_id, count(*) AS complete FROM (SELECT result_id AS match_id, o.betting_type_id AS b FROM (SELECT result_id, unnest(odds) AS o FROM ligue1_results) WHERE o.avg_odds IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT o.outcome_result_id) = 3) GROUP BY 1")
def complete_quoters(spark: SparkSession, sf: str) -> DataFrame:
    """Betting types that quote all three outcomes (relational division), per result."""
    o = table(spark, sf, "ligue1_results").select(F.col("result_id").alias("match_id"), F.explode("odds").alias("o"))
    full = o.where("o.avg_odds is not null").groupBy("match_id", F.col("o.betting_type_id").alias("b")).agg(F.count_distinct("o.outcome_result_id").alias("k")).where("k = 3")
    return full.groupBy("match_id").agg(F.count(F.lit(1)).alias("complete"))


@R.query("quotes_exploded", "SELECT result_id, o.betting_type_id AS betting_type_id, o.scope_id AS scope_id, o.outcome_result_id AS outcome_result_id, o.avg_odds AS avg_odds, o.max_odds AS max_odds FROM (SELECT result_id, unnest(odds) AS o FROM ligue1_results)")
def quotes_exploded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ligue1_results").select("result_id", F.explode("odds").alias("o")).select("result_id", "o.*")


@R.query("handicap_settlement", f"WITH {MATCHES_SQL}, l AS (SELECT match_id, unnest([-1.25, -0.5, 0.0, 0.25, 1.0]) AS line, gh - ga AS d FROM matches) SELECT line, count(*) AS n, round(avg(CASE WHEN d + line >= 0.5 THEN 1 WHEN d + line = 0.25 THEN 0.5 WHEN d + line = 0 THEN 0 WHEN d + line = -0.25 THEN -0.5 ELSE -1 END), 6) AS mean_fraction FROM l GROUP BY 1")
def handicap_settlement(spark: SparkSession, sf: str) -> DataFrame:
    rows = matches(spark, sf).select((F.col("gh") - F.col("ga")).cast("double").alias("d"), F.explode(F.array(*[F.lit(x) for x in (-1.25, -0.5, 0.0, 0.25, 1.0)])).alias("line"))
    return rounded(rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.avg(odds.settle_fraction(F.col("d"), F.col("line"))).alias("mean_fraction")))


# -- calibration -----------------------------------------------------------------------------------

OVER_SQL = f"{strength_sql(LEAD)}, {GRID_SQL}, ov AS (SELECT match_id, league, any_value(gh) AS gh, any_value(ga) AS ga, any_value(lam) AS lam, any_value(mu) AS mu, round(sum(p) FILTER (i + j > 2) / nullif(sum(p), 0), 6) AS p, CAST(any_value(gh) + any_value(ga) > 2 AS INT) AS y FROM g GROUP BY 1, 2)"


def overs(spark: SparkSession, sf: str) -> DataFrame:
    """match_id, league, at, gh, ga, lam, mu, p (rounded forecast of more than 2 goals), y."""
    d = predictions(spark, sf)
    p = grid.over_probability(grid.total_distribution(F.col("h"), F.col("a")), 2.5)
    # Written once: filters on p would otherwise be pushed down and repeat the whole grid expression.
    return cut(d.select("match_id", "league", "at", "gh", "ga", "lam", "mu", F.round(p, 6).alias("p"), (F.col("gh") + F.col("ga") > 2).cast("int").alias("y")))


BIN = "least(greatest(CAST(ceil(p * 10) AS INT) - 1, 0), 9)"


@R.query("reliability_bins", f"WITH {OVER_SQL}, b AS (SELECT {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM ov WHERE p IS NOT NULL GROUP BY 1) SELECT CAST(r AS INT) AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y FROM range(10) t(r) LEFT JOIN b ON r = bin")
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibration.reliability(overs(spark, sf), "p", "y"))


@R.query("forecast_scores", f"WITH {OVER_SQL} SELECT league, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(greatest(p, 1e-12)) + (1 - y) * ln(greatest(1 - p, 1e-12)))), 6) AS log_loss, round(avg(p - y), 6) + 0.0 AS bias FROM ov WHERE p IS NOT NULL GROUP BY 1")
def forecast_scores(spark: SparkSession, sf: str) -> DataFrame:
    p, y = F.col("p"), F.col("y")
    return rounded(overs(spark, sf).where("p is not null").groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.avg(scoring.binary_brier(p, y)).alias("brier"), F.avg(scoring.binary_log_loss(p, y)).alias("log_loss"), F.avg(p - y).alias("bias")))


@R.query("score_decomposition", f"WITH {OVER_SQL}, b AS (SELECT league, {BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM ov WHERE p IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n * my) OVER (PARTITION BY league) / sum(n) OVER (PARTITION BY league) AS base FROM b) SELECT league, CAST(sum(n) AS BIGINT) AS n, round(sum(n * pow(mp - my, 2)) / sum(n), 6) AS reliability, round(sum(n * pow(my - base, 2)) / sum(n), 6) AS resolution, round(max(base * (1 - base)), 6) AS uncertainty, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM t GROUP BY 1")
def score_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibration.murphy(overs(spark, sf), "p", "y", by=["league"]))


@R.query("bin_monotonicity", f"WITH {OVER_SQL}, b AS (SELECT {BIN} AS bin, avg(y) AS my FROM ov WHERE p IS NOT NULL GROUP BY 1), l AS (SELECT my - lag(my) OVER (ORDER BY bin) AS d FROM b) SELECT count(*) FILTER (d < 0) AS violations FROM l")
def bin_monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.decreases(calibration.bin_rows(overs(spark, sf), "p", "y", 10), "bin", "mean_y")


@R.query("quintile_table", f"WITH {OVER_SQL}, e AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM ov) SELECT CAST(len(list_filter(q, lambda x: x < p)) AS INT) AS part, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM ov, e WHERE p IS NOT NULL GROUP BY 1")
def quintile_table(spark: SparkSession, sf: str) -> DataFrame:
    q = calibration.quantile_bin(overs(spark, sf).where("p is not null"), "p", 5)
    return rounded(q.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y")))


@R.query("fixed_bin_table", f"WITH {OVER_SQL} SELECT CASE WHEN lam + mu < 1 THEN 0 WHEN lam + mu < 2 THEN 1 WHEN lam + mu < 3 THEN 2 WHEN lam + mu < 4 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(lam + mu), 6) AS mean_expected, round(avg(gh + ga), 6) AS mean_actual FROM ov GROUP BY 1")
def fixed_bin_table(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("lam") + F.col("mu")
    return rounded(overs(spark, sf).groupBy(scoring.left_closed_bin(x, [1.0, 2.0, 3.0, 4.0]).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_expected"), F.avg((F.col("gh") + F.col("ga")).cast("double")).alias("mean_actual")))


@R.query("cross_bin_table", f"WITH {OVER_SQL}, e AS (SELECT quantile_cont(lam, [0.2, 0.4, 0.6, 0.8]) AS a, quantile_cont(mu, [0.2, 0.4, 0.6, 0.8]) AS b FROM ov), kk AS (SELECT CAST(len(list_filter(a, lambda x: x < lam)) AS INT) AS i, CAST(len(list_filter(b, lambda x: x < mu)) AS INT) AS j, y FROM ov, e) SELECT i, j, count(*) AS n, round(avg(y), 6) AS mean_y FROM kk GROUP BY GROUPING SETS ((i, j), (i), (j), ())")
def cross_bin_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two quintile bins against each other with margins (CUBE)."""
    both = calibration.quantile_bin(calibration.quantile_bin(overs(spark, sf), "lam", 5).withColumnRenamed("part", "i"), "mu", 5).withColumnRenamed("part", "j")
    return rounded(both.cube("i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("mean_y")))


@R.query("stability_report", f"WITH {OVER_SQL}, s AS (SELECT ov.*, m.season FROM ov JOIN matches m USING (match_id) WHERE p IS NOT NULL) SELECT s.league, s.season, count(*) AS n, round(avg(p - y), 6) + 0.0 AS bias FROM s GROUP BY GROUPING SETS ((), (s.league), (s.season))")
def stability_report(spark: SparkSession, sf: str) -> DataFrame:
    s = overs(spark, sf).where("p is not null").join(matches(spark, sf).select("match_id", "season"), "match_id")
    return rounded(s.groupingSets([[], ["league"], ["season"]], "league", "season").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p") - F.col("y")).alias("bias")))


@R.query("walk_forward_scale", f"WITH {OVER_SQL}, t AS (SELECT ov.*, m.kick - {LEAD} AS t_at FROM ov JOIN matches m USING (match_id)) SELECT match_id, CASE WHEN count(*) OVER w >= 30 THEN round(sum(gh + ga) OVER w / nullif(sum(lam + mu) OVER w, 0), 6) END AS scale FROM t WINDOW w AS (PARTITION BY t.league ORDER BY t_at RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def walk_forward_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = overs(spark, sf).withColumns({"actual": (F.col("gh") + F.col("ga")).cast("double"), "expected": F.col("lam") + F.col("mu")})
    return rounded(calibration.walk_forward_scale(rows, ["league"], "at", "actual", "expected").select("match_id", "scale"))


@R.query("goal_moments", f"WITH {MATCHES_SQL} SELECT league, count(*) AS n, round(avg(gh + ga), 6) AS mean, round(var_samp(gh + ga) / avg(gh + ga), 6) AS dispersion, round(avg(pow(gh + ga - m, 3)) / pow(var_pop(gh + ga), 1.5), 6) AS skew, round(avg(pow(gh + ga - m, 4)) / pow(var_pop(gh + ga), 2) - 3, 6) AS kurtosis FROM (SELECT *, avg(gh + ga) OVER (PARTITION BY league) AS m FROM matches) GROUP BY 1")
def goal_moments(spark: SparkSession, sf: str) -> DataFrame:
    t = (F.col("gh") + F.col("ga")).cast("double")
    return rounded(matches(spark, sf).groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.avg(t).alias("mean"), (F.var_samp(t) / F.avg(t)).alias("dispersion"), F.skewness(t).alias("skew"), F.kurtosis(t).alias("kurtosis")))


@R.query("chronological_split", f"WITH {MATCHES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY kick, match_id) AS i, count(*) OVER (PARTITION BY league, season) AS n FROM matches) SELECT league, season, CASE WHEN i <= floor(n * 0.4) THEN 'burn_in' WHEN i <= floor(n * 0.4) + floor(n * 0.3) THEN 'calibration' ELSE 'test' END AS split, count(*) AS n, min(kick) AS first_kick FROM r GROUP BY ALL")
def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    s = calibration.chronological_split(matches(spark, sf), ["league", "season"], ["kick", "match_id"])
    return s.groupBy("league", "season", "split").agg(F.count(F.lit(1)).alias("n"), F.min("kick").alias("first_kick"))


@R.query("goodness_of_fit", f"WITH {strength_sql(LEAD)}, {GRID_SQL}, e AS (SELECT i, j, sum(p) AS expected FROM g WHERE i < 4 AND j < 4 GROUP BY 1, 2), o AS (SELECT gh AS i, ga AS j, count(*) AS observed FROM rated WHERE lam IS NOT NULL GROUP BY 1, 2) SELECT CAST(e.i AS INT) AS i, CAST(e.j AS INT) AS j, round(expected, 4) AS expected, coalesce(observed, 0) AS observed, round(pow(coalesce(observed, 0) - expected, 2) / expected, 3) AS part FROM e LEFT JOIN o ON e.i = o.i AND e.j = o.j")
def goodness_of_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Expected and observed counts of the cells 0-0 to 3-3; all 16 sums come from one aggregate."""
    p = predictions(spark, sf)
    cells = [(i, j) for i in range(4) for j in range(4)]
    sums = p.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(F.get("h", F.lit(i)) * F.get("a", F.lit(j))).alias("expected"), F.count_if((F.col("gh") == i) & (F.col("ga") == j)).alias("observed")) for i, j in cells]).alias("c"))
    rows = sums.select(F.explode("c").alias("c")).select("c.*")
    return rows.select("i", "j", F.round("expected", 4).alias("expected"), "observed", F.round(F.pow(F.col("observed") - F.col("expected"), 2) / F.col("expected"), 3).alias("part"))


@R.query("correlation_matrix", f"WITH {OVER_SQL} SELECT round(corr(p, lam), 6) AS p_lam, round(corr(p, mu), 6) AS p_mu, round(corr(lam, mu), 6) AS lam_mu, round(corr(p, y), 6) AS p_y, round(avg(abs(lam + mu - gh - ga)), 6) AS mae FROM ov WHERE p IS NOT NULL")
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    o = overs(spark, sf).where("p is not null")
    return rounded(o.agg(F.corr("p", "lam").alias("p_lam"), F.corr("p", "mu").alias("p_mu"), F.corr("lam", "mu").alias("lam_mu"), F.corr("p", F.col("y").cast("double")).alias("p_y"), F.avg(F.abs(F.col("lam") + F.col("mu") - F.col("gh") - F.col("ga"))).alias("mae")))


@R.query("isotonic_curve")
def isotonic_curve(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.isotonic_curve(overs(spark, sf), "league", "p", "y")


@R.query("logistic_recalibration")
def logistic_recalibration(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.logistic_recalibration(overs(spark, sf), "league", "p", "y")


# -- resampling and tests -----------------------------------------------------------------------------


@R.query("bootstrap_bias")
def bootstrap_bias(spark: SparkSession, sf: str) -> DataFrame:
    rows = overs(spark, sf).where("p is not null").select("match_id", "league", (F.col("p") - F.col("y")).alias("bias"))
    return resampling.bootstrap_means(rows, "league", "bias", "match_id")


@R.query("association_table")
def association_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = overs(spark, sf).where("p is not null").select("league", (F.col("lam") > F.col("mu")).alias("favoured"), (F.col("gh") > F.col("ga")).alias("won"))
    return resampling.two_by_two(rows, "league", "favoured", "won")


@R.query("holm_steps", "WITH p AS (SELECT n_nationkey AS id, ((n_nationkey * 37 + 11) % 100) / 1000.0 AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM p) SELECT id, round(p, 6) AS p, min(CAST(p <= 0.05 / (n - i + 1) AS INT)) OVER (ORDER BY i) = 1 AS rejected FROM r")
def holm_steps(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (((F.col("n_nationkey") * 37 + 11) % 100) / 1000.0).cast("double").alias("p"))
    return rounded(resampling.holm(p, "p", "id"))


DYADIC_SQL = f"""WITH {OVER_SQL}, d AS (SELECT m.match_id, m.home AS l, m.away AS r, ov.p AS x, CAST(ov.y AS DOUBLE) AS y FROM ov JOIN matches m USING (match_id) WHERE ov.p IS NOT NULL),
c AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) AS b, var_pop(x) AS v, count(*) AS n, corr(x, y) AS r FROM d),
gs AS (SELECT l, r, (x - mx) * (y - my - b * (x - mx)) AS g FROM d, (SELECT mx, my, b FROM c)),
t AS (SELECT k, sum(g) AS t FROM (SELECT l AS k, g FROM gs UNION ALL SELECT r, g FROM gs WHERE l <> r) GROUP BY 1),
q AS (SELECT least(l, r) AS a, greatest(l, r) AS z, sum(g) AS t FROM gs WHERE l <> r GROUP BY 1, 2)
SELECT n, round(b, 6) AS slope, round(r, 6) AS r, round(((SELECT sum(t * t) FROM t) - (SELECT sum(t * t) FROM q)) / pow(n * v, 2), 8) AS slope_variance FROM c"""


@R.query("dyadic_slope", DYADIC_SQL)
def dyadic_slope(spark: SparkSession, sf: str) -> DataFrame:
    rows = overs(spark, sf).where("p is not null").select("match_id", "p", F.col("y").cast("double").alias("y")).join(matches(spark, sf).select("match_id", "home", "away"), "match_id")
    d = resampling.dyadic_slope(rows, "p", "y", "home", "away")
    return d.select("n", F.round("slope", 6).alias("slope"), F.round("r", 6).alias("r"), F.round("slope_variance", 8).alias("slope_variance"))


# -- ledgers -------------------------------------------------------------------------------------------

BETS_SQL = f"{MATCHES_SQL}, {QUOTES_SQL}, bets AS (SELECT q.bookmaker, q.match_id, m.kick, q.part, q.gross, CASE WHEN gh > ga THEN p1 - 1 ELSE -1.0 END AS profit FROM quotes q JOIN matches m USING (match_id)), path AS (SELECT *, 100000 + sum(profit) OVER w AS balance FROM bets WINDOW w AS (PARTITION BY bookmaker ORDER BY kick, match_id, part, gross ROWS UNBOUNDED PRECEDING)), dd AS (SELECT *, balance / greatest(100000, max(balance) OVER (PARTITION BY bookmaker ORDER BY kick, match_id, part, gross ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown, lag(balance, 1, 100000) OVER (PARTITION BY bookmaker ORDER BY kick, match_id, part, gross) AS before FROM path)"


def flat_path(spark: SparkSession, sf: str) -> DataFrame:
    m = matches(spark, sf).select("match_id", "kick", "gh", "ga")
    bets = quotes(spark, sf).select("match_id", "bookmaker", "p1", "part", "gross").join(m, "match_id").select("bookmaker", "match_id", "kick", "part", "gross", F.when(F.col("gh") > F.col("ga"), F.col("p1") - 1).otherwise(-1.0).alias("profit"))
    return ledger.running_balance(bets, ["bookmaker"], ["kick", "match_id", "part", "gross"], "profit", 100_000.0)


@R.query("path_metrics", f"WITH {BETS_SQL} SELECT bookmaker, count(*) AS bets, round(arg_max(balance, row(kick, match_id, part, gross)), 2) AS final_balance, round(arg_max(balance, row(kick, match_id, part, gross)) / 100000 - 1, 7) AS total_return, round(min(drawdown), 6) AS max_drawdown, round(stddev_pop(balance / before - 1), 6) AS volatility, round(avg(CAST(balance > before AS INT)), 6) AS win_rate FROM dd GROUP BY 1")
def path_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = ledger.path_metrics(flat_path(spark, sf), ["bookmaker"], ["kick", "match_id", "part", "gross"], 100_000.0)
    return d.select("bookmaker", "bets", F.round("final_balance", 2).alias("final_balance"), F.round("total_return", 7).alias("total_return"), *[F.round(c, 6).alias(c) for c in ("max_drawdown", "volatility", "win_rate")])


@R.query("simulated_paths")
def simulated_paths(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.summarise_paths(ledger.simulate_paths(spark, 400, 200, 0.5, 2.05))


@R.query("positions_as_of", f"WITH {WAGERS_SQL} SELECT wallet, market, round(sum(CASE WHEN side = 'buy' THEN size ELSE -size END), 4) AS net_size, count(*) AS n_trades, max(t_at) AS last_at FROM wagers WHERE t_at < TIMESTAMP '2024-01-15' GROUP BY 1, 2")
def positions_as_of(spark: SparkSession, sf: str) -> DataFrame:
    p = ledger.positions_as_of(wagers(spark, sf), ["wallet", "market"], "at", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.col("side"), "size")
    return p.withColumn("net_size", F.round("net_size", 4))


STATS_SQL = f"WITH {WAGERS_SQL}, w AS (SELECT wagers.*, s.won, s.resolved_at < TIMESTAMP '2024-01-15' AS done FROM wagers LEFT JOIN settled s USING (market) WHERE t_at < TIMESTAMP '2024-01-15') SELECT wallet, count(*) AS n, round(sum(price * size), 4) AS volume, count(*) FILTER (done) AS n_resolved, round(sum((CASE WHEN side = 'buy' THEN 1 ELSE -1 END) * (CAST(won AS INT) - price) * size) FILTER (done), 4) AS realised, round(avg(CAST((CASE WHEN side = 'buy' THEN 1 ELSE -1 END) * (CAST(won AS INT) - price) * size > 0 AS INT)) FILTER (done), 6) AS win_rate FROM w GROUP BY 1"


def wallet_stats(spark: SparkSession, sf: str) -> DataFrame:
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    t = wagers(spark, sf).where(F.col("at") < at).join(settled(spark, sf).select("market", "won", (F.col("resolved_at") < at).alias("done")), "market", "left")
    profit = F.when(F.col("done"), ledger.settled_profit(F.col("side"), F.col("price"), F.col("size"), F.col("won")))
    return t.groupBy("wallet").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("price") * F.col("size")), 4).alias("volume"), F.count_if("done").alias("n_resolved"), F.round(F.sum(profit), 4).alias("realised"), F.round(F.avg((profit > 0).cast("double")), 6).alias("win_rate"))


@R.query("wallet_stats_as_of", STATS_SQL)
def wallet_stats_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return wallet_stats(spark, sf)


@R.query("top_wallets", f"SELECT wallet, realised FROM ({STATS_SQL}) WHERE n_resolved >= 5 AND realised IS NOT NULL ORDER BY realised DESC, wallet LIMIT 20")
def top_wallets(spark: SparkSession, sf: str) -> DataFrame:
    """A top-20 report: the limit is the feature."""
    return wallet_stats(spark, sf).where("n_resolved >= 5 and realised is not null").select("wallet", "realised").orderBy(F.col("realised").desc(), "wallet").limit(20)
