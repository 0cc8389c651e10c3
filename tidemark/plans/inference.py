"""Queries on resampling, walk-forward fits and tables of forecasts against prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import odds, scoring
from tidemark.operators import calibration, ranks, resampling
from tidemark.plans import registry
from tidemark.plans.adapters import QUOTES_SQL, matches, quotes
from tidemark.plans.forecasts import LONG_SQL, OVER_SQL, dyadic_slope, long_quotes, overs
from tidemark.plans.history import LEAD, rounded
from tidemark.plans.models import market, market_sql, scored

R = registry.new()
#: Hours of a refit period of walk-forward fits: four weeks.
PERIOD = 24 * 28

# -- resampling ----------------------------------------------------------------------------------------


def errors(spark: SparkSession, sf: str) -> DataFrame:
    """match_id, league, p, y, favoured, bias, miss of every forecast of more than 2 goals."""
    o = overs(spark, sf).where("p is not null")
    return o.select("match_id", "league", "p", "y", "lam", "mu", (F.col("lam") > F.col("mu")).alias("favoured"), (F.col("p") - F.col("y")).alias("bias"), F.abs(F.col("p") - F.col("y")).alias("miss"))


@R.query("bootstrap_two_sample")
def bootstrap_two_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Absolute error where the home side is favoured against where it is not."""
    return resampling.bootstrap_difference(errors(spark, sf), "league", "miss", F.col("favoured"), "match_id")


@R.query("bootstrap_correlations")
def bootstrap_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.bootstrap_correlation(errors(spark, sf), "league", "p", "y", "match_id")


@R.query("bootstrap_correlation_gap")
def bootstrap_correlation_gap(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.bootstrap_correlation_difference(errors(spark, sf), "league", "p", "y", F.col("favoured"), "match_id")


@R.query("permuted_correlation_gap")
def permuted_correlation_gap(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.permutation_correlation_difference(errors(spark, sf), "league", "p", "y", F.col("favoured"), "match_id")


@R.query("paired_model_tests")
def paired_model_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score of every model less the market's on the same matches: mean difference, t, p, and Holm's decision over the models."""
    s = scored(spark, sf)
    per = s.groupBy("match_id").agg(F.max(F.when(F.col("model") == "market", F.col("brier"))).alias("base"), F.collect_list(F.struct("model", "brier")).alias("all"))
    d = per.where("base is not null").select("base", F.explode("all").alias("x")).where("x.model <> 'market'").select("x.model", (F.col("x.brier") - F.col("base")).alias("d"))
    return resampling.holm(resampling.paired_t(d, "model", "d"), "p_value", "grp").withColumnRenamed("grp", "model")


@R.query("dependence_power")
def dependence_power(spark: SparkSession, sf: str) -> DataFrame:
    """Power of the correlation of forecasts and outcomes when matches that share a team depend on each other."""
    o = overs(spark, sf).where("p is not null")
    spread = o.agg(F.var_pop("p") / F.var_pop(F.col("y").cast("double"))).scalar()
    d = dyadic_slope(spark, sf)
    return resampling.power_report(d.select("n", "r", (F.col("slope_variance") * spread).alias("r_variance")))


# -- walk-forward fits ---------------------------------------------------------------------------------


def covariates(spark: SparkSession, sf: str) -> DataFrame:
    """Every forecast with its logit and the difference of expected goals as a covariate."""
    o = overs(spark, sf).where("p is not null")
    return o.withColumns({"lp": scoring.logit(F.col("p")), "gap": F.round(F.col("lam") - F.col("mu"), 6)})


def walked(spark: SparkSession, sf: str, x: list[str], offset: str | None = None) -> DataFrame:
    return calibration.walk_forward_logistic(covariates(spark, sf), "league", "at", PERIOD, x, "y", "match_id", offset)


@R.query("walk_forward_recalibrated")
def walk_forward_recalibrated(spark: SparkSession, sf: str) -> DataFrame:
    """Each forecast recalibrated by the fit on all earlier periods."""
    return walked(spark, sf, ["lp"]).withColumnRenamed("id", "match_id")


@R.query("walk_forward_gain")
def walk_forward_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Brier scores of the plain forecast, the recalibrated one, and with a covariate, once free and once on the forecast as offset."""
    base = covariates(spark, sf).select("match_id", "league", "p", "y")
    for name, x, offset in (("recalibrated", ["lp"], None), ("with_gap", ["lp", "gap"], None), ("on_offset", ["gap"], "lp")):
        base = base.join(walked(spark, sf, x, offset).select(F.col("id").alias("match_id"), F.col("p").alias(name)), "match_id")
    both = base.where("recalibrated is not null and with_gap is not null and on_offset is not null")
    score = lambda c: F.avg(scoring.binary_brier(F.col(c), F.col("y")))
    return rounded(both.groupBy("league").agg(F.count(F.lit(1)).alias("n"), *[score(c).alias(c) for c in ("p", "recalibrated", "with_gap", "on_offset")]))


@R.query("isotonic_on_later")
def isotonic_on_later(spark: SparkSession, sf: str) -> DataFrame:
    """Curves fitted on the earlier 70 % of each league, read on its later rows: scores before and after."""
    s = calibration.chronological_split(overs(spark, sf).where("p is not null"), ["league"], ["at", "match_id"])
    curve = calibration.isotonic_curve(s.where("split <> 'test'"), "league", "p", "y")
    t = calibration.apply_isotonic(s.where("split = 'test'").select("match_id", "league", "p", "y"), curve, "league", "p")
    score = lambda f, c: F.avg(f(F.col(c), F.col("y")))
    return rounded(t.groupBy("league").agg(F.count(F.lit(1)).alias("n"), *[score(f, c).alias(f"{n}_{c}") for n, f in (("brier", scoring.binary_brier), ("log_loss", scoring.binary_log_loss)) for c in ("p", "calibrated")]))


# -- tables against the market -------------------------------------------------------------------------

CATEGORY = "count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y, round(avg(p - y), 6) + 0.0 AS bias, round(avg(p - y) - 1.959963984540054 * stddev_samp(p - y) / sqrt(count(*)), 6) + 0.0 AS low, round(avg(p - y) + 1.959963984540054 * stddev_samp(p - y) / sqrt(count(*)), 6) + 0.0 AS high, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(greatest(p, 1e-12)) + (1 - y) * ln(greatest(1 - p, 1e-12)))), 6) AS log_loss"
GAPS_SQL = f"{OVER_SQL}, {QUOTES_SQL}, {market_sql('mk', f'm.kick - {LEAD}')}, gp AS (SELECT ov.match_id, ov.league, ov.p, ov.y, round(mk.home / (mk.home + mk.away), 6) AS q, round(1 / mk.home, 6) AS fair, mk.p1 AS price FROM ov JOIN mk USING (match_id) WHERE p IS NOT NULL)"


def against_market(spark: SparkSession, sf: str) -> DataFrame:
    """match_id, league, p, y with the market's two-way share q, its fair price and the price quoted."""
    mk = market(spark, sf, LEAD)
    h, a = F.get("market", F.lit(0)), F.get("market", F.lit(2))
    q = mk.select("match_id", F.round(h / (h + a), 6).alias("q"), F.round(1 / h, 6).alias("fair"), F.get("prices", F.lit(0)).alias("price"))
    return overs(spark, sf).where("p is not null").select("match_id", "league", "p", "y").join(q, "match_id")


def by_edges(x: Column, edges: list[float]) -> Column:
    return scoring.left_closed_bin(x, edges)


def case(x: str, edges: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {e} THEN {i}" for i, e in enumerate(edges)) + f" WHEN {x} IS NOT NULL THEN {len(edges)} END"


GAP_EDGES, ZONE_EDGES, PRICE_EDGES = [-0.2, -0.1, -0.05, 0.05, 0.1, 0.2], [0.05, 0.1, 0.2, 0.3], [5.0, 10.0, 20.0, 50.0]


@R.query("gap_table", f"WITH {GAPS_SQL} SELECT {case('round(p - q, 6)', GAP_EDGES)} AS gap_bin, {CATEGORY} FROM gp GROUP BY 1")
def gap_table(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration by how far the forecast lies above or below the market."""
    d = against_market(spark, sf)
    return rounded(calibration.category_table(d.withColumn("gap_bin", by_edges(F.round(F.col("p") - F.col("q"), 6), GAP_EDGES)), "gap_bin", "p", "y"))


@R.query("agreement_zones", f"WITH {GAPS_SQL}, z AS (SELECT *, {case('round(abs(p - q), 6)', ZONE_EDGES)} AS zone FROM gp) SELECT zone, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS model_brier, round(avg(pow(q - y, 2)), 6) AS market_brier, round(avg(pow(p - y, 2) - pow(q - y, 2)), 6) + 0.0 AS difference, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM z GROUP BY 1")
def agreement_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Model and market scores by how far they disagree, with each zone's share of the rows."""
    d = against_market(spark, sf).withColumn("zone", by_edges(F.round(F.abs(F.col("p") - F.col("q")), 6), ZONE_EDGES))
    a, b = scoring.binary_brier(F.col("p"), F.col("y")), scoring.binary_brier(F.col("q"), F.col("y"))
    g = d.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("model_brier"), F.avg(b).alias("market_brier"), F.avg(a - b).alias("difference"))
    return rounded(g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


@R.query("bias_asymmetry", f"WITH {GAPS_SQL} SELECT league, count(*) FILTER (p > q) AS above, count(*) FILTER (p < q) AS below, round(avg(p - y) FILTER (p > q), 6) + 0.0 AS bias_above, round(avg(p - y) FILTER (p < q), 6) + 0.0 AS bias_below, round(avg(p - y) FILTER (p > q) - avg(p - y) FILTER (p < q), 6) + 0.0 AS asymmetry FROM gp GROUP BY 1")
def bias_asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    d = against_market(spark, sf)
    up, down = F.col("p") > F.col("q"), F.col("p") < F.col("q")
    bias = lambda c: F.avg(F.when(c, F.col("p") - F.col("y")))
    return rounded(d.groupBy("league").agg(F.count_if(up).alias("above"), F.count_if(down).alias("below"), bias(up).alias("bias_above"), bias(down).alias("bias_below"), (bias(up) - bias(down)).alias("asymmetry")))


@R.query("price_gap_table", f"WITH {GAPS_SQL}, d AS (SELECT *, round(abs(price - 1 / p) / (1 / p) * 100, 6) AS pct FROM gp WHERE p > 0) SELECT {case('pct', PRICE_EDGES)} AS price_bin, round(avg(pct), 4) AS mean_pct, {CATEGORY} FROM d GROUP BY 1")
def price_gap_table(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration by how many percent the price quoted lies off the forecast's fair price."""
    fair = odds.fair_price(F.col("p"))
    d = against_market(spark, sf).where("p > 0").withColumn("pct", F.round(F.abs(F.col("price") - fair) / fair * 100, 6)).withColumn("price_bin", by_edges(F.col("pct"), PRICE_EDGES))
    mean = d.groupBy("price_bin").agg(F.round(F.avg("pct"), 4).alias("mean_pct"))
    return rounded(calibration.category_table(d, "price_bin", "p", "y").join(mean, "price_bin"))


@R.query("market_deciles", f"WITH {GAPS_SQL}, e AS (SELECT quantile_cont(q, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM gp) SELECT CAST(len(list_filter(e, lambda x: x < q)) AS INT) AS part, {CATEGORY} FROM gp, e GROUP BY 1")
def market_deciles(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration by deciles of the market's share."""
    return rounded(calibration.category_table(calibration.quantile_bin(against_market(spark, sf), "q", 10), "part", "p", "y"))


@R.query("favourite_quintiles", f"WITH {GAPS_SQL}, f AS (SELECT match_id, greatest(p, 1 - p) AS p, CASE WHEN p >= 0.5 THEN y ELSE 1 - y END AS y FROM gp), e AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS e FROM f) SELECT CAST(len(list_filter(e, lambda x: x < p)) AS INT) AS part, {CATEGORY} FROM f, e GROUP BY 1")
def favourite_quintiles(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration of the likelier side, by fifths of its probability."""
    d = against_market(spark, sf)
    f = d.select("match_id", F.greatest(F.col("p"), 1 - F.col("p")).alias("p"), F.when(F.col("p") >= 0.5, F.col("y")).otherwise(1 - F.col("y")).alias("y"))
    return rounded(calibration.category_table(calibration.quantile_bin(f, "p", 5), "part", "p", "y"))


@R.query("information_beyond_market", f"WITH {GAPS_SQL}, e AS (SELECT quantile_cont(q, [0.2, 0.4, 0.6, 0.8]) AS e FROM gp), b AS (SELECT CAST(len(list_filter(e, lambda x: x < q)) AS INT) AS part, p, y FROM gp, e), c AS (SELECT *, avg(p) OVER (PARTITION BY part) AS mp FROM b) SELECT part, count(*) FILTER (p > mp) AS high_n, count(*) FILTER (p <= mp) AS low_n, round(avg(y) FILTER (p > mp), 6) AS high_rate, round(avg(y) FILTER (p <= mp), 6) AS low_rate, round(avg(y) FILTER (p > mp) - avg(y) FILTER (p <= mp), 6) + 0.0 AS difference FROM c GROUP BY 1")
def information_beyond_market(spark: SparkSession, sf: str) -> DataFrame:
    """Inside each fifth of the market's share: outcome rates where the forecast lies above the fifth's mean against the rest."""
    b = calibration.quantile_bin(against_market(spark, sf), "q", 5).select("part", "p", "y")
    means = b.groupBy("part").agg(F.avg("p").alias("mp"))
    c = b.join(means, "part")
    high = F.col("p") > F.col("mp")
    rate = lambda t: F.avg(F.when(t, F.col("y").cast("double")))
    return rounded(c.groupBy("part").agg(F.count_if(high).alias("high_n"), F.count_if(~high).alias("low_n"), rate(high).alias("high_rate"), rate(~high).alias("low_rate"), (rate(high) - rate(~high)).alias("difference")))


DISPERSED_SQL = f"{OVER_SQL}, {QUOTES_SQL}, {LONG_SQL}, cs AS (SELECT match_id, round(stddev_samp(fair), 6) AS sd, round(max(fair) - min(fair), 6) AS spread FROM nq WHERE sel = 1 GROUP BY 1 HAVING count(*) >= 2), dp AS (SELECT ov.p, ov.y, sd, spread FROM ov JOIN cs USING (match_id) WHERE p IS NOT NULL)"
SD_EDGES, SPREAD_EDGES = [0.05, 0.1, 0.15, 0.2], [0.1, 0.2, 0.3, 0.4]


def dispersed(spark: SparkSession, sf: str) -> DataFrame:
    cs = long_quotes(spark, sf).where("sel = 1").groupBy("match_id").agg(F.count(F.lit(1)).alias("k"), F.round(F.stddev_samp("fair"), 6).alias("sd"), F.round(F.max("fair") - F.min("fair"), 6).alias("spread")).where("k >= 2")
    return overs(spark, sf).where("p is not null").select("match_id", "p", "y").join(cs, "match_id")


@R.query("dispersion_table", f"WITH {DISPERSED_SQL} SELECT {case('sd', SD_EDGES)} AS dispersion, {CATEGORY} FROM dp GROUP BY 1")
def dispersion_table(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration by how far the bookmakers' shares of a match spread (standard deviation)."""
    return rounded(calibration.category_table(dispersed(spark, sf).withColumn("dispersion", by_edges(F.col("sd"), SD_EDGES)), "dispersion", "p", "y"))


@R.query("spread_table", f"WITH {DISPERSED_SQL} SELECT {case('spread', SPREAD_EDGES)} AS spread_bin, {CATEGORY} FROM dp GROUP BY 1")
def spread_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(calibration.category_table(dispersed(spark, sf).withColumn("spread_bin", by_edges(F.col("spread"), SPREAD_EDGES)), "spread_bin", "p", "y"))


MOVE_EDGES = [0.02, 0.05, 0.1, 0.2]
MOVED_SQL = f"{OVER_SQL}, {QUOTES_SQL}, {LONG_SQL}, oc AS (SELECT match_id, round(arg_min(fair, row(known, bookmaker, price, fair)), 6) AS o, round(arg_max(fair, row(known, bookmaker, price, fair)), 6) AS c FROM nq WHERE sel = 1 GROUP BY 1), mv AS (SELECT m.match_id, o, c, CAST(gh > ga AS INT) AS y FROM oc JOIN matches m USING (match_id))"


@R.query("movement_table", f"WITH {MOVED_SQL} SELECT {case('round(abs(c - o), 6)', MOVE_EDGES)} AS amplitude, count(*) AS n, round(avg(pow(o - y, 2)), 6) AS open_brier, round(avg(pow(c - y, 2)), 6) AS close_brier, round(avg(pow(c - y, 2) - pow(o - y, 2)), 6) + 0.0 AS difference, count(*) FILTER (c > o) AS risen, round(avg(y) FILTER (c > o), 6) AS rate_risen, round(avg(y) FILTER (c < o), 6) AS rate_fallen FROM mv GROUP BY 1")
def movement_table(spark: SparkSession, sf: str) -> DataFrame:
    """First and last shares of the home side by how far they moved, and how often it won after a rise or a fall."""
    at = F.struct("known", "bookmaker", "price", "fair")
    oc = long_quotes(spark, sf).where("sel = 1").groupBy("match_id").agg(F.round(F.min_by("fair", at), 6).alias("o"), F.round(F.max_by("fair", at), 6).alias("c"))
    d = oc.join(matches(spark, sf).select("match_id", (F.col("gh") > F.col("ga")).cast("int").alias("y")), "match_id")
    o, c, y = F.col("o"), F.col("c"), F.col("y")
    a, b = scoring.binary_brier(o, y), scoring.binary_brier(c, y)
    rate = lambda t: F.avg(F.when(t, y.cast("double")))
    return rounded(d.groupBy(by_edges(F.round(F.abs(c - o), 6), MOVE_EDGES).alias("amplitude")).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("open_brier"), F.avg(b).alias("close_brier"), F.avg(b - a).alias("difference"), F.count_if(c > o).alias("risen"), rate(c > o).alias("rate_risen"), rate(c < o).alias("rate_fallen")))


@R.query("quoter_report", f"WITH {OVER_SQL}, {QUOTES_SQL}, h AS (SELECT bookmaker, match_id, 1 / p1 + 1 / p2 + 1 / p3 - 1 AS hold FROM quotes) SELECT bookmaker, count(DISTINCT match_id) AS matches, round(count(DISTINCT match_id) / (SELECT count(*) FROM matches), 6) AS coverage, round(avg(hold), 6) AS mean_hold, round(median(hold), 6) AS median_hold, round(min(hold), 6) AS least_hold, round(max(hold), 6) AS most_hold FROM h GROUP BY 1")
def quoter_report(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage and margins per bookmaker."""
    q = quotes(spark, sf).select("bookmaker", "match_id", odds.hold([F.col(c) for c in ("p1", "p2", "p3")]).alias("hold"))
    total = matches(spark, sf).agg(F.count(F.lit(1))).scalar()
    n = F.count_distinct("match_id")
    g = q.groupBy("bookmaker").agg(n.alias("matches"), F.avg("hold").alias("mean_hold"), F.median("hold").alias("median_hold"), F.min("hold").alias("least_hold"), F.max("hold").alias("most_hold"))
    return rounded(g.withColumn("coverage", F.col("matches") / total))


@R.query("best_quoters", f"WITH {OVER_SQL}, {QUOTES_SQL}, {LONG_SQL}, b AS (SELECT match_id, sel, max(row(price, -bookmaker)) AS b FROM nq GROUP BY 1, 2) SELECT match_id, CAST(sel AS INT) AS sel, b[1] AS price, -b[2] AS bookmaker FROM b")
def best_quoters(spark: SparkSession, sf: str) -> DataFrame:
    """The best price of each selection and who quotes it; ties go to the lesser bookmaker."""
    b = long_quotes(spark, sf).groupBy("match_id", "sel").agg(F.max(F.struct("price", (-F.col("bookmaker")).alias("b"))).alias("b"))
    return b.select("match_id", "sel", F.col("b.price").alias("price"), (-F.col("b.b")).alias("bookmaker"))


@R.query("model_against_consensus", f"WITH {OVER_SQL}, {QUOTES_SQL}, {LONG_SQL}, c AS (SELECT match_id, avg(fair) AS mean, count(*) AS k FROM nq WHERE sel = 1 GROUP BY 1), d AS (SELECT round(p - mean, 6) AS gap, k FROM ov JOIN c USING (match_id) WHERE p IS NOT NULL) SELECT CASE WHEN k < 2 THEN 'none' WHEN abs(gap) >= 0.10 THEN 'strong' WHEN abs(gap) >= 0.05 THEN 'weak' ELSE 'normal' END AS class, CASE WHEN gap > 0 THEN 'above' WHEN gap < 0 THEN 'below' ELSE 'equal' END AS direction, count(*) AS n, round(avg(gap), 6) + 0.0 AS mean_gap, round(median(gap), 6) + 0.0 AS median_gap FROM d GROUP BY 1, 2")
def model_against_consensus(spark: SparkSession, sf: str) -> DataFrame:
    c = long_quotes(spark, sf).where("sel = 1").groupBy("match_id").agg(F.avg("fair").alias("mean"), F.count(F.lit(1)).alias("k"))
    d = overs(spark, sf).where("p is not null").join(c, "match_id").select(F.round(F.col("p") - F.col("mean"), 6).alias("gap"), "k")
    label = F.when(F.col("k") < 2, "none").when(F.abs("gap") >= 0.10, "strong").when(F.abs("gap") >= 0.05, "weak").otherwise("normal")
    side = F.when(F.col("gap") > 0, "above").when(F.col("gap") < 0, "below").otherwise("equal")
    return rounded(d.groupBy(label.alias("class"), side.alias("direction")).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap")))


@R.query("forecast_spread", f"WITH {OVER_SQL}, e AS (SELECT round(lam + mu, 6) AS x FROM ov WHERE p IS NOT NULL) SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(stddev_samp(x) / avg(x), 6) AS variation, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM e")
def forecast_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of the expected totals; quartiles from counts per value, range by range."""
    e = overs(spark, sf).where("p is not null").select(F.round(F.col("lam") + F.col("mu"), 6).alias("x"))
    q = ranks.quantiles(e, "x", [0.25, 0.5, 0.75])
    a = e.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    return rounded(a.select("n", "mean", "sd", (F.col("sd") / F.col("mean")).alias("variation"), *[c.alias(n) for n, c in zip(("q25", "q50", "q75"), q, strict=True)], (q[2] - q[0]).alias("iqr")))


@R.query("total_frequencies", f"WITH {OVER_SQL}, f AS (SELECT league, least(gh + ga, 6) AS total, count(*) AS n FROM matches GROUP BY 1, 2), m AS (SELECT league, avg(gh + ga) AS mean FROM matches GROUP BY 1) SELECT league, total, n, round(n / sum(n) OVER (PARTITION BY league), 6) AS share, round(CASE WHEN total < 6 THEN exp(-mean) * pow(mean, total) / factorial(CAST(total AS INT)) ELSE 1 - exp(-mean) * (1 + mean + pow(mean, 2) / 2 + pow(mean, 3) / 6 + pow(mean, 4) / 24 + pow(mean, 5) / 120) END, 6) AS poisson FROM f JOIN m USING (league)")
def total_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of totals (6 and more together) beside a Poisson of the same mean."""
    m = matches(spark, sf).select("league", (F.col("gh") + F.col("ga")).alias("t"))
    f = m.groupBy("league", F.least("t", F.lit(6)).cast("long").alias("total")).agg(F.count(F.lit(1)).alias("n"))
    means = m.groupBy("league").agg(F.avg("t").alias("mean"))
    mean = F.col("mean")
    one = lambda k: F.exp(-mean) * F.pow(mean, k) / F.factorial(k.cast("int"))
    tail = 1 - sum((one(F.lit(k)) for k in range(1, 6)), one(F.lit(0)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("league"))
    return rounded(f.join(means, "league").select("league", "total", "n", share.alias("share"), F.when(F.col("total") < 6, one(F.col("total"))).otherwise(tail).alias("poisson")))
