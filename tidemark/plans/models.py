"""Queries on outcome models: walk-forward forecasts beside the market, fits at one time, and value against prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import grid, odds, scoring
from tidemark.operators import models, pit, strength
from tidemark.plans import registry
from tidemark.plans.adapters import MATCHES_SQL, QUOTES_SQL, matches, quotes
from tidemark.plans.history import AT, LEAD, TEAM_SQL, predictions, rated, rounded, strength_sql

R = registry.new()
#: Weights of the blends, the low-score correlation shown, and the lead of decisions that take a price.
MET_WEIGHT, HALF, RHO, PRICE_LEAD = 0.1, 0.5, -0.05, 24


def rates_sql(tag: str, scored: str, conceded: str, known: str, lag: int = LEAD) -> str:
    """Common tables r{tag} (match_id, league, home, away, t_at, gh, ga, lam, mu) and o{tag} (match_id, home, draw, away), given matches."""
    t = tag
    ratio = lambda n, s: f"(CASE WHEN {n} > 0 THEN greatest({s} / {n} / greatest(base, 1e-9), 1e-9) ELSE 1 END)"
    return f"""
lf{t} AS (SELECT league, home AS team, {known} AS known, {scored} AS s, {conceded} AS c FROM matches UNION ALL SELECT league, away, {known}, {conceded}, {scored} FROM matches),
tc{t} AS (SELECT league, team, known, sum(sum(s)) OVER w AS s, sum(sum(c)) OVER w AS c, sum(count(*)) OVER w AS n FROM lf{t} GROUP BY league, team, known WINDOW w AS (PARTITION BY league, team ORDER BY known)),
lc{t} AS (SELECT league, {known} AS known, sum(sum({scored})) OVER w AS h, sum(sum({conceded})) OVER w AS a, sum(count(*)) OVER w AS n FROM matches GROUP BY league, {known} WINDOW w AS (PARTITION BY league ORDER BY {known})),
d{t} AS (SELECT match_id, league, home, away, kick, kick - {lag} AS t_at, gh, ga FROM matches),
j{t} AS (SELECT d{t}.*, l.h, l.a, coalesce(l.n, 0) AS n, x.s AS hs, x.c AS hc, coalesce(x.n, 0) AS hn, y.s AS vs, y.c AS vc, coalesce(y.n, 0) AS vn
  FROM d{t} ASOF LEFT JOIN lc{t} l ON d{t}.league = l.league AND d{t}.t_at >= l.known ASOF LEFT JOIN tc{t} x ON d{t}.league = x.league AND d{t}.home = x.team AND d{t}.t_at >= x.known ASOF LEFT JOIN tc{t} y ON d{t}.league = y.league AND d{t}.away = y.team AND d{t}.t_at >= y.known),
k{t} AS (SELECT *, CASE WHEN n > 0 THEN greatest((h + a) / (2.0 * n), 1e-9) END AS base, CASE WHEN a > 0 THEN greatest(h / a, 1e-9) ELSE 1 END AS hfa FROM j{t}),
r{t} AS (SELECT match_id, league, home, away, kick, t_at, gh, ga, base * {ratio('hn', 'hs')} * {ratio('vn', 'vc')} * hfa AS lam, base * {ratio('vn', 'vs')} * {ratio('hn', 'hc')} AS mu FROM k{t}),
{cells_sql(t)}"""


def cells_sql(t: str, rho: float | None = None, out: str | None = None) -> str:
    """Common table o{out} with the scaled outcome shares of the rates in r{t}."""
    factor = f"* CASE WHEN i.i = 0 AND j.j = 0 THEN 1 - lam * mu * {rho} WHEN i.i = 0 AND j.j = 1 THEN 1 + lam * {rho} WHEN i.i = 1 AND j.j = 0 THEN 1 + mu * {rho} WHEN i.i = 1 AND j.j = 1 THEN 1 - {rho} ELSE 1 END" if rho is not None else ""
    name = out or t
    return f"""g{name} AS (SELECT match_id, i.i, j.j, exp(-lam) * pow(lam, i.i) / factorial(CAST(i.i AS INT)) * exp(-mu) * pow(mu, j.j) / factorial(CAST(j.j AS INT)) {factor} AS p FROM r{t}, range(0, 21) i(i), range(0, 21) j(j) WHERE lam IS NOT NULL),
o{name} AS (SELECT match_id, sum(p) FILTER (i > j) / nullif(sum(p), 0) AS home, sum(p) FILTER (i = j) / nullif(sum(p), 0) AS draw, sum(p) FILTER (i < j) / nullif(sum(p), 0) AS away FROM g{name} GROUP BY 1)"""


def market_sql(name: str, at: str) -> str:
    """Common table {name}: the last quote of each match at or before `at`, prices and shares without margin."""
    return f"{name} AS (SELECT q.match_id, q.p1, q.p2, q.p3, 1 / p1 / (1 / p1 + 1 / p2 + 1 / p3) AS home, 1 / p2 / (1 / p1 + 1 / p2 + 1 / p3) AS draw, 1 / p3 / (1 / p1 + 1 / p2 + 1 / p3) AS away FROM quotes q JOIN matches m USING (match_id) WHERE q.known <= {at} QUALIFY row_number() OVER (PARTITION BY q.match_id ORDER BY q.known DESC, q.bookmaker DESC, q.part DESC, q.gross DESC) = 1)"


def market(spark: SparkSession, sf: str, lead: int) -> DataFrame:
    """match_id, prices and shares (arrays) of the last quote `lead` hours before kick-off or earlier."""
    prices = [F.col(c) for c in ("p1", "p2", "p3")]
    q = quotes(spark, sf).join(matches(spark, sf).select("match_id", "kick"), "match_id").where(F.col("known") <= F.col("kick") - lead)
    last = q.groupBy("match_id").agg(F.max(F.struct("known", "bookmaker", "part", "gross", "p1", "p2", "p3")).alias("q")).select("match_id", "q.*")
    return last.select("match_id", F.array(*prices).alias("prices"), F.array(*odds.without_margin(prices)).alias("market"))


MODELS_SQL = f"""{MATCHES_SQL}, {QUOTES_SQL}, {rates_sql('g', 'gh', 'ga', 'known')}, {rates_sql('x', 'xh', 'xa', 'xg_known')}, {cells_sql('g', RHO, 'c')},
nc AS (SELECT league, known, sum(count(*) FILTER (gh > ga)) OVER w AS h, sum(count(*) FILTER (gh = ga)) OVER w AS d, sum(count(*) FILTER (gh < ga)) OVER w AS a, sum(count(*)) OVER w AS n FROM matches GROUP BY league, known WINDOW w AS (PARTITION BY league ORDER BY known)),
nv AS (SELECT match_id, h / n AS home, d / n AS draw, a / n AS away FROM dg ASOF JOIN nc ON dg.league = nc.league AND dg.t_at >= nc.known),
pm AS (SELECT league, least(home, away) AS lo, greatest(home, away) AS hi, known, max(row(kick, match_id, home, CAST(sign(gh - ga) AS INT))) AS m FROM matches GROUP BY ALL),
pw AS (SELECT league, lo, hi, known, max(m) OVER (PARTITION BY league, lo, hi ORDER BY known) AS m FROM pm),
lm AS (SELECT match_id, CASE WHEN m[3] = home THEN m[4] ELSE -m[4] END AS r FROM (SELECT *, least(home, away) AS lo, greatest(home, away) AS hi FROM dg) b ASOF JOIN pw ON b.league = pw.league AND b.lo = pw.lo AND b.hi = pw.hi AND b.t_at >= pw.known),
tv AS (SELECT og.match_id, (abs(og.home - ox.home) + abs(og.draw - ox.draw) + abs(og.away - ox.away)) / 2 AS w FROM og JOIN ox USING (match_id)),
{market_sql('mk', f'm.kick - {LEAD}')},
ml AS (
  SELECT match_id, 'naive' AS model, home, draw, away FROM nv UNION ALL SELECT match_id, 'goals', home, draw, away FROM og UNION ALL SELECT match_id, 'expected_goals', home, draw, away FROM ox UNION ALL SELECT match_id, 'low_score', home, draw, away FROM oc
  UNION ALL SELECT og.match_id, 'last_meeting', CASE WHEN r IS NULL THEN home ELSE (1 - {MET_WEIGHT}) * home + {MET_WEIGHT} * CAST(r = 1 AS INT) END, CASE WHEN r IS NULL THEN draw ELSE (1 - {MET_WEIGHT}) * draw + {MET_WEIGHT} * CAST(r = 0 AS INT) END, CASE WHEN r IS NULL THEN away ELSE (1 - {MET_WEIGHT}) * away + {MET_WEIGHT} * CAST(r = -1 AS INT) END FROM og LEFT JOIN lm USING (match_id)
  UNION ALL SELECT og.match_id, 'even_blend', (og.home + ox.home) / 2, (og.draw + ox.draw) / 2, (og.away + ox.away) / 2 FROM og JOIN ox USING (match_id)
  UNION ALL SELECT og.match_id, 'gap_blend', (1 - w) * og.home + w * ox.home, (1 - w) * og.draw + w * ox.draw, (1 - w) * og.away + w * ox.away FROM og JOIN ox USING (match_id) JOIN tv USING (match_id)
  UNION ALL SELECT match_id, 'market', home, draw, away FROM mk)"""


def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """match_id, result (0 home, 1 draw, 2 away), model, p (array of three): every model's forecast from what was known at its decision.

    All models of a match lie in one row until the end, so they share the
    sums they are made of.
    """
    m = matches(spark, sf)
    g = rated(spark, sf).select("match_id", "league", "home", "away", "at", "gh", "ga", "lam", "mu")
    d = models.last_meeting_as_of(m, models.outcome_shares_as_of(m, g))
    x = rated(spark, sf, "xh", "xa", "xg_known").select("match_id", F.col("lam").alias("xlam"), F.col("mu").alias("xmu"))
    d = d.join(x, "match_id").join(market(spark, sf, LEAD).select("match_id", "market"), "match_id", "left")
    d = d.withColumns({"goals": models.one_x_two(F.col("lam"), F.col("mu")), "expected_goals": models.one_x_two(F.col("xlam"), F.col("xmu")), "low_score": models.corrected_one_x_two(F.col("lam"), F.col("mu"), F.lit(RHO))})
    goals, xg = F.col("goals"), F.col("expected_goals")
    blends = {
        "last_meeting": F.when(F.col("met").isNull(), goals).otherwise(models.blended(goals, F.col("met"), F.lit(MET_WEIGHT))),
        "even_blend": models.blended(goals, xg, F.lit(HALF)),
        "gap_blend": models.blended(goals, xg, grid.total_variation(goals, xg)),
    }
    names = ["naive", "goals", "expected_goals", "low_score", *blends, "market"]
    long = d.withColumns(blends).select("match_id", models.outcome(F.col("gh"), F.col("ga")).alias("result"), F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("p")) for n in names])).alias("x"))
    return long.select("match_id", "result", "x.*").where("p is not null")


def three(p: str) -> list:
    return [F.get(p, F.lit(i)).alias(n) for i, n in enumerate(models.OUTCOMES)]


@R.query("walk_forward_models", f"WITH {MODELS_SQL} SELECT match_id, model, round(home, 6) AS home, round(draw, 6) AS draw, round(away, 6) AS away FROM ml")
def walk_forward_models(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(walk_forward(spark, sf).select("match_id", "model", *three("p")))


@R.query("model_blend", f"WITH {MODELS_SQL} SELECT match_id, round(w, 6) AS disagreement, round(home, 6) AS home, round(draw, 6) AS draw, round(away, 6) AS away FROM ml JOIN tv USING (match_id) WHERE model = 'gap_blend'")
def model_blend(spark: SparkSession, sf: str) -> DataFrame:
    """1X2 of the goal and the expected-goal model, blended by how far they disagree (total variation)."""
    def triple(df: DataFrame, name: str) -> DataFrame:
        o = grid.outcome_probabilities(grid.pmf(F.col("lam")), grid.pmf(F.col("mu")))
        return df.where("lam is not null").select("match_id", o.alias("o")).select("match_id", F.array("o.home", "o.draw", "o.away").alias(name))

    both = triple(rated(spark, sf), "g").join(triple(rated(spark, sf, "xh", "xa", "xg_known"), "x"), "match_id")
    w = grid.total_variation(F.col("g"), F.col("x"))
    blend = both.withColumn("w", w).withColumn("b", F.zip_with("g", "x", lambda p, q: (1 - F.col("w")) * p + F.col("w") * q))
    return rounded(blend.select("match_id", F.col("w").alias("disagreement"), *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("home", "draw", "away"))]))


SCORED_SQL = f"{MODELS_SQL}, sc AS (SELECT match_id, model, pow(home - CAST(gh > ga AS INT), 2) + pow(draw - CAST(gh = ga AS INT), 2) + pow(away - CAST(gh < ga AS INT), 2) AS brier, -ln(least(greatest(CASE WHEN gh > ga THEN home WHEN gh = ga THEN draw ELSE away END, 1e-12), 1)) AS log_loss FROM ml JOIN (SELECT match_id, gh, ga FROM matches) mm USING (match_id))"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    w = walk_forward(spark, sf)
    p = [F.get("p", F.lit(i)) for i in range(3)]
    return w.select("match_id", "model", scoring.multi_brier(p, F.col("result")).alias("brier"), scoring.multi_log_loss(p, F.col("result")).alias("log_loss"))


@R.query("model_scores", f"WITH {SCORED_SQL} SELECT model, count(*) AS n, round(avg(brier), 6) AS brier, round(avg(log_loss), 6) AS log_loss, round(stddev_samp(brier), 6) AS brier_sd FROM sc GROUP BY 1")
def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss"), F.stddev_samp("brier").alias("brier_sd")))


@R.query("models_against_market", f"WITH {SCORED_SQL}, d AS (SELECT a.model, a.brier - b.brier AS d FROM sc a JOIN sc b ON a.match_id = b.match_id AND b.model = 'market' WHERE a.model <> 'market') SELECT model, count(*) AS n, round(avg(d), 6) AS difference, round(avg(d) - 1.959963984540054 * stddev_samp(d) / sqrt(count(*)), 6) AS low, round(avg(d) + 1.959963984540054 * stddev_samp(d) / sqrt(count(*)), 6) AS high FROM d GROUP BY 1")
def models_against_market(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of Brier scores on the matches that both forecast; all of a match's models meet in one group."""
    s = scored(spark, sf)
    per = s.groupBy("match_id").agg(F.max(F.when(F.col("model") == "market", F.col("brier"))).alias("base"), F.collect_list(F.struct("model", "brier")).alias("all"))
    d = per.where("base is not null").select("base", F.explode("all").alias("x")).select("x.model", (F.col("x.brier") - F.col("base")).alias("d")).where("model <> 'market'")
    half = 1.959963984540054 * F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))
    return rounded(d.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("difference"), (F.avg("d") - half).alias("low"), (F.avg("d") + half).alias("high")))


# -- fits at one time ----------------------------------------------------------------------------------

LEVEL_SQL = f"""{MATCHES_SQL}, {TEAM_SQL}, tr AS (SELECT * FROM matches WHERE known <= {AT}), lv AS (SELECT league, greatest(sum(gh + ga) / (2.0 * count(*)), 1e-9) AS base, CASE WHEN sum(ga) > 0 THEN greatest(sum(gh) / sum(ga), 1e-9) ELSE 1 END AS factor FROM tr GROUP BY 1)"""
STRENGTHS_SQL = f"""{LEVEL_SQL}, ts AS (SELECT l.league, l.team, any_value(base) AS base, any_value(factor) AS factor, greatest(avg(scored) / any_value(base), 1e-9) AS attack, greatest(avg(conceded) / any_value(base), 1e-9) AS defence FROM lf l JOIN lv USING (league) WHERE l.known <= {AT} GROUP BY 1, 2),
hm AS (SELECT m.league, m.home AS team, count(*) AS n_home, avg(m.gh / (h.base * h.attack * v.defence)) AS raw FROM tr m JOIN ts h ON m.league = h.league AND m.home = h.team JOIN ts v ON m.league = v.league AND m.away = v.team GROUP BY 1, 2),
tf AS (SELECT ts.*, coalesce(n_home, 0) AS n_home, coalesce(raw, factor) AS raw_factor, (coalesce(n_home, 0) * coalesce(raw, factor) + 10 * factor) / (coalesce(n_home, 0) + 10) AS home_factor FROM ts LEFT JOIN hm USING (league, team))"""


def training(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).where(F.col("known") <= AT)


@R.query("team_strengths", f"WITH {STRENGTHS_SQL} SELECT league, team, round(attack, 6) AS attack, round(defence, 6) AS defence, round(base, 6) AS base, round(factor, 6) AS factor, n_home, round(raw_factor, 6) AS raw_factor, round(home_factor, 6) AS home_factor FROM tf")
def team_strengths(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.team_strengths(training(spark, sf)))


FIXTURE_SQL = f"fx AS (SELECT match_id, league, home, away FROM matches WHERE kick > {AT})"


def fixtures(spark: SparkSession, sf: str) -> DataFrame:
    return matches(spark, sf).where(F.col("kick") > AT).select("match_id", "league", "home", "away")


def forecast(rates: DataFrame) -> DataFrame:
    return rounded(rates.withColumn("p", models.one_x_two(F.col("lam"), F.col("mu"))).select("match_id", "lam", "mu", *three("p")))


OUT = "SELECT match_id, round(lam, 6) AS lam, round(mu, 6) AS mu, round(home, 6) AS home, round(draw, 6) AS draw, round(away, 6) AS away FROM r{t} JOIN o{t} USING (match_id)"


@R.query("team_factor_forecasts", f"WITH {STRENGTHS_SQL}, {FIXTURE_SQL}, rf AS (SELECT match_id, lv.base * coalesce(h.attack, 1) * coalesce(v.defence, 1) * coalesce(h.home_factor, lv.factor) AS lam, lv.base * coalesce(v.attack, 1) * coalesce(h.defence, 1) AS mu FROM fx JOIN lv USING (league) LEFT JOIN tf h ON fx.league = h.league AND fx.home = h.team LEFT JOIN tf v ON fx.league = v.league AND fx.away = v.team), {cells_sql('f')} {OUT.format(t='f')}")
def team_factor_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Later fixtures under each team's own shrunk home factor."""
    tr = training(spark, sf)
    t = models.team_strengths(tr)
    fx = fixtures(spark, sf)
    own = t.select("league", F.col("team").alias("home"), F.col("home_factor").alias("own"), F.col("factor").alias("_f"))
    r = strength.rates_from(fx, t, strength.league_levels(tr)).join(own, ["league", "home"], "left")
    return forecast(r.withColumn("lam", F.when(F.col("own").isNotNull(), F.col("lam") / F.col("_f") * F.col("own")).otherwise(F.col("lam"))))


@R.query("form_forecasts", f"WITH {LEVEL_SQL}, {FIXTURE_SQL}, rr AS (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY kick DESC, match_id DESC) AS i FROM lf WHERE known <= {AT}), fm AS (SELECT r.league, team, (count(*) FILTER (i <= 5) * greatest(avg(scored) FILTER (i <= 5) / any_value(base), 1e-9) + 3 * greatest(avg(scored) / any_value(base), 1e-9)) / (count(*) FILTER (i <= 5) + 3) AS attack, (count(*) FILTER (i <= 5) * greatest(avg(conceded) FILTER (i <= 5) / any_value(base), 1e-9) + 3 * greatest(avg(conceded) / any_value(base), 1e-9)) / (count(*) FILTER (i <= 5) + 3) AS defence FROM rr r JOIN lv USING (league) GROUP BY 1, 2), rf AS (SELECT match_id, base * coalesce(h.attack, 1) * coalesce(v.defence, 1) * factor AS lam, base * coalesce(v.attack, 1) * coalesce(h.defence, 1) AS mu FROM fx JOIN lv USING (league) LEFT JOIN fm h ON fx.league = h.league AND fx.home = h.team LEFT JOIN fm v ON fx.league = v.league AND fx.away = v.team), {cells_sql('f')} {OUT.format(t='f')}")
def form_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Later fixtures from each team's last five matches."""
    tr = training(spark, sf)
    return forecast(strength.rates_from(fixtures(spark, sf), models.form_strengths(tr, 5, 3.0), strength.league_levels(tr)))


@R.query("gamma_forecasts")
def gamma_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Later fixtures under the sequential gamma model."""
    tr = training(spark, sf)
    return forecast(strength.rates_from(fixtures(spark, sf), strength.sequential_gamma(tr), strength.league_levels(tr)))


@R.query("elo_outcome_bins")
def elo_outcome_bins(spark: SparkSession, sf: str) -> DataFrame:
    tr = training(spark, sf)
    rated_tr = strength.elo_ratings(tr).select("match_id", "league", "expected").join(tr.select("match_id", "gh", "ga"), "match_id")
    return rounded(models.elo_bins(rated_tr))


@R.query("elo_forecasts")
def elo_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Later fixtures: the expected score of the ratings at the time, read in the bins of what came of such scores."""
    tr = training(spark, sf)
    r = strength.elo_ratings(tr).join(tr.select("match_id", "home", "away", "gh", "ga", "kick"), "match_id")
    step = 20.0 * (F.when(F.col("gh") > F.col("ga"), 1.0).when(F.col("gh") == F.col("ga"), 0.5).otherwise(0.0) - F.col("expected"))
    after = r.select("league", F.explode(F.array(F.struct(F.col("home").alias("team"), (F.col("home_before") + step).alias("rating")), F.struct(F.col("away").alias("team"), (F.col("away_before") - step).alias("rating")))).alias("x"), F.struct("kick", "match_id").alias("o"))
    now = after.groupBy("league", "x.team").agg(F.max_by("x.rating", "o").alias("rating"))
    fx = fixtures(spark, sf)
    for side in ("home", "away"):
        fx = fx.join(now.select("league", F.col("team").alias(side), F.col("rating").alias(f"{side}_rating")), ["league", side], "left")
    e = 1 / (1 + F.pow(F.lit(10.0), -(F.coalesce("home_rating", F.lit(1500.0)) + 100 - F.coalesce("away_rating", F.lit(1500.0))) / 400))
    bins = models.elo_bins(r)
    return rounded(models.elo_lookup(fx.select("match_id", "league", e.alias("expected")), bins))


# -- value ---------------------------------------------------------------------------------------------

LINES = (0.5, 1.5, 2.5, 3.5, 4.5)
GOAL_SQL = "g AS (SELECT r.match_id, i.i, j.j, exp(-lam) * pow(lam, i.i) / factorial(CAST(i.i AS INT)) * exp(-mu) * pow(mu, j.j) / factorial(CAST(j.j AS INT)) AS p FROM rated r, range(0, 21) i(i), range(0, 21) j(j) WHERE lam IS NOT NULL)"


@R.query("over_under_lines", f"WITH {strength_sql(LEAD)}, {GOAL_SQL}, o AS (SELECT match_id, unnest([0.5, 1.5, 2.5, 3.5, 4.5]) AS line, unnest([" + ", ".join(f"sum(p) FILTER (i + j > {x}) / nullif(sum(p), 0)" for x in LINES) + "]) AS p FROM g GROUP BY 1) SELECT match_id, line, round(p, 6) + 0.0 AS p_over, CASE WHEN round(p, 6) > 0 THEN round(1 / round(p, 6), 4) ELSE CAST('inf' AS DOUBLE) END AS fair_over, CASE WHEN round(1 - p, 6) > 0 THEN round(1 / round(1 - p, 6), 4) ELSE CAST('inf' AS DOUBLE) END AS fair_under FROM o")
def over_under_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Five total lines per match with their fair prices (infinite for an impossible side)."""
    d = predictions(spark, sf).select("match_id", grid.total_distribution(F.col("h"), F.col("a")).alias("d"))
    rows = d.select("match_id", F.explode(F.array(*[F.struct(F.lit(x).alias("line"), grid.over_probability(F.col("d"), x).alias("p")) for x in LINES])).alias("x")).select("match_id", "x.*")
    fair = lambda p: F.round(odds.fair_price(F.round(p, 6)), 4)
    return rounded(rows.select("match_id", "line", F.col("p").alias("p_over"), fair(F.col("p")).alias("fair_over"), fair(1 - F.col("p")).alias("fair_under")))


VALUE_SQL = f"""{MATCHES_SQL}, {QUOTES_SQL}, {rates_sql('g', 'gh', 'ga', 'known', PRICE_LEAD)}, {market_sql('tk', f'm.kick - {PRICE_LEAD}')}, {market_sql('cl', 'm.kick')},
vl AS (SELECT dg.match_id, dg.league, dg.t_at AS decided, unnest(['home', 'draw', 'away']) AS selection, unnest([og.home, og.draw, og.away]) AS model_p, unnest([tk.home, tk.draw, tk.away]) AS market_p, unnest([tk.p1, tk.p2, tk.p3]) AS price, unnest([cl.home, cl.draw, cl.away]) AS closing_p, unnest([gh > ga, gh = ga, gh < ga]) AS won FROM dg JOIN og USING (match_id) JOIN tk USING (match_id) LEFT JOIN cl USING (match_id)),
va AS (SELECT *, model_p - market_p AS edge, model_p * price - 1 AS ev, (1 / closing_p / price - 1) * 100 AS clv_pct FROM vl)"""


def value_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Per match and selection: model and market share and price at the decision, edge, expected value, closing line value, whether it won."""
    m = matches(spark, sf)
    decisions = m.select("match_id", "league", "home", "away", (F.col("kick") - PRICE_LEAD).alias("at"), "gh", "ga")
    d = strength.strengths_as_of(m, decisions).withColumn("model", models.one_x_two(F.col("lam"), F.col("mu"))).where("model is not null")
    d = d.join(market(spark, sf, PRICE_LEAD), "match_id").join(market(spark, sf, 0).select("match_id", F.col("market").alias("closing")), "match_id", "left")
    result = models.outcome(F.col("gh"), F.col("ga"))
    sel = F.explode(F.array(*[F.struct(F.lit(n).alias("selection"), F.get("model", F.lit(i)).alias("model_p"), F.get("market", F.lit(i)).alias("market_p"), F.get("prices", F.lit(i)).alias("price"), F.get("closing", F.lit(i)).alias("closing_p"), (result == i).alias("won")) for i, n in enumerate(models.OUTCOMES)])).alias("x")
    rows = d.select("match_id", "league", "at", sel).select("match_id", "league", "at", "x.*")
    return rows.withColumns({"edge": F.col("model_p") - F.col("market_p"), "ev": odds.expected_value(F.col("model_p"), F.col("price")), "clv_pct": odds.closing_line_value(F.col("price"), 1 / F.col("closing_p"))})


@R.query("value_log", f"WITH {VALUE_SQL} SELECT match_id, decided, selection, round(model_p, 6) AS model_p, round(market_p, 6) AS market_p, round(price, 6) AS price, round(edge, 6) AS edge, round(ev, 6) AS ev, edge > 0.02 AND ev > 0.05 AS passes, won, round(clv_pct, 4) AS clv_pct FROM va")
def value_log(spark: SparkSession, sf: str) -> DataFrame:
    v = value_rows(spark, sf)
    out = v.select("match_id", F.col("at").alias("decided"), "selection", "model_p", "market_p", "price", "edge", "ev", ((F.col("edge") > 0.02) & (F.col("ev") > 0.05)).alias("passes"), "won", F.round("clv_pct", 4).alias("clv_pct"))
    return rounded(out)


@R.query("value_summary", f"WITH {VALUE_SQL} SELECT league, selection, count(*) AS n, count(*) FILTER (edge > 0.02 AND ev > 0.05) AS passing, round(avg(edge), 6) AS mean_edge, round(stddev_samp(edge), 6) AS sd_edge, round(min(ev), 6) AS least_ev, round(max(ev), 6) AS most_ev, round(avg(clv_pct), 4) AS mean_clv, round(avg(CAST(clv_pct > 0 AS INT)), 6) AS positive_clv, round(sum(CASE WHEN won THEN price - 1 ELSE -1 END) FILTER (edge > 0.02 AND ev > 0.05) / nullif(count(*) FILTER (edge > 0.02 AND ev > 0.05), 0), 6) AS flat_return FROM va GROUP BY 1, 2")
def value_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Edges, expected values, closing line values and the return of flat stakes on what passes, per league and selection."""
    passes = (F.col("edge") > 0.02) & (F.col("ev") > 0.05)
    profit = F.when(passes, F.when(F.col("won"), F.col("price") - 1).otherwise(-1.0))
    g = value_rows(spark, sf).groupBy("league", "selection").agg(F.count(F.lit(1)).alias("n"), F.count_if(passes).alias("passing"), F.avg("edge").alias("mean_edge"), F.stddev_samp("edge").alias("sd_edge"), F.min("ev").alias("least_ev"), F.max("ev").alias("most_ev"), F.round(F.avg("clv_pct"), 4).alias("mean_clv"), F.avg((F.col("clv_pct") > 0).cast("double")).alias("positive_clv"), F.avg(profit).alias("flat_return"))
    return rounded(g)


@R.query("kelly_stakes", f"WITH {VALUE_SQL}, k AS (SELECT *, (model_p * price - 1) / (price - 1) AS f FROM va) SELECT match_id, selection, round(f, 6) AS fraction, round(least(1000 * greatest(f, 0) * 0.25, 0.05 * 1000, 40, 1000), 6) AS stake FROM k")
def kelly_stakes(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter of the growth-optimal fraction of a balance of 1,000, limited to 5 % of it and to 40."""
    f = odds.kelly_fraction(F.col("model_p"), F.col("price"))
    return rounded(value_rows(spark, sf).select("match_id", "selection", f.alias("fraction"), odds.limited_stake(1000 * F.greatest(f, F.lit(0.0)) * 0.25, F.lit(1000.0), 0.05, 40.0).alias("stake")))


@R.query("two_way_comparison", f"WITH {strength_sql(LEAD)}, {GOAL_SQL}, {QUOTES_SQL}, o AS (SELECT match_id, sum(p) FILTER (i + j > 2) / nullif(sum(p), 0) AS p FROM g GROUP BY 1) SELECT match_id, bookmaker, part, round(p, 6) AS model_over, round(1 / p1 / (1 / p1 + 1 / p2), 6) AS market_over, round(p - 1 / p1 / (1 / p1 + 1 / p2), 6) + 0.0 AS edge, round(p - 1 / p1, 6) + 0.0 AS raw_edge, round(1 / p1 + 1 / p2 - 1, 6) + 0.0 AS hold FROM quotes JOIN o USING (match_id)")
def two_way_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """A model's over against every two-way quote: share without margin, edge, raw edge and hold."""
    p = grid.over_probability(grid.total_distribution(F.col("h"), F.col("a")), 2.5)
    q = quotes(spark, sf).join(predictions(spark, sf).select("match_id", p.alias("p")), "match_id")
    two = [F.col("p1"), F.col("p2")]
    share = odds.without_margin(two)[0]
    return rounded(q.select("match_id", "bookmaker", "part", F.col("p").alias("model_over"), share.alias("market_over"), (F.col("p") - share).alias("edge"), (F.col("p") - odds.implied(F.col("p1"))).alias("raw_edge"), odds.hold(two).alias("hold")))


@R.query("overround_methods")
def overround_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Proportional and insider-model shares of the same prices, with z, hold and their greatest difference."""
    from tidemark.plans.forecasts import regional, shin_probabilities

    prices = [F.col(c) for c in ("b365h", "b365d", "b365a")]
    p = regional(spark, sf).where("b365h > 1 and b365d > 1 and b365a > 1").select("match_id", odds.hold(prices).alias("hold"), *[x.alias(f"proportional_{n}") for n, x in zip(models.OUTCOMES, odds.without_margin(prices), strict=True)])
    s = shin_probabilities(spark, sf).select("match_id", "z", *[F.col(n).alias(f"shin_{n}") for n in models.OUTCOMES])
    gap = F.greatest(*[F.abs(F.col(f"proportional_{n}") - F.col(f"shin_{n}")) for n in models.OUTCOMES])
    return rounded(p.join(s, "match_id").withColumn("most_difference", gap))


# -- teams before a match ------------------------------------------------------------------------------

SHOTS_SQL = f"""{MATCHES_SQL}, sl AS (SELECT league, home AS team, xg_known AS known, xh AS f, xa AS g FROM matches UNION ALL SELECT league, away, xg_known, xa, xh FROM matches),
sc AS (SELECT league, team, known, sum(sum(f)) OVER w AS f, sum(sum(g)) OVER w AS g, sum(count(*)) OVER w AS n FROM sl GROUP BY league, team, known WINDOW w AS (PARTITION BY league, team ORDER BY known)),
pl AS (SELECT league, known, sum(sum(f)) OVER w AS f, sum(count(*)) OVER w AS n FROM sl GROUP BY league, known WINDOW w AS (PARTITION BY league ORDER BY known)),
sd AS (SELECT match_id, league, home, away, kick - {LEAD} AS at FROM matches)"""


@R.query("shot_averages", f"WITH {SHOTS_SQL} SELECT sd.match_id, CAST(p.n / 2 AS BIGINT) AS pool, round(coalesce(h.f / h.n, p.f / p.n) + coalesce(v.f / v.n, p.f / p.n), 6) AS shots_for, round(coalesce(h.g / h.n, p.f / p.n) + coalesce(v.g / v.n, p.f / p.n), 6) AS shots_against FROM sd ASOF JOIN pl p ON sd.league = p.league AND sd.at >= p.known ASOF LEFT JOIN sc h ON sd.league = h.league AND sd.home = h.team AND sd.at >= h.known ASOF LEFT JOIN sc v ON sd.league = v.league AND sd.away = v.team AND sd.at >= v.known WHERE p.n / 2 >= 30")
def shot_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of both teams' average shots for and against known before the match; the pool's mean stands in for unknown teams.

    Matches with fewer than 30 known before them are left out.
    """
    m = matches(spark, sf).drop("known").withColumnRenamed("xg_known", "known")
    d = m.select("match_id", "league", "home", "away", (F.col("kick") - LEAD).alias("at"))
    rows = strength.long_form(m, "xh", "xa").select("league", "team", "known", "scored", "conceded", F.lit(1).alias("one"))
    line = pit.cumulated(rows, d.select("league", "at", F.explode(F.array("home", "away")).alias("team")), ["league", "team"], "known", "at", {"f": "scored", "g": "conceded", "n": "one"})
    d = pit.running_as_of(rows, d, ["league"], "known", "at", {"pool_f": "scored", "pool_n": "one"}).where("pool_n >= 60")
    for side in ("home", "away"):
        d = d.join(line.select("league", F.col("team").alias(side), "at", *[F.col(c).alias(f"{side}_{c}") for c in "fgn"]), ["league", side, "at"], "left")
    pool = F.col("pool_f") / F.col("pool_n")
    mean = lambda side, c: F.coalesce(F.when(F.col(f"{side}_n") > 0, F.col(f"{side}_{c}") / F.col(f"{side}_n")), pool)
    return rounded(d.select("match_id", (F.col("pool_n") / 2).cast("long").alias("pool"), (mean("home", "f") + mean("away", "f")).alias("shots_for"), (mean("home", "g") + mean("away", "g")).alias("shots_against")))


CALENDAR_SQL = f"WITH {MATCHES_SQL}, {TEAM_SQL}, w AS (SELECT match_id, team, at_home, kick - max(kick) OVER (PARTITION BY league, team ORDER BY kick RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rest, count(*) OVER (PARTITION BY league, team ORDER BY kick RANGE BETWEEN 168 PRECEDING AND 1 PRECEDING) AS busy, CASE WHEN count(*) OVER k = 10 THEN avg(CAST(scored > conceded AS INT)) OVER k END AS rate FROM lf WINDOW k AS (PARTITION BY league, team ORDER BY kick, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"


@R.query("match_calendar", f"{CALENDAR_SQL} SELECT match_id, round((max(rest) FILTER (at_home) - max(rest) FILTER (NOT at_home)) / 24.0, 6) AS rest_days_difference, CAST(floor(max(rest) FILTER (at_home) / 24.0) AS BIGINT) AS home_rest_days, bool_or(busy >= 2) FILTER (at_home) AS home_congested, bool_or(busy >= 2) FILTER (NOT at_home) AS away_congested, bool_or(rate < 0.3) FILTER (at_home) AS home_must_win, bool_or(rate < 0.3) FILTER (NOT at_home) AS away_must_win FROM w GROUP BY 1")
def match_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Per match the sides' difference of rest, whether each plays its third match in a week, and whether its last ten went badly."""
    lf = strength.long_form(matches(spark, sf))
    part = Window.partitionBy("league", "team")
    before = part.orderBy("kick").rangeBetween(Window.unboundedPreceding, -1)
    week = part.orderBy("kick").rangeBetween(-168, -1)
    ten = part.orderBy("kick", "match_id").rowsBetween(-10, -1)
    rate = F.when(F.count(F.lit(1)).over(ten) == 10, F.avg((F.col("scored") > F.col("conceded")).cast("double")).over(ten))
    w = lf.select("match_id", "at_home", (F.col("kick") - F.max("kick").over(before)).alias("rest"), F.count(F.lit(1)).over(week).alias("busy"), rate.alias("rate"))
    side = lambda home, c: F.max(F.when(F.col("at_home") == home, c))
    return rounded(w.groupBy("match_id").agg(((side(True, F.col("rest")) - side(False, F.col("rest"))) / 24.0).alias("rest_days_difference"), F.floor(side(True, F.col("rest")) / 24.0).alias("home_rest_days"), *[side(h, t).alias(f"{n}_{label}") for label, t in (("congested", F.col("busy") >= 2), ("must_win", F.col("rate") < 0.3)) for h, n in ((True, "home"), (False, "away"))]))
