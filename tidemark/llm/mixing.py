"""Mixing sources to target weights (problem 8).

Iterative proportional fitting: token weights of the cells (source, language,
topic) are raked to the source targets and to the corpus's own language and
topic shares; each document then enters as often as its cell's weight says, by
systematic sampling, never more often than its source allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import norm_key
from tidemark.session import cut

#: Languages that count by name; the rest and NULL are one class.
LANGUAGES = ["en", "fr", "de", "es"]
DIMS = ["source", "lang", "topic"]
#: Rows of a sampling block; a block is one window group.
BLOCK_ROWS = 20_000


def rake(mass: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], cap: np.ndarray, rounds: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Expected copies per cell: mass * copies has the marginals `goals`, copies stay within `cap`.

    Where the caps allow no such table, the rounds end without one; `mix_report`
    shows what each class missed.

    `codes` gives each cell's class per dimension, the first being the source,
    whose goals are met last in each round and so hold exactly where caps allow.
    """
    w = np.ones(len(mass))
    for _ in range(rounds):
        before = w.copy()
        for code, goal in list(zip(codes, goals, strict=True))[::-1]:
            have = np.bincount(code, weights=w * mass, minlength=len(goal))
            w = w * np.divide(goal, have, out=np.zeros(len(goal)), where=have > 0)[code]
        # Mass over the cap goes to the open cells of the same source.
        code, goal = codes[0], goals[0]
        for _ in range(20):
            over = w > cap
            if not over.any():
                break
            w = np.where(over, cap, w)
            fixed = w >= cap
            held = np.bincount(code, weights=w * mass * fixed, minlength=len(goal))
            loose = np.bincount(code, weights=w * mass * ~fixed, minlength=len(goal))
            factor = np.divide(np.maximum(goal - held, 0), loose, out=np.ones(len(goal)), where=loose > 0)
            w = np.where(fixed, w, w * factor[code])
        w = np.minimum(w, cap)
        if np.abs(w - before).max(initial=0) < tol:
            break
    return w


CELL = T.StructType([T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("copies", T.DoubleType()), T.StructField("max_repeats", T.IntegerType())])


def plan_cells(cells: pd.DataFrame, share_of_feasible: float = 1.0) -> pd.DataFrame:
    """Copies per cell from tokens per cell (source, lang, topic, tokens, target_share, max_repeats).

    The mixture is as large as the targets and the repeat caps allow together.
    Targets of sources without documents are spread over the others.
    """
    cells = cells.sort_values(DIMS).reset_index(drop=True)
    cells = cells[(cells["tokens"] > 0) & (cells["target_share"] > 0) & (cells["max_repeats"] > 0)].reset_index(drop=True)
    if not len(cells):
        return pd.DataFrame(columns=[f.name for f in CELL.fields])
    mass = cells["tokens"].to_numpy(dtype=float)
    cap = cells["max_repeats"].to_numpy(dtype=float)
    coded = [pd.factorize(cells[d]) for d in DIMS]
    codes = [c for c, _ in coded]
    target = cells.groupby(codes[0])["target_share"].first().to_numpy(dtype=float)
    target = target / target.sum()
    room = np.bincount(codes[0], weights=mass * cap)
    total = share_of_feasible * float((room / target).min())
    goals = [target * total]
    for code, names in coded[1:]:
        natural = np.bincount(code, weights=mass, minlength=len(names))
        goals.append(natural / natural.sum() * total)
    return cells.assign(copies=rake(mass, codes, goals, cap))[[f.name for f in CELL.fields]]


def with_cells(documents: DataFrame) -> DataFrame:
    """documents (doc_id, source, lang, competition, tokens) with clean cell columns."""
    lang = F.lower(F.trim("lang"))
    return documents.select(
        "doc_id",
        F.coalesce(norm_key(F.col("source")), F.lit("(none)")).alias("source"),
        F.when(lang.isin(*LANGUAGES), lang).otherwise("other").alias("lang"),
        F.coalesce(norm_key(F.col("competition")), F.lit("(none)")).alias("topic"),
        "tokens",
    )


#: Starting points tried per block for the systematic draw, and single changes per source after it.
STARTS, FIXES = 32, 5


def mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source, tokens, copies: how often each document enters the mixture (0: not at all).

    Each block of a source is sorted by language, topic and size and drawn at
    even steps of the planned copies, so that every cell gets its number of
    documents to one more or less, from the starting point that comes closest
    to the planned tokens.  Then each source changes one document at a time by
    one copy, while that brings source, language and topic nearer to the plan.  Documents of sources
    without target, or without tokens, enter 0 times.
    """
    docs = with_cells(documents)
    goals = targets.select(norm_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))
    cells = cut(docs.groupBy(*DIMS).agg(F.sum("tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("rows")).join(goals, "source"))
    planned = cells.groupBy().applyInPandas(lambda pdf: plan_cells(pdf), CELL)
    blocks = cells.groupBy("source").agg(F.ceil(F.sum("rows") / BLOCK_ROWS).alias("blocks"))
    plan = cut(planned.join(blocks, "source"))
    rows = docs.join(plan, DIMS, "left")
    inside = F.col("copies").isNotNull() & (F.coalesce("tokens", F.lit(0)) > 0)
    drawn = rows.where(inside).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.col("blocks")))
    w = Window.partitionBy("source", "block").orderBy("lang", "topic", "tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("upto", F.sum(F.col("copies").cast("decimal(28,12)")).over(w))
    copies = F.col("copies").cast("decimal(28,12)")

    def steps(start) -> Column:  # noqa: ANN001 - a number or a column
        s = F.lit(start).cast("decimal(28,12)") if isinstance(start, float) else start
        return F.least(F.floor(F.col("upto") + s) - F.floor(F.col("upto") - copies + s), F.col("max_repeats").cast("long"))

    off = [F.abs(F.sum(steps((k + 0.5) / STARTS) * F.col("tokens")) - F.sum(F.col("copies") * F.col("tokens"))) for k in range(STARTS)]
    tried = drawn.groupBy("source", "block").agg(F.array_min(F.array(*[F.struct(o.alias("off"), F.lit((k + 0.5) / STARTS).alias("start")) for k, o in enumerate(off)]))["start"].alias("start"))
    taken = cut(drawn.join(tried, ["source", "block"]).select("doc_id", *DIMS, "tokens", "max_repeats", F.col("copies").alias("planned"), steps(F.col("start").cast("decimal(28,12)")).cast("int").alias("copies")))
    for _ in range(FIXES):
        taken = nearer(taken)
    out = rows.where(~inside).select("doc_id", "source", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.lit(0).alias("copies"))
    return taken.select("doc_id", "source", "tokens", "copies").unionByName(out)


def nearer(taken: DataFrame) -> DataFrame:
    """Per source one document more or less often, the one that most lessens the distance from the plan.

    The distance counts the tokens that the document's source (three times, so
    that sources stay first), language and topic miss.
    """
    mass = lambda c: F.sum(F.col("tokens") * F.col(c))
    near = taken
    for d in DIMS:
        near = near.join(taken.groupBy(d).agg((mass("planned") - mass("copies")).alias(f"missing_{d}")), d)
    weighted = [(3 if d == "source" else 1, F.col(f"missing_{d}")) for d in DIMS]

    def gain(sign: int) -> Column:
        allowed = F.col("copies") < F.col("max_repeats") if sign > 0 else F.col("copies") > 0
        terms = [w * (F.abs(m) - F.abs(m - sign * F.col("tokens"))) for w, m in weighted]
        kept = F.abs(F.col("missing_source") - sign * F.col("tokens")) <= F.abs("missing_source") + F.col("room")
        return F.when(allowed & kept, F.struct(sum(terms[1:], terms[0]).alias("gain"), F.lit(sign).alias("sign")))

    # A source may lose a little, a thousandth of its plan, where language and topic gain more.
    room = taken.groupBy("source").agg((mass("planned") / 1000).alias("room"))
    near = near.join(room, "source").withColumn("g", F.greatest(gain(1), gain(-1))).where("g.gain > 0")
    best = near.groupBy("source").agg(F.max(F.struct("g.gain", -F.col("doc_id"), "doc_id", "g.sign")).alias("b"))
    moves = best.select("source", F.col("b.doc_id").alias("doc_id"), F.col("b.sign").alias("sign"))
    return cut(taken.join(moves, ["source", "doc_id"], "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0))).drop("sign"))


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source its target, the target after spreading those without documents, and what it got."""
    goals = targets.select(norm_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("mixed_tokens"), F.sum(F.col("tokens").cast("long")).alias("available_tokens"), F.max("copies").alias("most_repeats"))
    both = got.join(F.broadcast(goals), "source", "full_outer")
    total = mixed.agg(F.sum(F.col("tokens").cast("long") * F.col("copies"))).scalar()
    reachable = both.agg(F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share")))).scalar()
    return both.select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.when(F.coalesce("available_tokens", F.lit(0)) > 0, F.coalesce("target_share", F.lit(0.0)) / reachable).otherwise(0.0).alias("reachable_share"),
        F.coalesce(F.try_divide("mixed_tokens", total), F.lit(0.0)).alias("actual_share"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
    )


def mix_report(mixed: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """dimension, class, goal_share, actual_share, missed: sources, languages and topics of the mixture against their goals.

    A source's goal is its reachable share; a language's or topic's goal is its
    share of the tokens of the sources that have a target.
    """
    goals = targets.select(norm_key(F.col("source")).alias("source"), "target_share").where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"))
    cells = with_cells(documents).where("tokens > 0").join(mixed.select("doc_id", "copies"), "doc_id").groupBy(*DIMS).agg(F.sum(F.col("tokens").cast("long")).alias("have"), F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("got")).join(goals, "source")
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("class")) for d in DIMS])).alias("d")
    per = cells.select(dims, "have", "got", "target_share").select("d.*", "have", "got", "target_share").groupBy("dimension", "class").agg(F.sum("have").alias("have"), F.sum("got").alias("got"), F.max("target_share").alias("target_share"))
    weight = F.when(F.col("dimension") == "source", F.col("target_share")).otherwise(F.col("have"))
    w = Window.partitionBy("dimension")
    share = lambda c: F.try_divide(c, F.sum(c).over(w))
    out = per.select("dimension", "class", share(weight).alias("goal_share"), share(F.col("got")).alias("actual_share"))
    return out.withColumn("missed", F.col("actual_share") - F.col("goal_share"))
