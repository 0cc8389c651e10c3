"""Prefix-filter set-similarity join (problem 5).

Tokens are ordered by global rarity; only the rare prefix of each set is joined,
length and positional filters drop pairs that cannot reach the threshold, and
Jaccard is verified exactly on what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bigram_set(c: Column) -> Column:
    """Bigrams of '^' + text as a set; a bigram's repeats are numbered, so the set keeps their count."""
    padded = F.concat(F.lit("^"), c)
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    numbered = F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).cast("string")))
    return F.when(F.length(c) >= 1, numbered).otherwise(F.array().cast("array<string>"))


def with_ranked_tokens(df: DataFrame, weights: DataFrame, key: str, tokens: str) -> DataFrame:
    """Replace each token set by its tokens in order of global rarity, as array `ranked` of (df, token)."""
    flat = df.select(key, F.explode(tokens).alias("token")).join(F.broadcast(weights), "token", "left")
    return flat.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("ranked"))


def token_rarity(*sides: DataFrame) -> DataFrame:
    """Occurrences of each token over all rows of all sides.

    Tokens are bigrams of folded text over 36 letters and digits, numbered per
    repeat, so this table has at most a few thousand rows however large the input.
    """
    flat = [s.select(F.explode("tokens").alias("token")) for s in sides]
    both = flat[0]
    for f in flat[1:]:
        both = both.unionByName(f)
    return both.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def prefixes(ranked: DataFrame, key: str, threshold: float) -> DataFrame:
    """One row per prefix token: key, token, its position and the set's size."""
    n = F.size("ranked")
    keep = n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1
    return ranked.select(key, n.alias("size"), F.posexplode(F.slice("ranked", F.lit(1), keep)).alias("pos", "t")).select(key, "size", "pos", F.col("t.token").alias("token"))


def similarity_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float) -> DataFrame:
    """Pairs (left_key, right_key, jaccard) whose token sets reach the threshold.

    Both sides have unique keys and an array column `tokens` (a set).  Empty
    sets match nothing.  Every pair at or above the threshold is returned.
    """
    weights = token_rarity(left, right)
    l, r = with_ranked_tokens(left, weights, left_key, "tokens"), with_ranked_tokens(right, weights, right_key, "tokens")
    lp = prefixes(l, left_key, threshold).withColumnsRenamed({"size": "ln", "pos": "lpos"})
    rp = prefixes(r, right_key, threshold).withColumnsRenamed({"size": "rn", "pos": "rpos"})
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("ln") + F.col("rn")) - 1e-9)
    could = 1 + F.least(F.col("ln") - F.col("lpos") - 1, F.col("rn") - F.col("rpos") - 1)
    # The first shared prefix token bounds the overlap; later ones are bounded by it too.
    pairs = (
        lp.join(rp, "token")
        .where((F.least("ln", "rn") >= F.lit(threshold) * F.greatest("ln", "rn") - 1e-9))
        .groupBy(left_key, right_key)
        .agg(F.min_by(could, F.col("lpos")).alias("could"), F.first("ln").alias("ln"), F.first("rn").alias("rn"))
        .where(F.col("could") >= need)
    )
    overlap = F.size(F.array_intersect("lt", "rt"))
    return (
        pairs.join(left.select(left_key, F.col("tokens").alias("lt")), left_key)
        .join(right.select(right_key, F.col("tokens").alias("rt")), right_key)
        .withColumn("jaccard", overlap / (F.col("ln") + F.col("rn") - overlap))
        .where(F.col("jaccard") >= threshold - 1e-9)
        .select(left_key, right_key, "jaccard")
    )
