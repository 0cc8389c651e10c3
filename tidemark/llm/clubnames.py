"""Typed club names to the canonical list: parsing, join and exact check (problem 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.setjoin import bigram_set, similarity_join
from tidemark.llm.textfold import damerau, fold, is_short_form
from tidemark.session import cut

#: Words of club names in four languages, as folded, for tables without a list of clubs and their towns.
CLUB_WORDS = (
    "united", "rovers", "wanderers", "county", "albion", "town", "athletic", "city", "olympique", "racing", "etoile", "stade", "us", "as",
    "fortuna", "sv", "concordia", "viktoria", "eintracht", "tsv", "real", "union", "deportivo", "sporting", "atletico", "cd", "ud",
)
#: Words that say no more than that it is a club, or what the text adds about the match.
NOISE_WORDS = ("fc", "afc", "cf", "sc", "club", "f.c", "n", "1", "h", "the", "de", "la", "le", "el", "cfc")
#: Words that name another side of the club than its first men's team.
OTHER_SIDE = re.compile(
    r"\b(u ?\d\d|under ?\d\d|ii|iii|2|3|b|c2|w|women|womens|ladies|fem|feminin|feminine|feminines|femenino|femenina|frauen|damen|girls|"
    r"youth|academy|reserves?|reserve|res|juniors?|junioren|jugend|juvenil|cantera|espoirs|filial|amateure|development|dev|next gen|sub ?\d\d|a-?jugend|colts)\b"
)
#: A country code or a match note that a text adds in brackets at its end.
BRACKETED = re.compile(r"[\[(]([a-z]{3}|n)[\])]\W*$")

PARSED = T.StructType([T.StructField("town", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("other", T.BooleanType())])


def squash(s: str) -> str:
    """One spelling for letter pairs that stand for an accented letter."""
    for pair, one in (("ae", "a"), ("oe", "o"), ("ue", "u"), ("ny", "n")):
        s = s.replace(pair, one)
    return s


def parse_name(text: str | None, club_words: tuple[str, ...] = CLUB_WORDS) -> tuple[str, list[str], bool]:
    """(town letters, club words in any short form, names another side) of a typed name."""
    is_word = lambda w: _is_club_word(w, club_words)
    s = fold(text or "").replace("'", "").replace("’", "").replace(".", "").replace("…", " ")
    s = BRACKETED.sub(" ", s)
    s = re.sub(r"(?<=[a-z])-(?=[a-z])", "~", s)
    s = re.sub(r"[^a-z0-9~]+", " ", s).strip()
    other = bool(OTHER_SIDE.search(s.replace("~", " ")))
    words, rest = [], []
    for chunk in s.split():
        parts = chunk.split("~")
        # A hyphen joins name parts, or is a slip inside one word.
        joined = len(parts) > 1 and not any(p in club_words or p in NOISE_WORDS or (is_word(p) and i in (0, len(parts) - 1) and max(map(len, parts)) > 7) for i, p in enumerate(parts))
        for w in ["".join(parts)] if joined else parts:
            if w in NOISE_WORDS or not w:
                continue
            (words if is_word(w) else rest).append(w)
    if not rest and words:
        rest, words = words, []
    return "".join(rest), words, other


@lru_cache(100_000)
def _is_club_word(w: str, club_words: tuple[str, ...]) -> bool:
    return w in club_words or any(is_short_form(w, c) for c in club_words if len(w) <= 5 or damerau(w, c, 2) <= 2)


def name_parser(club_words: tuple[str, ...] = CLUB_WORDS):  # noqa: ANN201
    """Column function that parses names with the given words of clubs."""

    @F.pandas_udf(PARSED)
    def parse(names: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in names:
            yield pd.DataFrame([parse_name(x, club_words) for x in batch], columns=["town", "words", "other"])

    return parse


parse_names = name_parser()


def club_vocabulary(clubs: DataFrame) -> tuple[str, ...]:
    """The words by which clubs of a list call themselves beside their town, as folded.

    The list has one row per club of the target list and goes to the driver.
    """
    words: set[str] = set()
    for r in clubs.select("club_name", "town").distinct().collect():
        split = lambda t: set(re.sub(r"[^a-z0-9]+", " ", fold(t or "").replace(".", "").replace("'", "")).split())
        words |= split(r["club_name"]) - split(r["town"]) - set(NOISE_WORDS)
    return tuple(sorted(words))


def town_distance(typed: str, town: str) -> tuple[int, int] | None:
    """(0 whole / 1 cut short, edits) if the letters may be the town's, else None."""
    plain = _town_distance(typed, town)
    if plain == (0, 0) or (squash(typed) == typed and squash(town) == town):
        return plain
    return min((d for d in (plain, _town_distance(squash(typed), squash(town))) if d is not None), default=None)


@lru_cache(200_000)
def _town_distance(typed: str, town: str) -> tuple[int, int] | None:
    n = len(typed)
    # The longer a name, the more slips it survives without becoming another.
    most, start = _slips(n)
    d = damerau(typed, town, most)
    if d <= most:
        return 0, d
    if 0 <= start and n < len(town) - 1:
        d = min(damerau(typed, town[:k], start) for k in range(max(1, n - 1), n + 2))
        if d <= start:
            return 1, d
    return None


def _slips(n: int) -> tuple[int, int]:
    """Edits that a name of n letters may have to a whole town, and to a town's beginning (-1: none is read so)."""
    return (3 if n >= 12 else 2 if n >= 8 else 1 if n >= 5 else 0), (1 if n >= 6 else 0 if n >= 4 else -1)


def _counts(texts: list[str]) -> np.ndarray:
    """How often each letter occurs in each text; characters of equal code modulo 32 count as one, which only brings texts nearer."""
    out = np.zeros((len(texts), 32), dtype=np.int16)
    for i, t in enumerate(texts):
        for x in t:
            out[i, ord(x) % 32] += 1
    return out


def _may_be(n: int, towns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """What a name of n letters may stand for, towns and beginnings of towns: positions, letter counts, most difference."""
    whole, start = _slips(n)
    tries = [(k, t, whole) for k, t in enumerate(towns) if abs(len(t) - n) <= whole]
    if start >= 0:
        tries += [(k, t[:m], start) for k, t in enumerate(towns) if n < len(t) - 1 for m in range(max(1, n - 1), n + 2)]
    if not tries:
        return None
    # An edit adds a letter, takes one away or both; a swap does neither.
    return np.array([k for k, _, _ in tries]), _counts([t for _, t, _ in tries]), np.array([2 * most - abs(len(t) - n) for _, t, most in tries])


def near_towns(typed: str, towns: list[str], memo: dict) -> set[int]:
    """Positions of the towns whose letter counts allow the edits of `_town_distance`; none that it accepts is missing."""
    n = len(typed)
    if n not in memo:
        memo[n] = _may_be(n, towns)
    if memo[n] is None:
        return set()
    at, counts, most = memo[n]
    return {int(k) for k in at[np.abs(counts - _counts([typed])).sum(1) <= most]}


def letter_pairs(towns: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs (town, alias_id) of unique typed towns and towns of clubs, by letter counts; none that `town_distance` accepts is missing.

    The list of clubs goes to every task: it has one town per club, however many names are typed.
    """
    listed = [(r["alias_id"], r["alias"]) for r in aliases.where("not is_code and alias <> ''").select("alias_id", "alias").collect()]
    ids, texts = [i for i, _ in listed], [t for _, t in listed]
    short = [squash(t) for t in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain: dict = {}
        squashed: dict = {}
        for pdf in batches:
            out = [(town, ids[k]) for town in pdf["town"] for k in sorted(near_towns(town, texts, plain) | near_towns(squash(town), short, squashed))]
            yield pd.DataFrame(out, columns=["town", "alias_id"])

    return towns.select("town").mapInPandas(run, "town string, alias_id string")


def judge(typed: str, words: list[str], alias: str, is_code: bool, club_words: list[str]) -> int | None:
    """Cost of reading a typed name as a club, None where it is another club.

    A club word in the text must be (a short form of) a word of the club: the
    same town with another word is another club.
    """
    if is_code:
        return 5 if typed == alias and not words else None
    for w in words:
        if not any(is_short_form(w, c) for c in club_words):
            return None
    d = town_distance(typed, alias)
    if d is None:
        return None
    return 100 * d[0] + 10 * d[1] + (0 if words or not club_words else 1)


@F.pandas_udf(T.IntegerType())
def judge_pairs(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([judge(t, list(w), a, bool(k), list(c)) for t, w, a, k, c in zip(*batch, strict=True)], dtype="Int32")


def club_aliases(clubs: DataFrame, parse=parse_names) -> DataFrame:  # noqa: ANN001
    """Per club its town and its short title as texts to match: alias_id, club_id, alias, is_code, club_words, competition."""
    town = clubs.select("club_id", parse("town").alias("t"), parse("club_name").alias("n"), F.lower("short_title").alias("code"), F.lower(F.trim("competition")).alias("club_competition"))
    words = F.col("n.words")
    names = town.select("club_id", F.col("t.town").alias("alias"), F.lit(False).alias("is_code"), words.alias("club_words"), "club_competition")
    codes = town.where("code is not null").select("club_id", F.col("code").alias("alias"), F.lit(True).alias("is_code"), words.alias("club_words"), "club_competition")
    return names.unionByName(codes).withColumn("alias_id", F.concat_ws(":", "club_id", F.col("is_code").cast("string")))


def match_clubs(typed: DataFrame, clubs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Club of each distinct (name, competition): columns name, competition, club_id (0: none), jaccard.

    `typed` has unique rows (name, competition); both may be NULL.  A name maps
    to the club that the exact check reads it as at the least cost; clubs tied at
    that cost are told apart by the competition of the row, else the name stays
    unresolved.  Names of another side, of no club, blank or NULL give 0.
    """
    parse = name_parser(club_vocabulary(clubs))
    parsed = cut(typed.select("name", "competition", parse("name").alias("p")))
    aliases = cut(club_aliases(clubs, parse))
    # The length filter of the join, ahead of it: a longer text cannot reach the threshold with any alias.
    longest = F.coalesce(aliases.agg(F.max(F.length("alias"))).scalar(), F.lit(0)) / threshold
    towns = cut(parsed.where("not p.other and p.town <> ''").select(F.col("p.town").alias("town")).where(F.length("town") <= longest).distinct().withColumn("tokens", bigram_set(F.col("town"))))
    right = aliases.select("alias_id", bigram_set(F.col("alias")).alias("tokens"))
    near = similarity_join(towns, right, "town", "alias_id", threshold)
    # Names whose slips leave them below the threshold, and short beginnings of long towns: all other pairs that the exact check can accept.
    sets = aliases.select("alias_id", F.length("alias").alias("_n"), bigram_set(F.col("alias")).alias("_r"))
    overlap = F.size(F.array_intersect("_l", "_r"))
    below = letter_pairs(towns, aliases).join(sets, "alias_id").join(towns.withColumnRenamed("tokens", "_l"), "town").withColumn("jaccard", overlap / (F.length("town") + F.col("_n") - overlap))
    near = near.unionByName(below.where(F.col("jaccard") < threshold - 1e-9).select("town", "alias_id", "jaccard")).join(aliases, "alias_id")
    flat = parsed.where("not p.other").select("name", "competition", F.col("p.town").alias("town"), F.col("p.words").alias("words"))
    cands = flat.join(near, "town").withColumn("cost", judge_pairs("town", "words", "alias", "is_code", "club_words")).where("cost is not null")
    here = F.coalesce(F.lower(F.trim("competition")) == F.col("club_competition"), F.lit(False))
    ranked = cands.groupBy("name", "competition").agg(
        F.min(F.struct(F.col("cost"), (~here).alias("away"))).alias("least"), F.collect_list(F.struct("cost", (~here).alias("away"), "club_id", "jaccard")).alias("all")
    )
    tied = F.filter("all", lambda x: (x["cost"] == F.col("least.cost")) & (x["away"] == F.col("least.away")))
    ids = F.array_distinct(F.transform(tied, lambda x: x["club_id"]))
    best = ranked.select("name", "competition", F.when(F.size(ids) == 1, ids[0]).alias("club_id"), F.array_max(F.transform(tied, lambda x: x["jaccard"])).alias("jaccard"))
    same = (F.col("a.name").eqNullSafe(F.col("b.name"))) & (F.col("a.competition").eqNullSafe(F.col("b.competition")))
    return typed.alias("a").join(best.alias("b"), same, "left").select("a.name", "a.competition", F.coalesce("b.club_id", F.lit(0)).cast("long").alias("club_id"), "b.jaccard")
