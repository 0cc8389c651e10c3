"""No pair of names that the exact check accepts may be lost before it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import clubnames
from tidemark.session import table

CLUBS = [(1, "Dravnimaden", "DRA", "a_1", "Dravnimaden"), (2, "Corvivugosa", "COR", "a_1", "Corvivugosa"), (3, "Ubrutinueva Atletico", "UBR", "a_1", "Ubrutinueva"), (4, "Jarvogwatrhaven", "JAR", "a_1", "Jarvogwatrhaven")]


@pytest.mark.parametrize(("name", "club"), [("Dravinmaedn", 1), ("Covriuvgosa", 2), ("Urbutinuvea Atletico", 3), ("Jarv", 4), ("jravog", 4), ("Xxxxxxxx", 0)])
def test_names_below_the_similarity_threshold(spark, name, club):
    clubs = spark.createDataFrame(CLUBS, "club_id long, club_name string, short_title string, competition string, town string")
    typed = spark.createDataFrame([(name, "a_1")], "name string, competition string")
    assert [r["club_id"] for r in clubnames.match_clubs(typed, clubs).collect()] == [club]


def slip(rng, t):
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(t))
        t = rng.choice([t[:i] + t[i + 1 :], t[:i] + t[i + 1 : i + 2] + t[i : i + 1] + t[i + 2 :], t[:i] + "x" + t[i:], t[: max(4, i)], t.replace("a", "ae", 1), t[:i] + "x" + t[i + 1 :]]) or "x"
    return t


def test_letter_counts_lose_no_accepted_pair(spark, data):
    rng = random.Random(5)
    towns = [r["t"] for r in table(spark, data, "clubs").select(clubnames.parse_names("town")["town"].alias("t")).distinct().collect() if r["t"]]
    towns += ["aexoue", "abcdefgh", "nyaeoeuenyaeoe"]
    typed = sorted({slip(rng, t) for t in towns for _ in range(8)})
    aliases = spark.createDataFrame([(t, t, False) for t in towns], "alias_id string, alias string, is_code boolean")
    got = {(r[0], r[1]) for r in clubnames.letter_pairs(spark.createDataFrame([(t,) for t in typed], "town string"), aliases).collect()}
    want = {(a, b) for a in typed for b in towns if clubnames.town_distance(a, b) is not None}
    assert want and want <= got
    assert len(got) < 0.2 * len(typed) * len(towns)
