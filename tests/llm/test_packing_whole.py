"""A seed's neighbours must not depend on how many shards there are."""

from __future__ import annotations

import random

from tidemark.llm import packing

DOC = "doc_id long, text string, tokens int"


def corpus() -> list[tuple[int, str, int]]:
    rng = random.Random(3)
    docs = []
    for i in range(1500):
        topic = rng.randrange(12) if i % 3 else 0
        words = rng.choices([f"t{topic}w{j}" for j in range(60)], k=rng.randint(5, 60)) + rng.choices([f"c{j}" for j in range(80)], k=10)
        docs.append((i, " ".join(words), len(words)))
    return docs + [(5000 + i, t, n) for i, t, n in docs[:100]]


def offered(spark, docs, shards):
    rest, stats = packing.prepared(spark.createDataFrame(docs, DOC), 512, shards)
    rows = packing.neighbours(rest.where("not is_seed"), rest.where("is_seed"), stats).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (-r["score"], r["doc_id"])):
        out.setdefault(r["seed"], []).append(r["doc_id"])
    return out


def test_neighbours_are_reached_whatever_the_number_of_shards(spark):
    docs = corpus()
    exact = offered(spark, docs, 1)
    for shards in (8, 64):
        got = offered(spark, docs, shards)
        reach = [d in got.get(s, ()) for s, near in exact.items() for d in near[:10]]
        assert sum(reach) / len(reach) >= 0.9


def test_unused_space_is_the_same_whatever_the_number_of_shards(spark):
    docs = corpus()
    unused = []
    for shards in (1, 8, 64):
        out = packing.pack(spark.createDataFrame(docs, DOC), 512, shards)
        unused.append(packing.fill_report(out, 512).first()["unused_share"])
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(d[0] for d in docs)
    assert max(unused) - min(unused) <= 0.005 + 512 / sum(d[2] for d in docs)


def test_repeats_of_one_text_are_spread_over_parts(spark):
    docs = [(i, "all the same text", 4) for i in range(4000)] + [(10_000 + i, f"text {i}", 2) for i in range(200)]
    rest, _ = packing.prepared(spark.createDataFrame(docs, DOC), 10, 64)
    held = rest.groupBy("shard").count().collect()
    assert max(r["count"] for r in held) < 1200
    out = packing.pack(spark.createDataFrame(docs, DOC), 10, 64).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(d[0] for d in docs)
