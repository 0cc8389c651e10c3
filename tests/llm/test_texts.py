"""Packing, mixing and toxic spans."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import crf, mixing, packing, tokens, toxicity

DOC = "doc_id long, text string, tokens int"


def packed_rows(spark, docs, capacity, shards=2):
    return packing.pack(spark.createDataFrame(docs, DOC), capacity, shards).collect()


def test_containers_hold_every_token_once(spark):
    rng = random.Random(3)
    words = "goal keeper market price odds corner referee rain stand draw".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), None) for i in range(300)]
    docs = [(i, t, len(t.split())) for i, t, _ in docs] + [(1000, "long " * 450, 450), (1001, None, None), (1002, "", 0), (1003, "exactly " * 100, 100), (1004, "x " * 200, 200)]
    got = packed_rows(spark, docs, 100)
    per_doc, per_box = {}, {}
    for r in got:
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + r["tokens"]
        per_box.setdefault(r["container_id"], []).append(r)
    assert per_doc == {i: n or 0 for i, _, n in docs}
    assert max(sum(r["tokens"] for r in b) for b in per_box.values()) <= 100
    assert all(sorted(r["position"] for r in b) == list(range(len(b))) for b in per_box.values())
    pieces = [r["tokens"] for r in got if r["doc_id"] == 1000]
    assert sorted(pieces) == [50, 100, 100, 100, 100]
    assert [r["piece"] for r in got if r["doc_id"] == 3] == [0]
    total = sum(per_doc.values())
    assert len(per_box) <= total / 100 * 1.05 + 2


def test_packing_ignores_row_order_and_empty_tables(spark):
    docs = [(i, f"word{i % 7} text", 2 + i % 9) for i in range(80)]
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["container_id"], r["position"]) for r in rows)
    assert key(packed_rows(spark, docs, 20)) == key(packed_rows(spark, docs[::-1], 20))
    assert packed_rows(spark, docs[:0], 20) == []


def test_seed_takes_its_lexical_neighbours():
    texts = ["alpha beta gamma delta", "alpha beta", "omega psi", "alpha gamma", "psi chi"]
    both = [packing.term_counts(t, packing.Hashes()) for t in texts]
    index = packing.Index(np.arange(5), [t for t, _ in both], [k for _, k in both], {}, 5, 2.4)
    boxes = packing.fill_shard([6, 2, 2, 2, 2], [t for t, _ in both], index, 10, [])
    assert set(boxes[0]) == {0, 1, 3}
    begun = packing.fill_shard([6, 2, 2, 2, 2], [t for t, _ in both], index, 10, [(0, 2)])
    assert begun[0] in ([0, 1], [0, 3])


def test_index_scores_equal_direct_bm25():
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randint(1, 25))) for _ in range(60)]
    both = [packing.term_counts(t, packing.Hashes()) for t in texts]
    df: dict = {}
    for t, _ in both:
        for w in t.tolist():
            df[w] = df.get(w, 0) + 1
    mean = sum(len(t.split()) for t in texts) / 60
    index = packing.Index(np.arange(60), [t for t, _ in both], [k for _, k in both], df, 60, mean)
    query = texts[0].split()
    got = index.scores(packing.term_counts(texts[0], packing.Hashes())[0])
    for d, t in enumerate(texts):
        words = t.split()
        want = 0.0
        for w in set(query):
            n = sum(w in x.split() for x in texts)
            tf = words.count(w)
            want += np.log1p((60 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        assert got[d] == pytest.approx(want)
    assert list(index.ranked(got, 5)) == list(index.ranked(got))[:5]


def test_best_fit_wastes_little():
    sizes = [7, 5, 5, 3, 3, 2, 2, 1]
    boxes = packing.best_fit(sizes, 10)
    assert sorted(i for b in boxes for i in b) == list(range(8)) and all(sum(sizes[i] for i in b) <= 10 for b in boxes)
    assert len(boxes) == 3 and packing.best_fit([], 10) == []


def test_rake_meets_marginals_and_caps():
    rng = np.random.default_rng(1)
    codes = [np.repeat([0, 1, 2], 4), np.tile([0, 1, 2, 3], 3)]
    mass = rng.uniform(1, 5, 12)
    goals = [np.array([10.0, 6.0, 4.0]), np.full(4, 5.0)]
    w = mixing.rake(mass, codes, goals, np.full(12, 50.0))
    for c, g in zip(codes, goals, strict=True):
        assert np.bincount(c, weights=w * mass) == pytest.approx(g, rel=1e-6)
    capped = mixing.rake(mass, codes, goals, np.full(12, 2.0))
    assert capped.max() <= 2.0 + 1e-12
    assert np.bincount(codes[0], weights=capped * mass)[2] == pytest.approx(4.0, rel=1e-3)


def test_plan_spreads_missing_sources():
    cells = pd.DataFrame({"source": ["a", "b"], "lang": "en", "topic": "x", "tokens": [100.0, 100.0], "target_share": [0.3, 0.3], "max_repeats": [1, 2]})
    plan = mixing.plan_cells(cells)
    assert plan["copies"].tolist() == pytest.approx([1.0, 1.0])
    assert len(mixing.plan_cells(cells.assign(tokens=0.0))) == 0


def test_mixture_reaches_targets(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["A", "a ", "b", "c", None, "other"]), rng.choice(["en", "EN", "fr", None, "xx"]), rng.choice(["l1", "l2", None]), rng.choice([0, 1, 40, 80, 300])) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, competition string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.2, 2), ("c", 0.2, 1), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets)
    assert mixed.count() == len(docs) and mixed.select("doc_id").distinct().count() == len(docs)
    report = {r["source"]: r for r in mixing.share_report(mixed, targets).collect()}
    for s, share in (("a", 5 / 9), ("b", 2 / 9), ("c", 2 / 9)):
        assert report[s]["actual_share"] == pytest.approx(share, abs=0.004)
        assert report[s]["most_repeats"] <= report[s]["max_repeats"]
    assert report["other"]["mixed_tokens"] == 0 and report["none"]["mixed_tokens"] == 0
    assert mixing.mix(df.where("false"), targets).count() == 0


def test_token_counts_round_trip(spark):
    t = tokens.load(tokens.DEFAULT_TOKENIZER)
    texts = ["Goal!", "", None, "<|endoftext|> is text", "ñandú " * 50]
    got = spark.createDataFrame([(x,) for x in texts], "text string").select("text", tokens.token_count(F.col("text")).alias("n")).collect()
    for r in got:
        ids = t.encode_ordinary(r["text"] or "")
        assert r["n"] == len(ids)
        assert t.decode(ids) == (r["text"] or "")


def test_both_files_of_a_vocabulary_count_alike():
    texts = ["It's 3-0, Zoë!  Next  week\n\n", "", "don't we'll they've", "très \u200b мяч 你好"]
    ranks, described = tokens.load(tokens.DEFAULT_TOKENIZER), tokens.load("/opt/tokenizers/byte_bpe_50k.json")
    assert tokens.counts(ranks, texts) == tokens.counts(described, texts)


def test_long_texts_do_not_widen_the_arrays_of_others(monkeypatch):
    rng = np.random.default_rng(4)
    model = crf.Model(rng.normal(size=crf.FEATURES))
    feats = [rng.integers(0, crf.FEATURES, size=(n, 7)) for n in (3, 900, 0, 40, 41, 7)]
    whole = model.marginals(feats)
    monkeypatch.setattr(crf, "PADDED_TOKENS", 100)
    for a, b in zip(whole, model.marginals(feats), strict=True):
        assert np.allclose(a, b)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    trans = rng.normal(size=(2, 2))
    scores = [rng.normal(size=n) for n in (4, 1, 6, 0)]
    got, pairs = crf.forward_backward(scores, trans, with_pairs=True)
    want_pairs = np.zeros((2, 2))
    for s, p in zip(scores, got, strict=True):
        n = len(s)
        z, m = 0.0, np.zeros(n)
        seen = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            e = np.exp(sum(s[i] for i in range(n) if path[i]) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            z += e
            m += e * np.array(path)
            for a, b in zip(path, path[1:], strict=False):
                seen[a, b] += e
        assert p == pytest.approx(m / z)
        want_pairs += seen / z
    assert pairs == pytest.approx(want_pairs)


@pytest.mark.parametrize("raw", ["moroooon", "MORON", "m​oron", "mоrоn", "m0ron", "m.o.r.o.n", "m o r o n", "'moron!'"])
def test_disguised_words_read_alike(raw):
    words, _ = crf.Encoder().tokens(f"you {raw} there")
    assert "moron" in [w[0].replace("oo", "o") for w in words]


def test_offsets_point_into_the_text():
    text = "Well, you f​ool… and m o r o n\nthere"
    words, spans = crf.Encoder().tokens(text)
    assert [text[a:b] for a, b in spans] == ["Well", "you", "f​ool", "and", "m o r o n", "there"]
    assert crf.Encoder().features("")[0].shape == (0, 7)


def labelled(spark, n=900, seed=4):
    rng = random.Random(seed)
    clean = ["the keeper held the cross", "late goal for the visitors", "price drifted to 2.10", "rain fell all afternoon", "a killer pass won it", "the club condemned the abuse"]
    bad = ["you are a stupid {} clown", "go and die {} you rat", "those {} people are vermin", "i hope {} breaks a leg"]
    docs, votes, truth = [], [], {}
    for i in range(n):
        parts = rng.choices(clean, k=rng.randint(1, 5))
        truth[i] = rng.random() < 0.15
        if truth[i]:
            parts.insert(rng.randint(0, len(parts)), rng.choice(bad).format(rng.choice(["Miro", "Grelo", "Teva"])))
        docs.append((i, " ".join(parts) if rng.random() < 0.5 else "\n".join(parts), rng.choice(["A", "b", None])))
        if i % 2 == 0:
            for rater in range(rng.randint(1, 3)):
                votes.append((i, f"r{rater}", int(truth[i] ^ (rng.random() < 0.04)) if rng.random() > 0.03 else None))
    docs += [(n, None, None), (n + 1, "", "A"), (n + 2, "goal " * 40_000, "b")]
    truth |= {n: False, n + 1: False, n + 2: False}
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(votes, "doc_id long, rater string, abusive int"), truth


def test_toxic_documents_on_held_out_texts(spark):
    docs, votes, truth = labelled(spark)
    scored = toxicity.score(docs, toxicity.fit(docs, votes))
    got = {r["doc_id"]: r for r in scored.collect()}
    assert got.keys() == truth.keys()
    held = [i for i in truth if i % 2]
    tp = sum(got[i]["abusive"] and truth[i] for i in held)
    wrong = sum(got[i]["abusive"] != truth[i] for i in held)
    assert tp > 40 and wrong <= 0.03 * len(held)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, r in got.items():
        assert all(0 <= s["start"] < s["end"] <= len(texts[i]) for s in r["spans"])
    rates = {r["source"]: r for r in toxicity.source_rates(scored, docs).collect()}
    assert set(rates) == {"a", "b", "(none)"}
    assert sum(r["documents"] for r in rates.values()) == len(truth)


def test_no_labels_and_no_documents(spark):
    docs, votes, _ = labelled(spark, 60)
    none = toxicity.score(docs, toxicity.fit(docs, votes.where("false")))
    assert none.where("abusive").count() == 0
    assert toxicity.score(docs.where("false"), toxicity.fit(docs, votes)).count() == 0
