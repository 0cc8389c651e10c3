"""The general data problems against brute force on small, dirty fixtures."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import asof, features, snapshots, timestamps
from tidemark.operators.timestamps import interpretations, viterbi

# -- snapshots ------------------------------------------------------------------------------------

SNAP = "feed string, snapshot_no int, id string, delivered_at timestamp_ntz, row_no int, v string, extra string"


def brute_changes(data):
    last = {}
    for feed, n, key, at, row, v, _ in data:
        if feed is None or n is None or key is None:
            continue
        last.setdefault((feed, n), []).append((at or datetime.min, row if row is not None else -1, key, v))
    snaps = {}
    for (feed, n), got in last.items():
        newest = max(x[0] for x in got)
        held = {}
        for at, row, key, v in got:
            if at == newest and (key not in held or row > held[key][0]):
                held[key] = (row, v)
        snaps.setdefault(feed, {})[n] = {k: x[1] for k, x in held.items()}
    out = []
    for feed, by in snaps.items():
        order = sorted(by)
        for a, b in zip(order, order[1:], strict=False):
            for k in by[a].keys() | by[b].keys():
                if k not in by[a]:
                    out.append((feed, b, k, "added"))
                elif k not in by[b]:
                    out.append((feed, b, k, "removed"))
                elif by[a][k] != by[b][k]:
                    out.append((feed, b, k, "changed"))
    return sorted(out, key=repr)


def test_snapshot_changes_match_brute_force(spark):
    rng = random.Random(3)
    t = datetime(2026, 1, 1)
    data = []
    for feed in ("a", "b"):
        state = {str(i): "x" for i in range(150)}
        for n in (1, 2, 4, 7):
            for k in rng.sample(sorted(state), 12):
                state[k] = rng.choice(["x", "y", None])
            for k in rng.sample(sorted(state), 5):
                del state[k]
            state[f"{n}{feed}"] = "new"
            for copy in range(rng.choice([1, 2])):
                for i, (k, v) in enumerate(state.items()):
                    data.append((feed, n, k, t + timedelta(days=n, hours=copy), i, v if copy or rng.random() > 0.1 else "old", "e"))
                data.append((feed, n, "5", t + timedelta(days=n, hours=copy), 9999, "late row", "e"))
    data += [(None, 1, "1", t, 1, "x", ""), ("a", 1, None, t, 1, "x", ""), ("a", None, "1", t, 1, "x", "")]
    df = spark.createDataFrame(data, SNAP)
    got = snapshots.snapshot_changes(df, snapshots.SnapshotSpec(block_rows=60), [F.col("v")])
    assert rows(got) == brute_changes(data)


def test_snapshot_of_empty_table(spark):
    got = snapshots.snapshot_changes(spark.createDataFrame([], SNAP), snapshots.SnapshotSpec(), [F.col("v")])
    assert rows(got) == []


def test_equal_chunks_are_discarded(spark):
    t = datetime(2026, 1, 1)
    data = [("a", n, f"k{i}", t + timedelta(days=n), i, "same", "") for n in (1, 2) for i in range(500)]
    spec = snapshots.SnapshotSpec(block_rows=125)
    delivered = snapshots.delivered_rows(spark.createDataFrame(data, SNAP), spec, [F.col("v")])
    arrived = snapshots.arrivals(delivered, spec)
    assert {r["blocks"] for r in arrived.collect()} == {4}
    c = snapshots.chunked(snapshots.effective_rows(delivered, arrived), spec)
    digests = c.groupBy("n", "b", "chunk").agg(F.bit_xor(F.xxhash64("k", "c1")).alias("d"))
    assert digests.groupBy("b", "d").count().where("count <> 2").count() == 0
    assert digests.count() > 20


def test_a_feed_that_holds_most_rows_is_cut_into_bounded_blocks(spark):
    t = datetime(2026, 1, 1)
    data = [("big", n, f"k{i}", t, i, "v", "") for n in (1, 2) for i in range(3000)] + [("small", 1, f"k{i}", t, i, "v", "") for i in range(20)]
    spec = snapshots.SnapshotSpec(block_rows=200)
    delivered = snapshots.delivered_rows(spark.createDataFrame(data, SNAP), spec, [F.col("v")])
    c = snapshots.chunked(snapshots.effective_rows(delivered, snapshots.arrivals(delivered, spec)), spec)
    assert max(r["count"] for r in c.groupBy("g", "n", "b").count().collect()) < 300


def test_a_delivery_without_any_key_counts_as_an_empty_snapshot(spark):
    t = datetime(2026, 1, 1)
    data = [("a", 1, "x", t, 1, "v", ""), ("a", 2, None, t, 1, "v", ""), ("a", 3, "x", t, 1, "v", ""), ("a", 3, None, t + timedelta(days=1), 1, "v", "")]
    got = snapshots.snapshot_changes(spark.createDataFrame(data, SNAP), snapshots.SnapshotSpec(), [F.col("v")])
    assert rows(got) == [("a", 2, "x", "removed")]


# -- timestamps ------------------------------------------------------------------------------------

UTC = "UTC"


@pytest.mark.parametrize(
    ("text", "zone", "first", "abbrev", "expected"),
    [
        ("2027-04-23 16:00:00", UTC, True, None, "2027-04-23T16:00:00"),
        (" 29/05/2027 19:00 ", "Europe/Paris", True, None, "2027-05-29T17:00:00"),
        ("05/29/27 19:00", "America/New_York", False, None, "2027-05-29T23:00:00"),
        ("26.10.2026 15:30", "Europe/Berlin", True, None, "2026-10-26T14:30:00"),
        ("2027-01-21 18:09 AEDT", None, True, 660, "2027-01-21T07:09:00"),
        ("Oct 29, 2026 6:45 PM", UTC, True, None, "2026-10-29T18:45:00"),
        ("Jan 15, 2027 12:00 a.m.", UTC, True, None, "2027-01-15T00:00:00"),
        ("Thu, 24 Sep 2026 20:30:00 +0200", UTC, True, None, "2026-09-24T18:30:00"),
        ("2026-12-23T17:11:04.123456789−05:00", UTC, True, None, "2026-12-23T22:11:04.123456"),
        ("2026-08-16 21:30:00+02:00[Europe/Madrid]", None, None, None, "2026-08-16T19:30:00"),
        ("20261211T180000", UTC, True, None, "2026-12-11T18:00:00"),
        ("20261126170000", UTC, True, None, "2026-11-26T17:00:00"),
        ("1802788200", None, None, None, "2027-02-16T14:30:00"),
        ("1786451417772097", None, None, None, "2026-08-11T12:30:17.772097"),
    ],
)
def test_readable_times(text, zone, first, abbrev, expected):
    got = interpretations(text, zone, first, abbrev)
    assert [k for _, _, k in got] == ["instant"]
    at = datetime(1970, 1, 1) + timedelta(microseconds=got[0][1])
    assert at.isoformat() == expected


@pytest.mark.parametrize("text", ["", "None", "soon", "19h", "18:45", "2026-10-17", "2027-13-05T18:30:00", "2026-09-12 25:10", "2026-11-07 19:75", "31/04/2027 20:00", "0000-00-00 00:00:00", "2026-W42", "12345", "Oct 29, 2026 13:45 PM", "x" * 100_000])
def test_unreadable_times(text):
    assert interpretations(text, UTC, True, None) == []


def test_local_times_without_one_instant():
    assert [k for _, _, k in interpretations("25.10.2026 02:30", "Europe/Berlin", True, None)] == ["ambiguous"] * 2
    assert [k for _, _, k in interpretations("28.03.2027 02:30", "Europe/Berlin", True, None)] == ["nonexistent"]
    assert [k for _, _, k in interpretations("28.03.2027 02:30", None, True, None)] == ["no_zone"]
    assert len(interpretations("03/04/2027 10:00", UTC, None, None)) == 2
    assert len(interpretations("04/04/2027 10:00", UTC, None, None)) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5).map(lambda h: h * 3_600_000_000)), min_size=1, max_size=3), min_size=1, max_size=6))
def test_viterbi_is_cheapest(chain):
    import itertools

    def cost(path):
        got = [c[i] for c, i in zip(chain, path, strict=True)]
        return sum(timestamps.step_cost(a, b, 1.0, 2.0) for a, b in zip(got, got[1:], strict=False))

    best = min(cost(p) for p in itertools.product(*[range(len(c)) for c in chain]))
    assert cost(viterbi(chain)) == pytest.approx(best)


def test_choose_over_blocks_equals_one_chain(spark):
    rng = random.Random(1)
    chain, data = [], []
    for i in range(60):
        t = i * 86_400_000_000
        cands = [("dmy", t, "instant")] if rng.random() < 0.35 else [("mdy", t + rng.randint(-40, 40) * 86_400_000_000, "instant"), ("dmy", t, "instant")]
        if i % 17 == 3:
            cands = []
        chain.append(cands)
        data.append(("t", i, [{"fmt": f, "us": u, "kind": k} for f, u, k in cands]))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("s", T.StringType()), T.StructField("o", T.LongType()), T.StructField("cands", timestamps.INTERPRETATIONS)])
    got = {r["o"]: r["pick"] for r in timestamps.choose(spark.createDataFrame(data, schema), ["s"], "o", block_rows=7).collect()}
    filled = [i for i, c in enumerate(chain) if c]
    path = viterbi([[(f, u) for f, u, _ in chain[i]] for i in filled])
    assert len(got) == 60

    def cost(us):
        return sum(timestamps.step_cost(a, b, 1.0, 2.0) for a, b in zip(us, us[1:], strict=False))

    whole = cost([chain[i][j][:2] for i, j in zip(filled, path, strict=True)])
    assert cost([(got[i]["fmt"], got[i]["us"]) for i in filled]) == pytest.approx(whole)
    assert all(got[i] is None for i in range(60) if not chain[i])


# -- features --------------------------------------------------------------------------------------

EV = "w string, a string, t timestamp_ntz, m long"


def test_features_by_endpoint_subtraction(spark):
    rng = random.Random(5)
    end = datetime(2027, 7, 1)
    data = [(rng.choice(["u", "v"]), rng.choice(["x", "y", "z"]), end - timedelta(hours=rng.randint(-50, 4000)), rng.randint(0, 99)) for _ in range(400)]
    cum = features.cumulative(features.daily(spark.createDataFrame(data, EV), "w", "a", "t", "m"), "w", "a")
    got = {(r["w"], r["a"]): r for r in features.as_of_features(cum, "w", "a", "2027-07-01", {"all": None, "7d": 7}).collect()}
    want = {}
    for w, a, t, m in data:
        if t < end:
            r = want.setdefault((w, a), [0, 0, 0, 0, t])
            r[0] += 1
            r[1] += m
            if t >= end - timedelta(days=7):
                r[2] += 1
                r[3] += m
            r[4] = max(r[4], t)
    assert {k: [r["n_all"], r["total_all"], r["n_7d"], r["total_7d"], r["last_at"]] for k, r in got.items()} == want


def test_features_of_nothing(spark):
    cum = features.cumulative(features.daily(spark.createDataFrame([], EV), "w", "a", "t", "m"), "w", "a")
    assert features.as_of_features(cum, "w", "a", "2027-07-01", {"all": None}).count() == 0


# -- as known --------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot_rows", [2_000_000, 3])
def test_as_known_join_matches_brute_force(spark, hot_rows):
    rng = random.Random(9)
    t0 = datetime(2026, 1, 1)
    at = lambda: t0 + timedelta(hours=rng.randint(0, 900))
    versions = [(rng.choice(["p", "q", "r", None]), at(), rng.choice([at(), at(), None]), i, f"v{i}") for i in range(120)]
    versions += versions[:10]
    events = [(i, rng.choice(["p", "p", "p", "q", "none", None]), rng.choice([at(), at(), at(), None]), "clash") for i in range(300)]
    v = spark.createDataFrame(versions, "who string, as_of timestamp_ntz, known_at timestamp_ntz, vid long, best string")
    e = spark.createDataFrame(events, "eid long, who string, at timestamp_ntz, vid string")
    log = asof.change_log(v, "who", "known_at", ["as_of", "known_at", "vid"], ["best"])
    got = asof.as_known_join(e, "who", "at", ["eid", "vid"], log, period_s=86400, hot_rows=hot_rows, hot_groups=10**9 if hot_rows == 3 else 1000)
    found = {r["eid"]: r["best"]["vid"] for r in got.collect()}
    want = {}
    for eid, who, t, _ in events:
        seen = [(a, k, i) for w, a, k, i, _ in versions if who and t and w == who and k and k <= t]
        if seen:
            want[eid] = max(seen)[2]
    assert found == want
