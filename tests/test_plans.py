"""What the plans of the data problems must look like at any size."""

from __future__ import annotations

import contextlib
import io

import pytest

from tidemark.plans import catalogue, problems

Q = catalogue.REGISTRY.queries


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["p3_found", "p3_window_features", "p4_found", "p4_trades_with_stats", "scd2_lookup", "strengths_as_of", "interval_match", "reconcile_one_to_one"])
def test_no_cross_joins(spark, data, name):
    text = plan(Q[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_they_need(spark, data):
    text = plan(Q["p3_found"](spark, data))
    read = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "outcome" not in read and "source" not in read
    assert "IsNotNull(timestamp_utc)" in text


def test_features_shuffle_three_times(spark, data):
    """Copies by fingerprint, days by wallet, type and day, then the running sums; endpoints and recency ride along."""
    text = plan(Q["p3_found"](spark, data))
    assert text.split("(1) Scan")[0].count("Exchange") == 3


def test_time_texts_are_parsed_once(spark, data):
    assert "ArrowEvalPython" not in plan(problems.p2_found(spark, data))
