"""Mixed timestamp formats and time zones to one unambiguous instant (problem 2).

Method: each text gives the array of its valid interpretations; a Viterbi pass
over each source's record order picks one per record, penalising changes of
format and backward jumps in time.  A record with exactly one interpretation
pins the path, so the order of a source is cut there and the parts between are
solved on their own, exactly and in parallel.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERPRETATIONS = T.ArrayType(T.StructType([T.StructField("fmt", T.StringType()), T.StructField("us", T.LongType()), T.StructField("kind", T.StringType())]))

#: English month names as they occur in texts, by their first three letters.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
#: Digits of a bare number -> divisor of a second (14 digits are a calendar time).
UNIX_UNITS = {10: 1, 13: 1_000, 16: 1_000_000, 19: 1_000_000_000}

_CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,12}))?)?\s*(?P<ap>am|pm|a\.m\.|p\.m\.)?"
_ZONE = r"\s*(?:(?P<z>z)|(?P<off>[+\-−]\d{2}(?::?\d{2})?)\s*(?:\[(?P<region>[A-Za-z_/+\-0-9]+)\])?|(?P<abbrev>[a-z]{2,5}))?"
_SHAPES = [
    ("iso", r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})(?:\s+|t)" + _CLOCK + _ZONE),
    ("compact", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})t(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?" + _ZONE),
    ("slash", r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4}|\d{2})(?:\s+|,\s*|t)" + _CLOCK + _ZONE),
    ("dot", r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4}|\d{2})(?:\s+|,\s*|t)" + _CLOCK + _ZONE),
    ("day_month", r"(?:[a-z]{3,9}\.?,?\s+)?(?P<d>\d{1,2})\.?[\s\-](?P<mon>[a-z]{3,9})\.?,?[\s\-](?P<y>\d{4}|\d{2}),?\s+" + _CLOCK + _ZONE),
    ("month_day", r"(?:[a-z]{3,9}\.?,?\s+)?(?P<mon>[a-z]{3,9})\.?\s+(?P<d>\d{1,2}),?\s+(?P<y>\d{4}|\d{2}),?\s+" + _CLOCK + _ZONE),
]
_COMPILED = [(name, re.compile(p, re.IGNORECASE)) for name, p in _SHAPES]
_OUTER = " \t\r\n ​﻿"


@lru_cache(maxsize=512)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # noqa: BLE001 - any unknown or malformed name means no zone
        return None


def _micros(t: datetime) -> int:
    d = t - datetime(1970, 1, 1)
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def _place(fmt: str, local: datetime, zone: str | None) -> list[tuple[str, int, str]]:
    """Instants that a local time may mean in a zone: one, two (clock set back) or none (set forward)."""
    tz = _zone(zone) if zone else None
    if tz is None:
        return [(fmt, _micros(local), "no_zone")]
    folds = []
    for fold in (0, 1):
        at = local.replace(tzinfo=tz, fold=fold).astimezone(UTC)
        if at.astimezone(tz).replace(tzinfo=None) == local:
            folds.append(_micros(at.replace(tzinfo=None)))
    if not folds:
        return [(fmt, _micros(local), "nonexistent")]
    if folds[0] == folds[-1]:
        return [(fmt, folds[0], "instant")]
    return [(fmt, u, "ambiguous") for u in folds]


def interpretations(text: str, zone: str | None, day_first: bool | None, abbrev_minutes: int | None) -> list[tuple[str, int, str]]:
    """All valid readings (format, microseconds since 1970, kind) of one text.

    A zone in the text decides; else `zone` holds.  kind is `instant`, `ambiguous`
    (one entry per instant), `nonexistent` or `no_zone` (both with the local time
    as if UTC).  Slashed dates follow `day_first`; where that is unknown both
    orders are given.  No valid date with a time of day gives the empty list.
    """
    s = text.strip(_OUTER)
    if s.isascii() and s.isdigit():
        if len(s) == 14:
            try:
                return _place("digits", datetime.strptime(s, "%Y%m%d%H%M%S"), zone)
            except ValueError:
                return []
        unit = UNIX_UNITS.get(len(s))
        return [] if unit is None else [("unix", int(s) * 1_000_000 // unit, "instant")]
    out: list[tuple[str, int, str]] = []
    for name, shape in _COMPILED:
        m = shape.fullmatch(s)
        if not m:
            continue
        g = m.groupdict()
        orders = [(g.get("d"), g.get("m"), name)]
        if name == "slash":
            dmy, mdy = (g["a"], g["b"], "slash_dmy"), (g["b"], g["a"], "slash_mdy")
            orders = [dmy, mdy] if day_first is None else [dmy] if day_first else [mdy]
        for d, mo, fmt in orders:
            local = _local(g, d, mo)
            if local is None:
                continue
            if g.get("z"):
                out.append((fmt + "+z", _micros(local), "instant"))
            elif g.get("off"):
                digits = g["off"][1:].replace(":", "")
                minutes = int(digits[:2]) * 60 + int(digits[2:] or 0)
                if minutes <= 18 * 60 and int(digits[2:] or 0) < 60:
                    out.append((fmt + "+off", _micros(local) - (1 if g["off"][0] == "+" else -1) * minutes * 60_000_000, "instant"))
            elif g.get("abbrev"):
                if abbrev_minutes is not None:
                    out.append((fmt + "+abbrev", _micros(local) - abbrev_minutes * 60_000_000, "instant"))
            else:
                out.extend(_place(fmt, local, zone))
        break
    # Two orders that mean the same day are one reading.
    return list({(u, k): (f, u, k) for f, u, k in reversed(out)}.values())[::-1]


def _local(g: dict, d: str, mo: str | None) -> datetime | None:
    month = int(mo) if mo else MONTHS.get(g["mon"][:3].lower())
    year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
    hour = int(g["H"])
    if ap := (g.get("ap") or "").lower():
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if ap[0] == "p" else 0)
    try:
        return datetime(year, month or 0, int(d), hour, int(g["M"]), int(g["S"] or 0), int(((g.get("f") or "") + "000000")[:6]))
    except ValueError:
        return None


@F.pandas_udf(INTERPRETATIONS)
def read_text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    memo: dict[tuple, list[dict]] = {}
    for text, zone, first, minutes in batches:
        out = []
        for key in zip(text, zone, first, minutes, strict=True):
            key = tuple(None if v is None or v != v else v for v in key)
            got = memo.get(key)
            if got is None:
                t, z, f, a = key
                got = [] if t is None else [{"fmt": x, "us": u, "kind": k} for x, u, k in interpretations(t, z, None if f is None else bool(f), None if a is None else int(a))]
                if len(memo) > 200_000:
                    memo.clear()
                memo[key] = got
            out.append(got)
        yield pd.Series(out)


def trailing_letters(c: Column) -> Column:
    """The zone letters at the end of a text, in upper case ('' if none)."""
    return F.upper(F.regexp_extract(c, r"(?<![A-Za-z\[/_])([A-Za-z]{2,5})\s*$", 1))


def step_cost(a: tuple[str, int], b: tuple[str, int], switch: float, back: float) -> float:
    """Cost of reading two neighbouring records as a then b."""
    hours = (a[1] - b[1]) / 3.6e9
    return (switch if a[0] != b[0] else 0.0) + (back * (1 + math.log1p(hours)) if hours > 0 else 0.0)


def viterbi(chain: list[list[tuple[str, int]]], switch: float = 1.0, back: float = 2.0) -> list[int]:
    """Index of the reading of each record on the cheapest path; ties take the first reading."""
    best, came = [0.0] * len(chain[0]), []
    for prev, cur in zip(chain, chain[1:], strict=False):
        costs = [[best[i] + step_cost(a, b, switch, back) for i, a in enumerate(prev)] for b in cur]
        from_ = [min(range(len(c)), key=c.__getitem__) for c in costs]
        best = [c[i] for c, i in zip(costs, from_, strict=True)]
        came.append(from_)
    path = [min(range(len(best)), key=best.__getitem__)]
    for from_ in reversed(came):
        path.append(from_[path[-1]])
    return path[::-1]


def choose(df: DataFrame, source: list[str], order: str, block_rows: int = 20_000, switch: float = 1.0, back: float = 2.0) -> DataFrame:
    """Add `pick` (fmt, us, kind) to rows with an array `cands`, by Viterbi over each source's order.

    `order` is a unique BIGINT.  Rows with one reading are settled at once and
    pin the path; rows with none get NULL and are skipped by the path.  Only
    runs of rows with several readings, with the pin on either side, reach
    Python.  Blocks are ranges of `order`; the rows before a block's first pin
    join the block before it, so no cut ever falls inside a run.
    """
    n = F.size("cands")
    settled = df.where((n <= 1) | F.col("cands").isNull()).withColumn("pick", F.try_element_at("cands", F.lit(1)))
    keys = [F.col(c).alias(f"_s{i}") for i, c in enumerate(source)]
    s = [f"_s{i}" for i in range(len(source))]
    live = df.where(n >= 1).select(*keys, F.col(order).alias("_o"), F.floor(F.col(order) / block_rows).alias("_b"), "cands", (n == 1).alias("_pin"))
    heads = live.groupBy(*s, "_b").agg(F.min(F.when(F.col("_pin"), F.col("_o"))).alias("_first"))
    before = Window.partitionBy(*s).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_to", F.coalesce(F.last(F.when(F.col("_first").isNotNull(), F.col("_b")), ignorenulls=True).over(before), F.lit(-(2**62))))
    placed = live.join(heads, [*s, "_b"])
    seg = F.when(F.col("_o") >= F.col("_first"), F.col("_b")).otherwise(F.col("_to"))
    parts = placed.withColumn("_seg", F.explode(F.when(F.col("_o") == F.col("_first"), F.array("_b", "_to")).otherwise(F.array(seg)))).select(*s, "_seg", "_o", "cands", "_pin")
    w = Window.partitionBy(*s, "_seg").orderBy("_o")
    # Pins beside a run hold its ends; pins further off would add the same cost to every path.
    near = ~F.col("_pin") | ~F.coalesce(F.lag("_pin").over(w), F.lit(True)) | ~F.coalesce(F.lead("_pin").over(w), F.lit(True))
    runs = parts.withColumn("_near", near).where("_near")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o")
        chain = [[(c["fmt"], c["us"]) for c in cands] for cands in pdf["cands"]]
        return pdf[[*s, "_o"]].assign(_i=viterbi(chain, switch, back))[~pdf["_pin"]]

    schema = T.StructType([*[T.StructField(k, df.schema[c].dataType) for c, k in zip(source, s, strict=True)], T.StructField("_o", T.LongType()), T.StructField("_i", T.IntegerType())])
    solved = runs.select(*s, "_seg", "_o", "cands", "_pin").groupBy(*s, "_seg").applyInPandas(solve, schema)
    open_rows = df.where(n > 1).withColumns({f"_s{i}": F.col(c) for i, c in enumerate(source)} | {"_o": F.col(order)})
    chosen = open_rows.join(solved, [*s, "_o"]).withColumn("pick", F.get("cands", F.col("_i"))).drop("_o", "_i", *s)
    return settled.unionByName(chosen)


def normalised_text(pick: Column) -> Column:
    """The chosen reading as an ISO instant in UTC, or the reason why there is none."""
    t = F.date_format(F.timestamp_micros(pick["us"]), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(pick.isNull(), "unreadable").when(pick["kind"] == "instant", t).otherwise(pick["kind"])
