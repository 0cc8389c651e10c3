"""Text calendars: a date line holds for the match lines below it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Month names of date lines by their first three letters.
_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
_DATE = re.compile(r"^\s*\[?\s*(?:[A-Za-z]{3}\s+)?([A-Za-z]{3})[a-z]*[/ ](\d{1,2})(?:[ /](\d{4}))?\s*\]?\s*$")
_RANGE = re.compile(r"([A-Za-z]{3})[a-z]*[/ ](\d{1,2})(?:[ /](\d{4}))?\s+-\s+(?:[A-Za-z]{3}\s+)?([A-Za-z]{3})[a-z]*[/ ](\d{1,2})(?:[ /](\d{4}))?")
_MATCH = re.compile(r"^\s*(?:(\d{1,2})[.:](\d{2})\s+)?(\S.*?)\s+v\s+(\S.*?)(?:\s+(\d+)-(\d+)(?:\s*\(.*\))?)?\s*$")
_QUALIFIED = re.compile(r"(pen\.|a\.e\.t\.|\[(awarded|postponed|cancelled|abandoned)\])", re.IGNORECASE)
_COUNTRY = re.compile(r"^(.*?)\s*\(([A-Z]{3})\)$")

FIELDS = [
    ("file", T.StringType()), ("line", T.IntegerType()), ("round", T.StringType()), ("day", T.DateType()), ("kickoff", T.StringType()), ("home", T.StringType()), ("home_code", T.StringType()),
    ("away", T.StringType()), ("away_code", T.StringType()), ("home_goals", T.IntegerType()), ("away_goals", T.IntegerType()), ("qualifier", T.StringType()), ("excluded", T.StringType()),
]
PARSED = T.StructType([T.StructField(n, t) for n, t in FIELDS])


def split_country(name: str) -> tuple[str, str | None]:
    """(name, code) of a side written with its country's three letters behind it."""
    m = _COUNTRY.match(name.strip())
    return (m[1].strip(), m[2]) if m else (name.strip(), None)


def declared_start(line: str) -> date | None:
    """First day of a span of dates in a heading; a side without year takes it from the other, across the turn of a year."""
    m = _RANGE.search(line)
    if not m or not (m[3] or m[6]):
        return None
    first, last = _MONTHS.get(m[1].lower()), _MONTHS.get(m[4].lower())
    if not first or not last:
        return None
    year = int(m[3]) if m[3] else int(m[6]) - (first > last)
    try:
        return date(year, first, int(m[2]))
    except ValueError:
        return None


def parse_text(text: str, year: int | None = None) -> list[tuple]:
    """One row per match line or line that could not be read, as in PARSED but for the file.

    A date line may leave out its year: it then continues the last one, one
    more when the months go back by half a year or more; the first takes it
    from the heading's span of dates, else from `year`.  A match without time
    has the time of the line above it on the same day.  Scores after extra
    time or by decision do not count as goals; the qualifier says why.
    """
    out: list[tuple] = []
    day: date | None = None
    stage = clock = None

    def bad(n: int, on: date | None, why: str) -> None:
        out.append((n, stage, on, None, None, None, None, None, None, None, None, why))

    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            heading = declared_start(raw)
            year = heading.year if heading and day is None else year
            if heading and day is None:
                day = heading
            continue
        if line.lstrip().startswith("="):
            continue
        if line.lstrip().startswith(("»", "▪")):
            stage = line.lstrip(" »▪").strip()
            continue
        if m := _DATE.match(line):
            month = _MONTHS.get(m[1].lower())
            y = int(m[3]) if m[3] else (day.year if day else year)
            if m[3] is None and day and month and day.month - month >= 6:
                y = day.year + 1
            clock = None
            try:
                day = date(y or 0, month or 0, int(m[2]))
            except ValueError:
                day = None
                bad(n, None, "bad date")
            continue
        qualifier = _QUALIFIED.search(line)
        if not (m := _MATCH.match(_QUALIFIED.sub("", line).rstrip())):
            bad(n, day, "unreadable")
            continue
        if m[1]:
            clock = f"{int(m[1]):02d}:{m[2]}" if int(m[1]) < 24 and int(m[2]) < 60 else None
        goals = (int(m[5]), int(m[6])) if m[5] and not qualifier else (None, None)
        word = qualifier[0].strip("[].").lower() if qualifier else None
        out.append((n, stage, day, clock, *split_country(m[3]), *split_country(m[4]), *goals, word, None if day else "no date"))
    return out


def parse(files: DataFrame) -> DataFrame:
    """Rows of text calendars (file, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *r) for f, t in zip(pdf["file"], pdf["text"], strict=True) for r in parse_text(t or "")]
            out = pd.DataFrame(rows, columns=[f.name for f in PARSED.fields])
            yield out.astype({"home_goals": "Int32", "away_goals": "Int32"})

    return files.select("file", "text").mapInPandas(run, PARSED)


def render(fixtures: DataFrame) -> DataFrame:
    """Text calendars (file, text), one per competition and day, from fixtures; those without competition or date are gathered under '?'."""
    name = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("?")), r"[\s#]+", " "))
    score = F.when(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull(), F.concat(F.lit("  "), "home_goals", F.lit("-"), "away_goals")).otherwise("")
    line = F.concat(F.lit("  "), name("home_team_openfootball"), F.lit(" v "), name("away_team_openfootball"), score)
    place = F.coalesce("competition", F.lit("?")).alias("competition")
    rows = fixtures.groupBy(place, "fixture_date").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fixture_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    head = F.concat(F.lit("= "), "competition", F.lit("\n\n"), F.coalesce(F.concat(F.lit("["), F.date_format("fixture_date", "EEE MMM/d yyyy"), F.lit("]\n")), F.lit("")))
    return rows.select(F.concat_ws("_", "competition", F.col("fixture_date").cast("string")).alias("file"), F.concat(head, "lines").alias("text"))
