"""JSON literals inside script text of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LITERAL = re.compile(r"JSON\.parse\(\s*(['\"])((?:\\.|(?!\1).)*)\1\s*\)", re.DOTALL)
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", re.DOTALL)
#: One-letter escapes of script strings.
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


def unescape(literal: str) -> str:
    """Text of a script string; \\xHH runs are bytes of UTF-8."""

    def one(m: re.Match) -> str:
        e = m.group(1)
        return chr(int(e[1:], 16)) if len(e) > 1 else _PLAIN.get(e, e)

    s = _ESCAPE.sub(one, literal)
    try:
        return s.encode("latin-1").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return s


@F.pandas_udf(T.StringType())
def literal_of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first JSON literal of a page, NULL where there is none."""
    for batch in pages:
        yield pd.Series([unescape(m.group(2)) if t is not None and (m := _LITERAL.search(t)) else None for t in batch], dtype=object)


def as_page(body: Column | str) -> Column:
    """A page that carries a text as an escaped literal (the inverse of literal_of, for tests)."""
    escaped = F.regexp_replace(F.hex(F.encode(body, "UTF-8")), "(..)", r"\\x$1")
    return F.concat(F.lit("<html><script>var datesData = JSON.parse('"), escaped, F.lit("');</script></html>"))
