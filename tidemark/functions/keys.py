"""Canonical forms of identifiers and of numbers kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as outer blanks of an identifier.
BLANKS = " \t\r\n ​﻿"


def norm_key(c: Column) -> Column:
    """Identifiers that differ in letter case or outer blanks only become one; blank becomes NULL."""
    out = F.lower(F.btrim(c.cast("string"), F.lit(BLANKS)))
    return F.when(out != "", out)


def number_text(c: Column) -> Column:
    """A number kept as text in one spelling ('02', '2.00' and ' 2' agree); blank becomes NULL.

    Text that is no number stays as it is (trimmed), so that it still compares as text.
    """
    t = F.btrim(c.cast("string"), F.lit(BLANKS))
    d = t.try_cast("decimal(38,12)")
    return F.when(t == "", None).otherwise(F.coalesce(d.cast("string"), t))


def fingerprint(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the columns; NULLs count as values of their own.

    Together they stand for the values in joins and groupings (collision odds about n^2 / 2^129).
    """
    marked = [x for c in cols for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(0), *marked), F.xxhash64(F.lit(0x5BD1E995), *marked, F.lit(7))
