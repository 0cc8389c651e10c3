"""Times of day in a named zone, and when a fact counts as known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_to_utc(text: Column, pattern: str, zone: str) -> Column:
    """UTC instant of a local text time; text that does not parse gives NULL."""
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone).cast("timestamp_ntz")


def known_before_matchday(kickoff_utc: Column, zone: str = "Europe/London") -> Column:
    """Conservative time at which odds without time stamp count as known.

    Weekend matches: the end of the Friday before; midweek (Wednesday,
    Thursday): the end of Tuesday; other days are ambiguous and give NULL.
    """
    local = F.from_utc_timestamp(kickoff_utc.cast("timestamp"), zone)
    day = F.weekday(local)
    back = F.when(day == 5, 1).when(day == 6, 2).when(day == 2, 1).when(day == 3, 2)
    eve = F.date_sub(F.to_date(local), back)
    end = F.to_timestamp(F.concat(F.date_format(eve, "yyyy-MM-dd"), F.lit(" 23:59:59")))
    return F.when(back.isNotNull(), F.to_utc_timestamp(end, zone).cast("timestamp_ntz"))


def decay_weight(age_days: Column, half_life_days: float) -> Column:
    """0.5 ^ (age / half life); a fact from the future has no weight."""
    return F.when(age_days >= 0, F.pow(F.lit(0.5), age_days / half_life_days))
