"""Instants: epoch seconds from the learning platform, ISO-8601 UTC text stamped locally.

All arithmetic is on zoneless timestamps, so no result depends on the session's time zone. "Now" is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY, HOUR = 86_400, 3600
ZONE = "America/Santo_Domingo"
#: Hours between slots that divide the day, so that no step at midnight is short.
GRID_HOURS = tuple(h for h in range(1, 25) if 24 % h == 0)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_epoch(seconds: Column | str) -> Column:
    """Epoch seconds as a zoneless UTC timestamp."""
    return F.timestamp_add("SECOND", as_column(seconds), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def epoch(stamp: Column | str) -> Column:
    """Whole seconds since the epoch of a zoneless UTC timestamp, rounded down."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("second", as_column(stamp)).cast("timestamp_ntz"))


def iso(seconds: Column | str) -> Column:
    """Epoch seconds as 2024-01-15T12:00:00+00:00."""
    return F.date_format(from_epoch(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def local(seconds: Column | str, zone: str = ZONE) -> Column:
    """Epoch seconds as the wall clock of a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), from_epoch(seconds))


def epoch_of_iso(text: Column | str) -> Column:
    """Whole epoch seconds of ISO text with an explicit +00:00 or Z; null for what is no such text."""
    return epoch(F.try_to_timestamp(F.left(as_column(text), F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"))


def next_slot(seconds: Column | str, hours: int, offset: int = -4 * HOUR) -> Column:
    """The first instant strictly after one on a grid of every `hours` hours from local midnight, in a zone `offset` seconds from UTC all year."""
    if hours not in GRID_HOURS:
        raise ValueError(f"a grid step must divide the day: {GRID_HOURS}")
    here, step = as_column(seconds) + offset, hours * HOUR
    return (F.floor(here / F.lit(step)) + 1) * step - offset


def remaining_words(seconds: Column | str) -> Column:
    """The time left in words, always rounded down."""
    s = as_column(seconds)
    whole = lambda unit: F.floor(s / unit).cast("bigint")

    def counted(n: Column, one: str, more: str) -> Column:
        return F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {more}")))

    return (
        F.when(s < 60, F.lit("menos de un minuto"))
        .when(s < HOUR, counted(whole(60), "minuto", "minutos"))
        .when(s < DAY, counted(whole(HOUR), "hora", "horas"))
        .otherwise(counted(whole(DAY), "dia", "dias"))
    )
