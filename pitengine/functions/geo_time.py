"""Dates, clocks and distances as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; NULL if a coordinate is missing."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.when(h.isNotNull(), 2 * EARTH_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0))))  # least() skips NULL


def calendar_distance(a: Column, b: Column) -> Column:
    """Circular distance of months over six: 0 to 1."""
    d = F.abs(F.month(a) - F.month(b))
    return F.least(d, 12 - d) / F.lit(6.0)


def valid_at(valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Half open: from <= at < to, open ends where NULL."""
    return (valid_from.isNull() | (valid_from <= at)) & (valid_to.isNull() | (valid_to > at))


def effective_cutoff(exact: Column, upper: Column, lower: Column, strict: bool) -> Column:
    """STRICT takes exact times only; CONSERVATIVE falls back to the upper and then the lower bound."""
    return exact if strict else F.coalesce(exact, upper, lower)


def end_of_day(day: Column) -> Column:
    """Evidence that is known by day counts from the day's end."""
    return F.date_trunc("day", day.cast("timestamp")) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND")


def known_by(published: Column, observed: Column, as_of: Column) -> Column:
    """Effective time (publication, else observation) not after as_of."""
    return F.coalesce(published, observed) <= as_of


def next_weekday(day: Column, name: str) -> Column:
    """The next such weekday after day, never the day itself."""
    return F.next_day(day, name)


def minute_bucket(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm")
