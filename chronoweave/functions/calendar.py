"""Calendar features of a timestamp, by the frequency of its series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> (function, least value, span): a feature is (value - least) / span - 0.5.
PARTS = {
    "second": (F.second, 0, 59), "minute": (F.minute, 0, 59), "hour": (F.hour, 0, 23), "day_of_week": (F.weekday, 0, 6), "day_of_month": (F.dayofmonth, 1, 30), "day_of_year": (F.dayofyear, 1, 365),
    "month": (F.month, 1, 11), "week": (F.weekofyear, 1, 52),
}
#: Frequency -> how many of the features, from the coarse end, tell its moments apart.
BY_FREQUENCY = {
    "y": [], "q": ["month"], "m": ["month"], "w": ["day_of_month", "week"], "d": ["day_of_week", "day_of_month", "day_of_year"], "b": ["day_of_week", "day_of_month", "day_of_year"],
    "h": ["hour", "day_of_week", "day_of_month", "day_of_year"], "t": ["minute", "hour", "day_of_week", "day_of_month", "day_of_year"], "s": ["second", "minute", "hour", "day_of_week", "day_of_month", "day_of_year"],
}


def scaled(name: str, ts: Column) -> Column:
    f, least, span = PARTS[name]
    return ((f(ts) - least) / F.lit(float(span)) - 0.5).alias(name)


def features(frequency: str, ts: Column) -> list[Column]:
    """The scaled features of a frequency such as ``h`` or ``15min``; ValueError for an unknown one."""
    unit = frequency.lower().lstrip("0123456789")
    unit = {"min": "t", "a": "y"}.get(unit, unit)
    if unit not in BY_FREQUENCY:
        raise ValueError(f"unknown frequency {frequency!r}")
    return [scaled(n, ts) for n in BY_FREQUENCY[unit]]


def raw(ts: Column) -> list[Column]:
    """month, day, weekday, hour and quarter of an hour as they are."""
    return [F.month(ts), F.dayofmonth(ts), F.weekday(ts), F.hour(ts), F.floor(F.minute(ts) / 15)]
