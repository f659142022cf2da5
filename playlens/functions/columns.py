"""Column expressions shared by the analyses; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def event_param(key: str, slot: str = "string_value", params: str = "event_params") -> Column:
    """The value stored under ``key`` in a key/value array, NULL when there is none."""
    found = F.filter(F.col(params), lambda entry: entry["key"] == key)
    return F.get(found, F.lit(0))["value"][slot]


def checked(text: Column, value: Column, what: str, strict: bool = True) -> Column:
    """``value`` as read from ``text``; where it could not be read, an error or NULL if not ``strict``.

    ``value`` must come from a ``try_`` function, so that neither depends on the session's
    ANSI setting.
    """
    if not strict:
        return value
    message = F.concat(F.lit(f"{what} can't be read: "), text.cast("string"))
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value)


def parse_event_date(day: Column, strict: bool = True) -> Column:
    """A date from its ``YYYYMMDD`` form, text or number; an unreadable one is an error or NULL."""
    text = day.cast("string")
    return checked(text, F.try_to_date(text, "yyyyMMdd"), "event_date", strict)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days between two epoch-microsecond columns, cut toward zero."""
    return F.call_function("div", end - start, F.lit(MICROS_PER_DAY))


def calendar_days(start: Column, end: Column) -> Column:
    """Midnights crossed between two dates."""
    return F.datediff(end, start).cast("bigint")


def ratio(part: Column, whole: Column, scale: float | None = None) -> Column:
    """``part / whole`` as a double, NULL when ``whole`` is 0; ``scale=100`` for percent."""
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return value if scale is None else value * F.lit(float(scale))


def band(percent: Column, low: float = 35, high: float = 75) -> Column:
    """``low`` up to the lower bound, ``high`` from the upper one, ``mid`` between."""
    return (
        F.when(percent <= low, "low").when(percent >= high, "high").when(percent.isNotNull(), "mid")
    )


def time_bucket(micros: Column, width: int) -> Column:
    """Number of the time slice an epoch-microsecond value falls in."""
    return F.call_function("div", micros, F.lit(width))
