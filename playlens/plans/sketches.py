"""Daily user counts that can be added up: sketches stored per day and merged for any window.

An exact count of a month's users reads every session of the month again.  A sketch of a
day's users has a fixed size, whatever their number, and the union of days is the sketch of
their users together, each counted once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.model import DAY, USER, DateRange, EventTables

#: What a daily sketch is kept for.
SPLIT = ("version", "platform")
#: Base-2 logarithm of a sketch's slots; the standard error is about 0.8 over the root of them, here 1.3 %.
SLOTS_LOG2 = 12


def daily_sketches(
    tables: EventTables,
    event: str = "session_start",
    dates: DateRange | None = None,
    by: Sequence[str] = SPLIT,
    slots_log2: int = SLOTS_LOG2,
) -> DataFrame:
    """``(event_date, *by, users)``: a sketch of the users of each day and kind.

    Every task makes sketches of its own rows, so a large day is a few rows per task in
    the shuffle.  Events without a user leave no trace in a sketch.
    """
    events = tables.get(event, USER, DAY, *by, dates=dates)
    return events.groupBy(DAY, *by).agg(F.hll_sketch_agg(USER, F.lit(slots_log2)).alias("users"))


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Store sketches by day; the days they hold replace what is stored of them, others stay."""
    rows = sketches.repartition(DAY)  # one row per kind and day
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)


def estimated_users(
    sketches: DataFrame, dates: DateRange | None = None, by: Sequence[str] = (), name: str = "num_user"
) -> DataFrame:
    """About how many different users there were in a window, split by some of the stored kinds."""
    if dates is not None:
        sketches = sketches.filter(dates.contains())
    together = F.hll_union_agg("users", F.lit(True))
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(together).alias(name))


def rolling_users(
    sketches: DataFrame, days: int = 7, by: Sequence[str] = (), name: str = "num_user"
) -> DataFrame:
    """About how many users there were in the ``days`` up to each day, and in no more than there are.

    A stored sketch is handed on to the windows it lies in: as many rows as sketches times days.
    """
    ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda n: F.date_add(DAY, n)))
    windows = sketches.select(*by, "users", ends.alias("window_end"))
    last = sketches.agg(F.max(DAY)).scalar()
    together = F.hll_sketch_estimate(F.hll_union_agg("users", F.lit(True)))
    return windows.filter(F.col("window_end") <= last).groupBy("window_end", *by).agg(together.alias(name))
