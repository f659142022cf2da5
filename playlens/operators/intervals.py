"""Level attempts as time intervals, and the attempt an event falls in.

An attempt lasts from a level start to the user's next start.  Finding either
end by a window over a whole user would put all rows of one user into one task.
Here every user is cut into time slices first: the heavy window runs per (user,
slice), and only one small row per slice and level travels on to the window
that looks across a user's slices.  How long that one gets is set by the time
span of the log, not by how many events a user has.  Slices are hours unless a
log is so dense that a user's hour is too much for one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions import time_bucket
from playlens.functions.columns import MICROS_PER_HOUR
from playlens.model import TIME, USER
from playlens.operators.sets import union

_SLICE = "slice"


def first_per_user(events: DataFrame, *carry: str) -> DataFrame:
    """Each user's earliest event: its time and the ``carry`` columns of that row.

    Repeats collapse before the shuffle: an aggregation, or with ``carry`` a limit of
    one row per user and task.  Of events at the same time the one with the
    smallest ``carry`` values counts.
    """
    known = events.filter(f"{USER} is not null and {TIME} is not null")
    if not carry:
        return known.groupBy(USER).agg(F.min(TIME).alias(TIME))
    place = F.row_number().over(Window.partitionBy(USER).orderBy(TIME, *carry))
    ranked = known.select(USER, TIME, *carry).withColumn("place", place)
    return ranked.filter("place = 1").drop("place")


def level_intervals(starts: DataFrame, slice_micros: int = MICROS_PER_HOUR) -> DataFrame:
    """``(user, level, level_start, next_start)`` for every start; the last one is open.

    Starts at the same instant follow each other by level.
    """
    number = time_bucket(F.col(TIME), slice_micros)
    in_slice = Window.partitionBy(USER, _SLICE).orderBy("level_start", "level")
    across = Window.partitionBy(USER).orderBy(_SLICE)
    rows = starts.filter(f"{USER} is not null").select(
        USER, "level", F.col(TIME).alias("level_start"), number.alias(_SLICE)
    )
    # Of each slice, when the user's next one begins: a row per user and slice.
    slices = (
        rows.groupBy(USER, _SLICE)
        .agg(F.min("level_start").alias("first_start"))
        .withColumn("next_slice_start", F.lead("first_start").over(across))
        .select(USER, _SLICE, "next_slice_start")
    )
    return (
        rows.withColumn("in_slice", F.lead("level_start").over(in_slice))
        .join(slices, [USER, _SLICE])
        .select(
            USER,
            "level",
            "level_start",
            F.coalesce("in_slice", "next_slice_start").alias("next_start"),
        )
    )


def attribute_to_level(
    points: DataFrame,
    starts: DataFrame,
    measures: Sequence[str],
    slice_micros: int = MICROS_PER_HOUR,
) -> DataFrame:
    """Sums the points' measures per user and level of the attempt they fall in.

    A point belongs to the last start at or before it; points before the first
    start belong nowhere and are left out.  Of starts at the same instant the
    highest level counts.

    Rows are spread by user and slice even if they come in already placed by
    user, say from a join.
    """
    rows = (
        union(
            starts.select(USER, TIME, F.struct("level").alias("start")),
            points.select(USER, TIME, *measures),
        )
        .filter(f"{USER} is not null")
        .withColumn(_SLICE, time_bucket(F.col(TIME), slice_micros))
        .repartition(USER, _SLICE)
    )
    so_far = (
        Window.partitionBy(USER, _SLICE)
        .orderBy(TIME, F.col("start").isNull(), "start")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    start_time = F.when(F.col("start").isNotNull(), F.col(TIME))
    # Within a group all starts have the group's level, so their last time is enough.
    per_slice = (
        rows.withColumn("here", F.last("start", ignorenulls=True).over(so_far))
        .groupBy(
            USER,
            _SLICE,
            F.col("here").isNotNull().alias("known"),
            F.col("here.level").alias("level_here"),
        )
        .agg(F.max(start_time).alias("last_time"), *(F.sum(m).alias(m) for m in measures))
    )
    earlier = (
        Window.partitionBy(USER).orderBy(_SLICE).rangeBetween(Window.unboundedPreceding, -1)
    )
    last_start = F.when(F.col("last_time").isNotNull(), F.struct("last_time", "level_here"))
    carried = F.max(last_start).over(earlier)
    has_points = F.coalesce(*measures).isNotNull()
    return (
        per_slice.withColumn("carried", carried)
        .filter(has_points & (F.col("known") | F.col("carried").isNotNull()))
        .withColumn("level", F.expr("if(known, level_here, carried.level_here)"))
        .groupBy(USER, "level")
        .agg(*(F.sum(m).alias(m) for m in measures))
    )
