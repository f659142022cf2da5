"""Daily activity and retention."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.functions import ratio
from playlens.model import DAY, LABEL, USER, CohortSpec, DateRange, EventTables, Scope
from playlens.operators import (
    FewUsers,
    UserFilter,
    count_users,
    in_users,
    join_labels,
    memberships,
    pivot_labels,
    tag,
    with_baseline,
)

_MASK_DAYS = 60


def event_names(events: DataFrame) -> DataFrame:
    """The distinct event names in a raw log."""
    return events.select("event_name").distinct()


def dau(tables: EventTables, platform: str | None = None) -> DataFrame:
    """Distinct users with a session per day and version, newest day first."""
    sessions = tables.get(
        "session_start", USER, DAY, "version", scope=Scope(platform=platform)
    )
    return count_users(sessions, DAY, "version", name="daily_active_users").orderBy(
        F.desc(DAY), "version"
    )


def dau_by_platform(tables: EventTables, limit: int | None = None) -> DataFrame:
    """As :func:`dau`, split by platform; ``limit`` keeps the newest rows."""
    sessions = tables.get("session_start", USER, DAY, "version", "platform")
    daily = count_users(sessions, DAY, "version", "platform", name="daily_active_users").orderBy(
        F.desc(DAY), "version", "platform"
    )
    return daily if limit is None else daily.limit(limit)


def users_by_country(tables: EventTables, scope: Scope, more_than: int = 100) -> DataFrame:
    """Countries with more than so many engaged users, largest first."""
    engaged = tables.get("user_engagement", USER, "country", scope=scope)
    return (
        count_users(engaged, "country")
        .filter(F.col("num_user") > more_than)
        .orderBy(F.desc("num_user"), "country")
    )


def new_users(tables: EventTables, scope: Scope, dates: DateRange) -> DataFrame:
    """How many users opened the game for the first time in a window."""
    return count_users(tables.get("first_open", USER, scope=scope, dates=dates))


def engaged_non_payers(tables: EventTables, scope: Scope, dates: DateRange) -> DataFrame:
    """How many users were engaged in the scope's countries and paid nowhere."""
    engaged = tables.get("user_engagement", USER, scope=scope, dates=dates)
    payers = tables.get("in_app_purchase", USER, scope=scope.worldwide(), dates=dates)
    return (
        memberships(
            tag(engaged, engaged="true"),
            tag(payers, paid="true"),
            of_first=True,
            by_user=tables.by_user,
        )
        .filter("not paid")
        .agg(F.count(USER).alias("num_user"))
    )


def _active_days(
    tables: EventTables, spec: CohortSpec, labels: DataFrame, few_users: FewUsers = False
) -> DataFrame:
    """``(event_date, user_type, dau)`` in the activity window.

    A user's events of a day collapse to one row before labels are joined.
    """
    days = tables.get(
        "user_engagement", USER, DAY, scope=spec.scope.worldwide(), dates=spec.regard
    ).distinct()
    return join_labels(days, labels, few_users).groupBy(DAY, LABEL).agg(
        F.count(USER).alias("dau")
    )


def dau_by_label(
    tables: EventTables,
    spec: CohortSpec,
    labels: DataFrame,
    columns: Mapping[str, str],
    few_users: FewUsers = False,
) -> DataFrame:
    """Active users per day, a column per label."""
    daily = _active_days(tables, spec, labels, few_users)
    return pivot_labels(daily, DAY, columns, value=F.col("dau"), how=F.max).orderBy(DAY)


def dau_pct_by_label(
    tables: EventTables,
    spec: CohortSpec,
    labels: DataFrame,
    columns: Mapping[str, str],
    denominators: Mapping[str, int] | None = None,
    few_users: FewUsers = False,
    all_days: bool = False,
) -> DataFrame:
    """Active users per day in percent of their segment, a column per label.

    Segment sizes are counted from the labels; ``denominators`` overrides them
    with given numbers.  Days on which only users with a NULL label played stay, empty.  With
    ``all_days`` those on which only users without any label played do, too; the days are
    then read by themselves.
    """
    daily = _active_days(tables, spec, labels, few_users)
    if denominators is None:
        sizes = labels.groupBy(LABEL).agg(F.count(USER).alias("size"))
        daily = daily.join(sizes, LABEL, "left")
    else:
        size = F.coalesce(
            *(F.when(F.col(LABEL) == name, n) for name, n in denominators.items())
        )
        daily = daily.withColumn("size", size)
    percent = ratio(F.col("dau"), F.col("size"), 100)
    by_day = pivot_labels(daily, DAY, columns, value=percent, how=F.max)
    if all_days:
        played = tables.get(
            "user_engagement", USER, DAY, scope=spec.scope.worldwide(), dates=spec.regard
        )
        days = played.filter(f"{USER} is not null").select(DAY).distinct()
        by_day = days.join(by_day, DAY, "left")
    return by_day.orderBy(DAY)


def _first_opens(tables: EventTables, labelled: DataFrame) -> DataFrame:
    """``(user, label, first_open_date)`` of labelled users; other players' opens are dropped first."""
    opens = in_users(tables.get("first_open", USER, DAY), labelled)
    opened = opens.groupBy(USER).agg(F.min(DAY).alias("first_open_date"))
    return opened.join(labelled, USER)


def _day_masks(days: int) -> list[Column]:
    """Bits of the days since first open, from the set of a user's days, in words of 60."""

    def mask(word: int) -> Column:
        def with_day(bits: Column, day: Column) -> Column:
            bit = F.datediff(day, F.col("first_open_date")) - word * _MASK_DAYS
            one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
            return bits.bitwiseOR(F.when(bit.between(0, _MASK_DAYS - 1), one).otherwise(F.lit(0).cast("long")))

        return F.aggregate("played", F.lit(0).cast("long"), with_day)

    return [mask(word).alias(f"mask{word}") for word in range(days // _MASK_DAYS + 1)]


def retention(
    tables: EventTables,
    labels: DataFrame,
    days: int = 7,
    first_open: DateRange | None = None,
    few_users: FewUsers = False,
) -> DataFrame:
    """Users of each segment who were active ``day_number`` days after first open.

    ``first_open`` is the window in which all labelled users opened the game, if there
    is one: days past its end and ``days`` more can't matter and are not read.  Without it the
    first and last day that matter are asked of the labels and first opens when the
    query runs, so that both are best kept.

    Engagement is shuffled once: a user's days collapse to a set in every task, and the set
    becomes a bit mask of the days since first open, counted by position.
    """
    labelled = labels.filter(f"{LABEL} is not null")
    people = _first_opens(tables, labelled)
    dates = None if first_open is None else first_open.until(days)
    active = tables.get("user_engagement", USER, DAY, dates=dates)
    if first_open is None:
        first = people.agg(F.min("first_open_date")).scalar()
        last = people.agg(F.date_add(F.max("first_open_date"), days)).scalar()
        active = active.filter((F.col(DAY) >= first) & (F.col(DAY) <= last))
    if isinstance(few_users, UserFilter):
        active = few_users.keep(active)
    elif few_users:
        active = in_users(active, labelled)
    played = active.groupBy(USER).agg(F.collect_set(DAY).alias("played"))
    masks = played.join(people, USER).select(LABEL, *_day_masks(days))
    on_day = [
        F.count_if(F.call_function("bit_get", F.col(f"mask{n // _MASK_DAYS}"), F.lit(n % _MASK_DAYS)) == 1)
        for n in range(days + 1)
    ]
    counted = masks.groupBy(F.col(LABEL).alias("segment")).agg(F.array(*on_day).alias("counts"))
    return (
        counted.select("segment", F.posexplode("counts").alias("day_number", "retained_users"))
        .filter("retained_users > 0")
        .withColumn("day_number", F.col("day_number").cast("bigint"))
        .orderBy("segment", "day_number")
    )


def retention_rate(
    tables: EventTables,
    labels: DataFrame,
    days: int = 7,
    first_open: DateRange | None = None,
    few_users: FewUsers = False,
) -> DataFrame:
    """Adds retained users as a fraction of the segment's day-0 users."""
    retained = with_baseline(
        retention(tables, labels, days, first_open, few_users),
        "day_number",
        0,
        {"retained_users": "day0_users"},
        by=["segment"],
    )
    rate = ratio(F.col("retained_users"), F.col("day0_users"))
    return retained.withColumn("retention_rate", rate).drop("day0_users")
