"""Purchases: who pays, where, when and in which level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions import elapsed_days, ratio, time_bucket
from playlens.functions.columns import MICROS_PER_DAY, MICROS_PER_HOUR
from playlens.model import LABEL, TIME, USER, CohortSpec, DateRange, EventTables, Scope
from playlens.operators import (
    attribute_to_level,
    count_users,
    first_per_user,
    in_users,
    share_of_total,
    union,
)

# Amounts are added up as decimals: the same total whatever the order of tasks.
_MONEY = "decimal(28,12)"

# Tasks that one user's events may be dealt to.
_PARTS = 8


def pay_rate_by_country(tables: EventTables, scope: Scope, more_than: int = 100) -> DataFrame:
    """Engaged users, payers and their ratio, in countries with enough users."""
    users = count_users(tables.get("user_engagement", USER, "country", scope=scope), "country")
    payers = count_users(
        tables.get("in_app_purchase", USER, "country", scope=scope), "country", name="num_iap"
    )
    return (
        users.filter(F.col("num_user") > more_than)
        .join(payers, "country", "left")
        .withColumn("pay_rate", ratio(F.col("num_iap"), F.col("num_user")))
    )


def revenue_by_country(tables: EventTables, scope: Scope) -> DataFrame:
    """Revenue per country and its share in percent, highest first."""
    paid = tables.get("in_app_purchase", "country", "event_value_in_usd", scope=scope)
    revenue = paid.groupBy("country").agg(
        F.sum(F.col("event_value_in_usd").cast(_MONEY)).alias("revenue")
    )
    return (
        share_of_total(revenue, {"revenue": "share_pct"})
        .withColumn("revenue", F.col("revenue").cast("double"))
        .orderBy(F.desc("revenue"), "country")
    )


def _purchases(tables: EventTables, scope: Scope) -> DataFrame:
    return tables.get("in_app_purchase", USER, TIME, scope=scope)


def _starts(tables: EventTables, scope: Scope, slice_micros: int) -> DataFrame:
    """Level starts of users who bought something, before anything is sorted.

    A busy buyer counts once per time slice.  Grouping by user alone would place the
    buyers for the join, and Spark could not split the starts of a very busy one.
    """
    starts = tables.get("start_level", USER, TIME, "level", scope=scope)
    number = time_bucket(F.col(TIME), slice_micros).alias("slice")
    return in_users(starts, _purchases(tables, scope).select(USER, number).distinct())


def first_purchase_by_level(
    tables: EventTables, scope: Scope, slice_micros: int = MICROS_PER_HOUR
) -> DataFrame:
    """Users whose first purchase fell in an attempt at each level.

    ``slice_micros`` as in :mod:`playlens.operators.intervals`, here and below.
    """
    first = first_per_user(_purchases(tables, scope)).withColumn("first_purchases", F.lit(1))
    starts = _starts(tables, scope, slice_micros)
    attributed = attribute_to_level(first, starts, ["first_purchases"], slice_micros)
    return attributed.groupBy("level").agg(F.count(USER).alias("num_first_iap")).orderBy("level")


def purchases_by_level(
    tables: EventTables, scope: Scope, slice_micros: int = MICROS_PER_HOUR
) -> DataFrame:
    """Payers and purchases per level whose attempt they fell in."""
    bought = _purchases(tables, scope).groupBy(USER, TIME).agg(F.count("*").alias("purchases"))
    starts = _starts(tables, scope, slice_micros)
    attributed = attribute_to_level(bought, starts, ["purchases"], slice_micros)
    return (
        attributed.groupBy("level")
        .agg(F.count(USER).alias("num_iap_users"), F.sum("purchases").alias("num_purchases"))
        .orderBy("level")
    )


def purchases_vs_first(
    tables: EventTables,
    scope: Scope,
    below_level: int | None = None,
    slice_micros: int = MICROS_PER_HOUR,
) -> DataFrame:
    """All and first purchases per level side by side, 0 where there are none.

    Both kinds of purchase go through one attribution, so the level starts are
    sorted once and no level table has to be merged with another.
    """
    purchases = _purchases(tables, scope)
    points = union(
        purchases.groupBy(USER, TIME).agg(F.count("*").alias("purchases")),
        first_per_user(purchases).withColumn("first_purchases", F.lit(1)),
    ).na.fill(0, ["purchases", "first_purchases"])
    attributed = attribute_to_level(
        points,
        _starts(tables, scope, slice_micros),
        ["purchases", "first_purchases"],
        slice_micros,
    )
    if below_level is not None:
        attributed = attributed.filter(f"level < {below_level}")
    return (
        attributed.groupBy("level")
        .agg(
            F.count_if(F.col("purchases") > 0).alias("num_iap_users"),
            F.sum("purchases").alias("num_purchases"),
            F.count_if(F.col("first_purchases") > 0).alias("num_first_iap"),
        )
        .orderBy("level")
    )


def payer_count(tables: EventTables) -> DataFrame:
    """Distinct payers over everything."""
    return count_users(tables.get("in_app_purchase", USER))


def _of_buyers(events: DataFrame, tables: EventTables, scope: Scope) -> DataFrame:
    """Events of users who bought something; a user with very many of them is dealt to several tasks."""
    part = F.pmod(F.xxhash64(TIME), F.lit(_PARTS)).cast("int").alias("part")
    parts = F.explode(F.array(*map(F.lit, range(_PARTS)))).alias("part")
    buyers = _purchases(tables, scope).select(USER).distinct().select(USER, parts)
    return events.select("*", part).join(buyers, [USER, "part"], "left_semi").drop("part")


def days_to_first_purchase(tables: EventTables, scope: Scope) -> DataFrame:
    """Users by whole days between first open and first purchase.

    A user with several first opens counts once for each distinct distance.  Installs of
    the many who never bought go first.  Only the earliest and the latest of a day go on to
    the join: opens between them are as many whole days away as one of the two.
    """
    first = first_per_user(_purchases(tables, scope)).withColumnRenamed(TIME, "paid_at")
    day = time_bucket(F.col(TIME), MICROS_PER_DAY)
    opened = (
        _of_buyers(tables.get("first_open", USER, TIME, scope=scope), tables, scope)
        .groupBy(USER, day)
        .agg(F.array(F.min(TIME), F.max(TIME)).alias("opens"))
        .select(USER, F.explode("opens").alias(TIME))
    )
    days = elapsed_days(F.col(TIME), F.col("paid_at")).alias("days")
    waited = opened.join(first, USER).select(USER, days)
    return count_users(waited, "days", name="num_users").orderBy("days")


def _payers_by_segment(
    tables: EventTables, scope: Scope, dates: DateRange, labels: DataFrame
) -> DataFrame:
    """Per segment its payers in a window and its size, from one pass over the labels."""
    paid = (
        tables.get("in_app_purchase", USER, scope=scope, dates=dates)
        .distinct()
        .withColumn("paid", F.lit(1))
    )
    return (
        labels.filter(f"{LABEL} is not null")
        .join(paid, USER, "left")
        .groupBy(F.col(LABEL).alias("segment"))
        .agg(F.count("paid").alias("num_payer"), F.count(USER).alias("num_user"))
    )


def pay_counts_by_segment(tables: EventTables, spec: CohortSpec, labels: DataFrame) -> DataFrame:
    """Payers and size of every segment as ``(metric, num_user)`` rows."""
    counts = _payers_by_segment(tables, spec.scope, spec.whole, labels)
    payers = counts.select(
        F.concat("segment", F.lit("_iap")).alias("metric"), F.col("num_payer").alias("num_user")
    )
    sizes = counts.select(F.col("segment").alias("metric"), "num_user")
    return payers.unionByName(sizes)


def pay_rate_by_segment(tables: EventTables, spec: CohortSpec, labels: DataFrame) -> DataFrame:
    """Payers, size and payers in percent of the segment."""
    counts = _payers_by_segment(tables, spec.scope, spec.whole, labels)
    return counts.withColumn("pay_rate", ratio(F.col("num_payer"), F.col("num_user"), 100))


def paying_members(tables: EventTables, spec: CohortSpec, users: DataFrame) -> DataFrame:
    """Distinct payers in the whole window among a set of users."""
    paid = tables.get("in_app_purchase", USER, scope=spec.scope, dates=spec.whole).distinct()
    return in_users(paid, users).agg(F.count(USER).alias("num_user"))
