"""Use of rewarded ads and boosters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions import ratio
from playlens.model import LABEL, USER, EventTables, Scope
from playlens.operators import FewUsers, count_users, join_labels, share_of_total
from playlens.plans.levels import counts_per_user_level
from playlens.plans.segments import BEST, WORST


def users_by_kind(
    tables: EventTables,
    event: str,
    kind: str,
    scope: Scope,
    labels: DataFrame,
    columns: Mapping[str, str],
    shares: Mapping[str, str],
    few_users: FewUsers = False,
    all_kinds: bool = False,
) -> DataFrame:
    """Distinct users per kind of event and label, and each kind's share in percent.

    Counts users, not events.  A user's repeats of a kind collapse before labels
    are joined; kinds that only users with a NULL label had stay, with 0.  With ``all_kinds``
    those of users who are not among the labels do, too, counted by themselves.
    """
    had = tables.get(event, USER, kind, scope=scope.worldwide()).distinct()
    counts = (
        join_labels(had, labels, few_users)
        .groupBy(kind)
        .agg(
            *(F.count_if(F.col(LABEL) == label).alias(name) for label, name in columns.items())
        )
    )
    if all_kinds:
        known = tables.get(event, USER, kind, scope=scope.worldwide()).filter(f"{USER} is not null")
        kinds, counts = known.select(kind).distinct(), counts.withColumnRenamed(kind, "had")
        counts = kinds.join(counts, F.col(kind).eqNullSafe(F.col("had")), "left").select(
            kind, *(F.coalesce(F.col(name), F.lit(0)).alias(name) for name in columns.values())
        )
    return share_of_total(counts, {columns[label]: name for label, name in shares.items()})


def ads_per_user_by_country(
    tables: EventTables, scope: Scope, more_than: int = 100
) -> DataFrame:
    """Reward ads and ads per level starter, in countries with enough ads."""
    ads = (
        tables.get("ads_reward_complete", "country", scope=scope)
        .groupBy("country")
        .agg(F.count("*").alias("num_ad_rw"))
        .filter(F.col("num_ad_rw") > more_than)
    )
    users = count_users(tables.get("start_level", USER, "country", scope=scope), "country")
    return ads.join(users, "country").select(
        "country", "num_ad_rw", ratio(F.col("num_ad_rw"), F.col("num_user")).alias("ad_per_user")
    )


def usage_by_level(
    tables: EventTables,
    labels: DataFrame,
    uses: Mapping[str, str],
    segments: tuple[str, ...] = (BEST, WORST),
    few_users: FewUsers = False,
) -> DataFrame:
    """Starters, starts and uses per level for each segment.

    ``uses`` maps a short name to its event table.  Uses at a level the user
    never started do not count; levels stay even if no segment reached them.
    Only users of the segments are joined and counted; the levels come by themselves.
    """
    per_user = counts_per_user_level(tables, {"started": "start_level", **uses})
    labelled = labels.filter(F.col(LABEL).isin(*segments))
    columns = []
    for segment in segments:
        mine = (F.col(LABEL) == segment) & (F.col("started") > 0)
        columns += [
            F.count(F.when(mine, F.col(USER))).alias(f"num_user_{segment}_start"),
            F.sum(F.when(mine, F.col("started"))).alias(f"num_start_{segment}"),
            *(F.sum(F.when(mine, F.col(use))).alias(f"num_{use}_{segment}") for use in uses),
        ]
    # No filter on the counts: it would keep the semi join from the scans.
    counted = join_labels(per_user, labelled, few_users).groupBy("level").agg(*columns)
    names = [c for c in counted.columns if c != "level"]
    counted = counted.withColumnRenamed("level", "reached")
    levels = tables.get("start_level", "level").distinct()
    return levels.join(counted, F.col("level").eqNullSafe(F.col("reached")), "left").select(
        "level", *(F.coalesce(F.col(name), F.lit(0)).alias(name) for name in names)
    )


def use_per_starter_by_level(
    tables: EventTables,
    labels: DataFrame,
    use: str,
    event: str,
    max_level: int | None = None,
    segments: tuple[str, ...] = (BEST, WORST),
    few_users: FewUsers = False,
) -> DataFrame:
    """:func:`usage_by_level` of one event, up to a level if given, with uses per starter."""
    usage = usage_by_level(tables, labels, {use: event}, segments, few_users)
    if max_level is not None:
        usage = usage.filter(f"level <= {max_level}")
    return usage.withColumns(
        {
            f"num_{use}_per_{segment}": ratio(
                F.col(f"num_{use}_{segment}"), F.col(f"num_user_{segment}_start")
            )
            for segment in segments
        }
    ).orderBy("level")


def overall_usage(
    tables: EventTables,
    labels: DataFrame,
    uses: Mapping[str, str],
    segments: tuple[str, ...] = (BEST, WORST),
    few_users: FewUsers = False,
) -> DataFrame:
    """Uses per started level of a user, over all levels, one row per segment.

    The denominator adds up each level's starters, so a user counts once for
    every level started.
    """
    per_user = counts_per_user_level(tables, {"started": "start_level", **uses})
    labelled = labels.filter(F.col(LABEL).isin(*segments))
    started = F.col("started") > 0
    starters = F.count(F.when(started, F.col(USER)))
    return (
        join_labels(per_user, labelled, few_users)
        .groupBy(F.col(LABEL).alias("segment"))
        .agg(
            starters.alias("starters"),
            *(ratio(F.sum(F.when(started, F.col(use))), starters).alias(f"{use}_per") for use in uses),
        )
        .filter("starters > 0")
        .drop("starters")
    )
