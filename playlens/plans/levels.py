"""Level outcomes, win rate, attempts per user, funnels and skill distribution."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.functions import band, ratio
from playlens.model import LABEL, USER, CohortSpec, EventTables
from playlens.operators import (
    FewUsers,
    centered_mean,
    cumulative_distribution,
    join_labels,
    pivot_labels,
    union,
    with_baseline,
)


def user_max_level(tables: EventTables, user: str | None = None) -> DataFrame:
    """The highest level each user started, or only one user's."""
    starts = tables.get("start_level", USER, "level").filter(f"{USER} is not null")
    if user is not None:
        starts = starts.filter(F.col(USER) == user)
    return starts.groupBy(USER).agg(F.max("level").alias("max_level"))


def counts_per_user_level(tables: EventTables, events: Mapping[str, str]) -> DataFrame:
    """How often each user had each event at each level; ``events`` maps column to table.

    Only levels started by the user count: ``started`` must be among the columns.
    An event without a level belongs to no start, not even to one without a level.
    """
    rows = [
        tables.get(table, USER, "level")
        .filter("true" if column == "started" else "level is not null")
        .selectExpr(USER, "level", f"1 as {column}")
        for column, table in events.items()
    ]
    return union(*rows).groupBy(USER, "level").agg(*(F.count(c).alias(c) for c in events))


_OUTCOMES = {"started": "start_level", "won": "win_level", "lost": "lose_level"}


def _outcome_totals(started: str = "started") -> list[Column]:
    return [
        F.count(F.when(F.col(started) > 0, F.col(USER))).alias("user_start"),
        F.sum(started).alias("event_start"),
        F.sum("won").alias("event_win"),
        F.sum("lost").alias("event_lose"),
    ]


def level_outcomes(tables: EventTables) -> DataFrame:
    """Starters, starts, wins and losses of every level that was started.

    The three event tables meet in one aggregation per user and level and one
    per level; a level's size or a user's zeal only shows as already-counted rows.
    """
    return (
        counts_per_user_level(tables, _OUTCOMES)
        .groupBy("level")
        .agg(*_outcome_totals())
        .filter("event_start > 0")
        .orderBy("level")
    )


def level_outcomes_by_label(
    tables: EventTables,
    labels: DataFrame,
    max_level: int | None = None,
    few_users: FewUsers = False,
) -> DataFrame:
    """:func:`level_outcomes` of each segment, with win rate and attempts per user.

    ``few_users`` as in :func:`playlens.operators.sets.join_labels`, here and below.
    """
    labelled = labels.filter(f"{LABEL} is not null")
    outcomes = (
        join_labels(counts_per_user_level(tables, _OUTCOMES), labelled, few_users)
        .groupBy(F.col(LABEL).alias("segment"), "level")
        .agg(*_outcome_totals())
        .filter("event_start > 0")
    )
    if max_level is not None:
        outcomes = outcomes.filter(f"level <= {max_level}")
    return outcomes.withColumns(
        {
            "winrate": ratio(F.col("event_win"), F.col("event_win") + F.col("event_lose")),
            "apu": ratio(F.col("event_start"), F.col("user_start")),
        }
    )


def winrate_by_label(
    tables: EventTables,
    labels: DataFrame,
    max_level: int | None = None,
    few_users: FewUsers = False,
) -> DataFrame:
    outcomes = level_outcomes_by_label(tables, labels, max_level, few_users).drop("apu")
    return outcomes.orderBy("segment", "level")


def winrate_rolling_by_label(
    tables: EventTables,
    labels: DataFrame,
    max_level: int | None = None,
    few_users: FewUsers = False,
) -> DataFrame:
    """Win rate averaged over five neighbouring levels, cut to ``max_level`` first if given."""
    outcomes = level_outcomes_by_label(tables, labels, max_level, few_users)
    smooth = centered_mean(outcomes, {"winrate": "rolling_winrate"}, "level", by=["segment"])
    return smooth.select("segment", "level", "rolling_winrate").orderBy("segment", "level")


def apu_by_label(
    tables: EventTables,
    labels: DataFrame,
    max_level: int | None = None,
    few_users: FewUsers = False,
) -> DataFrame:
    """Attempts per user, as they are and averaged over five neighbouring levels."""
    outcomes = level_outcomes_by_label(tables, labels, max_level, few_users)
    smooth = centered_mean(outcomes, {"apu": "rolling_apu"}, "level", by=["segment"])
    return smooth.select("segment", "level", "apu", "rolling_apu").orderBy("segment", "level")


def level_curves_by_label(
    tables: EventTables,
    labels: DataFrame,
    max_level: int | None = None,
    few_users: FewUsers = False,
) -> DataFrame:
    """Win rate and attempts per user, both also smoothed, from one pass."""
    outcomes = level_outcomes_by_label(tables, labels, max_level, few_users)
    smooth = {"winrate": "rolling_winrate", "apu": "rolling_apu"}
    return centered_mean(outcomes, smooth, "level", by=["segment"]).orderBy("segment", "level")


def level_users_by_label(
    tables: EventTables,
    spec: CohortSpec,
    labels: DataFrame,
    columns: Mapping[str, str],
    few_users: FewUsers = False,
) -> DataFrame:
    """Users who started each level in the whole window, a column per label.

    Levels that one of the labels never reached are left out.
    """
    reached = (
        tables.get("start_level", USER, "level", scope=spec.scope.worldwide(), dates=spec.whole)
        .filter("level is not null")
        .distinct()
    )
    named = labels.filter(F.col(LABEL).isin(*columns))
    per_level = pivot_labels(join_labels(reached, named, few_users), "level", columns)
    return per_level.na.drop(subset=list(columns.values()))


def level_split_by_label(
    tables: EventTables,
    spec: CohortSpec,
    labels: DataFrame,
    columns: Mapping[str, str],
    shares: Mapping[str, str],
    below_level: int | None = None,
    few_users: FewUsers = False,
) -> DataFrame:
    """Users per level with their total and each label's percentage of it."""
    users = level_users_by_label(tables, spec, labels, columns, few_users)
    if below_level is not None:
        users = users.filter(f"level < {below_level}")
    total = sum((F.col(c) for c in columns.values()), F.lit(0))
    return (
        users.withColumn("total", total)
        .withColumns(
            {
                shares[label]: ratio(F.col(column), F.col("total"), 100)
                for label, column in columns.items()
            }
        )
        .orderBy("level")
    )


def funnel_by_label(
    tables: EventTables,
    spec: CohortSpec,
    labels: DataFrame,
    columns: Mapping[str, str],
    remaining: Mapping[str, str],
    few_users: FewUsers = False,
) -> DataFrame:
    """Users per level and label, and the fraction still there of those at level 1.

    ``remaining`` names the fractions.  They are NULL if nobody started level 1.
    """
    users = level_users_by_label(tables, spec, labels, columns, few_users)
    first_level = {column: f"num_{column}_in_lv1" for column in columns.values()}
    funnel = with_baseline(users, "level", 1, first_level)
    return funnel.withColumns(
        {
            remaining[label]: ratio(F.col(column), F.col(first_level[column]))
            for label, column in columns.items()
        }
    ).orderBy("level")


def attempt_ratio_distribution(attempts: DataFrame) -> DataFrame:
    """Users per attempt ratio, from 1 start per level on."""
    return (
        attempts.filter(F.col("start_time") >= 1)
        .groupBy("start_time")
        .agg(F.count(USER).alias("num_user"))
        .orderBy("start_time")
    )


def attempt_ratio_cumulative(attempts: DataFrame, half_even: bool = False) -> DataFrame:
    """Adds running users, their percentage and its band to the distribution.

    ``half_even`` as in :func:`playlens.operators.shape.cumulative_distribution`.

    There is one row per different ratio.  Each ratio stands for a different
    number of starts, so even N starts make fewer than the root of 2N rows.
    """
    spread = cumulative_distribution(
        attempt_ratio_distribution(attempts), "start_time", "num_user", half_even
    )
    return spread.withColumn("band", band(F.col("pct_accumulate")))
