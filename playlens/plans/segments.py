"""Who the players are: cohorts, user lists and segment labels.

Every label relation is ``(user_pseudo_id, user_type)`` with one row per user.
Unless stated otherwise it is built from one union of tagged events and one
aggregation per user, whatever the number of sets that decide on the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions import elapsed_days, ratio
from playlens.model import LABEL, TIME, USER, CohortSpec, DateRange, EventTables
from playlens.operators import (
    in_users,
    label_by_membership,
    memberships,
    segment_users,
    share_of_total,
    tag,
    union,
)

# The labels that results carry.
IAP, NON_IAP = "iap", "non_iap"
AD, NON_AD = "adrw", "non_adrw"
BEST, MIDDLE, WORST = "best", "bete", "worst"


def _cohort_events(tables: EventTables, spec: CohortSpec) -> DataFrame:
    return tables.get("first_open", USER, scope=spec.scope, dates=spec.first_open)


def cohort(tables: EventTables, spec: CohortSpec) -> DataFrame:
    """Users whose first open lies in the cohort window."""
    return _cohort_events(tables, spec).filter(f"{USER} is not null").distinct()


def _actors(
    tables: EventTables, spec: CohortSpec, event: str, dates: DateRange | None
) -> DataFrame:
    """Users of one event, telling those in the spec's countries from the others."""
    columns = [USER, "country"] if spec.scope.countries else [USER]
    events = tables.get(event, *columns, scope=spec.scope.worldwide(), dates=dates)
    in_countries = spec.scope.conditions().get("country", "true")
    return tag(events, acted=in_countries, acted_anywhere="true")


def payer_lists(tables: EventTables, spec: CohortSpec) -> DataFrame:
    """Cohort users who paid in the whole window, and those engaged who did not.

    Payers must have paid in the spec's countries; paying anywhere keeps a user
    off the non-paying list.
    """
    engaged = tables.get("user_engagement", USER, scope=spec.scope, dates=spec.whole)
    users = memberships(
        tag(_cohort_events(tables, spec), cohort="true"),
        tag(engaged, engaged="true"),
        _actors(tables, spec, "in_app_purchase", spec.whole),
        of_first=True,
        by_user=tables.by_user,
    ).filter("acted or engaged and not acted_anywhere")
    return label_by_membership(users, {IAP: "acted"}, otherwise=NON_IAP)


def payer_users(tables: EventTables, spec: CohortSpec) -> DataFrame:
    return segment_users(payer_lists(tables, spec), IAP)


def non_payer_users(tables: EventTables, spec: CohortSpec) -> DataFrame:
    return segment_users(payer_lists(tables, spec), NON_IAP)


def ad_lists(tables: EventTables, spec: CohortSpec) -> DataFrame:
    """Cohort users with and without a completed reward ad, at any time."""
    ads = tables.get("ads_reward_complete", USER, scope=spec.scope)
    users = memberships(
        tag(_cohort_events(tables, spec), cohort="true"),
        tag(ads, acted="true"),
        of_first=True,
        by_user=tables.by_user,
    )
    return label_by_membership(users, {AD: "acted"}, otherwise=NON_AD)


def ad_users(tables: EventTables, spec: CohortSpec) -> DataFrame:
    return segment_users(ad_lists(tables, spec), AD)


def non_ad_users(tables: EventTables, spec: CohortSpec) -> DataFrame:
    return segment_users(ad_lists(tables, spec), NON_AD)


def _engaged_segments(
    tables: EventTables,
    spec: CohortSpec,
    event: str,
    labels: tuple[str, str],
    engaged_dates: DateRange | None,
) -> DataFrame:
    """Labels every engaged user by whether they did ``event`` in the whole window.

    Users outside the cohort, and those who acted only outside the spec's
    countries, keep a NULL label.
    """
    engaged = tables.get(
        "user_engagement", USER, scope=spec.scope.worldwide(), dates=engaged_dates
    )
    users = memberships(
        tag(engaged, engaged="true"),
        tag(_cohort_events(tables, spec), cohort="true"),
        _actors(tables, spec, event, spec.whole),
        of_first=True,
        by_user=tables.by_user,
    )
    acted, did_not = labels
    return label_by_membership(
        users,
        {
            acted: "cohort and acted",
            did_not: "cohort and not acted_anywhere",
        },
    )


def _engaged_cohort_labels(
    tables: EventTables,
    spec: CohortSpec,
    event: str,
    labels: tuple[str, str],
    engaged_dates: DateRange | None,
) -> DataFrame:
    """The labelled rows of :func:`_engaged_segments`, which are all of the cohort.

    Engagement and events shrink to users, and those to the cohort, before any set meets
    another.  If the cohort is small enough to send around, Spark drops other players at the
    scans.
    """
    members = cohort(tables, spec)
    engaged = tables.get(
        "user_engagement", USER, scope=spec.scope.worldwide(), dates=engaged_dates
    )
    acted = _actors(tables, spec, event, spec.whole)
    users = memberships(
        tag(in_users(engaged.distinct(), members), engaged="true"),
        in_users(acted.distinct(), members),
        of_first=True,
        by_user=tables.by_user,
    )
    yes, no = labels
    rules = {yes: "acted", no: "not acted_anywhere"}
    return label_by_membership(users, rules).filter(f"{LABEL} is not null")


def payer_labels(tables: EventTables, spec: CohortSpec) -> DataFrame:
    """The users whom :func:`payer_segments` labels, without the rest of the world."""
    return _engaged_cohort_labels(tables, spec, "in_app_purchase", (IAP, NON_IAP), None)


def ad_labels(
    tables: EventTables, spec: CohortSpec, engaged_any_time: bool = False
) -> DataFrame:
    """The users whom :func:`ad_segments` labels."""
    dates = None if engaged_any_time else spec.whole
    return _engaged_cohort_labels(tables, spec, "ads_reward_complete", (AD, NON_AD), dates)


def payer_segments(tables: EventTables, spec: CohortSpec) -> DataFrame:
    """Engaged users as ``iap``, ``non_iap`` or NULL."""
    return _engaged_segments(tables, spec, "in_app_purchase", (IAP, NON_IAP), None)


def ad_segments(
    tables: EventTables, spec: CohortSpec, engaged_any_time: bool = False
) -> DataFrame:
    """Engaged users as ``adrw``, ``non_adrw`` or NULL.

    Unlike :func:`ad_lists` this is bound to the whole window and to engagement.
    """
    dates = None if engaged_any_time else spec.whole
    return _engaged_segments(tables, spec, "ads_reward_complete", (AD, NON_AD), dates)


def cohort_payer_labels(tables: EventTables, spec: CohortSpec) -> DataFrame:
    """Cohort users as ``iap`` if they ever paid in scope, else ``non_iap``."""
    paid = tables.get("in_app_purchase", USER, scope=spec.scope)
    users = memberships(
        tag(_cohort_events(tables, spec), cohort="true"),
        tag(paid, acted="true"),
        of_first=True,
        by_user=tables.by_user,
    )
    return label_by_membership(users, {IAP: "acted"}, otherwise=NON_IAP)


def cohort_split_counts(tables: EventTables, spec: CohortSpec) -> DataFrame:
    """How many cohort users ever paid and how many did not."""
    labels = cohort_payer_labels(tables, spec)
    return labels.groupBy(LABEL).agg(F.count(USER).alias("num_user"))


def segment_sizes(labels: DataFrame) -> DataFrame:
    """Users per label and their share of all labelled users."""
    sizes = labels.filter(f"{LABEL} is not null").groupBy(F.col(LABEL).alias("segment"))
    return share_of_total(
        sizes.agg(F.count(USER).alias("num_user")), {"num_user": "share_pct"}
    )


def attempt_ratio(
    tables: EventTables, spec: CohortSpec, decimals: int | None = None
) -> DataFrame:
    """Starts per level, up to the rule's level, of cohort users who won that far.

    One aggregation per user decides on the cohort, the win and the starts.
    """
    level = spec.skill.level
    wins = tables.get("win_level", USER, "level", scope=spec.scope)
    starts = tables.get("start_level", USER, "level", scope=spec.scope)
    rows = union(
        tag(_cohort_events(tables, spec), cohort="true"),
        tag(wins.filter(f"level >= {level}"), won="true"),
        tag(starts.filter(f"level <= {level}"), started="true"),
    )
    places = spec.skill.decimals if decimals is None else decimals
    return (
        rows.filter(f"{USER} is not null")
        .groupBy(USER)
        .agg(
            F.bool_or("cohort").alias("cohort"),
            F.bool_or("won").alias("won"),
            F.count("started").alias("starts"),
        )
        .filter("cohort and won and starts > 0")
        .select(USER, F.round(ratio(F.col("starts"), F.lit(level)), places).alias("start_time"))
    )


def skill_segments(tables: EventTables, spec: CohortSpec) -> DataFrame:
    """Users with an attempt ratio as ``best``, ``worst`` or the middle."""
    rules = {
        BEST: f"start_time <= {float(spec.skill.best)}D",
        WORST: f"start_time >= {float(spec.skill.worst)}D",
    }
    return label_by_membership(attempt_ratio(tables, spec), rules, otherwise=MIDDLE)


def booster_segments(tables: EventTables, spec: CohortSpec, min_uses: int = 1) -> DataFrame:
    """Cohort users as ``booster`` from ``min_uses`` booster uses on, else ``non_booster``."""
    uses = tables.get("booster_use", USER, scope=spec.scope)
    rows = union(tag(_cohort_events(tables, spec), cohort="true"), tag(uses, used="true"))
    users = (
        rows.filter(f"{USER} is not null")
        .groupBy(USER)
        .agg(F.bool_or("cohort").alias("cohort"), F.count("used").alias("uses"))
        .filter("cohort")
    )
    return label_by_membership(
        users, {"booster": f"uses >= {min_uses}"}, otherwise="non_booster"
    )


def _before_level(
    tables: EventTables, spec: CohortSpec, event: str, level: int, labels: tuple[str, str]
) -> DataFrame:
    """Labels cohort users by whether ``event`` came before they reached ``level``."""
    events = tables.get(event, USER, TIME, scope=spec.scope)
    starts = tables.get("start_level", USER, TIME, "level", scope=spec.scope)
    rows = union(
        tag(_cohort_events(tables, spec), cohort="true"),
        tag(events, acted_at=TIME),
        tag(starts.filter(f"level >= {level}"), reached_at=TIME),
    )
    early, other = labels
    users = (
        rows.filter(f"{USER} is not null")
        .groupBy(USER)
        .agg(
            F.bool_or("cohort").alias("cohort"),
            F.min("acted_at").alias("acted_at"),
            F.min("reached_at").alias("reached_at"),
        )
        .filter("cohort")
    )
    in_time = "acted_at is not null and (reached_at is null or acted_at < reached_at)"
    return label_by_membership(users, {early: in_time}, otherwise=other)


def early_ad_segments(tables: EventTables, spec: CohortSpec, level: int = 20) -> DataFrame:
    """Cohort users as ``adrw`` if they watched a reward ad before reaching ``level``."""
    return _before_level(tables, spec, "ads_reward_complete", level, (AD, NON_AD))


def early_payer_segments(tables: EventTables, spec: CohortSpec, days: int = 7) -> DataFrame:
    """Cohort users as ``iap`` if they paid within ``days`` of their first open."""
    opened = tables.get("first_open", USER, TIME, scope=spec.scope, dates=spec.first_open)
    paid = tables.get("in_app_purchase", USER, TIME, scope=spec.scope)
    rows = union(tag(opened, opened_at=TIME), tag(paid, paid_at=TIME))
    waited = elapsed_days(F.col("opened_at"), F.col("paid_at"))
    return (
        rows.filter(f"{USER} is not null")
        .groupBy(USER)
        .agg(F.min("opened_at").alias("opened_at"), F.min("paid_at").alias("paid_at"))
        .filter("opened_at is not null")
        .select(USER, F.when(waited <= days, IAP).otherwise(NON_IAP).alias(LABEL))
    )


def early_payer_level_segments(
    tables: EventTables, spec: CohortSpec, level: int = 100
) -> DataFrame:
    """The other cut for early payers: paid before reaching ``level``."""
    return _before_level(tables, spec, "in_app_purchase", level, (IAP, NON_IAP))
