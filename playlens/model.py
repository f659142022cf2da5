"""What an analysis is about: scopes, date ranges, cohorts and the event tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from playlens.store import Store

USER = "user_pseudo_id"
TIME = "event_timestamp"
DAY = "event_date"
LABEL = "user_type"

_COMMON = (
    f"{TIME} bigint, {USER} string, {DAY} date, "
    "version string, country string, platform string"
)

# The flattened tables: the common columns plus what each event carries.
TABLE_SCHEMAS: dict[str, str] = {
    name: _COMMON + extra
    for name, extra in {
        "first_open": "",
        "session_start": "",
        "user_engagement": "",
        "start_level": ", mobile_name string, level bigint",
        "win_level": ", level bigint",
        "lose_level": ", level bigint",
        "in_app_purchase": ", event_value_in_usd double",
        "ads_reward_complete": ", placement string",
        "booster_use": ", level bigint, booster_type string",
        "af_rewarded": ", level bigint",
    }.items()
}


def quoted(text: str) -> str:
    """A string literal for SQL text."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


@dataclass(frozen=True)
class DateRange:
    """Calendar days from ``start`` to ``end``, both included (ISO text); without a start, all up to the end."""

    start: str | None
    end: str

    def contains(self, column: str = DAY) -> str:
        last = date.fromisoformat(self.end)
        if self.start is None:
            return f"{column} <= date'{last}'"
        return f"{column} between date'{date.fromisoformat(self.start)}' and date'{last}'"

    def until(self, days: int) -> DateRange:
        """Everything up to so many days after the end."""
        return DateRange(None, (date.fromisoformat(self.end) + timedelta(days=days)).isoformat())


@dataclass(frozen=True)
class Scope:
    """Which part of the game's traffic counts; an unset field does not restrict."""

    platform: str | None = None
    version: str | None = None
    countries: tuple[str, ...] = ()

    def conditions(self) -> dict[str, str]:
        """What each column must satisfy, as SQL text."""
        found = {}
        if self.platform is not None:
            found["platform"] = f"platform = {quoted(self.platform)}"
        if self.version is not None:
            found["version"] = f"version = {quoted(self.version)}"
        if self.countries:
            found["country"] = f"country in ({', '.join(map(quoted, self.countries))})"
        return found

    def worldwide(self) -> Scope:
        return replace(self, countries=())


@dataclass(frozen=True)
class SkillRule:
    """Skill is read from starts per level over levels 1 to ``level``.

    The defaults are fixed values, as the segments to be matched are cut.
    """

    level: int = 20
    best: float = 1.05
    worst: float = 1.35
    decimals: int = 2


@dataclass(frozen=True)
class CohortSpec:
    """A first-open cohort and the windows in which it is watched.

    ``first_open`` picks the cohort, ``regard`` is the daily-activity window and
    ``whole`` spans both.  Countries in ``scope`` restrict who belongs to the
    cohort and who counts as a payer; the exclusion of payers from the
    non-paying side ignores them.
    """

    scope: Scope
    first_open: DateRange
    regard: DateRange
    whole: DateRange
    skill: SkillRule = SkillRule()


ANYWHERE = Scope()


class EventTables:
    """The flattened event tables, read by name.

    ``load(name, columns)`` returns a DataFrame with at least these columns.  ``by_user`` says
    that all tables lie in the same number of buckets by user.
    """

    def __init__(self, load: Callable[[str, Sequence[str]], DataFrame], by_user: bool = False):
        self._load = load
        self.by_user = by_user

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> EventTables:
        """Tables written by :mod:`playlens.sources.ingest`, as they are when first asked for.

        A table that no manifest names is read from the folder ``root/table=NAME``.
        """
        store = Store(spark, root)

        @cache
        def table(name: str) -> DataFrame:
            stored = store.read(name, TABLE_SCHEMAS[name])
            if stored is None:
                stored = spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{root}/table={name}")
            return stored

        return cls(lambda name, columns: table(name))

    @classmethod
    def from_catalog(
        cls, spark: SparkSession, database: str | None = None, by_user: bool = False
    ) -> EventTables:
        """Tables or views of the session's catalog, named like the events."""
        prefix = "" if database is None else f"{database}."
        return cls(lambda name, columns: spark.table(f"{prefix}{name}"), by_user)

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> EventTables:
        return cls(lambda name, columns: frames[name])

    def get(
        self,
        name: str,
        *columns: str,
        scope: Scope = ANYWHERE,
        dates: DateRange | None = None,
    ) -> DataFrame:
        """``columns`` of one table, restricted to a scope and a range of days.

        Filters stay plain comparisons on stored columns, so that they reach the
        scan: days prune directories, the scope is pushed to the row groups.
        """
        conditions = scope.conditions()
        if dates is not None:
            conditions[DAY] = dates.contains()
        rows = self._load(name, tuple(dict.fromkeys([*columns, *conditions])))
        if conditions:
            rows = rows.filter(" and ".join(conditions.values()))
        return rows.select(*columns)
