"""The test tables seen as a game-event log.

``events`` joined to ``customer`` and ``nation`` plays the raw log; each event
table is a filter over it.  Only meant for tests, the bench and the checks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.model import DAY, TIME, USER, CohortSpec, DateRange, EventTables, Scope, SkillRule

SPEC = CohortSpec(
    scope=Scope(platform="IOS", version="1.0.5"),
    first_open=DateRange("2024-01-01", "2024-01-04"),
    regard=DateRange("2024-01-05", "2024-01-30"),
    whole=DateRange("2024-01-01", "2024-01-30"),
    skill=SkillRule(level=5),
)

_EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)
_CUSTOMER = "c_custkey bigint, c_nationkey int, c_mktsegment string"
_NATION = "n_nationkey int, n_name string"


# Rows of the log that make up each event table.
_ROWS = {
    "user_engagement": "true",
    "session_start": "event_type = 'view'",
    "start_level": "event_type = 'view'",
    "win_level": "event_type = 'click'",
    "lose_level": "event_type = 'error'",
    "in_app_purchase": "event_type = 'purchase' and value >= 200",
    "ads_reward_complete": "event_type = 'error' and value >= 150",
    "booster_use": "event_type = 'signup' and value < 20",
    "af_rewarded": "event_type = 'click' and value >= 100",
}

# Which raw event name an event type stands for when the log is nested again.
RAW_NAMES = {
    "view": "start_level",
    "click": "win_level",
    "error": "lose_level",
    "purchase": "in_app_purchase",
    "signup": "booster_use",
}


_K = "cast(get_json_object(props, '$.k') as bigint)"

# ``ts`` has no zone and is read as UTC, whatever zone the session is in.
_DERIVED = {
    USER: "cast(user_id as string)",
    TIME: "unix_micros(cast(convert_timezone('UTC', current_timezone(), ts) as timestamp))",
    DAY: "cast(ts as date)",
    "level": f"{_K} % 10 + 1",
    "platform": "if(user_id % 4 = 0, 'ANDROID', 'IOS')",
    "version": "if(user_id % 5 = 0, '1.0.4', '1.0.5')",
    "event_value_in_usd": "value",
    "placement": f"concat('p', {_K} % 4)",
    "booster_type": f"concat('b', {_K} % 3)",
    "country": "n_name",
    "mobile_name": "c_mktsegment",
}
_FROM_CUSTOMER = {"country", "mobile_name"}

# A harder log from the same rows: a third of the events are of one user, a seventh of
# nobody, there are 100 levels, and times are cut to whole hours, so that many are equal.
_HARD = {
    USER: "case when event_id % 7 = 0 then null when event_id % 3 = 0 then '1' "
    "else cast(user_id as string) end",
    TIME: f"({_DERIVED[TIME]} div 3600000000) * 3600000000",
    "level": f"{_K} % 100 + 1",
}


class _Log:
    """The test tables, each opened once."""

    def __init__(self, spark: SparkSession, sf_dir: str, hard: bool = False):
        self._spark = spark
        self._dir = sf_dir
        self._hard = hard
        self._derived = {**_DERIVED, **(_HARD if hard else {})}

    def _table(self, name: str, schema: str) -> DataFrame:
        return self._spark.read.schema(schema).parquet(f"{self._dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self._table("events", _EVENTS)

    @cached_property
    def first_opens(self) -> DataFrame:
        signups = self.events.filter("event_type = 'signup'")
        if self._hard:  # every signup opens the game anew
            return signups
        return signups.groupBy("user_id").agg(F.min("ts").alias("ts"))

    @cached_property
    def customers(self) -> DataFrame:
        customer = self._table("customer", _CUSTOMER).withColumnRenamed("c_custkey", "user_id")
        nation = self._table("nation", _NATION)
        return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")

    def select(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Only the wanted columns; customers are joined if one of theirs is among them."""
        if _FROM_CUSTOMER.intersection(columns):
            rows = rows.join(self.customers, "user_id", "left")
        return rows.selectExpr(*(f"{self._derived.get(c, c)} as {c}" for c in columns))


def bind(spark: SparkSession, sf_dir: str, hard: bool = False) -> EventTables:
    """The event tables of one scale factor; ``hard`` for the harder log."""
    log = _Log(spark, sf_dir, hard)

    def load(name: str, columns: Sequence[str]) -> DataFrame:
        if name == "first_open":
            return log.select(log.first_opens, columns)
        return log.select(log.events.filter(_ROWS[name]), columns)

    return EventTables(load)


def raw_log(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    """The log in its nested form, with a ``shard`` column for the day.

    All parameters are text, or if ``typed`` levels are in the slot of whole numbers.
    """
    columns = list(_DERIVED)
    log = _Log(spark, sf_dir)
    flat = log.select(log.events, [*columns, "event_type"])
    day = F.date_format(DAY, "yyyyMMdd")
    name = F.coalesce(*(F.when(F.col("event_type") == k, n) for k, n in RAW_NAMES.items()))

    def param(key: str) -> Column:
        text, none = F.col(key).cast("string"), F.lit(None)
        slots = [text.alias("string_value")]
        if typed:
            whole = key == "level"
            slots = [
                (none.cast("string") if whole else text).alias("string_value"),
                (F.col(key) if whole else none).cast("bigint").alias("int_value"),
            ]
        return F.struct(F.lit(key).alias("key"), F.struct(*slots).alias("value"))

    return flat.select(
        day.alias("event_date"),
        TIME,
        name.alias("event_name"),
        USER,
        "platform",
        "event_value_in_usd",
        F.struct("version").alias("app_info"),
        F.struct("country").alias("geo"),
        F.struct(F.col("mobile_name").alias("mobile_model_name")).alias("device"),
        F.array(param("placement"), param("booster_type"), param("level")).alias("event_params"),
        day.cast("int").alias("shard"),
    )
