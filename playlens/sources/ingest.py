"""Flattening of the nested event log into partitioned event tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.functions import checked, event_param, parse_event_date
from playlens.model import DAY, TABLE_SCHEMAS, TIME, USER, EventTables
from playlens.store import Entry, Store, refuse_other_layout, replaced

# The slots of a parameter's value in the export, of which one is filled, and their types.
SLOTS = {"string_value": "string", "int_value": "bigint", "float_value": "float", "double_value": "double"}


@dataclass(frozen=True)
class Param:
    """A parameter of an event: the type it is stored in, and the slot of the export it comes from."""

    type: str
    slot: str = "string_value"


Params = Mapping[str, "str | Param"]

# Parameters each event carries; a type alone stands for the text slot.
EVENT_PARAMS: dict[str, Params] = {
    "start_level": {"level": "bigint"},
    "win_level": {"level": "bigint"},
    "lose_level": {"level": "bigint"},
    "ads_reward_complete": {"placement": "string"},
    "booster_use": {"level": "bigint", "booster_type": "string"},
    "af_rewarded": {"level": "bigint"},
}

# Top-level fields of the export that only some tables keep.
EVENT_FIELDS: dict[str, dict[str, str]] = {
    "start_level": {"mobile_name": "device.mobile_model_name"},
    "in_app_purchase": {"event_value_in_usd": "event_value_in_usd"},
}

CLUSTER_BY = ("level", "version", "country")


def _declared(param: str | Param) -> Param:
    return param if isinstance(param, Param) else Param(param)


def raw_event_schema(params: Mapping[str, Params] = EVENT_PARAMS) -> str:
    """The part of the export that is read to flatten events with these parameters.

    Naming it keeps unused fields, and slots that no parameter comes from, out of the scan.
    """
    used = {_declared(p).slot for own in params.values() for p in own.values()} or {"string_value"}
    unknown = used.difference(SLOTS)
    if unknown:
        raise ValueError(f"no slots of a parameter: {', '.join(sorted(unknown))}")
    slots = ", ".join(f"{slot}: {kind}" for slot, kind in SLOTS.items() if slot in used)
    return f"""
    event_date string,
    event_timestamp bigint,
    event_name string,
    user_pseudo_id string,
    platform string,
    event_value_in_usd double,
    app_info struct<version: string>,
    geo struct<country: string>,
    device struct<mobile_model_name: string>,
    event_params array<struct<key: string, value: struct<{slots}>>>,
    shard int
"""


RAW_EVENT_SCHEMA = raw_event_schema()

# The partition column of the raw log: the day an event came in.
SHARD = "shard"


def shard_range(events: DataFrame, first: int | str, last: int | str) -> DataFrame:
    """Day shards from ``first`` to ``last`` (``YYYYMMDD``), both included.

    The comparison is on the bare partition column, so other days are not read.
    """
    return events.filter(F.col("shard").between(int(first), int(last)))


def read_events(
    spark: SparkSession,
    root: str,
    first: int | str,
    last: int | str | None = None,
    schema: str = RAW_EVENT_SCHEMA,
) -> DataFrame:
    """The raw log under ``root/shard=YYYYMMDD``, one day or a range of days."""
    events = spark.read.schema(schema).parquet(root)
    return shard_range(events, first, first if last is None else last)


def _flat_columns(
    params: Params, fields: Mapping[str, str], strict: bool
) -> list[Column]:
    def typed(key: str, param: str | Param) -> Column:
        wanted = _declared(param)
        value = event_param(key, wanted.slot)
        if wanted.type in ("string", SLOTS[wanted.slot]):
            return value.cast(wanted.type)
        cast = value.try_cast(wanted.type)
        if wanted.slot in ("float_value", "double_value"):  # a fraction fits no whole type
            cast = F.when(cast.cast("double") == value.cast("double"), cast)
        return checked(value, cast, key, strict)

    return [
        F.col(TIME),
        F.col(USER),
        parse_event_date(F.col("event_date"), strict).alias(DAY),
        F.col("app_info.version").alias("version"),
        F.col("geo.country").alias("country"),
        F.col("platform"),
        *(F.col(path).alias(name) for name, path in fields.items()),
        *(typed(key, param).alias(key) for key, param in params.items()),
    ]


def flatten_event(
    events: DataFrame,
    event_name: str,
    params: Params | None = None,
    fields: Mapping[str, str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """One event of the raw log as a flat table.

    Events without a user id stay: they count as events and as revenue, while user
    sets leave them out.  A day or a parameter that does not fit its type stops the
    job, or becomes NULL if not ``strict``, whatever the session's settings.
    """
    params = EVENT_PARAMS.get(event_name, {}) if params is None else params
    fields = EVENT_FIELDS.get(event_name, {}) if fields is None else fields
    return events.filter(F.col("event_name") == event_name).select(
        *_flat_columns(params, fields, strict)
    )


def _clustered(df: DataFrame, partitions: Sequence[str], cluster_by: Iterable[str]) -> DataFrame:
    """Rows of a partition together and in cluster order, in files of even size.

    The rebalance shuffles once and splits a partition that is too large for one
    task; the order within files lets a reader skip pages by the cluster keys.
    """
    keys = [*partitions, *(c for c in cluster_by if c in df.columns)]
    return df.hint("rebalance", *partitions).sortWithinPartitions(*keys)


def write_event_table(
    df: DataFrame, root: str, name: str, cluster_by: Iterable[str] = CLUSTER_BY
) -> None:
    """Creates or replaces one whole event table, partitioned by day and clustered.

    Readers have the old table until the new one is complete.  A table is written either by
    this or, shard by shard, by :func:`write_event_tables`; the other way is refused.
    """
    store = Store(df.sparkSession, root)
    refuse_other_layout(store.latest()[1], [name], by_shard=False)
    entry = Entry(name, None, store.new_version())
    rows = _clustered(df, [DAY], cluster_by)
    rows.write.partitionBy(DAY).parquet(store.folder(entry))

    def change(entries):
        refuse_other_layout(entries, [name], by_shard=False)
        return replaced(entries, [name], lambda shard: True, [entry])

    store.commit(change)


def write_event_tables(
    events: DataFrame,
    names: Iterable[str],
    root: str,
    shards: tuple[int | str, int | str] | None = None,
    strict: bool = True,
    cluster_by: Iterable[str] = CLUSTER_BY,
    params: Mapping[str, Params] = EVENT_PARAMS,
    whole: bool = False,
) -> None:
    """Writes many event tables in one pass over the raw log.

    Tables are partitioned by the shard an event came in and then by its own day, and shards
    are replaced as a whole in the named tables: a late event leaves the rest of its day alone, and
    what a shard no longer holds goes.  ``shards`` is the first and last day shard to
    flatten and replace; without it those that ``events`` holds are.  Only with ``whole`` do
    all other shards of the named tables go.  Tables not named stay as they are.

    Rows go to a new folder, and one new manifest puts all of them in place at once: until then,
    and after a failure, readers have the old shards.

    All tables share the columns any of them needs; an event leaves the others
    NULL, and parquet stores such a column as almost nothing.
    """
    if shards is not None:
        events = shard_range(events, *shards)
        first, last = map(int, shards)
        chosen = lambda shard: shard.isdigit() and first <= int(shard) <= last
    else:
        held = {str(r[0]) for r in events.select(SHARD).distinct().collect()}  # one per day
        chosen = held.__contains__
    if whole:
        chosen = lambda shard: True
    _write_shards(events, list(names), root, chosen, strict, cluster_by, params, {})


def _write_shards(
    events: DataFrame,
    names: list[str],
    root: str,
    chosen: Callable[[str], bool],
    strict: bool,
    cluster_by: Iterable[str],
    params: Mapping[str, Params],
    sources: Mapping[str, str],
) -> None:
    """Flattens events and replaces the chosen shards; ``sources`` says what known shards were made from."""
    store = Store(events.sparkSession, root)
    refuse_other_layout(store.latest()[1], names, by_shard=True)
    carried: dict[str, str | Param] = {}
    fields: dict[str, str] = {}
    for name in names:
        carried |= params.get(name, {})
        fields |= EVENT_FIELDS.get(name, {})
    flat = events.filter(F.col("event_name").isin(*names)).select(
        F.col("event_name").alias("table"), SHARD, *_flat_columns(carried, fields, strict)
    )
    rows = _clustered(flat, ["table", SHARD, DAY], cluster_by)
    version = store.new_version()
    rows.write.partitionBy("table", SHARD, DAY).parquet(f"{store.root}/written={version}")
    fresh = []
    for name in names:
        here = set(store.shards_in(version, name))
        fresh += [Entry(name, s, version, sources.get(s)) for s in here]
        # What was flattened and held none of these events is known as well.
        fresh += [Entry(name, s, None, sources[s]) for s in sources if s not in here]

    def change(entries):
        refuse_other_layout(entries, names, by_shard=True)
        return replaced(entries, names, chosen, fresh)

    store.commit(change)


def flatten_new(
    spark: SparkSession,
    raw_root: str,
    names: Iterable[str],
    root: str,
    shards: tuple[int | str, int | str] | None = None,
    strict: bool = True,
    cluster_by: Iterable[str] = CLUSTER_BY,
    params: Mapping[str, Params] = EVENT_PARAMS,
) -> list[str]:
    """Flattens the day shards under ``raw_root`` that are new or have changed; returns them.

    The manifest remembers for every table and shard which files, by name, size and time
    of change, and which declared parameters it was made from.  A run without news reads no
    event and writes nothing; a late file makes its shard run again, as does another
    declaration.  Shards whose raw files are gone stay as they were flattened.  Files that arrive
    during a run are seen by the next one.
    """
    names = list(names)
    store = Store(spark, root)
    declared = repr((sorted((n, sorted((k, _declared(p)) for k, p in params.get(n, {}).items())) for n in names), strict))
    found = store.fingerprints(raw_root.rstrip("/"), declared)
    if shards is not None:
        found = {s: f for s, f in found.items() if s.isdigit() and int(shards[0]) <= int(s) <= int(shards[1])}
    _, entries = store.latest()

    def known(name: str, shard: str) -> str | None:
        entry = entries.get((name, shard))
        return entry and entry.source

    news = {s: f for s, f in found.items() if any(known(n, s) != f for n in names)}
    if news:
        events = spark.read.schema(raw_event_schema(params)).parquet(raw_root)
        events = events.filter(F.col(SHARD).isin(*sorted(map(int, news))))
        _write_shards(events, names, root, news.__contains__, strict, cluster_by, params, news)
    return sorted(news)


def write_bucketed(
    tables: EventTables,
    names: Iterable[str],
    folder: str,
    buckets: int,
    database: str | None = None,
    columns: Mapping[str, Sequence[str]] | None = None,
) -> EventTables:
    """Event tables of the catalog whose files lie in buckets by user; returns them.

    A user's rows have the same bucket in all tables, so that sets of users, label joins and
    counts per user find them together and need no shuffle of the events.  For that the
    tables must have the same number of buckets, which should suit the cluster: a scan has one
    task for each, unless Spark finds the order of no use.  Rows are sorted by user within a
    bucket.  Users can be very uneven: one with a third of all events is one bucket.

    Files go to new folders in ``folder``; tables of these names are replaced, and who reads the
    old files can go on.  ``columns`` names what a table keeps; without it all that its
    schema has.
    """
    prefix = "" if database is None else f"{database}."
    session = None
    for name in names:
        wanted = (columns or {}).get(name) or [c.split()[0] for c in TABLE_SCHEMAS[name].split(", ")]
        rows = tables.get(name, *dict.fromkeys([USER, *wanted]))
        session = rows.sparkSession
        dealt = rows.repartition(buckets, USER)
        writer = dealt.write.mode("overwrite").option("path", f"{folder}/{name}-{uuid4().hex}")
        writer.bucketBy(buckets, USER).sortBy(USER).saveAsTable(f"{prefix}{name}")
    if session is None:
        raise ValueError("no tables are named")
    return EventTables.from_catalog(session, database, by_user=True)
