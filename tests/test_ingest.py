"""Flattening and the table layout on disk."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from playlens import DateRange, EventTables, Scope
from playlens.model import TABLE_SCHEMAS
from playlens.plans import activity
from playlens.plans.levels import level_outcomes
from playlens.sources import (
    RAW_EVENT_SCHEMA,
    flatten_event,
    read_events,
    shard_range,
    write_event_table,
    write_event_tables,
)
from playlens.sources.binding import bind, raw_log


def _raw(spark, rows):
    """Rows are (day, time, event, user, {param: value})."""
    values = [
        (
            day, time, event, user, "IOS", 1.5 if event == "in_app_purchase" else None,
            ("1.0.5",), ("US",), ("phone",), [(k, (v,)) for k, v in params.items()], int(day),
        )
        for day, time, event, user, params in rows
    ]
    return spark.createDataFrame(values, RAW_EVENT_SCHEMA)


@pytest.fixture(scope="module")
def raw(spark):
    return _raw(
        spark,
        [
            ("20250301", 1, "start_level", "a", {"mode": "x", "level": "7"}),
            ("20250415", 2, "start_level", "b", {"mode": "x"}),
            ("20250402", 3, "win_level", "a", {"level": "7"}),
            ("20250416", 4, "start_level", "a", {"level": "8"}),
            ("20250228", 5, "start_level", "a", {"level": "6"}),
            ("20250410", 6, "start_level", None, {"level": "5"}),
            ("20250410", 7, "in_app_purchase", "a", {}),
            ("20250411", 8, "start_level", "c", {}),
        ],
    )


def _levels(df):
    return sorted((r.user_pseudo_id, str(r.event_date), r.level) for r in df.collect())


def test_flatten_takes_the_event_in_the_shard_range(raw):
    flat = flatten_event(shard_range(raw, 20250301, 20250415), "start_level")
    assert set(flat.columns) == {
        "event_timestamp", "user_pseudo_id", "event_date", "version", "country", "platform",
        "mobile_name", "level",
    }
    assert dict(flat.dtypes)["level"] == "bigint"
    assert dict(flat.dtypes)["event_date"] == "date"
    # A start without the parameter stays, without a level, and so does one without a user.
    assert [r[0] for r in flat.select("user_pseudo_id").orderBy("event_timestamp").collect()] == [
        "a", "b", None, "c",
    ]
    known = flat.filter("level is not null and user_pseudo_id is not null")
    assert _levels(known) == [("a", "2025-03-01", 7)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_flatten_strict_and_lenient(spark, ansi):
    bad_level = _raw(spark, [("20250301", 1, "start_level", "a", {"level": "x"})])
    bad_day = bad_level.withColumn("event_date", F.lit("2025-3"))
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for raw in (bad_level, bad_day):
            with pytest.raises(PySparkException):
                flatten_event(raw, "start_level").collect()
        assert flatten_event(bad_level, "start_level", strict=False).first().level is None
        assert flatten_event(bad_day, "start_level", strict=False).first().event_date is None
        nothing = bad_level.withColumn("event_params", F.expr("filter(event_params, p -> false)"))
        assert flatten_event(nothing, "start_level").first().level is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_events_without_a_user_count_as_events_and_as_revenue(spark):
    from playlens.plans.levels import user_max_level
    from playlens.plans.payments import payer_count, revenue_by_country

    raw = _raw(
        spark,
        [
            ("20250301", 1, "in_app_purchase", "a", {}),
            ("20250301", 2, "in_app_purchase", None, {}),
            ("20250301", 3, "start_level", "a", {"level": "1"}),
            ("20250301", 4, "start_level", None, {"level": "1"}),
            ("20250301", 5, "win_level", None, {"level": "1"}),
            ("20250301", 6, "lose_level", "a", {"level": "2"}),
        ],
    )
    names = ("in_app_purchase", "start_level", "win_level", "lose_level")
    tables = EventTables.from_frames({name: flatten_event(raw, name) for name in names})
    assert revenue_by_country(tables, Scope()).first().revenue == 3.0
    assert payer_count(tables).first()[0] == 1
    assert tuple(level_outcomes(tables).first()) == (1, 1, 2, 1, 0)
    assert user_max_level(tables).collect() == [("a", 1)]


def test_first_of_repeated_parameters_counts(spark):
    raw = _raw(spark, [("20250301", 1, "start_level", "a", {})]).withColumn(
        "event_params",
        F.expr(
            "array(named_struct('key', 'level', 'value', named_struct('string_value', '3')),"
            "named_struct('key', 'level', 'value', named_struct('string_value', '4')))"
        ),
    )
    assert flatten_event(raw, "start_level").first().level == 3


def test_shards_outside_the_range_are_not_read(spark, raw, tmp_path):
    root = str(tmp_path / "raw")
    raw.write.partitionBy("shard").parquet(root)
    events = read_events(spark, root, 20250301, 20250415)
    assert events.count() == 6
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    one_day = read_events(spark, root, "20250402")
    assert [r[0] for r in activity.event_names(one_day).collect()] == ["win_level"]


def test_only_used_parameter_slots_are_read(spark, raw, tmp_path):
    root = str(tmp_path / "raw")
    raw.write.partitionBy("shard").parquet(root)
    flat = flatten_event(read_events(spark, root, 20250301, 20250415), "start_level")
    plan = flat._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "event_value_in_usd" not in read
    assert "PushedFilters" in plan and "EqualTo(event_name,start_level)" in plan


def test_written_table_is_pruned_by_day(spark, raw, tmp_path):
    root = str(tmp_path / "flat")
    write_event_table(flatten_event(raw, "start_level"), root, "start_level")
    tables = EventTables.from_parquet(spark, root)
    starts = tables.get(
        "start_level",
        "user_pseudo_id",
        "level",
        "event_date",
        scope=Scope(platform="IOS", countries=("US",)),
        dates=DateRange("2025-03-01", "2025-04-15"),
    )
    assert len(starts.collect()) == 4  # one of them without a user
    plan = starts._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "event_date" in partition_filters
    assert "EqualTo(platform,IOS)" in plan and "mobile_name" not in plan
    # Writing again replaces the table.
    write_event_table(flatten_event(raw, "start_level").limit(1), root, "start_level")
    again = EventTables.from_parquet(spark, root)
    assert again.get("start_level", "user_pseudo_id").count() == 1


def test_all_tables_in_one_pass(spark, sf_dir, tmp_path):
    root = str(tmp_path / "flat")
    names = ["start_level", "win_level", "lose_level", "in_app_purchase", "booster_use"]
    log = raw_log(spark, sf_dir)
    write_event_tables(log, names, root)
    stored, bound = EventTables.from_parquet(spark, root), bind(spark, sf_dir)
    for name in ("start_level", "win_level", "lose_level"):
        columns = ["user_pseudo_id", "event_timestamp", "event_date", "country", "level"]
        one, other = stored.get(name, *columns), bound.get(name, *columns)
        assert one.count() > 0
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    for name in names:
        single = flatten_event(log, name)
        together = stored.get(name, *single.columns)
        assert together.exceptAll(single).isEmpty() and single.exceptAll(together).isEmpty()
    outcomes = [sorted(map(repr, level_outcomes(t).collect())) for t in (stored, bound)]
    assert outcomes[0] == outcomes[1]


def test_tables_from_the_catalog(spark, raw):
    flatten_event(raw, "start_level").createOrReplaceTempView("start_level")
    try:
        starts = EventTables.from_catalog(spark).get(
            "start_level", "user_pseudo_id", dates=DateRange("2025-03-01", "2025-03-01")
        )
        assert [r[0] for r in starts.collect()] == ["a"]
    finally:
        spark.catalog.dropTempView("start_level")


def _stored(spark, root, name):
    rows = EventTables.from_parquet(spark, root).get(name, "user_pseudo_id", "event_date").collect()
    return sorted((str(r[0]), r[1].isoformat()) for r in rows)


def test_only_shards_that_are_asked_for_are_replaced(spark, raw, tmp_path):
    root = str(tmp_path / "flat")
    write_event_tables(raw, ["start_level", "win_level", "in_app_purchase"], root)
    again = _raw(
        spark,
        [
            ("20250301", 9, "start_level", "z", {"level": "1"}),
            ("20250301", 9, "win_level", "z", {"level": "1"}),
            ("20250416", 9, "start_level", "z", {"level": "1"}),
        ],
    )
    write_event_tables(again, ["start_level"], root, (20250301, "20250301"))
    assert ("z", "2025-03-01") in _stored(spark, root, "start_level")
    assert ("a", "2025-03-01") not in _stored(spark, root, "start_level")
    assert ("b", "2025-04-15") in _stored(spark, root, "start_level")
    assert ("z", "2025-04-16") not in _stored(spark, root, "start_level")
    assert _stored(spark, root, "win_level") == [("a", "2025-04-02")]
    assert _stored(spark, root, "in_app_purchase") == [("a", "2025-04-10")]


def test_a_late_event_leaves_the_rest_of_its_day(spark, tmp_path):
    root = str(tmp_path / "flat")
    day = [("20250301", i, "start_level", f"u{i}", {"level": "1"}) for i in range(5)]
    write_event_tables(_raw(spark, day), ["start_level"], root, (20250301, 20250301))
    late = _raw(spark, [("20250301", 9, "start_level", "late", {"level": "1"})])
    late = late.withColumn("shard", F.lit(20250302))
    for _ in range(2):  # flattening a shard again changes nothing
        write_event_tables(late, ["start_level"], root, (20250302, 20250302))
        stored = _stored(spark, root, "start_level")
        assert stored == sorted([(f"u{i}", "2025-03-01") for i in range(5)] + [("late", "2025-03-01")])
    tables = EventTables.from_parquet(spark, root)
    assert tables.get("start_level", "level", dates=DateRange("2025-03-01", "2025-03-01")).count() == 6


def test_events_that_a_shard_no_longer_holds_go(spark, tmp_path):
    root = str(tmp_path / "flat")
    names = ["start_level", "win_level"]
    first = [
        ("20250301", 1, "start_level", "a", {"level": "1"}),
        ("20250302", 2, "start_level", "b", {"level": "1"}),
        ("20250301", 3, "win_level", "a", {"level": "1"}),
    ]
    write_event_tables(_raw(spark, first), names, root)
    second = _raw(spark, [("20250301", 3, "win_level", "a", {"level": "1"})])
    write_event_tables(second, names, root, (20250301, 20250301))
    assert _stored(spark, root, "start_level") == [("b", "2025-03-02")]
    assert _stored(spark, root, "win_level") == [("a", "2025-03-01")]


def test_a_large_day_is_split_over_sorted_files(spark, tmp_path):
    root = str(tmp_path / "flat")
    rows = spark.range(0, 200000, 1, 8).selectExpr(
        "xxhash64(id) as event_timestamp",
        "cast(id % 3 as string) as user_pseudo_id",
        "date'2025-03-01' as event_date",
        "'1' as version",
        "'US' as country",
        "'IOS' as platform",
        "'phone' as mobile_name",
        "id % 50 as level",
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    try:
        write_event_table(rows, root, "start_level")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = sorted((tmp_path / "flat").glob("written=*/table=start_level/event_date=2025-03-01/*.parquet"))
    assert len(files) > 2
    for file in files:
        levels = [r[0] for r in spark.read.parquet(str(file)).select("level").collect()]
        assert levels == sorted(levels)
    assert EventTables.from_parquet(spark, root).get("start_level", "level").count() == 200000


def test_schemas_name_every_table():
    assert set(TABLE_SCHEMAS) == {
        "first_open", "session_start", "user_engagement", "start_level", "win_level",
        "lose_level", "in_app_purchase", "ads_reward_complete", "booster_use", "af_rewarded",
    }
