"""Stored event tables: replacing shards, failures, races, flattening once, and parameter slots."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from playlens import EventTables
from playlens.sources import (
    Param,
    flatten_event,
    flatten_new,
    raw_event_schema,
    read_events,
    write_event_table,
    write_event_tables,
)
from playlens.store import Entry, Store, replaced

SCHEMA = raw_event_schema({"e": {"a": "string", "b": Param("bigint", "int_value"), "c": Param("double", "double_value")}})


def _raw(spark, rows):
    """Rows are (shard, event, user, (text, whole, fraction))."""
    return spark.createDataFrame(
        [
            (str(shard), i, event, user, "IOS", None, ("1.0.5",), ("US",), ("phone",), [("level", slots)], shard)
            for i, (shard, event, user, slots) in enumerate(rows)
        ],
        SCHEMA,
    )


def _days(spark, days, user="a", event="start_level"):
    return _raw(spark, [(day, event, f"{user}{day}", ("1", None, None)) for day in days])


def _users(spark, root, name="start_level"):
    return sorted(r[0] for r in EventTables.from_parquet(spark, root).get(name, "user_pseudo_id").collect())


TEN = list(range(20240110, 20240120))


def test_shards_the_input_does_not_hold_stay(spark, tmp_path):
    root = str(tmp_path)
    write_event_tables(_days(spark, TEN), ["start_level", "win_level"], root)
    write_event_tables(_days(spark, [20240111], "b"), ["start_level", "win_level"], root)
    assert _users(spark, root) == sorted([f"a{d}" for d in TEN if d != 20240111] + ["b20240111"])
    # A shard that is there but has none of the events empties that shard of their tables.
    write_event_tables(_days(spark, [20240112], event="win_level"), ["start_level", "win_level"], root)
    assert "a20240112" not in _users(spark, root) and len(_users(spark, root)) == 9
    assert _users(spark, root, "win_level") == ["a20240112"]
    write_event_tables(_days(spark, [20240111], "c"), ["start_level"], root, whole=True)
    assert _users(spark, root) == ["c20240111"] and _users(spark, root, "win_level") == ["a20240112"]


def test_a_failure_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    write_event_tables(_days(spark, TEN), ["start_level"], root)
    before = _users(spark, root)
    held = EventTables.from_parquet(spark, root).get("start_level", "user_pseudo_id")
    unreadable = _raw(spark, [(20240111, "start_level", "x", ("seven", None, None))])
    with pytest.raises(PySparkException):
        write_event_tables(unreadable, ["start_level"], root)
    assert _users(spark, root) == before

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(Store, "publish", killed)  # after the rows are written, before they count
        with pytest.raises(KeyboardInterrupt):
            write_event_tables(_days(spark, TEN, "new"), ["start_level"], root)
        with pytest.raises(KeyboardInterrupt):
            write_event_table(flatten_event(_days(spark, TEN), "win_level"), root, "win_level")
    assert _users(spark, root) == before
    write_event_tables(_days(spark, TEN, "new"), ["start_level"], root)
    assert _users(spark, root) == [f"new{d}" for d in TEN]
    assert held.count() == 10  # who opened the old version still reads it
    Store(spark, root).expire(hours=24)
    assert held.count() == 10
    Store(spark, root).expire(hours=0)
    assert len(list(tmp_path.glob("written=*"))) == 1 and _users(spark, root) == [f"new{d}" for d in TEN]


def test_both_writers_on_one_table_are_refused(spark, tmp_path):
    root = str(tmp_path)
    write_event_tables(_days(spark, [20240111]), ["start_level"], root)
    with pytest.raises(ValueError, match="by shard"):
        write_event_table(flatten_event(_days(spark, [20240111]), "start_level"), root, "start_level")
    write_event_table(flatten_event(_days(spark, [20240111], event="win_level"), "win_level"), root, "win_level")
    with pytest.raises(ValueError, match="as a whole"):
        write_event_tables(_days(spark, [20240111]), ["start_level", "win_level"], root)
    assert _users(spark, root) == ["a20240111"] == _users(spark, root, "win_level")


def test_a_lost_race_is_run_again(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    seen = []

    def change(name):
        def add(entries):
            if not seen and name == "one":  # another writer publishes in between
                seen.append(name)
                Store(spark, str(tmp_path)).commit(change("other"))
            return replaced(entries, [name], lambda shard: True, [Entry(name, "1", "v")])

        return add

    store.commit(change("one"))
    number, entries = store.latest()
    assert number == 2 and {t for t, _ in entries} == {"one", "other"}
    assert not store.publish(2, {}) and store.latest()[1] == entries


def test_only_new_and_changed_shards_are_flattened(spark, tmp_path, monkeypatch):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "flat")
    names = ["start_level", "win_level"]
    _days(spark, TEN).write.partitionBy("shard").parquet(raw)
    assert flatten_new(spark, raw, names, root) == [str(d) for d in TEN]
    with monkeypatch.context() as patch:
        patch.setattr("playlens.sources.ingest._write_shards", lambda *_: pytest.fail("nothing is new"))
        assert flatten_new(spark, raw, names, root) == []
    _days(spark, [20240113], "late").write.mode("append").partitionBy("shard").parquet(raw)
    _days(spark, [20240125]).write.mode("append").partitionBy("shard").parquet(raw)
    assert flatten_new(spark, raw, names, root, (20240101, 20240120)) == ["20240113"]
    assert _users(spark, root) == sorted([f"a{d}" for d in TEN] + ["late20240113"])
    assert flatten_new(spark, raw, names, root) == ["20240125"]
    other = {"start_level": {"level": "int"}, "win_level": {"level": "bigint"}}
    assert len(flatten_new(spark, raw, names, root, params=other)) == 11
    assert flatten_new(spark, raw, names, root, params=other) == []
    assert len(flatten_new(spark, raw, ["lose_level"], root)) == 11 and _users(spark, root, "lose_level") == []


def test_parameters_of_every_slot(spark, tmp_path):
    rows = [
        (20240110, "start_level", "a", ("x", 7, None)),
        (20240110, "start_level", "b", (None, None, 2.0)),
        (20240110, "start_level", "c", ("5", 2**40, 2.5)),
    ]
    raw = _raw(spark, rows)

    def levels(param, strict=True):
        found = flatten_event(raw, "start_level", {"level": param}, {}, strict)
        return {r.user_pseudo_id: r.level for r in found.collect()}

    assert levels(Param("bigint", "int_value")) == {"a": 7, "b": None, "c": 2**40}
    assert levels(Param("string", "int_value")) == {"a": "7", "b": None, "c": str(2**40)}
    assert levels(Param("double", "double_value")) == {"a": None, "b": 2.0, "c": 2.5}
    assert levels(Param("bigint", "double_value"), strict=False) == {"a": None, "b": 2, "c": None}
    assert levels(Param("int", "int_value"), strict=False) == {"a": 7, "b": None, "c": None}
    assert levels("bigint", strict=False) == {"a": None, "b": None, "c": 5}
    for param in (Param("int", "int_value"), Param("bigint", "double_value"), "bigint"):
        with pytest.raises(PySparkException):
            levels(param)
    with pytest.raises(ValueError):
        raw_event_schema({"e": {"k": Param("string", "text_value")}})


def test_only_declared_slots_are_read(spark, tmp_path):
    root = str(tmp_path / "raw")
    _days(spark, [20240110]).write.partitionBy("shard").parquet(root)
    declared = {"start_level": {"level": Param("bigint", "int_value")}}
    events = read_events(spark, root, 20240110, schema=raw_event_schema(declared))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = flatten_event(events, "start_level", declared["start_level"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = plan[plan.index("ReadSchema") :]
    assert "int_value" in read and "string_value" not in read and "double_value" not in read


def test_a_table_without_rows_is_empty(spark, tmp_path):
    root, raw = str(tmp_path / "flat"), str(tmp_path / "raw")
    _days(spark, [20240110], event="other").write.partitionBy("shard").parquet(raw)
    flatten_new(spark, raw, ["start_level"], root)
    assert EventTables.from_parquet(spark, root).get("start_level", "level").count() == 0
    assert EventTables.from_parquet(spark, root).get("start_level", "level").filter(F.lit(True)).columns == ["level"]
