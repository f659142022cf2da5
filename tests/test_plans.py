"""What must hold for every plan, and how results relate to each other."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import sql_twins
from playlens import DateRange, EventTables, Scope
from playlens.functions.columns import MICROS_PER_HOUR
from playlens.plans import activity, levels, payments, segments
from playlens.sources.binding import SPEC, bind

# Corpus queries have tests of their own, next to their operators.
QUERIES = {n: q for n, q in contract.queries().items() if n not in contract.corpus()}
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "MapInArrow",
    "FlatMapGroupsInPandas",
    "FlatMapGroupsInArrow",
    "CollectLimit",
)


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return bind(spark, sf_dir)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_aggregates_by_hash(name, spark, sf_dir):
    assert "SortAggregate" not in _plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cross_join_and_no_python(name, spark, sf_dir):
    plan = _plan(QUERIES[name](spark, sf_dir))
    assert not [word for word in FORBIDDEN if word in plan]


def test_columns_are_pruned_and_filters_pushed(tables):
    plan = _plan(payments.payer_count(tables))
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in plan
    assert "EqualTo(event_type,purchase)" in plan


def test_labels_take_one_shuffle_per_user_and_no_join(tables):
    plan = _plan(segments.ad_lists(tables, SPEC))
    assert "Join" not in plan
    # One for the labels, one for the earliest signup in the test binding.
    assert plan.count("Exchange hashpartitioning") == 2


def test_attribution_is_spread_by_user_and_slice(tables):
    plan = _plan(payments.purchases_vs_first(tables, SPEC.scope))
    spread = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert len(spread) == 1 and "slice" in spread[0]
    assert "LeftSemi" in plan and "FullOuter" not in plan


def test_a_busy_user_has_one_first_row_per_task(tables):
    from playlens.operators import first_per_user

    plan = _plan(first_per_user(tables.get("in_app_purchase", "user_pseudo_id", "event_timestamp", "level"), "level"))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_attempts_are_sorted_once_per_user_and_slice(tables):
    from playlens.operators import level_intervals

    starts = tables.get("start_level", "user_pseudo_id", "event_timestamp", "level")
    plan = _plan(level_intervals(starts))
    by_slice = [line for line in plan.splitlines() if "Sort [" in line and "level_start" in line]
    assert len(by_slice) == 1


def test_a_busy_buyer_is_split(spark):
    """One buyer with a third of all purchases and starts, with broadcasting off."""
    rows = spark.range(0, 200000, 1, 8).selectExpr(
        "if(id % 3 = 0, 'busy', cast(id % 5000 as string)) as user_pseudo_id",
        "id * 20000000 as event_timestamp",
        "id % 40 as level",
        "'IOS' as platform",
        "'1.0.5' as version",
    )
    busy = EventTables.from_frames({"start_level": rows, "in_app_purchase": rows.filter("level < 20")})
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        starts = payments._starts(busy, Scope(), MICROS_PER_HOUR)
        assert starts.count() == rows.join(rows.filter("level < 20").select("user_pseudo_id").distinct(), "user_pseudo_id").count()
        kept = starts.groupBy("level").count()
        kept.collect()
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        buyers = rows.filter("level < 20 and user_pseudo_id = 'busy'")
        slices = buyers.selectExpr("event_timestamp div 3600000000 as slice").distinct().count()
        assert slices < buyers.count() / 20
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def test_retention_reads_no_days_past_the_cohort(spark, tmp_path):
    root = str(tmp_path / "flat")
    days = spark.range(0, 40).selectExpr(
        "id as event_timestamp", "'a' as user_pseudo_id", "date_add(date'2024-01-01', int(id)) as event_date",
        "'1.0.5' as version", "'US' as country", "'IOS' as platform",
    )
    for name in ("first_open", "user_engagement"):
        days.write.partitionBy("event_date").parquet(f"{root}/table={name}")
    stored = EventTables.from_parquet(spark, root)
    labels = spark.createDataFrame([("a", "best")], "user_pseudo_id string, user_type string")
    plain = activity.retention(stored, labels)
    pruned = activity.retention(stored, labels, first_open=DateRange("2024-01-01", "2024-01-04"))
    assert plain.collect() == pruned.collect() and len(plain.collect()) == 8
    again = activity.retention(stored, labels, first_open=DateRange("2024-01-01", "2024-01-04"))
    filters = [part for part in _plan(again).split("PartitionFilters: [")[1:] if "<=" in part[:160]]
    assert len(filters) == 1


@pytest.mark.parametrize("name", sorted(sql_twins.FEW))
def test_other_players_go_below_the_aggregation(name, spark, sf_dir, tmp_path):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_segments_cover_the_cohort(tables):
    cohort = segments.cohort(tables, SPEC).count()
    for labels in (
        segments.ad_lists(tables, SPEC),
        segments.cohort_payer_labels(tables, SPEC),
        segments.booster_segments(tables, SPEC),
        segments.early_ad_segments(tables, SPEC),
        segments.early_payer_segments(tables, SPEC),
    ):
        assert labels.select("user_pseudo_id").distinct().count() == labels.count() == cohort


def test_split_counts_add_up_to_the_cohort(tables):
    total = segments.cohort_split_counts(tables, SPEC).agg(F.sum("num_user")).first()[0]
    new = activity.new_users(tables, SPEC.scope, SPEC.first_open).first()[0]
    assert total == new


def test_known_segment_sizes(spark):
    """Sizes under the default spec at sf0.01, counted independently beforehand."""
    tables = bind(spark, "/root/testdata/sf0.01")

    def sizes(labels):
        return {r.segment: r.num_user for r in segments.segment_sizes(labels).collect()}

    assert sizes(segments.payer_lists(tables, SPEC)) == {"iap": 15, "non_iap": 55}
    assert sizes(segments.ad_lists(tables, SPEC)) == {"adrw": 35, "non_adrw": 35}
    assert sizes(segments.skill_segments(tables, SPEC)) == {"best": 33, "bete": 10, "worst": 27}
    unlabelled = segments.payer_segments(tables, SPEC).filter("user_type is null")
    assert unlabelled.count() == 20


def test_distribution_holds_every_user_from_ratio_one(tables):
    attempts = segments.attempt_ratio(tables, SPEC)
    spread = levels.attempt_ratio_cumulative(attempts).collect()
    assert spread[-1].accumulate == attempts.filter("start_time >= 1").count()
    assert spread[-1].pct_accumulate == 100.0


def test_attributed_purchases_match_the_level_totals(tables):
    both = payments.purchases_vs_first(tables, SPEC.scope).collect()
    every = payments.purchases_by_level(tables, SPEC.scope).collect()
    first = payments.first_purchase_by_level(tables, SPEC.scope).collect()
    assert [(r.level, r.num_iap_users, r.num_purchases) for r in both] == list(map(tuple, every))
    assert {r.level: r.num_first_iap for r in both if r.num_first_iap} == dict(map(tuple, first))


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
