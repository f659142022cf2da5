"""Label sets, Bloom filters, retention, buckets and sketches: same results, smaller plans."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from playlens import DateRange, EventTables, Scope
from playlens.model import LABEL, USER
from playlens.operators import UserFilter, cumulative_distribution, join_labels, memberships, tag
from playlens.plans import activity, levels, payments, segments, sketches
from playlens.sources import write_bucketed
from playlens.sources.binding import SPEC, bind


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "hard"])
def tables(request, spark, sf_dir):
    return bind(spark, sf_dir, hard=request.param)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(repr, df.collect()))


def _flat(spark, rows, *columns):
    """Rows of (user, day of 2024-01, *columns) as an event table of one platform."""
    values = [(u, date(2024, 1, d) if d else None, *rest) for u, d, *rest in rows]
    frame = spark.createDataFrame(values, f"{USER} string, event_date date" + "".join(f", {c}" for c in columns))
    return frame.withColumns({"platform": F.lit("IOS"), "version": F.lit("1"), "country": F.lit("US")})


def test_labels_are_those_of_the_whole_world_that_are_not_null(tables):
    for labels, world in (
        (segments.payer_labels(tables, SPEC), segments.payer_segments(tables, SPEC)),
        (segments.ad_labels(tables, SPEC), segments.ad_segments(tables, SPEC)),
        (segments.ad_labels(tables, SPEC, True), segments.ad_segments(tables, SPEC, True)),
    ):
        assert _rows(labels) == _rows(world.filter(f"{LABEL} is not null")) != []
        cohort = segments.cohort(tables, SPEC)
        assert labels.join(cohort, USER, "left_anti").isEmpty()


def test_only_the_cohort_is_shuffled_for_labels(tables):
    lines = _optimized(segments.payer_labels(tables, SPEC)).splitlines()
    # Every scan of engagement or purchases lies below a semi join with the cohort.
    assert sum("Join LeftSemi" in line for line in lines) >= 2
    deduplicated = [i for i, line in enumerate(lines) if "Aggregate [user" in line]
    semi = [i for i, line in enumerate(lines) if "Join LeftSemi" in line]
    assert deduplicated and min(semi) > deduplicated[0]


def test_days_without_labelled_users_stay(spark):
    engaged = _flat(spark, [("a", 5), ("x", 6), (None, 7), ("a", 8)])
    stored = EventTables.from_frames({"user_engagement": engaged})
    labels = spark.createDataFrame([("a", "iap")], f"{USER} string, {LABEL} string")
    spec = SPEC.__class__(Scope(), SPEC.first_open, SPEC.regard, SPEC.whole)
    found = activity.dau_pct_by_label(stored, spec, labels, {"iap": "p"}, all_days=True).collect()
    assert [(r.event_date.day, r.p) for r in found] == [(5, 100.0), (6, None), (8, 100.0)]
    assert len(activity.dau_pct_by_label(stored, spec, labels, {"iap": "p"}).collect()) == 2


def test_bloom_filter_keeps_all_its_users_and_few_others(spark):
    users = spark.range(0, 3000).selectExpr(f"concat('u', id) as {USER}")
    others = spark.range(0, 20000).selectExpr(f"concat('v', id) as {USER}").unionByName(
        spark.createDataFrame([(None,)], f"{USER} string")
    )
    chosen = UserFilter.of(users.unionByName(users).unionByName(others.filter(f"{USER} is null")), 3000)
    assert chosen.keep(users).count() == 3000
    assert chosen.keep(others).count() <= 20000 * 0.02
    assert chosen.keep(users.unionByName(others)).join(users, USER).count() == 3000
    crowded = UserFilter.of(users, 1)  # far more users than expected
    assert crowded.bits == 1 << 12 and crowded.keep(users).count() == 3000
    nobody = UserFilter.of(users.limit(0), 10)
    assert nobody.keep(others).count() == 0


def test_bloom_filter_acts_below_the_aggregation(spark, tables, no_broadcast):
    labels = segments.ad_lists(tables, SPEC)
    few = UserFilter.of(labels, 1000)
    facts = tables.get("start_level", USER, "level").filter(f"{USER} is not null")
    per_user = facts.groupBy(USER, "level").agg(F.count("*").alias("n"))
    plain, filtered = join_labels(per_user, labels), join_labels(per_user, labels, few)
    assert _rows(plain) == _rows(filtered)
    lines = _optimized(filtered).splitlines()
    tested = next(i for i, line in enumerate(lines) if "bit_get" in line or "getbit" in line.lower())
    grouped = next(i for i, line in enumerate(lines) if "Aggregate" in line and "count" in line)
    assert tested > grouped
    # What is shuffled: the users' rows, and hardly any others.
    kept, mine = few.keep(facts).count(), facts.join(labels, USER, "left_semi").count()
    assert mine <= kept <= mine + 0.05 * facts.count() + 50 < facts.count()


def test_retention_is_that_of_distinct_days(tables):
    labels = segments.skill_segments(tables, SPEC)
    opened = tables.get("first_open", USER, "event_date").groupBy(USER).agg(F.min("event_date").alias("day0"))
    engaged = tables.get("user_engagement", USER, "event_date").distinct()
    number = F.datediff("event_date", "day0").cast("bigint").alias("day_number")
    for days in (7, 25):
        plain = (
            engaged.join(labels, USER).join(opened, USER).select(F.col(LABEL).alias("segment"), number)
            .filter(F.col("day_number").between(0, days))
            .groupBy("segment", "day_number").agg(F.count("*").alias("retained_users"))
        )
        expected = _rows(plain)
        assert _rows(activity.retention(tables, labels, days)) == expected
        assert _rows(activity.retention(tables, labels, days, SPEC.first_open)) == expected
        assert _rows(activity.retention(tables, labels, days, few_users=UserFilter.of(labels, 500))) == expected


def test_retention_beyond_one_word_of_bits(spark):
    days = spark.range(0, 200).selectExpr(f"'a' as {USER}", "date_add(date'2024-01-01', int(id)) as event_date")
    stored = EventTables.from_frames({"first_open": days, "user_engagement": days})
    labels = spark.createDataFrame([("a", "best"), ("b", "best"), ("c", None)], f"{USER} string, {LABEL} string")
    found = activity.retention(stored, labels, 150).collect()
    assert [(r.day_number, r.retained_users) for r in found] == [(n, 1) for n in range(151)]


def test_retention_shuffles_engagement_once_and_prunes_itself(spark, tmp_path, no_broadcast):
    root = str(tmp_path)
    days = spark.range(0, 40).selectExpr(
        f"'a' as {USER}", "date_add(date'2024-01-01', int(id)) as event_date", "id as event_timestamp"
    )
    for name in ("first_open", "user_engagement"):
        days.write.partitionBy("event_date").parquet(f"{root}/table={name}")
    labels = spark.createDataFrame([("a", "best")], f"{USER} string, {LABEL} string")
    labels.write.parquet(f"{root}/labels")
    labels = spark.read.parquet(f"{root}/labels")
    found = activity.retention(EventTables.from_parquet(spark, root), labels)
    plan = _physical(found).splitlines()
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "Subquery" in plan[i + 1])
    assert "PartitionFilters: [isnotnull(event_date" in plan[scan]  # days are pruned by what the subquery finds
    joined = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line)
    shuffled = [line for line in plan[joined:scan] if "Exchange hashpartitioning(user" in line]
    assert len(shuffled) == 1 and "Exchange hashpartitioning(user_p" not in "".join(plan[:joined])
    assert [(r.day_number, r.retained_users) for r in found.collect()] == [(n, 1) for n in range(8)]


def test_installs_of_others_go_before_the_grouping(tables):
    plan = _optimized(payments.days_to_first_purchase(tables, SPEC.scope)).splitlines()
    grouped = next(i for i, line in enumerate(plan) if "Aggregate" in line and "min(" in line)
    semi = next(i for i, line in enumerate(plan) if "Join LeftSemi" in line)
    assert semi > grouped


def test_rounding_half_to_even(spark):
    counts = spark.createDataFrame([(1, 1), (2, 799)], "v int, n int")  # 0.125 percent
    up, even = (
        [r.pct_accumulate for r in cumulative_distribution(counts, "v", "n", half).orderBy("v").collect()]
        for half in (False, True)
    )
    assert up == [0.13, 100.0] and even == [0.12, 100.0]


def test_buckets_save_the_shuffle_of_events(spark, tmp_path, sf_dir, no_broadcast):
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}/db'")
    try:
        source = bind(spark, sf_dir)
        stored = write_bucketed(source, ["start_level", "win_level", "first_open"], f"{tmp_path}/files", 4, "bucketed")
        labels_of = lambda t: memberships(
            tag(t.get("first_open", USER), cohort="true"), tag(t.get("win_level", USER), won="true"), of_first=True, by_user=t.by_user
        )
        assert _rows(labels_of(stored)) == _rows(labels_of(source))
        won, opened = (tag(stored.get(n, USER), **{n: "true"}) for n in ("win_level", "first_open"))
        assert _rows(memberships(won, opened)) == _rows(memberships(won, opened, by_user=True))
        sets = labels_of(stored)
        assert "Exchange" not in _physical(sets)
        starts = stored.get("start_level", USER, "level")
        joined = join_labels(starts.groupBy(USER).agg(F.count("*").alias("n")), sets)
        assert "Exchange" not in _physical(joined)
        assert "Exchange" in _physical(labels_of(source))
        counts, labels = levels.counts_per_user_level(stored, {"won": "win_level"}), segments.cohort(stored, SPEC)
        assert counts.count() > 0 and labels.count() > 0
        again = write_bucketed(source, ["start_level"], f"{tmp_path}/files", 4, "bucketed", {"start_level": ["level"]})
        assert again.get("start_level", USER, "level").count() == starts.count()
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_sketches_come_near_and_merge(spark, sf_dir, tmp_path):
    rows = spark.range(0, 300000, 1, 8).selectExpr(
        f"cast(id % 50000 as string) as {USER}",
        "date_add(date'2024-01-01', cast(id % 30 as int)) as event_date",
        "if(id % 7 = 0, 'IOS', 'ANDROID') as platform",
        "'1' as version",
    )
    tables = EventTables.from_frames({"session_start": rows})
    path = str(tmp_path / "sketches")
    sketches.write_sketches(sketches.daily_sketches(tables), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 60
    for dates in (None, DateRange("2024-01-05", "2024-01-11")):
        exact = rows if dates is None else rows.filter(dates.contains())
        for by in ((), ("platform",), ("platform", "version")):
            want = {tuple(r[c] for c in by): r.n for r in exact.groupBy(*by).agg(F.countDistinct(USER).alias("n")).collect()}
            got = {tuple(r[c] for c in by): r.num_user for r in sketches.estimated_users(stored, dates, by).collect()}
            assert got.keys() == want.keys()
            assert all(abs(got[k] - n) <= 0.05 * n for k, n in want.items())
    # A day that is sketched again replaces what is stored of it.
    late = EventTables.from_frames({"session_start": rows.filter("event_date = date'2024-01-05'").limit(10)})
    sketches.write_sketches(sketches.daily_sketches(late), path)
    stored = spark.read.parquet(path)
    found = sketches.estimated_users(stored, DateRange("2024-01-05", "2024-01-05")).first()[0]
    assert found == 10
    weekly = sketches.rolling_users(stored, 7).collect()
    assert len(weekly) == 30 and max(r.window_end for r in weekly) == date(2024, 1, 30)


def test_win_rates_with_a_bloom_filter_and_study(spark, tables):
    labels = segments.skill_segments(tables, SPEC)
    few = UserFilter.of(labels, 500)
    assert _rows(levels.winrate_by_label(tables, labels, few_users=few)) == _rows(levels.winrate_by_label(tables, labels))
