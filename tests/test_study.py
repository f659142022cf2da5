"""The side-by-side study gives what the single analyses give."""

from __future__ import annotations

import pytest

from playlens.plans import activity, levels, payments, segments, usage
from playlens.plans.study import compare_segments, keep
from playlens.sources.binding import SPEC, bind


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return bind(spark, sf_dir)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_study_agrees_with_the_single_analyses(tables):
    labels = segments.skill_segments(tables, SPEC)
    study = compare_segments(tables, SPEC, labels, "best", "worst")
    ends = labels.filter("user_type <> 'bete'")
    assert _rows(study["sizes"]) == _rows(segments.segment_sizes(ends))
    assert _rows(study["level_curves"]) == _rows(levels.level_curves_by_label(tables, ends))
    assert _rows(study["retention"]) == _rows(activity.retention_rate(tables, ends))
    assert _rows(study["pay_rate"]) == _rows(payments.pay_rate_by_segment(tables, SPEC, ends))
    daily = {"best": "percent_dau_best", "worst": "percent_dau_worst"}
    assert _rows(study["daily_activity"]) == _rows(
        activity.dau_pct_by_label(tables, SPEC, labels, daily)
    )
    assert all(df.count() for df in study.values())
    plain = compare_segments(tables, SPEC, labels, "best", "worst", few_users=False)
    assert all(_rows(study[name]) == _rows(plain[name]) for name in study)


def test_few_users_are_picked_at_the_scan(spark, tables, tmp_path):
    path = str(tmp_path / "labels")
    segments.ad_lists(tables, SPEC).write.parquet(path)
    labels = spark.read.schema("user_pseudo_id string, user_type string").parquet(path)
    outcomes = levels.level_outcomes_by_label(tables, labels, few_users=True)
    plan = outcomes._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [user_pseudo_id") :]
    assert below.count("LeftSemi") == 3


def test_few_users_are_picked_at_the_scan_of_usage(spark, tables, tmp_path):
    path = str(tmp_path / "labels")
    segments.skill_segments(tables, SPEC).write.parquet(path)
    labels = spark.read.schema("user_pseudo_id string, user_type string").parquet(path)
    uses = {"booster": "booster_use"}
    few = usage.usage_by_level(tables, labels, uses, few_users=True)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [user_pseudo_id") :]
    assert below.count("LeftSemi") == 2
    assert _rows(few) == _rows(usage.usage_by_level(tables, labels, uses))


def test_labels_are_kept_where_the_caller_says(tables, tmp_path):
    labels = segments.ad_lists(tables, SPEC)
    with keep(labels, str(tmp_path)) as kept:
        assert _rows(kept) == _rows(labels)
        assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
        assert len(list(tmp_path.iterdir())) == 1
    assert not list(tmp_path.iterdir())


def test_labels_are_cached_without_a_folder(tables):
    labels = segments.ad_lists(tables, SPEC)
    kept = keep(labels)
    assert kept.frame.is_cached and _rows(kept.frame) == _rows(labels)
    kept.release()
    assert not kept.frame.is_cached
