"""

Every query runs an analysis of ``playlens`` over the whole test tables, bound as
a game-event log by ``playlens.sources.binding``.  The SQL twins are in
``sql_twins.py``.
"""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable
from dataclasses import replace
from importlib.util import find_spec
from pathlib import Path
from uuid import uuid4

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sql_twins
from playlens import CohortSpec, EventTables
from playlens.model import DAY, LABEL, TIME, USER
from playlens.operators import (
    UserFilter,
    attribute_to_level,
    count_users,
    first_per_user,
    in_users,
    level_intervals,
    memberships,
    merge_by_level,
    not_in_users,
    pivot_labels,
    tag,
)
from playlens.plans import activity, levels, payments, segments, sketches, usage
from playlens.sources.binding import SPEC, bind, raw_log
from playlens.sources.ingest import (
    Param,
    flatten_event,
    flatten_new,
    raw_event_schema,
    read_events,
    shard_range,
    write_bucketed,
    write_event_tables,
)

# The corpus part may be left out as a whole; if it is there, its own import errors are shown.
if find_spec("corpus_pipeline") and find_spec("playlens.llm") and find_spec("playlens.llm.queries"):
    import corpus_pipeline
    from playlens.llm import queries as corpus_queries
else:
    corpus_pipeline = corpus_queries = None

Query = Callable[[SparkSession, str], DataFrame]

# Thresholds the small test tables can reach, and the countries of scoped runs.
MORE_THAN_USERS = 3
MORE_THAN_ADS = 1
MARKETS = sql_twins.MARKETS

# Users that a Bloom filter is made for, buckets of stored tables, and how far a sketch may be off.
EXPECTED_USERS = 1000
BUCKETS = 4
SKETCH_ERROR = 0.05

# Levels that curves are drawn for and that tables show.
LEVELS_DRAWN = 50
LEVELS_SHOWN = 200

# Levels as whole numbers of the export, for the log that has them so.
TYPED_PARAMS = {
    name: {"level": Param("bigint", "int_value")} for name in ("start_level", "win_level", "lose_level")
}

# Segment sizes that a study may put in by hand.
TYPED_IN_SIZES = {"iap": 15, "non_iap": 2091}

MARKET_SPEC = replace(SPEC, scope=replace(SPEC.scope, countries=MARKETS))

USES = {"booster": "booster_use", "adrw": "af_rewarded"}


def _names(pattern: str, *labels: str) -> dict[str, str]:
    return {label: pattern.format(label) for label in labels}


def _on_tables(
    plan: Callable[[EventTables, CohortSpec], DataFrame],
    spec: CohortSpec = SPEC,
    hard: bool = False,
) -> Query:
    return lambda spark, sf_dir: plan(bind(spark, sf_dir, hard), spec)


def _set_queries() -> dict[str, Query]:
    """The building blocks by themselves."""

    def in_users_(t, s):
        starts = t.get("start_level", USER, "level").groupBy(USER, "level").count()
        payers = segments.payer_users(t, s)
        return in_users(starts, payers).groupBy("level").agg(F.sum("count").alias("count"))

    def not_in_users_(t, s):
        engaged = t.get("user_engagement", USER, "platform").distinct()
        payers = t.get("in_app_purchase", USER).distinct()
        return not_in_users(engaged, payers).groupBy("platform").agg(
            F.count(USER).alias("num_user")
        )

    def memberships_(t, s):
        events = {"won": "win_level", "paid": "in_app_purchase", "watched": "ads_reward_complete"}
        return memberships(*(tag(t.get(e, USER), **{n: "true"}) for n, e in events.items()))

    def merge_by_level_(t, s):
        boosts, ads = (
            t.get(event, USER, "level", scope=s.scope).groupBy("level").agg(F.count("*").alias(n))
            for n, event in (("num_booster", "booster_use"), ("num_adrw", "af_rewarded"))
        )
        return merge_by_level(boosts, ads)

    def pivot_labels_(t, s):
        revenue = t.get("in_app_purchase", DAY, "platform", "event_value_in_usd")
        columns = {"IOS": "max_ios", "ANDROID": "max_android"}
        value = F.col("event_value_in_usd")
        return pivot_labels(revenue, DAY, columns, value=value, how=F.max, label="platform")

    def attribute_to_level_(t, s):
        bought = t.get("in_app_purchase", USER, TIME).withColumn("purchases", F.lit(1))
        starts = in_users(t.get("start_level", USER, TIME, "level"), bought)
        return attribute_to_level(bought, starts, ["purchases"])

    return {
        "in_users": _on_tables(in_users_),
        "not_in_users": _on_tables(not_in_users_),
        "memberships": _on_tables(memberships_),
        "merge_by_level": _on_tables(merge_by_level_),
        "pivot_labels": _on_tables(pivot_labels_),
        "first_per_user": _on_tables(
            lambda t, s: first_per_user(
                t.get("in_app_purchase", USER, TIME, "event_value_in_usd"), "event_value_in_usd"
            )
        ),
        "level_intervals": _on_tables(
            lambda t, s: level_intervals(t.get("start_level", USER, TIME, "level"))
        ),
        "attribute_to_level": _on_tables(attribute_to_level_),
    }


def _log_queries() -> dict[str, Query]:
    """The raw log: event names and flattening."""
    return {
        "event_names": lambda spark, sf_dir: activity.event_names(
            shard_range(raw_log(spark, sf_dir), 20240115, 20240115)
        ),
        "flatten_event": lambda spark, sf_dir: flatten_event(
            shard_range(raw_log(spark, sf_dir), 20240101, 20240130), "start_level"
        ),
        "flatten_purchases": lambda spark, sf_dir: flatten_event(
            shard_range(raw_log(spark, sf_dir), 20240105, 20240130), "in_app_purchase"
        ),
        "flatten_int_slot": lambda spark, sf_dir: flatten_event(
            shard_range(raw_log(spark, sf_dir, typed=True), 20240101, 20240130),
            "start_level",
            TYPED_PARAMS["start_level"],
        ),
    }


def _scratch(spark: SparkSession) -> str:
    """The cluster's shared folder if it names one, else one for this run."""
    return spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="playlens-")


def _stored_log(spark: SparkSession, sf_dir: str) -> str:
    """The raw log written by day shard."""
    root = f"{_scratch(spark)}/log-{uuid4().hex}"
    raw_log(spark, sf_dir).write.partitionBy("shard").parquet(f"{root}/raw")
    return root


def _stored_queries() -> dict[str, Query]:
    """The way from a stored log to stored event tables and back, a range of shards at a time."""

    def names(spark, sf_dir):
        return activity.event_names(read_events(spark, f"{_stored_log(spark, sf_dir)}/raw", 20240115))

    def outcomes(spark, sf_dir):
        root = _stored_log(spark, sf_dir)
        for shards in ((20240101, 20240118), (20240115, 20240130)):  # some days twice
            events = read_events(spark, f"{root}/raw", *shards)
            write_event_tables(events, ["start_level", "win_level", "lose_level"], f"{root}/flat", shards)
        return levels.level_outcomes(EventTables.from_parquet(spark, f"{root}/flat"))

    def in_two_runs(spark, sf_dir):
        """Wins come in late, after everything else was flattened; typed slots, a manifest and its ledger."""
        root = f"{_scratch(spark)}/runs-{uuid4().hex}"
        log = raw_log(spark, sf_dir, typed=True)
        for part in ("event_name <> 'win_level'", "event_name = 'win_level'"):
            log.filter(part).write.mode("append").partitionBy("shard").parquet(f"{root}/raw")
            flatten_new(spark, f"{root}/raw", TYPED_PARAMS, f"{root}/flat", params=TYPED_PARAMS)
        return levels.level_outcomes(EventTables.from_parquet(spark, f"{root}/flat"))

    return {
        "stored_event_names": names,
        "stored_level_outcomes": outcomes,
        "level_outcomes_in_two_runs": in_two_runs,
    }


def _activity_queries() -> dict[str, Query]:
    return {
        "dau": _on_tables(lambda t, s: activity.dau(t, platform=s.scope.platform)),
        "dau_by_platform": _on_tables(lambda t, s: activity.dau_by_platform(t)),
        "dau_latest": _on_tables(lambda t, s: activity.dau_by_platform(t, limit=100)),
        "users_by_country": _on_tables(
            lambda t, s: activity.users_by_country(t, s.scope, MORE_THAN_USERS)
        ),
        "new_users": _on_tables(lambda t, s: activity.new_users(t, s.scope, s.first_open)),
        "engaged_non_payers": _on_tables(
            lambda t, s: activity.engaged_non_payers(t, s.scope, s.whole), MARKET_SPEC
        ),
        "dau_by_payer": _on_tables(
            lambda t, s: activity.dau_by_label(
                t, s, segments.cohort_payer_labels(t, s), _names("dau_{}", "iap", "non_iap")
            )
        ),
        "dau_pct_by_payer": _on_tables(
            lambda t, s: activity.dau_pct_by_label(
                t, s, segments.payer_labels(t, s), _names("percent_dau_{}", "iap", "non_iap"), all_days=True
            )
        ),
        "dau_pct_by_payer_fixed": _on_tables(
            lambda t, s: activity.dau_pct_by_label(
                t,
                s,
                segments.payer_labels(t, s),
                _names("percent_dau_{}", "iap", "non_iap"),
                denominators=TYPED_IN_SIZES,
                all_days=True,
            )
        ),
        "dau_pct_by_ad": _on_tables(
            lambda t, s: activity.dau_pct_by_label(
                t, s, segments.ad_labels(t, s), _names("percent_dau_{}", "adrw", "non_adrw"), all_days=True
            )
        ),
        "dau_pct_by_skill": _on_tables(
            lambda t, s: activity.dau_pct_by_label(
                t, s, segments.skill_segments(t, s), _names("percent_dau_{}", "best", "worst")
            )
        ),
        "retention": _on_tables(
            lambda t, s: activity.retention(
                t, segments.skill_segments(t, s), first_open=s.first_open
            )
        ),
        "retention_rate": _on_tables(
            lambda t, s: activity.retention_rate(
                t, segments.skill_segments(t, s), first_open=s.first_open
            )
        ),
    }


def _payment_queries() -> dict[str, Query]:
    return {
        "pay_rate_by_country": _on_tables(
            lambda t, s: payments.pay_rate_by_country(t, s.scope, MORE_THAN_USERS)
        ),
        "revenue_by_country": _on_tables(lambda t, s: payments.revenue_by_country(t, s.scope)),
        "revenue_by_market": _on_tables(
            lambda t, s: payments.revenue_by_country(t, s.scope), MARKET_SPEC
        ),
        "first_purchase_by_level": _on_tables(
            lambda t, s: payments.first_purchase_by_level(t, s.scope)
        ),
        "purchases_by_level": _on_tables(lambda t, s: payments.purchases_by_level(t, s.scope)),
        "purchases_vs_first": _on_tables(
            lambda t, s: payments.purchases_vs_first(t, s.scope, LEVELS_SHOWN)
        ),
        "payer_count": _on_tables(lambda t, s: payments.payer_count(t)),
        "days_to_first_purchase": _on_tables(
            lambda t, s: payments.days_to_first_purchase(t, s.scope)
        ),
        "pay_counts_by_ad": _on_tables(
            lambda t, s: payments.pay_counts_by_segment(t, s, segments.ad_lists(t, s))
        ),
        "pay_rate_by_ad": _on_tables(
            lambda t, s: payments.pay_rate_by_segment(t, s, segments.ad_lists(t, s))
        ),
        "pay_rate_by_skill": _on_tables(
            lambda t, s: payments.pay_rate_by_segment(
                t, s, segments.skill_segments(t, s).filter(F.col(LABEL) != segments.MIDDLE)
            )
        ),
        "paying_ad_users": _on_tables(
            lambda t, s: payments.paying_members(t, s, segments.ad_users(t, s))
        ),
    }


def _segment_queries() -> dict[str, Query]:
    return {
        "cohort": _on_tables(segments.cohort),
        "cohort_split_counts": _on_tables(segments.cohort_split_counts),
        "payer_users": _on_tables(segments.payer_users),
        "payer_users_by_market": _on_tables(segments.payer_users, MARKET_SPEC),
        "non_payer_users": _on_tables(segments.non_payer_users),
        "non_payer_users_by_market": _on_tables(segments.non_payer_users, MARKET_SPEC),
        "payer_segments": _on_tables(segments.payer_segments),
        "payer_segments_by_market": _on_tables(segments.payer_segments, MARKET_SPEC),
        "ad_users": _on_tables(segments.ad_users),
        "non_ad_users": _on_tables(segments.non_ad_users),
        "ad_segments": _on_tables(segments.ad_segments),
        "segment_sizes": _on_tables(
            lambda t, s: segments.segment_sizes(segments.payer_lists(t, s))
        ),
        "segment_sizes_by_ad": _on_tables(
            lambda t, s: segments.segment_sizes(segments.ad_lists(t, s))
        ),
        "segment_sizes_by_skill": _on_tables(
            lambda t, s: segments.segment_sizes(segments.skill_segments(t, s))
        ),
        "attempt_ratio": _on_tables(segments.attempt_ratio),
        "attempt_ratio_fine": _on_tables(lambda t, s: segments.attempt_ratio(t, s, decimals=4)),
        "skill_segments": _on_tables(segments.skill_segments),
        "booster_segments": _on_tables(lambda t, s: segments.booster_segments(t, s, min_uses=3)),
        "early_ad_segments": _on_tables(lambda t, s: segments.early_ad_segments(t, s, level=5)),
        "early_payer_segments": _on_tables(segments.early_payer_segments),
        "early_payer_level_segments": _on_tables(
            lambda t, s: segments.early_payer_level_segments(t, s, level=10)
        ),
    }


def _level_queries() -> dict[str, Query]:
    by = {
        "payer": segments.payer_lists,
        "ad": segments.ad_lists,
        "skill": lambda t, s: segments.skill_segments(t, s).filter(F.col(LABEL) != segments.MIDDLE),
    }
    found: dict[str, Query] = {
        "user_max_level": _on_tables(lambda t, s: levels.user_max_level(t)),
        "user_max_level_of_one": _on_tables(lambda t, s: levels.user_max_level(t, "1")),
        "apu_by_payer_all_levels": _on_tables(
            lambda t, s: levels.apu_by_label(t, segments.payer_lists(t, s))
        ),
        "level_outcomes": _on_tables(lambda t, s: levels.level_outcomes(t)),
    }
    for name, labels in by.items():
        found[f"winrate_by_{name}"] = _on_tables(
            lambda t, s, labels=labels: levels.winrate_by_label(t, labels(t, s))
        )
        found[f"winrate_rolling_by_{name}"] = _on_tables(
            lambda t, s, labels=labels: levels.winrate_rolling_by_label(t, labels(t, s), 8)
        )
        found[f"apu_by_{name}"] = _on_tables(
            lambda t, s, labels=labels: levels.apu_by_label(t, labels(t, s), LEVELS_DRAWN)
        )
        found[f"level_curves_by_{name}"] = _on_tables(
            lambda t, s, labels=labels: levels.level_curves_by_label(
                t, labels(t, s), LEVELS_DRAWN
            )
        )
    found |= {
        "funnel_by_payer": _on_tables(
            lambda t, s: levels.funnel_by_label(
                t,
                s,
                segments.payer_labels(t, s),
                _names("user_{}", "iap", "non_iap"),
                _names("{}_drop", "iap", "non_iap"),
            )
        ),
        "funnel_by_ad": _on_tables(
            lambda t, s: levels.funnel_by_label(
                t,
                s,
                segments.ad_lists(t, s),
                _names("user_{}", "adrw", "non_adrw"),
                _names("{}_drop", "adrw", "non_adrw"),
            )
        ),
        "funnel_by_skill": _on_tables(
            lambda t, s: levels.funnel_by_label(
                t,
                s,
                segments.skill_segments(t, s),
                _names("user_{}", "best", "worst"),
                _names("{}_drop", "best", "worst"),
            )
        ),
        "level_users_by_ad": _on_tables(
            lambda t, s: levels.level_split_by_label(
                t,
                s,
                segments.ad_lists(t, s),
                {"adrw": "user_ad_rw", "non_adrw": "user_non_ad_rw"},
                {"adrw": "ad_rw_pct", "non_adrw": "non_ad_rw_pct"},
                LEVELS_SHOWN,
            )
        ),
        "attempt_ratio_distribution": _on_tables(
            lambda t, s: levels.attempt_ratio_distribution(segments.attempt_ratio(t, s))
        ),
        "attempt_ratio_cumulative_half_even": _on_tables(
            lambda t, s: levels.attempt_ratio_cumulative(segments.attempt_ratio(t, s), half_even=True)
        ),
        "attempt_ratio_cumulative": _on_tables(
            lambda t, s: levels.attempt_ratio_cumulative(segments.attempt_ratio(t, s))
        ),
    }
    return found


def _usage_queries() -> dict[str, Query]:
    def kinds(event, kind, labels, what, *names):
        return _on_tables(
            lambda t, s: usage.users_by_kind(
                t,
                event,
                kind,
                s.scope,
                labels(t, s),
                _names(f"num_{what}_by_{{}}", *names),
                _names("pct_by_{}", *names),
                all_kinds=True,
            )
        )

    def per_level(use):
        return _on_tables(
            lambda t, s: usage.use_per_starter_by_level(
                t, segments.skill_segments(t, s), use, USES[use], LEVELS_DRAWN
            )
        )

    return {
        "ad_placement_by_payer": kinds(
            "ads_reward_complete", "placement", segments.payer_labels, "ads", "iap", "non_iap"
        ),
        "booster_type_by_payer": kinds(
            "booster_use", "booster_type", segments.payer_labels, "booster", "iap", "non_iap"
        ),
        "booster_type_by_ad": kinds(
            "booster_use",
            "booster_type",
            lambda t, s: segments.ad_labels(t, s, engaged_any_time=True),
            "booster",
            "adrw",
            "non_adrw",
        ),
        "ads_per_user_by_country": _on_tables(
            lambda t, s: usage.ads_per_user_by_country(t, s.scope, MORE_THAN_ADS)
        ),
        "booster_by_level_skill": per_level("booster"),
        "ad_by_level_skill": per_level("adrw"),
        "overall_usage_by_skill": _on_tables(
            lambda t, s: usage.overall_usage(t, segments.skill_segments(t, s), USES)
        ),
    }


def _few_user_queries() -> dict[str, Query]:
    """Queries that drop players without a label early; results are those of the plain ones."""
    skill = lambda t, s: segments.skill_segments(t, s).filter(F.col(LABEL) != segments.MIDDLE)
    few = {"few_users": True}
    plans = {
        "winrate_by_skill": lambda t, s: levels.winrate_by_label(t, skill(t, s), **few),
        "winrate_rolling_by_ad": lambda t, s: levels.winrate_rolling_by_label(
            t, segments.ad_lists(t, s), 8, **few
        ),
        "apu_by_payer": lambda t, s: levels.apu_by_label(
            t, segments.payer_lists(t, s), LEVELS_DRAWN, **few
        ),
        "dau_by_payer": lambda t, s: activity.dau_by_label(
            t, s, segments.cohort_payer_labels(t, s), _names("dau_{}", "iap", "non_iap"), **few
        ),
        "level_users_by_ad": lambda t, s: levels.level_split_by_label(
            t,
            s,
            segments.ad_lists(t, s),
            {"adrw": "user_ad_rw", "non_adrw": "user_non_ad_rw"},
            {"adrw": "ad_rw_pct", "non_adrw": "non_ad_rw_pct"},
            LEVELS_SHOWN,
            **few,
        ),
        "booster_by_level_skill": lambda t, s: usage.use_per_starter_by_level(
            t, segments.skill_segments(t, s), "booster", USES["booster"], LEVELS_DRAWN, **few
        ),
    }
    return {name: _on_tables(plans[plain]) for name, plain in sql_twins.FEW.items()}


def _bloom_queries() -> dict[str, Query]:
    """The same with a Bloom filter of the labelled users at the scan."""

    def on(labels, plan):
        def run(tables, spec):
            chosen = labels(tables, spec)
            return plan(tables, spec, chosen, UserFilter.of(chosen, EXPECTED_USERS))

        return _on_tables(run)

    skill = lambda t, s: segments.skill_segments(t, s).filter(F.col(LABEL) != segments.MIDDLE)
    return {
        "winrate_by_skill_bloom": on(skill, lambda t, s, l, few: levels.winrate_by_label(t, l, few_users=few)),
        "dau_by_payer_bloom": on(
            segments.cohort_payer_labels,
            lambda t, s, l, few: activity.dau_by_label(t, s, l, _names("dau_{}", "iap", "non_iap"), few_users=few),
        ),
        "retention_bloom": on(
            segments.skill_segments, lambda t, s, l, few: activity.retention(t, l, few_users=few)
        ),
    }


def _sketch_queries() -> dict[str, Query]:
    """Exact user counts, and whether counts from stored daily sketches come near them."""

    def stored(spark, tables):
        path = f"{_scratch(spark)}/sketches-{uuid4().hex}"
        sketches.write_sketches(sketches.daily_sketches(tables), path)
        return spark.read.parquet(path)

    def near(exact, estimated, *keys):
        off = F.abs(F.col("estimate") - F.col("num_user")) <= SKETCH_ERROR * F.col("num_user")
        return exact.join(estimated, [*keys]).select(*keys, "num_user", off.alias("near"))

    def by_platform(spark, sf_dir):
        tables = bind(spark, sf_dir)
        sessions = tables.get("session_start", USER, "platform", dates=SPEC.regard)
        estimated = sketches.estimated_users(stored(spark, tables), SPEC.regard, ["platform"], "estimate")
        return near(count_users(sessions, "platform"), estimated, "platform")

    def weekly(spark, sf_dir):
        tables = bind(spark, sf_dir)
        days = tables.get("session_start", USER, DAY).distinct()
        ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda n: F.date_add(DAY, n)))
        exact = count_users(days.select(USER, ends.alias("window_end")), "window_end")
        return near(exact, sketches.rolling_users(stored(spark, tables), 7, name="estimate"), "window_end")

    return {"users_by_platform_sketch": by_platform, "weekly_users_sketch": weekly}


def _bucketed_queries() -> dict[str, Query]:
    """Over event tables of the catalog that are bucketed by user."""

    def winrate(spark, sf_dir):
        database = f"playlens_{uuid4().hex}"
        folder = f"{_scratch(spark)}/{database}"
        spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
        names = ["first_open", "start_level", "win_level", "lose_level"]
        stored = write_bucketed(bind(spark, sf_dir), names, folder, BUCKETS, database)
        return levels.winrate_by_label(stored, segments.skill_segments(stored, SPEC).filter(F.col(LABEL) != segments.MIDDLE))

    return {"winrate_by_skill_bucketed": winrate}


def _hard_queries() -> dict[str, Query]:
    """Analyses over the harder log: unknown users, one busy user, equal times, 100 levels."""
    plans = {
        "revenue_by_country": lambda t, s: payments.revenue_by_country(t, s.scope),
        "level_outcomes": lambda t, s: levels.level_outcomes(t),
        "ads_per_user_by_country": lambda t, s: usage.ads_per_user_by_country(
            t, s.scope, MORE_THAN_ADS
        ),
        "payer_segments": segments.payer_segments,
        "ad_segments": segments.ad_segments,
        "apu_by_payer": lambda t, s: levels.apu_by_label(t, segments.payer_lists(t, s)),
        "winrate_by_payer": lambda t, s: levels.winrate_by_label(t, segments.payer_lists(t, s)),
        "purchases_by_level": lambda t, s: payments.purchases_by_level(t, s.scope),
        "purchases_vs_first": lambda t, s: payments.purchases_vs_first(t, s.scope),
        "retention": lambda t, s: activity.retention(
            t, segments.skill_segments(t, s), first_open=s.first_open
        ),
        "days_to_first_purchase": lambda t, s: payments.days_to_first_purchase(t, s.scope),
        "user_max_level": lambda t, s: levels.user_max_level(t),
        "level_intervals": lambda t, s: level_intervals(t.get("start_level", USER, TIME, "level")),
        "first_per_user": lambda t, s: first_per_user(
            t.get("in_app_purchase", USER, TIME, "event_value_in_usd"), "event_value_in_usd"
        ),
        "booster_by_level_skill": lambda t, s: usage.use_per_starter_by_level(
            t, segments.skill_segments(t, s), "booster", USES["booster"]
        ),
    }
    return {name: _on_tables(plans[plain], hard=True) for name, plain in sql_twins.HARD.items()}


def corpus() -> dict[str, Query]:
    """The corpus operators and their pipeline, where they are installed."""
    if corpus_queries is None:
        return {}
    return {**corpus_queries.queries(), "pipeline": corpus_pipeline.run}


def entry(spark: SparkSession) -> DataFrame:
    """Daily activity of payers and non-payers in percent of their segment."""
    return queries()["dau_pct_by_payer"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """Every analysis and building block by name."""
    return {
        **_log_queries(),
        **_stored_queries(),
        **_activity_queries(),
        **_payment_queries(),
        **_segment_queries(),
        **_level_queries(),
        **_usage_queries(),
        **_set_queries(),
        **_few_user_queries(),
        **_bloom_queries(),
        **_sketch_queries(),
        **_bucketed_queries(),
        **_hard_queries(),
        **corpus(),
    }


def oracle_sql() -> dict[str, str]:
    """The same results as DuckDB SQL over the test tables."""
    return {
        **sql_twins.statements(),
        **(corpus_queries.oracle_sql() if corpus_queries else {}),
    }
