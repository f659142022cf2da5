"""Two segments side by side, on every count the analyses know."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame

from playlens.model import LABEL, CohortSpec, DateRange, EventTables, quoted
from playlens.operators import FewUsers
from playlens.plans import activity, levels, payments, segments, usage


@dataclass
class Kept:
    """Labels worked out once; ``release`` gives back what holds them, also at the end of a ``with``."""

    frame: DataFrame
    release: Callable[[], None]

    def __enter__(self) -> DataFrame:
        return self.frame

    def __exit__(self, *failure: object) -> None:
        self.release()


def keep(labels: DataFrame, folder: str | None = None) -> Kept:
    """Labels worked out once for many analyses.

    With a ``folder`` that all executors share they are written to a new table in
    it at once, whose size Spark then knows; ``release`` deletes that table.  Without one
    they are cached as they are first read, and worked out again where an executor
    was lost; ``release`` drops the cache.
    """
    if folder is None:
        cached = labels.persist()
        return Kept(cached, lambda: cached.unpersist() and None)
    spark = labels.sparkSession
    path = f"{folder}/labels-{uuid4().hex}"
    labels.write.parquet(path)

    def delete() -> None:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        settings = spark.sparkContext._jsc.hadoopConfiguration()
        found.getFileSystem(settings).delete(found, True)

    return Kept(spark.read.schema(labels.schema).parquet(path), delete)


def compare_segments(
    tables: EventTables,
    spec: CohortSpec,
    labels: DataFrame,
    one: str,
    other: str,
    few_users: FewUsers = True,
    max_level: int | None = None,
    first_open: DateRange | None = None,
) -> dict[str, DataFrame]:
    """The comparisons of two segments by name, all on the same labels and all lazy.

    Every comparison reads ``labels``, so they are best kept by :func:`keep`.  Cohorts
    of some days are a small part of all players, so events of others are dropped
    early unless ``few_users`` is unset.  ``max_level`` cuts the level curves;
    ``first_open`` as in :func:`playlens.plans.activity.retention`.
    """
    kept = labels
    pair = kept.filter(f"{LABEL} in ({quoted(one)}, {quoted(other)})")
    few = {"few_users": few_users}

    def names(pattern: str) -> dict[str, str]:
        return {label: pattern.format(label) for label in (one, other)}

    def kinds(event: str, kind: str) -> DataFrame:
        counts, shares = names("num_users_{}"), names("pct_{}")
        return usage.users_by_kind(tables, event, kind, spec.scope, kept, counts, shares, **few)

    uses = {"booster": "booster_use", "adrw": "af_rewarded"}
    return {
        "sizes": segments.segment_sizes(pair),
        "daily_activity": activity.dau_pct_by_label(
            tables, spec, kept, names("percent_dau_{}"), **few
        ),
        "retention": activity.retention_rate(tables, pair, first_open=first_open, **few),
        "level_curves": levels.level_curves_by_label(tables, pair, max_level, **few),
        "funnel": levels.funnel_by_label(
            tables, spec, pair, names("user_{}"), names("{}_drop"), **few
        ),
        "ad_placements": kinds("ads_reward_complete", "placement"),
        "booster_types": kinds("booster_use", "booster_type"),
        "usage": usage.overall_usage(tables, pair, uses, (one, other), **few),
        "pay_rate": payments.pay_rate_by_segment(tables, spec, pair),
    }
