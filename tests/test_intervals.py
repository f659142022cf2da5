"""Interval operators against brute force, on users that span many time slices."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from playlens.functions.columns import MICROS_PER_HOUR
from playlens.operators import attribute_to_level, level_intervals

USERS = 60


def _times(rng, n):
    """Times in few hours out of many, with repeats, also at slice borders."""
    hours = [rng.randrange(200) for _ in range(4)]
    offsets = (0, 1, 2, MICROS_PER_HOUR - 1)
    return [rng.choice(hours) * MICROS_PER_HOUR + rng.choice(offsets) for _ in range(n)]


@pytest.fixture(scope="module")
def log():
    rng = random.Random(7)
    starts, points = [], []
    for n in range(USERS):
        user = f"u{n}"
        used = set()
        for t in _times(rng, rng.randrange(1, 25)):
            level = rng.choice([1, 2, 3, None])
            if (t, level) not in used:
                used.add((t, level))
                starts.append((user, t, level))
        times = _times(rng, rng.randrange(0, 15)) + [t + 1 for t, _ in used][:3]
        points += [(user, t) for t in times]
    starts.append((None, 1, 1))
    points.append((None, 5))
    return starts, points


def _key(start):
    _, time, level = start
    return time, level is not None, level or 0


def _per_user(starts):
    users = {}
    for start in starts:
        if start[0] is not None:
            users.setdefault(start[0], []).append(start)
    return {user: sorted(rows, key=_key) for user, rows in users.items()}


@pytest.mark.parametrize("slice_micros", [1, MICROS_PER_HOUR, 500 * MICROS_PER_HOUR])
def test_every_point_goes_to_the_last_start_before_it(spark, log, slice_micros):
    starts, points = log
    expected = Counter()
    ordered = _per_user(starts)
    for user, time in points:
        before = [s for s in ordered.get(user, []) if s[1] <= time]
        if user is not None and before:
            expected[user, before[-1][2]] += 1
    got = attribute_to_level(
        spark.createDataFrame(
            [(*p, 1) for p in points], "user_pseudo_id string, event_timestamp bigint, n int"
        ),
        spark.createDataFrame(
            starts, "user_pseudo_id string, event_timestamp bigint, level bigint"
        ),
        ["n"],
        slice_micros,
    )
    assert {(r[0], r[1]): r[2] for r in got.collect()} == dict(expected)


@pytest.mark.parametrize("slice_micros", [1, MICROS_PER_HOUR, 500 * MICROS_PER_HOUR])
def test_every_attempt_ends_at_the_next_start(spark, log, slice_micros):
    starts, _ = log
    expected = Counter()
    for rows in _per_user(starts).values():
        for start, following in zip(rows, [*rows[1:], (None, None, None)]):
            expected[start[0], start[2], start[1], following[1]] += 1
    got = level_intervals(
        spark.createDataFrame(
            starts, "user_pseudo_id string, event_timestamp bigint, level bigint"
        ),
        slice_micros,
    )
    assert Counter(tuple(r) for r in got.collect()) == expected


def test_intervals_and_attribution_agree(spark, log):
    starts, points = log
    spark.createDataFrame(
        [p for p in points if p[0]], "user_pseudo_id string, event_timestamp bigint"
    ).createOrReplaceTempView("points")
    start_rows = spark.createDataFrame(
        starts, "user_pseudo_id string, event_timestamp bigint, level bigint"
    )
    level_intervals(start_rows).createOrReplaceTempView("intervals")
    joined = spark.sql(
        """
        SELECT p.user_pseudo_id, level, count(*) AS n FROM points p JOIN intervals i
        ON p.user_pseudo_id = i.user_pseudo_id AND event_timestamp >= level_start
        AND (next_start IS NULL OR event_timestamp < next_start)
        GROUP BY ALL"""
    )
    attributed = attribute_to_level(
        spark.table("points").selectExpr("*", "1 as n"), start_rows, ["n"]
    )
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, attributed.collect()))
