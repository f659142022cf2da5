"""Whitening against numpy, and its cases of nulls, repeats, ties and empty tables."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__ as contract
from playlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"
SMALL = "/root/testdata/sf0.001"


def _plain(vectors: dict, components=16):
    """Distances and projections by numpy and Python integers."""
    x = {k: [int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for k, v in vectors.items()}
    distinct = sorted({tuple(v) for v in x.values()})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in distinct])
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    deviation = {k: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for k, v in x.items()}
    projected = {k: ((np.array(v) - np.array(sums) / n) @ directions) / np.sqrt(values) for k, v in x.items()}
    return n, deviation, projected, values / np.trace(covariance)


def test_query_is_that_of_numpy(spark):
    rows = contract.corpus()["op11_embedding_whitening"](spark, SMALL).collect()
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    n, deviation, projected, explained = _plain(given)
    assert len(rows) == 16 * len(given)
    sign = {}
    for r in rows:
        want = projected[r.vec_id][r.component - 1]
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-7)
        if abs(want) > 1e-6:
            assert sign.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert r.identity_error < 1e-9


def test_unsound_vectors_go_and_repeats_count_once(spark):
    generator = np.random.default_rng(5)
    sound = {i: generator.normal(size=3).astype("f4").tolist() for i in range(1, 30)}
    rows = [*sound.items(), (30, sound[1]), (31, sound[1]), (None, sound[2]), (1, sound[1])]
    rows += [(40, None), (41, [1.0, None, 2.0]), (42, [float("nan")] * 3), (43, [1.0, float("-inf"), 0.0]), (44, []), (45, [1e30] * 3)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' as x", "1 as row", "2 as component", "3 as id").repartition(4)
    found = whitening.whiten(frame).collect()
    n, deviation, projected, _ = _plain(sound)
    assert n == 29 and {r.n for r in found} == {29}
    assert sorted(r.vec_id or 0 for r in found) == sorted([*sound, 30, 31, 0, 1] * 3)
    by_id = {(r.vec_id, r.component): r for r in found}
    assert by_id[30, 1].whitened == by_id[31, 1].whitened == by_id[1, 1].whitened
    for (vec_id, component), r in by_id.items():
        if vec_id in sound:
            assert r.deviation == deviation[vec_id]
            assert abs(r.whitened) == pytest.approx(abs(projected[vec_id][component - 1]), abs=1e-9)


def test_exact_at_large_values(spark):
    rows = [(1, [1e9, 0.0]), (2, [1e9 + 64, 1.0]), (3, [-1e9, 5.0])]
    found = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = {i: [int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in rows}
    sums = [sum(c) for c in zip(*x.values(), strict=True)]
    for i, v in x.items():
        exact = sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert found[i].deviation == (exact if exact < 1 << 63 else None)


def test_no_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component) for r in one) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all(r.n == 1 and r.deviation == 0 and r.whitened is r.explained is r.identity_error is None for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    assert all(r.identity_error < 1e-9 and r.explained == pytest.approx(2 - r.component) for r in flat)


def test_dimensions_apart_and_empty_tables(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(9)] + [(10 + i, [float(i)]) for i in range(4)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.vec_id >= 10, r.component, r.n) for r in found} == {(False, 1, 9), (False, 2, 9), (True, 1, 4)}
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[:2] == ["vec_id", "component"]


def test_columns_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 2)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 512)
    generator = np.random.default_rng(6)
    vectors = {i: generator.normal(size=5).astype("f4").tolist() for i in range(100)}
    found = whitening.whiten(spark.createDataFrame(list(vectors.items()), SCHEMA)).collect()
    _, _, projected, _ = _plain(vectors)
    for r in found:
        assert abs(r.whitened) == pytest.approx(abs(projected[r.vec_id][r.component - 1]), abs=1e-9)
