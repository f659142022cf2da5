"""Search in a grid of tasks: what is shuffled, and results over many groups of blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from playlens.llm import topk_search

K = 5


def _shuffled(plan) -> int:
    """Bytes of rows that went into the exchanges of a plan that ran."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().get("dataSize").get().value() if name == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(_shuffled(children.apply(k)) for k in range(children.size()))


def _plain(rows: list[tuple[int, list[float]]]) -> dict[int, list[tuple[int, int]]]:
    """By query the ids and scores of the k best, computed with whole numbers of any size."""
    whole = [(i, np.array([int(x) for x in np.floor(np.array(v, float) * 256)], object)) for i, v in rows]
    found: dict = {}
    for query, v in whole:
        if query % 50 == 0:
            scores = sorted((-int((v * w).sum()), i) for i, w in whole if i != query and len(w) == len(v))
            found[query] = sorted(found.get(query, []) + scores[:K])[:K]
    return {q: [(i, -score) for score, i in best] for q, best in found.items() if best}


def _found(frame, **options) -> dict[int, list[tuple[int, int]]]:
    found: dict = {}
    for r in sorted(topk_search.top_k(frame, k=K, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    return found


def test_blocks_are_not_copied_for_every_pair(spark):
    n = 12800
    points = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda x: F.sin(x * F.col("vec_id")).cast("float"))
    frame = spark.range(n).select(F.col("id").alias("vec_id"), points.alias("embedding"))
    found = topk_search.top_k(frame, block_rows=64, query_rows=8)  # 200 blocks, 32 of queries
    assert len(found.collect()) == n // 50 * 5
    assert _shuffled(found._jdf.queryExecution().executedPlan()) < 4 * n * (32 * 4 + 8)


def test_grid_of_large_tables():
    for n in (50_000, 600_000, 15_000_000, 75_000_000):
        m, blocks, parts = n // 50, -(-n // 4096), -(-n // 50 // 1024)
        size = m * (64 * 8 + 16 * K)
        across, down = topk_search._grid(n, m, blocks, parts, size, 24)
        assert across <= blocks and down <= parts and size / down <= topk_search.QUERY_BYTES
        assert across * down >= min(24, blocks * parts)
        # Components of two bytes against an input of singles.
        assert 64 * 2 * (down * n + across * m) + 24 * K * across * m < 5 * 64 * 4 * n
    assert topk_search._grid(0, 0, 1, 1, 0, 24) == (1, 1)


def test_results_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERY_BYTES", 1 << 10)
    random_ = np.random.default_rng(4)
    rows = [(int(i), random_.normal(size=6).tolist()) for i in range(900)]
    rows += [(int(i), [1.0, 0.5, 0.0, 0.0, -0.25, 2.0]) for i in random_.permutation(600) + 1000]  # ties
    rows += [(int(i), random_.normal(size=3).tolist()) for i in range(2000, 2200)]
    rows += [(0, rows[0][1]), (1, rows[1][1]), (50, rows[3][1])]  # repeated ids
    rows += [(int(i), (random_.normal(size=6) * scale).tolist()) for i, scale in zip(range(3000, 3020), [1e3, 1e6] * 10, strict=True)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert _found(frame, block_rows=50, query_rows=4) == _found(frame) == _plain(rows)


def test_results_of_single_precision(spark):
    random_ = np.random.default_rng(5)
    points = random_.normal(size=(500, 8)).astype(np.float32)
    rows = [(int(i), [float(x) for x in p]) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert _found(frame, block_rows=40, query_rows=2) == _plain(rows)


def test_scores_are_carried_on():
    random_ = np.random.default_rng(6)
    points = random_.normal(0, 60, (3000, 8)).round()
    points[1000:1900] = points[10]
    ids = random_.permutation(9000)[:3000]
    queries = topk_search.build(ids[:70], points[:70])
    best = topk_search._Best(len(queries.ids), K)
    for part in np.array_split(random_.permutation(3000), 7):
        part = part[np.argsort(ids[part])]
        tree = topk_search.CoverTree.unpacked(topk_search.build(ids[part], points[part]).packed())
        topk_search.search(queries, tree, K, best)
    for row, name in enumerate(queries.ids):
        scores = points @ queries.points[row]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != name][:K]
        assert best.id[row].tolist() == ids[order].tolist() and best.score[row].tolist() == scores[order].tolist()
