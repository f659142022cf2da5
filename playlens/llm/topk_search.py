"""Exact inner-product search with a cover tree on either side.

Vectors are dealt to blocks; every block becomes a cover tree: each node has a centre, the
radius that covers all points below it, and children that cover them with half of that.
A search walks a tree of queries and a tree of vectors together.  With centres ``p, q`` and
radii ``s, r`` no inner product between two nodes exceeds ``<p, q> + r|p| + s|q| + r s``;
a pair is skipped if that lies below the worst k-th score in the query node.  Where points
lie too evenly for a covering to group them, a node stays a leaf and is scanned by one
matrix product.

Blocks meet in a grid of tasks: a task keeps a bounded part of the queries with their best
scores so far, and blocks of vectors go by it one after the other.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from playlens.llm.common import sparing, written

#: Vectors and queries in a block, and bytes of a block's components as doubles.
BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES = 4096, 1024, 1 << 25
#: Bytes of queries, as doubles and with their best scores, that a task keeps.
QUERY_BYTES = 1 << 27
#: Products of a task of a large table; fewer make more tasks and more copies of blocks.
TASK_PRODUCTS = 1 << 38
#: Points in a leaf that are not worth grouping, and points looked at to see if a covering can work.
LEAF, LOOKED_AT = 64, 64
#: Vectors that are scored at once, and below so many a child on the average its brothers are scored with it.
SCORED, SMALL = 1024, 256
#: Inner products below these are exact as singles and doubles, whatever the order of their sums.
EXACT_SINGLE, EXACT = float(1 << 24), float(1 << 52)
#: No score.
NONE = np.iinfo(np.int64).min


@dataclass
class CoverTree:
    """Points in leaf order, ids ascending within a leaf, and nodes as slices of them."""

    ids: np.ndarray
    points: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    first: np.ndarray
    end: np.ndarray
    children: list[list[int]]

    @cached_property
    def longest(self) -> float:
        return float(np.linalg.norm(self.points.astype(np.float64), axis=1).max())

    def packed(self) -> bytes:
        """The tree with its points in the smallest type that holds them."""
        most = np.abs(self.points).max()
        kind = next((t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max), np.float64)
        return pickle.dumps({**{n: getattr(self, n) for n in self.__dataclass_fields__}, "points": self.points.astype(kind)})

    @staticmethod
    def unpacked(data) -> CoverTree:
        return CoverTree(**pickle.loads(data))


def _hopeless(points: np.ndarray, reach: float, most: int) -> bool:
    """Whether far more than ``most`` children are to be expected.

    No child of a covering is within ``reach`` of an earlier one.  Of points so chosen in random
    order there are at least as many as the sum over all points of 1 / (points within reach).
    """
    squares = np.square(points).sum(axis=1)
    chosen = slice(None, None, max(1, len(points) // LOOKED_AT))
    near = np.count_nonzero(squares[chosen, None] + squares - 2 * points[chosen] @ points.T <= reach * reach, axis=1)
    return float(np.mean(1 / np.maximum(near, 1))) * len(points) > 2 * most


def cover(points: np.ndarray, centre: int, reach: float, most: int) -> np.ndarray | None:
    """For every point the child that covers it within ``reach``; None if it takes over ``most``."""
    if _hopeless(points, reach, most):
        return None
    owner = np.full(len(points), -1)
    child, left = 0, np.arange(len(points))
    while True:
        near = np.linalg.norm(points[left] - points[centre], axis=1) <= reach
        owner[left[near]] = owner[centre] = child
        left = left[~near & (left != centre)]
        child += 1
        if not len(left):
            return owner
        if child >= most:
            return None
        centre = int(left[0])


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    """The tree of a block of points with at least one row."""
    order: list[np.ndarray] = []
    nodes: list[list] = []  # centre, radius, first, end, children
    used = 0

    def grow(rows: np.ndarray, centre: int) -> int:
        nonlocal used
        own = points[rows]
        radius = float(np.linalg.norm(own - points[centre], axis=1).max())
        me = len(nodes)
        nodes.append([centre, radius, used, 0, []])
        owner = cover(own, int(np.flatnonzero(rows == centre)[0]), radius / 2, len(rows) // 8) if len(rows) > leaf and radius > 0 else None
        if owner is None:
            order.append(rows[np.argsort(ids[rows], kind="stable")])
            used += len(rows)
        else:
            for child in range(owner.max() + 1):
                below = rows[owner == child]
                nodes[me][4].append(grow(below, centre if child == 0 else int(below[0])))
        nodes[me][3] = used
        return me

    grow(np.arange(len(ids)), 0)
    rows = np.concatenate(order)
    centres = points[[n[0] for n in nodes]]
    return CoverTree(
        ids[rows],
        points[rows],
        centres,
        np.array([n[1] for n in nodes]),
        np.linalg.norm(centres, axis=1),
        np.array([n[2] for n in nodes]),
        np.array([n[3] for n in nodes]),
        [n[4] for n in nodes],
    )


class _Best:
    """The k best of every query so far, by score and then smaller id; ``NONE`` is no score."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of queries from ``first`` on by candidate; candidates in ascending id order."""
        kth = self.score[first : first + len(scores), -1].astype(scores.dtype)
        rows = np.flatnonzero(scores.max(axis=1) >= kth)
        if not len(rows):
            return
        scores, width = scores[rows], scores.shape[1]
        over = scores >= kth[rows, None]
        found = np.bincount((at := np.flatnonzero(over)) // width, minlength=len(rows))
        if (crowded := found > 4 * self.k).any():
            over[crowded] = self._largest(scores[crowded])
            found = np.bincount((at := np.flatnonzero(over)) // width, minlength=len(rows))
        row, column = np.divmod(at, width)
        place = np.arange(len(at)) - np.repeat(np.cumsum(found) - found, found)
        score = np.full((len(rows), self.k + found.max()), NONE)
        name = np.full(score.shape, np.iinfo(np.int64).max)
        score[:, : self.k], name[:, : self.k] = self.score[first + rows], self.id[first + rows]
        own = scores[row, column]
        score[row, self.k + place] = np.where(np.isinf(own), NONE, own).astype(np.int64) if own.dtype.kind == "f" else own
        name[row, self.k + place] = ids[column]
        # ~ turns the order of whole numbers round, without overflow.
        order = np.lexsort((name, ~score), axis=1)[:, : self.k]
        self.score[first + rows] = np.take_along_axis(score, order, 1)
        self.id[first + rows] = np.take_along_axis(name, order, 1)

    def _largest(self, scores: np.ndarray) -> np.ndarray:
        """Where the k largest scores of every row are; of equal ones those that come first."""
        if scores.shape[1] <= self.k:
            return np.ones(scores.shape, bool)
        kth = np.partition(scores, -self.k, axis=1)[:, -self.k :][:, :1]
        over, tied = scores > kth, scores == kth
        room = self.k - over.sum(1, keepdims=True)
        return over | tied & (np.cumsum(tied, axis=1) <= room)


def search(queries: CoverTree, vectors: CoverTree, k: int, best: _Best | None = None) -> _Best:
    """The k best vectors of each query, without rows of the query's own id, added to ``best``.

    Products are taken of singles where their sums are exact, else of doubles.  Where a product
    may be too large for exact sums of doubles, products are taken of long
    integers, whose sums are right whatever overflows on the way, if the result fits a long.
    """
    longest = queries.longest * vectors.longest
    kind = np.float32 if longest < EXACT_SINGLE else np.float64 if longest < EXACT else np.int64
    none = NONE if kind is np.int64 else -np.inf
    asked, given = queries.points.astype(kind), vectors.points.astype(kind)
    best = best or _Best(len(queries.ids), k)

    def bound(q, v):
        """Of one node or many of either tree with one of the other."""
        s, r = queries.radius[q], vectors.radius[v]
        most = queries.centres[q] @ vectors.centres[v].T + r * queries.norm[q] + s * vectors.norm[v] + r * s
        return most + 1e-9 * (queries.norm[q] + s) * (vectors.norm[v] + r) + 1e-6

    def scan(rows: slice, columns: np.ndarray) -> None:
        """``columns`` in ascending id order."""
        for at in range(0, len(columns), SCORED):
            own = columns[at : at + SCORED]
            scores, ids = asked[rows] @ given[own].T, vectors.ids[own]
            low, high = (np.searchsorted(ids, queries.ids[rows], side) for side in ("left", "right"))
            for row in np.flatnonzero(low < high):
                scores[row, low[row] : high[row]] = none
            best.add(rows.start, scores, ids)

    stack = [(float(bound(0, 0)), 0, 0)]
    while stack:
        most, q, v = stack.pop()
        rows = slice(queries.first[q], queries.end[q])
        least = float(best.score[rows, -1].min())
        if most < least:
            continue
        below_q, below_v = np.array(queries.children[q], int), np.array(vectors.children[v], int)
        small = vectors.end[v] - vectors.first[v] < SMALL * len(below_v)
        if len(below_q) and (not len(below_v) or small or vectors.radius[v] < queries.radius[q]):
            reach = bound(below_q, v)
            stack += [(float(reach[i]), int(below_q[i]), v) for i in np.argsort(reach)]
        elif not len(below_v):
            scan(rows, np.arange(vectors.first[v], vectors.end[v]))
        else:
            reach = bound(q, below_v)
            near = np.flatnonzero(reach >= least)
            if small and len(near):
                columns = np.concatenate([np.arange(vectors.first[c], vectors.end[c]) for c in below_v[near]])
                scan(rows, columns[np.argsort(vectors.ids[columns], kind="stable")])
            elif not small:
                stack += [(float(reach[i]), q, int(below_v[i])) for i in near[np.argsort(reach[near])]]
    return best


def _trees(vectors: DataFrame, blocks: int, scale: int) -> DataFrame:
    """One row per block of vectors of one dimension: its number and its tree of ``floor(scale * x)``."""
    place = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")

    def grow(key, block):
        ids = block.column("id").to_numpy()
        points = block.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        tree = build(ids[order], np.floor(points[order].astype(np.float64) * scale)).packed()
        return pa.table({"dimension": [key[0]], "block": [key[1]], "tree": [tree]}).cast(
            pa.schema([("dimension", pa.int32()), ("block", pa.int32()), ("tree", pa.binary())])
        )

    grouped = vectors.withColumn("dimension", F.size("v")).withColumn("block", place).groupBy("dimension", "block")
    return grouped.applyInArrow(grow, "dimension int, block int, tree binary")


def _grid(n: int, m: int, blocks: int, parts: int, query_bytes: int, tasks: int) -> tuple[int, int]:
    """Groups of vector blocks and of query blocks; every pair of groups is a task.

    Groups of queries are small enough to be kept.  Beyond that, vectors are copied once for each
    group of queries and queries once for each group of vectors, so that the grid follows
    their numbers.
    """
    tasks = max(tasks, math.ceil(n * m / TASK_PRODUCTS))
    down = min(parts, max(math.ceil(query_bytes / QUERY_BYTES), round(math.sqrt(tasks * m / max(1, n)))))
    return min(blocks, math.ceil(tasks / max(1, down))), max(1, down)


def _found(queries: CoverTree, best: _Best) -> pa.RecordBatch:
    real = best.score != NONE
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(queries.ids, best.k)[real.ravel()]), pa.array(best.id[real]), pa.array(best.score[real])],
        names=["query_id", "id", "score"],
    )


def top_k(
    vectors: DataFrame,
    *,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, id, score``: the k largest integer inner products of every query.

    Components become ``floor(scale * x)``.  Queries are the rows with an id divisible by
    ``every``, candidates all rows of the same dimension but those with the query's id; ties go to the
    smaller id, and a query with fewer candidates gets them all.  Rows with a null id, a
    null or empty vector, or a component that is null, not finite or beyond a long
    (``scale * x`` of 2**62 and more) take no part.  Scores must fit a long.  An empty table gives no rows.

    Every block of queries meets every block of vectors once.  A task has a group of either: it keeps
    its queries, at most ``QUERY_BYTES``, and vectors pass by block by block, with every query's scores carried
    on.  Blocks are shuffled once for each group of the other side; at most k rows leave a task for a query.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    component = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{component}>").alias("v"))
    given = given.dropna().filter(F.size("v") > 0)
    sound = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float(1 << 62)))
    queried = F.col("id") % every == 0
    asks = F.coalesce(queried, F.lit(False)).cast("int")
    n, long, m, asked_long = (
        x or 0
        for x in given.agg(F.count("*"), F.sum(F.size("v")), F.sum(asks), F.sum(asks * F.size("v"))).first()
    )
    blocks, parts = (
        max(1, math.ceil(rows / most), math.ceil(8 * components / BLOCK_BYTES))
        for rows, most, components in ((n, block_rows, long), (m, query_rows, asked_long))
    )
    across, down = _grid(n, m, blocks, parts, 8 * asked_long + 16 * k * m, spark.sparkContext.defaultParallelism * 4)
    clean = F.coalesce(sound, F.lit(False))
    data = written(_trees(given.filter(clean), blocks, scale), "vector-trees")
    asked = written(_trees(given.filter(queried).filter(clean), parts, scale), "query-trees")

    def dealt(trees: DataFrame, kept: int, own: int, copies: int, cell) -> DataFrame:
        copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        placed = trees.select("dimension", "block", "tree", (F.col("block") % own).alias("own"), copy.alias("copy"))
        return placed.select(cell.cast("int").alias("cell"), F.lit(kept).alias("kind"), "dimension", "block", "tree")

    cells = dealt(asked, 0, down, across, F.col("copy") * down + F.col("own")).union(
        dealt(data, 1, across, down, F.col("own") * down + F.col("copy"))
    )
    placed = cells.repartitionById(across * down, "cell").sortWithinPartitions("cell", "kind", "dimension", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kept = None, {}
        for batch in batches:
            cell, vector, dimension = (batch.column(c).to_numpy() for c in ("cell", "kind", "dimension"))
            for i in range(batch.num_rows):
                if cell[i] != here:
                    yield from (_found(*x) for part in kept.values() for x in part)
                    here, kept = cell[i], {}
                tree = CoverTree.unpacked(batch.column("tree")[i].as_buffer())
                if vector[i]:
                    for queries, best in kept.get(dimension[i], ()):
                        search(queries, tree, k, best)
                else:
                    kept.setdefault(dimension[i], []).append((tree, _Best(len(tree.ids), k)))
        yield from (_found(*x) for part in kept.values() for x in part)

    found = placed.mapInArrow(sparing(run), "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
