"""Sharded text files, and moving them to other shards with the fewest bytes on the way.

A dataset is a folder of generations, each with files under ``shard=K``, and a manifest that
lists the files that count with their shard, rows and bytes.  Resharding weighs the files
of every shard, asks a minimum-cost flow how many bytes go from which old shard to which
new one, turns that into whole files and at most one file to cut for each transfer, and writes only
those anew.  Files that stay are neither read nor written.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from playlens.llm.common import written

_FILE = "shard int, path string, rows long, bytes long"


@dataclass(frozen=True)
class Shards:
    """A dataset: its folder, the columns of its files and its manifest (``shard, path, rows, bytes``)."""

    root: str
    schema: StructType
    manifest: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.manifest.sparkSession


def shares(total: int, weights: Sequence[int]) -> list[int]:
    """``total`` dealt out by weight, each share within one of its exact value."""
    ends = np.cumsum([0, *weights]).tolist()
    cuts = [total * e // ends[-1] for e in ends]
    return [b - a for a, b in zip(cuts, cuts[1:], strict=False)]


def transfers(sizes: Sequence[int], capacities: Sequence[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Bytes from each old shard (row) to each new one (column) at the least total cost.

    Sizes and capacities have the same sum.  ``cost`` is an integer per byte; without it staying in
    the shard of the same number is free and moving costs one, so that the fewest bytes
    move.  Shortest augmenting paths: every step finds, with flows already sent as ways
    back, the cheapest path from an old shard with bytes left to a new one with room.
    """
    if sum(sizes) != sum(capacities):
        raise ValueError("sizes and capacities must have the same sum")
    n, m = len(sizes), len(capacities)
    price = np.ones((n, m), np.int64) - np.eye(n, m, dtype=np.int64) if cost is None else np.asarray(cost, np.int64)
    flow = np.zeros((n, m), object)
    left, room = [int(s) for s in sizes], [int(c) for c in capacities]
    far = np.iinfo(np.int64).max // 4
    while any(left):
        to_old = np.array([0 if s else far for s in left], np.int64)
        to_new = np.full(m, far)
        before_old, before_new = np.full(n, -1), np.full(m, -1)
        while True:
            paths = to_old[:, None] + price
            nearer = paths.min(axis=0) < to_new  # only then, so that ties make no circle
            to_new = np.where(nearer, paths.min(axis=0), to_new)
            before_new = np.where(nearer, paths.argmin(axis=0), before_new)
            back = np.where(flow > 0, to_new[None, :] - price, far)
            nearer = back.min(axis=1) < to_old
            if not nearer.any():
                break
            to_old = np.where(nearer, back.min(axis=1), to_old)
            before_old = np.where(nearer, back.argmin(axis=1), before_old)
        new = min((j for j in range(m) if room[j]), key=lambda j: (to_new[j], j))
        steps, end = [], new
        while True:
            old = int(before_new[end])
            steps.append((old, end, 1))
            if before_old[old] < 0:
                break
            end = int(before_old[old])
            steps.append((old, end, -1))
        most = min([left[old], room[new], *(flow[i, j] for i, j, way in steps if way < 0)])
        for i, j, way in steps:
            flow[i, j] += way * most
        left[old] -= most
        room[new] -= most
    return flow


def _stored(spark: SparkSession, shards: Shards, paths: list[str]) -> DataFrame:
    """The rows of some files with ``path`` and their place ``at`` in the file."""
    if not paths:
        empty = spark.createDataFrame([], shards.schema)
        return empty.select("*", F.lit("").alias("path"), F.lit(0).cast("long").alias("at"))
    found = spark.read.schema(shards.schema).parquet(*(f"{shards.root}/{p}" for p in paths))
    return found.select("*", _path(), F.col("_metadata.row_index").alias("at"))


def _path() -> Column:
    return F.substring_index("_metadata.file_path", "/", -3).alias("path")


def _write(rows: DataFrame, root: str) -> DataFrame:
    """A new generation of files by the column ``shard``, and their part of a manifest."""
    spark, generation = rows.sparkSession, f"g-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(f"{root}/{generation}")
    found = spark.read.schema(rows.schema).parquet(f"{root}/{generation}")
    return found.groupBy(F.col("shard").cast("int").alias("shard"), _path()).agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes")
    )


def lay_out(
    documents: DataFrame, root: str, shards: int, *, id_col: str = "doc_id", text_col: str = "text"
) -> Shards:
    """Write documents to ``root``, equal texts to the same of so many shards.

    Files hold ``id``, ``text``, ``size`` (UTF-8 bytes of the text plus one) and all other columns in a struct
    ``rest``, whatever their names.  A null text has size one.  Every task writes a file
    for each shard it has rows of; nothing is shuffled.
    """
    text = F.col(text_col).cast("string")
    own = [c for c in documents.columns if c not in (id_col, text_col)]
    rest = F.struct(*(F.col(f"`{c}`") for c in own)) if own else F.lit(None).cast("string")
    rows = documents.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        rest.alias("rest"),
        F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(shards)).cast("int").alias("shard"),
    )
    manifest = written(_write(rows, root), "manifest")
    return Shards(root, rows.drop("shard").schema, manifest)


def _deal(rows: pa.Table, goals: dict[int, int]) -> list[int]:
    """A shard for every row of a cut file, so that each gets about its bytes.

    The largest rows go first, each to the shard that lacks most: what is left over is about the
    size of the smallest rows.
    """
    sizes = rows.column("size").to_numpy()
    heap = [(-need, shard) for shard, need in sorted(goals.items())]
    heapq.heapify(heap)
    out = [0] * len(sizes)
    for i in np.lexsort((rows.column("at").to_numpy(), -sizes)).tolist():
        need, shard = heap[0]
        out[i] = shard
        heapq.heapreplace(heap, (need + int(sizes[i]), shard))
    return out


def _goals(shards: Shards, capacities: Sequence[int], flow: np.ndarray, numbers: list[int]) -> DataFrame:
    """``shard, path, rows, bytes, goals``: for every file the shards its bytes go to.

    A shard's files lie on a line in order of their names; what stays comes first.
    """
    spark = shards.spark
    cuts = []
    for i, old in enumerate(numbers):
        at = 0
        for new in sorted(range(len(capacities)), key=lambda j: (j != old, j)):
            if flow[i, new]:
                cuts.append((old, at, at + int(flow[i, new]), new))
                at = cuts[-1][2]
    cut = spark.createDataFrame(cuts, "shard int, low long, high long, goal int")
    line = Window.partitionBy("shard").orderBy("path")
    files = shards.manifest.withColumn("end", F.sum("bytes").over(line)).withColumn("start", F.col("end") - F.col("bytes"))
    part = F.least("high", "end") - F.greatest("low", "start")
    return (
        files.join(F.broadcast(cut), "shard")  # at most a row per old and new shard
        .withColumn("part", part)
        .filter("part > 0")
        .groupBy("shard", "path", "rows", "bytes")
        .agg(F.map_from_entries(F.collect_list(F.struct("goal", "part"))).alias("goals"))
    )


def reshard(shards: Shards, weights: Sequence[int], cost: np.ndarray | None = None) -> Shards:
    """The same documents in ``len(weights)`` shards whose bytes are in the ratio of the weights.

    Old shards keep what fits into the new shard of the same number; ``cost`` as in :func:`transfers`, by
    old shard in order of number.  A file that goes to one other shard as a whole, and one that is cut, is
    written anew; the manifest of the result lists those and the files that stay.  The given
    manifest stays valid, so a reader or a failed run loses nothing.  Sizes miss their share by
    about the smallest rows of the cut files, or by a row that is larger than a share.

    The driver holds one number per old and new shard and the names of the files that move;
    a cut file's row sizes are one task.
    """
    spark = shards.spark
    by_shard = shards.manifest.groupBy("shard").agg(F.sum("bytes").alias("bytes")).orderBy("shard").collect()
    numbers, sizes = [r.shard for r in by_shard], [r.bytes for r in by_shard]
    capacities = shares(sum(sizes), weights)
    if cost is None:
        cost = np.array([[int(i != j) for j in range(len(weights))] for i in numbers]).reshape(len(numbers), len(weights))
    flow = transfers(sizes, capacities, cost)
    files = written(_goals(shards, capacities, flow, numbers), "file-goals")
    whole, cut = files.filter("size(goals) = 1"), files.filter("size(goals) > 1")
    whole = whole.withColumn("goal", F.map_keys("goals")[0])
    moved = [r.path for r in whole.filter("goal != shard").select("path").collect()]
    goals = {r.path: dict(r.goals) for r in cut.select("path", "goals").collect()}  # one for each transfer at most

    def deal(key: tuple, rows: pa.Table) -> pa.Table:
        name = key[0].as_py()
        given = [pa.array([name] * rows.num_rows, pa.string()), rows.column("at"), pa.array(_deal(rows, goals[name]), pa.int32())]
        return pa.table(given, names=["path", "at", "shard"])

    in_cut = _stored(spark, shards, list(goals))
    dealt = in_cut.select("path", "at", "size").groupBy("path").applyInArrow(deal, "path string, at long, shard int")
    columns = [*shards.schema.names, "shard"]
    rewritten = (
        _stored(spark, shards, moved)
        .join(whole.select("path", F.col("goal").alias("shard")), "path")
        .select(columns)
        .unionAll(in_cut.join(written(dealt, "dealt-rows"), ["path", "at"]).select(columns))
    )
    fresh = _write(rewritten, shards.root)
    stay = whole.filter("goal = shard").select("shard", "path", "rows", "bytes")
    return Shards(shards.root, shards.schema, written(stay.unionAll(fresh.select("shard", "path", "rows", "bytes")), "manifest"))


def read(shards: Shards) -> DataFrame:
    """All rows with their ``shard`` and ``slot``, gapless from 0 in every shard, in order of files."""
    spark = shards.spark
    paths = [r.path for r in shards.manifest.select("path").orderBy("path").collect()]
    before = Window.partitionBy("shard").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.manifest.select("shard", "path", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    rows = _stored(spark, shards, paths).join(starts, "path")
    return rows.select(*shards.schema.names, "shard", (F.col("start") + F.col("at")).alias("slot"))


def balance(
    documents: DataFrame,
    root: str,
    *,
    old_shards: int = 6,
    new_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Shards:
    """Documents laid out by text, equal texts together, then moved to shards of near equal bytes.

    Texts and ids may be null, empty, very long or repeat: every row is a document with a size of its
    own, and only the copies that a full shard can't hold are told apart.  With fewer documents than
    shards some stay empty; an empty table has no files.  Other columns travel in ``rest``.
    """
    laid = lay_out(documents, root, old_shards, id_col=id_col, text_col=text_col)
    return reshard(laid, [1] * new_shards)
