"""Near-duplicate documents by b-bit MinHash.

Every document becomes the set of its word shingles.  Of each of a row of hash functions
the smallest value over the set is taken.  Bands of the full minima give candidates; the low
bits of the minima, packed into bit planes, give an estimate of the similarity that is
corrected for chance collisions; what the estimate lets through is confirmed on the full
sets.

Work stays linear in groups of copies: equal sets are one node, and candidates are not
paired within a bucket but gathered around the bucket's leader, the member that shares
buckets with most others.  A cluster is compared in blocks of bounded size, each with
the leader; only what the leader doesn't tie together is compared across blocks.  Blocks
hand on a spanning forest of confirmed links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import sparing, written
from playlens.llm.components import components
from playlens.llm.tokens import slices

#: Bytes of text and hashed shingles handled at once in a task.
CHUNK = 1 << 20
#: Members of a cluster that are compared in one block.
BLOCK = 128
#: Minima in a packed signature, and low bits kept of each.
MINIMA, LOW_BITS = 128, 4

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words`` words; links at ``percent`` similarity or more.

    ``rows`` minima make a band; there are as many bands as miss a pair at the threshold
    with a chance of at most ``miss``, and estimates may fall ``sigmas`` standard
    deviations short.
    """

    words: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-7
    sigmas: float = 5.0
    seed: int = 11

    @property
    def bands(self) -> int:
        hit = (self.percent / 100) ** self.rows
        return max(math.ceil(math.log(self.miss) / math.log1p(-hit)), -(-MINIMA // self.rows))

    @property
    def least_matches(self) -> float:
        """Of ``MINIMA`` low-bit values, those that must agree."""
        chance = 2.0**-LOW_BITS
        agree = chance + (1 - chance) * self.percent / 100
        return MINIMA * agree - self.sigmas * math.sqrt(MINIMA * agree * (1 - agree))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    Words are runs of bytes other than space, tab and line ends, with A-Z in lower case.  A
    text of fewer words than a shingle has its whole sequence as one; one without words
    has none.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b" ".join([*texts, b""]).translate(_FOLD), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    place = np.arange(len(data), dtype=np.int64)
    rank = place - np.maximum.accumulate(np.where(space, 0, np.where(np.concatenate(([True], space[:-1])), place, 0)))
    key = _mixed((data.astype(np.uint64) + (rank.astype(np.uint64) << np.uint64(8))) * _A)
    key[space] = 0
    word = _mixed(np.add.reduceat(key, starts))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    grams = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        grams = _mixed(grams * _A + word[k : len(grams) + k])
    out = []
    for first, end in itertools.pairwise(bounds.tolist()):
        if end - first >= words:
            out.append(np.unique(grams[first : end - words + 1]))
        elif end > first:
            whole = np.uint64(end - first)
            for x in word[first:end]:
                whole = _mixed(np.array([whole], np.uint64) * _A + x)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], settings: Settings) -> np.ndarray:
    """For each non-empty set, the smallest value of every hash function; 32 bits each."""
    random = np.random.default_rng(settings.seed)
    count = settings.bands * settings.rows
    factors = random.integers(0, 1 << 64, count, np.uint64) | np.uint64(1)
    shifts = random.integers(0, 1 << 64, count, np.uint64)
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    found = np.empty((len(sets), count), np.uint32)
    for k in range(count):
        hashed = ((values * factors[k] + shifts[k]) >> np.uint64(32)).astype(np.uint32)
        found[:, k] = np.minimum.reduceat(hashed, starts)
    return found


def packed(found: np.ndarray) -> np.ndarray:
    """The low bits of the first ``MINIMA`` minima as bit planes, a row of bytes per set."""
    low = found[:, :MINIMA]
    return np.concatenate([np.packbits((low >> bit) & 1, axis=1) for bit in range(LOW_BITS)], axis=1)


def matches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many low-bit values agree, for every row of ``left`` and of ``right``, by bit counts."""
    a, b = (np.ascontiguousarray(x).view(np.uint64).reshape(len(x), LOW_BITS, -1) for x in (left, right))
    differ = np.zeros((len(a), len(b), a.shape[2]), np.uint64)
    for bit in range(LOW_BITS):
        differ |= a[:, None, bit] ^ b[None, :, bit]
    return MINIMA - np.bitwise_count(differ).sum(axis=2, dtype=np.int64)


def estimate(agreeing: np.ndarray) -> np.ndarray:
    """Similarity from agreeing low-bit values, less those that agree by chance."""
    chance = 2.0**-LOW_BITS
    return (agreeing / MINIMA - chance) / (1 - chance)


def band_keys(found: np.ndarray, settings: Settings) -> np.ndarray:
    """A 64-bit key of the minima of each band, different for equal minima of other bands."""
    shaped = found.reshape(len(found), settings.bands, settings.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), shaped.shape[:2])
    for row in range(settings.rows):
        key = _mixed(key * _A + shaped[:, :, row])
    return key.view(np.int64)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of 0/1 matrices of some columns at a time."""
    values, where, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(often > 1) - 1
    several = often[where] > 1
    owner, column = owner[several], column[where[several]]
    total = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, (1 << 21) // len(sets))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, (first, first + width)))
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[part], column[part] - first] = 1
        total += dense @ dense.T
    total[np.diag_indices(len(sets))] = [len(s) for s in sets]
    return total.astype(np.int64)


def forest(linked: np.ndarray, names: list) -> list:
    """For every row of a symmetric matrix of links, the smallest name it is tied to."""
    root: list = [None] * len(names)
    for k in sorted(range(len(names)), key=names.__getitem__):
        if root[k] is None:
            seen, edge = np.zeros(len(names), bool), np.zeros(len(names), bool)
            edge[k] = True
            while edge.any():
                seen |= edge
                edge = linked[edge].any(axis=0) & ~seen
            for x in np.flatnonzero(seen):
                root[x] = names[k]
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in itertools.groupby(rows, lambda row: row[:keys]):
        yield key, [row[keys:] for row in group]


def _in_groups(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """Apply ``function(key, rows)`` to every group; it returns rows to go after the key."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for key, rows in _groups(batches, len(keys)):
            held += [(*key, *row) for row in function(key, rows)]
            if len(held) >= 4096:
                yield batch_of(held)
                held = []
        yield batch_of(held)

    kinds = {f.name: f.dataType for f in df.sparkSession.createDataFrame([], schema).schema}
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(kinds[n]) for n in names]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(sparing(run), schema)


def signatures(documents: DataFrame, settings: Settings, *, id_col: str, text_col: str) -> DataFrame:
    """``id, n_shingles, digest, signature, bands`` of every text; the last three null without words."""
    given = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in slices(map(len, texts), CHUNK):
                sets = shingle_sets(texts[a:b], settings.words)
                full = [k for k, s in enumerate(sets) if len(s)]
                digest, signature, bands = ([None] * len(sets) for _ in range(3))
                if full:
                    found = minima([sets[k] for k in full], settings)
                    for k, planes, keys in zip(full, packed(found), band_keys(found, settings), strict=True):
                        digest[k] = xxhash.xxh3_128_digest(sets[k].tobytes())
                        signature[k], bands[k] = planes.tobytes(), keys
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.array(signature, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "digest", "signature", "bands"],
                )

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(sparing(run), f"id {kind}, n_shingles long, digest binary, signature binary, bands array<long>")


def clusters(nodes: DataFrame) -> DataFrame:
    """``leader, id`` for every node in a bucket with others, the leaders included, and the cluster's ``size``.

    Two nodes that share a bucket share a cluster.  A bucket's leader is the member whose
    buckets hold most nodes, then the smallest.
    """
    places = nodes.select("id", F.explode(F.array_distinct("bands")).alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(places.join(sizes, "bucket"), "buckets")
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    chosen = (
        shared.join(degree, "id")
        .groupBy("bucket")
        .agg(F.max(F.struct("degree", (-F.col("id")).alias("least"))).alias("top"))
        .select("bucket", (-F.col("top.least")).alias("leader"))
    )
    pairs = shared.join(written(chosen, "leaders"), "bucket").select("leader", "id").distinct()
    members = written(pairs, "clusters")
    # Written, so that both sides are shuffled and Spark can split a large cluster's rows.
    sizes = written(members.groupBy("leader").agg(F.count("*").alias("size")), "cluster-sizes")
    return members.join(sizes, "leader")


def links(documents: DataFrame, nodes: DataFrame, settings: Settings, *, id_col: str, text_col: str) -> DataFrame:
    """Edges ``a, b`` that tie together what the similarity links; each is confirmed on full sets."""
    kind = nodes.schema["id"].dataType.simpleString()
    least = settings.least_matches
    members = written(clusters(nodes).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "members")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    large = members.filter("blocks > 1")
    leaders = large.select("leader", "blocks").distinct().select("leader", each.alias("block"), F.col("leader").alias("id"))
    inside = members.filter("blocks = 1 or id != leader").select("leader", block.alias("block"), "id").unionByName(leaders)
    planes = nodes.select("id", "signature")

    def likely(key, rows):
        """Members with an estimate that may reach the threshold."""
        names = [r[0] for r in rows]
        signs = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
        agree = matches(signs, signs) >= least
        np.fill_diagonal(agree, False)
        return [(n,) for n, some in zip(names, agree.any(axis=1), strict=True) if some]

    def confirm(key, rows):
        """The smallest member each one is tied to, and if the leader is among them."""
        sets = [np.frombuffer(r[1], "<u8") for r in rows]
        size = np.array([len(s) for s in sets])
        common = shared_counts(sets)
        linked = 100 * common >= settings.percent * (size[:, None] + size - common)
        names = [r[0] for r in rows]
        root = forest(linked, names)
        lead = {r for r, n in zip(root, names, strict=True) if n == key[0]}
        return [(n, r, r in lead) for n, r in zip(names, root, strict=True)]

    keys = ["leader", "block"]
    active = written(
        _in_groups(inside.join(planes, "id").select(*keys, "id", "signature"), keys, likely, f"leader {kind}, block int, id {kind}"),
        "likely",
    )
    wanted = active.select("id").union(large.select("id")).distinct()
    sets = written(_sets(documents, wanted, settings, id_col, text_col), "shingle-sets")
    first = written(
        _in_groups(
            active.join(sets, "id").select(*keys, "id", "shingles"),
            keys,
            confirm,
            f"leader {kind}, block int, id {kind}, root {kind}, led boolean",
        ),
        "links",
    )
    edges = first.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if not large.isEmpty():
        edges = edges.union(_across(large, first, planes, sets, settings, kind, block, each))
    return edges


def _across(large, first, planes, sets, settings: Settings, kind: str, block, each) -> DataFrame:
    """Edges between members of different blocks of a large cluster that its leader doesn't tie together."""
    least = settings.least_matches
    led = first.filter("led").select("leader", "id").distinct()
    loose = written(large.join(led, ["leader", "id"], "left_anti"), "loose")
    lone = loose.select("leader", block.alias("block")).distinct()
    left = loose.select("leader", block.alias("block"), each.alias("other"), "id", F.lit(True).alias("loose"))
    right = large.withColumn("other", block).join(lone, "leader").select("leader", "block", "other", "id", F.lit(False).alias("loose"))
    pairs = left.unionByName(right).filter("block != other")
    keys = ["leader", "block", "other"]

    def likely(key, rows):
        sides = [[r for r in rows if r[1] is side] for side in (True, False)]
        if not all(sides):
            return []
        signs = [np.frombuffer(b"".join(r[2] for r in side), np.uint8).reshape(len(side), -1) for side in sides]
        agree = matches(*signs) >= least
        agree &= np.array([r[0] for r in sides[0]])[:, None] != np.array([r[0] for r in sides[1]])
        some = [agree.any(axis=1), agree.any(axis=0)]
        return [(r[0], r[1]) for side, has in zip(sides, some, strict=True) for r, yes in zip(side, has, strict=True) if yes]

    def confirm(key, rows):
        known = {r[0]: np.frombuffer(r[2], "<u8") for r in rows}
        names, have = list(known), list(known.values())
        size = np.array([len(s) for s in have])
        common = shared_counts(have)
        linked = 100 * common >= settings.percent * (size[:, None] + size - common)
        return list(zip(names, forest(linked, names), strict=True))

    fields = f"leader {kind}, block int, other int, id {kind}"
    active = _in_groups(pairs.join(planes, "id").select(*keys, "id", "loose", "signature"), keys, likely, f"{fields}, loose boolean")
    found = _in_groups(
        written(active, "likely-across").join(sets, "id").select(*keys, "id", "loose", "shingles"), keys, confirm, f"{fields}, root {kind}"
    )
    return found.select(F.col("id").alias("a"), F.col("root").alias("b"))


def _sets(documents: DataFrame, wanted: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """``id, shingles`` of the wanted documents."""
    chosen = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in slices(map(len, texts), CHUNK):
                found = [s.astype("<u8").tobytes() for s in shingle_sets(texts[a:b], settings.words)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(found, pa.binary())], names=["id", "shingles"])

    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.select("id", "text").mapInArrow(sparing(run), f"id {kind}, shingles binary")


def near_duplicates(
    documents: DataFrame, *, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``n_shingles``, ``component_id`` and ``kept`` of every document.

    The component is named by its smallest id; the document of that id is kept.  Exact copies
    are one node; of the rest no link at or above the threshold is left out but by the chance
    ``settings.miss`` of the bands and that of the estimate.

    Null and empty texts and texts without words have no shingles and stand alone.  Rows
    that repeat an id are the same document; a row with a null id stands alone and is kept.
    An empty table gives no rows.  Other columns are left out, whatever their names.
    """
    given = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = written(signatures(given, settings, id_col="id", text_col="text"), "signatures")
    named = rows.filter("id is not null and digest is not null")
    copies = named.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("n")).filter("n > 1").drop("n")
    placed = rows.join(written(copies, "copies"), "digest", "left").withColumn("node", F.coalesce("node", "id"))
    placed = written(placed, "placed")
    nodes = placed.filter("id = node and digest is not null").select("id", "signature", "bands").dropDuplicates(["id"])
    nodes = written(nodes, "nodes")
    tied = components(links(given, nodes, settings, id_col="id", text_col="text"))
    classes = placed.select("id", "n_shingles", "node").join(tied.withColumnsRenamed({"a": "node", "b": "low"}), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "node"))
    return classes.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
