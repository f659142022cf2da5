"""Token ids in files of canonical, length-limited Huffman codes.

A file set is a folder in any store that Spark reads:

* ``codebook`` - one row: the code length of every id, from the counts of all ids;
* ``blocks`` - rows of consecutive documents in ascending id order: ids and token counts
  of the documents, the payload, and checkpoints, that is bit offsets of every
  ``STEP``-th token of each document.  A document starts on a byte.

Codes are canonical: of equal length in id order, shorter ones first.  A block is decoded
by itself through a table of all ``LIMIT``-bit windows, from all its checkpoints at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm.common import release, scratch_path, written
from playlens.llm.tokens import VOCABULARY, encoder, slices

#: Longest code in bits.
LIMIT = 16
#: Tokens from one checkpoint to the next.
STEP = 512
#: Payload of a block in bytes, unless one document alone is larger.
BLOCK_BYTES = 4 << 20
#: Tokens whose codes are written at once in a task; a processor's cache holds their arrays.
CHUNK = 1 << 15


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over ``limit`` bits (package-merge).

    Ids that don't occur get length 0; a single id gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids can't have codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaves = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        sort = np.argsort(both, kind="stable")
        level = both[sort]
        leaves.append(sort < len(weights))
    take = 2 * len(used) - 2
    for is_leaf in reversed(leaves):
        chosen = int(is_leaf[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of every id, by length and then id."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    codes = np.zeros(len(lengths), np.uint32)
    if len(order):
        sizes = lengths[order].astype(np.int64)
        steps = np.concatenate(([0], 1 << (LIMIT - sizes[:-1])))
        codes[order] = np.cumsum(steps) >> (LIMIT - sizes)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``LIMIT`` bits, the id it starts with and its code length."""
    ids, sizes = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (LIMIT - lengths[order].astype(np.int64))
    whole = int(spans.sum())
    ids[:whole], sizes[:whole] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, sizes


def encode_documents(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """Payload of consecutive documents, their byte ends, and their checkpoints' bit offsets.

    ``counts`` are the documents' token counts; a document without tokens takes no byte.
    Offsets count from the payload's start; a document has one per ``STEP`` tokens.
    """
    sizes = lengths[ids].astype(np.int64)
    after = np.cumsum(sizes)
    token_ends = np.cumsum(counts)
    token_starts = token_ends - counts
    bits_before = np.concatenate(([0], after))[token_starts]
    doc_bits = np.concatenate(([0], after))[token_ends] - bits_before
    byte_ends = np.cumsum((doc_bits + 7) // 8)
    base = 8 * np.concatenate(([0], byte_ends[:-1])) - bits_before
    starts = after - sizes + np.repeat(base, counts)
    total, at = int(byte_ends[-1]) if len(byte_ends) else 0, starts >> 5
    value = (codes[ids].astype(np.int64) << (64 - sizes - (starts & 31))).view(np.uint64)  # two words of 32 bits
    words = -(-total // 4) + 1
    payload = np.bincount(at, weights=value >> 32, minlength=words)[:words]
    payload += np.bincount(at + 1, weights=value & 0xFFFFFFFF, minlength=words)[:words]
    parts = -(-counts // STEP)
    rank = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    marks = starts[np.repeat(token_starts, parts) + STEP * rank]
    return payload.astype(">u4").view(np.uint8)[:total], byte_ends, marks


def decode_block(payload: bytes, checkpoints: np.ndarray, counts: np.ndarray, table) -> np.ndarray:
    """All ids of a block in order."""
    ids, sizes = table
    parts = -(-counts // STEP)
    rank = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    left = np.minimum(np.repeat(counts, parts) - rank * STEP, STEP)
    data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    windows = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    order = np.argsort(-left, kind="stable")
    place, ends = checkpoints.astype(np.int64)[order], np.cumsum(left)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    goal, left = (ends - left)[order], left[order]
    steps = np.arange(int(left[0]) if len(left) else 0)
    for step, live in enumerate(np.searchsorted(-left, -steps).tolist()):  # lanes with more tokens than steps done
        place, goal = place[:live], goal[:live]
        window = (windows[place >> 3] >> (24 - LIMIT - (place & 7)).astype(np.uint32)) & ((1 << LIMIT) - 1)
        out[goal + step] = ids[window]
        place = place + sizes[window]
    return out


def tokenised(documents: DataFrame, id_col: str, text_col: str, end_id: int, vocabulary: str) -> DataFrame:
    """``id``, ``n`` and ``ids`` (little-endian, 2 bytes where the vocabulary allows, else 4) of every text.

    A task's last row has a null ``n`` and in ``counts`` how often each id occurs in the task's texts.
    """
    given = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ending = np.array([end_id], "<u4").tobytes()
    pair = pa.struct([("token", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = ["id", "n", "ids", "counts"], None
        width = id_width(encoder(vocabulary).size, end_id)
        size = max(encoder(vocabulary).size, end_id + 1)
        total = np.zeros(size, np.int64)
        for batch in batches:
            kind = batch.schema.field(0).type
            texts = [t or "" for t in batch.column(1).to_pylist()]
            encoded = encoder(vocabulary).each(texts)
            for a, b in slices(map(len, texts), 1 << 20):
                found = [i + ending for i in islice(encoded, b - a)]
                ids = np.frombuffer(b"".join(found), "<u4")
                total += np.bincount(ids, minlength=size)
                ends = np.cumsum([len(i) // 4 for i in found])
                data, bytes_each = ids.astype(width).tobytes(), np.dtype(width).itemsize
                own = pa.array([data[s:e] for s, e in pairwise([0, *(bytes_each * ends).tolist()])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(np.diff(ends, prepend=0), pa.int64()), own, pa.nulls(b - a, pa.list_(pair))], names=names
                )
        if kind is not None:
            used = np.flatnonzero(total)
            counts = pa.StructArray.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], fields=list(pair))
            counts = pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), counts)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), counts], names=names)

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, n long, ids binary, counts array<struct<token:long,n:long>>")


def id_width(vocabulary_size: int, end_id: int) -> str:
    return "<u2" if max(vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"


def _counted(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the whole corpus; a row per id and task is shuffled."""
    rows = tokens.filter("n IS NULL").select(F.inline("counts")).groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in rows.collect():  # at most one row per id of the vocabulary
        counts[row.token] = row.n
    return counts


def write_ids(
    documents: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    vocabulary: str = VOCABULARY,
    ranges: int | None = None,
) -> None:
    """Write the ids of all documents, each with ``end_id`` at its end, in ascending id order.

    Texts are encoded once, into a scratch table, where each task also leaves its counts of ids; the
    codebook comes from all of them.  Documents are dealt to ``ranges`` ranges of ids of about the same number of
    documents and written in order within a range; equal ids lie in one range.

    A null or empty text is its end id alone.  Rows with a null id come first.  Rows with
    the same id are documents of their own, ordered by length and content.  An empty table
    gives a file set without blocks.  Other columns are left out, whatever their names.
    """
    spark = documents.sparkSession
    scratch = written(tokenised(documents, id_col, text_col, end_id, vocabulary), "token-ids")
    tokens = scratch.filter("n IS NOT NULL").drop("counts")
    size = max(encoder(vocabulary).size, end_id + 1)
    width = id_width(encoder(vocabulary).size, end_id)
    lengths = code_lengths(_counted(scratch, size))
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = tokens.agg(F.percentile_approx("id", cuts, 100 * ranges)).first()[0] or []
    place = F.expr(f"cast(aggregate(array({', '.join(map(str, sorted(set(bounds)))) or 'null'}), 0, (n, b) -> n + int(id > b)) as int)")
    by_range = tokens.groupBy(F.coalesce(place, F.lit(0)).alias("range")).agg(F.sum("n").alias("n")).orderBy("range").collect()
    ends = np.cumsum([r.n for r in by_range]).tolist()
    before = {r.range: end - r.n for r, end in zip(by_range, ends, strict=True)}
    kind = tokens.schema["id"].dataType.simpleString()
    limits = np.array(sorted(set(bounds)))
    shared = spark.sparkContext.broadcast((lengths, limits, before))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, limits, _ = shared.value
        codes = canonical_codes(lengths)
        for batch in batches:
            counts = batch.column(1).to_numpy()
            names = batch.column(0).to_pylist()
            place = np.searchsorted(limits, [n if n is not None else limits[0] if len(limits) else 0 for n in names]) if len(limits) else np.zeros(len(names), int)
            for a, b in slices(counts.tolist(), CHUNK):
                ids = np.concatenate([np.frombuffer(x.as_buffer(), width) for x in batch.column(2)[a:b]])
                payload, ends, marks = encode_documents(ids, counts[a:b], lengths, codes)
                starts, parts = np.concatenate(([0], ends[:-1])), np.cumsum(-(-counts[a:b] // STEP))
                owner = np.repeat(starts * 8, np.diff(parts, prepend=0))
                split = [x.astype("<u4").tobytes() for x in np.split(marks - owner, parts[:-1])]
                data = payload.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(place[a:b], pa.int32()),
                        batch.column(0)[a:b],
                        batch.column(1)[a:b],
                        pa.array([data[s:e] for s, e in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array(split, pa.binary()),
                    ],
                    names=["range", "id", "n", "payload", "marks"],
                )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = dict(shared.value[2])
        kind_of_id, held, held_bytes, held_range = None, [], 0, None

        def emit():
            offsets = np.concatenate(([0], np.cumsum([len(h[2]) for h in held])))
            marks = [np.frombuffer(h[3], "<u4").astype(np.int64) + 8 * o for h, o in zip(held, offsets, strict=False)]
            start = before[held_range]
            before[held_range] += sum(h[1] for h in held)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([held_range], pa.int32()),
                    pa.array([start], pa.int64()),
                    pa.array([[h[0] for h in held]], pa.list_(kind_of_id)),
                    pa.array([[h[1] for h in held]], pa.list_(pa.int64())),
                    pa.array([np.concatenate(marks).astype("<u8").tobytes()], pa.binary()),
                    pa.array([b"".join(h[2] for h in held)], pa.binary()),
                ],
                names=["range", "start", "ids", "counts", "checkpoints", "payload"],
            )

        for batch in batches:
            kind_of_id = batch.schema.field(1).type
            for at, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (at != held_range or held_bytes + len(row[2]) > BLOCK_BYTES):
                    yield emit()
                    held, held_bytes = [], 0
                held_range = at
                held.append(row)
                held_bytes += len(row[2])
        if held:
            yield emit()

    coded = tokens.mapInArrow(encode, f"range int, id {kind}, n long, payload binary, marks binary")
    ordered = coded.repartition(max(1, ranges // 4), "range").sortWithinPartitions("range", "id", "n", "payload")
    blocks = ordered.mapInArrow(
        block, f"range int, start long, ids array<{kind}>, counts array<long>, checkpoints binary, payload binary"
    )
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    shared.unpersist()
    release(scratch)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of a file set: ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``
    (little-endian unsigned 32-bit).  Blocks are decoded independently of each other.
    """
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first().lengths, np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks").select("start", "ids", "counts", "checkpoints", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoding = decoding_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                start, names, counts, marks, payload = (batch.column(k)[i] for k in range(5))
                counts = np.asarray(counts.values, np.int64)
                ids = decode_block(payload.as_buffer(), np.frombuffer(marks.as_buffer(), "<u8"), counts, decoding)
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.values,
                        pa.array(ends - counts + start.as_py()),
                        pa.array(counts),
                        pa.array([data[4 * (e - n) : 4 * e] for e, n in zip(ends, counts, strict=True)], pa.binary()),
                    ],
                    names=[id_col, "start", "n_tokens", "ids"],
                )

    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")


def round_trip(documents: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write a file set (into the shared folder if no path is given) and read it back."""
    path = path or scratch_path(documents.sparkSession, "token-file")
    write_ids(documents, path, **options)
    return read_ids(documents.sparkSession, path, options.get("id_col", "doc_id"))
