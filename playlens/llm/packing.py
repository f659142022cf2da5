"""Packing of token ids into training windows by order-preserving dynamic programming.

Documents keep their order.  Windows are cut at document or sentence boundaries (inside
a sentence only where it is long); the cuts minimise padding plus penalties for cutting
documents.  ``best(j) = min(best(i) + cost(i, j))`` over starts
``i`` at most one window back is a sliding-window minimum of ``best(i) + place(i)``, kept
in a monotone queue.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import sparing
from playlens.llm.tokens import VOCABULARY, encoder, sentence_tables, slices


@dataclass(frozen=True)
class Costs:
    """In tokens of padding: a window by itself, and cuts that are no document end."""

    window: float = 32.0
    sentence: float = 4.0
    inside: float = 32.0


def padding(length: int, size: int) -> int:
    """Padding of a window: up to ``size``, none where the length is a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def cut_points(ids: np.ndarray, ends: np.ndarray, size: int, tables, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and the penalty of a cut there.

    ``ends`` are the document ends.  Sentences longer than a sixteenth of a window may
    also be cut inside, at every half of that.
    """
    closing, spaced = tables
    kind = closing[ids[:-1]]
    sentences = np.flatnonzero((kind >= 2) | (kind == 1) & spaced[ids[1:]]) + 1
    places = _union(sentences, ends)
    gaps = np.diff(places, prepend=0)
    longest, step = max(1, size // 16), max(1, size // 32)
    wide = gaps > longest
    inside = [np.arange(p - g + step, p, step) for p, g in zip(places[wide], gaps[wide], strict=True)]
    if inside:
        places = _union(places, np.concatenate(inside))
    penalty = np.full(len(places), costs.inside)
    penalty[np.searchsorted(places, sentences)] = costs.sentence
    penalty[np.searchsorted(places, ends)] = 0
    return places, penalty


def _union(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The values of two sorted arrays in order, each once."""
    both = np.sort(np.concatenate([some, others]), kind="stable")
    return both[np.concatenate(([True], both[1:] != both[:-1]))[: len(both)]]


def best_cuts(places: np.ndarray, penalty: np.ndarray, size: int, costs: Costs) -> list[int]:
    """The window ends of least cost, from ``places``; the last one is always an end."""
    where = np.concatenate(([0], places))
    ends, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]  # windows of a power of two
    power = 1
    while power < size and size & (size - 1) == 0:
        start = np.searchsorted(where, where - power)
        end = np.flatnonzero((where >= power) & (where[np.minimum(start, len(where) - 1)] == where - power))
        ends.append(end)
        starts.append(start[end])
        power *= 2
    order = np.argsort(np.concatenate(ends), kind="stable")
    exact_ends = [*np.concatenate(ends)[order].tolist(), 0]
    exact_starts = np.concatenate(starts)[order].tolist()
    spots = where.tolist()
    best, source = [0.0] * len(spots), [0] * len(spots)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # value, number and place of possible starts
    exact = 0
    for j, (place, fine) in enumerate(zip(spots[1:], (penalty + costs.window).tolist(), strict=True), 1):
        value, i, start = queue[0]
        while place - start > size:
            queue.popleft()
            value, i, start = queue[0]
        value += size - place
        while exact_ends[exact] == j:
            k = exact_starts[exact]
            if best[k] < value:
                value, i = best[k], k
            exact += 1
        value += fine
        best[j], source[j] = value, i
        value += place
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j, place))
    cuts, j = [], len(spots) - 1
    while j:
        cuts.append(spots[j])
        j = source[j]
    return cuts[::-1]


class _Packer:
    """Documents waiting to be cut, in order."""

    def __init__(self, size: int, tables, costs: Costs, first_id: int) -> None:
        self.size, self.tables, self.costs, self.sequence = size, tables, costs, first_id
        self.waiting: list[tuple[object, int, int, bytes]] = []  # id, all tokens, tokens before, ids
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> None:
        self.waiting.append((doc_id, len(ids) // 4, 0, ids))
        self.tokens += len(ids) // 4

    def cut(self, last: bool) -> list[tuple]:
        """Pieces of all windows, but the last one while more documents may come."""
        if not self.waiting:
            return []
        ends = np.cumsum([len(w[3]) // 4 for w in self.waiting])
        ids = np.frombuffer(b"".join(w[3] for w in self.waiting), "<u4")
        cuts = best_cuts(*cut_points(ids, ends, self.size, self.tables, self.costs), self.size, self.costs)
        if not last:
            cuts.pop()
        pieces, at, k, used = [], 0, 0, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc_id, total, before, data = self.waiting[k]
                take = min(cut - at, len(data) // 4 - used)
                pieces.append((doc_id, before + used, take, data[4 * used : 4 * (used + take)], total, self.sequence, offset))
                at, used, offset = at + take, used + take, offset + take
                if used == len(data) // 4:
                    k, used = k + 1, 0
            self.sequence += 1
        rest = self.waiting[k:]
        if used:
            doc_id, total, before, data = rest[0]
            rest[0] = (doc_id, total, before + used, data[4 * used :])
        self.waiting, self.tokens = rest, self.tokens - at
        return pieces


def pack(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    end_id: int = 1,
    vocabulary: str = VOCABULARY,
    costs: Costs = Costs(),
    segment_tokens: int = 1 << 18,
    keep_words: bool = True,
) -> DataFrame:
    """One row per piece of a document: ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's ids are those of its whole text and ``end_id``; each lies in exactly one
    piece, and pieces fill a sequence without gaps from offset 0, in the order of the
    documents in their input partition.  Every partition packs for itself: nothing is
    shuffled, and at most ``segment_tokens`` ids and one document wait for their cuts.
    ``sequence_id`` is unique over all partitions.  ``keep_words`` as in :mod:`playlens.llm.tokens`.

    A null or empty text is its end id alone.  Ids may be null or repeat: each row is a
    document.  An empty table gives no rows.  Other columns are left out, whatever their
    names.
    """
    given = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ending = np.array([end_id], "<u4").tobytes()

    def batch_of(pieces: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*pieces, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sentence_tables(vocabulary)
        packer = _Packer(size, tables, costs, TaskContext.get().partitionId() << 33)
        schema = None
        for batch in batches:
            schema = schema or pa.schema(
                [(id_col, batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
                + [(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")]
            )
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = encoder(vocabulary).each([t or "" for t in texts], None if keep_words else 1 << 20)
            for a, b in slices([len(t or "") for t in texts], 1 << 20):
                for name, ids in zip(names[a:b], islice(found, b - a), strict=True):
                    packer.add(name, ids + ending)
                if packer.tokens >= segment_tokens and (pieces := packer.cut(last=False)):
                    yield batch_of(pieces, schema)
        if not keep_words:
            encoder(vocabulary).forget()
        if pieces := packer.cut(last=True):
            yield batch_of(pieces, schema)

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(
        sparing(run),
        f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
