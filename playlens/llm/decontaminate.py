"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Texts are normalised to words joined by single spaces.  The automaton holds every window
of ten consecutive item words; a document is scanned once, and each hit is mapped from
the normalised text to word numbers and to byte offsets of the original.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import sparing, written

WINDOW = 10
#: Most bytes of item text in one automaton; larger benchmarks take a pass over the texts for each part.
AUTOMATON_BYTES = 16 << 20

#: Lower-case a-z, digits and all bytes over 127 make words, other bytes part them.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def normalise(text: str | None) -> list[bytes]:
    """The words of a text; none for null."""
    return text.encode().translate(_FOLD).split() if text else []


def windows(words: list[bytes], size: int) -> set[bytes]:
    """Every run of ``size`` words, or all words where there are fewer."""
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def build(items: list[tuple[str, str]], size: int) -> ahocorasick.Automaton | None:
    """The automaton over the items' windows; its values are (words, item ids)."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        for window in windows(normalise(text), size):
            owners[window].add(item)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(sorted(ids))))
    automaton.make_automaton()
    return automaton


def scan(words: list[bytes], automaton: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges ``[first, end)`` that an item window covers, and the items found."""
    text = f" {b' '.join(words).decode('latin-1')} "
    found = list(automaton.iter(text))
    if not found:
        return [], set()
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    ends = np.searchsorted(starts, [at for at, _ in found])
    return [(int(e) - n, int(e)) for e, (_, (n, _)) in zip(ends, found, strict=True)], {
        i for _, (_, ids) in found for i in ids
    }


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each normalised word starts and ends in the text's UTF-8 bytes."""
    inside = np.frombuffer(text.encode().translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def item_parts(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct benchmark items in parts of at most ``part_bytes`` (or one item), one at a time."""
    part: list[tuple[str, str]] = []
    size = 0
    chosen = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    for row in chosen.dropna().distinct().orderBy("item", "text").toLocalIterator():
        n = len(row.text.encode())
        if part and size + n > part_bytes:
            yield part
            part, size = [], 0
        part.append((row.item, row.text))
        size += n
    if part:
        yield part


_RESULTS = ("n_words", "n_hit", "items", "spans")
_RANGES = "array<struct<start:long,end:long>>"
_RANGE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _hits(texts: DataFrame, part: list[tuple[str, str]], window: int) -> DataFrame:
    """``digest, ranges, items`` of each distinct text that holds a window of a part of the benchmark."""
    shared = texts.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(shared.value, window)
        for batch in batches if automaton else ():
            rows = []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalise(text)
                ranges, items = scan(words, automaton) if words else ([], set())
                if ranges:
                    rows.append((digest, [{"start": a, "end": b} for a, b in merged(ranges)], sorted(items)))
            kinds = (pa.string(), _RANGE, pa.list_(pa.string()))
            columns = zip(zip(*rows, strict=True) if rows else ((), (), ()), kinds, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["digest", "ranges", "items"])

    found = texts.mapInArrow(sparing(run), f"digest string, ranges {_RANGES}, items array<string>")
    return written(found.dropDuplicates(["digest"]), "benchmark-hits")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    part_bytes: int = AUTOMATON_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """What each document shares with the benchmark.

    Returns ``n_words``, ``n_hit`` (words inside any occurrence of an item window),
    ``items`` (sorted ids of items with an occurring window) and ``spans`` (byte ranges
    of the original text) beside the id and the ``keep`` columns.

    Null and empty texts have no words and no hits; a null item or item text is no item;
    an item of fewer than ``window`` words is one window; the same item given twice counts
    once; an empty benchmark hits nothing.  Ids may be null or repeat: each row gets its
    own result.  Columns not in ``keep`` are left out, whatever their names; a kept column with
    the name of a result is refused.

    A benchmark of up to ``part_bytes`` is broadcast, and one scan without a shuffle finds all.  A
    larger one is read part by part: each is broadcast by itself for a pass over the texts that writes
    the texts it hits, and the hits of all parts meet the documents by the digest of their texts.
    No driver or task holds more than two parts.
    """
    names = [id_col, *keep]
    if clashing := set(_RESULTS).intersection(names):
        raise ValueError(f"results have columns of their own named {sorted(clashing)}")
    given = documents.select(id_col, *keep, F.col(text_col).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:-1]]
    parts = item_parts(benchmark, item_col, item_text_col, part_bytes)
    first, second = next(parts, []), next(parts, None)
    shared = None
    if second is None:
        shared = documents.sparkSession.sparkContext.broadcast(first)
    else:
        texts = documents.select(F.sha2(F.col(text_col), 256).alias("digest"), F.col(text_col).alias("text")).dropna()
        tables = [_hits(texts, part, window) for part in chain([first, second], parts)]
        hits = reduce(DataFrame.union, tables).groupBy("digest").agg(
            F.flatten(F.collect_list("ranges")).alias("__ranges"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("__items"),
        )
        hits = hits.withColumnRenamed("digest", "__digest")
        given = given.join(hits, F.sha2("__text", 256) == F.col("__digest"), "left").drop("__digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(shared.value, window) if shared else None
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            texts = batch.column(len(names)).to_pylist()
            if shared:
                known = [(None, None)] * len(texts)
            else:
                known = zip(batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2).to_pylist(), strict=True)
            for text, (ranges, found) in zip(texts, known, strict=True):
                words = normalise(text)
                if shared:
                    ranges, found = scan(words, automaton) if words and automaton else ([], set())
                else:
                    ranges, found = [(r["start"], r["end"]) for r in ranges or ()], found or ()
                ranges = merged(ranges)
                if ranges:
                    start, end = word_offsets(text)
                    spans.append([{"start": int(start[a]), "end": int(end[b - 1])} for a, b in ranges])
                else:
                    spans.append([])
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in ranges))
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(len(names))),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, _RANGE),
                ],
                names=[*names, *_RESULTS],
            )

    return given.mapInArrow(sparing(run), f"{', '.join(kinds)}, n_words long, n_hit long, items array<string>, spans {_RANGES}")


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts with the item ids as one sha256."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
