"""Language of texts by prediction by partial matching over bytes.

Every language has a tree of byte contexts of up to three bytes with the counts of the
bytes that follow, of all that was seen.  A byte costs its bits under the longest context; one that was
not seen there costs an escape and then its share among the bytes not yet excluded in the
next shorter context, down to all 256 bytes alike.  Escapes follow method C: a context
seen ``n`` times with ``d`` different bytes escapes with probability ``d / (n + d)``.
With the counts frozen, a byte's cost depends on the three bytes before it alone, so costs
are sorted tables, in a file that tasks map instead of loading it.  The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import crc_of_id, release, shared_file, sparing, written
from playlens.llm.tokens import slices

UNKNOWN = "und"
#: Longest context in bytes.
ORDER = 3
#: Text bytes handled at once in a task.
CHUNK = 1 << 20
_GAP = b" " * ORDER


def has_letter(text: str) -> bool:
    """If a character is a letter; fractions, raised or circled figures are none."""
    return any(map(str.isalpha, text))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with a gap before each, and where each starts and ends."""
    data = np.frombuffer(_GAP + _GAP.join(texts) if texts else b"", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + ORDER)
    return data, ends - sizes, ends


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The four bytes that end at each text byte."""
    wide = data.astype(np.uint32)
    four = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return four[np.cumsum(edge[:-1])[ORDER:] > 0]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, counts).astype(np.int64)


def _rising(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _level(keys: np.ndarray, n: np.ndarray, lower: np.ndarray, outside: np.ndarray):
    """Bits of each string after its context, the contexts, and the bits of escaping from them.

    ``lower`` counts each string without its first byte; ``outside`` is, for each of these
    strings, what all that follows its context counts there, different bytes added.  Bytes
    seen in a context are seen in the next shorter one too, so all sums are of whole numbers.
    """
    context = keys >> 8
    first = _rising(context)
    different = np.diff(np.append(first, len(keys)))
    whole = np.add.reduceat(n, first) + different
    bits = np.log2(np.repeat(whole, different)) - np.log2(n)
    left = np.maximum(outside[first] - np.add.reduceat(lower, first), 1)
    return bits, context[first], np.log2(whole) - np.log2(different) + np.log2(left) - np.log2(outside[first])


def costs(keys: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """One language's costs from its four-byte strings and their counts, as arrays of 32 bits.

    Four-byte strings and their bits, three-byte contexts and the bits of escaping, the same
    of three-byte strings, then the bits of all two-byte strings and of escaping from each.
    """
    keys = keys.astype(np.int64)
    order = np.argsort(keys)
    held = [(keys[order], n[order].astype(np.int64))]
    for mask in (1 << 24, 1 << 16, 1 << 8):
        held.append(_summed(held[-1][0] % mask, held[-1][1]))
    four, three, two, one = held
    whole = [np.zeros(0, np.int64)] * 2
    for k, (keys_, n_) in enumerate((two, three)):
        first = _rising(keys_ >> 8)
        whole[k] = np.zeros(1 << 8 * (k + 1), np.int64)
        whole[k][(keys_ >> 8)[first]] = np.add.reduceat(n_, first) + np.diff(np.append(first, len(keys_)))

    def under(upper, shorter, mask):
        return shorter[1][np.searchsorted(shorter[0], upper[0] % mask)]

    bits1, _, escape1 = _level(*one, np.ones(len(one[0]), np.int64), np.full(len(one[0]), 256))
    single = np.full(256, escape1[0] + 8)
    single[one[0]] = bits1
    total = int(one[1].sum()) + len(one[0])
    bits2, context, escape2 = _level(*two, under(two, one, 1 << 8), np.full(len(two[0]), total))
    pairs = np.tile(single, (256, 1))
    pairs[context] += escape2[:, None]
    pairs = pairs.ravel()
    pairs[two[0]] = bits2
    bits3, context, escape = _level(*three, under(three, two, 1 << 16), whole[0][(three[0] >> 8) % (1 << 8)])
    escapes = np.zeros(1 << 16)
    escapes[context] = escape
    bits4, context, escape4 = _level(*four, under(four, three, 1 << 24), whole[1][(four[0] >> 8) % (1 << 16)])
    found = ((four[0], bits4), (context, escape4), (three[0], bits3))
    arrays = [a for k, x in found for a in (k.astype("<u4"), x.astype("<f4"))]
    return [*arrays, pairs.astype("<f4"), escapes.astype("<f4")]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], other)


@dataclass
class Model:
    """Frozen costs: all that was seen of every language, see ``costs``.

    ``ends[language]`` bounds its arrays in ``data``, or else in the file that Spark copied
    to every executor under the name ``file``, of which tasks map what they look up.
    """

    languages: list[str]
    ends: np.ndarray
    data: np.ndarray | None = None
    file: str | None = None

    def arrays(self, k: int) -> list[np.ndarray]:
        if self.data is None:
            self.data = np.memmap(SparkFiles.get(self.file), "<u4", "r")
        parts = [self.data[a:b] for a, b in pairwise(self.ends[k].tolist())]
        return [x if i in (0, 2, 4) else x.view("<f4") for i, x in enumerate(parts)]

    def costs_of(self, four: np.ndarray, k: int) -> np.ndarray:
        """Bits of the last byte of distinct, sorted four-byte strings under a language."""
        strings, bits, contexts, escape, shorter, bits3, pairs, escape3 = self.arrays(k)
        end = four & np.uint32(0xFFFFFF)
        found = _looked_up(shorter, bits3, end, escape3[end >> 8] + pairs[end & 0xFFFF])
        return _looked_up(strings, bits, four, _looked_up(contexts, escape, four >> 8, np.float32(0)) + found)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        data, starts, ends = joined(texts)
        total = np.zeros((len(texts), len(self.languages)))
        sizes = ends - starts
        filled = np.flatnonzero(sizes)
        if not len(filled):
            return total
        four, where = np.unique(grams(data, starts, ends), return_inverse=True)
        first = np.cumsum(sizes[filled]) - sizes[filled]
        for k in range(len(self.languages)):
            total[filled, k] = np.add.reduceat(self.costs_of(four, k)[where], first, dtype=np.float64)
        return total

    @property
    def bits(self) -> np.ndarray:
        """``bits[context, byte, language]`` after every three-byte context, the first byte being
        one that was never seen and the others all that were.  A dense table, to look into small models.
        """
        contexts = np.unique(np.concatenate([self.arrays(k)[2] for k in range(len(self.languages))]))
        seen = np.unique(np.concatenate([self.arrays(k)[0] & np.uint32(255) for k in range(len(self.languages))]))
        symbols = np.concatenate([np.setdiff1d(np.arange(256, dtype=np.uint32), seen)[:1], seen])
        four = (contexts[:, None] << np.uint32(8) | symbols).ravel()
        found = np.stack([self.costs_of(four, k) for k in range(len(self.languages))], 1)
        return found.reshape(len(contexts), len(symbols), -1)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from each language's four-byte strings and their counts, in memory."""
    languages = sorted(counts)
    found = [costs(*counts[x]) for x in languages]
    data = np.concatenate([a.view("<u4") for arrays in found for a in arrays])
    return Model(languages, _ends([[len(a) for a in arrays] for arrays in found]), data)


def _ends(sizes: list[list[int]]) -> np.ndarray:
    ends = np.cumsum(sizes).reshape(len(sizes), -1)
    return np.concatenate([ends[:, :1] - np.array(sizes)[:, :1], ends], 1)


def train(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Counts over every text of ``documents`` with a language; None if there is none.

    A row per task, language and four-byte string is shuffled.  All strings count; those of
    one language at a time reach the driver, which appends their costs to a file.
    """
    given = documents.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(language: str) -> pa.RecordBatch:
            keys, n = held.pop(language)
            return pa.RecordBatch.from_arrays(
                [pa.array([language] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)],
                names=["lang", "gram", "n"],
            )

        for batch in batches:
            languages = batch.column(0).to_pylist()
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for language in set(languages):
                own = [t for x, t in zip(languages, texts, strict=True) if x == language]
                for i, j in slices(map(len, own), CHUNK):
                    keys, n = np.unique(grams(*joined(own[i:j])), return_counts=True)
                    if language in held:
                        before = held[language]
                        keys, n = _summed(np.concatenate([before[0], keys]), np.concatenate([before[1], n]))
                    held[language] = keys, n
                    if len(keys) > 1 << 21:
                        yield rows(language)
        for language in list(held):
            yield rows(language)

    total = given.mapInArrow(sparing(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = written(total, "strings")
    languages = sorted(r[0] for r in total.select("lang").distinct().collect())
    sizes: list[list[int]] = []

    def pieces() -> Iterator[bytes]:
        for language in languages:
            own = total.filter(F.col("lang") == language).select("gram", "n").toArrow()
            found = costs(own["gram"].to_numpy(), own["n"].to_numpy())
            sizes.append([len(a) for a in found])
            yield from (a.tobytes() for a in found)

    name = shared_file(documents.sparkSession, "costs", pieces()) if languages else None
    release(total)
    return Model(languages, _ends(sizes), file=name) if languages else None


def predict(
    documents: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``lang_pred`` and ``score`` of every text beside the id and the ``keep`` columns.

    The score is the posterior of the predicted language with all languages equally likely
    beforehand.  A text that is null or has no letter gets ``und`` and 0, as does every text
    if nothing was learned; languages of equal length resolve to the first by name.  Ids
    may be null or repeat: each row gets its own result.  Columns not in ``keep`` are left
    out, whatever their names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    given = documents.select(id_col, *keep, F.col(text_col).alias("__text"))
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            chosen: list[str] = [UNKNOWN] * len(texts)
            score = np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if t and has_letter(t)] if model else []
            data = [texts[i].encode() for i in rows]
            for a, b in slices(map(len, data), CHUNK):
                bits = model.code_lengths(data[a:b])
                best = bits.argmin(1)
                score[rows[a:b]] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                for i, k in zip(rows[a:b], best, strict=True):
                    chosen[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(chosen, pa.string()), pa.array(score)],
                names=[*names, "lang_pred", "score"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:-1])
    return given.mapInArrow(sparing(run), f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Documents that no model learns from."""
    return crc_of_id(F.col(id_col)) % 4 == 2


def identify(documents: DataFrame, *, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Learn from the documents that are not held out and predict all of them."""
    model = train(documents.filter(F.coalesce(~held_out(id_col), F.lit(True))))
    marked = documents.withColumn("held_out", F.coalesce(held_out(id_col), F.lit(False)))
    return predict(marked, model, id_col=id_col, keep=(*keep, "held_out"))
