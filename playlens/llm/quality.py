"""Text quality by supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams are hashed to buckets, each with
a learned vector.  A document is the average of its vectors, and a softmax over a linear
layer gives its class.  Vectors and layer are trained together by stochastic gradient
descent in numpy.  For scoring, each bucket's vector is folded into one number, its share
of the logit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import crc_of_id
from playlens.llm.tokens import slices

#: Characters handled at once in a task.
CHUNK = 1 << 19


@dataclass(frozen=True)
class Settings:
    """``sample`` is the most labelled documents that are learned from."""

    sample: int = 6000
    bits: int = 18
    dimensions: int = 16
    char_ngrams: tuple[int, ...] = (3, 4)
    epochs: int = 6
    rate: float = 0.3
    seed: int = 7


_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_WORD, _PAIR, _TWICE = np.uint64(1), np.uint64(2), np.uint64(3)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    keys = keys * _MIX
    keys = (keys ^ (keys >> np.uint64(32))) * _STEP
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the texts and, for each, the text it belongs to.

    Grouped by kind of feature; within a kind in text order.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    space = (chars <= 32) | (chars == 0x85) | (chars == 0xA0)
    buckets, owners = [], []
    for n in settings.char_ngrams:
        if len(chars) < n:
            continue
        key = np.full(len(chars) - n + 1, n + 16, np.uint64)
        for k in range(n):
            key = (key ^ chars[k : len(chars) - n + 1 + k]) * _STEP
        inside = owner[: len(key)] == owner[n - 1 :]
        buckets.append(_bucket(key[inside], settings.bits))
        owners.append(owner[: len(key)][inside])
    if len(chars):
        before = np.concatenate(([True], space[:-1] | (owner[1:] != owner[:-1])))
        starts = np.flatnonzero(~space & before)
        if len(starts):
            rank = np.arange(len(chars)) - np.maximum.accumulate(np.where(~space & before, np.arange(len(chars)), 0))
            mixed = (chars + _MIX * (rank.astype(np.uint64) + _WORD)) * _STEP
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
            word = np.add.reduceat(np.where(space, np.uint64(0), mixed), starts)
            of = owner[starts]
            buckets.append(_bucket(word ^ _WORD, settings.bits))
            owners.append(of)
            pair = of[:-1] == of[1:]
            twice = word[:-1] == word[1:]
            both = np.where(twice, _TWICE, (word[:-1] * _STEP) ^ word[1:] ^ _PAIR)
            buckets.append(_bucket(both[pair], settings.bits))
            owners.append(of[:-1][pair])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Each bucket's share of the logit of class 1, and the logit of a text without features."""

    shares: np.ndarray
    bias: float
    settings: Settings

    def scores(self, texts: list[str]) -> np.ndarray:
        buckets, owners = features(texts, self.settings)
        total = np.bincount(owners, self.shares[buckets], minlength=len(texts))
        count = np.bincount(owners, minlength=len(texts))
        return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], settings: Settings) -> Model:
    """Train on (label, buckets, weights that add up to 1) of every document.

    Documents come in a fixed order and are shuffled by a seed.  A document's step is
    divided by the squared norm of its weights, so that long and short texts learn alike.
    """
    random = np.random.default_rng(settings.seed)
    vectors = random.normal(0, 0.1, (1 << settings.bits, settings.dimensions)).astype(np.float32)
    layer = random.normal(0, 1 / np.sqrt(settings.dimensions), (2, settings.dimensions)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = settings.epochs * len(rows), 0
    for _ in range(settings.epochs):
        for k in random.permutation(len(rows)):
            label, buckets, weights = rows[k]
            rate = settings.rate * (1 - done / steps)
            done += 1
            own = vectors[buckets]
            hidden = weights @ own
            logits = layer @ hidden + bias
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[label] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, hidden)
            bias -= rate * error
            if len(buckets):
                vectors[buckets] = own - (rate / float(weights @ weights)) * np.outer(weights, back)
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]), settings)


def learned_labels(labels: DataFrame, *, id_col: str, label_col: str) -> DataFrame:
    """One label per id: the more frequent one; ids with as many of both are left out."""
    votes = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
    share = votes.groupBy("id").agg(F.avg("label").alias("share")).filter("share != 0.5")
    return share.select("id", (F.col("share") > 0.5).cast("int").alias("label"))


def train(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    settings: Settings = Settings(),
) -> Model | None:
    """Train on at most ``settings.sample`` labelled documents, drawn by a hash of their ids.

    The sample's ids and labels are broadcast, its whole texts are turned to features where
    they lie, and one task does the descent.  None if no document has a label.
    """
    spark = documents.sparkSession
    drawn = learned_labels(labels, id_col=id_col, label_col=label_col).orderBy(F.xxhash64("id"), "id").limit(settings.sample)
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(drawn), "id").dropDuplicates(["id"])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text, label in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "label")), strict=True):
                buckets, _ = features([text], settings)
                unique, counts = np.unique(buckets, return_counts=True)
                weights = (counts / max(1, counts.sum())).astype("<f4")
                out.append((name, label, unique.astype("<u4").tobytes(), weights.tobytes()))
            if out:
                kinds = (batch.schema.field("id").type, pa.int32(), pa.binary(), pa.binary())
                columns = zip(zip(*out, strict=True), kinds, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["id", "label", "buckets", "weights"])

    kind = sample.schema["id"].dataType.simpleString()
    prepared = sample.select("id", "text", "label").mapInArrow(prepare, f"id {kind}, label int, buckets binary, weights binary")

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((row[0], row[1], np.frombuffer(row[2], "<u4"), np.frombuffer(row[3], "<f4")))
        rows.sort(key=lambda r: r[0])
        if rows:
            model = fit([r[1:] for r in rows], settings)
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.shares.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], names=["shares", "bias"]
            )

    found = prepared.repartition(1).mapInArrow(descend, "shares binary, bias double").first()
    return Model(np.frombuffer(found.shares, "<f4").astype(np.float64), found.bias, settings) if found else None


def score(
    documents: DataFrame,
    model: Model | None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    cut: float = 0.3,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``score`` (chance of class 1) and ``predicted`` (1 from ``cut`` on) of every whole text.

    Null and empty texts have no features and get the model's prior; without a model all
    scores are 0.5.  Ids may be null or repeat: each row gets its own result.  Columns not
    in ``keep`` are left out, whatever their names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    given = documents.select(id_col, *keep, F.col(text_col).alias("__text"))
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            scores = np.full(len(texts), 0.5)
            for a, b in slices(map(len, texts), CHUNK) if model else ():
                scores[a:b] = model.scores(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(scores), pa.array((scores >= cut).astype(np.int32))],
                names=[*names, "score", "predicted"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:-1])
    return given.mapInArrow(run, f"{fields}, score double, predicted int")


def held_out(id_col: str = "doc_id"):
    """Documents whose labels no model learns from."""
    return F.coalesce(crc_of_id(F.col(id_col)) % 5 == 0, F.lit(False))


def rate(documents: DataFrame, labels: DataFrame, *, settings: Settings = Settings()) -> DataFrame:
    """Learn from the labels of documents that are not held out and score all documents."""
    model = train(documents, labels.filter(~held_out()), settings=settings)
    return score(documents.withColumn("held_out", held_out()), model, keep=("held_out",))
