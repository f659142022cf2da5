"""From raw documents to packed training windows, one operator per stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm import decontaminate, language_id, near_dedup, packing, suffix_dedup
from playlens.llm.common import release, settled, table, written

ID, TEXT, LANG, LENGTH = "doc_id", "text", "lang", "n_chars"
#: A passage to cut has more than 50 words, and so at least this many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 101

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(stage: Stage) -> Stage:
    """The stage with all columns it doesn't know under names that clash with nothing.

    Whatever other columns documents have, they come out as they went in.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        known = (ID, TEXT, LANG, LENGTH)
        private = [c if c in known else f"other column {i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*private), sf_dir).toDF(*docs.columns)

    return run


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != ID)


@_apart
def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: those with a null or empty text, or one without letters.

    If no document says its language nothing can be learned, and documents with a letter
    stay.  Ids may be null or repeat: each row is judged by its own text.  An empty table stays
    empty.
    """
    model = language_id.train(docs)
    if model is None:
        return docs.filter(F.col(TEXT).rlike(r"\p{L}"))
    found = language_id.predict(docs, model, keep=_others(docs))
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select(docs.columns)


@_apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Texts that are null or without words are nobody's duplicates, nor are rows with a null id.
    Rows that repeat an id stay or go together.
    """

    def dropped() -> DataFrame:
        return near_dedup.near_duplicates(docs).filter(~F.col("kept")).select(F.col(ID).alias("dropped"))

    return docs.join(settled(spark, dropped, "near-duplicates"), F.col(ID) == F.col("dropped"), "left_anti")


@_apart
def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of more than 50 words that a document with a smaller id holds.

    Documents of which only white space is left go; one that is shorter than that stays, even
    if another one quotes all of it.  Rows with a null text or id stay as they are, and rows of the same
    id don't take from each other.
    """
    return suffix_dedup.without_repeats(docs, least=PASSAGE_BYTES, least_words=PASSAGE_WORDS, length_col=LENGTH)


@_apart
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark; those without words hold none."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=_others(docs))
    return found.filter("n_hit = 0").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens, with their ids; a null text is its end alone.

    Workers don't keep what they remember of words, as other stages may follow in them.
    """
    return packing.pack(docs, keep_words=False)


STAGES = [
    ("language_id", identify),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the language models, the removal of bytes or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one but the last is written and read again.

    A stage's table goes once the next one is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = written(stage(spark, docs, sf_dir), name)
        if hasattr(docs, "scratch"):
            release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
