"""The pipeline's stages on planted documents, and the whole of it over the smallest tables."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from playlens.llm import common
from playlens.llm.tokens import Encoder

SMALL = "/root/testdata/sf0.001"


def _passage(start, n=60):
    return " ".join(f"word{i * 7919 % 1000}x{i}" for i in range(start, start + n))


@pytest.fixture(scope="module")
def benchmark_text(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text


@pytest.fixture(scope="module")
def docs(spark, benchmark_text):
    rows = [
        (1, _passage(0, 200)),
        (2, _passage(0, 199) + " changed"),
        (3, _passage(2000, 90) + " ~~ " + _passage(500) + " and its end"),
        (4, _passage(3000, 90) + " ## " + _passage(500) + " other end of four"),
        (5, "before it " + benchmark_text + " after it"),
        (6, None),
        (7, "12345 !!! ..."),
        (8, _passage(1000, 50)),
        (9, _passage(500, 60)),
        (10, _passage(505, 17)),
    ]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs):
    columns = docs.columns
    found = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        found[name] = {r.doc_id: r for r in docs.collect()}
    assert set(found["language_id"]) == {1, 2, 3, 4, 5, 8, 9, 10}
    assert set(found["near_dedup"]) == {1, 3, 4, 5, 8, 9, 10}
    cut = found["suffix_dedup"]
    assert set(cut) == {1, 3, 4, 5, 8, 10}  # all of 9 is in 3, and of 10, which is short
    assert cut[10].text == _passage(505, 17)
    assert cut[3].text == found["near_dedup"][3].text
    assert cut[4].text == _passage(3000, 90) + " ##other end of four"
    assert cut[4].n_chars == len(cut[4].text)
    assert set(found["decontaminate"]) == {1, 3, 4, 8, 10}
    pieces = pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    ids = {r.doc_id: e + b"\1\0\0\0" for r, e in zip(docs.collect(), Encoder().encode([r.text for r in docs.collect()]), strict=True)}
    whole = dict.fromkeys(ids, b"")
    for r in sorted(pieces, key=lambda r: r.start):
        whole[r.doc_id] += r.ids
    assert whole == ids


CLASHES = ["score", "lang_pred", "dropped", "kept", "__id", "__ranges", "n_hit", "n_words", "items", "spans", "id"]


def test_stages_keep_other_columns_nulls_and_repeats(spark, docs):
    more = [(None, _passage(4000), None, None, None), (1, _passage(0, 200), None, None, 3), (11, "", "en", "s", 0), (12, None, "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs = docs.withColumns({name: F.concat(F.lit(f"{name} "), F.col("text")) for name in CLASHES})
    given = {(r.doc_id, r.score) for r in docs.collect()}
    for _, stage in pipeline.STAGES[:-1]:
        done = stage(spark, docs, SMALL)
        assert done.columns == docs.columns
        docs = spark.createDataFrame(done.collect(), done.schema)
        assert {(r.doc_id, r.score) for r in docs.collect()} <= given
    assert {r.doc_id for r in docs.collect()} == {None, 1, 3, 4, 8, 10}
    assert [r.doc_id for r in docs.collect()].count(1) == 2
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, docs, SMALL).collect()} == {None, 1, 3, 4, 8, 10}


def test_without_any_label_documents_with_letters_stay(spark, docs):
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in pipeline.identify(spark, unlabelled, SMALL).collect()} == {1, 2, 3, 4, 5, 8, 9, 10}


def test_tables_on_the_way_to_near_duplicates_go(spark, docs, monkeypatch):
    made = []
    before = common.scratch_path

    def path(spark, name):
        made.append(before(spark, name))
        return made[-1]

    monkeypatch.setattr(common, "scratch_path", path)
    assert pipeline.drop_near_duplicates(spark, docs, SMALL).count() == 9
    assert len(made) > 2 and [Path(p).exists() for p in made].count(True) == 1


def test_run_over_the_tables(spark):
    pieces = pipeline.run(spark, SMALL).collect()
    total = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    kept = {r.doc_id for r in pieces}
    assert 0.7 * total <= len(kept) <= total
    assert all(len(r.ids) == 4 * r.length for r in pieces)
    whole = {}
    for r in pieces:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole == {r.doc_id: r.doc_tokens for r in pieces}
    assert np.all([r.offset + r.length <= 2048 for r in pieces])


def test_stages_take_empty_tables(spark, docs):
    docs = docs.limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
        if "text" in docs.columns:
            docs = spark.createDataFrame([], docs.schema)


def test_tasks_of_every_stage_give_their_memory_back(spark, docs, monkeypatch):
    seen = []
    mapped = type(docs).mapInArrow

    def recorded(self, func, *args, **more):
        seen.append(func)
        return mapped(self, func, *args, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", recorded)
    for _, stage in pipeline.STAGES:
        before = len(seen)
        stage(spark, docs, SMALL)
        assert len(seen) > before and all(hasattr(f, "__wrapped__") for f in seen)


def test_memory_goes_back_when_a_task_ends_or_is_left(monkeypatch):
    back = []
    monkeypatch.setattr(common, "give_back", lambda: back.append(1))
    tasks = common.sparing(lambda batches: (2 * b for b in batches))
    assert list(tasks(iter([1, 2]))) == [2, 4] and back == [1]
    left = tasks(iter([1, 2]))
    assert next(left) == 2 and back == [1]
    left.close()
    assert back == [1, 1]
