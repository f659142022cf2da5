"""Registered corpus queries against their SQL or a plain computation, over the smallest tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
from playlens.llm import html_text, packing
from playlens.llm.tokens import VOCABULARY

SMALL = "/root/testdata/sf0.001"
QUERIES = contract.corpus()
ORACLE = contract.corpus_queries.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


@pytest.fixture(scope="module")
def documents(database):
    return database.execute("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def ids(documents):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t, _ in documents}


def _rows(spark, name):
    return QUERIES[name](spark, SMALL).collect()


def _bytes(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(name, spark, database):
    frame = QUERIES[name](spark, SMALL)
    found = database.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = sorted(found.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == expected


def test_main_text_is_that_of_the_article(spark, database):
    import html
    import re

    pages = dict(database.execute("SELECT page_id, html FROM pages").fetchall())
    for row in _rows(spark, "op3_html_text"):
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[row.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inside)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", b))).strip() for b in blocks]
        assert row.text == "\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text)


def test_quality_of_held_out_documents(spark, database):
    labels = dict(database.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = _rows(spark, "op5_quality")
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert held and np.mean([a == b for a, b in held]) >= 0.8


def test_language_of_held_out_documents(spark, documents):
    rows = {r.doc_id: r for r in _rows(spark, "op8_language_id")}
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in documents)
    held = [rows[d].lang_pred == lang for d, _, lang in documents if rows[d].held_out]
    assert np.mean(held) >= 0.9


def test_pieces_cover_every_document_with_little_padding(spark, ids):
    pieces = defaultdict(list)
    windows = defaultdict(list)
    for row in _rows(spark, "op7_packing"):
        pieces[row.doc_id].append(row)
        windows[row.sequence_id].append((row.offset, row.length))
    assert set(pieces) == set(ids)
    for doc_id, own in pieces.items():
        data, at = _bytes([*ids[doc_id], 1]), 0
        for row in sorted(own, key=lambda r: r.start):
            assert row.start == at and row.length > 0 and row.doc_tokens * 4 == len(data)
            assert zlib.crc32(data[4 * at : 4 * (at + row.length)]) == row.ids_crc32
            at += row.length
        assert 4 * at == len(data)
    padding = total = 0
    for own in windows.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
        total += end
        padding += packing.padding(end, 2048)
    assert padding <= 0.03 * total


def test_token_files_read_back(spark, ids):
    expected, start = [], 0
    for doc_id in sorted(ids):
        own = [*ids[doc_id], 2]
        expected.append((doc_id, start, len(own), zlib.crc32(_bytes(own))))
        start += len(own)
    assert sorted(map(tuple, _rows(spark, "op10_token_file"))) == expected


def test_repeated_bytes_are_those_of_a_plain_search(spark, documents):
    seen: dict[bytes, int] = {}
    expected = []
    for doc_id, text, _ in documents:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 49):
            if seen.setdefault(data[i : i + 50], doc_id) < doc_id:
                gone[i : i + 50] = True
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        kept = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
        expected.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, _rows(spark, "op9_suffix_dedup"))) == expected


def test_weights_come_from_labelled_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = html_text.learn_weights(pages, id_col="page_id")
    assert weights["word"]["div.ad"] < 0 < weights["prior"]
    assert weights["tag"]["li"] < weights["tag"]["p"] < 0
