"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from playlens.llm import (
    decontaminate,
    html_text,
    language_id,
    near_dedup,
    packing,
    quality,
    suffix_dedup,
    token_file,
    topk_search,
    url_filter,
)

LONG = "lorem ipsum dolor sit amet consectetur " * 20000
TEXTS = [
    (1, "A first text that has some ten or more words to be compared with others."),
    (1, "A first text that has some ten or more words to be compared with others."),
    (2, None),
    (3, ""),
    (4, "  \n\t "),
    (5, "word"),
    (6, LONG),
    (7, LONG),
    (None, "A text without an id, which is nobody's copy."),
    (8, "A FIRST text that has some ten or more words to be compared with others."),
    (9, "\u00e9t\u00e9 \u00e7a \u65e5\u672c\u8a9e \U0001f600 12345 !!!"),
]
SCHEMA = "doc_id long, text string"
# Names that the operators use inside.
CLASHES = ["id", "digest", "node", "n", "bands", "spans", "items", "range", "places", "ids", "low", "bucket"]


@pytest.fixture(scope="module")
def documents(spark):
    frame = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    return frame.withColumns({name: F.lit("x") for name in CLASHES})


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [
        ("a", "some ten or more words to be compared with others"),
        ("b", "WORD!"),
        ("c", None),
        (None, "lorem ipsum"),
        ("d", ""),
        ("b", "WORD!"),
    ]
    return spark.createDataFrame(rows, "item_id string, text string")


def _by_id(frame, *columns):
    rows = [tuple(r[c] for c in ("doc_id", *columns)) for r in frame.collect()]
    assert len(rows) == len(TEXTS)
    return {r[0]: r[1:] for r in rows}


def test_near_duplicates(spark, documents):
    found = _by_id(near_dedup.near_duplicates(documents), "n_shingles", "component_id", "kept")
    assert found[1] == (11, 1, True) and found[8] == (11, 1, False)
    assert found[2] == (0, 2, True) and found[3] == (0, 3, True) and found[4] == (0, 4, True)
    assert found[5] == (1, 5, True)
    assert found[6][1:] == (6, True) and found[7][1:] == (6, False)
    assert found[None][1:] == (None, True)
    empty = near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_suffix_dedup(spark, documents):
    found = _by_id(suffix_dedup.remove_repeats(documents), "n_bytes", "spans", "kept")
    assert found[2] == (0, [], b"") and found[3] == (0, [], b"")
    assert found[1][1] == [] and found[6][1] == []  # repeats inside a document stay
    assert found[7][1][0][:] == (0, len(LONG)) and found[7][2] == b""
    assert [tuple(s) for s in found[8][1]] == [(7, len(TEXTS[0][1]))] and found[8][2] == b"A FIRST"
    assert found[None][1] == []
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_without_repeats_keep_their_columns(documents):
    found = suffix_dedup.without_repeats(documents.withColumn("n_chars", F.length("text")), length_col="n_chars")
    assert found.columns == [*documents.columns, "n_chars"]
    rows = {r.doc_id: r for r in found.collect()}
    assert 7 not in rows and rows[2].text is None and rows[8].text == "A FIRST" and rows[8].n_chars == 7
    assert rows[1].n_chars == len(rows[1].text)


def test_contamination(spark, documents, benchmark):
    found = _by_id(decontaminate.contamination(documents, benchmark), "n_words", "n_hit", "items", "spans")
    assert found[1][:3] == (15, 10, ["a"]) and found[8] == found[1]
    start, end = found[1][3][0]
    assert TEXTS[0][1][start:end] == "some ten or more words to be compared with others"
    assert found[5][:3] == (1, 1, ["b"])
    assert found[2] == (0, 0, [], []) and found[4] == (0, 0, [], [])
    assert found[6][1] == 0
    nothing = decontaminate.contamination(documents, benchmark.limit(0))
    assert nothing.filter("n_hit > 0").count() == 0 and nothing.count() == len(TEXTS)
    parts = decontaminate.contamination(documents, benchmark, part_bytes=1)
    assert _by_id(parts, "n_words", "n_hit", "items", "spans") == found
    assert decontaminate.contamination(spark.createDataFrame([], SCHEMA), benchmark).count() == 0


def test_language(spark, documents):
    learned = documents.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise("yy"))
    model = language_id.train(learned)
    found = _by_id(language_id.predict(documents, model), "lang_pred", "score")
    assert all(found[i] == ("und", 0.0) for i in (2, 3, 4))
    assert all(found[i][0] in ("xx", "yy") and 0 < found[i][1] <= 1 for i in (1, 5, 6, 9))
    assert language_id.train(learned.withColumn("lang", F.lit(None).cast("string"))) is None
    untaught = _by_id(language_id.predict(documents, None), "lang_pred", "score")
    assert set(untaught.values()) == {("und", 0.0)}
    assert language_id.identify(learned.limit(0)).count() == 0


def test_quality(spark, documents):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (6, 1), (9, 0), (9, 1), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(documents, labels, settings=quality.Settings(bits=10, epochs=20))
    found = _by_id(quality.score(documents, model), "score", "predicted")
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in found.values())
    assert found[2] == found[3] and found[1][0] > found[5][0]
    assert quality.train(documents, labels.limit(0)) is None
    assert set(_by_id(quality.score(documents, None), "score").values()) == {(0.5,)}
    assert quality.rate(documents.limit(0), labels).count() == 0


def test_packing(spark, documents):
    pieces = packing.pack(documents, size=64).collect()
    total: dict = {}
    for row in pieces:
        total[row.doc_id] = total.get(row.doc_id, 0) + row.length
        assert len(row.ids) == 4 * row.length <= 4 * 64
    assert total[2] == 1 and total[3] == 1 and len(total) == 10
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_token_file(spark, documents):
    found = token_file.round_trip(documents, ranges=4).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, 1, 1, *range(2, 10)]
    assert found[3].n_tokens == 1 and found[3].ids == b"\2\0\0\0"
    ends = [0]
    for row in found:
        assert row.start == ends[-1] and len(row.ids) == 4 * row.n_tokens
        ends.append(row.start + row.n_tokens)
    assert token_file.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_url_filter(spark):
    rules = [
        url_filter.Rule("org", "/", "allow"),
        url_filter.Rule("example.org", "/es/", "block"),
        url_filter.Rule("b.example.org", "/es/", "allow"),
    ]
    urls = [
        (1, "http://A.B.Example.ORG/es/1?x=/fr/", "a.b.example.org", "/es/1", "b.example.org/es/", "allow"),
        (2, "http://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        (3, "https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (4, "https://example.org?q", "example.org", "", None, "allow"),
        (5, None, "", "", None, "allow"),
        (6, "example.org/es/", "", "", None, "allow"),
        (6, "", "", "", None, "allow"),
        (None, "x://org/#a://b", "org", "/", "org/", "allow"),
        (7, "http://" + "a." * 5000 + "org/" + "y" * 5000, "a." * 5000 + "org", "/" + "y" * 5000, "org/", "allow"),
    ]
    pages = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string").withColumn("host", F.lit(1))
    found = url_filter.judge(pages, rules, id_col="page_id").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr((u[0], *u[2:])) for u in urls)
    assert url_filter.judge(pages.limit(0), rules, id_col="page_id").count() == 0
    assert url_filter.judge(pages, [], id_col="page_id").filter("rule is null").count() == len(urls)


def test_html(spark):
    pages = [
        (1, None, ""),
        (2, "", ""),
        (3, "<html><body>   </body></html>", ""),
        (4, "<article><p>Only &lt;one&gt;\n\n text&nbsp;here</article>", "Only <one> text here"),
        (4, "<article><p>cut off here &amp; <a hre", "cut off here &"),
        (None, "<main><h2>Head</h2><ul><li>first item of it<li>second item of it</ul></main>", "Head\nfirst item of it\nsecond item of it"),
        (5, "<article><script>if (a<b) x()</script><p>body text of it</p><aside>no</aside><form><p>no<input></form>"
            "<div class='comments'><p>not by the author at all</div><p>more body text</p></article>", "body text of it\nmore body text"),
        (6, "<div class='site-header'><p>name of the site</div><div class='page-with-sidebar'><p>a body of some words</p>"
            "<p>and more</p><div id='sidebar'><p>what else there is to read</p></div></div>", "a body of some words\nand more"),
    ]
    frame = spark.createDataFrame([p[:2] for p in pages], "page_id long, html string").withColumn("text", F.lit("x"))
    found = html_text.main_text(frame, id_col="page_id", weights=html_text.DEFAULT_WEIGHTS).collect()
    assert sorted(repr((r.page_id, r.text)) for r in found) == sorted(repr((p[0], p[2])) for p in pages)
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_text.main_text(frame.limit(0), id_col="page_id").count() == 0


def test_figures_are_no_letters(spark):
    texts = [(1, "\u00b2"), (2, "\u00bd 12"), (3, "\u2460"), (4, "\u00e9"), (5, "a"), (6, "the cat sat"), (7, "\u65e5")]
    frame = spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language_id.predict(frame, language_id.train(frame)).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "en", 5: "en", 6: "en", 7: "en"}


def test_top_k_of_large_components(spark):
    random_ = np.random.default_rng(8)
    rows = [(int(i), random_.normal(size=4).tolist()) for i in range(3, 49)]
    rows += [(0, [1.0, 0.0, 0.0, 0.5]), (50, [5000.0, 1.0, 0.0, 0.0]), (2, [4096.0, 0.0, 3.0, 0.0]), (100, [-1e6, 3e6, 0.25, -2e6])]
    rows += [(i, (random_.normal(size=4) * 1e6).tolist()) for i in range(101, 140)] + [(141, [1e300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(frame).collect()}
    whole = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if i != 141]
    for query, v in whole:
        if query % 50 == 0:
            scores = sorted((-sum(map(math.prod, zip(v, w, strict=True))), i) for i, w in whole if i != query)[:5]
            assert [found[query, k] for k in range(1, 6)] == [(i, -score) for score, i in scores]


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, [0.5, 0.999]), (5, None),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, []), (100, [1.0, 1.0, 1.0]), (3, [1.0, 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    found = topk_search.top_k(frame, k=3).collect()
    by_query: dict = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert by_query[0] == [(1, 2, 65536), (2, 3, 65536), (3, 3, 65536)]
    assert by_query[50] == [(1, 4, 256 * 255), (2, 0, 0), (3, 2, 0)]
    assert 100 not in by_query
    assert topk_search.top_k(frame.limit(0)).count() == 0
