"""The source audit against a plain computation, and its cases of nulls, ties and long texts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from playlens.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def _plain(rows, least, top=50):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        in_lang = sum((counts[lang, s] for s in sources), Counter())

        def p(own, kept=kept):
            total = sum(own[t] for t in kept)
            return {t: 1 + 10**9 * (own[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = p(in_lang)
        by_source = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(by_source[s][t] - by_source[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            over = [(q[t] - by_source[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and by_source[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    generator = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["été", "\U0001f600", "～", "Ä"]
    rows = []
    for i in range(400):
        picked = generator.choice(words, size=int(generator.integers(0, 40)), p=(w := 1 / np.arange(1, len(words) + 1)) / w.sum())
        lang = ["en", "de", None, "de"][i % 4]
        rows.append((i, "1 ".join(picked).upper(), lang, [None, "a", "b", "é", "z"][int(generator.integers(5)) if i % 3 else 1]))
    rows += [(1, None, "en", "quiet"), (1, "", "fr", "x"), (None, "9 !!", "fr", "y"), (2, "rare", "it", None)]
    return rows + rows[:40]


@pytest.mark.parametrize("least", [1, 30])
def test_same_as_a_plain_audit(spark, rows, least):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as j", "2 as n", "'x' as term", "3 as kept", "4 as item")
    assert sorted(map(tuple, divergence.audit(frame, least_docs=least).collect())) == _plain(rows, least)


def test_small_tiles_and_pieces_change_nothing(spark, rows, monkeypatch):
    for name, value in (("TILE_TERMS", 7), ("TILE_SOURCES", 2)):
        monkeypatch.setattr(divergence, name, value)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, divergence.audit(frame, least_docs=5, top=3).collect())) == _plain(rows, 5, 3)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


@given(st.text(st.sampled_from("aZ \né\U0001f6001_@[`{\x7f\x80"), max_size=60))
def test_terms_in_pieces(text):
    whole = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    before, divergence.PIECE = divergence.PIECE, 3
    try:
        assert [w.decode() for words in divergence.terms(text.encode()) for w in words] == whole
    finally:
        divergence.PIECE = before


def test_very_large_counts_stay_exact():
    counts = np.array([0, 7, 10**10, 9 * 10**18], np.int64)
    total = int(sum(map(int, counts)))
    assert divergence._scaled_rows(counts, total, 4).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 20) for c in counts]
