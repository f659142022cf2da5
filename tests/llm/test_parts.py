"""The operators' own building blocks against plain computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playlens.llm import decontaminate, html_text, language_id, near_dedup, packing, quality, suffix_dedup, token_file, tokens, topk_search
from playlens.llm.components import components
from playlens.llm.suffix_array import common_prefixes, suffix_array
from playlens.llm.tokens import VOCABULARY, Encoder, sentence_tables

TOKENIZER = Tokenizer.from_file(VOCABULARY)
ENCODER = Encoder()
WORDS = ["the", "a", "of", "one", "two", "six", "ten", "red", "sea", "sky", "sun", "ice", "oak", "elm", "fig", "rye"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t  ab.,!'éж日1\U0001f600<|>")), min_size=1, max_size=4))
def test_ids_are_those_of_whole_texts(texts):
    texts += ["it's <|endoftext|> x<|endoftext|>y", "don't  stop.\nNow\n\nthen ", "foo,bar.\nBaz!! ǅx qux"]
    whole = [np.array(e.ids, "<u4").tobytes() for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert ENCODER.encode(texts) == whole


def test_ids_don_t_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 8)
    small = Encoder()
    texts = ["the cat, the dog\nsaw", "naïve cat's Übung. Жук!", "the sky  is", "caf\u00e9, the dog's", "", "don't—stop", "日本 the cat"] * 3
    whole = [np.array(e.ids, "<u4").tobytes() for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    for k, text in enumerate(texts):
        assert small.encode([text]) == [whole[k]]
        assert len(small._later) <= 4 + 8 and len(small._parts) <= 4 + 8
    small.forget()
    assert small.encode(texts) == whole


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 6), st.booleans())
def test_suffix_arrays(data, letters, wide):
    text = np.frombuffer(data, np.uint8).astype(np.int64) % letters
    size = 700 if wide else 256  # either way of inducing
    order = suffix_array(text, size)
    raw = text.astype(np.uint8).tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    before = np.full(len(text), -1)
    before[order[1:]] = order[:-1]

    def shared(i, j):
        n = 0
        while j >= 0 and n < 20 and max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
            n += 1
        return n

    assert common_prefixes(text, before, 20).tolist() == [shared(i, before[i]) for i in range(len(raw))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), max_size=150), min_size=1, max_size=4), st.integers(10, 40))
def test_every_window_holds_a_sampled_gram(texts, least):
    data = [t.encode() for t in texts]
    _, owner, place, *_ = suffix_dedup.anchors(data, least)
    gram = min(suffix_dedup.GRAM, least)
    for k, text in enumerate(data):
        own = place[owner == k]
        for start in range(len(text) - least + 1):
            assert ((own >= start) & (own + gram <= start + least)).any()
        if len(own):
            mine = np.zeros(len(own), np.int64)
            _, at, first, last = suffix_dedup.windows_of([text], mine, own, least)
            covered = [s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)]
            assert covered == list(range(len(text) - least + 1))
            assert ((at >= first) & (at + gram <= first + least) | (last > first)).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=300), st.integers(0, 2**32))
def test_huffman_round_trip(counts, seed):
    counts = np.array(counts)
    lengths = token_file.code_lengths(counts)
    assert (lengths > 0).tolist() == (counts > 0).tolist() and lengths.max(initial=0) <= token_file.LIMIT
    used = np.flatnonzero(lengths)
    if not len(used):
        return
    assert (0.5 ** lengths[used].astype(float)).sum() <= 1
    random_ = np.random.default_rng(seed)
    sizes = random_.integers(0, 1300, 5)
    ids = random_.choice(used, int(sizes.sum()))
    payload, _, marks = token_file.encode_documents(ids, sizes, lengths, token_file.canonical_codes(lengths))
    back = token_file.decode_block(payload.tobytes(), marks, sizes, token_file.decoding_table(lengths))
    assert (back == ids).all()


def test_code_lengths_are_optimal_where_the_limit_does_not_bind():
    counts = np.array([45, 13, 12, 16, 9, 5])
    assert token_file.code_lengths(counts).tolist() == [1, 3, 3, 3, 4, 4]
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(sum(fibonacci[-2:]))
    lengths = token_file.code_lengths(np.array(fibonacci))
    assert lengths.max() == token_file.LIMIT and (0.5 ** lengths.astype(float)).sum() <= 1


def test_cuts_cost_no_more_than_any_others():
    random.seed(5)
    costs = packing.Costs(window=3, sentence=2, inside=5)
    for _ in range(60):
        size = random.choice([8, 12, 16])
        places = np.cumsum([random.randint(1, size) for _ in range(random.randint(1, 12))])
        fines = np.array([random.choice([0.0, 2.0, 5.0]) for _ in places])
        cuts = packing.best_cuts(places, fines, size, costs)
        at = dict(zip(places.tolist(), fines.tolist(), strict=True))
        power = size & (size - 1) == 0

        def waste(n):
            return packing.padding(n, size) if power else size - n

        best = {0: 0.0}
        for j in places.tolist():
            best[j] = min(best[i] + waste(j - i) + at[j] + costs.window for i in best if 0 < j - i <= size)
        ends = [0, *cuts]
        cost = sum(waste(b - a) + at[b] + costs.window for a, b in zip(ends, ends[1:], strict=False))
        assert cuts[-1] == places[-1] and cost == pytest.approx(best[int(places[-1])])


def test_long_sentences_are_cut_inside():
    ids = np.zeros(5000, np.int64)
    tables = (np.zeros(1, np.int8), np.zeros(1, bool))
    places, fines = packing.cut_points(ids, np.array([5000]), 2048, tables, packing.Costs())
    assert np.diff(places, prepend=0).max() <= 128 and fines[-1] == 0 and (fines[:-1] == 32).all()
    closing, spaced = sentence_tables()
    end, word = (TOKENIZER.encode(t, add_special_tokens=False).ids[0] for t in (".", " word"))
    assert closing[end] == 1 and spaced[word] and not closing[word]


@pytest.mark.parametrize("kind", ["spread", "grouped", "repeated"])
def test_cover_tree_search_is_exact(kind):
    random_ = np.random.default_rng(3)
    if kind == "spread":
        points = random_.normal(0, 50, (700, 8)).round()
    elif kind == "grouped":
        points = (random_.normal(0, 200, (9, 8))[random_.integers(0, 9, 700)] + random_.normal(0, 4, (700, 8))).round()
    else:
        points = np.repeat(random_.normal(0, 50, (3, 8)).round(), 234, 0)[:700]
    ids = np.sort(random_.permutation(5000)[:700])
    best = topk_search.search(
        queries := topk_search.build(ids[:90], points[:90]), topk_search.build(ids, points), 5
    )
    for k, name in enumerate(queries.ids):
        scores = points @ queries.points[k]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != name][:5]
        assert best.id[k].tolist() == ids[order].tolist() and best.score[k].tolist() == scores[order].tolist()


def test_estimates_agree_with_similarities():
    random_ = np.random.default_rng(2)
    chosen = near_dedup.Settings()
    for share in (0.0, 0.5, 0.8, 1.0):
        common = random_.integers(0, 1 << 63, int(2000 * share), np.uint64)
        rest = [random_.integers(0, 1 << 63, 2000 - len(common), np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([common, r])) for r in rest]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        planes = near_dedup.packed(near_dedup.minima(sets, chosen))
        found = near_dedup.estimate(near_dedup.matches(planes[:1], planes[1:]))[0, 0]
        assert abs(found - true) < 0.15
        assert near_dedup.shared_counts(sets)[0, 1] == len(np.intersect1d(*sets))


def test_short_texts_and_word_ends():
    sets = near_dedup.shingle_sets([b"A b\tC d", b"a B c D", b"a b c", b"a b", b"b a", b"", b" \n", b"a  b\x0bc\x0cd"], 3)
    assert [len(s) for s in sets] == [2, 2, 1, 1, 1, 0, 0, 2]
    assert (sets[0] == sets[1]).all() and (sets[0] == sets[7]).all()
    assert sets[3][0] != sets[4][0] and sets[2][0] in sets[0]


def _walks(count, start, edits, seed):
    """Near copies of one text, each with its own number of changed words."""
    random.seed(seed)
    base = [random.choice(WORDS) + str(random.randint(0, 400)) for _ in range(start)]
    for k in range(count):
        words = base[:]
        for _ in range(random.randint(0, edits)):
            words[random.randrange(start)] = f"new{random.randint(0, 9)}"
        yield " ".join(words)


@pytest.mark.parametrize("block", [8, 128])
def test_large_clusters_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = [*_walks(70, 60, 7, 1), *_walks(50, 90, 12, 2), *_walks(12, 40, 2, 3), *_walks(40, 30, 30, 4)]
    random.seed(9)
    random.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    chosen = near_dedup.Settings(words=3, percent=85)
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame, settings=chosen).collect()}
    sets = [set(s.tolist()) for s in near_dedup.shingle_sets([t.encode() for t in texts], 3)]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert found == {i: top(i) for i in range(len(texts))}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7), (300, 299)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.a: r.b for r in components(frame).collect()}
    expected = {i: 0 for i in range(1, 31)} | {i: 100 for i in range(101, 140)} | {200: 100, 300: 299}
    assert found == expected
    assert components(frame.limit(0)).count() == 0


def test_costs_are_those_of_a_distribution():
    texts = {"x": [b"the cat sat on the mat", b"a cat"], "y": [b"le chat est sur le tapis"]}
    counts = {k: np.unique(language_id.grams(*language_id.joined(v)), return_counts=True) for k, v in texts.items()}
    model = language_id.build(counts)
    chance = np.exp2(-model.bits.astype(float))
    unseen = 256 - (model.bits.shape[1] - 1)
    assert np.allclose(chance[:, 1:].sum(1) + unseen * chance[:, 0], 1, atol=0.01)
    bits = model.code_lengths([b"the cat sat", b"", b"le chat est", b"\xff\xfe"])
    assert bits[0, 0] < bits[0, 1] and bits[2, 1] < bits[2, 0] and (bits[1] == 0).all() and np.isfinite(bits).all()
    alone = np.concatenate([model.code_lengths([t]) for t in (b"the cat sat", b"le chat est")])
    assert np.allclose(alone, bits[[0, 2]])


def test_contexts_of_a_hot_gram_are_dealt_out(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz    é"
    common, short = ("".join(rng.choices(letters, k=n)) for n in (180, 56))

    def text(i: int) -> str:
        own = ["".join(rng.choices(letters, k=70)) for _ in range(3)]
        return own[0] + (common if i % 3 else "") + own[1] + (short if i % 2 else "") + own[2]

    texts = {i: text(i) for i in range(400)}
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen, expected = {}, {}
    for i, t in texts.items():
        data = t.encode()
        gone = np.zeros(len(data) + 2, int)
        for at in range(len(data) - 49):
            if seen.setdefault(data[at : at + 50], i) < i:
                gone[at + 1 : at + 51] = 1
        if gone.any():
            expected[i] = np.stack([np.flatnonzero(np.diff(gone) == 1), np.flatnonzero(np.diff(gone) == -1)], 1).tolist()
    for hot in (suffix_dedup.HOT, 50):
        rows = suffix_dedup.repeated_spans(documents, hot=hot).collect()
        assert {r.id: np.frombuffer(r.ranges, "<i8").reshape(-1, 2).tolist() for r in rows} == expected
    given = documents.select(F.xxhash64("text").alias("digest"), "text", F.col("doc_id").alias("id"))
    places = suffix_dedup._candidates(given.select("digest", "text"), 50, 32, 8, 50).cache()
    often = np.sort(np.frombuffer(b"".join(r.places for r in places.filter("digest IS NULL").collect()), np.uint64))
    lists = places.groupBy("digest").agg(F.collect_list("places").alias("places"))
    found = given.join(lists, "digest").select("id", "text", "places").cache()

    def most(hot):
        """The largest share of contexts that a shard of 64 gets."""
        held = suffix_dedup._contexts(found, 50, 64, hot).filter("context IS NOT NULL").groupBy("shard").count().collect()
        return max(r["count"] for r in held) / sum(r["count"] for r in held)

    # By gram alone, one shard gets the edge of every document with a passage.
    assert len(often) and most(often[:0]) > 0.15 and most(often) < 0.05


@pytest.mark.parametrize(
    "inside, expected",
    [
        ('a <svg class="i"/> b', "a b"),
        ("a <math/> b", "a b"),
        ("a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b", "a x=1 b"),
        ("a <svg><title/><text>no</text></svg> b", "a b"),
        ("a <video><p>no</p></video> b", "a b"),
        ("a <span><canvas></span> b", "a b"),
        ("a <script>no</script> b", "a b"),
    ],
)
def test_text_after_embedded_elements_stays(inside, expected):
    page = f"<html><body><article><p>{inside}</p><p>c</p></article></body></html>"
    assert html_text.extract(page, html_text.DEFAULT_WEIGHTS) == f"{expected}\nc"


@pytest.mark.parametrize(
    ("inside", "expected"),
    [
        ('<p title="the hidden valley">a</p>', "a"),
        ('<div aria-hidden="false"><p>a</p></div>', "a"),
        ('<p>a</p><p aria-hidden="true">no</p>', "a"),
        ('<p data-id="comment">a</p>', "a"),
        ('<p data-x="a > b" data-class=\'ad\'>a</p>', "a"),
        ('<h2 class="section-header">a</h2>', "a"),
        ("<p><b>only</b>x<br>y<br/>z</p>", "onlyx y z"),
        ('<p class="one two three four five ad">no</p><p>a</p>', "a"),
        ('<p class="footnote-header">a</p><div class="author-comments"><p>no</p></div>', "a"),
        ("<p hidden>no</p><p>a</p>", "a"),
        ('<ul><li role=navigation>no</li><li id="x">a</li></ul>', "a"),
    ],
)
def test_attributes_are_read_by_name(inside, expected):
    page = f"<html><body><nav>no</nav><article>{inside}<p>c d e f</p></article><footer>no</footer></body></html>"
    assert html_text.extract(page, html_text.DEFAULT_WEIGHTS) == f"{expected}\nc d e f"


def test_several_articles_on_a_page():
    page = "<nav>no</nav><article><h2>a b</h2><p>c</p></article><aside>no</aside><article><p>d e</p></article><footer>no</footer>"
    assert html_text.extract(page, html_text.DEFAULT_WEIGHTS) == "a b\nc\nd e"


def test_of_equal_runs_the_first_is_taken():
    weights = {"word": {"nav2": 0.0}, "tag": {"hr": -4.0}, "prior": 1.0}
    assert html_text.extract("a b<hr>c d", weights) == "a b"


def test_weights_of_all_names_from_pages_that_name_their_content(spark):
    plain = [(i, "<div><p>text without any content element</p></div>") for i in range(40)]
    named = [(100 + i, f"<div class='c{i} d e f g{i}'>x y z</div><main><p>the text</p></main>") for i in range(5)]
    frame = spark.createDataFrame(plain + named, "page_id long, html string")
    weights = html_text.learn_weights(frame, id_col="page_id", sample=5)
    assert {f"div.{c}{i}" for c in "cg" for i in range(5)} < set(weights["word"])


def test_clashing_names_of_main_text_are_refused(spark):
    frame = spark.createDataFrame([(1, "<p>a</p>", "x")], "page_id long, html string, n_chars string")
    with pytest.raises(ValueError, match="n_chars"):
        html_text.main_text(frame, id_col="page_id", keep=("n_chars",))


def test_a_benchmark_in_parts_gives_the_same_rows(spark):
    random_ = np.random.default_rng(4)
    texts = [" ".join(random_.choice(WORDS[:4], 40)) for _ in range(30)] + [None, "", "The SEA, the sky", "the sea the sky"]
    documents = [(i % 25 if i % 7 else None, t, "x") for i, t in enumerate([*texts, *texts[:12]])]
    items = [(f"i{i}", " ".join(t.split()[3:9]) if t else t) for i, t in enumerate(texts)] + [("i0", "the sea the sky"), (None, "red"), ("n", None)]
    frame = spark.createDataFrame(documents, "doc_id long, text string, ranges string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    whole, parts = (
        sorted(map(repr, decontaminate.contamination(frame, benchmark, window=5, part_bytes=size, keep=("ranges",)).collect()))
        for size in (1 << 20, 100)
    )
    assert len(list(decontaminate.item_parts(benchmark, "item_id", "text", 100))) > 3
    assert whole == parts and len(whole) == len(documents)
    assert sum("n_hit=0" not in row for row in whole) > 10
    with pytest.raises(ValueError, match="n_hit"):
        decontaminate.contamination(frame.withColumnRenamed("ranges", "n_hit"), benchmark, keep=("n_hit",))


_ALL = (1 << 64) - 1


def _plain_bucket(key: int, bits: int) -> int:
    key = key * int(quality._MIX) & _ALL
    return ((key ^ (key >> 32)) * int(quality._STEP) & _ALL) >> (64 - bits)


def _plain_features(text: str, settings) -> list[int]:
    """Character by character, with whole numbers."""
    mix, step = int(quality._MIX), int(quality._STEP)
    found = []
    for n in settings.char_ngrams:
        for at in range(len(text) - n + 1):
            key = n + 16
            for c in text[at : at + n]:
                key = (key ^ ord(c)) * step & _ALL
            found.append(key)
    words = []
    for word in "".join(" " if ord(c) <= 32 or ord(c) in (0x85, 0xA0) else c for c in text).split(" "):
        total = 0
        for rank, c in enumerate(word):
            one = (ord(c) + mix * (rank + 1)) * step & _ALL
            total += (one ^ (one >> 29)) * mix & _ALL
        if word:
            words.append(total & _ALL)
    found += [w ^ 1 for w in words]
    found += [3 if a == b else (a * step & _ALL) ^ b ^ 2 for a, b in zip(words, words[1:], strict=False)]
    return [_plain_bucket(key, settings.bits) for key in found]


def test_quality_is_that_of_a_plain_computation():
    settings_ = quality.Settings(bits=8, dimensions=4, epochs=3)
    random_ = np.random.default_rng(3)
    texts = [" ".join(random_.choice(WORDS[:8] if i % 2 else WORDS[8:], 1 + i)) for i in range(14)]
    texts += ["", "a", "\u00e9t\u00e9 \u65e5\n\tx  x", " b "]
    labels = [i % 2 for i in range(len(texts))]
    plain = [_plain_features(t, settings_) for t in texts]
    buckets, owners = quality.features(texts, settings_)
    for k in range(len(texts)):
        assert sorted(buckets[owners == k].tolist()) == sorted(plain[k])
    rows = []
    for label, own in zip(labels, plain, strict=True):
        unique, counts = np.unique(np.array(own, np.int64), return_counts=True)
        rows.append((label, unique, (counts / max(1, counts.sum())).astype(np.float32)))
    model = quality.fit(rows, settings_)
    # The same descent with lists of Python numbers.
    seeded, size = np.random.default_rng(settings_.seed), settings_.dimensions
    vectors = seeded.normal(0, 0.1, (1 << settings_.bits, size)).tolist()
    layer = seeded.normal(0, 1 / np.sqrt(size), (2, size)).tolist()
    bias, done = [0.0, 0.0], 0
    for _ in range(settings_.epochs):
        for k in seeded.permutation(len(rows)):
            rate = settings_.rate * (1 - done / (settings_.epochs * len(rows)))
            done += 1
            share = {b: plain[k].count(b) / len(plain[k]) for b in plain[k]}
            hidden = [sum(w * vectors[b][d] for b, w in share.items()) for d in range(size)]
            logits = [sum(map(math.prod, zip(layer[c], hidden, strict=True))) + bias[c] for c in (0, 1)]
            chance = [math.exp(x) / sum(map(math.exp, logits)) for x in logits]
            error = [chance[c] - (labels[k] == c) for c in (0, 1)]
            back = [error[0] * layer[0][d] + error[1] * layer[1][d] for d in range(size)]
            for c in (0, 1):
                layer[c] = [layer[c][d] - rate * error[c] * hidden[d] for d in range(size)]
                bias[c] -= rate * error[c]
            norm = sum(w * w for w in share.values())
            for b, w in share.items():
                vectors[b] = [vectors[b][d] - rate / norm * w * back[d] for d in range(size)]
    for text, own, score in zip(texts, plain, model.scores(texts), strict=True):
        mean = [sum(vectors[b][d] for b in own) / max(1, len(own)) for d in range(size)]
        logit = sum((layer[1][d] - layer[0][d]) * mean[d] for d in range(size)) + bias[1] - bias[0]
        assert score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4), text


def _ppm_bits(learned: bytes, text: bytes) -> float:
    """Method C with exclusion, from the counts of every context seen."""
    seen = {}
    padded = b"   " + learned
    for i in range(3, len(padded)):
        for order in range(4):
            after = seen.setdefault(padded[i - order : i], {})
            after[padded[i]] = after.get(padded[i], 0) + 1
    padded, bits = b"   " + text, 0.0
    for i in range(3, len(padded)):
        barred, chance = set(), 1.0
        for order in (3, 2, 1, 0):
            after = seen.get(padded[i - order : i])
            if not after:
                continue
            whole = sum(after.values()) + len(after)
            left = 1 - sum(after[b] for b in barred) / whole
            if padded[i] in after:
                chance *= after[padded[i]] / whole / left
                break
            chance *= len(after) / whole / left
            barred = set(after)
        else:
            chance /= 256 - len(barred)
        bits -= np.log2(chance)
    return bits


def test_every_context_seen_counts(spark):
    rng = random.Random(8)
    learned = {"x": "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(60000)), "y": "plain words " * 50}
    text = "".join(learned["x"][i : i + 3] for i in range(0, 60000, 997)) + "plain new 字"
    documents = spark.createDataFrame(list(learned.items()), "lang string, text string")
    model = language_id.train(documents)
    strings, _, contexts, *_ = model.arrays(0)
    data = b"   " + learned["x"].encode()
    assert len(strings) == len({data[i : i + 4] for i in range(len(data) - 3)}) > 1 << 16
    assert len(contexts) == len({data[i : i + 3] for i in range(len(data) - 3)}) > 1 << 14
    expected = [_ppm_bits(learned[k].encode(), text.encode()) for k in "xy"]
    assert np.allclose(model.code_lengths([text.encode()])[0], expected, rtol=1e-5)
    counts = {k: np.unique(language_id.grams(*language_id.joined([v.encode()])), return_counts=True) for k, v in learned.items()}
    assert np.allclose(language_id.build(counts).code_lengths([text.encode()])[0], expected, rtol=1e-5)


def test_scores_do_not_depend_on_the_batch():
    chosen = quality.Settings(bits=12, epochs=3)
    texts = ["good words here", "BAD!! BAD!!", "", "x", "good words here"]
    rows = []
    for label, text in ((1, texts[0]), (0, texts[1])):
        buckets, counts = np.unique(quality.features([text], chosen)[0], return_counts=True)
        rows.append((label, buckets, (counts / counts.sum()).astype(np.float32)))
    model = quality.fit(rows * 20, chosen)
    together = model.scores(texts)
    assert np.allclose(together, [model.scores([t])[0] for t in texts])
    assert together[0] == together[4] > 0.5 > together[1]


def test_hits_map_to_the_original_text():
    automaton = decontaminate.build([("q", "One, two THREE")], 10)
    text = "x one--two éthree three One two? three!"
    words = decontaminate.normalise(text)
    ranges, items = decontaminate.scan(words, automaton)
    assert items == {"q"} and [words[a:b] for a, b in ranges] == [[b"one", b"two", b"three"]]
    first, end = decontaminate.word_offsets(text)
    assert text.encode()[first[ranges[0][0]] : end[ranges[0][1] - 1]] == b"One two? three"


def test_kept_bytes_in_whole_characters():
    text = "aé日z"  # 1 + 2 + 3 + 1 bytes
    cut = lambda *ranges: np.array(ranges, "<i8").tobytes()
    assert suffix_dedup.kept_bytes(text, cut((2, 5)))[0] == b"a\xc3\xa5z"
    assert suffix_dedup.kept_bytes(text, cut((2, 6)), True)[0].decode() == "aéz"
    assert suffix_dedup.kept_bytes(text, cut((1, 7)), True)[0].decode() == "a"
    assert suffix_dedup.kept_bytes(text, cut((2, 3)), True)[0].decode() == text
    assert suffix_dedup.kept_bytes(None, None)[0] == b""
