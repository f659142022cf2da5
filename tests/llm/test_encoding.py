"""What the encoder remembers, and ids that are counted as texts are encoded."""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from playlens.llm import token_file
from playlens.llm.tokens import VOCABULARY, Encoder, sentence_tables

TOKENIZER = Tokenizer.from_file(VOCABULARY)


def test_what_follows_a_line_break_is_remembered_by_itself():
    texts = ["One word.\nTwo words\nthree.", "a\n\nb\nc d", " \nx", "x\n y", "x y\n", "\nx y", "tab\t\nx y\nz", "é\nß ü.\nÖ", "q <|x|>\ny"]
    small = Encoder()
    whole = [np.array(e.ids, "<u4").tobytes() for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert small.encode(texts) == whole
    assert {"word.", "\nTwo", "words", "\nthree."} <= set(small._later)


def test_ids_are_counted_while_texts_are_encoded(spark):
    texts = ["one two two", None, "", "two\nthree"]
    documents = spark.createDataFrame([(k or None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    found = token_file.tokenised(documents, "doc_id", "text", 2, VOCABULARY).cache()
    ids = np.frombuffer(b"".join(r.ids for r in found.filter("n IS NOT NULL").collect()), "<u2")
    assert found.filter("n IS NOT NULL").count() == 4 and (ids == 2).sum() == 4
    assert token_file._counted(found, TOKENIZER.get_vocab_size()).tolist() == np.bincount(ids, minlength=TOKENIZER.get_vocab_size()).tolist()


def test_a_piece_that_many_texts_share_is_looked_up_once():
    asked = []

    class Counted(dict):
        def __getitem__(self, piece):
            asked.append(piece)
            return known[piece]

    texts = ["a cat", "the cat\nsat", "", "a cat sat"] * 50
    small = Encoder()
    whole = small.encode(texts)
    known, small._later = small._later, Counted()
    assert small._encode(texts) == whole
    assert sorted(asked) == ["\nsat", "cat", "sat"]


def test_a_space_before_a_line_break_counts_in_texts_of_any_kind():
    texts = ["a \nb<|", "a \nb\rc", "x \ny\n\nz", " \nb<|", "a\n \nb<|", " lead", "\nlead <|"]
    whole = [np.array(e.ids, "<u4").tobytes() for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert Encoder().encode(texts) == whole
    assert Encoder().encode(texts[::-1]) == whole[::-1]


def test_texts_encoded_ahead_come_one_by_one():
    texts = ["one two", "", "three\nfour", "  ", "five", "é six"]
    for together in (1, 9, None):
        assert list(Encoder().each(texts, together)) == Encoder().encode(texts)


def test_a_worker_reads_the_sentence_tables_once():
    assert sentence_tables()[0] is sentence_tables()[0]


def test_codes_meet_in_words_without_touching_each_other():
    ids = np.arange(3000, dtype=np.uint32) ** 2 % 70
    counts = np.array([0, 1, 511, 512, 513, 0, 1463])
    lengths = token_file.code_lengths(np.bincount(ids) ** 3)
    codes = token_file.canonical_codes(lengths)
    payload, ends, marks = token_file.encode_documents(ids, counts, lengths, codes)
    bits, plain, places = "", [], []
    for text in np.split(ids, np.cumsum(counts)[:-1]):
        for k, i in enumerate(text):
            if k % token_file.STEP == 0:
                places.append(len(bits))
            bits += f"{codes[i]:0{lengths[i]}b}"
        bits += "0" * (-len(bits) % 8)
        plain.append(len(bits) // 8)
    assert payload.dtype == np.uint8 and payload.tobytes() == int(bits, 2).to_bytes(len(bits) // 8, "big")
    assert ends.tolist() == plain and marks.tolist() == places
    assert (token_file.decode_block(payload.tobytes(), marks, counts, token_file.decoding_table(lengths)) == ids).all()
