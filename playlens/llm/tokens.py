"""Token ids of whole texts, for the operators that pack and store them.

A Python worker remembers the ids of words from one task to the next, up to the bounds below.  Where
other steps that need much memory follow in the same workers, a task can give its words back
(``keep_words=False``), and the next one learns them anew.
"""

from __future__ import annotations

import gc
import os
import re
import string
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer

#: The vocabulary file used where a caller names no other.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces between spaces that a worker remembers, and their characters; as many parts of them.
MEMO_PIECES, MEMO_CHARS = 1_000_000, 32 << 20
#: Which characters below this are letters doesn't depend on the version of Unicode.
_STABLE = "\u0590"
#: Characters whose pieces are looked up together, each different one once.
TOGETHER = 8 << 20
_ODD_SPACE = re.compile(r"[^\S\n]|\n\n")


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes add up to about ``limit`` at most."""
    first = end = total = 0
    for size in sizes:
        if end > first and total + size > limit:
            yield first, end
            first, total = end, 0
        end += 1
        total += size
    if end > first:
        yield first, end


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be printed."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Pieces(dict):
    """Ids by piece; a piece that is asked for the first time is looked up in the older ones, or learned."""

    def __init__(self, learn, older: dict[str, bytes | None]) -> None:
        self.learn, self.older, self.chars = learn, older, 0

    def __missing__(self, piece: str) -> bytes | None:
        found = self.older.get(piece)
        if found is None:
            found = self.learn(piece)
        self[piece] = found
        self.chars += len(piece)
        return found


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes, equal to encoding the whole text.

    The pre-tokenizer starts a new token at every single space between two other
    characters, so the text falls into pieces that can be encoded by themselves and
    remembered.  Arrow finds the different pieces of many texts and puts their ids in place.
    A text with a piece that starts or ends with white space (runs of
    spaces, line breaks next to spaces) is encoded whole.  Pieces in turn fall into parts at
    single line breaks and between a run of letters and the punctuation after it.  A run of letters
    or of punctuation is one pre-token, which the BPE model takes as it is.
    """

    def __init__(self, path: str = VOCABULARY) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self._model = self.tokenizer.model
        self._letters = _byte_letters()
        self._space = self._letters[32]
        self._packed = [i.to_bytes(4, "little") for i in range(self.size)]
        self.forget()

    def forget(self) -> None:
        """Give back the memory of remembered pieces, as at the end of a task."""
        self._later = _Pieces(self._learn, {})  # pieces after a space, without it, and those that begin with a line break
        self._parts: dict[str, bytes] = {}  # other strings that are encoded by themselves
        self._part_chars = 0

    def _age(self) -> None:
        """Forget what was not asked for since the last time, where the memory is half full."""
        later = self._later
        if 2 * len(later) > MEMO_PIECES or 2 * later.chars > MEMO_CHARS:
            later.older = {}
            self._later = _Pieces(self._learn, later)
        if 2 * len(self._parts) > MEMO_PIECES or 2 * self._part_chars > MEMO_CHARS:
            self._parts, self._part_chars = {}, 0

    def _ids(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, "<u4").tobytes()

    def _token(self, part: str) -> bytes:
        """The ids of one pre-token."""
        if part.isascii():
            return self._joined(part.replace(" ", self._space))
        return self._joined(part.encode().decode("latin-1").translate(self._letters))

    def _joined(self, seen: str) -> bytes:
        """The ids of one pre-token in the model's own letters."""
        packed = self._packed
        return b"".join([packed[token.id] for token in self._model.tokenize(seen)])

    def _part(self, part: str) -> bytes:
        if part.startswith(" ") and _letters(part[1:]):
            return self._later[part[1:]]
        known = self._parts.get(part)
        if known is None:
            one = _letters(part) or not part.strip(string.punctuation)
            known = self._parts[part] = self._token(part) if one else self._ids(part)
            self._part_chars += len(part)
        return known

    def _learn(self, piece: str) -> bytes | None:
        """The ids of a piece after a space, or of one that begins with a line break."""
        if piece.isalpha():
            if piece.isascii():
                return self._joined(self._space + piece)
            if _letters(piece):
                return self._token(" " + piece)
        stem = piece.rstrip(string.punctuation)
        if stem.isalpha() and _letters(stem):
            tail = piece[len(stem) :]
            return self._later[stem] + (self._parts.get(tail) or self._part(tail))
        if piece.startswith("\n"):
            rest = self._alone(piece[1:], "")
            return None if rest is None else self._part("\n") + rest
        return self._alone(piece, " ")

    def _alone(self, piece: str, lead: str) -> bytes | None:
        """The ids of a piece by its parts; None for one that can't stand alone."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return b"".join(map(self._part, _parts_of(piece, lead)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; of an empty one none."""
        return list(self.each(texts))

    def each(self, texts: list[str], together: int | None = None) -> Iterator[bytes]:
        """The ids of text after text; up to ``together`` characters are encoded ahead.

        Python's cycle collector rests meanwhile: it would walk what is remembered again and
        again, and none of that is part of a cycle.
        """
        for a, b in slices(map(len, texts), together or TOGETHER):
            collecting = gc.isenabled()
            gc.disable()
            try:
                found = self._encode(texts[a:b])
            finally:
                self._age()
                if collecting:
                    gc.enable()
            yield from found

    def _encode(self, texts: list[str]) -> list[bytes]:
        raw = [text.encode() for text in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        spaces, breaks = data == 32, data == 10  # what follows a line break is a piece that begins with it
        for k, text in enumerate(texts):
            if "\n" in text and ("\n\n" in text or "\r" in text or "<|" in text):
                breaks[starts[k] : ends[k]] &= np.roll(spaces[starts[k] : ends[k]], 1)
        begins = spaces | breaks
        begins[starts[sizes > 0]] = True
        at = np.append(np.flatnonzero(begins), len(data))
        pieces = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(joined)).dictionary_encode()
        different, later = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), self._later
        known = [later[p[1:]] if p[0] == " " else later[p] if p[0] == "\n" else self._alone(p, "") for p in different]
        ids = pa.array(known, pa.large_binary()).take(pieces.indices)
        found, places = self._cut(ids, np.searchsorted(at, ends))
        if places.size:  # pieces that can't stand alone
            for k in np.unique(np.searchsorted(ends, at[places], "right")).tolist():
                found[k] = self._ids(texts[k])
        return found

    @staticmethod
    def _cut(ids: pa.LargeBinaryArray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The ids of the pieces up to each of ``ends``, and the places of pieces without any."""
        missing = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)) if ids.null_count else np.zeros(0, np.int64)
        _, offsets, data = ids.buffers()
        if data is None:
            return [b""] * len(ends), missing
        bounds = np.frombuffer(offsets, np.int64)[ends].tolist()
        view = memoryview(data)
        return [view[a:b].tobytes() for a, b in pairwise([0, *bounds])], missing


def _letters(part: str) -> bool:
    """If it holds letters only, whatever the version of Unicode."""
    return part.isalpha() and (part.isascii() or max(part) < _STABLE)


def _parts_of(piece: str, lead: str) -> list[str]:
    """Parts of a piece that are encoded by themselves; letters stop where Unicode versions may differ."""
    if "<|" in piece or _ODD_SPACE.search(piece):
        return [lead + piece]
    out = []
    for k, line in enumerate(piece.split("\n")):
        if k:
            out.append("\n")
            lead = ""
        stem = line.rstrip(string.punctuation)
        if len(stem) < len(line) and _letters(stem):
            out += [lead + stem, line[len(stem) :]]
        else:
            out.append(lead + line)
    return out


@cache
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder for all tasks of a Python worker, as its vocabulary takes long to load."""
    return Encoder(path)


@cache
def sentence_tables(path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """By id: if the token ends a sentence, and if a token may begin the next one.

    A sentence ends after a line break, or after ``.``, ``!`` or ``?`` with white space
    to follow.
    """
    tokenizer = Tokenizer.from_file(path)
    texts = tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size())], skip_special_tokens=False)
    ends = np.array([t.rstrip("\"')]").endswith((".", "!", "?")) for t in texts])
    breaks = np.array([t.endswith("\n") for t in texts])
    spaced = np.array([t[:1].isspace() for t in texts])
    return ends.astype(np.int8) + 2 * breaks, spaced
