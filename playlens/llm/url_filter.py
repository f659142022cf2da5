"""URL rules in a sorted array of 64-bit digests.

A rule is a host and a path prefix.  Its key ``host + path`` is hashed with xxh64;
the digests lie sorted in a file that every task maps into memory, next to the full
strings.  A URL probes the array with the keys it could match, all of a batch in one
binary search, and a hit counts only if the stored string is the key itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import lower_ascii, shared_file

ALLOW, BLOCK = "allow", "block"
#: Largest rule file that is copied to every executor.
MAX_BYTES = 1 << 30


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode())


def pack(rules: Iterable[Rule]) -> bytes:
    """The rule file: counts, digests, string ends, verdicts, host lengths, strings.

    Rules are sorted by digest, then by key; of rules with the same host and path the
    last one counts.
    """
    unique = {(r.host, r.path): r for r in rules}.values()
    ordered = sorted(unique, key=lambda r: (digest(r.host + r.path), r.host + r.path, r.host))
    strings = [(r.host + r.path).encode() for r in ordered]
    return b"".join(
        (
            np.array([len(ordered)], "<u8").tobytes(),
            np.array([digest(r.host + r.path) for r in ordered], "<u8").tobytes(),
            np.cumsum([0, *map(len, strings)], dtype="<u8").tobytes(),
            np.array([len(r.host.encode()) for r in ordered], "<u4").tobytes(),
            np.array([r.verdict == BLOCK for r in ordered], "u1").tobytes(),
            b"".join(strings),
        )
    )


class DigestArray:
    """A rule file mapped into memory."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, dtype="u1", mode="r")
        n = int(data[:8].view("<u8")[0])
        at = 8
        self.digests = data[at : at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = data[at : at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.host_bytes = data[at : at + 4 * n].view("<u4")
        at += 4 * n
        self.blocked = data[at : at + n]
        self.strings = data[at + n :]

    def __len__(self) -> int:
        return len(self.digests)

    def key(self, i: int) -> bytes:
        return self.strings[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def rule(self, i: int) -> tuple[str, str]:
        whole, cut = self.key(i), int(self.host_bytes[i])
        return whole[:cut].decode(), whole[cut:].decode()

    def find(self, keys: list[str], hosts: list[int]) -> np.ndarray:
        """For each key the place of the rule with that string and host length, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self) or not keys:
            return found
        wanted = np.fromiter(map(digest, keys), np.uint64, len(keys))
        first = np.searchsorted(self.digests, wanted)
        inside = np.minimum(first, len(self) - 1)
        for k in np.flatnonzero(self.digests[inside] == wanted):
            i, text = int(first[k]), keys[k].encode()
            while i < len(self) and self.digests[i] == wanted[k]:
                if self.host_bytes[i] == hosts[k] and self.key(i) == text:
                    found[k] = i
                    break
                i += 1
        return found


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _candidates(host: str, path: str, labels: list[int], lengths: list[int]) -> list[tuple[str, int]]:
    """The keys a URL can match and the bytes of their hosts, longest first."""
    parts = host.split(".")
    tails = [".".join(parts[-n:]) for n in labels if n <= len(parts)]
    keys = [(t + path[:n], len(t.encode())) for t in tails for n in lengths if n <= len(path)]
    return sorted(keys, key=lambda k: (-len(k[0]), -k[1]))


def judge(
    pages: DataFrame, rules: Iterable[Rule], *, id_col: str, url_col: str = "url", default: str = ALLOW
) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every URL.

    A rule fits its host and all subdomains if the path starts with the rule's.  The
    longest ``host + path`` wins, then the longer host.  Rows whose URL no rule fits get
    ``default`` and a null rule.

    A null URL or one without ``://`` has an empty host and path; only a rule with an
    empty host could fit it.  Ids may be null or repeat: each row gets its own result.
    Other columns are left out, whatever their names.  The rules are checked against
    ``MAX_BYTES`` before they are copied to the executors.
    """
    rules = list(rules)
    data = pack(rules)
    if len(data) > MAX_BYTES:
        raise ValueError(f"{len(data)} bytes of rules; at most {MAX_BYTES} are copied to executors")
    name = shared_file(pages.sparkSession, "rules", data)
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys, widths, owner = [], [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                for key, width in _candidates(host, path, labels, lengths):
                    keys.append(key)
                    widths.append(width)
                    owner.append(i)
            places = array.find(keys, widths)
            rule, verdict = [None] * len(hosts), [default] * len(hosts)
            for k in np.flatnonzero(places >= 0)[::-1]:  # the longest comes last and stays
                i, at = owner[k], int(places[k])
                rule[i] = "".join(array.rule(at))
                verdict[i] = BLOCK if array.blocked[at] else ALLOW
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    url = F.col(url_col)
    given = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = given.schema[id_col].dataType.simpleString()
    return given.mapInArrow(
        run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string"
    )
