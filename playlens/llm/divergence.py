"""How far the sources of a language are from each other and from the language, term by term.

Terms are told apart only by how often they occur: all terms with the same count in a group
and in its language form a cell, share their scaled frequencies and so their difference.
Cells are ranked by that difference with the number of terms before them, and only cells
that reach the report are turned into terms again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.llm.common import UPPER, written

#: Bytes of a text that are split at once, and terms and documents that a task counts before it hands them on.
PIECE, COUNTED = 1 << 20, 200_000
#: Terms at least in a tile of the pairwise sums, and sources on one side of it.
TILE_TERMS, TILE_SOURCES = 4096, 1024
#: What a frequency is scaled by, and what is added to every count.
SCALE, ADDED = 1_000_000_000, 5

# Letters of ASCII in lower case, bytes of longer characters as they are, all else white space.
_TERM_BYTES = bytes(
    ord(c.lower()) if c.isascii() and c.isalpha() else b if b >= 0x80 else 0x20 for b, c in ((b, chr(b)) for b in range(256))
)


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in lower case, a piece of it at a time."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and _TERM_BYTES[data[end]] != 0x20:
            end += 1
        yield data[at:end].translate(_TERM_BYTES).split()
        at = end


def _counted(documents: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` from every task: occurrences, and documents that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (total, docs) in found.items():
                words = pa.array(list(total), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(words), pa.string()),
                        pa.array([source] * len(words), pa.string()),
                        words.cast(pa.string()),
                        pa.array(total.values(), pa.int64()),
                        pa.array([docs[w] for w in total], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
            found.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary() if batch.schema.field(2).type == pa.string() else pa.large_binary())
            for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
                total, docs = found.setdefault((lang, source), (Counter(), Counter()))
                own: Counter = Counter()
                for words in terms(texts[i].as_py()):
                    own.update(words)
                before = len(total)
                total.update(own)
                docs.update(own.keys())
                size += len(total) - before
                if size >= COUNTED:
                    yield from flush()
                    size = 0
        yield from flush()

    return documents.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _scaled(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), exact for every count."""
    above = (count + F.lit(ADDED)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + F.lit(ADDED) * kept).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _scaled_rows(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same of an array of counts."""
    below = total + ADDED * kept
    if len(counts) and int(counts.max()) + ADDED > np.iinfo(np.int64).max // SCALE:
        return np.array([1 + SCALE * (int(c) + ADDED) // below for c in counts], np.int64)
    return 1 + SCALE * (counts + ADDED) // below


def _tile(rows: pa.Table, own: pa.Table) -> pa.Table:
    """Sums of abs(p - q) over the terms of a tile, for pairs of its left and right sources.

    ``rows`` has a term's sources (numbers ``js``) and counts (``ns``), ``own`` the sources of
    either side with their totals.
    """
    side, place, totals = (own.column(f"own_{c}").to_numpy() for c in ("side", "j", "total"))
    kept = own.column("own_kept")[0].as_py()
    js, ns = (rows.column(c).combine_chunks() for c in ("js", "ns"))
    term = np.repeat(np.arange(rows.num_rows), np.diff(js.offsets.to_numpy()))
    js, ns = js.flatten().to_numpy(), ns.flatten().to_numpy()
    dense = []
    for k in (0, 1):
        mine = np.flatnonzero(side == k)
        mine = mine[np.argsort(place[mine])]
        block = np.empty((len(mine), rows.num_rows), np.int64)
        column = np.searchsorted(place[mine], js)
        column[column == len(mine)] = 0
        here = place[mine][column] == js
        order = np.argsort(column[here], kind="stable")
        at, which, n = column[here][order], term[here][order], ns[here][order]
        ends = np.searchsorted(at, np.arange(len(mine) + 1))
        for i, total in enumerate(totals[mine].tolist()):
            block[i] = _scaled_rows(np.zeros(1, np.int64), total, kept)[0] if kept else 0
            block[i, which[ends[i] : ends[i + 1]]] = _scaled_rows(n[ends[i] : ends[i + 1]], total, kept)
        dense.append((place[mine], block))
    (left, p), (right, q) = dense
    value = np.array([np.abs(q - one).sum(1) for one in p]).reshape(len(left), len(right))
    a, b = np.meshgrid(left, right, indexing="ij")
    pick = (a < b).ravel()
    out = {"a": a.ravel()[pick], "b": b.ravel()[pick], "value": value.ravel()[pick]}
    langs = pa.array([own.column("own_lang")[0].as_py()] * int(pick.sum()), pa.string())
    return pa.table({"lang": langs, **{k: pa.array(v, pa.int64()) for k, v in out.items()}})


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, in both orders.

    Kept terms of a language are dealt to buckets of some thousand, and its sources to blocks; a tile
    has the terms of a bucket and one or two blocks, absent terms filled in.  Tiles give one sum per pair of sources.
    """
    blocks = groups.withColumn("block", F.floor(F.col("j") / TILE_SOURCES))
    # As many terms to a bucket as there are sources: sums of pairs are then no more than entries.
    most = F.greatest(F.lit(TILE_TERMS), F.max("j") + 1)
    shape = blocks.groupBy("lang").agg(
        F.max("block").alias("last"), F.greatest(F.lit(1), F.ceil(F.max("kept") / most)).cast("long").alias("buckets")
    )
    tiles = (
        shape.withColumn("left", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        .withColumn("right", F.explode(F.sequence("left", "last")))
        .select("lang", "left", "right", "buckets")
    )
    own = tiles.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))).select(
        "lang", "left", "right", "bucket", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    )
    own = own.withColumn("block", F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right")))
    own = own.join(blocks.select("lang", "block", "j", "total", "kept"), ["lang", "block"])
    own = own.select(*(F.col(c).alias(f"own_{c}") for c in own.columns))
    rows = kept.join(F.broadcast(tiles), "lang").select(  # a row per language and pair of blocks
        "lang", "left", "right", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), "js", "ns"
    )
    keys = ["lang", "left", "right", "bucket"]
    sums = (
        rows.groupBy(*keys)
        .cogroup(own.groupBy(*(f"own_{k}" for k in keys)))
        .applyInArrow(_tile, "lang string, a long, b long, value long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    one, other = (groups.select("lang", F.col("j").alias(k), F.col("source").alias(f"source_{k}")) for k in ("a", "b"))
    named = sums.join(one, ["lang", "a"]).join(other, ["lang", "b"])
    return named.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").unionAll(
        named.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value")
    )


def _top_terms(entries: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """``lang, source, item, value, rank`` of the terms most over their language's frequency."""
    group = ["lang", "source"]
    cells = entries.groupBy(*group, "n", "lang_n").agg(F.count("*").alias("terms"))
    p = _scaled(F.col("n"), F.col("total"), F.col("kept"))
    q = _scaled(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    over = cells.join(groups, group).withColumn("value", p - q).filter("value > 0")
    # Every value stands for a term at least, so the first ``top`` values of a group are enough.
    falling = Window.partitionBy(*group).orderBy(F.desc("value"))
    values = over.groupBy(*group, "value").agg(F.sum("terms").alias("terms"))
    values = values.withColumn("place", F.row_number().over(falling)).filter(F.col("place") <= top)
    before = F.sum("terms").over(falling.rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < top)
    chosen = over.join(values.select(*group, "value", "before"), [*group, "value"])
    found = entries.join(chosen.select(*group, "n", "lang_n", "value", "before"), [*group, "n", "lang_n"])
    nth = F.row_number().over(Window.partitionBy(*group, "value").orderBy("term"))
    ranked = found.withColumn("nth", nth).filter(F.col("nth") <= top)
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("nth")).cast("int")).filter(F.col("rank") <= top)
    return ranked.select(*group, F.col("term").alias("item"), "value", "rank")


def audit(
    documents: DataFrame,
    *,
    least_docs: int = 30,
    top: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: what tells the sources of a language apart.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z in lower case.  A language keeps
    the ``V`` terms that at least ``least_docs`` of its documents hold.  With ``N`` occurrences of kept
    terms, a group or language gives a term that occurs ``count`` times there
    ``p = 1 + floor(10**9 * (count + 5) / (N + 5 V))``.

    Part ``pair`` has every other source of the language, with the sum of ``abs(p - q)`` over all
    kept terms (0 without any); part ``term`` the up to ``top`` terms that occur in the group and
    are more frequent there than in the language, with ``p - q``.  Ranks start at 1 in every group and part; equal values
    follow each other by the UTF-8 bytes of the item, so ranks don't tie.

    A null text, language or source is an empty one.  Every row is a document, also a repeated
    one.  A group without terms has its pairs; an empty table gives no rows.  Long texts are split
    in pieces.  Other columns are left out, whatever their names.

    A task counts its own documents before anything is shuffled, so a frequent term is a row
    per task, source and language.  A language's sources lie in one row per term: their number bounds
    it, as its square is that of the result.
    """
    given = documents.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text")))
    )
    group = ["lang", "source"]
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    known = written(given.select(*group).distinct().withColumn("j", number.cast("long")), "audit-groups")
    counts = _counted(given).groupBy(*group, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entry = F.struct("j", "n")
    by_term = counts.join(known, group).groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(entry).alias("entries")
    )
    kept = written(
        by_term.filter(F.col("docs") >= least_docs).select(
            "lang", "term", "lang_n", F.col("entries.j").alias("js"), F.col("entries.n").alias("ns")
        ),
        "audit-terms",
    )
    pairs = F.explode(F.arrays_zip("js", "ns")).alias("e")
    spread = kept.select("lang", "term", "lang_n", pairs).select(
        "lang", "term", "lang_n", F.col("e.js").alias("j"), F.col("e.ns").alias("n")
    )
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = spread.groupBy("lang", "j").agg(F.sum("n").alias("total"))
    groups = known.join(totals, ["lang", "j"], "left").join(langs, "lang", "left")
    groups = written(groups.na.fill(0, ["total", "kept", "lang_total"]), "audit-totals")
    entries = spread.join(groups.select("lang", "j", "source"), ["lang", "j"])
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    pair = _pairs(kept, groups).withColumn("rank", F.row_number().over(order).cast("int"))
    term = _top_terms(entries, groups, top)
    columns = ["lang", "source", F.col("part"), "item", F.col("value").cast("long").alias("value"), "rank"]
    return pair.withColumn("part", F.lit("pair")).select(*columns).unionAll(
        term.withColumn("part", F.lit("term")).select(*columns)
    )


#: The audit of ``documents`` as DuckDB SQL, with the values above.
AUDIT_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, CAST(sum(c) AS HUGEINT) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (
  SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS total
  FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
filled AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS n,
         1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.c, 0) + {ADDED}) // (CAST(s.total AS HUGEINT) + {ADDED} * l.v) AS p,
         1 + CAST({SCALE} AS HUGEINT) * (k.c + {ADDED}) // (l.total + {ADDED} * l.v) AS q
  FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM filled a JOIN filled b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM filled WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR place <= 50"""
