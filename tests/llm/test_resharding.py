"""Resharding: the flow against all ways, the files against the documents."""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from playlens.llm import resharding

SMALL = "/root/testdata/sf0.001"


def _least_cost(sizes, capacities, cost):
    """By trying every way to send each unit."""
    units = [i for i, s in enumerate(sizes) for _ in range(s)]
    best = None
    for goals in product(range(len(capacities)), repeat=len(units)):
        if all(goals.count(j) == c for j, c in enumerate(capacities)):
            paid = sum(cost[i][j] for i, j in zip(units, goals, strict=True))
            best = paid if best is None else min(best, paid)
    return best


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_flow_costs_least(data):
    sizes = data.draw(st.lists(st.integers(0, 3), min_size=1, max_size=3))
    total, m = sum(sizes), data.draw(st.integers(1, 3))
    cuts = sorted(data.draw(st.lists(st.integers(0, total), min_size=m - 1, max_size=m - 1)))
    capacities = [b - a for a, b in zip([0, *cuts], [*cuts, total], strict=True)]
    cost = np.array(data.draw(st.lists(st.lists(st.integers(0, 5), min_size=m, max_size=m), min_size=len(sizes), max_size=len(sizes))))
    flow = resharding.transfers(sizes, capacities, cost)
    assert (flow >= 0).all()
    assert flow.sum(1).tolist() == sizes and flow.sum(0).tolist() == capacities
    assert int((flow * cost).sum()) == _least_cost(sizes, capacities, cost)


def test_fewest_bytes_move():
    flow = resharding.transfers([90, 10, 50, 0], [30, 30, 30, 30, 30])
    assert sum(flow[i, i] for i in range(4)) == 30 + 10 + 30
    assert resharding.transfers([5 * 10**18] * 4, [10 * 10**18] * 2).sum() == 20 * 10**18
    with pytest.raises(ValueError):
        resharding.transfers([3], [2])


def _check(rows, documents):
    """``rows`` of (id, text, size, shard, slot) hold each document once, with gapless slots."""
    assert sorted(map(repr, [r[:2] for r in rows])) == sorted(map(repr, documents))
    slots, sizes = defaultdict(list), defaultdict(int)
    for _, text, size, shard, slot in rows:
        assert size == len((text or "").encode()) + 1
        slots[shard].append(slot)
        sizes[shard] += size
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    return sizes


def test_query_keeps_all_documents_in_even_shards(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    text = {r.doc_id: (r.text or "").encode() for r in documents}
    rows = contract.corpus()["op13_resharding"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
        assert r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(sizes) == list(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) / 8
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


@pytest.fixture(scope="module")
def texts():
    copies = [(i, "the same text in a third of all rows, " * 3) for i in range(200)]
    others = [(1000 + i, f"text {i} " * (i % 37 + 1)) for i in range(380)]
    return [*copies, *others, (5, None), (None, ""), (None, None), (7, "é" * 50), (7, "é" * 50), (8, "long " * 1200)]


def test_only_affected_files_are_written(spark, texts, tmp_path):
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    frame = frame.withColumns({n: F.lit("x") for n in ("id", "size", "shard", "path", "at", "rest", "bytes")}).repartition(6)
    laid = resharding.lay_out(frame, str(tmp_path), 4)
    old = {r.path: r for r in laid.manifest.collect()}
    at_first = defaultdict(int)
    for r in old.values():
        at_first[r.shard] += r.bytes
    new = resharding.reshard(laid, [1, 1, 1, 1, 2])
    files = {r.path: r for r in new.manifest.collect()}
    kept = files.keys() & old.keys()
    assert kept and all(files[p].shard == old[p].shard for p in kept)
    found = resharding.read(new).select("id", "text", "size", "shard", "slot").collect()
    sizes = _check([tuple(r) for r in found], texts)
    goals = resharding.shares(sum(at_first.values()), [1, 1, 1, 1, 2])
    assert all(abs(sizes[j] - goal) <= 250 for j, goal in enumerate(goals) if j in sizes)
    before = {(r.id, r.text): r.shard for r in resharding.read(laid).collect()}
    moved = sum(r.size for r in found if before[r.id, r.text] != r.shard)
    fewest = sum(max(0, size - goals[i]) for i, size in at_first.items())
    assert moved <= fewest + 300
    rest = resharding.read(new).select("rest.*").columns
    assert sorted(rest) == sorted(["id", "size", "shard", "path", "at", "rest", "bytes"])


def test_again_and_fewer_shards(spark, texts, tmp_path):
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    new = resharding.balance(frame, str(tmp_path), old_shards=7, new_shards=5)
    back = resharding.reshard(new, [1, 1, 1])
    rows = [tuple(r) for r in resharding.read(back).select("id", "text", "size", "shard", "slot").collect()]
    sizes = _check(rows, texts)
    assert set(sizes) == {0, 1, 2} and max(sizes.values()) - min(sizes.values()) < 100


def test_few_and_no_documents(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [r.slot for r in resharding.read(resharding.balance(one, str(tmp_path / "one"))).collect()] == [0]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resharding.read(resharding.balance(none, str(tmp_path / "none"))).collect() == []
