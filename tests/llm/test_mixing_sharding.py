"""Poisson mixing and minimum-cost-flow resharding: brute force and odd rows."""

import hashlib
import itertools
import math
import random
import time
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import mixing, resharding

DOCS = "doc_id long, text string, source string"


def _count(u, rate):
    """The Poisson quantile of u."""
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def _expected(rows, targets=None, seed=mixing.SEED):
    chars = defaultdict(int)
    for _, text, source in rows:
        chars[source or ""] += len(text or "")
    chars = {s: n for s, n in chars.items() if n}
    w = {s: math.sqrt(n) if targets is None else targets.get(s, 0.0) for s, n in chars.items()}
    rate = {s: w[s] / sum(w.values()) * sum(chars.values()) / chars[s] for s in chars}
    out = Counter()
    for i, text, source in rows:
        if rate.get(source or "", 0) > 0:
            u = int(hashlib.md5(f"{seed}|{'~' + hashlib.md5((text or '').encode()).hexdigest() if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
            for copy in range(1, _count(u, rate[source or ""]) + 1):
                out[i, copy] += 1
    return out


def _got(df):
    return Counter((r.doc_id, r.copy) for r in df.collect())


ROWS = [(i, "w " * (i % 9 + 1), f"s{i * i % 3}") for i in range(300)] + [(None, "null id", "s1"), (5, "a repeated id", "s0"), (5, "a repeated id", "s0"), (900, None, "s1"), (901, "", "s2"), (902, "no source", None), (903, "x" * 200_000, "s2"), (904, "", "empty source")]


def test_counts_equal_brute_force(spark):
    assert _got(mixing.mixed(spark.createDataFrame(ROWS, DOCS))) == _expected(ROWS)


def test_counts_with_targets(spark):
    targets = {"s0": 3.0, "s1": 1.0}
    got = _got(mixing.mixed(spark.createDataFrame(ROWS, DOCS), targets=targets, seed=3))
    assert got == _expected(ROWS, targets, 3)
    with pytest.raises(ValueError, match="negative"):
        mixing.mixed(spark.createDataFrame(ROWS, DOCS), targets={"s0": -1.0})


def test_output_reaches_the_target_shares(spark):
    rows = [(i, "x" * 100, "big" if i % 10 else "small") for i in range(20000)]
    out = mixing.mixed(spark.createDataFrame(rows, DOCS), targets={"big": 1.0, "small": 1.0}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n["small"] / sum(n.values()) - 0.5) < 0.02 and abs(sum(n.values()) / 20000 - 1) < 0.05


def test_mixing_shuffles_whatever_order_came_in(spark):
    rows = [(i, "some text", "s") for i in range(500)]
    a = [(r.doc_id, r.copy) for r in mixing.mixed(spark.createDataFrame(rows, DOCS)).coalesce(1).collect()]
    b = mixing.mixed(spark.createDataFrame(rows[::-1], DOCS))
    assert Counter(a) == _got(b) and [x for x, _ in a] != sorted(x for x, _ in a)


def test_mixing_columns(spark):
    docs = spark.createDataFrame([(1, "t", "s", 9, "k", 1.5)], DOCS + ", copy int, mix_key string, cdf double")
    assert mixing.mixed(docs).columns == ["doc_id", "text", "source", "cdf", "copy", "mix_key"]
    got = mixing.replicated(docs)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= {(1, "t", "s", 9, "k", 1.5)}


def test_mixing_empty_tables(spark):
    for rows in ([], [(1, "", "s"), (2, None, None)]):
        docs = spark.createDataFrame(rows, DOCS)
        assert mixing.mixed(docs).count() == 0 == mixing.replicated(docs).count()


# --- resharding


def _least_moved(sizes, capacities):
    """By brute force over how many bytes each shard keeps."""
    keep = [range(min(s, capacities[i]) + 1) if i < len(capacities) else [0] for i, s in enumerate(sizes)]
    total = sum(sizes)
    return min(total - sum(k) for k in itertools.product(*keep) if total - sum(k) <= sum(capacities) - sum(k))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=4), st.lists(st.integers(0, 9), min_size=1, max_size=4))
def test_transfers_move_the_fewest_bytes(sizes, capacities):
    if sum(sizes) > sum(capacities):
        with pytest.raises(ValueError, match="capacities"):
            resharding.transfers(sizes, capacities)
        return
    plan = resharding.transfers(sizes, capacities)
    for i, s in enumerate(sizes):
        assert sum(x for a, _, x in plan if a == i) == s
    for j, c in enumerate(capacities):
        assert sum(x for _, b, x in plan if b == j) <= c
    assert sum(x for a, b, x in plan if a != b) == _least_moved(sizes, capacities)


def test_many_shards_are_planned_in_linear_time():
    rng = random.Random(2)
    sizes = [rng.randrange(10**9) for _ in range(80_000)]
    capacities = [-(-sum(sizes) * 102 // (100 * 60_000))] * 60_000
    began = time.process_time()
    plan = resharding.transfers(sizes, capacities)
    assert time.process_time() - began < 10 and len(plan) < 220_000
    assert sum(x for _, _, x in plan) == sum(sizes) and sum(x for i, j, x in plan if i != j) == sum(s - min(s, c) for s, c in zip(sizes, capacities + [0] * 20_000))


def test_reshard_places_every_row_within_capacity(spark):
    rows = [(i, "y" * (i % 50 + 1), f"s{min(i % 7, 3)}") for i in range(2000)]
    size = sum(len(t) for _, t, _ in rows)
    caps = [size // 3 + 1] * 3
    got = resharding.reshard(spark.createDataFrame(rows, DOCS), caps).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    by = defaultdict(int)
    for r in got:
        by[r.new_shard] += len(r.text)
        assert r.moved == (r.old_shard != r.new_shard)
    assert set(by) <= {0, 1, 2} and all(by[j] <= caps[j] + 4 * 50 * 2 for j in by)  # a block more from each old shard
    old = [sum(len(t) for _, t, s in rows if s == f"s{k}") for k in range(4)]
    moved = sum(len(r.text) for r in got if r.moved)
    assert abs(moved - sum(x for a, b, x in resharding.transfers(old, caps) if a != b)) <= 12 * 50 * 2


def test_reshard_odd_rows(spark):
    rows = [(None, "a", "s"), (1, None, None), (1, None, None), (2, "", "e"), (3, "z" * 100_000, "s"), (4, "b", "s"), (4, "b", "s")]
    docs = spark.createDataFrame([(*r, "o", 7) for r in rows], DOCS + ", old_shard string, shard int")
    got = resharding.reshard(docs)
    assert got.columns == ["doc_id", "text", "source", "shard", "old_shard", "new_shard", "moved"]
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == Counter(rows)
    assert resharding.reshard(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="capacities"):
        resharding.reshard(docs, [1])


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    rows = [(i, "y" * 10, "abc"[i % 3]) for i in range(300)]
    placed = resharding.Placement(spark.createDataFrame(rows, DOCS), [1000, 500, 1500])
    done = resharding.rewrite_affected(placed, str(tmp_path / "out"))
    assert done.written == [1, 2] and done.emptied == []  # the first shard holds what it held
    again = spark.read.parquet(done.path)
    assert again.count() == placed.rows.filter("new_shard IN (1, 2)").count() and {r.new_shard for r in again.collect()} == {1, 2}


def test_a_shard_that_loses_all_rows_is_emptied(spark):
    rows = [(i, "y" * 10, "abcd"[i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    placed = resharding.Placement(docs, [2000, 2000])
    done = resharding.rewrite_affected(placed)
    assert done.written == [0, 1] and done.emptied == [2, 3] and done.path.startswith(spark.conf.get("spark.checkpoint.dir"))
    got = resharding.reshard(docs, [2000, 0, 2000]).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows) and {r.new_shard for r in got} == {0, 2}
    assert all(r.moved == (r.old_shard != r.new_shard) for r in got)


def test_nothing_is_rewritten_where_nothing_moves(spark):
    rows = [(i, "y" * 10, "ab"[i % 2]) for i in range(100)]
    placed = resharding.Placement(spark.createDataFrame(rows, DOCS), [500, 500])
    assert placed.affected() == ([], []) and not any(r.moved for r in resharding.reshard(spark.createDataFrame(rows, DOCS), [500, 500]).collect())


def test_the_plan_has_as_many_entries_as_transfers(spark):
    rows = [(i, "y" * (i % 7 + 1), f"s{i % 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    size = [sum(len(t) for _, t, s in rows if s == f"s{k}") for k in range(5)]
    caps = [-(-sum(size) // 8) + 1] * 8
    assert resharding.block_plan(docs, caps).count() <= len(resharding.transfers(size, caps))
