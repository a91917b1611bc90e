"""Sharding, near copies, lines, mixing, secrets and search against brute force."""

import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkbase.llm import sharding, simhash
from tests.llm.conftest import prose

# ---------------------------------------------------------------- sharding


def test_shards_are_contiguous_gapless_and_balanced(documents):
    rows = sharding.assign_shards(documents, 5).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in documents.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    rows.sort(key=lambda r: (r.shard, r.slot))
    total, biggest = sum(r.size for r in rows), max(r.size for r in rows)
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    for shard, own in itertools.groupby(rows, key=lambda r: r.shard):
        own = list(own)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 5) <= biggest
    # By prefix sums: the shard of each row's middle byte.
    at = 0
    for r in rows:
        assert r.shard == (2 * at + r.size) * 5 // (2 * total)
        at += r.size


def test_one_id_for_all_rows(spark):
    df = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.assign_shards(df, 4).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [125] * 4


# ---------------------------------------------------------------- SimHash


def slow_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(max_size=80))
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode("utf-8", "replace")) == slow_fingerprint(text.encode("utf-8", "replace").decode())


@settings(max_examples=200)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), min_size=1, max_size=4))
def test_any_four_errors_leave_a_common_key(value, errors):
    other = value
    for e in errors:
        other ^= 1 << e
    keys = [set(simhash.bucket_keys(np.array([v], np.uint64).view(np.int64))[0].tolist()) for v in (value, other)]
    assert keys[0] & keys[1]


def test_golay_code_is_perfect():
    _, table = simhash.golay_tables()
    sizes = (table >= 0).sum(axis=1)
    assert Counter(sizes.tolist()) == {6: 1771, 1: 277}


def slow_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def near(seed, changes=0):
    words = prose(seed, 400).split()
    for k in range(changes):
        words[37 * (k + 1) % 400] = "changed"
    return " ".join(words)


def test_components(spark, documents):
    rows = [(1000 + i, near(900, i)) for i in range(6)] + [(2000, prose(33)), (1999, prose(33).upper())]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    local = docs.collect()
    prints = [slow_fingerprint(r.text or "") for r in local]
    roots = slow_components(prints)
    least = {}
    for r, root in zip(local, roots, strict=True):
        least[root] = min((x for x in (least.get(root), r.doc_id) if x is not None), default=None)
    want = Counter((r.doc_id, f"{p:016x}", least[root]) for r, p, root in zip(local, prints, roots, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.group(docs).collect()) == want
    kept = simhash.drop_near_copies(docs).collect()
    assert len(kept) == len(set(roots))
    assert {r.doc_id for r in kept if r.doc_id is not None} <= {v for v in least.values() if v is not None}


def test_all_kinds_of_four_errors_leave_a_common_key():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    others = values.copy()
    for i in range(len(values)):
        for b in rng.choice(64, 1 + i % 4, replace=False):
            others[i] ^= np.uint64(1) << np.uint64(b)
    held: list[dict] = []
    for prints in (values, others):
        keys, owners = simhash.bucket_keys(prints.view(np.int64))
        of: dict[int, set] = {}
        for k, o in zip(keys.tolist(), owners.tolist(), strict=True):
            of.setdefault(o, set()).add(k)
        held.append(of)
        assert len(keys) / len(prints) < 100
    for a, b in zip(values.view(np.int64).tolist(), others.view(np.int64).tolist(), strict=True):
        assert held[0][a] & held[1][b]


@pytest.mark.parametrize(("near", "far"), [(3, 40), (4, 0), (6, 30)])
def test_a_large_bucket_loses_no_link(monkeypatch, near, far):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 20)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    values = [base ^ int(sum(1 << int(b) for b in rng.choice(64, near, replace=False))) for _ in range(150)]
    values += [int(rng.integers(0, 2**62)) for _ in range(far)]
    values = np.array(sorted(set(values)), np.uint64)
    forest = simhash.Forest()
    simhash.link_runs(np.zeros(len(values), np.int64), values.view(np.int64), forest)
    signed = values.view(np.int64).tolist()
    want, got = slow_components([int(v) for v in values]), [forest.root(v) for v in signed]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def test_a_bucket_too_large_for_a_task_is_dealt_again(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    values = sorted({base ^ int(sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 7)), replace=False))) for _ in range(120)} | {int(rng.integers(0, 2**62)) for _ in range(40)})
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    monkeypatch.setattr(simhash, "HELD_BUCKET", 5)
    assert simhash.materialize(simhash.links(prints)).count()
    root = {r.node: r.root for r in simhash.components(simhash.links(prints)).collect()}
    want, got = slow_components(values), [root.get(v, v) for v in values]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def test_streamed_buckets(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 12, 300))
    prints = rng.integers(0, 1 << 10, 300) | (keys << 40)
    cuts = np.sort(rng.integers(0, 300, 25))
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(p)], ["key", "fingerprint"]) for k, p in zip(np.split(keys, cuts), np.split(prints, cuts), strict=True)]
    one = simhash.Forest()
    simhash.link_runs(keys, prints, one)
    for most in (None, 24):
        other, over = simhash.Forest(), Counter()
        for batch in simhash.meet(iter(batches), most):
            for a, b, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key is None:
                    other.join(a, b)
                else:
                    over[key] += 1
        assert over == ({} if most is None else {k: n for k, n in Counter(keys.tolist()).items() if over[k]})
        same = [p for k, p in zip(keys.tolist(), prints.tolist(), strict=True) if k not in over]
        assert [one.root(p) for p in same] == [other.root(p) for p in same]


def test_nodes_with_very_many_edges(spark, monkeypatch):
    from larkbase.llm import common

    monkeypatch.setattr(common, "SENT_KEYS", 0)
    monkeypatch.setattr(common, "ROWS_OF_TASK", 5)
    edges = [(0, i) for i in range(1, 60)] + [(59, 100 + i) for i in range(40)] + [(1000, 1001)]
    want = {b: 0 for _, b in edges} | {1001: 1000}
    assert dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    docs = spark.createDataFrame([(i, "the same text of all" if i % 3 else near(i)) for i in range(60)], "doc_id long, text string")
    rows = simhash.group(docs).collect()
    assert len(rows) == 60 and {r.component_id for r in rows if r.doc_id % 3} == {1}


def test_long_chains_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert dict(map(tuple, simhash.components(edges).collect())) == {**{i: 0 for i in range(1, 61)}, 101: 100}


# ---------------------------------------------------------------- odd tables


@pytest.mark.parametrize("operator", [sharding.assign_shards, simhash.group, simhash.drop_near_copies])
def test_odd_tables(operator, clashing, empty):
    operator(clashing).collect()
    assert operator(empty).count() == 0
