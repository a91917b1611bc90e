"""Top-k search against brute force, and what the tree prunes."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkbase.llm import topk

SCHEMA = "id long, vector array<float>"


def slow_top_k(vectors, asked, k, scale=1024):
    """(query id, rank, id, score) of the rows whose numbers are asked; every row but the query's own is a candidate."""
    whole = {n: (i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(vectors) if v and all(x is not None and np.isfinite(x) for x in v)}
    out = Counter()
    for n in asked:
        if n in whole:
            q = whole[n][1]
            scores = [(-sum(a * b for a, b in zip(q, v, strict=True)), i is None, i or 0, i) for m, (i, v) in whole.items() if m != n and len(v) == len(q)]
            out.update((whole[n][0], r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k]))
    return out


def clustered(n, dims=8, centres=4, spread=0.2, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return [(i, [float(np.float32(x)) for x in middle[i % centres] + spread * rng.normal(size=dims)]) for i in range(n)]


ODD = [(10_000, None), (10_001, []), (10_002, [1.0, None] + [0.0] * 6), (10_003, [float("nan")] * 8), (10_004, [float("inf")] * 8), (10_010, [1.0, 2.0]), (10_020, [1.0, 2.5])]
SMALL = {"block": 20, "group": 4, "leaf": 4, "fan": 3}


@pytest.mark.parametrize(
    ("n", "k", "config"),
    [(300, 10, {}), (150, 3, SMALL), (150, 3, SMALL | {"sent_centres": 0, "rows_of_task": 30, "sent_nodes": 0, "groups_of_task": 1}), (5, 10, {"leaf": 1})],
)
def test_search(spark, n, k, config):
    rows = clustered(n, seed=n) + ODD
    rows += [(n + i, rows[0][1]) for i in range(25)]  # ties
    rows += [(0, rows[0][1]), (0, rows[1][1]), (None, rows[0][1]), (None, rows[3][1]), (20, rows[20 % n][1])]  # repeated and null ids
    df = spark.createDataFrame(rows, SCHEMA)
    found = topk.top_k(df.withColumns({c: F.lit("mine") for c in ("row", "kind", "node", "v", "x", "y", "score")}), F.col("id") % 10 == 0, topk.TopKConfig(k=k, **config)).collect()
    assert Counter(map(tuple, found)) == slow_top_k(rows, [m for m, (i, _) in enumerate(rows) if i is not None and i % 10 == 0], k)


def test_queries_of_another_table(spark):
    rows, asked = clustered(120), [(7, clustered(5, seed=9)[3][1]), (7, clustered(120)[7][1]), (None, clustered(120)[9][1])]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, SCHEMA), topk.TopKConfig(k=4, **SMALL)).collect()
    both = rows + asked
    want = Counter()
    for m in range(120, 123):
        want += slow_top_k(rows + [both[m]], [120], 4)
    assert Counter(map(tuple, found)) == want


def test_a_vector_that_most_rows_hold(spark):
    rows = clustered(60) + [(1000 + i, clustered(60)[5][1]) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = topk.candidates_and_questions(topk.numbered(df, F.col("id") % 100 == 0, 1024), 3)
    assert kept.filter("kind = 1").count() == 60 + 3 and kept.filter("kind = 2").count() == 2
    found = topk.top_k(df, F.col("id") % 100 == 0, topk.TopKConfig(k=3, **SMALL)).collect()
    assert Counter(map(tuple, found)) == slow_top_k(rows, [m for m, (i, _) in enumerate(rows) if i % 100 == 0], 3)


def test_large_components_are_exact(spark):
    rows = [(i, [float((i * 7919 % 91 - 45) * 2.0**24 + i), float(i % 7) * 2.0**20]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found = topk.top_k(df, F.col("id") % 5 == 0, topk.TopKConfig(k=3, scale=1, **(SMALL | {"block": 8}))).collect()
    whole = [[int(x) for x in v] for _, v in rows]
    for q in range(0, 40, 5):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q)[:3]
        assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == [(i, -s) for s, i in scores]


def test_the_tree_covers_and_prunes(spark):
    """Unit vectors in clusters, so that the best candidates of a query are near it."""
    rows = []
    for i, v in clustered(3000, dims=4, centres=30, spread=0.02, seed=5):
        norm = sum(x * x for x in v) ** 0.5
        rows.append((i, [x / norm for x in v]))
    config = topk.TopKConfig(k=3, block=100, group=10, leaf=16, fan=8)
    numbered = topk.numbered(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0, 1024)
    tree = topk.build(topk.candidates_and_questions(numbered, 3), config)
    assert tree.depth > 1
    nodes = {r.node: r for r in tree.nodes.collect()}
    for r in tree.rows.collect():
        node = r.node
        while node is not None:
            own = nodes[node]
            far = float(np.sqrt(((np.array(r.v) - np.array(own.centre)) ** 2).sum()))
            # A node's radius is that of the rows given to it; they stay below it.
            assert far <= (own.r_data if r.kind == topk.DATA else own.r_query)
            node = own.parent
    plan = topk.plan_search(numbered, config)
    pairs, groups, blocks = plan.first.count() + plan.left.count(), plan.groups.count(), plan.blocks.count()
    assert pairs < groups * blocks / 3
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0, config).collect()
    assert Counter(map(tuple, found)) == slow_top_k(rows, range(0, 3000, 20), 3)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(df, F.col("id") % 100 == 0).count() == topk.top_k(df, df).count() == 0
    one = spark.createDataFrame([(100, [1.0, 2.0])], SCHEMA)
    assert topk.top_k(one, F.col("id") % 100 == 0).count() == 0
    assert topk.top_k(one, one).collect() == [(100, 1, 100, 1024 * 1024 * 5)]
