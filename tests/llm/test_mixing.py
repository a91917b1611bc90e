"""Raking and sampling against plain iterative proportional fitting."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkbase.llm import common, mixing

CELLS = "source string, lang string, topic string, tokens long, cell string, n long"


def table_of(spark, cells):
    rows = [(c.source, c.lang, c.topic, c.tokens, f"{c.source}/{c.lang}/{c.topic}", 1) for c in cells.itertuples()]
    return mixing.materialize(spark.createDataFrame(rows, CELLS))


def plain_ipf(cells, config, rounds=3000):
    """Probabilities of capped raking by dictionaries, and the share kept, from the definition."""
    rows = [{d: None if pd.isna(r[d]) else r[d] for d in mixing.DIMENSIONS} | {"tokens": r["tokens"]} for _, r in cells.iterrows()]
    whole = sum(r["tokens"] for r in rows)
    targets, factor, size = {}, {}, config.keep
    for d in mixing.DIMENSIONS:
        totals = Counter()
        for r in rows:
            totals[r[d]] += r["tokens"]
        raw = {k: config.targets[d].get(k, 0.0) if d in config.targets else v ** config.temper[d] for k, v in totals.items()}
        for k, v in totals.items():
            targets[d, k], factor[d, k] = raw[k] / sum(raw.values()), 1.0
            if raw[k]:
                size = min(size, v / whole / targets[d, k])
    chance = lambda r: min(1.0, factor["source", r["source"]] * factor["lang", r["lang"]] * factor["topic", r["topic"]])
    for _ in range(rounds):
        worst = 0.0
        for (d, k), want in targets.items():
            now = sum(r["tokens"] * chance(r) for r in rows if r[d] == k) / whole
            worst = max(worst, abs(now - want * size))
            factor[d, k] *= want * size / now if now else 0.0
        if worst < 1e-9:
            return np.array([chance(r) for r in rows]), size
    return None, size


def random_cells(seed, zero=0.0):
    rng = np.random.default_rng(seed)
    rows = [(s, lang, t, int(rng.integers(50, 1000))) for s in "abc" for lang in ("x", None) for t in "pq" if rng.random() >= zero]
    return pd.DataFrame(rows, columns=["source", "lang", "topic", "tokens"])


@pytest.mark.parametrize(("seed", "keep"), [(1, 0.3), (2, 0.7), (3, 0.95)])
def test_raking_is_iterative_proportional_fitting(spark, seed, keep):
    cells = random_cells(seed)
    config = mixing.MixConfig(keep=keep, tolerance=1e-10, rounds=3000, targets={"topic": {"p": 0.55, "q": 0.45}})
    want, size = plain_ipf(cells, config)
    got, kept = mixing.rake(cells, config)
    assert want is not None and kept == pytest.approx(size)
    assert got == pytest.approx(want, abs=1e-6)
    found = {r.cell: r.probability for r in mixing.rake_in_spark(table_of(spark, cells), mixing.MixConfig(keep=keep, rounds=12, attempts=1, targets=config.targets)).collect()}
    there = mixing.rake(cells, mixing.MixConfig(keep=keep, rounds=12, attempts=1, targets=config.targets))[0]
    assert [found[f"{c.source}/{c.lang}/{c.topic}"] for c in cells.itertuples()] == pytest.approx(there, abs=1e-9)


@pytest.mark.parametrize("keep", [0.2, 0.8, 1.0])
def test_all_targets_are_met_within_the_tolerance(keep):
    for seed in range(8):
        cells = random_cells(seed, 0.15)
        config = mixing.MixConfig(keep=keep, targets={"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"x": 0.6, None: 0.4}}, rounds=2000)
        p, kept = mixing.rake(cells, config)
        assert ((p >= 0) & (p <= 1)).all() and kept <= keep
        expected, whole = cells["tokens"] * p, cells["tokens"].sum()
        for d, shares in config.targets.items():
            held = cells.groupby(d, dropna=False)["tokens"].sum()
            for v, share in shares.items():
                mask = cells[d].isna() if v is None else cells[d] == v
                others = sum(s for k, s in shares.items() if (cells[d].isna() if k is None else cells[d] == k).any())
                if len(held) == len(shares):
                    assert expected[mask].sum() / whole == pytest.approx(share / others * kept, abs=2e-6)


def test_targets_that_cannot_be_met_are_told(spark):
    """Two sources that stand for two languages can't have other shares than these."""
    docs = spark.createDataFrame([(i, "a few words of text", "s" if i % 3 else "t", "en" if i % 3 else "de") for i in range(300)], "doc_id long, text string, source string, lang string")
    config = mixing.MixConfig(targets={"source": {"s": 0.5, "t": 0.5}, "lang": {"en": 0.9, "de": 0.1}}, rounds=20, attempts=3)
    told = {(r.dimension, r.value): r for r in mixing.marginals(mixing.assign(docs, config), config).collect()}
    assert told["lang", "en"].target == pytest.approx(0.9) and told["source", "s"].target == pytest.approx(0.5)
    assert told["source", "s"].expected == pytest.approx(told["lang", "en"].expected)
    assert max(abs(r.target - r.expected) for r in told.values()) > 0.1


def test_sampling(spark, documents, empty, clashing):
    config = mixing.MixConfig()
    rows = mixing.assign(documents)
    assert rows.count() == documents.count()
    assert rows.filter("probability IS NULL OR probability < 0 OR probability > 1").count() == 0
    again = mixing.assign(documents.repartition(3))
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, again.collect()))
    told = mixing.marginals(rows, config).collect()
    assert max(abs(r.target - r.expected) for r in told) < 1e-4
    sampled = mixing.sample(documents)
    assert sampled.columns == documents.columns
    assert Counter(r.doc_id for r in sampled.collect()) == Counter(r.doc_id for r in rows.filter("sampled").collect())
    assert mixing.assign(empty).count() == mixing.sample(empty).count() == 0


def test_columns_of_the_caller_stay(documents, clashing):
    names = ["weight", "probability", "n_tokens", "cell", "tokens", "draw", "n", "value"]
    named = clashing.withColumns({n: F.lit("mine") for n in names})
    got = mixing.sample(named)
    assert got.columns == named.columns
    assert all(r[n] == "mine" for r in got.collect() for n in names)
    plain = Counter(r.doc_id for r in mixing.sample(documents).collect())
    assert Counter(r.doc_id for r in got.collect()) == plain
    topical = documents.withColumn("topic", (F.coalesce("doc_id", F.lit(0)) % 3).cast("int"))
    kept = mixing.sample(topical)
    assert dict(kept.dtypes)["topic"] == "int" and {r.topic for r in kept.collect()} <= {0, 1, 2}
    assert {r.topic for r in mixing.assign(topical).collect()} == {"0", "1", "2"}


def test_many_cells_and_frequent_ones_give_the_same_sample(documents, monkeypatch):
    want = Counter(map(tuple, mixing.assign(documents).select("doc_id", "sampled").collect()))
    monkeypatch.setattr(common, "SENT_KEYS", 0)
    monkeypatch.setattr(common, "ROWS_OF_TASK", 3)
    assert Counter(map(tuple, mixing.assign(documents, mixing.MixConfig(driver_cells=0)).select("doc_id", "sampled").collect())) == want


def test_drawn_shares_follow_the_probabilities(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 4 == 0, "big").otherwise("small").alias("source"), F.lit("en").alias("lang"))
    config = mixing.MixConfig(keep=0.4, targets={"source": {"big": 0.5, "small": 0.5}})
    told = {r.value: r for r in mixing.marginals(mixing.assign(docs, config), config).filter("dimension = 'source'").collect()}
    assert told["big"].expected == pytest.approx(0.5, abs=1e-5) and told["big"].sampled == pytest.approx(0.5, abs=0.02)
