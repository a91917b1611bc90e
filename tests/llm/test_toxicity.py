"""Toxicity against a plain Kneser-Ney model and held-out labels."""

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkbase.llm import toxicity
from tests.llm.conftest import prose


def toxic_corpus(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = prose(i, 50).split()
        if toxic:
            words[10 + i % 20] = ["vilefoo", "grubbax", "vilefool"][i % 3] + "."
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


# ---------------------------------------------------------------- by brute force


def key(text):
    """Of an expression or a history."""
    value = sum(ord(c) * int(f) for c, f in zip(text, toxicity.FACTORS, strict=False)) % (1 << 64)
    return value - (1 << 64) if value >> 63 else value


def d_of(counts):
    once, twice = sum(v == 1 for v in counts), sum(v == 2 for v in counts)
    return once / (once + 2 * twice) if once and twice else 0.5


PADDED = SimpleNamespace(order=toxicity.ORDER)


class Plain:
    """Both models by recursion over the definition, from lists of words by class."""

    def __init__(self, ordinary, toxic, order):
        self.order = order
        self.counts = [Counter(g for w in words for g in self.grams(w)) for words in (ordinary, toxic)]
        kinds = set(self.counts[0]) | set(self.counts[1])
        self.before = {}
        for k in range(order - 1, 0, -1):
            self.before[k] = Counter(g[1:] for g in kinds)
            kinds = set(self.before[k])
        self.letters = len(kinds)

    def grams(self, word):
        padded = "^" * (self.order - 1) + word + "$"
        return [padded[i : i + self.order] for i in range(len(word) + 1)]

    @staticmethod
    def interpolated(counts, gram, below):
        after = [n for g, n in counts.items() if g[:-1] == gram[:-1] and n]
        if not after:
            return below
        d = d_of(counts.values())
        return (max(counts[gram] - d, 0) + d * len(after) * below) / sum(after)

    def shared(self, gram):
        below = 1 / self.letters if len(gram) == 1 else self.shared(gram[1:])
        return self.interpolated(self.before[len(gram)], gram, below)

    def gain(self, gram):
        a, b = (self.interpolated(c, gram, self.shared(gram[1:])) for c in (self.counts[1], self.counts[0]))
        return math.log(a) - math.log(b)


def test_all_probabilities_agree_with_plain_kneser_ney(spark, monkeypatch):
    ordinary = [prose(i, 12) for i in range(6)] + ["ÉTÉ 12 a_b Über-mut ΑΣ", "", None]
    toxic = [prose(i, 9) + " vilefoo grubbax" for i in range(20, 23)] + ["once"]
    words = [[r for t in texts for w in (t or "").split() for r in toxicity.RUNS.findall(w.lower())] for texts in (ordinary, toxic)]
    plain = Plain(*words, toxicity.ORDER)
    texts = spark.createDataFrame([(t, 0) for t in ordinary] + [(t, 1) for t in toxic], "text string, toxic int")
    for held in (toxicity.HELD, 3):  # also where a task passes on what it holds after every few words
        monkeypatch.setattr(toxicity, "HELD", held)
        grams = toxicity.materialize(toxicity.count_expressions(texts.repartition(3)))
        assert {r.gram: (r.ordinary, r.toxic) for r in grams.collect()} == {g: (plain.counts[0][g], plain.counts[1][g]) for g in plain.counts[0] | plain.counts[1]}
    for r in toxicity.continuation_probabilities(grams).collect():
        assert r.p == pytest.approx(plain.shared(r.gram), abs=1e-12)
    seen, unseen = toxicity.log_ratios(grams)
    want = {key(g): plain.gain(g) for g in plain.counts[0] | plain.counts[1]}
    assert {r.key: pytest.approx(r.gain, abs=1e-9) for r in seen.collect()} == want
    rest = {r.key: r.gain for r in unseen.collect()}
    for h in {g[:-1] for g in plain.counts[0] | plain.counts[1]}:
        never = h + "\0"
        monkeypatch.setattr(plain, "shared", lambda gram: 0.01)
        assert rest[key(h)] == pytest.approx(plain.gain(never), abs=1e-9)


def test_probabilities_after_a_history_add_up(spark):
    grams = toxicity.materialize(toxicity.count_expressions(spark.createDataFrame([(prose(i, 30), i % 2) for i in range(8)], "text string, toxic int")))
    plain = {r.gram: r.p for r in toxicity.continuation_probabilities(grams).collect()}
    start = toxicity.PAD * (toxicity.ORDER - 2)
    assert 0 < sum(p for g, p in plain.items() if g[:-1] == start) <= 1 + 1e-9


def test_rare_expressions_count_however_many_texts_there_are(spark):
    """One toxic word in one of 3,000 texts is known to the model."""
    rows = [(prose(i % 50, 8) + f" w{i}", 0) for i in range(3000)] + [("a zzyzxword here", 1)]
    grams = toxicity.count_expressions(spark.createDataFrame(rows, "text string, toxic int"))
    assert grams.filter(F.col("gram") == "zzyzxwor").first().toxic == 1


# ---------------------------------------------------------------- scores


def test_held_out_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert len(scored) > 20
    assert all(r.predicted == r.toxic for r in scored)
    assert all(0 <= r.score <= 1 for r in scored)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 180


def test_a_model_too_large_to_send_scores_alike(spark, clashing, documents):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    large = toxicity.train(docs, labels, toxicity.ToxicityConfig(held_expressions=0))
    assert model.held and not large.held
    assert large.weights == pytest.approx(model.weights, rel=1e-9)
    more = docs.unionByName(spark.createDataFrame([(1000, "vilefoo " * 30_000), (1001, "x" * 100_000 + " vilefoo"), (1002, "vilefoo"), (1003, "-- ..."), (None, None)], docs.schema))
    for rows in (more, documents, clashing):
        one, other = (sorted((str(r.doc_id), str(r.score)[:10], r.predicted) for r in toxicity.score(rows, m).collect()) for m in (model, large))
        assert one == other and len(one) == rows.count()
        kept = [sorted(map(str, toxicity.drop_toxic(rows, m).collect())) for m in (model, large)]
        assert kept[0] == kept[1] and toxicity.drop_toxic(rows, model).columns == rows.columns


def test_features_by_definition(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    gains, unseen = ({r.key: r.gain for r in df.collect()} for df in (model.gains, model.unseen))
    for r in toxicity.with_features(docs.limit(20), model).collect():
        words = []
        for w in r.text.split():
            grams = [g for run in toxicity.RUNS.findall(w.lower()) for g in Plain.grams(PADDED, run)]
            words.append(sum(gains.get(key(g), unseen.get(key(g[:-1]), 0.0)) for g in grams))
        want = (sum(words) / len(words), sum(sorted(words)[-3:]) / 3, math.log1p(len(words)))
        assert (r.whole, r.peak, r.log_words) == pytest.approx(want, abs=1e-9)


def test_toxicity_does_not_learn_from_held_out_labels(spark):
    docs, labels = toxic_corpus(spark)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(map(tuple, toxicity.score(docs, toxicity.train(docs, x)).select("doc_id", "score").collect())) for x in (labels, flipped)]
    assert [s for s, _ in scores[0]] == [s for s, _ in scores[1]]
    assert [s for _, s in scores[0]] == pytest.approx([s for _, s in scores[1]], abs=1e-9)


def test_toxicity_without_labels_and_with_odd_rows(spark, clashing, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(clashing, none)
    assert {r.score for r in toxicity.score(clashing, model).collect()} == {0.0}
    odd = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0), (3, 1, 7), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    toxicity.score(clashing, toxicity.train(clashing, odd)).collect()
    assert toxicity.score(empty, toxicity.train(empty, odd)).count() == 0
    docs, labels = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    assert toxicity.score(empty, model).count() == toxicity.drop_toxic(empty, model).count() == 0
    named = docs.withColumns({n: F.lit("mine") for n in ("toxic", "whole", "peak", "log_words", "key", "gram", "n")})
    kept = toxicity.drop_toxic(named, model)
    assert kept.columns == named.columns and kept.filter("peak = 'mine' AND whole = 'mine'").count() == kept.count() == 180
    again = toxicity.train(named, labels)
    assert again.weights == pytest.approx(model.weights, rel=1e-9)


def test_logistic_fit_separates():
    x = np.column_stack([np.linspace(-2, 2, 40), np.zeros(40), np.ones(40)])
    y = (x[:, 0] > 0).astype(float)
    p = 1 / (1 + np.exp(-(toxicity.design(x) @ np.array(toxicity.fit_logistic(x, y)))))
    assert ((p > 0.5) == (y == 1)).all()
