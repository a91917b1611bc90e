"""Widespread lines against brute force, and the runs that remember them."""

import hashlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkbase.llm import linededup
from tests.llm.conftest import prose


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def slow_lines(texts, min_docs, before=()):
    """(number of lines, lines left) of each text; `before` are texts of earlier batches."""
    split = [(t or "").split("\n") for t in texts]
    count = Counter(k for lines in [*split, *((t or "").split("\n") for t in before)] for k in {key(x) for x in lines} if k)
    return [(len(lines), [x for x in lines if count[key(x)] < min_docs]) for lines in split]


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def wanted(ids, texts, min_docs, before=()):
    return Counter((i, n, n - len(left), sha("\n".join(left))) for i, (n, left) in zip(ids, slow_lines(texts, min_docs, before), strict=True))


def found(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in df.collect())


TEXTS = [f"Common line\n{prose(i, 10)}\n  COMMON line \t\n\nÉtat {i % 5}" for i in range(12)] + ["common LINE", "x\n\x0b y", "\n\n", None, ""]
TEXTS += ["twice\ntwice"] * 3


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_LINES": 0, "BROADCAST_ROWS": 0}])
def test_lines(spark, clashing, empty, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(linededup, name, value)
    ids = [i % 9 if i % 7 else None for i in range(len(TEXTS))]
    docs = spark.createDataFrame(list(zip(ids, TEXTS, ["keep"] * len(ids), strict=True)), "doc_id long, text string, key string")
    docs = docs.withColumns({n: F.lit("mine") for n in ("line_a", "first", "at", "pos", "repeats", "n_docs")})
    got = linededup.drop_lines(docs, min_docs=3)
    assert found(got) == wanted(ids, TEXTS, 3)
    assert got.filter("key = 'keep' AND line_a = 'mine' AND at = 'mine' AND first = 'mine'").count() == len(ids)
    assert linededup.drop_lines(clashing).count() == clashing.count()
    assert linededup.drop_lines(empty).count() == 0


def test_runs_give_the_same_in_any_batches(spark):
    texts = [f"shared {i % 7}\nown {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    results = [sorted(map(tuple, linededup.drop_lines(docs, 5, batch_bits=b, fanout=f).collect())) for b, f in ((1, 2), (3, 2), (2, 3))]
    assert results[0] == results[1] == results[2]
    assert all(r[3] == 1 for r in results[0])


def test_first_text_may_keep_its_lines(spark):
    docs = spark.createDataFrame([(i, f"shared passage\nown {i}") for i in range(12)] + [(50, "shared passage\nown 3")], "doc_id long, text string")
    kept = linededup.drop_lines(docs, 10, keep_first=True).filter(F.col("text").contains("shared")).select("text").distinct()
    assert kept.count() == 1


def test_a_later_call_meets_the_runs_of_an_earlier_one(spark, tmp_path):
    store = str(tmp_path / "runs")
    batches = [[f"rare {j}\nslow {i % 4}\nown {k} {i}" for i, j in enumerate(range(k, k + 8))] for k in range(0, 20, 4)]
    before = []
    for k, texts in enumerate(batches):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = linededup.drop_lines(docs, 6, store=store, batch_bits=1)
        assert found(got) == wanted(range(len(texts)), texts, 6, before), k
        before += texts
    # A line that was widespread before is dropped everywhere later, also where its first text is kept.
    docs = spark.createDataFrame([(1, "slow 1\nnew"), (2, "slow 1\nnewer")], "doc_id long, text string")
    assert found(linededup.drop_lines(docs, 6, store=store, keep_first=True)) == wanted([1, 2], ["slow 1\nnew", "slow 1\nnewer"], 6, before)
    runs = linededup.LineRuns(spark, store, 6)
    names = [n for level in runs.levels for n in level]
    assert len(names) <= 4  # twelve batches in levels of two
    held = [r for n in names for r in runs.run(n).collect()]
    true = Counter(k for t in [*before, "slow 1\nnew", "slow 1\nnewer"] for k in {key(x) for x in t.split("\n")})
    assert len({(r.line_a, r.line_b) for r in held}) == len(true)
    assert sum(r.n_docs >= 6 for r in held) == sum(n >= 6 for n in true.values())
    runs.vacuum()
    assert {p.name for p in (tmp_path / "runs").iterdir() if p.is_dir()} == set(names)
    assert linededup.LineRuns(spark, store, 6).widespread().count() == sum(n >= 6 for n in true.values())
    with pytest.raises(ValueError):
        linededup.LineRuns(spark, store, 7)
    runs.close()


def test_runs_are_merged_without_moving_them(spark, tmp_path):
    runs = linededup.LineRuns(spark, str(tmp_path / "runs"), 3, fanout=4)
    for k in range(3):
        runs.add(spark.range(200).select((F.col("id") * 7 + k).alias("line_a"), F.col("id").alias("line_b"), F.lit(1).cast("long").alias("n_docs"), F.lit(k).cast("long").alias("first")))
    assert [len(x) for x in runs.levels] == [3]
    plan = runs.compaction(*runs.levels[0][:2])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert "Exchange" not in runs.widespread()._jdf.queryExecution().executedPlan().toString()
    runs.close()


def test_very_many_lines_in_one_text(spark):
    """The work is linear in the lines, whether they repeat, go or stay."""

    def seconds(n):
        text = "\n".join(f"line {i}" if i % 3 else "again" for i in range(n))
        docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string").repartition(1)
        start = time.perf_counter()
        got = linededup.drop_lines(docs, min_docs=4).collect()
        assert [(r.n_lines, r.n_dropped, r.text) for r in got] == [(n, n, "")] * 4
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 60
