"""The pipeline's stages against plain Python on a small corpus."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkbase.llm import common, simhash
from larkbase.llm.common import collect_garbage
from tests.llm.conftest import DOCUMENTS, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, labels = [], []
    for i in range(160):
        words = prose(i, 70).split()
        if i % 4 == 0:
            words[12] = "vilefoo"
        body = " ".join(words) + "\nA shared licence line of the whole corpus."
        rows.append((i, body, "en" if i % 2 else "de", "hot" if i % 3 else f"src{i % 5}", len(body)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000 + i, rows[1][1], "en", "hot", 1) for i in range(5)] + [(2000, None, None, None, None), (2001, "", "en", "hot", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, folder)
    toxic = {i for i in range(160) if i % 4 == 0}
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - toxic

    cut = stages["line_dedup"](spark, clean, folder)
    assert cut.columns == columns and cut.count() == clean.count()
    shared = cut.filter(F.col("text").contains("licence")).select("text").distinct().count()
    assert shared == 1
    assert cut.filter(F.col("n_chars") != F.length("text")).count() == 0

    single = stages["near_dedup"](spark, cut, folder)
    ids = {r.doc_id for r in single.collect()}
    assert single.columns == columns
    assert not ids & {1000, 1001, 1002, 1003, 1004} and 1 in ids
    assert len(ids & {2000, 2001}) == 1  # null and empty texts are one group

    mixed = stages["mixing"](spark, single, folder)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= ids

    tokens = stages["bpe"](spark, mixed, folder)
    assert tokens.count() == mixed.count()
    assert tokens.filter(~F.col("round_trip")).count() == 0


def test_run_is_its_stages_in_order(spark, corpus):
    folder, _ = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    once, again = (sorted((r.doc_id or -1, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert once == again and once


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_are_all_pairs_of_similarity_0_8(spark):
    import random

    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    random.seed(3)
    rows, sets = [], {}
    for i in range(60):
        words = [f"w{random.randrange(400)}" for _ in range(random.choice([8, 60, 200]))]
        for k in range(4):
            copy = list(words)
            for _ in range(k * len(words) // 60):
                copy[random.randrange(len(words))] = f"new{random.random()}"
            rows.append((10 * i + k, " ".join(copy), "en", "s", 1))
            sets[10 * i + k] = shingles(rows[-1][1])
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCUMENTS), "").collect()}
    assert 60 < len(set(root.values())) < len(rows)
    assert kept == set(root.values())


def test_near_copies_meet_by_golay_keys_of_fingerprints(spark):
    """Copies with one changed word are found by the fingerprints alone, and checked on their sets."""
    import random

    from larkbase.llm import nearcopies, simhash

    random.seed(5)
    rows = []
    for i in range(20):
        words = [f"w{random.randrange(4000)}" for _ in range(600)]
        rows.append((10 * i, " ".join(words), "en", "s", 1))
        words[300] = "changed"
        rows.append((10 * i + 1, " ".join(words), "en", "s", 1))
    prints = [simhash.fingerprint(t.encode(), nearcopies.SHINGLE) for _, t, *_ in rows]
    near = {10 * i for i in range(20) if (prints[2 * i] ^ prints[2 * i + 1]).bit_count() <= 4}
    assert len(near) > 10
    docs = spark.createDataFrame(rows, DOCUMENTS)
    described = nearcopies.materialize(nearcopies._described(docs.withColumn("_larkbase_row", F.monotonically_increasing_id())).withColumn("keys", F.array().cast("array<long>")))
    by_node = {r.node: r.doc_id for r in described.collect()}
    pairs = {tuple(sorted((by_node[r.a], by_node[r.b]))) for r in nearcopies.golay_pairs(described).collect()}
    assert {(i, i + 1) for i in near} <= pairs
    found = nearcopies.roots(docs.withColumn("_larkbase_row", F.monotonically_increasing_id()), described).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).update({by_node[r.node], by_node[r.root]})
    assert sorted(map(sorted, groups.values())) == sorted([i, i + 1] for i in near)


def test_large_buckets_lose_no_pair_and_make_few(spark):
    """Texts with a passage in common, and copies of some at about 0.8: pairs by rare shingles against all pairs."""
    import random
    from itertools import combinations

    from larkbase.llm import nearcopies

    random.seed(9)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(150):
        words = passage + [f"w{random.randrange(3000)}" for _ in range(random.choice([5, 60]))]
        texts.append(" ".join(words))
        if i % 5 == 0:
            words[random.randrange(len(words))] = "changed"
            texts.append(" ".join(words + ["more"] * (i % 3)))
    hashes = {nearcopies.node_of(h): h for h in map(nearcopies.shingles, map(str.encode, texts))}
    sets = spark.createDataFrame([(k, h.view("int64").tolist()) for k, h in hashes.items()], "node long, hashes array<long>")
    members = spark.createDataFrame([(k, len(h), k) for k, h in hashes.items()], "node long, n long, root long")
    made = {tuple(sorted((r.a, r.b))) for r in nearcopies.rare_pairs(members, sets).collect()}
    each = {k: set(h.tolist()) for k, h in hashes.items()}
    alike = {tuple(sorted(p)) for p in combinations(each, 2) if 10 * len(each[p[0]] & each[p[1]]) >= 8 * len(each[p[0]] | each[p[1]])}
    assert len(alike) > 100 and alike <= made
    assert len(made) < len(each) * (len(each) - 1) / 4


def test_a_large_group_of_near_copies_is_not_paired_off(spark):
    """Copies of one text with zero to eight words changed, most of them unlike each other: rows made, before equal ones
    are dropped, and components, against all pairs."""
    import random
    from itertools import combinations

    from larkbase.llm import nearcopies

    random.seed(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in random.sample(range(120), i % 9):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words), "en", "s", 1))
    hashes = {i: nearcopies.shingles(t.encode()) for i, t, *_ in rows}
    node = {i: nearcopies.node_of(h) for i, h in hashes.items()}
    each = {node[i]: set(h.tolist()) for i, h in hashes.items()}
    sets = spark.createDataFrame([(node[i], h.view("int64").tolist()) for i, h in hashes.items()], "node long, hashes array<long>").dropDuplicates(["node"])
    members = spark.createDataFrame([(k, len(h), k) for k, h in each.items()], "node long, n long, root long")
    made = [tuple(sorted((r.a, r.b))) for r in nearcopies.rare_pairs(members, sets).collect()]
    alike = {p for p in combinations(sorted(each), 2) if 10 * len(each[p[0]] & each[p[1]]) >= 8 * len(each[p[0]] | each[p[1]])}
    assert len(alike) > 500 and alike <= set(made)
    assert len(made) < len(each) * (len(each) - 1) / 4

    root = {k: k for k in each}
    for a, b in alike:
        low, high = sorted((root[a], root[b]))
        root = {k: low if r == high else r for k, r in root.items()}
    first = {}
    for i in node:
        first.setdefault(root[node[i]], i)
    kept = {r.doc_id for r in nearcopies.drop_near_copies(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert 50 < len(kept) < 250 and kept == set(first.values())


def test_a_run_leaves_only_the_results_of_its_stages(spark, corpus, tmp_path, monkeypatch):
    from pathlib import Path

    from larkbase.llm import common, linededup

    folder, _ = corpus
    for module in (common, linededup):
        monkeypatch.setattr(module, "scratch_dir", lambda _: str(tmp_path))
    rows = corpus_pipeline.run(spark, folder)
    assert len(list(Path(tmp_path, "larkbase").iterdir())) == len(corpus_pipeline.STAGES)
    assert rows.count() > 0


def test_working_folder_of_a_session_that_names_none(monkeypatch):
    from types import SimpleNamespace

    from larkbase.llm import common

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="a"))
    assert common.scratch_dir(session("local[4]")) == common.scratch_dir(session("local[4]"))
    for cluster in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            common.scratch_dir(session(cluster))


def test_stages_begin_when_the_driver_has_given_back_native_memory(spark):
    """Memory that the driver's JVM has freed outside its heap stays in the allocator's arenas unless it is trimmed."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def held() -> float:
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024

    deflaters = [spark._jvm.java.util.zip.Deflater() for _ in range(1200)]
    for i, d in enumerate(deflaters):
        if i % 4:
            d.end()
    for _ in range(3):  # the heap gives back what it can
        spark._jvm.java.lang.System.gc()
    before = held()
    collect_garbage(spark)
    freed = before - held()
    for d in deflaters[::4]:
        d.end()
    assert freed > 60


def test_rounds_of_components_leave_their_edges_only(spark, tmp_path, monkeypatch):
    """A round's tables on the way to its edges are deleted with its end; the result can still be read."""
    monkeypatch.setattr(common, "scratch_dir", lambda _: str(tmp_path))
    path = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    written = []
    kept = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda *args, **options: written.append(1) or kept(*args, **options))
    roots = {r.node: r.root for r in simhash.components(path).collect()}
    assert roots == {i: 0 for i in range(1, 31)} | {101: 100}
    left = len(list((tmp_path / "larkbase").iterdir()))
    rounds = (len(written) - 1) // 4
    assert rounds > 1 and left <= rounds + 1
