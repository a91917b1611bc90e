"""Scores, token ids, token counts and quality rules against brute force."""

import hashlib
from pathlib import Path

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkbase.llm import bpe, quality, tokencount
from tests.llm.conftest import prose

BYTES, WORDS = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = st.text(alphabet=st.sampled_from(list(" \n\t 　\x1c\x85abcE'sé12.,!<|>😀́İΣ")) | st.characters(exclude_categories=["Cs"]), max_size=60)


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(Path(BYTES).read_bytes())


@settings(max_examples=300, deadline=None)
@given(ODD | st.just("a <|endoftext|>b<|endoftext|>"))
def test_words_encode_as_the_whole_text(codec, text):
    import re

    expected = Tokenizer.from_file(BYTES) if not hasattr(codec, "reference") else codec.reference
    codec.reference = expected
    ids = expected.encode(text, add_special_tokens=False).ids
    assert codec.encode(re.findall(bpe.WORDS, text)) == ids
    assert codec.decode(ids) == expected.decode(ids, skip_special_tokens=False) == text


def test_words_are_encoded_joined_and_told_apart():
    """Each word has the ids it has by itself, from far fewer texts than words; also where the pieces don't add up."""
    import re
    from types import SimpleNamespace

    text = " a  bc\n\nd'll 12,345 \x85x \u3000\u00a0é <|endoftext|>y <|endoftext|> \x1cq 🙂🙂 \t" + " ".join(f"w{i}x{i * i}" for i in range(3000)) + "  "
    words = list(dict.fromkeys(re.findall(bpe.WORDS, text)))
    own = bpe.Codec(Path(BYTES).read_bytes())
    tokenizer, seen = own.tokenizer, []
    own.tokenizer = SimpleNamespace(encode_batch_fast=lambda texts, **b: (seen.extend(texts), tokenizer.encode_batch_fast(texts, **b))[1])
    own.rows(words)
    each = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    assert [own.ids[own.at[w]] for w in words] == each
    assert len(seen) < len(words) / 50
    own.lengths = own.lengths + 1
    assert own.encode_words(words) == each


def test_encoding_decoding_and_digests(documents):
    reference = Tokenizer.from_file(BYTES)
    encoded = bpe.encode(documents, BYTES)
    assert encoded.filter(~F.col("round_trip")).count() == 0
    decoded = {(r.doc_id, r.text, r.decoded) for r in bpe.decode(encoded, BYTES).collect()}
    assert all((t or "") == d for _, t, d in decoded)
    got = sorted(map(tuple, bpe.digest(documents, BYTES).collect()), key=str)
    want = []
    for r in documents.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
    assert got == sorted(want, key=str)


# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def prefixes():
    table = tokencount.PrefixTable(Path(WORDS).read_bytes())
    table.reference = Tokenizer.from_file(WORDS)
    return table


def at_all_prefixes(table, text):
    return [len(table.reference.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


MIXED = st.text(alphabet=st.sampled_from("abcdeéßñØαβΣжё漢字かกहि한글'’<|>#$-_.0123½²٣Ⅷİſﬁ😀👍́‍ᅡᆨ "), max_size=40)


@settings(max_examples=300, deadline=None)
@given(ODD | MIXED | st.just("it's <|endoftext|> don't ab́c x<|startoftext|>7y<|endoftext|") | st.characters(exclude_categories=["Cs"]), st.integers(0, 20))
def test_counts_at_every_prefix(prefixes, text, budget):
    want = at_all_prefixes(prefixes, text)
    counts = tokencount.PrefixCounts.of(text, prefixes)
    assert counts.all() == want
    assert [counts.at(k) for k in range(len(text) + 1)] == want
    assert counts.longest(budget) == max(k for k, n in enumerate(want) if n <= budget)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinorstlhd"), min_size=1, max_size=30) | st.text(alphabet=st.sampled_from("#$%!?.*😂"), min_size=1, max_size=20))
def test_the_recurrence_gives_every_prefix_of_a_run(prefixes, run):
    assert prefixes._of_run(run) == at_all_prefixes(prefixes, run)


def test_neighbours_fit_as_they_encode(prefixes):
    import random

    merges = prefixes.merges
    tokens = sorted(merges.rank, key=merges.rank.get)
    random.seed(7)
    closed = lambda t: t.endswith(tokencount.END_MARK)
    kinds = [a + b for a, b in tokens]
    left = [t for t in kinds if not closed(t)]
    pairs = [(random.choice(left), random.choice(kinds)) for _ in range(4000)] + [random.choice(tokens) for _ in range(2000)]
    pairs += [(a, b) for a in ("a", "aa", "aaa", "haha", "ha") for b in ("a", "aa", "aaa", "a</w>", "aa</w>", "haha", "ha</w>")]
    for a, b in pairs:
        known = merges.encode(merges.symbols(a))[0] == [a]
        assert not known or merges.fit(a, b) == (merges.encode([*merges.symbols(a), *merges.symbols(b)])[0] == [a, b]), (a, b)


def test_prefixes_of_long_words_are_stored(prefixes, monkeypatch):
    words = ["internationalization" * 30, "ab1" * 400, "漢字" * 300, "x" * 3000, "é" * 200 + "tail" * 100]
    counted = [tokencount.PrefixCounts.of(w, prefixes) for w in words]

    def never(*args, **kwargs):
        raise AssertionError("encoded again")

    own = prefixes.tokenizer
    prefixes.tokenizer = None
    try:
        for word, counts in zip(words, counted, strict=True):
            for k in (*range(0, len(word), 97), len(word)):
                assert counts.at(k) == len(prefixes.reference.encode(word[:k], add_special_tokens=False).ids)
    finally:
        prefixes.tokenizer = own


def test_a_symbol_that_the_vocabulary_lacks_goes_to_the_tokenizer(prefixes, monkeypatch):
    part = tokencount.Merges(["a", "a</w>"], [])
    table = tokencount.PrefixTable(Path(WORDS).read_bytes())
    table.merges = part
    assert list(table.of("abba", True)) == at_all_prefixes(prefixes, "abba")


def test_counts_of_documents(spark, documents):
    reference = Tokenizer.from_file(WORDS)
    size = lambda t: len(reference.encode(t, add_special_tokens=False).ids)
    counted = tokencount.count_tokens(documents, WORDS, 50)
    for r in counted.collect():
        text = r.text or ""
        assert (r.n_tokens, r.n_bytes) == (size(text), len(text.encode()))
        assert (r.fits_chars == len(text)) == (r.n_tokens <= 50)
        found = [(m.start(), size(text[: m.end()])) for m in tokencount.WORD.finditer(text)]
        assert list(zip(r.word_starts, r.word_tokens, strict=True)) == found
    asked = counted.withColumn("cut", F.when(F.col("n_bytes") > 0, F.col("n_bytes") % 100))
    for r in tokencount.prefix_tokens(asked, WORDS, "cut").collect():
        assert r.prefix_tokens == size((r.text or "")[: r.cut or 0])


def test_running_counts_of_slices_and_texts_without_space_between(prefixes):
    import pyarrow as pa

    texts = ["ab", "cd ef", "", " ", "gh", "é漢", "x	y "]
    whole = pa.array([t.encode() for t in texts], pa.binary())
    for a in range(len(texts)):
        found = tokencount.running_counts(whole.slice(a, 4), prefixes)
        want = [len(prefixes.reference.encode(t, add_special_tokens=False).ids) for t in texts[a : a + 4]]
        assert found.totals().tolist() == want
        starts = [[m.start() for m in tokencount.WORD.finditer(t)] for t in texts[a : a + 4]]
        assert [found.starts[i:j].tolist() for i, j in zip(found.bounds, found.bounds[1:], strict=False)] == starts


# ---------------------------------------------------------------- quality


def slow_repeats(words, size=3):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + size))
    return len(hit)


@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=30))
def test_repeated_words(words):
    assert quality.repeated_words(words) == slow_repeats(words)


def test_measures():
    text = "Ab é#\n\nx %x\nAb é#\n \t\nx %x\n".encode()
    assert quality.measure_text(text) == (8, 14, 4, 2, slow_repeats(text.split()), 4)


def test_bucket_values(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 12345, 10**6, 10**9]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket_value(quality.bucket(F.col("v"))).alias("low"))
    for v, low in df.collect():
        assert low <= v and (low == v if v < 64 else v - low < v / 32 + 1)


def test_quality_verdicts(spark):
    rows = [(i, prose(i, 120), "en", f"s{i % 3}") for i in range(300)]
    rows += [(1000, " ".join(w + "###" for w in prose(5, 120).split()), "en", "s0"), (1001, "short", "en", "s0"), (1002, "a b c " * 40, "en", "s1")]
    rows += [(1003, None, None, None), (1004, "", "en", None)]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] == (False, True) for i in range(300))
    assert kept[1000] == (False, False)
    assert all(kept[i] == (True, False) for i in (1001, 1002, 1003, 1004))


def test_sketches_merge_to_the_same_cutoffs(spark):
    rows = [(i, prose(i, 100), "en", "s0") for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    config = quality.QualityConfig()
    cuts = [sorted(map(tuple, quality.thresholds(quality.measure(df.repartition(n)), config).collect())) for n in (1, 7)]
    assert cuts[0] == cuts[1]


@pytest.mark.parametrize("operator", [lambda d: bpe.encode(d, BYTES), lambda d: bpe.digest(d, BYTES), lambda d: tokencount.count_tokens(d, WORDS), quality.judge])
def test_odd_tables(operator, documents, clashing, empty):
    assert operator(documents).count() == documents.count()
    assert operator(clashing).count() == documents.count()
    assert operator(empty).count() == 0
