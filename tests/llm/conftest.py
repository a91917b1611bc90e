import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over a lazy dog near the river bank while seven wise owls watch from old oak trees at dusk".split()


def prose(seed: int, words: int = 60) -> str:
    """Text that is the same for the same seed and shares no long run with other seeds."""
    out = []
    for i in range(words):
        out.append(PROSE[(seed * 7919 + i * 104729 + (seed + i) ** 2) % len(PROSE)] + (chr(97 + (seed * 31 + i * 17) % 26) if i % 3 else ""))
        if i % 15 == 14:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture
def documents(spark):
    """Documents with nulls in any column, empty, repeated and long texts, and repeated and null ids."""
    rows = [(i, prose(i), "en" if i % 3 else "de", f"src{i % 4}", 1) for i in range(40)]
    rows += [(100, prose(1), "en", "src0", 1), (101, prose(1), "en", "src0", 1), (101, prose(1), "en", "src0", 1)]
    rows += [(200, None, "en", "src1", 1), (201, "", None, None, None), (None, prose(77), "en", "src1", 1), (None, None, None, None, None)]
    rows += [(300, " ".join(prose(s) for s in range(500, 560)), "en", "src2", 1), (301, " \t\n \x0b", "fr", "src3", 4)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def clashing(documents):
    """The documents with extra columns that have names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "shard", "tie", "part", "slot", "key", "keys", "batch", "line", "n_lines", "n_dropped", "fingerprint", "component_id", "root", "node"]
    names += ["ids", "n_tokens", "decoded", "round_trip", "n_bytes", "n_words", "kept", "base_failed", "score", "predicted", "toxic", "rule", "bucket", "n", "draw"]
    return documents.withColumns({n: F.lit("x") for n in names})
