"""Quality rules whose cutoffs adapt to each language and source.

Every document is measured once. For each group of language and source, and each rule, a sketch
counts the documents in log-linear buckets: values below 64 are exact, larger ones fall in buckets
no wider than a 32nd of their value. Sketches are plain counts, so they merge by addition, in any
order and with the same result; Spark adds them up before shuffling. A group's sketch is shrunk
toward its language's and toward that of all documents: each of those is mixed in with the weight of
a fixed number of documents, at every group size alike, so that a small group borrows its scale and
a large one has its own. From the mixed sketch comes the cutoff:

* where the quartiles differ, a fence above the upper one, `spread` times their distance away;
* where they don't (half the group or more shares one value), the first valley above the upper
  quartile: a value from which on `valley` buckets (two doublings) hold under one in `valley_share`
  of the weight, while more lies beyond. A group without a valley has no cutoff by that rule.

Shares are taken as what the counts establish: of n events, two standard deviations of a Poisson
count are left out, so that a few events in a short text condemn nothing. The cutoffs are joined
back to the measures; a document above any of them falls.

Defined cases: a null text has no words; null language and source are groups of their own; documents
with fewer than 50 words or mostly repeated windows fail the base rules and take no part in the
sketches; a value at a cutoff stays; repeated rows count each; an empty table gives no rows; other
columns stay, unless they have the names of measures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from larkbase.llm.common import prepare_python, materialize

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines"]
SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Sketched values are shares in units of 1/10,000, and the mean length of words in 1/100 characters.
RULES = ["symbol_share", "dup_line_share", "repeat_share", "mean_word"]


@dataclass
class QualityConfig:
    min_words: int = 50
    #: Distance of the fence above the upper quartile, in distances between the quartiles.
    spread: int = 6
    #: Buckets that a valley is wide, and the share of the weight (one in so many) that it may hold.
    valley: int = 64
    valley_share: int = 1000
    #: Documents that the sketch of a group's language, and that of all, count as within each group's.
    language_weight: int = 200
    overall_weight: int = 50


def measure_text(text: bytes) -> tuple[int, ...]:
    """The measures of one UTF-8 text; n_text_lines are the lines with a word."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    # Code points are the bytes that don't continue one.
    chars = len(joined.decode("utf-8", "replace")) if not joined.isascii() else len(joined)
    symbols = len(SYMBOLS.findall(text))
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    dup = len(lines) - len(set(lines))
    return n, chars, symbols, dup, repeated_words(words), len(lines)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """How many words stand in a window of `size` words that the text has at least twice."""
    n = len(words)
    if n <= size:
        return 0
    codes: dict[bytes, int] = {}
    at = np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)
    kinds = len(codes)
    if kinds == n:
        return 0
    key = at[: n - size + 1]
    for k in range(1, size):
        if k == 2 and kinds > 2_000_000:  # three codes no longer fit 63 bits: number the pairs first
            key = np.unique(key, return_inverse=True)[1]
        key = key * kinds + at[k : n - size + 1 + k]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(size):
        covered[k : n - size + 1 + k] |= twice
    return int(covered.sum())


def measure(docs: DataFrame) -> DataFrame:
    """The documents without their text, with their measures; one scan."""
    prepare_python(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (*MEASURES, "text")]
    names = [f.name for f in kept]
    out = StructType(kept)
    for m in MEASURES:
        out = out.add(m, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure_text(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
            made = np.array(found, dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(made[:, k]) for k in range(len(MEASURES)))], [*names, *MEASURES]
            )

    return docs.select(*(F.col(f"`{n}`") for n in names), "text").mapInArrow(run, out)


def bucket(value: Column) -> Column:
    """Log-linear bucket of a non-negative integer, by integers only: 32 buckets to each doubling, without holes."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 32 + F.call_function("shiftright", value.cast("long"), shift)).cast("int")


def bucket_value(b: Column) -> Column:
    """The least value of a bucket."""
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - shift * 32).cast("long"), shift)


def with_rules(measures: DataFrame) -> DataFrame:
    words, chars = F.col("n_words"), F.col("word_chars")
    whole = lambda part, of: F.when(of > 0, F.call_function("div", part, of)).otherwise(F.lit(0))
    established = lambda n: F.greatest(n - F.ceil(2 * F.sqrt(n)), F.lit(0))
    return measures.withColumns(
        {
            "symbol_share": whole(10_000 * established(F.col("n_symbols")), words),
            "dup_line_share": whole(10_000 * established(F.col("n_dup_lines")), F.col("n_text_lines")),
            "repeat_share": whole(10_000 * established(F.col("n_repeat_words")), words),
            "mean_word": whole(100 * chars, words),
        }
    )


def sketches(measures: DataFrame, config: QualityConfig) -> DataFrame:
    """(lang, source, rule, bucket, n) over the documents that pass the base rules."""
    good = with_rules(measures).filter(~base_failed(config))
    stacked = good.select(
        "lang", "source", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), bucket(F.col(r)).alias("bucket")) for r in RULES))).alias("x")
    ).select("lang", "source", "x.*")
    return stacked.groupBy("lang", "source", "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def mixed(sketch: DataFrame, config: QualityConfig) -> DataFrame:
    """(lang, source, rule, bucket, weight): each group's sketch with its language's and that of all mixed in.

    Weights are exact: with N the documents of the language and M those of all, a bucket weighs
    own * N * M + language_weight * language's * M + overall_weight * all's * N.
    """
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    language = sketch.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    overall = sketch.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    # All rules have the same documents, so one of them tells how many there are.
    sizes = language.filter(F.col("rule") == RULES[0]).groupBy(F.col("lang").alias("lang_")).agg(F.sum("n").alias("n_lang"))
    size = overall.filter(F.col("rule") == RULES[0]).agg(F.sum("n").alias("n_all"))
    groups = sketch.select("lang", "source").distinct().join(sizes, F.col("lang").eqNullSafe(F.col("lang_"))).crossJoin(F.broadcast(size))
    groups = materialize(groups.select("lang", "source", "n_lang", "n_all"))
    own = sketch.withColumnsRenamed({"lang": "lang_", "source": "source_"}).join(
        groups, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    ).select("lang", "source", "rule", "bucket", (exact("n") * exact("n_lang") * exact("n_all")).alias("weight"))
    from_language = language.withColumnRenamed("lang", "lang_").join(groups, F.col("lang").eqNullSafe(F.col("lang_"))).select(
        "lang", "source", "rule", "bucket", (exact("n") * exact("n_all") * config.language_weight).cast("decimal(38,0)").alias("weight")
    )
    # At most 1,888 buckets for each rule, so one row of the groups meets a small table.
    from_all = groups.crossJoin(F.broadcast(overall)).select(
        "lang", "source", "rule", "bucket", (exact("n") * exact("n_lang") * config.overall_weight).cast("decimal(38,0)").alias("weight")
    )
    parts = own.unionByName(from_language).unionByName(from_all)
    return parts.groupBy("lang", "source", "rule", "bucket").agg(F.sum("weight").alias("weight"))


def thresholds(measures: DataFrame, config: QualityConfig) -> DataFrame:
    """(lang, source, a cutoff for each rule, null where nothing is cut)."""
    every = Window.partitionBy("lang", "source", "rule")
    ordered = every.orderBy("bucket")
    ranked = mixed(materialize(sketches(measures, config)), config).withColumns(
        {
            "upto": F.sum("weight").over(ordered),
            "total": F.sum("weight").over(every),
            "ahead": F.coalesce(F.sum("weight").over(ordered.rangeBetween(1, config.valley)), F.lit(0)),
        }
    )
    at = lambda quarter: F.min(F.when(F.col("upto") * 4 >= F.col("total") * quarter, F.col("bucket")))
    empty = (F.col("upto") * 4 >= F.col("total") * 3) & (F.col("upto") < F.col("total")) & (F.col("ahead") * config.valley_share <= F.col("total"))
    found = ranked.groupBy("lang", "source", "rule").agg(at(1).alias("low"), at(3).alias("high"), F.min(F.when(empty, F.col("bucket"))).alias("valley"))
    q1, q3 = bucket_value(F.col("low")), bucket_value(F.col("high"))
    # A bucket's values all stay if its least one does.
    cut = F.when(q3 > q1, q3 + config.spread * (q3 - q1)).otherwise(bucket_value(F.col("valley") + 1) - 1).cast("long")
    return found.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == r, cut)).alias(f"cut_{r}") for r in RULES))


def base_failed(config: QualityConfig) -> Column:
    return (F.col("n_words") < config.min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def judge(docs: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """The measures of each document with base_failed and kept."""
    config = config or QualityConfig()
    measures = materialize(measure(docs))
    cuts = materialize(thresholds(measures, config)).withColumnsRenamed({"lang": "_larkbase_lang", "source": "_larkbase_source"})
    if cuts.count() <= 100_000:  # rows of about 60 bytes; more groups than that are joined by shuffling
        cuts = F.broadcast(cuts)
    joined = with_rules(measures).join(
        cuts, F.col("lang").eqNullSafe(F.col("_larkbase_lang")) & F.col("source").eqNullSafe(F.col("_larkbase_source")), "left"
    )
    within = F.lit(True)
    for r in RULES:
        within = within & F.coalesce(F.col(r) <= F.col(f"cut_{r}"), F.lit(True))
    return joined.select(*measures.columns, base_failed(config).alias("base_failed"), (~base_failed(config) & within).alias("kept"))
