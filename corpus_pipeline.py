"""A corpus pipeline from the operators of `larkbase.llm`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of `documents`.

Defined cases: those of the operators. A stage gives no rows for an empty table; null texts pass the
first stages as null, and are encoded as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbase.llm import bpe, linededup, mixing, nearcopies, toxicity
from larkbase.llm.common import collect_garbage, materialize, table, working_files
from larkbase.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go. The models learn from the labelled ones among the input."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share stay in one text only; no document goes."""
    cut = linededup.drop_lines(docs, min_docs=10, keep_first=True)
    return cut.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 5-word shingles, similarity 0.8 or more, found by SimHash
    fingerprints and Golay-code keys, and by MinHash where those don't reach."""
    return nearcopies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with four fifths of the tokens at most, nearer to even shares of sources, languages and topics."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, round_trip): token ids, and whether they decode to the text."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_file("byte_bpe_50k.json"), keep_text=False)


def _rested(stage: Stage) -> Stage:
    """The stage, begun when executors have given back what the one before has left."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("toxicity", _rested(drop_toxic)),
    ("line_dedup", _rested(dedup_lines)),
    ("near_dedup", _rested(drop_near_copies)),
    ("mixing", _rested(mix_sources)),
    ("bpe", _rested(encode)),
]

#: The learned model and the raking can't be expressed in SQL. The tests of their operators compare both with
#: plain versions, and those of the pipeline compare near_dedup's groups with all pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        # What a stage has written on the way is deleted with its end; its result stays.
        with working_files(spark):
            docs = materialize(stage(spark, docs, sf_dir), keep=True)
    return docs
