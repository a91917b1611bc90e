"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up by cell: source, language and topic. Each value of each dimension has a factor, and
a cell's inclusion probability is the product of its three factors, at most 1. Raking multiplies the
factors, over and over, by what the expected tokens of their value lack of its target, until all three
dimensions meet their targets within `tolerance` of all tokens; cells whose product is over 1 are taken
whole meanwhile, and the others make up for them. The expected sample is `keep` of all tokens, or as much
as the targets allow: where a value has too few tokens for its share of that, or the cells can't meet all
targets at once, less is drawn. What was reached is told by `marginals`.

A document is sampled if the uniform number that its id and text hash to is below its cell's probability,
so the same corpus gives the same sample on any cluster, and equal rows share one decision.

Only cells are ever gathered: up to `driver_cells` of them are raked in the driver. More are summed in
Spark, round by round, by the same rule; then the driver holds the factors, not the cells.

Defined cases: null source, language or topic are values like any others; texts without words weigh
nothing and take the probability of their cell, cells without tokens that of `keep`; without a topic
column the topic is the text's form (see `form`); an empty table gives no rows; `sample` returns the
caller's columns untouched, whatever their names; a topic column is read as a string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkbase.llm.common import WORD_PATTERN, join_each, materialize, prepare_python

DIMENSIONS = ["source", "lang", "topic"]
#: Names inside, which clash with none of the user's.
INSIDE = {d: f"_larkbase_{d}" for d in DIMENSIONS}
TOKENS, CELL, DRAW, CHANCE, WEIGHT = (f"_larkbase_{c}" for c in ("tokens", "cell", "draw", "chance", "weight"))


@dataclass
class MixConfig:
    #: Exponent that tempers each dimension's share of tokens where no target is given: 1 keeps, 0 evens out.
    temper: dict[str, float] = field(default_factory=lambda: {"source": 0.9, "lang": 0.9, "topic": 0.9})
    #: Target shares by dimension and value, for example {"lang": {"en": 0.5, "de": 0.5}}; values without one get none.
    targets: dict[str, dict[str | None, float]] = field(default_factory=dict)
    #: Share of all tokens that the sample is expected to have, at most.
    keep: float = 0.8
    seed: int = 42
    #: Rounds of one attempt, and the distance from the targets, as a share of all tokens, at which it ends.
    rounds: int = 300
    tolerance: float = 1e-6
    #: Where the targets can't be met at a size, it is multiplied by `shrink`, so many times at most.
    shrink: float = 0.9
    attempts: int = 20
    driver_cells: int = 200_000


def form(text: Column) -> Column:
    """A topic for corpora that come without: the form of the text."""
    words = F.regexp_count(text, F.lit(WORD_PATTERN))
    signs = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    return (
        F.when(words == 0, "empty").when(signs * 5 >= words, "markup").when(words < 100, "brief").when(words < 1000, "article").otherwise("long")
    )


def draw(seed: int) -> Column:
    high = F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed)), 11)
    return high / F.lit(float(1 << 53))


def measured(docs: DataFrame, config: MixConfig) -> DataFrame:
    """The documents with the inside columns: three dimensions, tokens (words), the cell's name and a uniform draw."""
    text = F.coalesce("text", F.lit(""))
    topic = F.col("topic").cast("string") if "topic" in docs.columns else form(text)
    values = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic}
    made = docs.withColumns({INSIDE[d]: values[d] for d in DIMENSIONS} | {TOKENS: F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), DRAW: draw(config.seed)})
    # Each value with its length, so that no two cells have one name; nulls have none.
    named = (F.coalesce(F.concat(F.length(INSIDE[d]).cast("string"), F.lit(":"), F.col(INSIDE[d])), F.lit("-")) for d in DIMENSIONS)
    return made.withColumn(CELL, F.concat(*named))


def target_shares(totals: np.ndarray, values: list, dimension: str, config: MixConfig) -> np.ndarray:
    """Shares that add up to 1 over the values that have tokens."""
    given = config.targets.get(dimension)
    if given is None:
        raw = np.maximum(totals, 0) ** config.temper.get(dimension, 1.0)
    else:
        raw = np.array([float(given.get(None if pd.isna(v) else v, 0.0)) for v in values])
    raw = np.where(totals > 0, raw, 0.0)
    return raw / raw.sum() if raw.sum() > 0 else raw


Held = Callable[[int, list[np.ndarray]], np.ndarray]


def fit_factors(totals: list[np.ndarray], shares: list[np.ndarray], held: Held, config: MixConfig) -> tuple[list[np.ndarray], float]:
    """Factors by dimension, and the share of all tokens that they are expected to keep.

    `held(side, factors)` gives the expected tokens of each value of a dimension, as a share of all.
    """
    whole = totals[0].sum()
    # No value can give more tokens than it has.
    most = min(float((t[s > 0] / whole / s[s > 0]).min(initial=1.0)) for t, s in zip(totals, shares, strict=True))
    size = min(config.keep, most)
    for attempt in range(config.attempts):
        factors = [np.full(len(s), size ** (1 / len(shares))) for s in shares]
        for _ in range(config.rounds):
            worst = 0.0
            for side, share in enumerate(shares):
                now, wanted = held(side, factors), share * size
                worst = max(worst, float(np.abs(now - wanted).max(initial=0.0)))
                change = np.divide(wanted, now, out=np.zeros_like(wanted), where=now > 0)
                factors[side] = np.minimum(factors[side] * change, 1e90)
            if worst <= config.tolerance:
                return factors, size
        if attempt + 1 < config.attempts:
            size *= config.shrink
    return factors, size


def chances(factors: list[np.ndarray], codes: list[np.ndarray]) -> np.ndarray:
    product = np.ones(len(codes[0]))
    for f, c in zip(factors, codes, strict=True):
        product *= f[c]
    return np.minimum(product, 1.0)


def rake(cells: pd.DataFrame, config: MixConfig) -> tuple[np.ndarray, float]:
    """Probabilities of the cells (source, lang, topic, tokens) and the share of tokens expected."""
    tokens = cells["tokens"].to_numpy(dtype=float)
    codes, totals, shares = [], [], []
    for d in DIMENSIONS:
        own, values = pd.factorize(cells[d], use_na_sentinel=False)
        codes.append(own)
        totals.append(np.bincount(own, tokens, len(values)))
        shares.append(target_shares(totals[-1], list(values), d, config))
    whole = tokens.sum()
    factors, size = fit_factors(totals, shares, lambda side, f: np.bincount(codes[side], tokens * chances(f, codes), len(shares[side])) / whole, config)
    return chances(factors, codes), size


def rake_in_spark(cells: DataFrame, config: MixConfig) -> DataFrame:
    """The cells (source, lang, topic, tokens, cell, n) with their probability, for more cells than a driver should hold."""
    spark = cells.sparkSession
    prepare_python(spark)
    coded, totals, shares = cells, [], []
    for k, d in enumerate(DIMENSIONS):
        found = cells.groupBy(d).agg(F.sum("tokens").alias("t")).orderBy(d).toPandas()
        values = [None if pd.isna(v) else v for v in found[d]]
        totals.append(found["t"].to_numpy(dtype=float))
        shares.append(target_shares(totals[-1], values, d, config))
        codes = spark.createDataFrame(list(zip(values, range(len(values)), strict=True)), f"v string, code{k} int")
        coded = coded.join(codes, F.col(d).eqNullSafe(F.col("v"))).drop("v")
    coded = materialize(coded)
    whole = totals[0].sum()

    def held(side: int, factors: list[np.ndarray]) -> np.ndarray:
        size = len(shares[side])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size)
            for batch in batches:
                codes = [batch.column(f"code{k}").to_numpy() for k in range(len(factors))]
                sums += np.bincount(codes[side], batch.column("tokens").to_numpy() * chances(factors, codes), size)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], ["code", "held"])

        parts = coded.select("tokens", "code0", "code1", "code2").mapInArrow(run, "code long, held double")
        out = np.zeros(size)
        for r in parts.groupBy("code").agg(F.sum("held").alias("held")).collect():
            out[r["code"]] = r["held"] / whole
        return out

    factors, size = fit_factors(totals, shares, held, config)
    names = [*DIMENSIONS, "tokens", "cell", "n"]

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chances(factors, [batch.column(f"code{k}").to_numpy() for k in range(len(factors))])
            p = np.where(batch.column("tokens").to_numpy() > 0, p, config.keep)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p), pa.array(p / size)], [*names, "probability", "weight"])

    return coded.mapInArrow(give, "source string, lang string, topic string, tokens long, cell string, n long, probability double, weight double")


def cell_probabilities(measures: DataFrame, config: MixConfig) -> DataFrame:
    """(source, lang, topic, tokens, cell, n, probability, weight): n documents, weight the probability over the share kept."""
    spark = measures.sparkSession
    cells = measures.groupBy(CELL, *INSIDE.values()).agg(F.sum(TOKENS).alias("tokens"), F.count(F.lit(1)).alias("n"))
    cells = materialize(cells.select(*(F.col(INSIDE[d]).alias(d) for d in DIMENSIONS), "tokens", F.col(CELL).alias("cell"), "n"))
    size = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if not size[1]:
        return cells.withColumns({"probability": F.lit(float(config.keep)), "weight": F.lit(1.0)})
    if size[0] > config.driver_cells:
        return materialize(rake_in_spark(cells, config))
    found = cells.orderBy("cell").toArrow().to_pandas()
    p, kept = rake(found, config)
    p = np.where(found["tokens"] > 0, p, config.keep)
    rows = [
        (*(None if pd.isna(r[d]) else r[d] for d in DIMENSIONS), int(r["tokens"]), r["cell"], int(r["n"]), float(x), float(x / kept))
        for (_, r), x in zip(found.iterrows(), p, strict=True)
    ]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, cell string, n long, probability double, weight double")


def with_chances(measures: DataFrame, cells: DataFrame) -> DataFrame:
    """The measures with each document's probability and weight. Documents of a frequent cell are dealt by their draw."""
    each = cells.select(F.col("cell").alias(CELL), "n", F.col("probability").alias(CHANCE), F.col("weight").alias(WEIGHT))
    return join_each(measures, each, CELL, DRAW)


def assign(docs: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled) of every document."""
    config = config or MixConfig()
    columns = ["doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else [])]
    rows = materialize(measured(docs.select(*columns), config).drop("text"))
    return with_chances(rows, cell_probabilities(rows, config)).select(
        "doc_id", "source", "lang", F.col(INSIDE["topic"]).alias("topic"), F.col(TOKENS).alias("n_tokens"), F.col(WEIGHT).alias("weight"),
        F.col(CHANCE).alias("probability"), (F.col(DRAW) < F.col(CHANCE)).alias("sampled"),
    )


def sample(docs: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """The sampled documents with their own columns."""
    config = config or MixConfig()
    rows = measured(docs, config)
    cells = cell_probabilities(rows.select(CELL, TOKENS, *INSIDE.values()), config)
    return with_chances(rows, cells).filter(F.col(DRAW) < F.col(CHANCE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def marginals(assigned: DataFrame, config: MixConfig | None = None) -> DataFrame:
    """(dimension, value, share, target, expected, sampled): shares of tokens of each value among all documents, as
    wanted, as expected of the sample and in the sample drawn, from what `assign` gave."""
    config = config or MixConfig()
    spark = assigned.sparkSession
    rows = []
    for d in DIMENSIONS:
        tokens = F.col("n_tokens")
        made = assigned.groupBy(F.col(d).cast("string").alias("value")).agg(
            F.sum(tokens).alias("all"), F.sum(tokens * F.col("probability")).alias("expected"), F.sum(F.when(F.col("sampled"), tokens).otherwise(0)).alias("sampled")
        )
        found = made.toPandas()
        target = target_shares(found["all"].to_numpy(dtype=float), list(found["value"]), d, config)
        for (_, r), t in zip(found.iterrows(), target, strict=True):
            rows.append((d, None if pd.isna(r["value"]) else r["value"], *(float(r[c] / max(1e-300, found[c].sum())) for c in ("all",)), float(t), *(float(r[c] / max(1e-300, found[c].sum())) for c in ("expected", "sampled"))))
    return spark.createDataFrame(rows, "dimension string, value string, share double, target double, expected double, sampled double")
