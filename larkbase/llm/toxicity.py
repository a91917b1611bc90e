"""Toxicity by class-conditional Kneser-Ney models.

Expressions are character n-grams of order eight within words, padded before the first letter and
closed by an end mark. Two models, one of toxic and one of ordinary texts, are made of the counts of
their own expressions with absolute discounts, and share every lower order: there the probabilities
are interpolated Kneser-Ney continuation counts, pooled over both classes. So an expression which is
rare or which neither class has seen backs off to the same probability in both and counts for
neither. No expression is left out, however rare.

A passage is compared by its length-normalised log-likelihoods: log P(toxic) - log P(ordinary) of its
words, over the number of words. A text's score is a logistic curve over that of the whole text and
that of its three most toxic words, with the logarithm of the number of words, as a longer text has
more words among which to find three. The curve is set by a bounded sample of labelled texts which
the counts have not seen: of each class the first quarter by an id hash, at most `calibration_docs`.
All other labelled texts are counted, in Spark, and the probabilities are computed there too.

Scoring needs one number for each expression and one for each history. Up to `held_expressions` of
them are sent to all executors as sorted hashes, and a scan scores every text; beyond it, the
distinct words of the texts are joined to them, and the words' numbers to the texts. Both give the
same scores, up to the rounding of sums.

Defined cases: null and empty texts, and texts without a letter or digit, have no words and get the
score of an empty text; labels that are null or neither 0 nor 1 are ignored, and a document labelled
twice counts as toxic if any label says so; equal texts count once in training, by the label of the
least id; if either class has fewer than four texts to learn from, every score is the share of toxic
labels (0 without labels). Columns beyond doc_id, text and toxic are ignored in training and kept in
results, unless they have the names of what is made.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from larkbase.llm.common import id_bucket, materialize, prepare_python, tidy

ORDER = 8
PAD = "^"
END = "$"
RUNS = re.compile(r"[^\W_]+")
SEED = 42
#: Most toxic words that stand for a text's most toxic passage.
PEAK = 3
#: Distinct words that a task holds before it passes their counts on, and whose numbers it keeps.
HELD, KEPT = 60_000, 100_000
#: Texts that a task takes apart at once.
TOGETHER = 128


@dataclass
class ToxicityConfig:
    #: Every `held_out_mod`-th document by id hash is never learned from.
    held_out_mod: int = 5
    #: Bound of the sample that sets the logistic curve, per class (the counts have no such bound).
    calibration_docs: int = 2000
    #: Expressions and histories (16 bytes each) up to which they are sent to all executors.
    held_expressions: int = 8_000_000
    #: Labels of up to this many rows are sent to all executors; beyond it they are joined by shuffling.
    broadcast_labels: int = 2_000_000


@dataclass
class ToxicityModel:
    """(key, gain) of expressions and of histories, by the hash of their text, and the curve."""

    gains: DataFrame | None = None
    unseen: DataFrame | None = None
    weights: tuple[float, ...] | None = None
    prior: float = 0.0
    held: bool = True

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        z = design(features) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def column(self) -> Column:
        """The score from columns whole, peak and log_words."""
        if self.weights is None:
            return F.lit(self.prior)
        z = F.lit(self.weights[0])
        for w, c in zip(self.weights[1:], FEATURES, strict=True):
            z = z + F.lit(w) * F.col(c)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


FEATURES = ["whole", "peak", "log_words"]


def design(features: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), features])


def fit_logistic(features: np.ndarray, toxic: np.ndarray, rounds: int = 50, ridge: float = 1e-4) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; both classes weigh the same."""
    x = design(features)
    share = toxic.mean()
    weight = np.where(toxic == 1, 0.5 / share, 0.5 / (1 - share)) * 1.0
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1)) * len(x) + 1e-6 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - toxic)) + penalty @ w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


# ---------------------------------------------------------------- counting


def spread(words: Iterable[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """All runs of the words in one padded string, where each expression begins in it, and its word's number."""
    pieces, owners, lengths = [], [], []
    for i, word in enumerate(words):
        for run in RUNS.findall(word.lower()):
            pieces.append(PAD * (ORDER - 1) + run + END)
            owners.append(i)
            lengths.append(len(run) + 1)
    sizes = np.array(lengths, dtype=np.int64)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return "".join(pieces), np.repeat(starts, sizes) + inside, np.repeat(np.array(owners, dtype=np.int64), sizes)


#: Odd factors of the characters of an expression.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the expressions that begin at `starts`, and of their histories: sums of the code points
    by their factors."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    history = np.zeros(len(starts), dtype=np.uint64)
    for k in range(ORDER - 1):
        history += points[starts + k] * FACTORS[k]
    return (history + points[starts + ORDER - 1] * FACTORS[-1]).view(np.int64), history.view(np.int64)


def keyed(values: DataFrame) -> DataFrame:
    """(key, gain) of (text, gain), the texts being expressions or histories."""
    prepare_python(values.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            size = len(texts[0]) if texts else 0
            # A history is followed by anything, which its key leaves out.
            whole = keys("".join(texts) + END, np.arange(len(texts)) * size)[0 if size == ORDER else 1]
            yield pa.RecordBatch.from_arrays([pa.array(whole), batch.column("gain")], ["key", "gain"])

    return values.select("text", "gain").mapInArrow(tidy(run), "key long, gain double")


def count_expressions(texts: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) over texts with a label, (text, toxic)."""
    prepare_python(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[Counter, Counter] = (Counter(), Counter())

        def passed() -> pa.RecordBatch:
            both = list(words[0] | words[1])
            text, starts, owners = spread(both)
            _, first, at = np.unique(keys(text, starts)[0], return_index=True, return_inverse=True)
            counts = []
            for side in (1, 0):
                n = np.array([words[side][w] for w in both], dtype=np.float64)
                counts.append(np.bincount(at, n[owners], len(first)).astype(np.int64))
            grams = [text[i : i + ORDER] for i in starts[first].tolist()]
            for side in words:
                side.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *map(pa.array, counts)], ["gram", "toxic", "ordinary"])

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                words[toxic].update((text.as_py() or "").split())
                if len(words[0]) + len(words[1]) > HELD:
                    yield passed()
        yield passed()

    counted = texts.select("text", "toxic").mapInArrow(tidy(run), "gram string, toxic long, ordinary long")
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


# ---------------------------------------------------------------- probabilities


def discount(once: int | None, twice: int | None) -> float:
    """The absolute discount, from how many counts are 1 and 2."""
    return once / (once + 2 * twice) if once and twice else 0.5


def ones_and_twos(counts: DataFrame, column: str) -> tuple[int, int]:
    found = counts.agg(*(F.sum((F.col(column) == k).cast("long")) for k in (1, 2))).first()
    return found[0] or 0, found[1] or 0


def history(length: int) -> Column:
    return F.substring("gram", 1, length).alias("history")


def continuation_probabilities(grams: DataFrame) -> DataFrame:
    """(gram, p): the interpolated Kneser-Ney probability of the last character of each expression's
    ending of length ORDER - 1, given the characters before it.

    A count is the number of distinct characters that stand before, so each level is counted from the
    distinct expressions of the one above; probabilities are then made from the shortest up.
    """
    levels, kinds = [], grams.select("gram")
    for k in range(ORDER - 1, 0, -1):
        counts = materialize(kinds.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        levels.append(counts)
        kinds = counts.select("gram")
    below = None
    for k, counts in enumerate(reversed(levels), 1):
        d = discount(*ones_and_twos(counts, "n"))
        after = counts.withColumn("history", F.substring("gram", 1, k - 1))
        totals = after.groupBy("history").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        if below is None:
            shorter, p = after.join(totals, "history"), F.lit(1.0 / max(1, counts.count()))
        else:
            suffix = below.select(F.col("gram").alias("suffix"), F.col("p").alias("p_below"))
            shorter, p = after.withColumn("suffix", F.substring("gram", 2, k - 1)).join(totals, "history").join(suffix, "suffix"), F.col("p_below")
        below = materialize(shorter.select("gram", ((F.col("n") - d) / F.col("total") + d * F.col("types") / F.col("total") * p).alias("p")))
    return below


def log_ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, gain) of each expression that was counted, and of anything else after each history."""
    shared = continuation_probabilities(grams).select(F.col("gram").alias("suffix"), "p")
    sides = ("toxic", "ordinary")
    d = {c: discount(*ones_and_twos(grams, c)) for c in sides}
    totals = grams.groupBy(history(ORDER - 1)).agg(
        *(F.sum(c).alias(f"{c}_total") for c in sides), *(F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_types") for c in sides)
    )
    # What each class leaves to the shared backoff after a history; all of it where it has not seen the history.
    left = {c: F.when(F.col(f"{c}_total") > 0, F.lit(d[c]) * F.col(f"{c}_types") / F.col(f"{c}_total")).otherwise(F.lit(1.0)) for c in sides}
    totals = materialize(totals.select("history", *(f"{c}_total" for c in sides), *(left[c].alias(f"{c}_left") for c in sides)))
    own = {
        c: F.when(F.col(f"{c}_total") > 0, F.greatest(F.col(c) - d[c], F.lit(0.0)) / F.col(f"{c}_total")).otherwise(F.lit(0.0)) + F.col(f"{c}_left") * F.col("p")
        for c in sides
    }
    joined = grams.withColumns({"history": F.substring("gram", 1, ORDER - 1), "suffix": F.substring("gram", 2, ORDER - 1)}).join(totals, "history").join(shared, "suffix")
    seen = joined.select(F.col("gram").alias("text"), (F.log(own["toxic"]) - F.log(own["ordinary"])).alias("gain"))
    unseen = totals.select(F.col("history").alias("text"), (F.log("toxic_left") - F.log("ordinary_left")).alias("gain"))
    return materialize(keyed(seen)), materialize(keyed(unseen))


# ---------------------------------------------------------------- training


def labelled(docs: DataFrame, labels: DataFrame, config: ToxicityConfig) -> DataFrame:
    """(doc_id, text, toxic) of the documents that may be learned from."""
    flags = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(id_bucket(F.col("doc_id"), config.held_out_mod) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    flags = materialize(flags)
    if flags.count() <= config.broadcast_labels:
        flags = F.broadcast(flags)
    return docs.select("doc_id", "text").join(flags, "doc_id")


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig | None = None) -> ToxicityModel:
    """Fit the models and the curve on the documents whose id hash is not held out."""
    config = config or ToxicityConfig()
    rows = labelled(docs, labels, config)
    # One document stands for all equal texts, so that a much copied text counts once.
    first = materialize(
        rows.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "doc_id", "toxic")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "toxic")).alias("first"))
        .select("key", "first.*")
    )
    sizes = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rows = sum(sizes.values())
    prior = sizes.get(1, 0) / n_rows if n_rows else 0.0
    if min(sizes.get(1, 0), sizes.get(0, 0)) < 4:
        return ToxicityModel(prior=prior)
    order = (F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
    sample = [first.filter(F.col("toxic") == c).orderBy(*order).limit(min(config.calibration_docs, sizes[c] // 4)) for c in (1, 0)]
    sample = materialize(sample[0].unionByName(sample[1]))

    # An id may stand in several rows, so the text's hash is part of a row's name.
    def texts_of(chosen: DataFrame) -> DataFrame:
        chosen = chosen.select("doc_id", F.col("key").alias("_larkbase_key"), "toxic")
        if n_rows <= config.broadcast_labels:
            chosen = F.broadcast(chosen)
        whole = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_larkbase_key"))
        return whole.join(chosen, ["doc_id", "_larkbase_key"])

    counted = first.join(F.broadcast(sample.select("key")), "key", "left_anti")
    grams = materialize(count_expressions(texts_of(counted)))
    gains, unseen = log_ratios(grams)
    model = ToxicityModel(gains, unseen, prior=prior, held=gains.count() + unseen.count() <= config.held_expressions)
    measured = with_features(texts_of(sample).select("toxic", "text"), model)
    found = materialize(measured.select("toxic", *FEATURES)).toArrow().to_pandas()
    model.weights = fit_logistic(found[FEATURES].to_numpy(dtype=float), found["toxic"].to_numpy(dtype=float))
    return model


# ---------------------------------------------------------------- scoring


class Held:
    """The model's numbers in sorted arrays, and those of the words that have been asked for."""

    def __init__(self, gains: tuple[np.ndarray, np.ndarray], unseen: tuple[np.ndarray, np.ndarray]):
        self.gains, self.unseen = gains, unseen
        self.words: dict[str, float] = {}

    @staticmethod
    def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, number) of each key; 0 where it is not."""
        if not len(table[0]):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
        # Distinct keys in order, so that neighbours are looked up one after the other.
        kinds, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(table[0], kinds), len(table[0]) - 1)
        found = table[0][at] == kinds
        return found[back], np.where(found, table[1][at], 0.0)[back]

    def learn(self, words: list[str]) -> None:
        """Log-likelihood differences of new words; NaN for those without a letter or digit."""
        text, starts, owners = spread(words)
        grams, histories = keys(text, starts)
        found, values = self.look_up(self.gains, grams)
        values[~found] = self.look_up(self.unseen, histories[~found])[1]
        totals = np.bincount(owners, values, len(words))
        self.words.update(zip(words, np.where(np.bincount(owners, minlength=len(words)) > 0, totals, np.nan).tolist(), strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """`FEATURES` of each text."""
        out = np.zeros((len(texts), len(FEATURES)))
        for start in range(0, len(texts), TOGETHER):
            part = [(t or "").split() for t in texts[start : start + TOGETHER]]
            if len(self.words) > KEPT:
                self.words.clear()
            if fresh := {w for words in part for w in words if w not in self.words}:
                self.learn(list(fresh))
            for row, words in enumerate(part, start):
                values = np.fromiter(map(self.words.__getitem__, words), float, len(words))
                values = values[~np.isnan(values)]
                if n := len(values):
                    top = values if n <= PEAK else np.partition(values, n - PEAK)[-PEAK:]
                    out[row] = values.sum() / n, top.mean(), math.log1p(n)
        return out


def _shared(model: ToxicityModel):
    """The sorted arrays of the model, for all executors."""
    tables = []
    for df in (model.gains, model.unseen):
        found = df.select("key", "gain").toArrow()
        keys, values = (np.asarray(found.column(c)) for c in ("key", "gain"))
        order = np.argsort(keys, kind="stable")
        tables.append((keys[order], values[order]))
    shared = model.gains.sparkSession.sparkContext.broadcast(tuple(tables))

    return shared


def with_features(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of `docs` with `FEATURES`; columns of these names are replaced."""
    if model.gains is None:
        return docs.drop(*FEATURES).withColumns({c: F.lit(0.0) for c in FEATURES})
    return _features_by_scan(docs, model) if model.held else _features_by_join(docs, model)


def _features_by_scan(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    prepare_python(docs.sparkSession)
    shared = _shared(model)
    kept = [f for f in docs.schema.fields if f.name not in FEATURES]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Held(*shared.value)
        for batch in batches:
            found = own.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(found[:, i]) for i in range(len(FEATURES)))], [*names, *FEATURES])

    out = StructType(list(kept))
    for c in FEATURES:
        out = out.add(c, DoubleType())
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(tidy(run, shared), out)


def _features_by_join(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The same without a table on any executor: words of texts, expressions of distinct words, and back."""
    prepare_python(docs.sparkSession)
    names = [c for c in docs.columns if c not in FEATURES]
    rows = materialize(docs.select(*(F.col(f"`{n}`") for n in names), F.monotonically_increasing_id().alias("_larkbase_row")))

    # Words go by two hashes, as a very long one would be repeated for each of its expressions.
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_larkbase_row").to_pylist(), batch.column("text"), strict=True):
                found = Counter(w for w in (text.as_py() or "").split() if RUNS.search(w.lower()))
                columns = [pa.array([row] * len(found), pa.int64()), pa.array(found, pa.string()), pa.array(found.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["_larkbase_row", "word", "n"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                text, starts, owners = spread(own.column("word").to_pylist())
                of = pa.array(owners)
                yield pa.RecordBatch.from_arrays([own.column("a").take(of), own.column("b").take(of), *map(pa.array, keys(text, starts))], ["a", "b", "key", "history"])

    held = rows.select("_larkbase_row", "text").mapInArrow(words, "_larkbase_row long, word string, n long")
    held = materialize(held.withColumns({"a": F.xxhash64("word"), "b": F.xxhash64(F.lit(7), "word")}))
    grams = held.select("a", "b", "word").dropDuplicates(["a", "b"]).mapInArrow(parts, "a long, b long, key long, history long")
    grams = grams.join(model.gains.select("key", "gain"), "key", "left")
    grams = grams.join(model.unseen.select(F.col("key").alias("history"), F.col("gain").alias("other")), "history", "left")
    values = materialize(grams.groupBy("a", "b").agg(F.sum(F.coalesce("gain", "other", F.lit(0.0))).alias("value")))
    # The most toxic words are the last of a sorted list with as many copies of each word as could matter.
    copies = F.array_repeat("value", F.least(F.col("n"), F.lit(PEAK)).cast("int"))
    texts = held.drop("word").join(values, ["a", "b"]).groupBy("_larkbase_row").agg(
        F.sum(F.col("value") * F.col("n")).alias("total"), F.sum("n").alias("n"), F.flatten(F.collect_list(copies)).alias("values")
    )
    top = F.slice(F.sort_array("values", asc=False), 1, PEAK)
    made = texts.select(
        "_larkbase_row", (F.col("total") / F.col("n")).alias("whole"), (F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)).alias("peak"), F.log1p("n").alias("log_words")
    )
    return rows.join(made, "_larkbase_row", "left").select(*(F.col(f"`{n}`") for n in names), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of `docs` but text, with `score` (0 to 1) and `predicted` (1 from 0.5)."""
    kept = [c for c in docs.columns if c not in ("text", "score", "predicted", *FEATURES)]
    judged = with_features(docs.select(*(F.col(f"`{c}`") for c in kept), "text"), model).withColumn("score", model.column())
    return judged.select(*(F.col(f"`{c}`") for c in kept), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents, with all their columns, whose score is under 0.5."""
    if any(c in FEATURES for c in docs.columns):
        renamed = docs.withColumnsRenamed({c: f"_larkbase_{c}" for c in FEATURES})
        return drop_toxic(renamed, model).withColumnsRenamed({f"_larkbase_{c}": c for c in FEATURES}).select(*(F.col(f"`{c}`") for c in docs.columns))
    return with_features(docs, model).filter(model.column() < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
