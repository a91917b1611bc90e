"""Near copies by the Jaccard similarity of word shingles, for the corpus pipeline.

Two texts are linked if their sets of 5-word shingles have a similarity of at least 0.8, decided on
the whole sets. Texts with equal sets are one node from the start. Candidates come from `simhash`: the
fingerprints of the 5-word shingles meet by their Golay-code keys, and the links within four bits are
checked on the sets.

At a similarity of 0.8 two fingerprints differ in about ten bits, beyond what the keys reach, so what they
leave unconnected has a way of its own: MinHash, `BANDS` keys of `ROWS` minima each, so that a pair at
the threshold meets in no bucket with probability (1 - 0.8^4)^32, about 5e-8, and more similar ones
with less. A bucket's nodes are compared with one centre first, which is another in each of
`STAR_ROUNDS` rounds; what those leave in different components is compared pair by pair.
Pairs that are already connected need no comparison, so a large group of copies is never paired
off. Nor is a large bucket of texts that have little more than a passage in common: of `LARGE_BUCKET` nodes
on, pairs are those that share one of their rarest shingles. That loses none: two sets that lack the first
n - ceil(0.8 n) + 1 of each other's shingles, in any one order, have a similarity below 0.8. Nor is a large
group of near copies that differ from each other: where two sets' first common shingle stands at places i
and j of that order, they share n - i and m - j at most, and pairs for which that is too little are left
out. Before, each is compared with the most ordinary node that has its rare shingle.

Defined cases: a null text is empty; texts without words are copies of each other; a text with fewer
words than a shingle has its whole sequence as the only one; case and white space do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkbase.llm.common import collect_garbage, materialize, prepare_python, tidy, working_files
from larkbase.llm.simhash import SEED, components, fingerprint_of, links, shingle_hashes

SHINGLE = 5
BANDS, ROWS = 32, 4
STAR_ROUNDS = 2
#: From so many nodes on, the pairs of a bucket are told by rare shingles.
LARGE_BUCKET = 33
#: Counts of shingles are held in so many slots, a power of two.
SLOTS = 1 << 20
#: Odd factors of the permutations.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
HASHED_AT_ONCE = 1024


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's shingles."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), HASHED_AT_ONCE):
        x = FACTORS[:, None] * hashes[None, at : at + HASHED_AT_ONCE]
        x ^= x >> np.uint64(32)
        x *= MIX
        least = np.minimum(least, x.min(axis=1))
    raw, width = least.tobytes(), 8 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[b * width : (b + 1) * width], b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def node_of(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _described(rows: DataFrame) -> DataFrame:
    """(_larkbase_row, doc_id, node, n, fingerprint, keys): the set's hash and size, the SimHash, the set's bands."""
    prepare_python(rows.sparkSession)
    kept = rows.select("_larkbase_row", "doc_id", "text")
    names = ["_larkbase_row", "doc_id", "node", "n", "fingerprint", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py() or b"", SHINGLE) for t in batch.column("text").cast(pa.binary())]
            prints = pa.array(np.array(list(map(fingerprint_of, hashes)), np.uint64).view(np.int64))
            sets = list(map(np.unique, hashes))
            made = [pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), prints, pa.array(map(band_keys, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(tidy(run), f"_larkbase_row long, doc_id {kind}, node long, n long, fingerprint long, keys array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, hashes) of (node, text)."""
    prepare_python(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or b"").view(np.int64) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node long, hashes array<long>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is at least 0.8: 9 times the common shingles are 4 times both sizes."""
    one, other = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in ("a", "b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(one, "a").join(other, "b").filter(9 * common >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def similar(n_a: str, n_b: str):
    """Sizes that allow a similarity of 0.8."""
    return 5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)


def rare_shingles(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(hash, at, node, n): the first shingles of each of `members` (node), the rarest first, with their place from 0.
    Rarity is counted by slots of hashes, a table of fixed size; any one order of all hashes loses no pair."""
    spark = members.sparkSession
    prepare_python(spark)
    kept = materialize(members.select("node").join(sets, "node").select("node", "hashes"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount(slots_of(batch.column("hashes").flatten().to_numpy()), minlength=SLOTS)
        held = np.flatnonzero(total)
        for at in range(0, len(held), 10_000):
            part = held[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["slot", "times"])

    found = kept.select("hashes").mapInArrow(tidy(counted), "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(SLOTS, np.int64)
    times[found.column("slot").to_numpy()] = found.column("times").to_numpy()
    sent = spark.sparkContext.broadcast(times)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, held in zip(batch.column("node"), batch.column("hashes"), strict=True):
                hashes = held.values.to_numpy()
                n = len(hashes)
                order = np.lexsort((hashes, sent.value[slots_of(hashes)]))[: n - (4 * n + 4) // 5 + 1]
                columns = [pa.array(hashes[order]), pa.array(np.arange(len(order))), pa.repeat(node, len(order)), pa.repeat(pa.scalar(n, pa.int64()), len(order))]
                yield pa.RecordBatch.from_arrays(columns, ["hash", "at", "node", "n"])

    return materialize(kept.mapInArrow(tidy(first, sent), "hash long, at long, node long, n long"))


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & (SLOTS - 1)).astype(np.int64)


def _met(one: DataFrame, other: DataFrame, apart: Column) -> DataFrame:
    """(a, n, b, n_b) of rows that share a rare shingle. If it is the first that two sets have in common, what stands
    from it on in each is all they can share, and has to be enough."""
    left = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    enough = (9 * left >= 4 * (F.col("n") + F.col("n_b"))) & similar("n", "n_b") & apart
    return one.withColumnRenamed("node", "a").join(other, (F.col("hash") == F.col("hash_b")) & enough).select("a", "n", "b", "n_b")


def rare_stars(rare: DataFrame) -> DataFrame:
    """(a, n, b, n_b) of rows (hash, at, node, n, root): each of a shingle's nodes with the one that has the fewest rarer
    shingles, so the fewest of its own."""
    centres = rare.groupBy("hash").agg(F.min(F.struct("at", "node", "n", "root")).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    centres = centres.filter("low <> high").select(F.col("hash").alias("hash_b"), F.col("c.at").alias("at_b"), F.col("c.node").alias("b"), F.col("c.n").alias("n_b"), F.col("c.root").alias("root_b"))
    return _met(rare, centres, F.col("root") != F.col("root_b"))


def rare_pairs(members: DataFrame, sets: DataFrame, rare: DataFrame | None = None) -> DataFrame:
    """(a, n, b, n_b) of the members (node, n, root) that lie in different components and share a rare shingle at which
    they may have a similarity of 0.8; every pair that has it is there. `rare`: their rare shingles, if made already."""
    rare = rare_shingles(members, sets) if rare is None else rare
    rare = rare.join(members.select("node", "root"), "node")
    sizes = rare.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    split = rare.join(sizes.filter("low <> high").select("hash"), "hash", "left_semi")
    other = split.select(*(F.col(c).alias(f"{c}_b") for c in ("hash", "at", "n", "root")), F.col("node").alias("b"))
    return _met(split, other, F.col("root") < F.col("root_b"))


def golay_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) to be checked: the links of `simhash` among the fingerprints of (node, n, fingerprint). Of nodes with one
    fingerprint, the first stands for it and meets the others."""
    first = materialize(nodes.groupBy("fingerprint").agg(F.min(F.struct("node", "n")).alias("first")).select("fingerprint", "first.*"))
    of_a = first.select(F.col("fingerprint").alias("a"), F.col("node").alias("node_a"), F.col("n").alias("n_a"))
    of_b = first.select(F.col("fingerprint").alias("b"), F.col("node").alias("node_b"), F.col("n").alias("n_b"))
    across = links(first).join(of_a, "a").join(of_b, "b").select("node_a", "n_a", "node_b", "n_b")
    same = nodes.select("fingerprint", F.col("node").alias("node_a"), F.col("n").alias("n_a")).join(of_b, F.col("fingerprint") == F.col("b"))
    pairs = across.unionByName(same.filter("node_a <> node_b").select("node_a", "n_a", "node_b", "n_b"))
    return pairs.filter(similar("n_a", "n_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def roots(rows: DataFrame, described: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a near copy."""
    spark = rows.sparkSession
    nodes = described.groupBy("node").agg(F.min_by(F.struct("n", "fingerprint", "keys"), "_larkbase_row").alias("of"), F.min("_larkbase_row").alias("_larkbase_row"))
    nodes = materialize(nodes.select("node", "_larkbase_row", "of.*"))
    met = materialize(golay_pairs(nodes.select("node", "n", "fingerprint")))
    collect_garbage(spark)
    spread = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    buckets = materialize(spread.join(shared, "key"))
    wanted = buckets.select("node").unionByName(met.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    places = nodes.join(wanted, "node").select("node", "_larkbase_row")
    sets = materialize(_sets(rows.select("_larkbase_row", "text").join(places, "_larkbase_row")))
    collect_garbage(spark)
    edges = materialize(_linked(met, sets))
    found = None if edges.isEmpty() else components(edges)
    # What the keys don't reach: pairs in the buckets that are not connected yet.

    def rooted(rows: DataFrame) -> DataFrame:
        if found is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def connect(pairs: DataFrame) -> None:
        nonlocal edges, found
        pairs = materialize(pairs.filter(similar("n", "n_b")).select("a", "b").distinct())
        collect_garbage(spark)
        if pairs.isEmpty():
            return
        new = materialize(_linked(pairs, sets))
        if not new.isEmpty():
            edges = edges.unionByName(new)
            found = components(edges)

    for k in range(STAR_ROUNDS):
        placed = rooted(buckets)
        centres = placed.groupBy("key").agg(
            F.min(F.struct(F.xxhash64("node", F.lit(k)), "node", "n", "root")).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")
        )
        centres = centres.filter("low <> high").select("key", F.col("c.node").alias("b"), F.col("c.n").alias("n_b"), F.col("c.root").alias("root_b"))
        connect(placed.withColumnRenamed("node", "a").join(centres, "key").filter("root <> root_b"))
    large = materialize(_split(rooted(buckets)).filter(F.col("size") >= LARGE_BUCKET).select("node", "n").distinct())
    if not large.isEmpty():
        rare = rare_shingles(large, sets)
        connect(rare_stars(rooted(rare)))
        connect(rare_pairs(rooted(large), sets, rare))
    small = materialize(_split(rooted(buckets)).filter(F.col("size") < LARGE_BUCKET).drop("size"))
    other = small.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    connect(small.withColumnRenamed("node", "a").join(other, "key").filter("root < root_b"))
    return found if found is not None else spark.createDataFrame([], "node long, root long")


def _split(rows: DataFrame) -> DataFrame:
    """The rows (key, node, n, root) of buckets with more than one component, with the bucket's `size`."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    return rows.join(sizes.filter("low <> high").select("key", "size"), "key")


def drop_near_copies(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents, one of each component: the one with the least id, and of rows with that id any one."""
    rows = materialize(docs.withColumn("_larkbase_row", F.monotonically_increasing_id()))
    with working_files(docs.sparkSession):
        described = materialize(_described(rows))
        ids = described.select("_larkbase_row", "doc_id", "node").join(roots(rows, described), "node", "left")
        ids = materialize(ids.select("_larkbase_row", "doc_id", F.coalesce("root", "node").alias("root")))
        first = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_larkbase_row"))).alias("first"))
        gone = ids.join(first.select(F.col("first._larkbase_row").alias("_larkbase_row")), "_larkbase_row", "left_anti").select("_larkbase_row")
        gone = materialize(gone, keep=True)
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return rows.join(gone, "_larkbase_row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
