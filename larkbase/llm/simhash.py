"""Near duplicates by SimHash fingerprints and Golay-code keys.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits, each padded to the 23 bits of
the perfect binary Golay code. Every 23-bit word has one codeword within distance 3; its keys are
the 12-bit indices of all codewords within distance 4, of which there are one or six. Two words at
distance 2 or less always share such a codeword: if the nearest codeword of one is not within 4 of
the other, the two are a word of weight 3 and one of weight 5 around it, and the codeword through
the weight-3 word and one of the added points is within 4 of both.

Fingerprints within 4 bits are found by counting errors over the segments. Either some segment has
none, and then one of the other two has at most two: the key is the exact segment with a Golay key of
the other. Or each has one or two, at most one of them two: the key is a Golay key of that one with a
half of each other segment, since one error leaves a half of it exact. So every linked pair meets in
some bucket, of 33 or 34 key bits, by about 95 keys a fingerprint. Equal fingerprints are merged before.

Each partition of keys is sorted and read as a stream; the pairs in a bucket are verified by their
exact distance, and what leaves a task is a spanning forest of the links it has found, never all pairs
of a group. In a large bucket everything is first compared with one member after the other that is not
linked yet, which links a group of near copies without its pairs; then only pairs that these left
unconnected are compared, within five exact blocks of 12 or 13 bits, one of which any linked pair
shares. A bucket beyond what one task should hold is passed on, and dealt by those blocks to others.
Components follow from the forests by large-star and small-star rounds in Spark, in which the edges of
a node with very many are dealt to several tasks.

Defined cases: a null text is empty; texts without a word have fingerprint zero and are linked like
any others; texts with fewer words than a shingle have their whole sequence as the only shingle; rows
with equal ids are rows of their own; a component whose ids are all null has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from larkbase.llm.common import join_each, materialize, prepare_python, tidy, working_files

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (first bit, number of bits) of each segment.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: (first bit, number of bits) of the blocks that cut a large bucket.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
LARGE_BUCKET = 2048
#: Members of a large bucket that all others are compared with.
STARS = 24
#: Rows of a bucket that one task takes; the rows of a larger one are passed on.
HELD_BUCKET = 2_000_000
HASHED_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a UTF-8 text's shingles in their order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of a text's shingle hashes, as an unsigned 64-bit number; zero without any."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HASHED_AT_ONCE):
        part = hashes[at : at + HASHED_AT_ONCE].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text, as an unsigned 64-bit number."""
    return fingerprint_of(shingle_hashes(text, shingle))


@lru_cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each single bit, all error patterns of up to four bits by syndrome, -1 filling up to six)."""
    powers = np.zeros(23, dtype=np.int64)
    value = 1
    for i in range(23):
        powers[i] = value
        value <<= 1
        if value >> 11:
            value ^= GENERATOR
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= int(powers[b])
            patterns[syndrome].append(sum(1 << b for b in bits))
    table = np.full((2048, 6), -1, dtype=np.int64)
    for s, found in enumerate(patterns):
        table[s, : len(found)] = found
    return powers, table


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each 23-bit word; -1 fills up to six."""
    powers, table = golay_tables()
    syndrome = np.zeros(len(words), dtype=np.int64)
    for b in range(23):
        syndrome ^= np.where((words >> b) & 1, powers[b], 0)
    errors = table[syndrome]
    # The code is systematic: a codeword is told by its upper twelve bits.
    return np.where(errors >= 0, (words[:, None] ^ np.maximum(errors, 0)) >> 11, -1)


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) of every bucket of each fingerprint (int64 in, int64 out)."""
    bits = prints.view(np.uint64)
    exact = [((bits >> np.uint64(first)) & np.uint64((1 << n) - 1)).astype(np.int64) for first, n in SEGMENTS]
    halves = [(e >> 11, e & 0x7FF) for e in exact]
    near = [golay_keys(e) for e in exact]
    keys, owners = [], []

    def put(tag: int, whole: np.ndarray, golay: np.ndarray) -> None:
        valid = golay >= 0
        keys.append(((tag << 40) | (whole[:, None] << 12) | golay)[valid])
        owners.append(np.broadcast_to(prints[:, None], golay.shape)[valid])

    for y in range(3):
        x, z = (s for s in range(3) if s != y)
        put(1 + x + 3 * y, exact[x], near[y])
        put(1 + z + 3 * y, exact[z], near[y])
        for i, one in enumerate(halves[x]):
            for j, other in enumerate(halves[z]):
                put(16 + 4 * y + 2 * i + j, one << 11 | other, near[y])
    return np.concatenate(keys), np.concatenate(owners)


class Forest:
    """Union-find over the fingerprints that have links."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def link_runs(keys: np.ndarray, prints: np.ndarray, forest: Forest, max_bits: int = MAX_BITS) -> None:
    """Verify the pairs of rows with the same key; equal keys stand together."""
    if len(keys) < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    large = sizes > LARGE_BUCKET
    for start, size in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
        link_large(np.unique(prints[start : start + size]), forest, max_bits)
    if large.any():
        small = np.repeat(~large, sizes)
        keys, prints = keys[small], prints[small]
    at, shift = np.arange(len(keys)), 1
    while True:
        at = at[: np.searchsorted(at, len(keys) - shift)]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            return
        _join(prints[at], prints[at + shift], forest, max_bits)
        shift += 1


def _join(x: np.ndarray, y: np.ndarray, forest: Forest, max_bits: int) -> None:
    linked = (np.bitwise_count((x ^ y).view(np.uint64)) <= max_bits) & (x != y)
    for a, b in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
        forest.join(a, b)


def link_large(prints: np.ndarray, forest: Forest, max_bits: int = MAX_BITS) -> None:
    """Connect distinct fingerprints, all that are linked, without comparing pairs that are connected already."""
    # label: the first member found linked to each, itself if none; members of one label are connected.
    label = np.arange(len(prints))
    alone = np.arange(len(prints))
    for _ in range(STARS):
        if len(alone) < 2:
            break
        centre = alone[len(alone) // 2]
        near = np.bitwise_count((prints ^ prints[centre]).view(np.uint64)) <= max_bits
        held = np.unique(label[near])
        for i in np.flatnonzero(near).tolist():
            forest.join(int(prints[i]), int(prints[centre]))
        label[np.isin(label, held)] = held[0]
        counts = np.bincount(label, minlength=len(prints))
        alone = np.flatnonzero((counts[label] == 1) & (np.arange(len(prints)) != centre))
    for first, n in BLOCKS:
        block = (prints.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << n) - 1)
        order = np.argsort(block, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            members = order[a:b]
            kinds, sizes = np.unique(label[members], return_counts=True)
            if len(kinds) < 2:
                continue
            # All but the most frequent label meet all members.
            others = members[label[members] != kinds[sizes.argmax()]]
            for at in range(0, len(others), max(1, (1 << 22) // len(members))):
                part = others[at : at + max(1, (1 << 22) // len(members))]
                i, j = np.nonzero(np.bitwise_count((prints[part][:, None] ^ prints[members][None, :]).view(np.uint64)) <= max_bits)
                apart = label[part[i]] != label[members[j]]
                for x, y in zip(prints[part[i[apart]]].tolist(), prints[members[j[apart]]].tolist(), strict=True):
                    forest.join(x, y)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """All columns of the documents but text, with `fingerprint` as a signed long."""
    prepare_python(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("text", "fingerprint")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(prints.view(np.int64))], [*names, "fingerprint"])

    return docs.select(*(F.col(f"`{n}`") for n in names), "text").mapInArrow(tidy(run), StructType(kept).add("fingerprint", LongType()))


def links(prints: DataFrame) -> DataFrame:
    """(a, b) with b < a: a forest that connects all fingerprints within four bits. `prints` are distinct."""
    prepare_python(prints.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2000):
                keys, owners = bucket_keys(values[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], ["key", "fingerprint"])

    keyed = prints.select("fingerprint").mapInArrow(tidy(spread), "key long, fingerprint long")
    met = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: meet(b, HELD_BUCKET), "a long, b long, key long"))
    edges = met.filter("key IS NULL").select("a", "b")
    over = met.filter("key IS NOT NULL").select("key", F.col("a").alias("fingerprint"))
    if over.isEmpty():
        return edges
    # Buckets that were too large for one task, dealt by exact blocks. A linked pair shares one of them.
    blocks = F.array(*(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fingerprint", first).bitwiseAND((1 << n) - 1).alias("v")) for i, (first, n) in enumerate(BLOCKS)))
    dealt = over.select("fingerprint", "key", F.explode(blocks).alias("block")).select(F.xxhash64("key", "block.i", "block.v").alias("key"), "fingerprint")
    again = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: meet(b, None), "a long, b long, key long")
    return edges.unionByName(again.select("a", "b"))


def meet(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """(a, b, null): a forest of the links among rows (key, fingerprint) in the order of the keys; and (fingerprint,
    null, key) of buckets with more than `most` rows."""
    forest, over = Forest(), None
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def passed(keys: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(owners), pa.nulls(len(owners), pa.int64()), pa.array(keys)], ["a", "b", "key"])

    for batch in batches:
        keys, owners = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if over is not None:
            end = int(np.searchsorted(keys, over, side="right"))
            if end:
                yield passed(keys[:end], owners[:end])
            keys, owners = keys[end:], owners[end:]
            if len(keys):
                over = None
        if not len(keys):
            continue
        parts.append((keys, owners))
        waiting += len(keys)
        whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if whole or parts[0][0][0] != keys[-1]:
            held = [np.concatenate([p[i] for p in parts]) for i in (0, 1)]
            cut = len(held[0]) - (len(keys) - whole)
            link_runs(held[0][:cut], held[1][:cut], forest)
            parts, waiting = [(keys[whole:], owners[whole:])], len(keys) - whole
        if most is not None and waiting > most:
            over = int(keys[-1])
            for p in parts:
                yield passed(*p)
            parts, waiting = [], 0
    if parts:
        link_runs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), forest)
    found = np.array(forest.edges(), dtype=np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.int64())], ["a", "b", "key"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root), the root being the least node of the component; nodes without edges are left out.

    Rounds go on until nothing changes, which takes about the logarithm of the longest path, squared at most.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        # What a round has written on the way is deleted with its end.
        with working_files(spark):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count(F.lit(1)).alias("n")))
            large = join_each(both.filter("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
            large = materialize(large)
            low = materialize(large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")))
            small = join_each(large, low, "a", "b").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
            edges = materialize(small.filter("a <> b").distinct(), keep=True)
        # Rounds end when every node has one edge, to its root, and no root has one.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def group(docs: DataFrame) -> DataFrame:
    """The documents without text, with fingerprint (16 hexadecimal digits), component_id and
    component_root, the least fingerprint of the component."""
    made = ("component_id", "component_root")
    printed = materialize(with_fingerprints(docs).drop(*made))
    distinct = materialize(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct))
    placed = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "n", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    placed = materialize(placed)
    least = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    by_print = materialize(join_each(placed.withColumnRenamed("n", "copies"), least, "root", "fingerprint").select("fingerprint", F.col("copies").alias("n"), "component_id", F.col("root").alias("component_root")))
    names = [c for c in printed.columns if c not in ("fingerprint", "_larkbase_deal_by")]
    return join_each(printed.withColumn("_larkbase_deal_by", F.monotonically_increasing_id()), by_print, "fingerprint", "_larkbase_deal_by").select(
        *(F.col(f"`{n}`") for n in names), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "component_root"
    )


def drop_near_copies(docs: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents, one of each component: the one with the least id, and of rows with that id any one."""
    rows = materialize(docs.withColumn("_larkbase_row", F.monotonically_increasing_id()))
    ids = group(rows.select("doc_id", "text", "_larkbase_row"))
    ids = materialize(ids.select("_larkbase_row", "doc_id", "component_root"))
    first = ids.groupBy("component_root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_larkbase_row"))).alias("first"))
    gone = materialize(ids.join(first.select(F.col("first._larkbase_row").alias("_larkbase_row")), "_larkbase_row", "left_anti").select("_larkbase_row"))
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)
    return rows.join(gone, "_larkbase_row", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
