"""Removal of widespread lines with levelled sorted runs of line hashes.

`LineRuns` is a log-structured store of (line hash, number of documents so far). A run is a Parquet
table bucketed and sorted by the hash, so that merging runs, and a batch with runs, moves nothing but
the batch. A batch of documents is counted and merged with the runs: keys that some run already knows
to be widespread are anti-joined, since another count changes nothing; the others are written, with
what the runs have counted before added, as a new run of level 0. Whenever a level holds `fanout` runs,
they are merged into one run of the next level, so each key is rewritten once a level. A key that has
become widespread stands so in exactly one run, so that the widespread keys are a plain scan. A manifest
names the runs of each version; a later call, or another session, opens the store again by its path.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased. Keys are
held as two 64-bit hashes, of the key and of the reversed key. Rows are known by a number that they get
as they are first written to the shared folder. Only numbers, hashes and positions are moved; in the end
the positions to drop are joined to the rows that lose a line, and cut out in time linear in the lines.

Defined cases: a null or empty text is one empty line; keys shorter than `min_chars` never count;
a key counts once a document however often it repeats there; every row is a document of its own,
even if its doc_id repeats or is null; all columns of the documents stay, whatever their names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbase.llm.common import file_system, materialize, scratch_dir

LINE = ["line_a", "line_b"]
ROW, TEXT = "_larkbase_row", "_larkbase_text"
#: Widespread lines of up to this many are sent to all executors (about 24 bytes each).
BROADCAST_LINES = 500_000
#: Rows that lose a line, and the positions they lose, up to which they are sent to all executors (some 60 MB).
BROADCAST_ROWS, BROADCAST_POSITIONS = 500_000, 5_000_000


def line_key(line: Column) -> Column:
    """The key of one line. ASCII lines, which lower() treats alike, take the faster way."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(
        F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


class LineRuns:
    """Sorted runs of (line_a, line_b, n_docs, first) by level, under a path that driver and executors share.

    `first` is the hash of the text that had the line first: the least one of the first batch with it.
    """

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 10, fanout: int = 2, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.names: dict[str, str] = {}
        found = self._manifest()
        if found and found["min_docs"] != min_docs:
            raise ValueError(f"the runs at {path} were made for lines of {found['min_docs']} documents")
        self.version = found["version"] if found else 0
        self.min_docs, self.fanout = min_docs, fanout
        self.buckets = found["buckets"] if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = found["levels"] if found else []

    # -- what is stored

    def _manifest(self) -> dict | None:
        fs, at = file_system(self.spark, self.path)
        versions = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(n[9:-5]) for n in versions if n.startswith("manifest-") and n.endswith(".json")]
        if not numbers:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{max(numbers)}.json", wholetext=True).first()[0])

    def _publish(self) -> None:
        """A new version names the runs; the file of a version is made once, so two writers can't both make it."""
        self.version += 1
        made = {"version": self.version, "min_docs": self.min_docs, "buckets": self.buckets, "levels": self.levels}
        fs, at = file_system(self.spark, f"{self.path}/manifest-{self.version}.json")
        out = fs.create(at, False)
        out.write(json.dumps(made).encode())
        out.close()

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed table of this session."""
        if name not in self.names:
            table = f"larkbase_{name.replace('-', '_')}_{uuid.uuid4().hex[:8]}"
            columns = "line_a BIGINT, line_b BIGINT, n_docs BIGINT, first BIGINT"
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (line_a, line_b) SORTED BY (line_a, line_b) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
            self.names[name] = table
        return self.spark.table(self.names[name])

    def runs(self) -> list[DataFrame]:
        return [self.run(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        table = f"larkbase_{name.replace('-', '_')}"
        rows.write.bucketBy(self.buckets, *LINE).sortBy(*LINE).option("path", f"{self.path}/{name}").saveAsTable(table)
        self.names[name] = table
        return name

    # -- batches

    def add(self, batch: DataFrame) -> None:
        """Add a batch, given as (line_a, line_b, n_docs, first), one row for each of its keys."""
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            batch = batch.repartition(self.buckets, *LINE)
        merged, counts, firsts = batch, [], []
        for i, run in enumerate(self.runs()):
            merged = merged.join(run.select(*LINE, F.col("n_docs").alias(f"n{i}"), F.col("first").alias(f"f{i}")), LINE, "left")
            counts.append(F.col(f"n{i}"))
            firsts.append(F.col(f"f{i}"))
        if counts:
            # The newest run with a key has its greatest count.
            before = F.greatest(F.lit(0), F.lit(0), *counts)
            merged = merged.filter(before < self.min_docs).select(
                *LINE, (F.col("n_docs") + before).alias("n_docs"), F.coalesce(F.array_min(F.array(*firsts)), "first").alias("first")
            )
        self._put(merged.select(*LINE, F.col("n_docs").cast("long"), "first"), 0)
        self._publish()

    def _put(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(rows))
        if len(self.levels[level]) >= self.fanout:
            first, *rest = self.levels[level]
            for name in rest[:-1]:  # two by two, so that nothing is moved
                first = self._write(self.compaction(first, name))
            merged = self.compaction(first, rest[-1])
            self.levels[level] = []
            self._put(merged, level + 1)

    def compaction(self, one: str, other: str) -> DataFrame:
        """Two runs merged bucket by bucket."""
        right = self.run(other).withColumnsRenamed({"n_docs": "n2", "first": "f2"})
        return self.run(one).join(right, LINE, "full").select(*LINE, F.greatest("n_docs", "n2").alias("n_docs"), F.least("first", "f2").alias("first"))

    def widespread(self) -> DataFrame:
        """(line_a, line_b, first) of the lines of at least `min_docs` documents; a scan, as a key is so in one run."""
        found = [run.filter(F.col("n_docs") >= self.min_docs).select(*LINE, "first") for run in self.runs()]
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        return out

    def vacuum(self) -> None:
        """Delete runs and manifests that the newest version doesn't need."""
        fs, at = file_system(self.spark, self.path)
        named = {n for level in self.levels for n in level} | {f"manifest-{self.version}.json"}
        for s in fs.listStatus(at):
            if s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)

    def close(self) -> None:
        """Take the tables out of the session; their files stay."""
        for table in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.names = {}


def _lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(row, text hash, line_a, line_b, at): one row for each document and distinct key, with its positions."""
    # Made before the rows multiply. The outer form of explode, as Spark would test an inner one's array by making it twice.
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)
    counted = F.filter("keys", lambda k: F.length(k) >= min_chars)
    keyed = rows.select(ROW, F.xxhash64(F.coalesce("text", F.lit(""))).alias(TEXT), keys.alias("keys")).withColumn(
        "repeats", F.size(F.array_distinct(counted)) < F.size(counted)
    )
    each = (
        keyed.select(ROW, TEXT, "repeats", F.posexplode_outer("keys").alias("pos", "key"))
        .filter(F.length("key") >= min_chars)
        .select(ROW, TEXT, "repeats", "pos", F.xxhash64("key").alias(LINE[0]), F.xxhash64(F.reverse("key"), F.lit(7)).alias(LINE[1]))
    )
    return materialize(each)


def drop_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batch_bits: int = 2, fanout: int = 2, keep_first: bool = False, store: str | None = None
) -> DataFrame:
    """The documents, `text` without widespread lines, with `n_lines` before and `n_dropped`.

    With `keep_first`, a widespread line stays in the text that had it first, and in its copies. The
    documents are added in 2 ** `batch_bits` batches by text hash. `store` is the path of runs that
    outlive the call: the documents of earlier calls count then too, and those of this one are added.
    Columns that are already called n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = materialize(docs.select(*(F.col(f"`{c}`") for c in names), F.monotonically_increasing_id().alias(ROW)))
    each = _lines(rows, min_chars)
    # Only documents that repeat a key need their lines brought together.
    once = each.filter("NOT repeats").select(ROW, TEXT, *LINE, F.array("pos").alias("at"))
    often = each.filter("repeats").groupBy(ROW, TEXT, *LINE).agg(F.collect_list("pos").alias("at"))
    often = materialize(often)
    lines = once.unionByName(often)
    batch = (F.shiftright(TEXT, 64 - batch_bits) + (1 << batch_bits >> 1)).cast("int")
    path = store or f"{scratch_dir(spark)}/larkbase/{uuid.uuid4().hex}"
    runs = LineRuns(spark, path, min_docs, fanout)
    for b in range(1 << batch_bits):
        counts = lines.filter(batch == b).groupBy(*LINE).agg(F.count(F.lit(1)).alias("n_docs"), F.min(TEXT).alias("first"))
        runs.add(counts)
    found = materialize(runs.widespread())
    runs.close()
    if store is None:
        fs, at = file_system(spark, path)
        fs.delete(at, True)
    if found.count() <= BROADCAST_LINES:
        found = F.broadcast(found)
    held = lines.join(found, LINE)
    if keep_first:
        held = held.filter(F.col(TEXT) != F.col("first"))
    hits = materialize(held.groupBy(ROW).agg(F.flatten(F.collect_list("at")).alias("_larkbase_drop")))
    size = hits.agg(F.count(F.lit(1)), F.sum(F.size("_larkbase_drop"))).first()
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_POSITIONS:
        hits = F.broadcast(hits)
    joined = rows.join(hits, ROW, "left").withColumn("_larkbase_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    # array_except goes through a hash set and keeps the order.
    left = F.array_except(F.sequence(F.lit(0), F.size("_larkbase_lines") - 1), "_larkbase_drop")
    kept = F.when(F.col("_larkbase_drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("_larkbase_lines", i)), "\n")
    )
    return joined.select(
        *((kept if c == "text" else F.col(f"`{c}`")).alias(c) for c in names),
        F.size("_larkbase_lines").cast("long").alias("n_lines"),
        F.when(F.col("_larkbase_drop").isNull(), F.lit(0)).otherwise(F.size("_larkbase_drop")).cast("long").alias("n_dropped"),
    )
