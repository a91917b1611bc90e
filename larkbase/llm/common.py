"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs without ASCII white space; `bytes.split()` cuts at the same six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of one Arrow batch, where the session doesn't say: a run of very long texts, and the tables that
#: workers hold besides, stay small.
ARROW_BATCH_BYTES = 8 << 20


#: Temporary folders by application, where the session names none and all is local.
_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`). Where it is unset, a local master
    gets a temporary one; a cluster's executors could not see that, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _own_dirs.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="larkbase-")
        _own_dirs[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


_scopes: list[list[str]] = []


@contextmanager
def working_files(spark: SparkSession) -> Iterator[None]:
    """Deletes, in the end, what operators have materialized inside. What is read lazily from it has to be
    written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            fs, at = file_system(spark, path)
            fs.delete(at, True)


def materialize(df: DataFrame, partition_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back.

    This cuts the lineage, and what is read later is the same rows even if executors are lost and
    tasks run again. The files live until the innermost `working_files` ends, with `keep` until the one around
    it; without one, as long as the folder, since lazily read results point at them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/larkbase/{uuid.uuid4().hex}"
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers
    can import it wherever the driver has it from."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="larkbase-ship-")) / "larkbase_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def prepare_python(spark: SparkSession) -> None:
    """Make the package importable on executors, and limit Arrow batches by bytes as well as by rows: one
    limit for all operators, unless the session has its own."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shared_file(spark: SparkSession, path: str) -> Callable[[], tuple[str, bytes]]:
    """The file's digest and bytes on any executor, whose disks need not have it. The driver reads it, or Spark
    does where the path names a file system."""
    raw = bytes(spark.read.format("binaryFile").load(path).first()["content"]) if "://" in path else Path(path).read_bytes()
    digest, shared = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)
    return lambda: (digest, shared.value)


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level pieces: printable bytes stand for themselves, and the
    characters from 256 on for the others, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def tidy(run: Callable[[Iterator], Iterator], *shared) -> Callable[[Iterator], Iterator]:
    """The same function over batches; when it ends, what its worker has freed goes back to the system, and the
    values of broadcasts are let go, as idle workers stay beside the JVM's own stages."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for b in shared:
                b.__dict__.pop("_value", None)  # read again from its file when next asked for
            gc.collect()
            trim_native()

    return tidied


def trim_native() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """What the driver's JVM and Python have freed outside the heap goes back to the system; it stays in the
    allocator's arenas otherwise, a quarter of a GB after some hundred jobs. A JVM without the command keeps it."""
    java, javax, gateway = spark._jvm.java, spark._jvm.javax, spark.sparkContext._gateway
    with suppress(Py4JError):
        server = java.lang.management.ManagementFactory.getPlatformMBeanServer()
        named = javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        kinds, values = gateway.new_array(java.lang.Class, 4), gateway.new_array(java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = java.lang.Class.forName(kind)
        values[0], values[1] = named, "systemTrimNativeHeap"
        values[2], values[3] = gateway.new_array(java.lang.Object, 0), gateway.new_array(java.lang.String, 0)
        # The server's own class is closed to reflection, its interface is not.
        java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)
    trim_native()


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files that nothing points at any more are deleted once the driver has collected its garbage; the
    executors' heaps give what they have free back to the system when they do, and their Python workers need it."""
    gc.collect()
    spark._jvm.java.lang.System.gc()
    trim_driver(spark)
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a key table that are sent to all executors (some 40 bytes each), and rows of one key that one task takes.
SENT_KEYS, ROWS_OF_TASK = 1_000_000, 100_000


def join_each(rows: DataFrame, each: DataFrame, key: str, dealt_by: str) -> DataFrame:
    """Inner join of rows with `each`, one row for each key with `n`, how many rows have it. A large table is
    joined by shuffling; rows of a frequent key are then dealt to several tasks by a hash of column `dealt_by`."""
    if each.count() <= SENT_KEYS:
        return rows.join(F.broadcast(each.drop("n")), key)
    # There are at most rows / ROWS_OF_TASK frequent keys.
    tasks = F.ceil(F.col("n") / ROWS_OF_TASK).cast("int")
    frequent = each.filter(F.col("n") > ROWS_OF_TASK).select(key, tasks.alias("_larkbase_tasks"))
    dealt = rows.join(F.broadcast(frequent), key, "left").withColumn("_larkbase_deal", F.pmod(F.xxhash64(dealt_by), F.coalesce("_larkbase_tasks", F.lit(1))).cast("int"))
    repeated = each.withColumn("_larkbase_deal", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("n")
    return dealt.drop("_larkbase_tasks").join(repeated, [key, "_larkbase_deal"]).drop("_larkbase_deal")
