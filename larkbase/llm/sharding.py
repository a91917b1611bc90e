"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are put in one global order by range partitioning, each partition sums its sizes, and a prefix
sum over those few totals tells where each partition begins in the whole. A row's shard follows
from the middle of its byte interval: with the total cut at equal targets, no shard is further from
its target than half a row at either end. Only ids, sizes and checksums are moved, never texts.

The order is doc_id (nulls first), then the text's checksum and hash; rows equal in all of these are
interchangeable, so any order among them gives the same rows. A position number breaks their ties
while partitioning, so that even one id held by a third of all rows is dealt over many partitions.
Equal texts are not kept together: the law is equal bytes.

Defined cases: a null text has no bytes and the checksum of the empty text; an empty table gives no
rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkbase.llm.common import materialize

#: Every row weighs this much besides its text.
ROW_BYTES = 8


def assign_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot); slots count from 0 within each shard."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["doc_id", "text_crc32", "text_hash", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the totals and the rows must see the same partitions.
    placed = materialize(materialize(rows).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
    # One row for each partition of the range exchange, so this window and broadcast stay small.
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = materialize(
        placed.withColumns({"bytes_inside": F.sum("size").over(inside), "row_inside": F.count(F.lit(1)).over(inside)})
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"int(({shards} * cast(2 * (bytes_before + bytes_inside) - size as decimal(38,0))) div (2 * all_bytes))").alias("shard"),
            (F.col("rows_before") + F.col("row_inside") - 1).alias("position"),
        )
    )
    starts = cut.groupBy("shard").agg(F.min("position").alias("start"))
    return cut.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("start")).alias("slot")
    )
