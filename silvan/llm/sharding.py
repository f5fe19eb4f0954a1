"""Sharding: longest-processing-time scheduling of groups that must stay together.

Documents with equal texts form a group. Groups are scheduled by size, largest first, each to the least loaded shard,
which a heap gives. The driver must not hold all groups, so what it schedules is bounded: every group above
1 / (`n_shards` * `BIG_PER_SHARD`) of all bytes is an item of its own (there are at most `n_shards` * `BIG_PER_SHARD`),
all other groups fall by their hash into `CHUNKS` chunks and are scheduled by chunk. No group is split. At every size the
same rule holds; chunks only keep what the driver sorts from growing.

Edge cases: null texts count as 0 bytes and form one group; empty texts form another; a very long text is a big group of
its own, and one longer than a shard's share makes its shard the largest; groups of equal size go by their hash, shards of
equal load by number; repeated rows are kept, each with a slot of its own; an empty table gives no rows; other columns,
whatever their names, are ignored by `shard_documents` and kept by `write_shards`, but for one named shard, which is
replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvan.llm.common import columns_of, materialise, scratch, table

CHUNKS = 16_384
BIG_PER_SHARD = 64
#: Bytes of text of a written file, about.
FILE_BYTES = 1 << 29
#: Rows numbered by one window group, on average at most, however large the input.
ROWS_PER_CELL = 50_000


def lpt(items: Iterable[tuple[int, object]], n_shards: int) -> dict[object, int]:
    """Shard of each (size, key): largest first to the least loaded shard; equal sizes by key, equal loads by shard."""
    heap = [(0, shard) for shard in range(n_shards)]
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        # One more hash input keeps null apart from the empty text.
        F.xxhash64(text, text.isNull()).alias("key"),
    )


def plan_shards(keyed: DataFrame, n_shards: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds the shard to rows with a key. It joins two broadcast tables: at most n_shards * BIG_PER_SHARD big
    groups and CHUNKS chunks, so a group of any size stays where its rows are."""
    spark = keyed.sparkSession
    groups = keyed.groupBy("key").agg(F.sum("size").alias("bytes"))
    total = keyed.agg(F.sum("size")).first()[0] or 0
    big = max(1, total // (n_shards * BIG_PER_SHARD) + 1)
    is_big = F.col("bytes") >= big
    items = (
        groups.groupBy(is_big.alias("alone"), F.when(is_big, F.col("key")).otherwise(F.pmod("key", F.lit(CHUNKS))).alias("item"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()
    )
    placed = lpt([(x["bytes"], (x["alone"], x["item"])) for x in items], n_shards)

    def half(which: bool, key: str, shard: str) -> DataFrame:
        mine = [(k, s) for (alone, k), s in placed.items() if alone == which]
        return F.broadcast(spark.createDataFrame(pa.table({key: pa.array([k for k, _ in mine], pa.int64()), shard: pa.array([s for _, s in mine], pa.int32())})))

    large, small = half(True, "key", "shard_large"), half(False, "chunk", "shard_small")

    def attach(df: DataFrame) -> DataFrame:
        df = df.withColumn("chunk", F.pmod("key", F.lit(CHUNKS))).join(large, "key", "left").join(small, "chunk", "left")
        return df.withColumn("shard", F.coalesce("shard_large", "shard_small")).drop("shard_large", "shard_small", "chunk")

    return attach


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and slot, gapless from 0 within the shard.

    Slots are numbered in cells of a shard (by hash of the document) whose number grows with the input, and the cells'
    counts are summed up, so no task numbers a whole shard.
    """
    with scratch(docs.sparkSession) as keep:
        keyed = materialise(_keyed(docs), "shard-keys")
        return keep(_slotted(plan_shards(keyed, n_shards)(keyed), n_shards), "shards")


def _slotted(placed: DataFrame, n_shards: int) -> DataFrame:
    rows = placed.count()
    cells = max(64, -(-rows // (n_shards * ROWS_PER_CELL)))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(starts, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, files_per_shard: int | None = None) -> None:
    """Writes whole documents, all columns, as Parquet under path/shard=N, in files of about FILE_BYTES of text unless their
    number is given. Files are ranges of (shard, a hash of the document), so no task has two shards' share."""
    docs = docs.drop("shard")
    with scratch(docs.sparkSession):
        keyed = materialise(_keyed(docs), "shard-keys")
        attach = plan_shards(keyed, n_shards)
        files = files_per_shard or -(-(keyed.agg(F.sum("size")).first()[0] or 0) // (n_shards * FILE_BYTES)) or 1
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.xxhash64(F.col("text"), F.col("text").isNull()).alias("key"))
    salt = F.pmod(F.xxhash64("row.doc_id", "key"), F.lit(files)).alias("salt")
    dealt = attach(rows).select("row", "shard", salt).repartitionByRange(n_shards * files, "shard", "salt")
    dealt.select("row.*", "shard").write.partitionBy("shard").parquet(path)


def op7_sharding(spark, sf_dir):
    out = shard_documents(table(spark, sf_dir, "documents"), 16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op7_sharding": op7_sharding}
SQL: dict[str, str] = {}
