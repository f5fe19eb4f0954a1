"""An index for keyword search: which rows hold which three characters in a row, and searches that read only its postings.

The index is a table of (gram, ids of some rows that have it) in order of gram, in folders by the gram's hash, for lower-cased text. A query's
literal stretches (what is between its wildcards % and _) of three characters and more give its grams; the rows that have
all of them are candidates, and the same case-insensitive match as in the search without an index decides. A query
without such a stretch, or with a backslash, which escapes wildcards, has no grams: it is answered by the scan.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvan.operators import search

BUCKETS = 64
#: Tasks that a bucket's lists are dealt over, by their first id.
PARTS = 16
#: Bytes of text from which lists of ids are made at once; what a task holds is some twenty times as much.
STRETCH = 1 << 21
#: Of a query's grams, so many of the rarest are looked up: each more costs a read of its postings and takes out few.
LOOKUPS = 4
#: Candidates that are handed to all tasks; with more of them, rows and candidates are joined by id.
BROADCAST_IDS = 1_000_000


def grams(text: Column) -> Column:
    """The distinct grams of a text, lower-cased. Characters are cut once, so a long text takes linear time."""
    chars = F.split(F.lower(text), "")
    three = F.arrays_zip(chars.alias("a"), F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))).alias("b"), F.slice(chars, 3, F.greatest(F.size(chars), F.lit(1))).alias("c"))
    return F.array_distinct(F.filter(F.transform(three, lambda x: F.concat(x["a"], x["b"], x["c"])), lambda g: g.isNotNull()))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(BUCKETS)).cast("int")


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts one after another, and how many each text has."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if not len(data) or data.max() < 0x80:
        return data.astype(np.int32), np.diff(ends)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    width = np.minimum(np.diff(np.append(first, len(data))), 4)
    chars = data[first] & np.array([0x7F, 0x1F, 0x0F, 0x07], np.int32)[width - 1]
    for k in range(1, 4):
        wide = np.flatnonzero(width > k)
        chars[wide] = chars[wide] << 6 | data[first[wide] + k] & 0x3F
    return chars, np.diff(np.searchsorted(first, ends - ends[0]))


def _lists(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """gram, n, ids of rows (id and texts): the ids of the rows that have a gram. Gram and row are one number, so a sort
    gives the lists; rows with too many different characters for that are cut in halves."""
    found = [_code_points(rows.column(k)) for k in range(1, rows.num_columns)]
    chars = np.concatenate([c for c, _ in found])
    alphabet = np.flatnonzero(np.bincount(chars))
    size, bits = len(alphabet), rows.num_rows.bit_length()
    if rows.num_rows > 1 and size**3 << bits >= 1 << 64:
        half = rows.num_rows // 2
        yield from _lists(rows.slice(0, half))
        yield from _lists(rows.slice(half))
        return
    cell = np.repeat(np.arange(len(found) * rows.num_rows, dtype=np.int32), np.concatenate([n for _, n in found]))
    inside = cell[:-2] == cell[2:]
    if not inside.any():
        return
    digit = np.zeros(alphabet[-1] + 1, np.uint64)
    digit[alphabet] = np.arange(size)
    d, base = digit[chars], np.uint64(size)
    keys = ((d[:-2] * base + d[1:-1]) * base + d[2:])[inside] << np.uint64(bits)
    keys |= (cell[:-2][inside] % rows.num_rows).astype(np.uint64)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    code, row = keys >> np.uint64(bits), keys & np.uint64((1 << bits) - 1)
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    letter = [chr(min(c, 0x10FFFF)).encode("utf-8", "replace").decode() for c in alphabet.tolist()]
    texts = [letter[g // size**2] + letter[g // size % size] + letter[g % size] for g in code[begin].tolist()]
    ends = np.append(begin, len(keys))
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.column(0).take(pa.array(row)))
    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(np.diff(ends)), ids], ["gram", "n", "ids"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts come to STRETCH bytes."""
    for batch in batches:
        size = np.cumsum(sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]))
        edge = [0, *(np.flatnonzero(np.diff(size // STRETCH)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(lo, hi - lo) for lo, hi in itertools.pairwise(edge) if hi > lo)


def write_index(rows: DataFrame, path: str, columns: Sequence[str], id_: str = "unit_id") -> None:
    """The postings of rows, and how many each gram has. Each stretch of rows gives one list of ids for each of its grams, so a
    gram's postings are many lists, none larger than a stretch, and are dealt over PARTS tasks however frequent it is."""
    texts = rows.select(F.col(id_).alias("id"), *(F.coalesce(F.lower(F.col(c)), F.lit("")).alias(f"t{k}") for k, c in enumerate(columns)))
    kind = texts.schema["id"].dataType.simpleString()
    lists = texts.mapInArrow(lambda batches: (x for s in _stretches(batches) for x in _lists(s)), f"gram string, n long, ids array<{kind}>")
    dealt = lists.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(PARTS)))
    dealt.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    counts = rows.sparkSession.read.parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")


def query_grams(query: str) -> list[str]:
    """The grams that every match has; none if the query has to be scanned for."""
    if "\\" in query:
        return []
    return list(dict.fromkeys(s[k : k + 3] for s in re.split("[%_]", query.lower()) for k in range(len(s) - 2)))


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """Ids of the rows that have the query's rarest grams; None if it has no grams."""
    wanted = query_grams(query)
    if not wanted:
        return None
    within = lambda df, some: df.filter(F.col("bucket").isin(sorted({zlib.crc32(g.encode()) % BUCKETS for g in some})) & F.col("gram").isin(some))
    counted = {r["gram"]: r["n"] for r in within(spark.read.parquet(f"{path}/counts"), wanted).collect()}
    rare = sorted(wanted, key=lambda g: (counted.get(g, 0), g))[:LOOKUPS]
    held = within(spark.read.parquet(f"{path}/postings"), rare)
    return held.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select("id")


def _narrowed(rows: DataFrame, ids: DataFrame, id_: str) -> DataFrame:
    ids = ids.withColumnRenamed("id", id_)
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, id_, "left_semi")


def keyword(units: DataFrame, corpora: DataFrame, path: str, query: str, **page) -> DataFrame:
    """`search.keyword` through an index over text, label and path: the same rows. A corpus whose name matches brings all of its
    units, so these are looked up by its id."""
    ids = candidates(units.sparkSession, path, query)
    if ids is None:
        return search.keyword(units, corpora, query, **page)
    named = corpora.filter(search.matches_any(query, "name")).select("corpus_id")
    whole = units.join(F.broadcast(named), "corpus_id", "left_semi")
    others = units.join(F.broadcast(named), "corpus_id", "left_anti")
    return search.keyword(whole.unionByName(_narrowed(others, ids, "unit_id")), corpora, query, **page)


def autocomplete(units: DataFrame, path: str, query: str, height: int | None = None, limit: int = 20) -> DataFrame:
    """`search.autocomplete` through an index over text, label and path: the same rows."""
    ids = candidates(units.sparkSession, path, query)
    return search.autocomplete(units if ids is None else _narrowed(units, ids, "unit_id"), query, height, limit)
