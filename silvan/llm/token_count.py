"""Token counts by separator scan over flat, unindexed token files.

A token file is a run of little-endian unsigned 16- or 32-bit ids in which an end id closes each document, and nothing
else. It is read by byte ranges, each in blocks that know nothing of documents: a range is a file's name, an offset and a
length, all derived from the file's size. Each block is searched for the end id as one array. What a block leaves open
before its first and after its last end is stitched by a prefix scan over the blocks' summaries (number of ends, length
of the open tail), so no task sees more than a block's tokens. The scan runs within a file, as a document does not go on
in the next one; a file's summaries are one narrow row per block.

`write_token_files` writes such files and a table of its own that says which document is which in a file. A task writes
files under names of its own attempt and gives their names as rows, so an attempt that is lost or repeated leaves at most
files that no row names. Files are opened through pyarrow by their URI, so the folder must be one that driver and
executors share.

Edge cases: ids after a file's last end are a document that is not closed (closed = false); two ends in a row are a
document of 0 tokens; a file without ids has no documents; block boundaries fall anywhere, on an end too; a file whose
length is not a whole number of ids is an error, unless the files to be counted are named and it isn't one of them; repeated rows are documents of their own. In `write_token_files`, a null
or empty text is a document of 0 tokens; long texts are read whole and go through several blocks; the name of a special
token in a text is ordinary text, so an end id closes a document and stands nowhere else; an id that does not fit the
width, or is the end id, is an error; an empty table gives no files and no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvan.llm.common import materialise, scratch, scratch_path, table
from silvan.llm.packing import encoder, vocabulary_path

#: <|endoftext|> of the vocabulary.
END = 50_256
BLOCK_TOKENS = 1 << 16
#: Ids of a range, whose file a task opens once: 64 MB of 16-bit ids.
RANGE_TOKENS = 1 << 25
#: A file is closed after so many ids or documents.
FILE_TOKENS, DOCS_PER_FILE = 1 << 26, 10_000


def _store(path: str):
    """pyarrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path if path.startswith("/") else path)


def _local(path: str) -> str:
    """file:/a and file:///a are the same to Spark; pyarrow takes the second."""
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:/") else path


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, width: int = 2, docs_per_file: int = DOCS_PER_FILE, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes token files into folder when the rows are asked for; file, nth (from 0 within the file), doc_id of each document.

    A task holds one document's ids at a time. The rows must be written or kept once: asked for again, they are new files.
    """
    path, folder = vocabulary or vocabulary_path(), _local(folder)
    if width not in (2, 4) or not 0 <= end < 1 << 8 * width:
        raise ValueError("ids are of 2 or 4 bytes, and the end id must fit")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dtype = encoder(path), f"<u{width}"
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, nth, held = None, "", 0, 0
        try:
            for batch in batches:
                names, places = [], []
                for ids in encode(batch.column("text").to_pylist(), special=False):
                    ids = np.frombuffer(ids, "<u4")
                    if len(ids) and (int(ids.max()) >= 1 << 8 * width or (ids == end).any()):
                        raise ValueError(f"an id is {end}, the end id, or does not fit {width} bytes")
                    if out is None or nth == docs_per_file or held >= file_tokens:
                        if out is not None:
                            out.close()
                        name, nth, held = f"{uuid.uuid4().hex}.ids", 0, 0
                        out = store.open_output_stream(posixpath.join(root, name))
                    out.write(ids.astype(dtype).tobytes() + end.to_bytes(width, "little"))
                    names.append(name)
                    places.append(nth)
                    nth, held = nth + 1, held + len(ids) + 1
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), batch.column("doc_id")], ["file", "nth", "doc_id"])
        finally:
            if out is not None:
                out.close()

    return docs.select("doc_id", "text").mapInArrow(write, f"file string, nth long, doc_id {kind}")


def token_ranges(spark: SparkSession, folder: str, width: int = 2, range_tokens: int = RANGE_TOKENS, named: DataFrame | None = None) -> DataFrame:
    """path, file, offset, length: byte ranges of the token files (*.ids) in folder, from the files' sizes alone.

    With `named` (a column file), only of files named there: what a lost attempt has left is not looked at.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("file"))
    if named is not None:
        # Cut off here, so that no check of a length can come before the join.
        files = materialise(files.join(named.select("file").distinct(), "file", "left_semi"), "token-files-named")
    step = range_tokens * width
    whole = F.when(F.pmod("length", F.lit(width)) == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("not a whole number of ids: "), "path")).cast("long"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(whole - 1, F.lit(0)), F.lit(step).cast("long")))
    df = files.select("path", "file", "length", starts.alias("offset"))
    return df.select("path", "file", "offset", F.least(F.lit(step).cast("long"), F.col("length") - F.col("offset")).alias("length"))


def read_blocks(ranges: DataFrame, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, ids (bytes) of the blocks in each range. A range's file is opened once and read block by block; ranges begin
    at a block's border."""
    step = block_tokens * width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "file", "offset", "length")), strict=True):
                store, where = _store(_local(path))
                with store.open_input_file(where) as f:
                    for at in range(0, length, step):
                        size = min(step, length - at)
                        raw = f.read_at(size, offset + at)
                        if len(raw) != size:
                            raise ValueError(f"{path} has changed")
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([(offset + at) // step], pa.int64()), pa.array([raw], pa.binary())], ["file", "block", "ids"])

    return ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism * 4, "file", "offset").mapInArrow(read, "file string, block long, ids binary")


def count_tokens(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """One row per document of the files in blocks (file, block, ids): file, nth, start, n_tokens, closed.

    blocks is read once: each block gives the positions of its ends, which are then shifted by what the scan carries in.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = [], []
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_buffer() if raw.is_valid else b"", f"<u{width}")
                ends.append(np.flatnonzero(ids == end))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "size", "ends"]
            )

    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.select("file", F.col("block").cast("long"), "ids").mapInArrow(search, f"file {kind}, block long, size long, ends array<bigint>")
    found = materialise(found, "ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    summary = found.select("file", "block", "size", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    # Prefix scan: tokens and documents before the block, and where the document that is open at its start began.
    scanned = summary.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))).select(
        "file", "block", "size", "base",
        F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("docs"),
        F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0).cast("long")).alias("open"),
        ((F.sum("size").over(whole)) == F.col("base") + F.col("size")).alias("tail"),
    )
    df = found.drop("size").join(scanned, ["file", "block"])
    absolute = F.transform("ends", lambda e: e + F.col("base"))
    starts = F.concat(F.array("open"), F.transform(absolute, lambda e: e + 1))
    closed = F.transform(absolute, lambda e, i: F.struct(F.get(F.col("starts"), i).alias("start"), (e - F.get(F.col("starts"), i)).alias("n_tokens"), F.lit(True).alias("closed")))
    df = df.withColumn("starts", starts)
    last = F.element_at("starts", -1)
    stop = F.col("base") + F.col("size")
    rest = F.when(F.col("tail") & (stop > last), F.array(F.struct(last.alias("start"), (stop - last).alias("n_tokens"), F.lit(False).alias("closed"))))
    none = F.array().cast("array<struct<start:bigint,n_tokens:bigint,closed:boolean>>")
    df = df.select("file", "docs", F.posexplode(F.concat(closed, F.coalesce(rest, none))).alias("i", "d"))
    return df.select("file", (F.col("docs") + F.col("i")).alias("nth"), "d.start", "d.n_tokens", "d.closed")


def count_token_files(spark: SparkSession, folder: str, end: int = END, width: int = 2, block_tokens: int = BLOCK_TOKENS, named: DataFrame | None = None) -> DataFrame:
    """file, nth, start, n_tokens, closed of each document in the token files of folder (named: as in `token_ranges`)."""
    ranges = token_ranges(spark, folder, width, block_tokens * max(1, RANGE_TOKENS // block_tokens), named)
    return count_tokens(read_blocks(ranges, width, block_tokens), end, width)


def document_tokens(docs: DataFrame, docs_per_file: int = DOCS_PER_FILE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, file, nth, start, n_tokens of each document: written as token files, counted there, and joined by place.

    That a file has as many ends as documents is checked: a document without a count, or a count without a document, is an error.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    with scratch(spark) as keep:
        folder = scratch_path(spark, "token-files")
        ids = materialise(write_token_files(docs, folder, docs_per_file=docs_per_file), "token-documents")
        if ids.isEmpty():
            return spark.createDataFrame([], "doc_id long, file string, nth long, start long, n_tokens long").withColumn("doc_id", F.col("doc_id").cast(kind))
        counts = count_token_files(spark, folder, block_tokens=block_tokens, named=ids)
        both = counts.withColumn("found", F.lit(True)).join(ids.withColumn("named", F.lit(True)), ["file", "nth"], "full")
        right = F.when(F.col("found") & F.col("named") & F.col("closed"), F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("ends and documents differ in "), "file")).cast("long"))
        return keep(both.select("doc_id", "file", "nth", "start", right.alias("n_tokens")), "token-counts")


def op6_token_counts(spark, sf_dir):
    """The documents are written as flat token files; doc_id comes back by a document's number within its file."""
    return document_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
