"""Whole-file corpora: plain texts with headings, HTML pages, EPUB and their parsing rules, as parsed units.

A plain text is read in one row and cut into lines with their numbers; what a heading starts is filled forward over the
lines after it, so each rule set is a few patterns and not a program of its own.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from silvan.functions import text as T


def read_texts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """file, text of each whole file, without a byte order mark and with line ends as one character."""
    name = F.element_at(F.split("path", "/"), -1)
    df = spark.read.format("binaryFile").load(path).select(name.alias("file"), F.decode("content", encoding).alias("text"))
    return df.withColumn("text", F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), r"\r\n?", "\n"))


def lines(texts: DataFrame) -> DataFrame:
    """file, n, line inside the envelope."""
    return texts.select("file", F.posexplode(F.split(T.strip_envelope(F.col("text")), r"\r?\n")).alias("n", "line"))


def headed(numbered: DataFrame, marks: dict[str, Column], file: str = "file") -> DataFrame:
    """numbered with name and name_at for each mark: the latest value that is not null and the n of its line; marks go from
    the top down, and a higher one ends the lower ones."""
    w = Window.partitionBy(file).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df, above = numbered, []
    for name, value in marks.items():
        df = df.withColumn(name, value).withColumn(f"{name}_at", F.max(F.when(F.col(name).isNotNull(), F.col("n"))).over(w)).withColumn(name, F.last(name, True).over(w))
        if above:
            ended = F.greatest(F.lit(-1), *(F.coalesce(a, F.lit(-1)) for a in above)) > F.coalesce(f"{name}_at", F.lit(-1))
            # Under no heading of the level above, there is none of this one either.
            df = df.withColumns({c: F.when(~ended & above[-1].isNotNull(), F.col(c)) for c in (name, f"{name}_at")})
        above.append(F.col(f"{name}_at"))
    return df


def joined(rows: DataFrame, keys: list[str], line: str = "line", separator: str = " ") -> DataFrame:
    """keys, n (the first), text: the lines of each key in order."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.col(line).alias("v")))), lambda x: x["v"]), separator)
    return rows.groupBy(*keys).agg(F.min("n").alias("n"), text.alias("text"))


def sections(numbered: DataFrame, headings: list[str], stop: str | None = None) -> DataFrame:
    """numbered with h0, h1, ...: the latest heading of each level (its first group), a higher one ends the lower ones.

    Lines that are headings themselves are left out; so is all from the first line that matches stop.
    """
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = numbered
    if stop is not None:
        df = df.withColumn("__over", F.max(F.coalesce(F.col("line").rlike(stop), F.lit(False)).cast("int")).over(w)).filter("__over = 0").drop("__over")
    at: list[Column] = []
    is_heading = F.lit(False)
    for k, pattern in enumerate(headings):
        here = F.col("line").rlike(pattern)
        is_heading = is_heading | here
        df = df.withColumn(f"__at{k}", F.max(F.when(here, F.col("n"))).over(w)).withColumn(f"h{k}", F.last(F.when(here, F.trim(F.regexp_extract("line", pattern, 1))), True).over(w))
        at.append(F.col(f"__at{k}"))
    for k in range(1, len(headings)):
        ended = F.greatest(*at[:k], F.lit(-1)) > F.coalesce(at[k], F.lit(-1))
        df = df.withColumn(f"h{k}", F.when(~ended, F.col(f"h{k}")))
    return df.filter(~is_heading).drop(*(f"__at{k}" for k in range(len(headings))))


def paragraphs(df: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys, nth (from 1), text: runs of lines between blank ones, joined; those shorter than `least` characters are left out."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    blank = F.trim("line") == ""
    df = df.withColumn("__p", F.sum(blank.cast("int")).over(w)).filter(~blank)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ")
    p = df.groupBy("file", *keys, "__p").agg(T.collapse_spaces(joined).alias("text"), F.min("n").alias("n")).filter(F.length("text") >= least)
    return p.withColumn("nth", F.row_number().over(Window.partitionBy("file", *keys).orderBy("n"))).drop("__p")


def numbered_items(df: DataFrame, keys: list[str], pattern: str = r"^\s*(\d+|[IVXLCDM]+)\.?\s+") -> DataFrame:
    """keys, number, text: lines that begin with a number start an item, which takes the lines up to the next one."""
    w = Window.partitionBy("file", *keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("line").rlike(pattern)
    df = df.withColumn("__i", F.sum(start.cast("int")).over(w)).filter("__i > 0")
    mark = F.when(start, F.regexp_extract("line", pattern, 1))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.regexp_replace("line", pattern, "").alias("line")))), lambda x: x["line"]), " ")
    items = df.groupBy("file", *keys, "__i").agg(F.max(mark).alias("mark"), T.collapse_spaces(body).alias("text"))
    number = F.coalesce(T.roman_to_int(F.col("mark")), T.first_integer(F.col("mark")), F.col("__i").cast("int"))
    return items.select("file", *keys, number.alias("number"), "text").filter("text != ''")


def clean_verse(text: Column) -> Column:
    """Without notes in brackets, underscores for italics and the bar or gap of a half-line."""
    return T.collapse_spaces(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]|\{[^}]*\}", " "), r"_|\s\|\s", " "))


class _Blocks(HTMLParser):
    """Text of each block element, in order, with its tag, id, classes and the ids of the divisions around it."""

    BLOCKS = frozenset("p h1 h2 h3 h4 td li title".split())

    def __init__(self, skip=None):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, dict, list[str]]] = []
        self.divisions: list[str] = []
        self.skip, self.skipping = skip, []

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if self.skipping:
            if tag == self.skipping[0]:
                self.skipping.append(tag)
            return
        if self.skip and self.skip(tag, attrs):
            self.skipping.append(tag)
            return
        if tag == "div":
            self.divisions.append(attrs.get("id", ""))
        elif tag == "br":
            self.handle_data("\n")
        if tag in self.BLOCKS:
            # A block that was not closed ends where the next of its kind begins.
            if self.open and self.open[-1][0] == tag:
                self.handle_endtag(tag)
            self.open.append((tag, attrs, []))

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping[0]:
                self.skipping.pop()
            return
        if tag == "div" and self.divisions:
            self.divisions.pop()
        if self.open and any(t == tag for t, _, _ in self.open):
            while True:
                t, attrs, parts = self.open.pop()
                text = "".join(parts)
                self.found.append(
                    {
                        "tag": t, "id": attrs.get("id", ""), "text": " ".join(text.split()), "lines": [x for x in (" ".join(y.split()) for y in text.split("\n")) if x],
                        "classes": attrs.get("class", "").lower().split(), "within": [d for d in self.divisions if d],
                    }
                )
                if t == tag:
                    break

    def handle_data(self, data):
        if self.open and not self.skipping:
            self.open[-1][2].append(data)


def html_blocks(html: str, skip=None) -> list[dict]:
    """Blocks that have a text; skip(tag, attributes): an element that is left out with all it holds."""
    parser = _Blocks(skip)
    parser.feed(html)
    parser.close()
    parser.skipping = []
    while parser.open:
        parser.handle_endtag(parser.open[-1][0])
    return [b for b in parser.found if b["text"]]


BLOCK_FIELDS = ("tag", "id", "text", "lines", "classes", "within")
BLOCK_TYPES = [pa.string()] * 3 + [pa.list_(pa.string())] * 3
#: Blocks, and characters of them, that a task hands on at once.
BATCH_BLOCKS, BATCH_CHARS = 5_000, 1 << 21


def _block_batches(batch: pa.RecordBatch, names: list[str], skip) -> Iterator[pa.RecordBatch]:
    """Blocks of the pages of a batch (id and page), handed on whenever there are BATCH_BLOCKS or BATCH_CHARS of them."""
    held, rows, places, size = [], [], [], 0

    def made() -> pa.RecordBatch:
        columns = [pa.array([b[c] for b in held], t) for c, t in zip(BLOCK_FIELDS, BLOCK_TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(places, pa.int32()), *columns], names)

    for k in range(batch.num_rows):
        for n, b in enumerate(html_blocks(batch.column(1)[k].as_py() or "", skip)):
            held.append(b)
            rows.append(k)
            places.append(n)
            size += len(b["text"])
        if len(held) >= BATCH_BLOCKS or size >= BATCH_CHARS:
            yield made()
            held, rows, places, size = [], [], [], 0
    if held:
        yield made()


def parse_html(pages: DataFrame, id_: str, html: str = "html", skip=None) -> DataFrame:
    """id, n, tag, element_id, text, lines, classes, within of each block of each page, in order. A task holds the blocks of
    a few pages at a time, however many pages it has."""
    texts = pages.select(id_, F.col(html).alias("__html"))
    kinds = StructType([texts.schema[id_]]).add("n", IntegerType())
    for c in BLOCK_FIELDS:
        kinds = kinds.add("element_id" if c == "id" else c, ArrayType(StringType()) if c in BLOCK_FIELDS[3:] else StringType())
    names = kinds.names
    return texts.mapInArrow(lambda batches: (x for b in batches for x in _block_batches(b, names, skip)), kinds)


def page_paragraphs(blocks: DataFrame, id_: str, least: int = 20, stop: str = r"(?i)^footnote") -> DataFrame:
    """id, heading, nth, text: paragraphs of at least `least` characters with the latest heading, up to the first block that matches stop."""
    w = Window.partitionBy(id_).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = blocks.withColumn("over", F.max(F.col("text").rlike(stop).cast("int")).over(w)).filter("over = 0")
    df = df.withColumn("heading", F.last(F.when(F.col("tag").isin("h1", "h2", "h3", "h4"), F.col("text")), True).over(w))
    df = df.filter((F.col("tag") == "p") & (F.length("text") >= least))
    return df.select(id_, "heading", F.row_number().over(Window.partitionBy(id_).orderBy("n")).alias("nth"), "text")


def read_epub(spark: SparkSession, path: str, prefix: str = "", skip: str = "^$", folder: str = "", drop=None) -> DataFrame:
    """file, item, n, tag, element_id, text, lines, classes, within: blocks of the pages of EPUB archives; items in folder, by
    prefix, without those that match skip; drop(tag, attributes): elements left out. natural_key(item) is their order. An
    item without blocks is one row without a tag."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for item in z.namelist():
                        name = item.rsplit("/", 1)[-1]
                        if not (re.search(r"(?i)\.x?html?$", name) and item.startswith(folder) and name.startswith(prefix)) or re.search(skip, name):
                            continue
                        b = html_blocks(z.read(item).decode("utf-8", "replace"), drop) or [dict.fromkeys(BLOCK_FIELDS)]
                        columns = [pa.array([x[c] for x in b], t) for c, t in zip(BLOCK_FIELDS, BLOCK_TYPES, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([file.rsplit("/", 1)[-1]] * len(b)), pa.array([item] * len(b)), pa.array(range(len(b)), pa.int32()), *columns],
                            ["file", "item", "n", *("element_id" if c == "id" else c for c in BLOCK_FIELDS)],
                        )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    lists = ", ".join(f"{c} array<string>" for c in BLOCK_FIELDS[3:])
    return files.mapInArrow(unpack, f"file string, item string, n int, tag string, element_id string, text string, {lists}")
