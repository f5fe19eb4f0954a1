"""Line dedup: hashes of lines, range-partitioned and sorted by document and position, give a keep bitmap for each document.

A text is split at newlines. A line's key is the line without white space at its ends, A-Z lower-cased; equal keys have
equal 128 bits of hashes. Only hashes, the document's identity and the line's number leave the task that reads a text.
They are dealt by ranges of the hash and sorted by document and position inside, so that a stream over them meets a key's
lines document by document and marks the first of each document; marks summed by key are the number of documents that
have it. Two rules: a key found in at least `min_docs` documents loses all its lines (`keep="none"`), or all but the
first one, in order of doc_id and position (`keep="first"`).

The result is a bitmap for each document that loses a line, in words of 64 lines, those without a loss left out; texts
don't move for it. `kept_lines` joins bitmaps and texts again, once, where texts are wanted.

A document is its doc_id and text, and rows equal in both are documents of their own that fare alike. A hot key spreads
over `PIECES` ranges by document, and copies of a row by the partition they are read from, so no group holds a key's lines
of all documents; what meets in one group are a piece's lines. Keys that do not drop anything leave the flow before any
document's lines meet.

Edge cases: a null or empty text is one empty line; keys shorter than `min_chars` code points (empty and blank lines for
1) are never dropped; a line repeated in one document counts that document once; a carriage return at a line's end is
white space there and stays in lines that stay; very long texts and lines are read whole; a key in exactly min_docs documents is
dropped; with `keep="first"` a null doc_id comes first, and all copies of a repeated row keep the line; an empty table
gives no rows; other columns, whatever their names, are kept by `kept_lines` and ignored by `drop_bitmaps`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvan.functions.arrays import let
from silvan.llm.common import SPACE_CHARS, ascii_lower, columns_of, materialise, scratch, table

#: Pieces that a key's documents are dealt into. They only set where ranges may be cut, so many of them cost nothing, and a key
#: with a third of all lines goes over as many tasks as its lines fill.
PIECES = 1 << 16
MIN_DOCS = 10
KEY = ("h1", "h2")
DOC = ("d1", "d2")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _identity() -> list[Column]:
    """128 bits that tell documents apart; null and empty texts, which have the same line, are one."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64("doc_id", text).alias("d1"), F.xxhash64(F.lit(1), text, "doc_id").alias("d2")]


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, d1, d2 (the document), piece, pos (from 0), h1, h2 (the key) of each line whose key is long enough."""
    # Copies of a row are told apart by the partition, which a repeated task has again, so all lines of a row are in one piece.
    piece = F.pmod(F.col("d1") + F.spark_partition_id(), F.lit(PIECES)).cast("int").alias("piece")
    each = docs.select("doc_id", "text", *_identity()).select("doc_id", *DOC, piece, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = each.select("doc_id", *DOC, "piece", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= max(1, min_chars))
    return keyed.select("doc_id", *DOC, "piece", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def mark_firsts(hashes: DataFrame, partitions: int | None = None) -> DataFrame:
    """hashes with `first`: whether the line is its document's first of that key.

    The range partitions are those that the window needs, so its sort by document and position is the only one, and it
    streams: a rank needs no more than the row before.
    """
    by = [*KEY, "piece"]
    dealt = hashes.repartitionByRange(partitions, *by) if partitions else hashes.repartitionByRange(*by)
    inside = Window.partitionBy(*by, *DOC).orderBy("pos")
    return dealt.withColumn("first", F.rank().over(inside) == 1)


def dropped_keys(marked: DataFrame, min_docs: int, keep: str) -> DataFrame:
    """h1, h2 and, for keep="first", the first line of each key that loses lines. Sums of tasks meet, not lines."""
    sums = [F.count_if("first").alias("docs"), F.count("*").alias("lines")]
    if keep == "first":
        sums.append(F.min(F.struct("doc_id", *DOC, "pos")).alias("stays"))
    found = marked.groupBy(*KEY).agg(*sums).filter(F.col("docs") >= min_docs)
    if keep == "first":
        return found.filter(F.col("lines") > 1).select(*KEY, F.col("stays.d1").alias("s1"), F.col("stays.d2").alias("s2"), F.col("stays.pos").alias("s_pos"))
    return found.select(*KEY)


def drop_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, keep: str = "none", partitions: int | None = None) -> DataFrame:
    """d1, d2, kept: for each document that loses a line an array of (word, bits).

    Bit i of word w is set if line 64 * w + i stays; a word that isn't there keeps all its lines, so a document pays for
    the stretches in which it loses something.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    with scratch(docs.sparkSession) as hold:
        # Written first, as the ranges are cut from a sample for which the texts would be read once more.
        hashes = materialise(line_hashes(docs, min_chars), "line-hashes")
        marked = materialise(mark_firsts(hashes, partitions), "lines")
        keys = materialise(dropped_keys(marked, min_docs, keep), "dropped-keys")
        hits = marked.select(*KEY, *DOC, "pos").join(keys, list(KEY))
        if keep == "first":
            hits = hits.filter(~((F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2")) & (F.col("pos") == F.col("s_pos"))))
        word, bit = F.shiftright("pos", 6), F.expr("shiftleft(1L, pos & 63)")
        words = hits.select(*DOC, word.alias("word"), bit.alias("bit")).groupBy(*DOC, "word").agg(F.bitwise_not(F.bit_or("bit")).alias("bits"))
        return hold(words.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("kept")), "bitmaps")


def _dense(kept: Column) -> Column:
    """All words up to the last one that is there."""
    before = lambda i: F.coalesce(F.get(kept, i - 1)["word"], F.lit(-1))
    return F.flatten(F.transform(kept, lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), x["word"] - before(i) - 1), F.array(x["bits"]))))


def apply_bitmap(text: Column, kept: Column) -> Column:
    """The lines of text that the bitmap keeps, joined by newlines; a null bitmap keeps all. Linear in the text's lines."""
    word = lambda words, i: F.coalesce(F.get(words, F.shiftright(i, 6)), F.lit(-1).cast("long"))
    bit = lambda words, i: F.call_function("shiftright", word(words, i), i.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1
    cut = let(_dense(kept), lambda words: F.array_join(F.filter(_lines(text), lambda line, i: bit(words, i)), "\n"))
    return F.when(kept.isNull(), F.coalesce(text, F.lit(""))).otherwise(cut)


def kept_lines(docs: DataFrame, output: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text"), **rule) -> DataFrame:
    """All columns of docs, the number of lines, of those dropped, and the text of the others (rule: as in `drop_bitmaps`).

    Texts move once, to meet their bitmaps, and not at all where the table of bitmaps is small enough for a broadcast.
    Columns of docs of the output's names are replaced.
    """
    bitmaps = drop_bitmaps(docs, **rule).withColumnsRenamed({"d1": "k1", "d2": "k2"})
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), *_identity())
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    size = (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")
    lost = F.aggregate("kept", F.lit(0).cast("long"), lambda n, x: n + F.bit_count(F.bitwise_not(x["bits"])))
    new = (size, F.coalesce(lost, F.lit(0).cast("long")), apply_bitmap(text, F.col("kept")))
    found = rows.join(bitmaps, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left").select("row", F.struct(*(c.alias(k) for c, k in zip(new, output, strict=True))).alias("new"))
    old = [c for c in docs.columns if c.lower() not in {x.lower() for x in output}]
    return found.select(*(F.col("row")[c].alias(c) for c in old), *(F.col("new")[c].alias(c) for c in output))


def op13_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return kept_lines(docs, min_docs=MIN_DOCS).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op13_line_dedup": op13_line_dedup}

_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS nr, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT nr, i, lines[i] AS line FROM (SELECT nr, lines, unnest(range(1, len(lines) + 1)) AS i FROM t)),
k AS (SELECT nr, i, line, lower_ascii AS key FROM (
  SELECT nr, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM l)),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT nr) >= 10),
m AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON common.key = k.key),
g AS (
  SELECT nr, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM m GROUP BY nr)
SELECT t.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g JOIN t ON t.nr = g.nr
"""
SQL = {"op13_line_dedup": _SQL}
