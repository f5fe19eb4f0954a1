"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection.

A block is one word at every size: a larger one cannot be dealt to sources and shards that have fewer words than it, and
what apportionment costs does not depend on the number of blocks.

A source's target is its share by weight of `share` times all words, but at most `most` times its own words; what is
above is shared again by weight among the others. The targets are bought in blocks: blocks go one by one
to the source with the highest quotient target / (2 * blocks + 1), and each source's blocks go in the same way to its
shards by their words. A shard is a circle of its documents in a seeded order: the blocks taken are whole turns and then
one run of blocks from a seeded start, so words are repeated only when all of a shard's words were taken.

The driver holds sources and shards with their sizes, one row each (at most `MAX_SOURCES` sources; a shard has about
`ROWS_PER_SHARD` rows, or more where that would be more than `MAX_SHARDS` shards), never documents.

Edge cases: a null text or source is a document of 0 words or a source of its own, last in order; documents of 0 words
take 0; a very long text is a document like others, whole or in a run, however many shards' words it has; equal quotients
go to the first source or shard; repeated rows are documents of their own; if nothing has words all targets are 0; an
empty table gives no rows; other columns, whatever their names, are ignored by `mix_sources` and kept by
`mixed_documents`.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvan.llm.common import SPACE, SPACE_CHARS, columns_of, materialise, scratch, table, words_of

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 42
MAX_SOURCES = 100_000
ROWS_PER_SHARD = 500
MAX_SHARDS = 20_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Target of each source: share * sum(sizes) by weight, none above most * its size."""
    rest, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / whole > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / whole
            break
        for i in over:
            out[i] = most * sizes[i]
        rest = max(0.0, rest - sum(out[i] for i in over))
        open_ -= over
    return out


def sainte_lague(seats: int, votes: Sequence[float], caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 * seats + 1), first one first in ties; none gets more than its cap.

    What the divisor gives for sure is dealt at once; quotients are compared only for the last seats.
    """
    n = len(votes)
    caps = [seats] * n if caps is None else list(caps)
    total = sum(votes)
    out = [0] * n
    if total > 0:
        low, high = 0.0, 2 * (seats + n) / total  # seats bought for each vote
        given = lambda f: [min(c, int(v * f + 0.5)) if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]
        while sum(given(high)) < min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0)):
            high *= 2
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(given(mid)) <= seats else (low, mid)
        out = given(low)
    heap = [(-v / (2 * s + 1), i) for i, (v, s, c) in enumerate(zip(votes, out, caps, strict=True)) if v > 0 and s < c]
    heapq.heapify(heap)
    left = seats - sum(out)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        out[i] += 1
        left -= 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(size).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("check"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = int(MOST), seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, and what the mix takes of it.

    turns: how often it is taken whole; first, run: the words first .. first + run - 1 (from 0) are taken once more, and so
    are the words 0 .. again - 1 if the run comes round the circle into the document again; taken: all words taken.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_mixed(materialise(_sized(docs), "mix-sizes"), weights, share, most, seed), "mix")


def _mixed(sized: DataFrame, weights: Sequence[float], share: float, most: int, seed: int) -> DataFrame:
    spark = sized.sparkSession
    named = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(named) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # Code points order as UTF-8 bytes do.
    named.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in named]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(named))], share, most)
    per_shard = max(ROWS_PER_SHARD, sum(r["rows"] for r in named) // MAX_SHARDS)
    text, long = pa.string(), pa.int64()
    plan = spark.createDataFrame(
        pa.table(
            {
                "source": pa.array([r["source"] for r in named], text),
                "nth_source": pa.array(range(len(named)), long),
                "source_size": pa.array(sizes, long),
                "target": pa.array(aims, pa.float64()),
                "shards": pa.array([-(-r["rows"] // per_shard) for r in named], long),
            }
        )
    )
    order = F.xxhash64(F.lit(seed), "doc_id", "check")
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    placed = sized.alias("d").join(F.broadcast(plan).alias("p"), same).select(
        "doc_id", "d.source", "size", "source_size", "target", "nth_source", order.alias("order"), "check",
        F.pmod(F.xxhash64("doc_id", F.lit(seed + 1), "check"), "shards").alias("nth_shard"),
    )
    shards = placed.groupBy("nth_source", "nth_shard").agg(F.sum("size").alias("words")).collect()
    shards.sort(key=lambda r: (r["nth_source"], r["nth_shard"]))
    quota = sainte_lague(int(sum(aims) + 0.5), aims, [int(most * s) for s in sizes])
    bought, begins = [], 0
    for i in range(len(named)):
        end = begins
        while end < len(shards) and shards[end]["nth_source"] == i:
            end += 1
        words = [r["words"] for r in shards[begins:end]]
        bought += sainte_lague(quota[i], words, [int(most * w) for w in words])
        begins = end
    quotas = spark.createDataFrame(
        pa.table(
            {
                "nth_source": pa.array([r["nth_source"] for r in shards], long),
                "nth_shard": pa.array([r["nth_shard"] for r in shards], long),
                "words": pa.array([r["words"] for r in shards], long),
                "quota": pa.array(bought, long),
            }
        )
    )
    circle = Window.partitionBy("nth_source", "nth_shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = placed.withColumn("at", F.coalesce(F.sum("size").over(circle), F.lit(0).cast("long"))).join(F.broadcast(quotas), ["nth_source", "nth_shard"])
    words = F.greatest("words", F.lit(1))
    turns = F.expr("quota div greatest(words, 1)")
    df = df.select("*", turns.alias("turns"), (F.col("quota") - turns * F.col("words")).alias("rest"), F.pmod(F.xxhash64(F.lit(seed + 2), "nth_source", "nth_shard"), words).alias("begin"))
    # The run is [begin, begin + rest) on the circle; a document can meet it, and meet it again one turn later.
    end = F.col("begin") + F.col("rest")
    first = F.greatest(F.col("begin") - F.col("at"), F.lit(0))
    until = F.least(end - F.col("at"), F.col("size"))
    again = F.greatest(F.least(end - F.col("words") - F.col("at"), F.col("size")), F.lit(0))
    run = F.greatest(until - first, F.lit(0))
    df = df.withColumns({"first": first, "run": run, "again": again})
    return df.select(
        "doc_id", "source", "size", "source_size", "target", "turns", "first", "run", "again", (F.col("turns") * F.col("size") + F.col("run") + F.col("again")).alias("taken"), "check"
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents, with all columns of docs and more columns for none: each row whole as often as its turns, then
    the words of its run and of what the run meets again, with the white space between them; a run over all its words is
    the whole text. n_chars, if there, counts anew.

    Rows that are equal in doc_id, source and text have a decision each and are told apart by a number within their key.
    """
    key = F.struct(F.col("doc_id"), F.col("source"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("check"))
    plan = mix_sources(docs, **how).groupBy(F.struct("doc_id", "source", "check").alias("key"))
    plan = plan.agg(F.sort_array(F.collect_list(F.struct("first", "run", "again", "turns", "size"))).alias("takes"))
    # The row travels as one value, so its columns' names meet none of ours.
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), key.alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    df = rows.withColumn("nth", nth).join(plan, "key").select("row", F.element_at("takes", F.col("nth")).alias("take"))
    text, t = F.col("row.text"), F.col("take")
    # Each word with the white space after it.
    words = F.split(F.regexp_replace(text, f"^{SPACE}", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = lambda start, n: F.rtrim(F.array_join(F.slice(words, (start + 1).cast("int"), n.cast("int")), ""), F.lit(SPACE_CHARS))
    piece = lambda start, n: F.when(n == t["size"], text).otherwise(cut(start, n))
    texts = F.concat(
        F.transform(F.sequence(F.lit(0), t["turns"].cast("int")), lambda i: F.when(i > 0, text)),
        F.array(F.when(t["run"] > 0, piece(t["first"], t["run"])), F.when(t["again"] > 0, piece(F.lit(0), t["again"]))),
    )
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    out = df.select("row", F.explode(F.array_compact(texts)).alias("text"))
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op4_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mixing": op4_mixing}
SQL: dict[str, str] = {}
