"""Vectors for texts: an encoder as a function, queues, batches by a token budget, and vectors of units from those below.

An encoder is any function from a list of texts to a list of vectors, made on each worker by a factory; it may raise
`TooMuch` (or MemoryError) for a batch, which is then tried in halves. No model comes with this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvan.functions import text as T
from silvan.functions import vector as V
from silvan.operators.tree import first_level_below

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]
#: Labels of the methods for units and for spans: fixed values.
METHODS = ("unit", "span")


class TooMuch(Exception):
    """A batch is too large for the encoder."""


def batches(costs: Sequence[int], most_items: int, budget: int) -> Iterator[tuple[int, int]]:
    """Ranges [start, end) of items in order: as many as the budget pays for, most_items at most and one at least."""
    paid = np.concatenate(([0], np.cumsum(costs, dtype=np.int64)))
    start = 0
    while start < len(costs):
        affordable = int(np.searchsorted(paid, paid[start] + budget, side="right")) - 1
        end = min(start + most_items, max(start + 1, affordable))
        yield start, end
        start = end


@dataclass
class Limiter:
    """The share of a full batch that is tried: 2 ** -halvings of it.

    A failure takes a step down; `patience` batches in a row that go through take one up again.
    """

    patience: int = 5
    halvings: int = 0
    streak: int = 0

    def share(self, full: int) -> int:
        return max(1, full >> self.halvings)

    def record(self, went_through: bool) -> None:
        self.streak = self.streak + 1 if went_through else 0
        if not went_through:
            self.halvings += 1
        elif self.halvings and self.streak == self.patience:
            self.halvings, self.streak = self.halvings - 1, 0


def _in_halves(encode: Encoder, chunk: list[tuple[object, str, int]], limiter: Limiter, lost: list) -> Iterator[tuple[list, Sequence[Sequence[float]]]]:
    """ids and vectors of a chunk; what is too much is cut in two until it goes through, and a single item that doesn't is lost."""
    try:
        vectors = encode([text for _, text, _ in chunk])
    except (TooMuch, MemoryError):
        if len(chunk) == 1:
            lost.append(chunk[0][0])
            return
        limiter.record(False)
        middle = len(chunk) // 2
        for half in (chunk[:middle], chunk[middle:]):
            yield from _in_halves(encode, half, limiter, lost)
        return
    limiter.record(True)
    yield [i for i, _, _ in chunk], vectors


def encode_all(encode: Encoder, items: list[tuple[object, str, int]], most_items: int, limiter: Limiter | None = None, lost: list | None = None) -> Iterator[tuple[list, Sequence[Sequence[float]]]]:
    """ids and vectors of items (id, text, cost), the dearest first; `lost` gets the ids of items that are too much alone.

    A full batch costs what the first most_items do, so the first batch is as long as it may be and later ones as dear.
    """
    limiter, lost = limiter or Limiter(), [] if lost is None else lost
    left = sorted(items, key=lambda x: (x[2], len(x[1])), reverse=True)
    full = sum(cost for _, _, cost in left[:most_items])
    while left:
        _, end = next(batches([cost for _, _, cost in left[: limiter.share(most_items)]], most_items, limiter.share(full)))
        chunk, left = left[:end], left[end:]
        yield from _in_halves(encode, chunk, limiter, lost)


def embed(queue: DataFrame, make: Callable[[], Encoder], most_items: int = 64, task_items: int = 4_096) -> DataFrame:
    """id, vector of each item of queue (id, text, cost) that the encoder takes; make builds the encoder, once for each task.

    A task sees its items in groups of at most task_items, each gone through longest first.
    """
    kind = queue.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for part in parts:
            for at in range(0, part.num_rows, task_items):
                rows = part.slice(at, task_items)
                for ids, vectors in encode_all(encode, list(zip(*(rows.column(c).to_pylist() for c in ("id", "text", "cost")), strict=True)), most_items):
                    out = [np.asarray(v, np.float32) for v in vectors]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, rows.column("id").type), pa.array(out, pa.list_(pa.float32()))], ["id", "vector"])

    return queue.select("id", "text", F.col("cost").cast("long").alias("cost")).mapInArrow(run, f"id {kind}, vector array<float>")


def at_height(units: DataFrame, height: int | None = None) -> DataFrame:
    """Units of one height (leaves only with a text), or of all above 1."""
    if height is None:
        return units.filter("height > 1")
    own = units.filter(F.col("height") == height)
    return own.filter("text is not null") if height == 0 else own


def roll_up(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """unit_id, vector of units above height 1: the average of the vectors of the units of height 1 below, weighed by the
    characters of their leaves' texts (1 without any) and at unit length; units without such vectors are left out."""
    below = first_level_below(units)
    chars = units.filter("height = 0 and text is not null").groupBy(F.col("parent_id").alias("below")).agg(F.sum(F.length("text")).cast("double").alias("chars"))
    held = below.join(vectors.select(F.col("unit_id").alias("below"), "vector"), "below").join(chars, "below", "left").withColumn("chars", F.coalesce("chars", F.lit(1.0)))
    return V.weighted_average(held, "unit_id", "vector", "chars")


def span_vectors(spans: DataFrame, vectors: DataFrame, methods: DataFrame, label: str, profile: int) -> DataFrame:
    """Vectors of one method's label and profile with their spans, by corpus and span; LookupError if there are none."""
    method = methods.filter(F.col("label") == label).select("method_id")
    df = spans.filter(F.col("profile_id") == profile).join(vectors.join(method, "method_id", "left_semi"), "span_id")
    if df.limit(1).isEmpty():
        raise LookupError(f"no vectors of {label} for profile {profile}")
    return df.orderBy("corpus_id", "span_id")


def unit_vectors(units: DataFrame, vectors: DataFrame, method_id: int) -> DataFrame:
    """Vectors of leaves of one method, by corpus and unit."""
    return units.filter("height = 0").join(vectors.filter(F.col("method_id") == method_id), "unit_id").orderBy("corpus_id", "unit_id")


def unassigned(units: DataFrame, corpora: DataFrame, ids: DataFrame) -> DataFrame:
    """corpus, unit_id, label of the units of a table of ids, by corpus and unit: what a sample found no division for."""
    return units.join(ids.select("unit_id"), "unit_id", "left_semi").join(corpora.select("corpus_id", F.col("name").alias("corpus")), "corpus_id").select("corpus_id", "corpus", "unit_id", "label").orderBy("corpus_id", "unit_id")


def items(df: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """id, text, cost for the encoder: the text with the documents' prefix, and its estimated tokens."""
    return df.select(F.col(id_).alias("id"), T.with_prefix(F.col(text), "search_document").alias("text"), T.token_estimate(T.word_count(F.col(text))).alias("cost"))
