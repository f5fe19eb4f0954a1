"""Language ID by rank-order profiles: a document's most frequent n-grams against each language's, by out-of-place distance.

Texts are lower-cased, everything but letters becomes one space between words, and n-grams of 1 to 3 characters are
counted over the whole text. A profile is the `PROFILE` most frequent n-grams of a language in order; a document's own
is compared to it n-gram by n-gram: the distance is the sum of the differences of rank, `PROFILE` for one that the
language's profile lacks. The nearest language wins, the first by name in a tie. The score is 1 - distance / worst.

Profiles are fitted on a bounded sample: about `SAMPLE_PER_LANGUAGE` labelled documents of each language, chosen by
hash (all of them where a language has fewer). Prediction reads the text alone.

Edge cases: a null text, or one without a letter, is `und` with score 0; rows without a language are not learned from; if
nothing can be learned, all are `und`; more than `MAX_LANGUAGES` languages are an error; very long texts are read whole;
n-grams of equal count go by their number; repeated rows are predicted alike; an empty table gives no rows; other columns,
whatever their names, are kept by `identify`, but for those it adds, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silvan.llm.common import fresh, table

PROFILE = 400
SAMPLE_PER_LANGUAGE = 1_000
#: Languages, each of which is a profile that every task holds.
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
#: A character's place in an n-gram's number.
WIDTH = 21


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 characters as numbers, and their counts; none without a letter."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds, where = np.unique(codes, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds])
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(letter[where], codes, 32)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([True], blank[:-1])))]  # one space between words, none first
    codes = np.concatenate(([32], codes, [32])) if codes[-1] != 32 else np.concatenate(([32], codes))
    ones, twos = codes[codes != 32], (codes[:-1] << WIDTH) | codes[1:]
    threes = (codes[:-2] << 2 * WIDTH) | (codes[1:-1] << WIDTH) | codes[2:]
    return np.unique(np.concatenate((ones, twos, threes)), return_counts=True)


def top(found: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent, in order; the smaller number first in ties."""
    if len(counts) > 2 * n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.lexsort((found, -counts))[:n]]


def fit_profiles(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profile of each language, from rows with doc_id, text and lang."""
    labelled = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return {}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    spread = 1 << 30
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(spread, per_language * spread // n + 1))))
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < F.try_element_at(share, F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mine = sums.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in grams(text)), strict=True):
                    mine[g] = mine.get(g, 0) + n
        for lang, mine in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(mine.keys(), pa.int64()), pa.array(mine.values(), pa.int64())], ["lang", "gram", "n"])

    summed = labelled.filter(keep).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # One pass: the sample is bounded, and so is what its n-grams come to.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = summed.withColumn("nth", nth).filter(F.col("nth") <= size).orderBy("lang", "nth").collect()
    found: dict[str, list[int]] = {}
    for r in rows:
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(g, np.int64) for lang, g in found.items()}


def distance(mine: np.ndarray, codes: np.ndarray, ranks: np.ndarray, size: int) -> int:
    """Out-of-place distance of an ordered profile to one given as sorted codes with their ranks."""
    at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
    return int(np.where(codes[at] == mine, np.abs(ranks[at] - np.arange(len(mine))), size).sum())


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """docs with `lang_pred` and `lang_score`, from the text alone."""
    ready = [(lang, np.sort(p), np.argsort(p)) for lang, p in sorted(profiles.items())]

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for text in texts:
                mine = top(*grams(text), size)
                if not len(mine) or not ready:
                    out.append((UNKNOWN, 0.0))
                    continue
                best, lang = min((distance(mine, codes, ranks, size), lang) for lang, codes, ranks in ready)
                out.append((lang, 1 - best / (size * len(mine))))
            yield pd.DataFrame(out, columns=["lang", "score"])

    found = fresh(docs, "found")
    return docs.withColumn(found, predict(F.col("text"))).withColumns({"lang_pred": F.col(found)["lang"], "lang_score": F.col(found)["score"]}).drop(found)


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    profiles = fit_profiles(docs.filter(~F.coalesce(held_out, F.lit(False))))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
