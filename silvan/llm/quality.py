"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule's cost (seconds on the sample beyond those of no rule) and selectivity (share of the sample that it rejects)
are estimated on a sample of at most `SAMPLE_ROWS` documents; the rules then run in order of rejection per cost, and a
document that one rule rejects isn't looked at by those after it. The order changes what the cascade costs, never which
documents it keeps. It may differ between runs, as times do, and so may the name of the rule that is found to reject a
document; whether one does is always the same.

Words are maximal runs of characters other than space and tab to carriage return.

Edge cases: a null text counts as an empty one; an empty text has no words, so the rule on few words rejects it; long
texts are read whole (in the sample, which decides no verdict, up to `SAMPLE_CHARS` characters of a text tell its cost);
rules of equal rejection per cost stay in the order given; repeated rows are judged one by one and alike; an empty table
gives no rows (the rules then stay in the order given). Columns of the input other than doc_id and text, whatever their
names, are kept by `quality_filter` and `accepted` and ignored by `quality_metrics`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvan.functions.arrays import let
from silvan.llm.common import SPACE_CHARS, materialise, scratch, table, words_of

#: Documents on which costs and selectivities are estimated, at most.
SAMPLE_ROWS = 256
SAMPLE_CHARS = 1 << 16
#: How often the time of a job on the sample is taken.
TIMES = 2
#: Seconds below which a difference of times is noise.
NOISE = 2e-3
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

Metric = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """rejects: from a function that gives a metric by name to a condition that is never null."""

    name: str
    rejects: Callable[[Metric], Column]


#: The first two are the base; the others reject what prose in no language looks like.
RULES = (
    Rule("few_words", lambda m: m("n_words") < MIN_WORDS),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: (m("n_dup_lines") >= 3) & (100 * m("n_dup_lines") > 30 * m("n_lines"))),
    Rule("word_length", lambda m: (m("word_chars") > 20 * m("n_words")) | (m("word_chars") < 2 * m("n_words"))),
    Rule("shouting", lambda m: 2 * m("n_capitals") > m("word_chars")),
    Rule("exclamation", lambda m: 2 * m("n_exclamations") > m("n_words")),
)
BASE = ("few_words", "repeated_windows")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more.

    A window is one long, its hash above its start, so one sort of a primitive array puts equal windows side by side;
    neighbours with equal hash bits count as equal only if their words are.
    """
    n = F.size(words)
    short = n < (1 << 24)
    high = F.when(short, F.lit(-1 << 24)).otherwise(F.lit(-1 << 31))
    low = F.when(short, F.lit((1 << 24) - 1)).otherwise(F.lit((1 << 31) - 1)).cast("long")
    word = lambda i: F.get(words, i.cast("int"))
    pack = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))

    def starts(windows: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            p, q = x.bitwiseAND(low), y.bitwiseAND(low)
            equal = x.bitwiseXOR(y).bitwiseAND(high) == 0
            for k in (0, 1, 2):
                equal = equal & (word(p + k) == word(q + k))
            return F.coalesce(equal, F.lit(False))

        beside = lambda x, j: same(x, F.get(windows, j - 1)) | same(x, F.get(windows, j + 1))
        return F.sort_array(F.transform(F.filter(windows, beside), lambda x: x.bitwiseAND(low)))

    covered = F.aggregate(
        let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), pack)), starts),
        F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(n > 3, covered).otherwise(F.lit(0).cast("long"))


def _expressions(text: Column, words: Column) -> dict[str, Column]:
    """Each metric as an expression of the text and its words."""
    long = lambda c: c.cast("long")
    return {
        "n_words": long(F.size(words)),
        "word_chars": long(_without(text, SPACE_CHARS)),
        "n_symbols": long(F.length(text) - _without(text, SYMBOLS)),
        "n_lines": long(F.size(_lines(text))),
        "n_dup_lines": long(F.size(_lines(text)) - F.size(F.array_distinct(_lines(text)))),
        "n_repeat_words": _repeat_words(words),
        "n_capitals": long(F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))),
        "n_exclamations": long(F.length(text) - _without(text, "!")),
    }


def _of_text(f: Callable[[dict[str, Column]], Column]) -> Column:
    """f of the metrics of the column text, split into words once."""
    return let(F.coalesce("text", F.lit("")), lambda t: let(words_of(t), lambda w: f(_expressions(t, w))))


def quality_metrics(docs: DataFrame) -> DataFrame:
    """doc_id and all metrics of each document."""
    return docs.select("doc_id", _of_text(lambda m: F.struct(*(e.alias(k) for k, e in m.items()))).alias("m")).select("doc_id", "m.*")


def _first(rules: tuple[Rule, ...], m: Metric) -> Column:
    """The first rule of this order that rejects, or null; what comes after it is not worked out."""
    out = None
    for r in rules:
        c = r.rejects(m)
        out = F.when(c, r.name) if out is None else out.when(c, r.name)
    return F.lit(None).cast("string") if out is None else out


def cascade(rules: tuple[Rule, ...]) -> Column:
    """The first rule of this order that rejects the column text, or null."""
    return _of_text(lambda m: _first(rules, m.__getitem__))


def judged(rules: tuple[Rule, ...], metrics: tuple[str, ...]) -> Column:
    """struct of these metrics of the column text and `rejected_by`, the verdict of `cascade`: each of them is worked out once
    for both, all others only for documents that get so far in the cascade."""

    def both(m: dict[str, Column]) -> Column:
        shared = F.struct(*(m[k].alias(k) for k in metrics))
        verdict = lambda s: _first(rules, lambda k: s[k] if k in metrics else m[k])
        return let(shared, lambda s: F.struct(*(s[k].alias(k) for k in metrics), verdict(s).alias("rejected_by")))

    return _of_text(both)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules with their seconds and share of rejected documents on the sample, best rejection per cost first.

    The sample is the first documents that a scan meets, no more than sample_rows of them, from as few partitions as hold
    them. A rule's time is the least of a few jobs on the sample, less that of a job without one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).take(sample_rows)
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]
    with scratch(spark):
        # Written once, so that the jobs below carry no texts.
        sample = materialise(spark.createDataFrame([(r["text"],) for r in rows], "text string").coalesce(1), "quality-sample")
        return _timed_rules(sample, rules, len(rows))


def _timed_rules(sample: DataFrame, rules: tuple[Rule, ...], rows: int) -> list[tuple[Rule, float, float]]:
    def timed(verdict: Column) -> tuple[float, int]:
        hit, took = sample.agg(F.count(verdict)), []
        n = hit.first()[0]  # compiles the code
        for _ in range(TIMES):
            began = time.perf_counter()
            hit.first()
            took.append(time.perf_counter() - began)
        return min(took), n

    idle, _ = timed(F.when(F.col("text") == "", 1))
    out = []
    for rule in rules:
        took, n = timed(cascade((rule,)))
        out.append((rule, max(NOISE, took - idle), n / rows))
    return sorted(out, key=lambda x: -x[2] / x[1])


def _ordered(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int) -> tuple[Rule, ...]:
    return tuple(r for r, _, _ in order_rules(docs, rules, sample_rows))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, output: str = "rejected_by") -> DataFrame:
    """All columns of docs and `output`: a rule of the cascade that rejects the document, null if it is kept.

    A column of docs of that name is replaced.
    """
    return docs.withColumn(output, cascade(_ordered(docs, rules, sample_rows)))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs, all columns, without the documents that a rule rejects."""
    return docs.filter(cascade(_ordered(docs, rules, sample_rows)).isNull())


#: What op8 returns of every document.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    df = docs.select("doc_id", judged(_ordered(docs, RULES, SAMPLE_ROWS), RETURNED).alias("m")).select("doc_id", "m.*")
    base = F.lit(False)
    for r in RULES:
        if r.name in BASE:
            base = base | r.rejects(F.col)
    return df.select("doc_id", *RETURNED, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


QUERIES = {"op8_quality_rules": op8_quality_rules}

_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_capitals,
         length(text) - length(replace(text, '!', '')) AS n_exclamations
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 2 * n_capitals > word_chars OR 2 * n_exclamations > n_words) AS kept
FROM m
"""
SQL = {"op8_quality_rules": _SQL}
