"""Filter interaction audit by a subset-zeta transform: what each filter removes in each order, from one count of masks.

A document's mask has bit k set if filter k fails it. One aggregation counts documents by part and mask, all of them and
those of each label. The zeta transform over a part's 2^n counts gives what survives every subset of the filters: a
document survives a subset if its mask has no bit in it. A step of an order is then the difference of two neighbouring
subsets (the filters before it, and those with it), and a filter's removals over all orders are a weighted sum of such
differences. Nothing is worked out per document and order.

Words are maximal runs of characters other than space and tab to carriage return.

Edge cases: a null text counts as an empty one (and equals one); an empty text has no words, no capitals and no
characters, so of A to D only A fails it; null and empty values of the part's column are one part; a document without a
label is in no label's counts, a doc_id with several labels is good or toxic if one of them says so, and labels without a
document count nowhere; a null doc_id is neither smaller nor greater than others, so such a row is no repeat and makes
none, and rows of one doc_id and text don't make each other repeats; very long texts are read whole; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvan.functions.arrays import let
from silvan.llm.common import materialise, scratch, table, words_of

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Filters in an audit: masks and subsets are 2^n numbers of a part, orders n!.
MAX_FILTERS = 7


def _diversity(words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


#: Failure conditions that look at one text: of (text, words), neither null.
TEXT_FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda t, w: F.size(w) < 100,
    "B": lambda t, w: _diversity(w),
    "C": lambda t, w: 100 * (F.length(t) - F.length(F.translate(t, CAPITALS, ""))) > 10 * F.length(t),
    "D": lambda t, w: t.rlike("[#$%&*|]"),
}
#: The filter that looks at all texts: identical to the text of a smaller doc_id.
REPEAT = "E"
FILTERS = "ABCDE"
LABELS = {"good": ("quality", 1), "toxic": ("toxic", 1)}


def failure_masks(docs: DataFrame, filters: str = FILTERS, part: str = "lang") -> DataFrame:
    """doc_id, part, mask of each document. Texts are read once; only two hashes and the mask leave the task that reads them.

    Texts are equal if 128 bits of hashes are. A group of equal texts of any size is one partial minimum per task.
    """
    bit = {f: 1 << k for k, f in enumerate(filters)}
    text = F.coalesce("text", F.lit(""))

    def own(t: Column) -> Column:
        return let(words_of(t), lambda w: sum((F.when(TEXT_FILTERS[f](t, w), bit[f]).otherwise(0) for f in filters if f != REPEAT), F.lit(0)))

    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), let(text, own).alias("mask"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    if REPEAT not in bit:
        return rows.select("doc_id", "part", "mask")
    rows = materialise(rows, "masks")
    # Only texts that more than one id has can fail, so what the rows meet again is small.
    groups = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("first") < F.col("last")).drop("last")
    # A table of its own, so that the join is one of two scans: small, it is broadcast, and else a group of copies can be split.
    groups = materialise(groups, "repeated-texts")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(groups, ["h1", "h2"], "left").select("doc_id", "part", (F.col("mask") + F.when(repeated, bit[REPEAT]).otherwise(0)).alias("mask"))


def labelled(masks: DataFrame, labels: DataFrame, names: dict[str, tuple[str, object]] = LABELS) -> DataFrame:
    """masks with a boolean column for each label: whether a row of labels of that doc_id has the value."""
    each = [F.coalesce(F.bool_or(F.col(c) == v), F.lit(False)).alias(name) for name, (c, v) in names.items()]
    of = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*each)
    return masks.join(of, "doc_id", "left").withColumns({name: F.coalesce(name, F.lit(False)) for name in names})


def mask_counts(masks: DataFrame, n: int, names: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """part and, for `all` and each label, an array of 2^n counts by mask. One row a part; summed up in the tasks first."""
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("all"), *(F.count_if(F.col(x)).alias(x) for x in names))
    measures = ("all", *names)
    cells = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures).alias("n")))).alias("cells")
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    row = lambda x: F.transform(every, lambda m: F.coalesce(F.try_element_at("cells", m)[x], F.lit(0).cast("long")))
    return counts.groupBy("part").agg(cells).select("part", *(row(x).alias(x) for x in measures))


def zeta(counts: Column, n: int) -> Column:
    """For each subset of n bits the sum of counts over all masks inside it: n rounds, one a bit, of 2^n additions."""

    def add(counts: Column, bit: int) -> Column:
        return let(counts, lambda c: F.transform(c, lambda x, s: x + F.when(s.bitwiseAND(F.lit(bit)) != 0, F.get(c, s - bit)).otherwise(0)))

    for k in range(n):
        counts = add(counts, 1 << k)
    return counts


def survivors(counts: DataFrame, n: int, names: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """part, the counts by mask (`alone`) and arrays of 2^n numbers: what is left once all filters of the subset have been applied.

    A mask survives a subset if it lies inside its complement, and complements are the array backwards.
    """
    return counts.select("part", F.col("all").alias("alone"), *(F.reverse(zeta(F.col(x), n)).alias(x) for x in ("all", *names)))


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS, part: str = "lang") -> DataFrame:
    """One row per part, order of all filters and step of it: what the step keeps and removes, and its filter's interactions."""
    n = len(filters)
    if not 0 < n <= MAX_FILTERS or len(set(filters)) < n:
        raise ValueError(f"1 to {MAX_FILTERS} different filters")
    with scratch(docs.sparkSession) as keep:
        counts = mask_counts(labelled(failure_masks(docs, filters, part), labels), n)
        return order_steps(keep(survivors(counts, n), "survivors"), filters)


def order_steps(left: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The rows of `audit`, from those of `survivors`."""
    n = len(filters)
    index = {f: k for k, f in enumerate(filters)}
    steps = []
    for order in itertools.permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(order), "step": step, "f": index[f], "before": before})
            before |= 1 << index[f]
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,f:int,before:int>>")
    # What a filter removes after the subset s, times the orders that begin with s and go on with the filter.
    weight = lambda s: math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())
    at = lambda x, s: F.get(F.col(x), F.lit(s))
    shapley = F.array(*(sum((F.lit(weight(s)) * (at("all", s) - at("all", s | 1 << k)) for s in range(1 << n) if not s >> k & 1), F.lit(0).cast("long")) for k in range(n)))
    df = left.select("*", shapley.alias("shapleys")).select("*", F.explode(every).alias("now")).select("*", "now.*")
    bit = F.expr("shiftleft(1, f)")
    after = F.col("before") + bit
    gone = lambda x: F.get(x, F.col("before")) - F.get(x, after)
    failing = F.get("all", F.lit(0)) - F.get("all", bit)
    return df.select(
        "part", "filter_order", "step", F.get("all", after).alias("kept"), gone("all").alias("removed"), (failing - gone("all")).alias("redundant"),
        F.get("alone", bit).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shapleys", F.col("f")).alias("shapley"),
    )


def op11_filter_interaction(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_filter_interaction": op11_filter_interaction}

#: Order by order and mask by mask: the step at which a mask's documents go, no subsets.
_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM t GROUP BY text),
f AS (
  SELECT t.doc_id, part,
         len(w) < 100 AS fa, 100 * len(list_distinct(w)) < 80 * len(w) AS fb,
         100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 10 * length(t.text) AS fc,
         regexp_matches(t.text, '[#$%&*|]') AS fd, coalesce(t.doc_id > first_id, false) AS fe
  FROM t JOIN firsts ON t.text = firsts.text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, (CASE WHEN fa THEN 'A' ELSE '' END) || (CASE WHEN fb THEN 'B' ELSE '' END) || (CASE WHEN fc THEN 'C' ELSE '' END)
         || (CASE WHEN fd THEN 'D' ELSE '' END) || (CASE WHEN fe THEN 'E' ELSE '' END) AS failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS k FROM o, (SELECT unnest(range(1, 6)) AS step)),
gone AS (
  SELECT c.*, filter_order, (SELECT min(v.i) FROM (SELECT unnest(range(1, 6)) AS i) v WHERE contains(failed, substr(filter_order, v.i, 1))) AS goes
  FROM c, o),
r AS (
  SELECT part, s.filter_order, CAST(step AS INTEGER) AS step, k,
         CAST(sum(n) FILTER (WHERE goes IS NULL OR goes > step) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE goes = step) AS BIGINT) AS removed,
         CAST(sum(n) FILTER (WHERE goes < step AND contains(failed, k)) AS BIGINT) AS redundant, CAST(sum(n) FILTER (WHERE failed = k) AS BIGINT) AS unique_fails,
         CAST(sum(good) FILTER (WHERE goes = step) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (WHERE goes = step) AS BIGINT) AS toxic_lost
  FROM gone JOIN s ON s.filter_order = gone.filter_order GROUP BY part, s.filter_order, step, k)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, k), 0) AS BIGINT) AS shapley
FROM r
"""
SQL = {"op11_filter_interaction": _SQL}
