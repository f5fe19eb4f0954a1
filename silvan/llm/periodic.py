"""Periodic run detection: branching tandem repeats from a suffix tree, rotated and merged into maximal runs.

A run is a stretch of consecutive words with smallest period q, so that words q apart are identical, of at least
max(`min_length`, 2 * q) words, that no neighbouring word extends keeping period q.

The suffix tree is that of Stoye and Gusfield's method, kept as the tree of intervals of the suffix array: the leaves of
a node of depth q are an interval of it. At each node, only the leaf lists of all children but the largest are gone
through; for a leaf i it is asked whether i + q or i - q is a leaf of the node too and goes on with another word, which
makes a branching tandem repeat of period q. A leaf is gone through O(log n) times. A run has one branching repeat, at
its end, and is reached from it by rotating to the left; repeats with a multiple of a run's period that end with it are
merged into it.

A document's words are read once. What cannot be in a run is left out before the tree is built: every word of a run of
twelve words or more lies in a stretch of six words that occurs a second time in the document. Stretches are found by
hash, so a clash only leaves in more words. Documents of a batch are one sequence, in which words of different documents
and the ends of stretches are symbols of their own.

Words are maximal runs of characters other than space and tab to carriage return.

Edge cases: a null, empty or blank text has no words, no runs and an empty collapsed text; a text without runs collapses
to its words with one space between them; a document of any length is one sequence in one task, in memory proportional to
its words; where runs of different periods overlap, each is reported; runs are in order of start, then period; repeated
rows are judged one by one and alike; an empty table gives no rows; other columns, whatever their names, are kept by
`periodic_runs`, but for those it adds, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silvan.functions.arrays import let
from silvan.llm.common import quoted, table, words_of

MIN_LENGTH = 12
#: Words that are looked at together; a longer document is a batch of its own.
BATCH_WORDS = 1 << 18
CHARS_PER_WORD = 6
#: Steps that all repeats are rotated by at once, before what is still going is rotated one by one.
ROTATIONS = 16


def repeated_stretches(ids: np.ndarray, size: int) -> np.ndarray:
    """Whether each place lies in a stretch of `size` symbols that occurs at least twice (or seems to, by hash)."""
    n = len(ids) - size + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    begins = np.zeros(len(ids) + 1, np.int64)
    found = np.zeros(n, bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    at = np.flatnonzero(found)
    np.add.at(begins, at, 1)
    np.add.at(begins, at + size, -1)
    return np.cumsum(begins[:-1]) > 0


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes in order, and each suffix's rank, by doubling; only suffixes still tied are sorted again.

    The last symbol must occur once.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)

    def number(block: np.ndarray, new: np.ndarray, at: np.ndarray) -> None:
        """Ranks of the sorted suffixes of block, which stand at `at`: each group has the place of its first."""
        rank[block] = at[np.maximum.accumulate(np.where(new, np.arange(len(block)), 0))]

    new = np.concatenate(([True], s[order[1:]] != s[order[:-1]]))
    number(order, new, np.arange(n))
    at = np.arange(n)
    step = 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at, block, new = at[tied], order[at[tied]], new[tied]
        if not len(at):
            return order, rank
        # A tied suffix goes on for more than step symbols, as the last symbol is only there once.
        inner = np.lexsort((rank[block + step], rank[block]))
        block = block[inner]
        head, tail = rank[block], rank[block + step]
        new = np.concatenate(([True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
        order[at] = block
        number(block, new, at)
        step *= 2
        full = np.ones(n, bool)
        full[at] = new
        new, at = full, np.arange(n)


def common_prefixes(s: np.ndarray, order: np.ndarray, rank: np.ndarray) -> list[int]:
    """For each place of the suffix array but the first, the length that its suffix shares with the one before it."""
    symbols, sa, at = s.tolist(), order.tolist(), rank.tolist()
    out = [0] * len(symbols)
    shared = 0
    for i, r in enumerate(at):
        if r == 0:
            shared = 0
            continue
        j = sa[r - 1]
        while symbols[i + shared] == symbols[j + shared]:
            shared += 1
        out[r] = shared
        if shared:
            shared -= 1
    return out


def tree_nodes(lcp: list[int]) -> np.ndarray:
    """Inner nodes of the suffix tree but the root: depth, first and last leaf, first and last leaf of the largest child."""
    out: list[int] = []
    depths, firsts, larges = [0], [0], [(0, 0)]
    for k in range(1, len(lcp) + 1):
        shared = lcp[k] if k < len(lcp) else 0
        low, high = k - 1, k - 1  # the child that ends before k: at first a leaf
        while depths[-1] > shared:
            a, b = larges.pop()
            if high - low > b - a:
                a, b = low, high
            low = firsts.pop()
            out += (depths.pop(), low, high, a, b)
        if depths[-1] == shared:
            a, b = larges[-1]
            if high - low > b - a:
                larges[-1] = (low, high)
        else:
            depths.append(shared)
            firsts.append(low)
            larges.append((low, high))
    return np.array(out, np.int64).reshape(-1, 5)


def branching_repeats(s: np.ndarray, order: np.ndarray, rank: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of all branching tandem repeats, in order: s[i : i + q] twice over, and then another symbol."""
    n = len(s)
    depth, first, last, low, high = nodes.T
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # The leaf lists of all children but the largest: what stands before it, and what stands after it.
    begin, size = np.concatenate((first, high + 1)), np.concatenate((low - first, last - high))
    node = np.concatenate((np.arange(len(nodes)),) * 2)
    keep = size > 0
    begin, size, node = begin[keep], size[keep], node[keep]
    upto = np.cumsum(size)
    done = 0
    while done < len(size):
        # Some lists at a time: about as many leaves as there are symbols, or one list.
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + n, "right")))
        part = size[done:stop]
        which = np.repeat(node[done:stop], part)
        leaf = order[np.arange(part.sum()) + np.repeat(begin[done:stop] - np.cumsum(part) + part, part)]
        q, f, t = depth[which], first[which], last[which]
        for left, right in ((leaf, leaf + q), (leaf - q, leaf)):
            ok = (left >= 0) & (right + q < n)
            i, j, p = left[ok], right[ok], q[ok]
            other = rank[j if left is leaf else i]
            inside = (other >= f[ok]) & (other <= t[ok])
            i, j, p = i[inside], j[inside], p[inside]
            branches = s[j] != s[j + p]
            starts.append(i[branches])
            periods.append(p[branches])
        done = stop
    both = np.unique(np.stack((np.concatenate(starts), np.concatenate(periods))), axis=1)
    return both[0], both[1]


def _rotated(s: np.ndarray, start: int, q: int) -> int:
    """The first place from which on s has period q up to start."""
    step = 64
    while start:
        low = max(0, start - step)
        differ = np.flatnonzero(s[low:start] != s[low + q : start + q])
        if len(differ):
            return low + int(differ[-1]) + 1
        start, step = low, 2 * step
    return 0


def maximal_runs(s: np.ndarray, starts: np.ndarray, periods: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """start, length, period of the runs that the branching repeats end, in order of start, then period."""
    ends = starts + 2 * periods
    going = np.arange(len(starts))
    low = starts.copy()
    for _ in range(ROTATIONS):
        at = low[going]
        more = (at > 0) & (s[at - 1] == s[at - 1 + periods[going]])
        going = going[more]
        low[going] -= 1
    more = np.zeros(len(starts), bool)
    more[going] = True
    long = np.flatnonzero(more | (ends - low >= min_length))
    out: list[tuple[int, int, int]] = []
    known: list[tuple[int, int]] = []  # start and period of the runs that end where the last one did
    end = -1
    for k in long[np.lexsort((periods[long], ends[long]))].tolist():
        q = int(periods[k])
        if ends[k] != end:
            end, known = int(ends[k]), []
        if any(q % p == 0 and end - a >= 2 * q for a, p in known):
            continue  # the run of period p itself
        a = _rotated(s, int(low[k]), q) if more[k] else int(low[k])
        known.append((a, q))
        if end - a >= min_length:
            out.append((a, end - a, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(words: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """The runs of each document of a batch, as start, length, period in words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    flat = [w for ws in words for w in ws]
    if not flat:
        return out
    numbers = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    sizes = np.array([len(ws) for ws in words])
    begins = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(words)), sizes)
    ids += doc * len(numbers)  # words of different documents are different symbols
    inside = repeated_stretches(ids, max(1, min_length // 2))
    # Maximal stretches of words inside, each closed by a symbol of its own that no word has.
    places = np.flatnonzero(inside)
    if not len(places):
        return out
    breaks = (np.diff(places) != 1) | (doc[places[1:]] != doc[places[:-1]])
    _, symbols = np.unique(ids[places], return_inverse=True)
    gaps = np.concatenate((np.flatnonzero(breaks) + 1, [len(places)]))
    s = np.insert(symbols, gaps, symbols.max() + 1 + np.arange(len(gaps)))
    origin = np.insert(places, gaps, -1)
    order, rank = suffix_array(s)
    nodes = tree_nodes(common_prefixes(s, order, rank))
    for a, length, q in maximal_runs(s, *branching_repeats(s, order, rank, nodes), min_length):
        at = int(origin[a])
        d = int(doc[at])
        out[d].append((at - int(begins[d]), length, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, carry: Sequence[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all if not given), `runs` (array of start, length, period) and the text `collapsed` to one
    period of each run."""
    new = ("runs", "collapsed")
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([*(T.StructField(c, kinds[c]) for c in carried)])
    run = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
    schema = schema.add("runs", T.ArrayType(run)).add("collapsed", T.StringType())
    run_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def judge(texts: list[str | None]) -> list[tuple[list[dict[str, int]], str]]:
        words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]  # bytes are split at the same six characters
        found = zip(words, runs_of(words, min_length), strict=True)
        return [([{"start": a, "length": n, "period": q} for a, n, q in runs], b" ".join(collapse(w, runs)).decode("utf-8", "surrogatepass")) for w, runs in found]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, chars = [], 0
                while start + len(texts) < batch.num_rows and chars < CHARS_PER_WORD * BATCH_WORDS:
                    texts.append(batch.column(0)[start + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                out = judge(texts)
                old = batch.slice(start, len(texts)).columns[1:]
                yield pa.RecordBatch.from_arrays([*old, pa.array([r for r, _ in out], run_type), pa.array([c for _, c in out], pa.string())], [*carried, *new])
                start += len(texts)

    return docs.select(F.col("text"), *(F.col(quoted(c)) for c in carried)).mapInArrow(find, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and the text with the contract's periods: in a tenth of the documents, chosen by the id's crc32, the words from
    one on are a period of the text over and over. A null id or a text without words changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def again(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i).cast("int")
        return F.array_join(F.transform(words, lambda _, i: F.get(words, at(i))), " ")

    chosen = F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False)) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(chosen, let(words_of(F.col("text")), again)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(planted(table(spark, sf_dir, "documents")), carry=("doc_id",))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), "best.length", (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
SQL: dict[str, str] = {}
