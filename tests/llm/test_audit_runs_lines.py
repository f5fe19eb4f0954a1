import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import EDGES

from silvan.llm import interaction, line_dedup, periodic

WORD = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op11 -----------------------------------------------------------------------------------------------------------


def plain_masks(rows):
    """Filters that each row of (doc_id, text, lang) fails."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        w = re.findall(WORD, text)
        earlier = any((t or "") == text and doc_id is not None and i is not None and i < doc_id for i, t, _ in rows)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": earlier}
        out.append({k for k, v in fails.items() if v})
    return out


def plain_audit(rows, labels):
    parts = defaultdict(list)
    for row, fails in zip(rows, plain_masks(rows), strict=True):
        mine = [r for r in labels if r[0] == row[0] is not None]
        parts[row[2] or ""].append((fails, any(q == 1 for _, q, _ in mine), any(x == 1 for _, _, x in mine)))
    out = {}
    for part, mine in parts.items():
        shapley = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone), f]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = shapley[row[6]] if isinstance(row[6], str) else row[6]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_every_order(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "A", "SHOUTED " * 120, "one two # three", " ".join(f"w{k}" for k in range(150)), " ".join(f"w{k} |" for k in range(90)), "x " * 99]
    rows = [(rng.choice([None, k, k, k - 1]), rng.choice(texts), rng.choice(["en", "de", "", None])) for k in range(120)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "y", 1) for r in rows], "doc_id long, text string, lang string, mask string, good int")
    got = interaction.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(rows, labels)
    found = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got}
    assert found == want and len(got) == len(want) == 3 * 600


def test_audit_of_fewer_filters_and_no_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(docs([]), labels).count() == 0
    rows = {(r["filter_order"], r["step"]): r for r in interaction.audit(docs(EDGES), labels, filters="AB").collect()}
    assert len(rows) == 4
    # All but the long text have too few words; the long one repeats its word.
    assert [rows["AB", 1]["removed"], rows["AB", 2]["removed"], rows["BA", 1]["removed"], rows["BA", 2]["removed"]] == [len(EDGES) - 1, 1, 1, len(EDGES) - 1]
    for wrong in ("", "AA"):
        with pytest.raises(ValueError, match="filters"):
            interaction.audit(docs(EDGES), labels, filters=wrong)


# --- op12 -----------------------------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    """Every period, every stretch that keeps it; the smallest period of a stretch is its own."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_query(doc_id, text):
    w = re.findall(WORD, text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    digests = sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests)


def texts_with_runs(rng):
    vocabulary = [f"w{k}" for k in range(rng.choice([1, 2, 3, 60]))]
    w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 160))]
    for _ in range(rng.randint(0, 3)):
        if len(w) > 4:
            a = rng.randrange(len(w))
            p = rng.randint(1, max(1, len(w) // 4))
            end = rng.randint(a, len(w))
            w = [w[a + (i - a) % p] if a <= i < end else x for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_every_period(least):
    rng = random.Random(least)
    for _ in range(300):
        batch = [[x.encode() for x in texts_with_runs(rng)] for _ in range(rng.randint(1, 4))]
        assert periodic.runs_of(batch, least) == [plain_runs(w, least) for w in batch]


def test_suffix_tree_leaves_and_depths():
    import numpy as np

    s = np.array([*map(ord, "mississippi"), 0])
    order, rank = periodic.suffix_array(s)
    assert order.tolist() == sorted(range(12), key=lambda i: s[i:].tolist()) and rank[order].tolist() == list(range(12))
    lcp = periodic.common_prefixes(s, order, rank)
    nodes = {(d, "mississippi"[order[f] : order[f] + d], l - f + 1) for d, f, l, _, _ in periodic.tree_nodes(lcp).tolist()}
    assert nodes == {(1, "i", 4), (4, "issi", 2), (1, "p", 2), (1, "s", 4), (2, "si", 2), (3, "ssi", 2)}


def test_long_periods_take_no_square_of_time():
    for w in ([b"a"] * 200_000, [b"w%d" % (i % 50_000) for i in range(200_000)]):
        assert [r[:2] for r in periodic.runs_of([w])[0]] == [(0, 200_000)]


def test_query_of_runs_against_plain_one(spark, tmp_path):
    rng = random.Random(9)
    chosen = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(texts_with_runs(rng))) for i in [*range(100), *chosen]]
    rows += [(7, None), (8, ""), (9, " \t"), (None, "x " * 30), (None, None), (10, "a b " * 40), (10, "a b " * 40), (11, "word " * 30_000), (chosen[0], " "), (chosen[1], None)]
    spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *plain_query(i, t))) if t is None or len(t) < 100_000 else repr(next(r for r in got if r[0] == 11)) for i, t in rows)
    assert next(r for r in got if r[0] == 11)[1:6] == (1, 0, 30_000, 1, 30_000_000)


def test_runs_keep_other_columns(spark, docs):
    rows = docs([*EDGES, (20, "p q r " * 8)]).withColumn("found", F.lit(1)).withColumn("runs", F.lit("old"))
    got = periodic.periodic_runs(rows)
    assert set(got.columns) == {*rows.columns, "collapsed"} and got.count() == len(EDGES) + 1
    last = got.filter("doc_id = 20").first()
    assert [tuple(r) for r in last["runs"]] == [(0, 24, 3)] and last["collapsed"] == "p q r" and last["found"] == 1
    assert periodic.periodic_runs(docs([])).count() == 0


# --- op13 -----------------------------------------------------------------------------------------------------------


def plain_key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))


def plain_lines(rows, min_docs, keep="none", min_chars=1):
    """n_lines, n_dropped, text of each row, from every line's key looked up in every row."""
    keys = [[plain_key(x) for x in (t or "").split("\n")] for _, t in rows]
    common = {k for k in itertools.chain(*keys) if len(k) >= min_chars and sum(k in mine for mine in keys) >= min_docs}
    first = {}
    for nth in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0)):
        for at, k in enumerate(keys[nth]):
            first.setdefault(k, (rows[nth], at))
    out = []
    for nth, (i, t) in enumerate(rows):
        lines = (t or "").split("\n")
        stays = [x for at, x in enumerate(lines) if keys[nth][at] not in common or keep == "first" and first[keys[nth][at]] == ((i, t), at)]
        out.append((i, len(lines), len(lines) - len(stays), "\n".join(stays)))
    return out


LINES = ["", " ", "Footer", "footer \r", "FOOTER", "é", "a b", "A  b", "\t", "x" * 300, "only "]


@pytest.mark.parametrize("min_docs", [1, 2, 4])
def test_lines_against_plain_counts(docs, min_docs):
    rng = random.Random(min_docs)
    rows = [(k, "\n".join(rng.choice([*LINES, f"own {k}"]) for _ in range(rng.randint(1, 12)))) for k in range(14)]
    rows += [(50, "\n".join([*(f"u{k}" for k in range(200)), "Footer", *(f"u{k}" for k in range(200, 300)), "footer"])), *(r[:2] for r in EDGES), rows[0], rows[0]]
    got = line_dedup.kept_lines(docs(rows), min_docs=min_docs)
    assert sorted(map(repr, (tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()))) == sorted(map(repr, plain_lines(rows, min_docs)))
    assert set(got.columns) == {*docs([]).columns, "n_lines", "n_dropped", "kept_text"}


def test_lines_first_occurrence_stays(docs):
    rows = [(5, "head\nbody\nhead"), (3, "Head \nx"), (9, "body\n\nhead"), (1, "y")]
    got = line_dedup.kept_lines(docs(rows), min_docs=1, keep="first").select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_lines(rows, 1, "first")) == [(1, 1, 0, "y"), (3, 2, 0, "Head \nx"), (5, 3, 2, "body"), (9, 3, 2, "")]
    with pytest.raises(ValueError, match="keep"):
        line_dedup.drop_bitmaps(docs(rows), keep="last")


def test_bitmaps_leave_out_stretches_without_loss(docs):
    text = "\n".join([*(f"l{k}" for k in range(130)), "same", *(f"m{k}" for k in range(70))])
    (row,) = line_dedup.drop_bitmaps(docs([(1, text), (1, text)]), min_docs=2, min_chars=4, partitions=3).collect()
    # All lines of four code points are in both rows: those from 100 on in either series, and the one between.
    bits = [b for w, b in row["kept"]], [w for w, b in row["kept"]]
    assert bits[1] == [1, 2] and [x for x in range(64) if not bits[0][0] >> x & 1] == list(range(100 - 64, 64))
    (row,) = line_dedup.drop_bitmaps(docs([(1, text), (2, "same")]), min_docs=2).filter(F.size("kept") == 1).filter("kept[0].word = 2").collect()
    assert tuple(row["kept"][0]) == (2, ~(1 << 2))
    assert line_dedup.kept_lines(docs([])).count() == 0


def test_lines_of_rows_equal_in_id_and_text_count_each(docs):
    rows = [(4, "twice\nonce"), (4, "twice\nonce"), (5, "other")]
    got = {(r["doc_id"], r["kept_text"]) for r in line_dedup.kept_lines(docs(rows), min_docs=2).collect()}
    assert got == {(4, ""), (5, "other")}
