"""PII by weak supervision, with DataFrame functions only.

Candidates of each kind come from a strict pattern (the base, whose matches always stay) and from a wider one. Labelers
vote on every candidate: the strict pattern, a gazetteer (known domains, address ranges, issuers, dialling codes), the
words before it, its borders and its shape. The votes of all documents are counted by pattern of votes, of which there
are a fixed number however large the corpus; from these counts expectation-maximisation estimates how reliable each
labeler is, and a logistic regression on the votes and the length is trained on the resulting probabilities. This span
classifier decides on the candidates that are not base. It and the estimates are a few hundred numbers on the driver.

Positions are code points, end exclusive. Patterns use possessive loops and start only where a run starts, so no text
makes them slow or deep; positions are running sums over blocks of matches, so a text with very many of them takes time in
proportion.

Edge cases: a null or empty text has no spans; long texts are read whole; with no candidates at all the labelers keep
their prior reliabilities; of two spans of one kind that overlap the base one stays, and ties of the vote fall to the
classifier's threshold; repeated rows get the same spans; an empty table gives no rows; `find_pii` and `redact` keep other
columns, whatever their names, and replace one of their output's name, pii by default.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvan.functions.arrays import let
from silvan.llm.common import fresh, quoted, running, table

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: (what a text must hold, pattern, wide pattern's must, wide pattern). A run is tried from its start, or from where the last match ended.
_PATTERNS = {
    "email": (
        "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"[\[(](?i:at)[\])]", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?i:dot)[\])]) ?[A-Za-z0-9-]++)++",
    ),
    "ip": (
        ".", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
        r"\[\.\]", r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    ),
    "card": (
        None, r"[0-9](?:[\x20-]?[0-9]){12,}+",
        r"[0-9]{4}[._/][0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])",
    ),
    "phone": (
        "+", r"\+[0-9][\x20().0-9-]+[0-9]",
        r"[0-9][ .-][0-9]{4}", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    ),
}

#: Gazetteers and context words: fixed values.
_GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl|ch|at|be|pl|ru|cn|jp|in|br|ca|au|us)$",
    "ip": r"^0*(?:[1-9][0-9]?|1[01][0-9]|12[0-689]|1[3-9][0-9]|2[01][0-9]|22[0-3])[^0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|6011|65|62)",
    "phone": r"^\+?(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])[^0-9]|^\(?[2-9][0-9]{2}",
}
_CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write to|correo|courriel|adresse|mailto)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip\b|\bhost\b|server|address|adresse|client|from)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|dial|téléphone|telefon|teléfono)\W*(?:\w+\W+){0,2}$",
}
_AGAINST = r"(?i)(?:version|release|isbn|issn|doi|invoice|order|figure|table|section|chapter|serial|build)\W*(?:\w+\W+){0,1}$"
_SHAPE = {
    "email": r"^[A-Za-z0-9](?:.{0,62}[A-Za-z0-9])?(?:@| ?[\[(])",
    "ip": r"^(?:0|[1-9][0-9]*)(?:(?:\.|\[\.\])(?:0|[1-9][0-9]*)){3}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[^0-9][0-9]{4}){3}|[0-9]{4}[^0-9][0-9]{6}[^0-9][0-9]{5})$",
    "phone": r"^\+?[0-9 ]*(?:\([0-9]{1,4}\))?[0-9 .-]*$",
}
LABELERS = ("pattern", "gazetteer", "context", "borders", "shape")


def _with(value: object, f: Callable) -> Callable:
    """f with its first argument held, as a function of one column."""
    return lambda x: f(value, x)


def _spans(text: Column, pattern: str, must: Column) -> Column:
    """array<struct<start, end, hit, before, after>> of the leftmost non-overlapping matches; the texts between them give
    the positions. before: up to 40 characters, no further back than to the match before the last one; after: one."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")
    zero = F.lit(0)

    def place(gaps: Column, hits: Column) -> Column:
        lengths = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.length(h))

        def one(ends: Column) -> Callable:
            def span(h: Column, i: Column) -> Column:
                start = F.get(ends, i) + F.length(F.get(gaps, i))
                near = F.concat_ws("", F.right(F.get(gaps, i - 1), F.lit(40)), F.right(F.get(hits, i - 1), F.lit(40)), F.right(F.get(gaps, i), F.lit(40)))
                after = F.left(F.concat(F.left(F.get(gaps, i + 1), F.lit(1)), F.left(F.coalesce(F.get(hits, i + 1), F.lit("")), F.lit(1))), F.lit(1))
                return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"), F.right(near, F.lit(40)).alias("before"), after.alias("after"))

            return span

        return let(lengths, lambda n: let(running(n, zero, lambda a, x: a + x), lambda ends: F.transform(hits, one(ends))))

    found = lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda gaps: place(gaps, hits))).otherwise(none)
    return F.when(must, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(none)


def _apart(base: Column, wide: Column) -> Column:
    """Those of wide that touch none of base: in the order of starts, no base span before ends later, none after starts earlier."""
    none = F.filter(wide, lambda _: F.lit(False))
    far = 1 << 30
    mark = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("wide"), x["end"].alias("end"), x.alias("span"))
    ends = lambda m: running(F.transform(m, lambda x: F.when(x["wide"] == 0, x["end"]).otherwise(-1)), F.lit(-1), F.greatest)
    starts = lambda m: F.reverse(running(F.reverse(F.transform(m, lambda x: F.when(x["wide"] == 0, x["start"]).otherwise(far))), F.lit(far), F.least))
    clear = lambda x, i, e, s: (x["wide"] == 1) & (F.get(e, i) <= x["start"]) & (F.get(s, i) >= x["end"])
    kept = lambda m: let(ends(m), lambda e: let(starts(m), lambda s: F.transform(F.filter(m, lambda x, i: clear(x, i, e, s)), lambda x: x["span"])))
    both = F.sort_array(F.concat(F.transform(base, mark(0)), F.transform(wide, mark(1))))
    return F.when(F.size(wide) == 0, none).when(F.size(base) == 0, wide).otherwise(let(both, kept))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(hit)).between(13, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, x: Column, base: bool) -> Column:
    """One number for the votes (0 against, 1 none, 2 for, in base 3 and in the order of LABELERS), whether the span is base, and its length."""
    hit, before = x["hit"], x["before"]
    plain = F.regexp_replace(hit, r"[\[\] ()]", "") if kind != "phone" else hit
    edge = F.concat(F.right(before, F.lit(1)), F.lit("|"), x["after"])
    for_ = lambda c: F.when(c, 2).otherwise(0)
    votes = (
        F.lit(2 if base else 1),
        for_(plain.rlike(_GAZETTEER[kind])),
        F.when(before.rlike(_CONTEXT[kind]), 2).when(before.rlike(_AGAINST), 0).otherwise(1),
        for_(~edge.rlike(r"^[\p{L}\p{N}]|\|[\p{L}\p{N}]")),
        for_(hit.rlike(_SHAPE[kind])),
    )
    code = F.when(F.length(hit) > 40, 2).when(F.length(hit) > 12, 1).otherwise(0)
    for v in votes:
        code = code * 3 + v
    return code * 2 + (1 if base else 0)


def _coded(text: Column) -> Column:
    """struct with a field for each kind: array<struct<start, end, code>>, base spans and those others that touch no base span of their kind."""

    def coded(kind: str, base: Column, wide: Column) -> Column:
        code = lambda is_base: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _votes(kind, x, is_base).alias("code"))
        return let(base, lambda b: let(wide, lambda w: F.concat(F.transform(b, code(True)), F.transform(_apart(b, w), code(False)))))

    def all_kinds(text: Column) -> Column:
        digit, out = text.rlike("[0-9]"), []
        for kind, (must, strict, wide_must, wide) in _PATTERNS.items():
            here = F.lit(True) if kind == "email" else digit
            found = _spans(text, strict, here & (F.lit(True) if must is None else F.contains(text, F.lit(must))))
            base = F.filter(found, _with(kind, lambda k, x: _valid(k, x["hit"])))
            out.append(coded(kind, base, _spans(text, wide, here & text.rlike(wide_must))).alias(kind))
        return F.struct(*out)

    return let(F.coalesce(text, F.lit("")), all_kinds)


def count_votes(docs: DataFrame) -> dict[tuple[str, int], int]:
    """How often each kind's candidates have each pattern of votes, over all documents: at most 4 * 3^6 * 2 numbers."""
    df = docs.select(_coded(F.col("text")).alias("found"))
    codes = F.concat(*(F.transform(f"found.{kind}", _with(k, lambda k, x: F.struct(F.lit(k).alias("kind"), x["code"].alias("code")))) for k, kind in enumerate(KINDS)))
    rows = df.select(F.explode(codes).alias("c")).groupBy("c.kind", "c.code").count().collect()
    return {(KINDS[r["kind"]], r["code"]): r["count"] for r in rows}


def decode(code: int) -> tuple[list[int], int, bool]:
    """Votes (-1, 0, 1), length class, and whether the span is base."""
    base, code, votes = bool(code & 1), code >> 1, []
    for _ in LABELERS:
        votes.append(code % 3 - 1)
        code //= 3
    return votes[::-1], code, base


def estimate(counts: dict[tuple[str, int], int], rounds: int = 50) -> tuple[dict[str, list[tuple[float, float]]], dict[tuple[str, int], float]]:
    """Expectation-maximisation: for each kind and labeler the probability of a true vote on true and on false spans, and
    each pattern's probability of being true. Pseudo-counts stand for a labeler that is right four times in five."""
    reliable = {kind: [(0.8, 0.8)] * len(LABELERS) for kind in KINDS}
    prior = dict.fromkeys(KINDS, 0.5)
    probability: dict[tuple[str, int], float] = {}
    for _ in range(rounds):
        for key in counts:
            kind, votes = key[0], decode(key[1])[0]
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for (sense, spec), v in zip(reliable[kind], votes, strict=True):
                odds += math.log(sense / (1 - spec)) if v > 0 else math.log((1 - sense) / spec) if v < 0 else 0
            probability[key] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for kind in KINDS:
            own = [(decode(c)[0], n, probability[k, c]) for (k, c), n in counts.items() if k == kind]
            prior[kind] = (5 + sum(n * p for _, n, p in own)) / (10 + sum(n for _, n, _ in own))
            reliable[kind] = [
                (
                    (8 + sum(n * p for v, n, p in own if v[i] > 0)) / (10 + sum(n * p for v, n, p in own if v[i])),
                    (8 + sum(n * (1 - p) for v, n, p in own if v[i] < 0)) / (10 + sum(n * (1 - p) for v, n, p in own if v[i])),
                )
                for i in range(len(LABELERS))
            ]
    return reliable, probability


def _features(kind: str, code: int) -> list[float]:
    votes, length, _ = decode(code)
    return [1.0, *(float(k == kind) for k in KINDS), *(float(v > 0) for v in votes), *(float(v < 0) for v in votes), *(float(length == c) for c in range(3))]


def train(counts: dict[tuple[str, int], int], probability: dict[tuple[str, int], float], steps: int = 400, rate: float = 1.0, decay: float = 1e-3) -> list[float]:
    """Weights of the span classifier. Patterns weigh by the root of their count; one pattern for and one against each kind keep it defined without data."""
    rows = [(_features(*key), probability[key], math.sqrt(n)) for key, n in counts.items()]
    for kind in KINDS:
        for vote, p in ((2, 0.95), (0, 0.05)):
            code = 1
            for _ in LABELERS:
                code = code * 3 + vote
            rows.append((_features(kind, code * 2), p, 1.0))
    w, whole = [0.0] * len(rows[0][0]), sum(r[2] for r in rows)
    for _ in range(steps):
        slope = [decay * x for x in w]
        for x, p, n in rows:
            error = n / whole * (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - p)
            slope = [s + error * b for s, b in zip(slope, x, strict=True)]
        w = [a - rate * s for a, s in zip(w, slope, strict=True)]
    return w


def score(weights: list[float], kind: str, code: int) -> float:
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, _features(kind, code), strict=True))))


def find_pii(docs: DataFrame, accept: float = ACCEPT, output: str = "pii") -> DataFrame:
    """docs with `output`: array<struct<kind, start, end, base>>, by kind as in KINDS, then start. docs is read twice: to count votes, and to decide."""
    counts = count_votes(docs)
    _, probability = estimate(counts)
    weights = train(counts, probability)
    accepted = {kind: [c for k, c in counts if k == kind and not decode(c)[2] and score(weights, k, c) >= accept] for kind in KINDS}
    base = lambda x: F.pmod(x["code"], F.lit(2)) == 1
    span = lambda k, x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), F.lit(k).alias("kind"), base(x).alias("base"))

    def decide(found: Column) -> Column:
        kept = {kind: F.filter(found[kind], _with(accepted[kind], lambda codes, x: base(x) | x["code"].isin(codes) if codes else base(x))) for kind in KINDS}
        return F.concat(*(F.array_sort(F.transform(k, _with(kind, span))) for kind, k in kept.items()))

    return docs.drop(output).withColumn(output, let(_coded(F.col("text")), decide))


#: Characters of the pieces into which a text is cut before parts of it are read by position.
PIECE = 4_096


def _without_spans(text: Column, spans: Column) -> Column:
    """text with each of the sorted spans replaced by its kind; one that starts before an earlier one's end goes with that one."""
    part = lambda piece, k, start, stop: F.substring(piece, F.greatest(start - k * PIECE, F.lit(0)) + 1, F.least(stop, (k + 1) * PIECE) - F.greatest(start, k * PIECE))

    def between(pieces: Column, start: Column, stop: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor((stop - 1) / PIECE).cast("int")
        parts = F.transform(F.sequence(first, last), lambda k: part(F.get(pieces, k), k, start, stop))
        return F.when(stop > start, F.array_join(parts, "")).otherwise("")

    def build(pieces: Column, ends: Column, last: Column) -> Column:
        new = lambda x, i: F.concat(between(pieces, F.get(ends, i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        parts = F.transform(spans, lambda x, i: F.when(x["start"] >= F.get(ends, i), new(x, i)).otherwise(""))
        return F.concat(F.array_join(parts, ""), between(pieces, last, F.length(text)))

    def cut(stops: Column) -> Column:
        ends = running(stops, F.lit(0), F.greatest)
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return let(pieces, lambda p: let(ends, lambda e: let(F.array_max(stops), lambda last: build(p, e, last))))

    return let(F.transform(spans, lambda x: x["end"]), cut)


def redact(found: DataFrame, pii: str = "pii") -> DataFrame:
    """found with each span of its text replaced by the kind's name in brackets; what overlaps goes with the first. n_chars, if there, counts anew; pii goes."""
    by_start = lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["kind"].alias("kind"))
    spans = F.col(quoted(pii))
    clean = let(F.array_sort(F.transform(spans, by_start)), lambda s: _without_spans(F.col("text"), s))
    out = found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in found.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(found.schema["n_chars"].dataType), F.col("n_chars")))
    return out.drop(pii)


def redacted(docs: DataFrame) -> DataFrame:
    """docs, all columns, with personal data replaced by its kind."""
    output = fresh(docs, "pii")
    return redact(find_pii(docs, output=output), output)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["base"])
    n = {f"n_{k}": F.size(F.filter("pii", _with(k, lambda k, x: x["base"] & (x["kind"] == k)))).cast("long") for k in KINDS}
    return found.select("doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
