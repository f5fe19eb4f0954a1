"""URL filters: explicit host and path rules, and a logistic regression on hashed character n-grams of host and path.

Rules come first: a rule fits its host and all subdomains if the path starts with the rule's path, and the longest rule
that fits decides. All other URLs get the classifier's verdict. The classifier is trained on the driver from a small
labelled table (at most `MAX_LABELLED` rows are accepted) and is `2 ** BITS` weights, so what tasks receive is fixed.

Up to `MAX_RULES` rules are one expression. A longer list, or one given as a table (`match_rules`), is joined on the
suffixes of the host, of which a host has as many as labels; both ways give the same rule.

Edge cases: a null URL, or one without `://`, has an empty host and path, fits no rule and gets the classifier's verdict
on no features, its bias; a score of exactly the threshold blocks; of rules of equal length that both fit the first by text
wins, and of one rule given twice with different verdicts block; very long URLs are read whole; repeated rows are judged
alike, each by itself; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvan.llm.common import ascii_lower, materialise, table

BITS = 15
ORDERS = (3, 4, 5)
MAX_LABELLED = 10_000
#: Rules that are tried as one expression; a longer list is joined.
MAX_RULES = 1_000

#: Fixed values of the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


#: Words of unwanted and of ordinary URLs, from which the labelled table is made.
BAD = (
    "casino poker slots betting jackpot roulette blackjack bingo gambling wager porn xxx sex escort nude camgirls hentai erotic milf viagra cialis "
    "pills pharma steroids levitra payday loans torrent warez crack keygen serial nulled cracked pirate replica"
).split()
GOOD = (
    "news wiki docs library school museum garden science history recipes travel weather music art sport health forum blog university research "
    "journal books theatre energy nature kitchen culture education government council hospital family language community project software"
).split()
NEUTRAL = "home main site page list index item place thing net web portal".split()


def labelled_urls(bad: Iterable[str] = tuple(BAD), good: Iterable[str] = tuple(GOOD)) -> list[tuple[str, str]]:
    """A small labelled table: unwanted trades on hosts and paths of their kind, and ordinary pages."""
    bad, good = list(bad), list(good)
    hosts = ("www.{}.com", "{}-online.net", "best{}.org", "m.{}.example.com", "{}24.info", "my{}s.net")
    paths = ("/", "/{}/index.html", "/en/{}/12", "/page/{}?id=7", "/{}-free", "/top/{}s/3.html")
    out = []
    for label, words in (("block", bad), ("allow", good)):
        for i, w in enumerate(words):
            for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
                other = NEUTRAL[(i * 5 + k) % len(NEUTRAL)]
                # Half of the URLs say it in the host, half in the path.
                host, path = (h.format(w), p.format(other)) if k % 2 == 0 else (h.format(other), p.format(w))
                out.append((f"http://{host}{path}", label))
    return out + [(f"http://{w}.example.{t}/{c}/{i * 977}", "allow") for i, (w, t) in enumerate(zip(good, ["com", "net", "org"] * 12)) for c in ("en", "de")]


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def longest_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0] != "block"))
    if len(ordered) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are accepted")
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule = verdict = None
    for what, text in ordered:
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (row, host, path, ...) with `rule` and `verdict` of the longest rule that fits, null if none does. rules: verdict, rule.

    Each host meets the rules of its suffixes in an equi-join, so the list may be as long as a table; of what fits, only the
    best for each row goes on. row must be the same whenever the rows are read.
    """
    slash = F.instr("rule", "/")
    listed = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block above allow
    listed = listed.select("rule", "verdict", F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule")).alias("suffix"), F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise("").alias("start"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = pages.select("row", "path", F.explode(suffixes).alias("suffix")).join(listed, "suffix").filter(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("row").agg(F.min(F.struct((-F.length("rule")).alias("shorter"), "rule", "verdict")).alias("best"))
    return pages.join(best.select("row", "best.rule", "best.verdict"), "row", "left")


def features(host: str, path: str, bits: int = BITS) -> np.ndarray:
    """Distinct buckets of the character n-grams, host and path apart."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        if len(text) > 2:
            for n in ORDERS:
                found.update(zlib.crc32((mark + text[i : i + n]).encode("utf-8", "surrogatepass")) for i in range(len(text) - n + 1))
    return np.unique(np.fromiter(found, np.int64, len(found)) & ((1 << bits) - 1))


def split_url(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def train(labelled: Iterable[tuple[str, str]], bits: int = BITS, passes: int = 200, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias, by full gradient steps on features scaled to unit length; the same rows always give the same model."""
    rows = list(labelled)
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs are accepted")
    feats = [features(*split_url(u), bits) for u, _ in rows]
    y = np.array([label == "block" for _, label in rows], float)
    weights, bias = np.zeros(1 << bits), 0.0
    owner = np.repeat(np.arange(len(rows)), [len(f) for f in feats])
    flat = np.concatenate(feats) if feats else np.zeros(0, np.int64)
    scale = np.repeat([1 / max(1, len(f)) ** 0.5 for f in feats], [len(f) for f in feats])
    for _ in range(passes):
        z = np.bincount(owner, weights[flat] * scale, len(rows)) + bias
        error = 1 / (1 + np.exp(-z)) - y
        weights -= rate * (np.bincount(flat, error[owner] * scale, 1 << bits) / max(1, len(rows)) * 10 + decay * weights)
        bias -= rate * error.mean() if len(rows) else 0
    return weights, float(bias)


def classify(docs: DataFrame, model: tuple[np.ndarray, float], host: str = "host", path: str = "path") -> DataFrame:
    """docs with `block_score`, the probability that the URL is to be blocked."""
    weights, bias = model
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    bits = int(np.log2(len(weights)))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = held.value
        for hosts, paths in parts:
            z = [float(w[f].sum()) / max(1, len(f)) ** 0.5 + bias for f in (features(h, p, bits) for h, p in zip(hosts, paths, strict=True))]
            yield pd.Series(1 / (1 + np.exp(-np.array(z, float))))

    return docs.withColumn("block_score", score(F.col(host), F.col(path)))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame = RULES, labelled: Iterable[tuple[str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, url, host, path, rule, verdict, block_score of every page. rules: (verdict, rule), or a table of both."""
    model = train(labelled_urls() if labelled is None else labelled)
    host, path = host_path(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if len(rules) > MAX_RULES:
            rules = pages.sparkSession.createDataFrame(rules, "verdict string, rule string")
    if isinstance(rules, DataFrame):
        df = match_rules(materialise(df.withColumn("row", F.monotonically_increasing_id()), "url-rows"), rules)
    else:
        rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
        df = df.withColumns({"rule": rule, "verdict": verdict})
    learned = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return classify(df, model).select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "block_score")


def op1_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_score")


QUERIES = {"op1_url_filter": op1_url_filter}
SQL: dict[str, str] = {}
