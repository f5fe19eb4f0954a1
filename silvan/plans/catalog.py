"""The catalogue: each query with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvan.functions import text as T
from silvan.functions import vector as V
from silvan.operators import audit, balls, cells, embedding, ingest, intervals, manifold, mapview, projection, results, search, sequences, span_store, spans, taxonomy, tree, trigrams
from silvan.plans import domain as D
from silvan.session import cut, read_table, scratch_path
from silvan.sources import documents, dump, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, domain: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            tables = sql.lstrip()[:6].upper() != "SELECT"
            head = f"WITH RECURSIVE {D.DOMAIN_SQL}" + (", " if tables else "") if domain else "WITH RECURSIVE " if tables else ""
            SQL[f.__name__] = head + sql
        return f

    return add


def _vectors(s, d):
    """All vectors, with the lang and source of their documents if they have one."""
    return read_table(s, d, "embeddings").join(read_table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id", "left")


_DIST = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT e.vec_id, e.label, d.lang, d.source, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.q) AS dist
      FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id, q)
"""


# ---- vector search ----
@query(_DIST + "SELECT vec_id, lang, source, round_even(1 - dist, 4) AS score FROM v WHERE vec_id <> 0 ORDER BY dist, vec_id LIMIT 10")
def vector_topk(s, d):
    e = read_table(s, d, "embeddings")
    page = search.top_k(e.filter("vec_id != 0").select("vec_id", "embedding"), search.vector_of(e, "vec_id", 0))
    of = read_table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return page.join(of, "vec_id", "left").select("vec_id", "lang", "source", "score")


@query("""w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id IN (0, 7, 13)),
n AS (SELECT w.vec_id AS query, e.vec_id, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), w.q) AS dist FROM w, embeddings e)
SELECT query, vec_id, score FROM (SELECT query, vec_id, round_even(1 - dist, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY dist, vec_id) AS k FROM n) WHERE k <= 15""", domain=False)
def vector_topk_indexed(s, d):
    """Three searches through one index of balls."""
    where = scratch_path(s, "balls")
    e = read_table(s, d, "embeddings").select("vec_id", "embedding")
    balls.write_index(e, where, n_balls=64)
    index = balls.Balls(s, where)
    pages = [index.top_k(search.vector_of(e, "vec_id", q), 15).select(F.lit(q).cast("long").alias("query"), "vec_id", "score") for q in (0, 7, 13)]
    return reduce(DataFrame.unionByName, pages)


@query(_DIST + "SELECT vec_id, lang, label, round_even(1 - dist, 4) AS score FROM v WHERE lang IN ('en', 'fr') AND label BETWEEN 2 AND 6 ORDER BY dist, vec_id LIMIT 15")
def vector_topk_filtered(s, d):
    e = read_table(s, d, "embeddings")
    df = search.keep_range(search.keep_ids(_vectors(s, d), "lang", ["en", "fr"]), "label", 2, 6)
    return search.top_k(df, search.vector_of(e, "vec_id", 0), 15).select("vec_id", "lang", "label", "score")


@query(_DIST + "SELECT vec_id, round_even(1 - dist, 4) AS score FROM v ORDER BY dist, vec_id LIMIT 10 OFFSET 10")
def vector_topk_offset(s, d):
    e = read_table(s, d, "embeddings")
    return search.top_k(e.select("vec_id", "embedding"), search.vector_of(e, "vec_id", 0), 10, 10).select("vec_id", "score")


@query(_DIST + "SELECT vec_id, round_even(1 - dist, 4) AS score FROM v WHERE NOT EXISTS (SELECT 1 FROM bridge b WHERE b.span_id = v.vec_id AND b.unit_id = 5) ORDER BY dist, vec_id LIMIT 10")
def vector_topk_exclude_anti(s, d):
    e = read_table(s, d, "embeddings")
    found = search.without_units(e.select("vec_id", "embedding"), D.bridge(s, d), 5)
    return search.top_k(found, search.vector_of(e, "vec_id", 0)).select("vec_id", "score")


_UNITVEC = """p AS (
  SELECT b.unit_id, i, sum(CASE WHEN weight > 0 THEN weight ELSE 1 END * CAST(e.embedding[i] AS DOUBLE)) / sum(CASE WHEN weight > 0 THEN weight ELSE 1 END) AS x
  FROM bridge b JOIN embeddings e ON e.vec_id = b.span_id, range(1, 65) t(i) GROUP BY b.unit_id, i),
n AS (SELECT unit_id, sqrt(sum(x * x)) AS n FROM p GROUP BY unit_id)
"""


@query(_UNITVEC + "SELECT p.unit_id, CAST(i - 1 AS INT) AS pos, round(x / n, 6) AS value FROM p JOIN n ON n.unit_id = p.unit_id")
def unit_weighted_vector(s, d):
    u = search.unit_vectors(D.bridge(s, d), read_table(s, d, "embeddings"))
    return u.select("unit_id", F.posexplode("vector").alias("pos", "v")).select("unit_id", "pos", F.round("v", 6).alias("value"))


def _passage(s, d, unit):
    e = read_table(s, d, "embeddings").select("vec_id", "embedding")
    own = e.select((F.col("vec_id") + D.DOC).alias("unit_id"), F.col("embedding").alias("vector"))
    return search.passage(unit, e, D.bridge(s, d), own).select("vec_id", "score")


@query(_UNITVEC + """, u AS (SELECT p.unit_id, list(x / n ORDER BY i) AS v FROM p JOIN n ON n.unit_id = p.unit_id GROUP BY p.unit_id)
SELECT e.vec_id, round_even(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), u.v), 4) AS score
FROM embeddings e, u WHERE u.unit_id = 7 AND NOT EXISTS (SELECT 1 FROM bridge b WHERE b.span_id = e.vec_id AND b.unit_id = 7)
ORDER BY 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), u.v), e.vec_id LIMIT 10""")
def passage_search(s, d):
    return _passage(s, d, 7)


@query(_DIST.replace("vec_id = 0", "vec_id = 5") + "SELECT vec_id, round_even(1 - dist, 4) AS score FROM v ORDER BY dist, vec_id LIMIT 10")
def passage_search_own(s, d):
    """A document that no span covers is searched for by its own vector."""
    return _passage(s, d, D.DOC + 5)


@query("""a AS (SELECT i AS place, u FROM (SELECT unnest([3, 1, 3, 99999999, 7]) AS u, unnest(range(5)) AS i)),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
SELECT CAST(place AS INT) AS place, e.vec_id AS unit_id, round_even(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q), 6) AS score FROM a JOIN embeddings e ON e.vec_id = a.u, q""")
def compare_units(s, d):
    v = read_table(s, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return search.compare(0, [3, 1, 3, 99999999, 7], v).select("place", F.col("unit_id").cast("long").alias("unit_id"), "score")


@query("SELECT span_id, list(unit_id ORDER BY unit_order) AS unit_ids FROM bridge GROUP BY span_id")
def span_supports(s, d):
    return search.supports(D.bridge(s, d))


@query("""v AS (SELECT unit_id FROM unit WHERE corpus_id NOT IN (1) AND height NOT IN (0)), r AS (SELECT vec_id, vec_id AS place FROM embeddings)
SELECT r.vec_id AS span_id, r.place FROM r WHERE EXISTS (SELECT 1 FROM bridge b JOIN v ON v.unit_id = b.unit_id + 1000000000 WHERE b.span_id = r.vec_id) ORDER BY place, span_id LIMIT 10""")
def visible_results(s, d):
    v = search.visible_units(D.units(s, d), hidden_corpora=[1], hidden_heights=[0])
    b = D.bridge(s, d).withColumn("unit_id", F.col("unit_id") + D.DOC)
    r = read_table(s, d, "embeddings").select(F.col("vec_id").alias("span_id"), F.col("vec_id").alias("place"))
    return search.visible_results(r, b, v)


@query("SELECT unit_id, version_id FROM unit WHERE corpus_id NOT IN (1) AND version_id NOT IN (7, 9) AND height NOT IN (0)")
def visible_units(s, d):
    return search.visible_units(D.units(s, d), [1], [7, 9], [0]).select("unit_id", "version_id")


@query(_DIST + "SELECT vec_id, CASE WHEN 1 - dist >= 0.75 THEN 'high' WHEN 1 - dist >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM v")
def score_bands(s, d):
    q = search.vector_of(read_table(s, d, "embeddings"), "vec_id", 0)
    return read_table(s, d, "embeddings").select("vec_id", T.score_band(V.cosine_to(F.col("embedding"), q)).alias("band"))


# ---- keyword search ----
_MATCH = "(u.text ILIKE '%{0}%' OR u.label ILIKE '%{0}%' OR u.path ILIKE '%{0}%' OR c.name ILIKE '%{0}%')"


@query(f"SELECT u.unit_id, c.name AS corpus, u.label, 1.0::DOUBLE AS score FROM unit u JOIN corpus c ON c.corpus_id = u.corpus_id WHERE {_MATCH.format('licen_ed')} ORDER BY u.unit_id LIMIT 20 OFFSET 5")
def keyword_search(s, d):
    return search.keyword(D.units(s, d), D.corpora(s, d), "licen_ed", limit=20, offset=5).select("unit_id", "corpus", "label", "score")


def _indexed_units(s, d):
    """The units, and an index over their texts, labels and paths, as an ingest writes them."""
    where, units = scratch_path(s, "trigrams"), scratch_path(s, "units")
    D.units(s, d).write.parquet(units)
    trigrams.write_index(s.read.parquet(units), where, ("text", "label", "path"))
    return s.read.parquet(units), where


@query(f"SELECT u.unit_id, c.name AS corpus, u.label, 1.0::DOUBLE AS score FROM unit u JOIN corpus c ON c.corpus_id = u.corpus_id WHERE {_MATCH.format('licen_ed')} ORDER BY u.unit_id LIMIT 20 OFFSET 5")
def keyword_search_indexed(s, d):
    units, where = _indexed_units(s, d)
    return trigrams.keyword(units, D.corpora(s, d), where, "licen_ed", limit=20, offset=5).select("unit_id", "corpus", "label", "score")


@query("SELECT unit_id, depth, label FROM unit WHERE text ILIKE '%nedb%' OR label ILIKE '%nedb%' OR path ILIKE '%nedb%' ORDER BY depth, unit_id LIMIT 200")
def autocomplete_indexed(s, d):
    units, where = _indexed_units(s, d)
    return trigrams.autocomplete(units, where, "NEDB", limit=200).select("unit_id", "depth", "label")


@query(f"SELECT u.unit_id, u.path FROM unit u JOIN corpus c ON c.corpus_id = u.corpus_id WHERE u.corpus_id IN (1, 2) AND u.height BETWEEN 0 AND 1 AND {_MATCH.format('SRC1')} ORDER BY u.unit_id LIMIT 500")
def keyword_multi_column(s, d):
    return search.keyword(D.units(s, d), D.corpora(s, d), "SRC1", [1, 2], height=(0, 1), depth=(1, None), limit=500).select("unit_id", "path")


@query("SELECT unit_id, depth, label FROM unit WHERE height = 1 AND (text ILIKE '%17%' OR label ILIKE '%17%' OR path ILIKE '%17%') ORDER BY depth, unit_id LIMIT 20")
def autocomplete_ordered(s, d):
    return search.autocomplete(D.units(s, d), "17", 1).select("unit_id", "depth", "label")


@query("SELECT unit_id, label FROM unit WHERE false")
def empty_filter_returns_none(s, d):
    return search.keyword(D.units(s, d), D.corpora(s, d), "a", []).select("unit_id", "label")


@query("SELECT vec_id, label FROM embeddings ORDER BY coalesce(label = 5, false) DESC, label, vec_id LIMIT 1", domain=False)
def profile_defaults(s, d):
    return search.default_row(read_table(s, d, "embeddings"), "label", 5, "vec_id").select("vec_id", "label")


# ---- tree ----
_CLOSURE = """cl(ancestor, descendant, distance) AS (
  SELECT unit_id, unit_id, 0 FROM unit UNION ALL SELECT u.parent_id, cl.descendant, cl.distance + 1 FROM cl JOIN unit u ON u.unit_id = cl.ancestor WHERE u.parent_id IS NOT NULL)
"""


@query(_CLOSURE + "SELECT * FROM cl")
def tree_closure(s, d):
    return tree.closure(D.units(s, d), "unit_id")


@query("SELECT unit_id AS id, path FROM unit")
def tree_ancestor_path(s, d):
    return tree.paths(D.units(s, d))


_NODE_CLOSURE = """cl(ancestor, descendant, distance) AS (
  SELECT id, id, 0 FROM node UNION ALL SELECT n.parent_id, cl.descendant, cl.distance + 1 FROM cl JOIN node n ON n.id = cl.ancestor WHERE n.parent_id IS NOT NULL),
leaf AS (SELECT id FROM node WHERE id NOT IN (SELECT parent_id FROM node WHERE parent_id IS NOT NULL))
"""


@query(_NODE_CLOSURE + "SELECT ancestor AS id, CAST(min(distance) AS INT) AS height FROM cl JOIN leaf ON leaf.id = cl.descendant GROUP BY ancestor")
def tree_height_min_leaf(s, d):
    return tree.heights(cut(D.unbalanced(s, d)))


@query("SELECT unit_id, label FROM unit WHERE parent_id IS NULL AND version_id = (SELECT min(version_id) FROM unit) ORDER BY depth, unit_id")
def tree_roots(s, d):
    return tree.roots(D.units(s, d)).select("unit_id", "label")


@query("""page AS (SELECT * FROM unit WHERE parent_id = 1 ORDER BY depth, unit_id LIMIT 20 OFFSET 2),
f AS (SELECT parent_id, count(*) AS n, min(unit_id) AS c FROM unit GROUP BY parent_id)
SELECT page.unit_id, page.label, page.depth, coalesce(f.n, 0) AS n_children, f.c AS first_child, u.label AS first_label
FROM page LEFT JOIN f ON f.parent_id = page.unit_id LEFT JOIN unit u ON u.unit_id = f.c""")
def tree_children_preview(s, d):
    return tree.children_preview(D.units(s, d), 1, 20, 2)


def _intervals(s, d):
    """The units with their intervals, as an ingest writes them."""
    path = scratch_path(s, "intervals")
    intervals.write(intervals.with_intervals(D.units(s, d)), path)
    return intervals.read(s, path)


@query(_CLOSURE + "SELECT ancestor AS id, CAST(2 - distance AS INT) AS place FROM cl WHERE descendant = 1000000000001")
def tree_ancestors(s, d):
    return intervals.ancestors(_intervals(s, d), 1_000_000_000_001).select(F.col("unit_id").alias("id"), "place")


@query(_CLOSURE + "SELECT u.unit_id, u.label FROM cl JOIN unit u ON u.unit_id = cl.descendant AND u.height = 0 WHERE cl.ancestor = 2 ORDER BY u.unit_id LIMIT 50 OFFSET 10")
def tree_leaves_paged(s, d):
    return intervals.leaves(_intervals(s, d), 2, 50, 10).select("unit_id", "label")


@query("""w(unit_id, way) AS (SELECT unit_id, [unit_id] FROM unit WHERE parent_id IS NULL UNION ALL SELECT u.unit_id, list_append(w.way, u.unit_id) FROM w JOIN unit u ON u.parent_id = w.unit_id),
cl(ancestor, descendant) AS (SELECT unit_id, unit_id FROM unit UNION ALL SELECT u.parent_id, cl.descendant FROM cl JOIN unit u ON u.unit_id = cl.ancestor WHERE u.parent_id IS NOT NULL),
n AS (SELECT ancestor AS unit_id, count(*) AS n FROM cl GROUP BY ancestor),
e AS (SELECT unit_id, row_number() OVER (ORDER BY way) AS enter FROM w)
SELECT e.unit_id, enter, enter + n - 1 AS leave FROM e JOIN n ON n.unit_id = e.unit_id""")
def tree_intervals(s, d):
    return _intervals(s, d).select("unit_id", "enter", "leave")


@query("SELECT unit_id, version_id AS division FROM unit")
def tree_division(s, d):
    return tree.division(D.units(s, d))


@query(_CLOSURE + "SELECT cl.descendant AS unit_id, u.height, cl.ancestor FROM cl JOIN unit u ON u.unit_id = cl.ancestor WHERE u.height >= 1")
def tree_ancestor_per_height(s, d):
    return tree.ancestor_per_height(D.units(s, d))


@query("SELECT parent_id AS unit_id, unit_id AS below FROM unit WHERE height = 1")
def tree_first_level_below(s, d):
    return tree.first_level_below(D.units(s, d))


@query("SELECT unit_id, label FROM unit WHERE height > 0 AND label IS NOT NULL")
def unit_labels(s, d):
    return D.units(s, d).filter("height > 0 and label is not null").select("unit_id", "label")


# ---- taxonomy ----
_UP = """up AS (SELECT t.id AS taxonomy_id, t.id, t.name, t.level FROM taxonomy t UNION ALL SELECT t.id, p.id, p.name, p.level FROM taxonomy t JOIN taxonomy p ON p.id = t.parent_id)
"""


@query(_UP + "SELECT corpus, list(name ORDER BY level, id) AS chain FROM (SELECT DISTINCT corpus, up.id, name, level FROM link JOIN up USING (taxonomy_id)) GROUP BY corpus")
def taxonomy_chain_union(s, d):
    return taxonomy.chain_union(D.taxonomy_links(s, d), D.taxonomy(s, d))


@query(_UP + "SELECT corpus, list(name ORDER BY level, id) AS chain FROM (SELECT DISTINCT l.corpus, up.id, name, level FROM (SELECT corpus, max(taxonomy_id) AS taxonomy_id FROM link GROUP BY corpus) l JOIN up USING (taxonomy_id)) GROUP BY corpus")
def taxonomy_chain_last_link(s, d):
    return taxonomy.chain_last_link(D.taxonomy_links(s, d), D.taxonomy(s, d))


@query(_UP + "SELECT name AS grp, count(*) AS n, string_agg(corpus, ',' ORDER BY corpus) AS corpora FROM (SELECT DISTINCT corpus, name FROM link JOIN up USING (taxonomy_id) WHERE level = 0) GROUP BY name")
def taxonomy_grouping(s, d):
    return taxonomy.grouping(D.taxonomy_links(s, d), D.taxonomy(s, d))


@query("""n AS (SELECT taxonomy_id, count(*) AS n FROM link GROUP BY taxonomy_id)
SELECT lower(coalesce('/' || p.name, '') || '/' || t.name) AS path, t.level AS depth, coalesce(n.n, 0) AS n_corpora
FROM taxonomy t LEFT JOIN taxonomy p ON p.id = t.parent_id LEFT JOIN n ON n.taxonomy_id = t.id""")
def taxonomy_printed(s, d):
    return taxonomy.printed(D.taxonomy(s, d), D.taxonomy_links(s, d))


@query("SELECT c.corpus_id, c.name, count(*) AS n_versions, list(v.source ORDER BY v.version_id) AS sources FROM corpus c JOIN version v ON v.corpus_id = c.corpus_id GROUP BY ALL")
def corpus_info(s, d):
    v = D.versions(s, d).join(F.broadcast(D.corpora(s, d)), "corpus_id")
    return v.groupBy("corpus_id", "name").agg(F.count("*").alias("n_versions"), F.transform(F.sort_array(F.collect_list(F.struct("version_id", "source"))), lambda x: x["source"]).alias("sources"))


# ---- audits ----
_MEASURED = r"""m AS (
  SELECT *, w > 0 AS "full", CASE WHEN w > 0 THEN length(text) END AS chars, CASE WHEN w > 0 THEN w END AS n_words
  FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS w FROM unit))
"""
_COVER = """count(*) AS total, CAST(sum("full"::INT) AS BIGINT) AS nonempty, CAST(count(*) - sum("full"::INT) AS BIGINT) AS "empty", round_even(100.0 * sum("full"::INT) / count(*), 4) AS coverage_pct,
round_even(avg(chars), 4) AS chars_avg, min(chars) AS chars_min, max(chars) AS chars_max, round_even(avg(n_words), 4) AS words_avg, min(n_words) AS words_min, max(n_words) AS words_max"""


@query(_MEASURED + f"SELECT corpus_id, version_id, height, depth, {_COVER} FROM m GROUP BY ALL")
def coverage_by_height_depth(s, d):
    return audit.coverage_by_level(D.units(s, d))


@query(_MEASURED + f"SELECT corpus_id, version_id, {_COVER}, min(height) AS height_min, max(height) AS height_max, min(depth) AS depth_min, max(depth) AS depth_max, count(DISTINCT (height, depth)) AS n_groups FROM m GROUP BY corpus_id, version_id")
def coverage_by_version(s, d):
    return audit.coverage_by_version(D.units(s, d))


@query(_MEASURED + """SELECT c.corpus_id, c.name, count(m.n_words) AS n,
round_even(avg(chars), 4) AS chars_mean, round_even(stddev_pop(chars), 4) AS chars_std, min(chars) AS chars_min, max(chars) AS chars_max,
round_even(avg(n_words), 4) AS n_words_mean, round_even(stddev_pop(n_words), 4) AS n_words_std, min(n_words) AS n_words_min, max(n_words) AS n_words_max
FROM corpus c LEFT JOIN (SELECT * FROM m WHERE height = 0 AND "full") m ON m.corpus_id = c.corpus_id GROUP BY c.corpus_id, c.name""")
def h0_length_stats(s, d):
    return audit.leaf_lengths(D.units(s, d), D.corpora(s, d))


@query(_MEASURED + """, h AS (SELECT corpus_id, n_words FROM m WHERE height = 0 AND "full"),
e AS (SELECT corpus_id, min(n_words) AS low, greatest((max(n_words) - min(n_words)) / 70.0::DOUBLE, 1e-9) AS width, count(*) AS n FROM h GROUP BY corpus_id)
SELECT h.corpus_id, CAST(least(floor((n_words - low) / width), 69) AS BIGINT) AS bin, count(*) AS n, round_even(count(*) / (any_value(e.n) * any_value(width)), 6) AS density FROM h JOIN e ON e.corpus_id = h.corpus_id GROUP BY 1, 2""")
def h0_histogram(s, d):
    return audit.leaf_histogram(D.units(s, d))


@query(r"""t AS (SELECT parent_id, greatest(CAST(floor(sum(len(regexp_extract_all(text, '\S+'))) * 13 / 10) AS BIGINT), 1) AS tokens FROM unit WHERE height = 0 GROUP BY parent_id),
r AS (SELECT tokens, row_number() OVER (ORDER BY tokens) - 1 AS k, count(*) OVER () AS n FROM t)
SELECT any_value(n) AS n, min(tokens) AS least, max(tokens) AS most, CAST(sum((tokens > 8192)::INT) AS BIGINT) AS n_over, round_even(100.0 * sum((tokens > 8192)::INT) / any_value(n), 4) AS pct_over,
max(tokens) FILTER (k = least(n - 1, CAST(floor(n * 0.5) AS BIGINT))) AS median, max(tokens) FILTER (k = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS p95, max(tokens) FILTER (k = least(n - 1, CAST(floor(n * 0.99) AS BIGINT))) AS p99 FROM r""")
def length_percentiles(s, d):
    return audit.length_percentiles(D.units(s, d))


@query("""sp AS (SELECT e.vec_id AS span_id, CAST(e.label AS VARCHAR) AS profile, d.lang AS corpus, d.n_chars AS tokens FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
br AS (SELECT span_id, unit_id, unit_order AS start, unit_order + 1 AS stop FROM bridge),
per AS (SELECT span_id, count(*) AS u, sum((start <> 0)::INT) AS o FROM br GROUP BY span_id),
r AS (SELECT sp.*, u, o, row_number() OVER (PARTITION BY profile, corpus ORDER BY tokens) - 1 AS k, count(*) OVER (PARTITION BY profile, corpus) AS n FROM sp JOIN per ON per.span_id = sp.span_id),
nu AS (SELECT profile, corpus, count(DISTINCT unit_id) AS n_units FROM sp JOIN br ON br.span_id = sp.span_id GROUP BY ALL)
SELECT r.profile, r.corpus, count(*) AS span_count, min(tokens) AS tokens_min, round_even(avg(tokens), 4) AS tokens_avg, max(tokens) AS tokens_max, round_even(avg(u), 4) AS units_per_span, CAST(sum(o) AS BIGINT) AS overlapping_links,
max(tokens) FILTER (k = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))) AS tokens_p95, round_even(sum(u) / any_value(n_units), 4) AS spans_per_unit
FROM r JOIN nu ON nu.profile = r.profile AND nu.corpus = r.corpus GROUP BY r.profile, r.corpus""")
def span_audit(s, d):
    sp = read_table(s, d, "embeddings").join(read_table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "n_chars"), "vec_id")
    sp = sp.select(F.col("vec_id").alias("span_id"), F.col("label").cast("string").alias("profile"), F.col("lang").alias("corpus"), F.col("n_chars").alias("tokens"))
    br = D.bridge(s, d).select("span_id", "unit_id", F.col("unit_order").alias("start"), (F.col("unit_order") + 1).alias("stop"))
    return audit.span_audit(sp, br)


@query("SELECT version_id, corpus_id, CASE WHEN coalesce(trim(source), '') = '' THEN 'Version ' || version_id ELSE source END AS translation, CASE WHEN coalesce(trim(lang), '') = '' THEN 'Unknown' ELSE lang END AS language FROM version WHERE corpus_id IN (1, 3)")
def version_inventory(s, d):
    return audit.inventory(D.versions(s, d), [3, 1, 3])


@query("SELECT count(DISTINCT corpus_id) AS corpora, count(DISTINCT version_id) AS versions, count(*) AS units, max(height) AS max_height, max(depth) AS max_depth FROM unit")
def inventory_rollup(s, d):
    u = D.units(s, d)
    return u.agg(F.countDistinct("corpus_id").alias("corpora"), F.countDistinct("version_id").alias("versions"), F.count("*").alias("units"), F.coalesce(F.max("height"), F.lit(0)).alias("max_height"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


# ---- text ----
@query("SELECT parent_id AS unit_id, string_agg(text, ' ' ORDER BY unit_id) AS text FROM unit WHERE height = 0 GROUP BY parent_id")
def ordered_text_concat(s, d):
    leaf = D.units(s, d).filter("height = 0").withColumnRenamed("unit_id", "leaf")
    return sequences.ordered_text(leaf, [F.col("parent_id").alias("unit_id")], "leaf")


@query(r"""w AS (SELECT unit_id, text, regexp_extract_all(text, '\S+') AS w FROM unit WHERE height = 0)
SELECT unit_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_filter(w, lambda x: regexp_matches(x, '[.!?;:][''")\]]*$'))) AS BIGINT) AS n_sentences, greatest(CAST(floor(len(w) * 13 / 10) AS BIGINT), 1) AS tokens FROM w""")
def word_sentence_stats(s, d):
    leaf = D.units(s, d).filter("height = 0").select("unit_id", T.words(F.col("text")).alias("w"))
    n = F.size("w").cast("long")
    return leaf.select("unit_id", n.alias("n_words"), F.size(F.filter("w", T.ends_sentence)).cast("long").alias("n_sentences"), T.token_estimate(n).alias("tokens"))


@query("SELECT parent_id AS unit_id, CASE WHEN min_by(label, unit_id) <> max_by(label, unit_id) THEN min_by(label, unit_id) || ' - ' || max_by(label, unit_id) ELSE min_by(label, unit_id) END AS label FROM unit WHERE height = 0 GROUP BY parent_id")
def span_label(s, d):
    g = D.units(s, d).filter("height = 0").groupBy(F.col("parent_id").alias("unit_id")).agg(F.min_by("label", "unit_id").alias("a"), F.max_by("label", "unit_id").alias("b"))
    return g.select("unit_id", T.span_label(F.col("a"), F.col("b")).alias("label"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages", domain=False)
def html_strip_tags(s, d):
    return read_table(s, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(c[2], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS cell FROM (SELECT page_id, regexp_extract_all(html, '(?is)<td[^>]*>(.*?)</td>', 1) AS c FROM pages)""", domain=False)
def html_second_cell(s, d):
    return read_table(s, d, "pages").select("page_id", T.table_cell(F.col("html"), 2).alias("cell"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part", domain=False)
def slug(s, d):
    return read_table(s, d, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


_ROMAN = [[one * k for k in range(4)] + [one + five] + [five + one * k for k in range(4)] + [one + ten] for one, five, ten in (("I", "V", "X"), ("X", "L", "C"), ("C", "D", "M"))]


@query(f"""SELECT p_partkey, repeat('M', p_size // 1000) || {_ROMAN[2]}[p_size // 100 % 10 + 1] || {_ROMAN[1]}[p_size // 10 % 10 + 1] || {_ROMAN[0]}[p_size % 10 + 1] AS roman, nullif(CAST(p_size AS INT), 0) AS value FROM part""", domain=False)
def roman_numerals(s, d):
    """The sizes of all parts as numerals, and back."""
    digit = lambda place: F.get(F.array(*map(F.lit, _ROMAN[place])), F.expr(f"p_size div {10**place} % 10").cast("int"))
    p = read_table(s, d, "part").select("p_partkey", F.concat(F.expr("repeat('M', cast(p_size div 1000 as int))"), digit(2), digit(1), digit(0)).alias("roman"))
    return p.withColumn("value", T.roman_to_int(F.col("roman")))


@query("SELECT n_name, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 65535) AS INT) AS hash FROM nation", domain=False)
def name_hash(s, d):
    return read_table(s, d, "nation").select("n_name", T.name_hash(F.col("n_name")).alias("hash"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS BIGINT) AS nth FROM conversations", domain=False)
def running_counter(s, d):
    return sequences.numbered(read_table(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], "turn")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations", domain=False)
def forward_fill_heading(s, d):
    c = read_table(s, d, "conversations")
    return sequences.filled(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "heading").select("conv_id", "turn", "heading")


@query("""SELECT conv_id, CAST(g AS BIGINT) AS session, count(*) AS n, min(turn) AS first_turn FROM (SELECT *, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM conversations) GROUP BY conv_id, g""", domain=False)
def marker_sessionise(s, d):
    c = sequences.sessions(read_table(s, d, "conversations"), ["conv_id"], "turn", F.col("role") == "assistant")
    return c.groupBy("conv_id", "session").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS block_end FROM conversations", domain=False)
def next_block_start(s, d):
    return sequences.next_start(read_table(s, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


# ---- spans ----
@query(r"""o AS (SELECT version_id, parent_id, unit_id, len(regexp_extract_all(text, '\S+')) AS n, row_number() OVER (PARTITION BY parent_id ORDER BY unit_id) AS k FROM unit WHERE height = 0 AND trim(text) <> ''),
pk(parent_id, k, g, total, closed, unit_id, n) AS (
  SELECT parent_id, k, 0, n, n > 120, unit_id, n FROM o WHERE k = 1
  UNION ALL
  SELECT o.parent_id, o.k, CASE WHEN o.n > 120 OR pk.closed OR pk.total + o.n > 80 THEN pk.g + 1 ELSE pk.g END, CASE WHEN o.n > 120 OR pk.closed OR pk.total + o.n > 80 THEN o.n ELSE pk.total + o.n END, o.n > 120, o.unit_id, o.n
  FROM pk JOIN o ON o.parent_id = pk.parent_id AND o.k = pk.k + 1)
SELECT parent_id, CAST(g AS INT) AS g, count(*) AS n_units, CAST(sum(n) AS BIGINT) AS n_words, min(unit_id) AS first_unit FROM pk GROUP BY parent_id, g""")
def greedy_span_pack(s, d):
    leaf = D.units(s, d).filter("height = 0 and trim(text) != ''").select("parent_id", "unit_id", T.word_count(F.col("text")).alias("n"))
    g = leaf.groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("unit_id", "n"))).alias("l"))
    g = g.withColumn("g", spans.pack(F.transform("l", lambda x: x["n"]), 80, 120))
    flat = g.select("parent_id", F.explode(F.arrays_zip("l", "g")).alias("z")).select("parent_id", F.col("z.g").alias("g"), "z.l.unit_id", "z.l.n")
    return flat.groupBy("parent_id", "g").agg(F.count("*").alias("n_units"), F.sum("n").alias("n_words"), F.min("unit_id").alias("first_unit"))


_PACKED = r"""o AS (SELECT version_id, parent_id, unit_id, regexp_extract_all(text, '\S+') AS w, row_number() OVER (PARTITION BY parent_id ORDER BY unit_id) AS k FROM unit WHERE height = 0 AND regexp_matches(text, '\S')),
pk(parent_id, k, g, total, closed) AS (
  SELECT parent_id, k, 0, len(w), len(w) > 80 FROM o WHERE k = 1
  UNION ALL
  SELECT o.parent_id, o.k, CASE WHEN len(o.w) > 80 OR pk.closed OR pk.total + len(o.w) > 50 THEN pk.g + 1 ELSE pk.g END, CASE WHEN len(o.w) > 80 OR pk.closed OR pk.total + len(o.w) > 50 THEN len(o.w) ELSE pk.total + len(o.w) END, len(o.w) > 80
  FROM pk JOIN o ON o.parent_id = pk.parent_id AND o.k = pk.k + 1),
big AS (
  SELECT o.*, pk.g, list_transform(range(1, len(w) + 1), lambda e: CASE WHEN regexp_matches(w[e], '[.!?;:][''")\]]*$') THEN e ELSE 0 END) AS ends
  FROM o JOIN pk ON pk.parent_id = o.parent_id AND pk.k = o.k WHERE len(w) > 80),
win(unit_id, part, lo, hi) AS (
  SELECT unit_id, 0, 0, CASE WHEN len(w) <= 50 THEN len(w) WHEN list_max(ends[25:50]) > 0 THEN list_max(ends[25:50]) ELSE 50 END FROM big
  UNION ALL
  SELECT b.unit_id, part + 1, greatest(lo + 1, hi - 10),
         CASE WHEN greatest(lo + 1, hi - 10) + 50 >= len(b.w) THEN len(b.w)
              WHEN list_max(b.ends[greatest(lo + 1, hi - 10) + 25:greatest(lo + 1, hi - 10) + 50]) > 0 THEN list_max(b.ends[greatest(lo + 1, hi - 10) + 25:greatest(lo + 1, hi - 10) + 50])
              ELSE greatest(lo + 1, hi - 10) + 50 END
  FROM win JOIN big b ON b.unit_id = win.unit_id WHERE hi < len(b.w)),
sp AS (
  SELECT o.version_id, o.parent_id, pk.g, 0 AS part, CASE WHEN count(*) > 1 THEN 'aggregate-small-units' ELSE 'single-unit' END AS kind, CAST(sum(len(o.w)) AS BIGINT) AS n_words, CAST(NULL AS INT) AS lo, CAST(NULL AS INT) AS hi,
         length(string_agg(array_to_string(o.w, ' '), ' ' ORDER BY o.unit_id)) AS chars, count(*) AS members
  FROM o JOIN pk ON pk.parent_id = o.parent_id AND pk.k = o.k WHERE o.unit_id NOT IN (SELECT unit_id FROM big) GROUP BY ALL
  UNION ALL
  SELECT b.version_id, b.parent_id, b.g, w.part, 'split-large-unit', CAST(w.hi - w.lo AS BIGINT), CAST(w.lo AS INT), CAST(w.hi AS INT), NULL, 1 FROM win w JOIN big b ON b.unit_id = w.unit_id),
no AS (SELECT *, CAST(row_number() OVER (PARTITION BY version_id, parent_id ORDER BY g, part) - 1 AS INT) AS span_no FROM sp)
SELECT no.version_id, no.parent_id, span_no, kind, n_words, o.unit_id, CAST(row_number() OVER (PARTITION BY no.parent_id, span_no ORDER BY o.unit_id) - 1 AS INT) AS unit_order,
       CASE WHEN members > 1 THEN length(array_to_string(o.w, ' ')) / chars ELSE 1.0::DOUBLE END AS weight, lo, hi
FROM no JOIN pk ON pk.parent_id = no.parent_id AND pk.g = no.g JOIN o ON o.parent_id = pk.parent_id AND o.k = pk.k"""


@query(_PACKED)
def sliding_windows(s, d):
    u = D.units(s, d).filter("height = 0")
    return spans.build(u, 50, 10, 80).select("version_id", "parent_id", "span_no", "kind", "n_words", "unit_id", "unit_order", "weight", "lo", "hi")


# ---- roll-ups and projections ----
@query("""w AS (SELECT d.source, e.embedding, d.n_chars AS w FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
p AS (SELECT source, i, sum(w * CAST(embedding[i] AS DOUBLE)) / sum(w) AS x FROM w, range(1, 65) t(i) GROUP BY source, i),
n AS (SELECT source, sqrt(sum(x * x)) AS n FROM p GROUP BY source)
SELECT p.source, CAST(i - 1 AS INT) AS pos, round(x / n, 6) AS value FROM p JOIN n ON n.source = p.source""")
def weighted_rollup(s, d):
    e = read_table(s, d, "embeddings").join(read_table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", "n_chars"), "vec_id")
    v = V.weighted_average(e, "source", "embedding", "n_chars")
    return v.select("source", F.posexplode("vector").alias("pos", "v")).select("source", "pos", F.round("v", 6).alias("value"))


@query("""w AS (SELECT b.unit_id, CASE WHEN weight > 0 THEN weight ELSE 1 END AS w, e.embedding AS v FROM bridge b JOIN embeddings e ON e.vec_id = b.span_id)
SELECT unit_id, round(sum(w * v[1]) / sum(w), 6) AS x, round(sum(w * v[2]) / sum(w), 6) AS y, round(sum(w * v[3]) / sum(w), 6) AS z FROM w GROUP BY unit_id""")
def fold_spans_to_units(s, d):
    p = read_table(s, d, "embeddings").select(F.col("vec_id").alias("span_id"), F.slice("embedding", 1, 3).alias("coords"))
    c = projection.fold_to_units(D.bridge(s, d), p)
    return c.select("unit_id", *(F.round(F.col("coords")[k], 6).alias(a) for k, a in enumerate("xyz")))


@query("""l0 AS (SELECT id, parent_id, depth, CAST(id % 1000 AS DOUBLE) AS x, CAST(id % 7 AS DOUBLE) AS y FROM node WHERE id NOT IN (SELECT parent_id FROM node WHERE parent_id IS NOT NULL)),
h1 AS (SELECT n.id, n.parent_id, avg(l0.x) AS x, avg(l0.y) AS y FROM node n JOIN l0 ON l0.parent_id = n.id GROUP BY n.id, n.parent_id),
d1 AS (SELECT id, parent_id, x, y FROM l0 UNION ALL SELECT * FROM h1),
h2 AS (SELECT n.id, n.parent_id, avg(d1.x) AS x, avg(d1.y) AS y FROM node n JOIN d1 ON d1.parent_id = n.id WHERE n.id NOT IN (SELECT id FROM d1) AND n.id IN (SELECT parent_id FROM h1) GROUP BY n.id, n.parent_id),
d2 AS (SELECT * FROM d1 UNION ALL SELECT * FROM h2),
h3 AS (SELECT n.id, n.parent_id, avg(d2.x) AS x, avg(d2.y) AS y FROM node n JOIN d2 ON d2.parent_id = n.id WHERE n.id NOT IN (SELECT id FROM d2) AND n.id IN (SELECT parent_id FROM h2) GROUP BY n.id, n.parent_id)
SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT * FROM d2 UNION ALL SELECT * FROM h3)""")
def parent_mean(s, d):
    # Written once: joins with a union of tables would go to each of them, and one task would hold the rows of all these joins.
    t = cut(D.unbalanced(s, d))
    leaf = t.join(t.select(F.col("parent_id").alias("id")).distinct().hint("shuffle_hash"), "id", "left_anti")
    placed = leaf.select("id", "parent_id", F.array((F.col("id") % 1000).cast("double"), (F.col("id") % 7).cast("double")).alias("coords"))
    m = projection.parent_means(t, placed, 2)
    return m.select("id", F.round(F.col("coords")[0], 6).alias("x"), F.round(F.col("coords")[1], 6).alias("y"))


@query("SELECT source, least(count(*), 12) AS n FROM documents GROUP BY source", domain=False)
def stratified_sample_sizes(s, d):
    return projection.stratified_sample(read_table(s, d, "documents").select("source", "doc_id"), "source", "doc_id", 12).groupBy("source").agg(F.count("*").alias("n"))


@query()
def stratified_sample(s, d):
    return projection.stratified_sample(read_table(s, d, "documents").select("source", "doc_id"), "source", "doc_id", 12)


def _points(s, d):
    return read_table(s, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_POINTS = "pt AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)\n"


@query(_POINTS + "SELECT coalesce(min(x), -1) AS x_min, coalesce(max(x), 1) AS x_max, coalesce(min(y), -1) AS y_min, coalesce(max(y), 1) AS y_max FROM pt")
def bounds(s, d):
    return projection.bounds(_points(s, d))


@query(_POINTS + "SELECT label, round(avg(x), 8) AS x, round(avg(y), 8) AS y, count(*) AS n FROM pt GROUP BY label")
def centroids(s, d):
    return projection.centroids(_points(s, d), "label").select("label", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"), "n")


_FIELD = _POINTS + """, bx AS (SELECT label, min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), 1e-6) AS w, greatest(max(y) - min(y), 1e-6) AS h FROM pt GROUP BY label HAVING count(*) > 1),
b2 AS (SELECT label, x0 - w * 0.18::DOUBLE AS lx, y0 - h * 0.18::DOUBLE AS ty, w * 1.36::DOUBLE AS w, h * 1.36::DOUBLE AS h FROM bx),
b3 AS (SELECT *, greatest(w, h) / 18 AS band, w / 48 AS dx, h / 48 AS dy FROM b2),
g AS (SELECT b3.label, CAST(i AS INT) AS i, CAST(j AS INT) AS j, (power(lx + i * dx - x, 2) + power(ty + j * dy - y, 2)) / power(band, 2) AS sq
      FROM b3 JOIN pt ON pt.label = b3.label, range(49) a(i), range(49) c(j)),
f AS (SELECT label, i, j, sum(exp(-sq / 2)) AS value FROM g WHERE sq <= 9 GROUP BY label, i, j)
"""


@query(_FIELD + "SELECT label, i, j, round(value, 5) AS value FROM f")
def kde_grid(s, d):
    return projection.density(_points(s, d), "label").withColumn("value", F.round("value", 5))


@query(_FIELD + """, l AS (SELECT label, max(value) AS top FROM f GROUP BY label),
ed AS (SELECT DISTINCT label, i - di AS i, j - dj AS j, e FROM f, (VALUES ('x', 0, 0), ('y', 0, 0), ('x', 1, 0), ('y', 0, 1)) t(e, di, dj) WHERE i - di >= 0 AND j - dj >= 0),
ev AS (SELECT ed.label, ed.i, ed.j, ed.e, coalesce(a.value, 0) AS v0, coalesce(b.value, 0) AS v1, s.s AS level, s.s * l.top AS cut
       FROM ed JOIN l ON l.label = ed.label LEFT JOIN f a ON a.label = ed.label AND a.i = ed.i AND a.j = ed.j
       LEFT JOIN f b ON b.label = ed.label AND b.i = ed.i + (ed.e = 'x')::INT AND b.j = ed.j + (ed.e = 'y')::INT, (VALUES (0.18::DOUBLE), (0.32), (0.48), (0.66)) s(s))
SELECT label, level, CAST(i AS INT) AS i, CAST(j AS INT) AS j, e AS edge, round((cut - v0) / (v1 - v0), 4) AS "at" FROM ev WHERE (v0 < cut) <> (v1 < cut)""")
def contour_crossings(s, d):
    return projection.contour_crossings(projection.density(_points(s, d), "label"), "label").withColumn("at", F.round("at", 4))


_CROSSED = """, l AS (SELECT label, max(value) AS top FROM f GROUP BY label),
ed AS (SELECT DISTINCT label, i - di AS i, j - dj AS j, e FROM f, (VALUES ('x', 0, 0), ('y', 0, 0), ('x', 1, 0), ('y', 0, 1)) t(e, di, dj) WHERE i - di >= 0 AND j - dj >= 0),
ev AS (SELECT ed.label, ed.i, ed.j, ed.e, coalesce(a.value, 0) AS v0, coalesce(b.value, 0) AS v1, s.s AS level, s.s * l.top AS cut
       FROM ed JOIN l ON l.label = ed.label LEFT JOIN f a ON a.label = ed.label AND a.i = ed.i AND a.j = ed.j
       LEFT JOIN f b ON b.label = ed.label AND b.i = ed.i + (ed.e = 'x')::INT AND b.j = ed.j + (ed.e = 'y')::INT, (VALUES (0.18::DOUBLE), (0.32), (0.48), (0.66)) s(s)),
cr AS (SELECT label, level, i, j, e, (cut - v0) / (v1 - v0) AS t FROM ev WHERE (v0 < cut) <> (v1 < cut)),
sd AS (
  SELECT label, level, i AS ci, j AS cj, CASE e WHEN 'x' THEN 0 ELSE 3 END AS side, CASE e WHEN 'x' THEN i + t ELSE i END AS x, CASE e WHEN 'x' THEN j ELSE j + t END AS y FROM cr
  UNION ALL
  SELECT label, level, CASE e WHEN 'x' THEN i ELSE i - 1 END, CASE e WHEN 'x' THEN j - 1 ELSE j END, CASE e WHEN 'x' THEN 2 ELSE 1 END, CASE e WHEN 'x' THEN i + t ELSE i END, CASE e WHEN 'x' THEN j ELSE j + t END FROM cr),
nm AS (SELECT *, row_number() OVER (PARTITION BY label, level, ci, cj ORDER BY side) - 1 AS k FROM sd WHERE ci >= 0 AND cj >= 0)
SELECT a.label, a.level, CAST(a.ci AS INT) AS i, CAST(a.cj AS INT) AS j, CAST(a.k // 2 AS INT) AS part, round(a.x, 4) AS x0, round(a.y, 4) AS y0, round(b.x, 4) AS x1, round(b.y, 4) AS y1
FROM nm a JOIN nm b ON b.label = a.label AND b.level = a.level AND b.ci = a.ci AND b.cj = a.cj AND b.k = a.k + 1 WHERE a.k % 2 = 0"""


@query(_FIELD + _CROSSED)
def contour_segments(s, d):
    found = projection.contour_segments(projection.density(_points(s, d), "label"), "label")
    return found.select("label", "level", "i", "j", "part", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query()
def pca_variance(s, d):
    """No rows if there are no vectors."""
    e = read_table(s, d, "embeddings").filter("embedding is not null")
    shares = [] if e.isEmpty() else projection.explained_variance(e, "embedding")[2]
    cum, rows = 0.0, []
    for k, share in enumerate(shares):
        cum += float(share)
        rows.append((k, round(float(share), 6), round(cum, 6)))
    return s.createDataFrame(rows, "component int, share double, cumulative double")


@query("""x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
c AS (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM x a JOIN x b ON b.vec_id = a.vec_id GROUP BY a.i, b.i)
SELECT (SELECT count(*) FROM embeddings) AS n, round(sum(c) FILTER (WHERE i = j), 8) AS total, round(sum(c * c), 8) AS squares FROM c""", domain=False)
def pca_moments(s, d):
    """Sums of the components' variances and of their squares: the covariance's trace and the sum of its squares."""
    e = read_table(s, d, "embeddings")
    n, _, cov = projection.moments(e, "embedding")
    values = np.linalg.eigvalsh(cov)
    return s.createDataFrame([(n, round(float(values.sum()), 8), round(float((values**2).sum()), 8))], "n long, total double, squares double")


#: Vectors of each source in the sample that a projection is fitted on; no fit takes more than its own bound.
PER_SOURCE = 100


def _placed(s, d, fit, most):
    """All vectors, placed by a fit on up to PER_SOURCE vectors of each source."""
    e = read_table(s, d, "embeddings").select("vec_id", "embedding")
    sources = read_table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    sample = manifold.take_sample(e.join(sources, "vec_id", "left"), "vec_id", "embedding", most, "source", PER_SOURCE)
    return manifold.place(e, "embedding", fit(sample)).select("vec_id", F.transform("coords", lambda c: F.round(c, 5)).alias("coords"))


@query()
def isomap(s, d):
    return _placed(s, d, lambda x: manifold.isomap(s, x), 20_000)


@query()
def umap(s, d):
    return _placed(s, d, lambda x: manifold.umap(s, x), 10_000)


@query()
def phate(s, d):
    return _placed(s, d, manifold.phate, 2_000)


@query(_POINTS.rstrip() + """, b AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) * 1.08 * 1.08 AS box FROM pt)
SELECT label, count(DISTINCT (x, y)) AS cells, round(min(box), 6) AS area FROM pt, b GROUP BY label HAVING count(*) > 1""", domain=False)
def voronoi_areas(s, d):
    """The cells of different places of a label fill the box of all points."""
    found = cells.voronoi(_points(s, d), "label", "vec_id").join(_points(s, d), "vec_id").dropDuplicates(["label", "x", "y"])
    return found.groupBy("label").agg(F.count("*").alias("cells"), F.round(F.sum(cells.area(F.col("cell"))), 6).alias("area"))


@query()
def voronoi_cells(s, d):
    found = cells.voronoi(_points(s, d), "label", "vec_id")
    return found.select("vec_id", F.size("cell").alias("corners"), F.round(cells.area(F.col("cell")), 6).alias("area"))


# ---- ingest and integrity ----
@query("""SELECT 'labels' AS child, (SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS orphans
UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id))
UNION ALL SELECT 'orders', (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey))""", domain=False)
def source_integrity(s, d):
    t = lambda n: read_table(s, d, n)
    one = lambda name, df: df.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("child"), "orphans")
    a = one("labels", ingest.orphans(t("labels"), t("documents"), "doc_id", "doc_id"))
    b = one("embeddings", ingest.orphans(t("embeddings"), t("documents"), "vec_id", "doc_id"))
    return a.unionByName(b).unionByName(one("orders", ingest.orphans(t("orders"), t("customer"), "o_custkey", "c_custkey")))


@query("SELECT lang AS corpus, source AS translation, doc_id FROM documents WHERE NOT (lang IN ('en', 'de') AND source IN ('src0', 'src1'))", domain=False)
def idempotent_ingest(s, d):
    parsed = read_table(s, d, "documents").select(F.col("lang").alias("corpus"), F.col("source").alias("translation"), "doc_id")
    there = s.range(1).select(F.explode(F.array(F.lit("en"), F.lit("de"))).alias("corpus")).select("corpus", F.explode(F.array(F.lit("src0"), F.lit("src1"))).alias("translation"))
    return ingest.new_versions(parsed, there)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", domain=False)
def uniqueness_violations(s, d):
    return ingest.violations(read_table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


_PARSED = """p AS (
  SELECT lang AS corpus, source AS translation, 'top' AS key, CAST(NULL AS VARCHAR) AS parent_key, 'T' AS label, CAST(-1 AS BIGINT) AS position FROM (SELECT DISTINCT lang, source FROM documents)
  UNION ALL SELECT lang, source, CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 5 = 0 THEN 'gone' ELSE 'top' END, '', doc_id FROM documents),
n AS (SELECT row_number() OVER (ORDER BY corpus, translation, position) + 99 AS unit_id, * FROM p),
w AS (SELECT n.*, u.unit_id AS parent_id FROM n LEFT JOIN n u ON u.corpus = n.corpus AND u.translation = n.translation AND u.key = n.parent_key)
"""


def _parsed(s, d):
    docs = read_table(s, d, "documents").select(F.col("lang").alias("corpus"), F.col("source").alias("translation"), "doc_id")
    top = docs.select("corpus", "translation").distinct().select("*", F.lit("top").alias("key"), F.lit(None).cast("string").alias("parent_key"), F.lit("T").alias("label"), F.lit(-1).cast("long").alias("position"))
    rest = docs.select("corpus", "translation", F.col("doc_id").cast("string").alias("key"), F.when(F.col("doc_id") % 5 == 0, "gone").otherwise("top").alias("parent_key"), F.lit("").alias("label"), F.col("doc_id").alias("position"))
    return top.unionByName(rest)


@query(_PARSED + "SELECT unit_id, corpus, translation, key, parent_id FROM w", domain=False)
def ingest_ids(s, d):
    return ingest.assign_ids(_parsed(s, d), 100).select("unit_id", "corpus", "translation", "key", "parent_id")


@query(_PARSED + """SELECT w.unit_id, CASE WHEN w.parent_id IS NULL THEN '' ELSE '/T' END || '/' || CASE WHEN w.label = '' THEN CAST(w.unit_id AS VARCHAR) ELSE w.label END AS path,
CAST(CASE WHEN EXISTS (SELECT 1 FROM w c WHERE c.parent_id = w.unit_id) THEN 1 ELSE 0 END AS INT) AS height, v.version_id, v.corpus_id
FROM w JOIN (SELECT corpus, translation, row_number() OVER (ORDER BY corpus, translation) AS version_id, dense_rank() OVER (ORDER BY corpus) AS corpus_id FROM (SELECT DISTINCT corpus, translation FROM p)) v ON v.corpus = w.corpus AND v.translation = w.translation""", domain=False)
def ingest_whole(s, d):
    """All versions of the documents, as an ingest into empty tables; a parent that is missing makes a root."""
    units = _parsed(s, d)
    wanted = [ingest.Version(r["corpus"], r["translation"], levels=("Sources", "Document")) for r in units.select("corpus", "translation").distinct().collect()]
    none = F.lit(None).cast("string")
    units = units.withColumns({"depth": F.when(F.col("parent_key") == "top", 1).otherwise(0), "text": none, "uncleaned_text": none, "author": none, "metadata": none})
    new = ingest.ingest(units, wanted, ingest.empty_tables(s), D.taxonomy(s, d).select("id", "name"))["unit"]
    return new.select((F.col("unit_id") + 99).alias("unit_id"), F.when(F.col("label") == "", F.concat(F.when(F.col("parent_id").isNotNull(), "/T").otherwise(""), F.lit("/"), (F.col("unit_id") + 99).cast("string"))).otherwise(F.col("path")).alias("path"), "height", "version_id", "corpus_id")


@query(r"""j AS (SELECT parent_id AS unit_id, string_agg(text, ' ' ORDER BY unit_id) AS text FROM unit WHERE height = 0 AND trim(text) <> '' GROUP BY parent_id),
t AS (SELECT unit_id, text FROM unit WHERE height = 0 AND trim(text) <> '' UNION ALL SELECT * FROM j)
SELECT unit_id, length('search_document: ' || text) AS chars, greatest(CAST(floor(len(regexp_extract_all(text, '\S+')) * 13 / 10) AS BIGINT), 1) AS cost FROM t WHERE unit_id - 1000000000 NOT IN (SELECT vec_id FROM embeddings)""")
def embed_queue(s, d):
    done = read_table(s, d, "embeddings").select((F.col("vec_id") + D.DOC).alias("unit_id"))
    return ingest.embed_queue(D.units(s, d), done).select("unit_id", F.length("text").cast("long").alias("chars"), "cost")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents", domain=False)
def dump_documents(s, d):
    """The documents as a dump's inserts, and back."""
    where = scratch_path(s, "dump")
    dump.write_dump(read_table(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), where, "documents")
    return dump.read_table(s, where, "documents")


@query("SELECT version_id, count(*) AS points FROM unit GROUP BY version_id")
def points_per_version(s, d):
    return D.units(s, d).groupBy("version_id").agg(F.count("*").alias("points"))


@query("SELECT corpus_id, unit_id, row_number() OVER (PARTITION BY corpus_id ORDER BY unit_id) AS nth FROM unit WHERE height > 0")
def rank_in_corpus(s, d):
    return sequences.numbered_across(D.units(s, d).filter("height > 0").select("corpus_id", "unit_id"), ["corpus_id"], ["unit_id"])


# ---- results ----
_CHAIN = """cup AS (SELECT t.id AS taxonomy_id, t.id, t.name, t.level FROM taxonomy t UNION ALL SELECT t.id, p.id, p.name, p.level FROM taxonomy t JOIN taxonomy p ON p.id = t.parent_id),
chain AS (SELECT corpus_id, list(name ORDER BY level, id) AS taxonomy FROM (SELECT DISTINCT corpus_id, cup.id, name, level FROM clink JOIN cup USING (taxonomy_id)) GROUP BY corpus_id)
"""
_BRIEF = """SELECT u.unit_id, u.label, u.path, u.height, u.depth, c.name AS corpus, v.source AS version, coalesce(chain.taxonomy, []) AS taxonomy{more}
FROM unit u JOIN corpus c ON c.corpus_id = u.corpus_id JOIN version v ON v.version_id = u.version_id LEFT JOIN chain ON chain.corpus_id = u.corpus_id"""


def _names(s, d):
    return D.corpora(s, d), D.versions(s, d).withColumn("translation", F.col("source")), results.chains(D.corpus_links(s, d), D.taxonomy(s, d))


@query(_CHAIN + _BRIEF.format(more="") + " WHERE u.height >= 1")
def unit_brief(s, d):
    return results.brief(D.units(s, d).filter("height >= 1"), *_names(s, d))


@query(_CHAIN + _BRIEF.format(more=", u.text, CAST(NULL AS VARCHAR) AS uncleaned_text, ref.url AS source_url") + " LEFT JOIN ref ON ref.version_id = u.version_id WHERE u.height = 0 AND u.version_id IN (2, 3)")
def unit_detail(s, d):
    return results.detail(D.units(s, d).filter("height = 0 and version_id in (2, 3)"), *_names(s, d), D.source_refs(s, d))


_SPAN = """hit AS (SELECT e.vec_id AS span_id, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q) AS dist FROM embeddings e, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
  WHERE e.vec_id <> 0 ORDER BY dist, span_id LIMIT 25),
sup AS (SELECT span_id, list(unit_id + 1000000000 ORDER BY unit_order) AS ids FROM bridge WHERE span_id % 3 <> 0 GROUP BY span_id)
"""


@query(_SPAN + """SELECT h.span_id, CASE WHEN h.span_id % 2 = 0 THEN 'span ' || h.span_id ELSE u.label END AS label, CASE WHEN h.span_id % 5 = 0 THEN '/s' ELSE u.path END AS path, c.name AS corpus, v.source AS version, u.height,
round_even(1 - dist, 4) AS score, coalesce(sup.ids, [h.span_id + 1000000000]) AS support_unit_ids, h.span_id + 1000000000 AS start_unit_id, h.span_id + 1000000001 AS end_unit_id, h.span_id + 1000000000 AS primary_unit_id
FROM hit h JOIN unit u ON u.unit_id = h.span_id + 1000000000 JOIN corpus c ON c.corpus_id = u.corpus_id JOIN version v ON v.version_id = u.version_id LEFT JOIN sup ON sup.span_id = h.span_id""")
def semantic_search(s, d):
    """The star of span, start unit, corpus and version; empty labels and paths are the unit's, spans without units have their start."""
    e = read_table(s, d, "embeddings").filter("vec_id != 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    query = search.vector_of(read_table(s, d, "embeddings"), "vec_id", 0)
    hits = results.semantic_hits(query, e, e.limit(0), 25).select(F.col("id").alias("span_id"), "score")
    start = F.col("vec_id") + D.DOC
    held = read_table(s, d, "embeddings").select(
        F.col("vec_id").alias("span_id"), start.alias("start_unit_id"), (start + 1).alias("end_unit_id"),
        F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("span "), "vec_id")).otherwise("").alias("label"), F.when(F.col("vec_id") % 5 == 0, "/s").alias("path"),
    )
    bridge = D.bridge(s, d).filter("span_id % 3 != 0").withColumn("unit_id", F.col("unit_id") + D.DOC)
    return results.span_results(hits, held, D.units(s, d), D.corpora(s, d), D.versions(s, d).withColumn("translation", F.col("source")), bridge)


@query("""SELECT 'unit' AS kind, vec_id AS id, round_even(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 4) AS score FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1)
ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), vec_id LIMIT 12""", domain=False)
def semantic_units(s, d):
    """Without any span vector the units are searched."""
    e = read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return results.semantic_hits(search.vector_of(e, "id", 1, "vector"), e.limit(0), e, 12)


@query("SELECT unit_id, label, count(*) OVER () = 30 AS more FROM (SELECT unit_id, label, depth FROM unit ORDER BY depth, unit_id LIMIT 30 OFFSET 40)")
def page_more(s, d):
    return results.page(D.units(s, d).select("unit_id", "label", "depth"), ["depth", "unit_id"], 30, 40).select("unit_id", "label", "more")


@query("""h AS (SELECT c.name AS corpus, u.unit_id FROM unit u JOIN corpus c ON c.corpus_id = u.corpus_id WHERE u.height = 1 AND u.label ILIKE '%17%' ORDER BY u.depth, u.unit_id LIMIT 20)
SELECT corpus, CAST(row_number() OVER (ORDER BY min(unit_id)) - 1 AS INT) AS place, list(unit_id ORDER BY unit_id) AS units FROM h GROUP BY corpus""")
def results_by_corpus(s, d):
    found = search.autocomplete(D.units(s, d).filter("height = 1").drop("text", "path").withColumns({"text": F.lit(None).cast("string"), "path": F.lit(None).cast("string")}), "17", 1)
    named = found.join(D.corpora(s, d).select("corpus_id", F.col("name").alias("corpus")), "corpus_id").withColumn("at", F.col("unit_id"))
    return results.by_corpus(named, "at", query="17")


@query("""cp AS (SELECT corpus_id, max(height) AS top FROM clevel WHERE corpus_id <> 2 OR height < 2 GROUP BY corpus_id),
nm AS (SELECT cp.corpus_id, (SELECT name FROM clevel l WHERE l.corpus_id = cp.corpus_id AND l.height = least(1, top)) AS a, (SELECT name FROM clevel l WHERE l.corpus_id = cp.corpus_id AND l.height = least(9, top)) AS b FROM cp)
SELECT corpus_id, CASE WHEN a = b THEN a ELSE a || ' – ' || b END AS level_name FROM nm""")
def level_names(s, d):
    return results.level_names(D.corpora(s, d), D.levels(s, d).filter("corpus_id != 2 or height < 2"), 1, 9)


@query("SELECT unit_id, CASE height WHEN 2 THEN 'Documents' ELSE 'Lines' END AS title FROM unit WHERE height > 0")
def child_titles(s, d):
    return results.child_titles(D.units(s, d), D.levels(s, d))


@query("SELECT coalesce(max(height), 0) AS max_height FROM clevel")
def level_top_height(s, d):
    return results.top_height(D.levels(s, d))


@query(_CHAIN + """SELECT c.corpus_id, c.name, v.translations, l.levels, coalesce(chain.taxonomy, []) AS taxonomy FROM corpus c
LEFT JOIN (SELECT corpus_id, list(source ORDER BY version_id) AS translations FROM version GROUP BY corpus_id) v ON v.corpus_id = c.corpus_id
LEFT JOIN (SELECT corpus_id, list(name ORDER BY height) AS levels FROM clevel GROUP BY corpus_id) l ON l.corpus_id = c.corpus_id LEFT JOIN chain ON chain.corpus_id = c.corpus_id""")
def corpus_nest(s, d):
    corpora, versions, chain = _names(s, d)
    info = results.corpus_info(corpora, versions, D.levels(s, d), chain)
    return info.select("corpus_id", "name", F.col("versions.translation").alias("translations"), F.col("levels.level").alias("levels"), "taxonomy")


@query("SELECT count(*) > 0 AS has_vectors FROM embeddings WHERE label = 3", domain=False)
def vector_probe(s, d):
    return s.createDataFrame([(results.has_vectors(read_table(s, d, "embeddings"), F.col("label") == 3),)], "has_vectors boolean")


# ---- vectors of units ----
@query("""cl(top, id, h) AS (
  SELECT u.unit_id, c.unit_id, c.height FROM unit u JOIN unit c ON c.parent_id = u.unit_id WHERE u.height > 1
  UNION ALL SELECT cl.top, c.unit_id, c.height FROM cl JOIN unit c ON c.parent_id = cl.id WHERE cl.h > 1),
ch AS (SELECT parent_id, CAST(sum(length(text)) AS DOUBLE) AS chars FROM unit WHERE height = 0 AND text IS NOT NULL GROUP BY parent_id),
w AS (SELECT cl.top, CASE WHEN coalesce(ch.chars, 1) > 0 THEN coalesce(ch.chars, 1) ELSE 1 END AS w, e.embedding FROM cl JOIN embeddings e ON e.vec_id + 1000000000 = cl.id LEFT JOIN ch ON ch.parent_id = cl.id WHERE cl.h = 1),
p AS (SELECT top, i, sum(w * CAST(embedding[i] AS DOUBLE)) / sum(w) AS x FROM w, range(1, 65) t(i) GROUP BY top, i),
n AS (SELECT top, sqrt(sum(x * x)) AS n FROM p GROUP BY top)
SELECT p.top AS unit_id, CAST(i - 1 AS INT) AS pos, round(x / n, 6) AS value FROM p JOIN n ON n.top = p.top""")
def unit_roll_up(s, d):
    """Vectors of units above height 1 from those of height 1 below, weighed by their text's length."""
    v = read_table(s, d, "embeddings").select((F.col("vec_id") + D.DOC).alias("unit_id"), F.col("embedding").alias("vector"))
    found = embedding.roll_up(D.units(s, d), v)
    return found.select("unit_id", F.posexplode("vector").alias("pos", "v")).select("unit_id", "pos", F.round("v", 6).alias("value"))


@query("SELECT u.corpus_id, u.unit_id, e.label AS method_id FROM unit u JOIN embeddings e ON e.vec_id + 1000000000 = u.unit_id - u.unit_id % 1 WHERE u.height = 1 AND e.label = 4")
def unit_vector_load(s, d):
    v = read_table(s, d, "embeddings").select((F.col("vec_id") + D.DOC).alias("unit_id"), F.col("label").alias("method_id"))
    leaves = D.units(s, d).filter("height = 1").withColumn("height", F.lit(0))
    return embedding.unit_vectors(leaves, v, 4).select("corpus_id", "unit_id", "method_id")


@query("SELECT e.vec_id AS span_id, c.corpus_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN corpus c ON c.name IS NOT DISTINCT FROM d.lang WHERE e.label = 3")
def span_vector_load(s, d):
    docs = D.numbered_documents(s, d).select(F.col("doc_id").alias("span_id"), "corpus_id")
    e = read_table(s, d, "embeddings").select(F.col("vec_id").alias("span_id"), F.col("label").alias("profile_id"))
    held = e.join(docs, "span_id")
    vectors = e.select("span_id", F.lit(1).alias("method_id"))
    methods = s.createDataFrame([(1, "span"), (2, "unit")], "method_id int, label string")
    return embedding.span_vectors(held, vectors, methods, "span", 3).select("span_id", "corpus_id")


@query("SELECT u.corpus_id, c.name AS corpus, u.unit_id, u.label FROM unit u JOIN corpus c ON c.corpus_id = u.corpus_id WHERE u.unit_id IN (SELECT vec_id * 7 + 1000000000 FROM embeddings)")
def unassigned_units(s, d):
    ids = read_table(s, d, "embeddings").select((F.col("vec_id") * 7 + D.DOC).alias("unit_id"))
    return embedding.unassigned(D.units(s, d), D.corpora(s, d), ids)


@query("SELECT height, count(*) AS n FROM unit WHERE height > 1 OR (height = 0 AND text IS NOT NULL) GROUP BY height")
def units_by_height(s, d):
    u = D.units(s, d)
    return embedding.at_height(u, 0).unionByName(embedding.at_height(u)).groupBy("height").agg(F.count("*").alias("n"))


@query("SELECT CAST(label AS INT) AS profile_id, count(*) AS spans, min(vec_id) AS tokens_min, round_even(avg(vec_id), 4) AS tokens_avg, max(vec_id) AS tokens_max FROM embeddings GROUP BY label", domain=False)
def span_report(s, d):
    return span_store.report(read_table(s, d, "embeddings").select(F.col("label").alias("profile_id"), F.col("vec_id").alias("token_count")))


# ---- the map ----
@query("SELECT e.vec_id AS unit_id, label AS corpus_id, CASE WHEN vec_id % 3 = 0 THEN 9.0::DOUBLE ELSE CAST(embedding[1] AS DOUBLE) END AS x FROM embeddings e", domain=False)
def map_positions(s, d):
    """Two layers, of which the second holds every third unit again: it counts."""
    p = read_table(s, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("label").alias("corpus_id"), *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))
    again = p.filter("unit_id % 3 = 0").withColumn("x", F.lit(9.0))
    return mapview.positions(p.withColumn("layer", F.lit(0)).unionByName(again.withColumn("layer", F.lit(1)))).select("unit_id", "corpus_id", "x")


@query("""SELECT vec_id AS span_id, CASE WHEN vec_id % 2 = 0 THEN 'own' WHEN vec_id % 7 <> 0 THEN 'primary' WHEN (vec_id + 1) % 7 <> 0 AND vec_id + 1 IN (SELECT vec_id FROM embeddings) THEN 'start' END AS found FROM embeddings""", domain=False)
def result_positions(s, d):
    """Where a result is drawn: its span's place (even ones have one), else its primary or start unit's (multiples of 7 have none)."""
    e = read_table(s, d, "embeddings").select("vec_id")
    at = lambda kind: {a: F.lit(kind).cast("double") for a in "xyz"}
    found = e.select(F.col("vec_id").alias("span_id"), F.col("vec_id").alias("primary_unit_id"), (F.col("vec_id") + 1).alias("start_unit_id"), F.array(F.lit(-1).cast("long")).alias("support_unit_ids"))
    units = e.filter("vec_id % 7 != 0").select(F.col("vec_id").alias("unit_id")).withColumns({a: F.col("unit_id").cast("double") for a in "xyz"})
    own = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("span_id")).withColumns(at(-1.0))
    placed = mapview.result_positions(found, own, units)
    kind = F.when(F.col("x") == -1, "own").when(F.col("x") == F.col("primary_unit_id"), "primary").when(F.col("x") == F.col("start_unit_id"), "start")
    return placed.select("span_id", kind.alias("found"))


@query("SELECT version_id, CASE WHEN version_id <= 3 THEN true WHEN version_id = 7 THEN false ELSE true END AS visible FROM version")
def map_visibility(s, d):
    """One version is hidden by its flag; a group that was hidden in part is switched to visible."""
    flags = D.versions(s, d).filter("version_id in (2, 7)").select("version_id", F.lit(False).alias("visible"))
    return mapview.toggled(mapview.visibility(D.versions(s, d), flags), F.col("version_id") <= 3)


@query("SELECT 0 AS low, coalesce(max(depth), 0) AS high FROM unit")
def map_depth_range(s, d):
    return mapview.depth_range(D.units(s, d))


@query("SELECT corpus_id, count(*) AS n FROM version WHERE coalesce(trim(source), '') <> '' AND version_id % 2 = 1 GROUP BY corpus_id")
def map_translations(s, d):
    v = D.versions(s, d).withColumn("translation", F.col("source"))
    return mapview.translations(v, v.filter("version_id % 2 = 1"))


@query(_DIST + """, pg AS (SELECT vec_id, row_number() OVER (ORDER BY dist, vec_id) AS k FROM v WHERE vec_id <> 0 ORDER BY dist, vec_id LIMIT 20),
p AS (SELECT k, e.vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM pg JOIN embeddings e ON e.vec_id = pg.vec_id), h AS (SELECT * FROM p WHERE k = 1)
SELECT p.vec_id, h.x AS x0, h.y AS y0, p.x AS x1, p.y AS y1 FROM p, h WHERE p.vec_id <> h.vec_id""")
def constellation(s, d):
    """Lines from the best result of a search to the others of its page."""
    e = read_table(s, d, "embeddings").select("vec_id", "embedding")
    page = search.top_k(e.filter("vec_id != 0"), search.vector_of(e, "vec_id", 0), 20).withColumn("place", F.monotonically_increasing_id())
    p = page.select("vec_id", "place", *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))
    return mapview.constellation(p, "place").select("vec_id", "x0", "y0", "x1", "y1")


@query("SELECT vec_id, CAST(embedding[5] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, 0.0::DOUBLE AS z FROM embeddings", domain=False)
def pca_axes(s, d):
    p = read_table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("coords"))
    return mapview.flat(mapview.chosen_axes(p, 4, 1, 2)).select("vec_id", "x", "y", "z")


@query(_POINTS + """SELECT round((min(x) + max(x)) / 2, 8) AS x, round((min(y) + max(y)) / 2, 8) AS y, round(log2(800 * 0.7::DOUBLE / greatest(max(x) - min(x), max(y) - min(y), 0.1)), 8) AS zoom,
round(greatest(max(x) - min(x), max(y) - min(y), 0.1) / 250, 8) AS radius FROM pt""")
def map_first_view(s, d):
    box = projection.bounds(_points(s, d))
    view = mapview.first_view(box, 800).withColumn("radius", mapview.point_radius(box).first()["radius"] + F.lit(0.0))
    return view.select(*(F.round(c, 8).alias(c) for c in ("x", "y", "zoom", "radius")))


@query("""h AS (SELECT n_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(lower(trim(n_name)), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (a * 31 + c) & 65535) AS h FROM nation)
SELECT n_name, CAST((40 + (h % 11) - 5 + 360) % 360 AS INT) AS h, CAST(greatest(28, least(90, 55 + ((h >> 5) % 13) - 6)) AS INT) AS s, CAST(greatest(28, least(68, 48 + ((h >> 9) % 21) - 10)) AS INT) AS l FROM h""", domain=False)
def corpus_colours(s, d):
    n = read_table(s, d, "nation")
    return n.select("n_name", mapview.variant(F.col("n_name"), "corpus", F.lit(40), F.lit(55), F.lit(48)).alias("c")).select("n_name", "c.*")


def _shifted(name: str, kind: str, base: str) -> str:
    (hm, hs), (sm, ss), (lm, ls), (s0, s1), (l0, l1) = mapview.VARIANTS[kind]
    h = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(lower(trim({name})), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (a * 31 + c) & 65535)"
    return f"""{{'h': CAST(({base}.h + (({h} >> {hs}) % {hm}) - {hm // 2} + 360) % 360 AS INT), 's': CAST(greatest({s0}, least({s1}, {base}.s + (({h} >> {ss}) % {sm}) - {sm // 2})) AS INT),
 'l': CAST(greatest({l0}, least({l1}, {base}.l + (({h} >> {ls}) % {lm}) - {lm // 2})) AS INT)}}"""


_NODE_COLOURS = f"""nc AS (SELECT t.*, {_shifted('name', 'taxonomy', "{'h': 0, 's': 0, 'l': 43}")} AS c FROM taxonomy t),
cu AS (SELECT t.id AS taxonomy_id, t.id, t.parent_id FROM taxonomy t UNION ALL SELECT cu.taxonomy_id, p.id, p.parent_id FROM cu JOIN taxonomy p ON p.id = cu.parent_id),
"""


@query(_NODE_COLOURS + f"""deep AS (SELECT corpus_id, arg_min(c, {{'u': -level, 'i': nc.id}}) AS b FROM clink JOIN cu ON cu.taxonomy_id = clink.taxonomy_id JOIN nc ON nc.id = cu.id GROUP BY corpus_id),
cc AS (SELECT corpus.corpus_id, name, {_shifted('name', 'corpus', 'b')} AS c FROM corpus JOIN deep ON deep.corpus_id = corpus.corpus_id)
SELECT corpus_id, c.h AS h, c.s AS s, c.l AS l FROM cc""")
def corpus_palette(s, d):
    c = mapview.corpus_colours(D.corpora(s, d), D.corpus_links(s, d), D.taxonomy(s, d))
    return c.select("corpus_id", "colour.*")


@query("""SELECT unit_id, CASE WHEN unit_id % 100 = 0 THEN [201, 169, 110] WHEN corpus_id = 1 THEN [1, 2, 3] ELSE [110, 110, 110] END || [CASE WHEN version_id % 5 = 0 THEN 0 WHEN unit_id % 100 = 0 THEN 235 ELSE 200 END] AS fill,
CASE WHEN unit_id % 100 = 0 THEN [255, 243, 209] WHEN corpus_id = 1 THEN [4, 5, 6] ELSE [190, 190, 190] END || [CASE WHEN version_id % 5 = 0 THEN 0 WHEN unit_id % 100 = 0 THEN 255 ELSE 225 END] AS line FROM unit""")
def point_styles(s, d):
    """All units: one corpus has a colour, every fifth version is hidden, every hundredth unit is selected."""
    units = D.units(s, d).select("unit_id", "corpus_id", "version_id")
    numbers = lambda *v: F.array(*map(F.lit, v))
    colours = D.corpora(s, d).filter("corpus_id = 1").select("corpus_id", numbers(1, 2, 3).alias("fill"), numbers(4, 5, 6).alias("line"))
    flags = D.versions(s, d).filter("version_id % 5 = 0").select("version_id", F.lit(False).alias("visible"))
    return mapview.point_styles(units, colours, mapview.visibility(D.versions(s, d), flags), units.filter("unit_id % 100 = 0"))


@query("""tx AS (SELECT id, name, parent_id, level FROM taxonomy WHERE id <> 2),
wk(id, way) AS (
  SELECT id, [{'o': CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END, 'l': level, 'n': lower(name), 'i': id}] FROM tx WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM tx)
  UNION ALL SELECT t.id, list_append(wk.way, {'o': 0, 'l': t.level, 'n': lower(t.name), 'i': t.id}) FROM wk JOIN tx t ON t.parent_id = wk.id),
ln AS (SELECT taxonomy_id, string_agg(c.name, ',' ORDER BY c.name, c.corpus_id) AS corpora FROM clink JOIN corpus c ON c.corpus_id = clink.corpus_id GROUP BY taxonomy_id)
SELECT CAST(row_number() OVER (ORDER BY way) AS INT) AS nth, wk.id, tx.name, tx.level, CAST(len(way) - 1 AS INT) AS depth, way[1].i AS top, coalesce(ln.corpora, '') AS corpora
FROM wk JOIN tx ON tx.id = wk.id LEFT JOIN ln ON ln.taxonomy_id = wk.id""")
def taxonomy_forest(s, d):
    """The taxonomy without one of its roots, whose nodes are orphans."""
    links = D.corpus_links(s, d).join(D.corpora(s, d).select("corpus_id", F.col("name").alias("corpus")), "corpus_id")
    found = taxonomy.forest(D.taxonomy(s, d).filter("id != 2"), links)
    return found.select("nth", "id", "name", "level", "depth", "top", F.array_join(F.transform("corpora", lambda c: c["corpus"]), ",").alias("corpora"))


# ---- lines of whole texts ----
_LINES = r"""ln AS (SELECT doc_id, CAST(n AS INT) AS n, parts[n + 1] AS line FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)))
"""


def _lines(s, d):
    return read_table(s, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query(_LINES + r""", h AS (SELECT *, CASE WHEN n % 7 = 0 THEN line END AS top, CASE WHEN n % 3 = 1 THEN line END AS sub FROM ln),
f AS (SELECT doc_id, n, last_value(top IGNORE NULLS) OVER w AS top, max(CASE WHEN top IS NOT NULL THEN n END) OVER w AS top_at, last_value(sub IGNORE NULLS) OVER w AS sub, max(CASE WHEN sub IS NOT NULL THEN n END) OVER w AS sub_at
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, n, top, top_at, CASE WHEN sub_at >= top_at THEN sub END AS sub, CASE WHEN sub_at >= top_at THEN sub_at END AS sub_at FROM f""", domain=False)
def headed_lines(s, d):
    """Two levels of headings over the lines below them (every seventh line, and of the others one in three), the higher one ending the lower."""
    marks = {"top": F.when(F.col("n") % 7 == 0, F.col("line")), "sub": F.when(F.col("n") % 3 == 1, F.col("line"))}
    return documents.headed(_lines(s, d), marks).select(F.col("file").alias("doc_id"), "n", "top", "top_at", "sub", "sub_at")


@query(_LINES + r""", b AS (SELECT *, sum(CAST(length(line) % 11 = 0 AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM ln),
p AS (SELECT doc_id, run, trim(regexp_replace(string_agg(line, ' ' ORDER BY n), '\s+', ' ', 'g')) AS text, min(n) AS n FROM b WHERE length(line) % 11 <> 0 GROUP BY doc_id, run)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS nth, text FROM p WHERE length(text) >= 20""".replace("SELECT doc_id, row_number()", "SELECT doc_id, CAST(row_number()").replace("ORDER BY n) AS nth", "ORDER BY n) AS INT) AS nth"), domain=False)
def line_paragraphs(s, d):
    """Runs of lines between breaks (here lines whose length is a multiple of eleven, as the tables have no blank lines)."""
    broken = _lines(s, d).withColumn("line", F.when(F.length("line") % 11 == 0, "").otherwise(F.col("line")))
    return documents.paragraphs(broken, [], 20).select(F.col("file").alias("doc_id"), "nth", "text")


@query()
def page_blocks(s, d):
    """Blocks of every page, as the corpora made of pages are read."""
    return documents.parse_html(read_table(s, d, "pages"), "page_id").groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(_MEASURED + f"SELECT version_id, \"empty\", coverage_pct FROM (SELECT version_id, corpus_id, {_COVER} FROM m GROUP BY version_id, corpus_id) ORDER BY coverage_pct, \"empty\" DESC, corpus_id, version_id LIMIT 15")
def most_incomplete(s, d):
    return reports.table(reports.most_incomplete(audit.coverage_by_version(D.units(s, d)), 15), ["version_id", "empty", "coverage_pct"])
