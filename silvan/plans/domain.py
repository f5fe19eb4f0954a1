"""The domain's tables as re-shapings of the supplied ones.

A corpus is a language, a version a (language, source). Units: version -> document -> line, text on lines only. A second,
unbalanced tree: region -> nation -> (supplier | customer -> order). The same rules as SQL stand in DOMAIN_SQL. A null lang
or source is a name like others, ranked last, and `NAMELESS` in labels and paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silvan.session import read_table

DOC, LINE = 1_000_000_000, 1_000_000_000_000
#: Lines of a document in the numbering of units; a document with more is an error.
LINES = 100_000
#: Label of a null source.
NAMELESS = "(none)"


def _ranked(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Distinct names with their rank: as many rows as there are languages or sources."""
    return df.select(*cols).distinct().withColumn(name, F.row_number().over(Window.orderBy(*(F.asc_nulls_last(c) for c in cols))).cast("long"))


def corpora(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(read_table(spark, d, "documents"), ["lang"], "corpus_id").withColumnRenamed("lang", "name")


def versions(spark: SparkSession, d: str) -> DataFrame:
    v = _ranked(read_table(spark, d, "documents"), ["lang", "source"], "version_id")
    return v.join(corpora(spark, d), v["lang"].eqNullSafe(F.col("name"))).select("version_id", "corpus_id", "lang", "source")


def numbered_documents(spark: SparkSession, d: str) -> DataFrame:
    v = versions(spark, d).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    same = F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    df = read_table(spark, d, "documents").join(v, same)
    return df.select("lang", "source", *(c for c in df.columns if c not in ("lang", "source", "lang_", "source_")))


def units(spark: SparkSession, d: str) -> DataFrame:
    """unit_id, version_id, corpus_id, parent_id, depth, height, label, text, path."""
    cols = ["unit_id", "version_id", "corpus_id", "parent_id", "depth", "height", "label", "text", "path"]
    none, source = F.lit(None).cast("string"), F.coalesce("source", F.lit(NAMELESS))
    roots = versions(spark, d).select(F.col("version_id").alias("unit_id"), "version_id", "corpus_id", F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("depth"), F.lit(2).alias("height"), source.alias("label"), none.alias("text"), F.concat(F.lit("/"), source).alias("path"))
    docs = numbered_documents(spark, d)
    key = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/"), source, F.lit("/"), key)
    middle = docs.select((F.col("doc_id") + DOC).alias("unit_id"), "version_id", "corpus_id", F.col("version_id").alias("parent_id"), F.lit(1).alias("depth"), F.lit(1).alias("height"), key.alias("label"), none.alias("text"), path.alias("path"))
    lines = docs.select("doc_id", "version_id", "corpus_id", path.alias("p"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    label = F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("n") + 1).cast("string"))
    leaves = lines.select((F.col("doc_id") * LINES + F.when(F.col("n") < LINES, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("too many lines: document "), "doc_id")).cast("int")) + LINE).alias("unit_id"), "version_id", "corpus_id", (F.col("doc_id") + DOC).alias("parent_id"), F.lit(2).alias("depth"), F.lit(0).alias("height"), label.alias("label"), "text", F.concat("p", F.lit("/"), label).alias("path"))
    return roots.select(cols).unionByName(middle.select(cols)).unionByName(leaves.select(cols))


def unbalanced(spark: SparkSession, d: str) -> DataFrame:
    """id, parent_id, depth: regions at 1, nations at 1000, suppliers at 1e6, customers at 1e8, orders at 1e10 upwards."""
    t = lambda name: read_table(spark, d, name)
    node = lambda df, i, p, depth: df.select(i.cast("long").alias("id"), p.cast("long").alias("parent_id"), F.lit(depth).alias("depth"))
    c = F.col
    return (
        node(t("region"), c("r_regionkey") + 1, F.lit(None), 0)
        .unionByName(node(t("nation"), c("n_nationkey") + 1000, c("n_regionkey") + 1, 1))
        .unionByName(node(t("supplier"), c("s_suppkey") + 1_000_000, c("s_nationkey") + 1000, 2))
        .unionByName(node(t("customer"), c("c_custkey") + 100_000_000, c("c_nationkey") + 1000, 2))
        .unionByName(node(t("orders"), c("o_orderkey") + 10_000_000_000, c("o_custkey") + 100_000_000, 3))
    )


def bridge(spark: SparkSession, d: str) -> DataFrame:
    """span_id, unit_id, unit_order, weight: a vector covers its document and the next; weights of 0 count as 1."""
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("span_id"))
    order = F.array(F.lit(0), F.lit(1))
    b = e.select("span_id", F.explode(order).alias("unit_order"))
    return b.select("span_id", (F.col("span_id") + F.col("unit_order")).alias("unit_id"), "unit_order", (F.pmod("span_id", F.lit(4)) / 4.0 + F.col("unit_order")).alias("weight"))


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """id, name, parent_id, level: regions and their nations."""
    r = read_table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("level"))
    n = read_table(spark, d, "nation").select((F.col("n_nationkey") + 101).cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.lit(1).alias("level"))
    return r.unionByName(n)


def taxonomy_links(spark: SparkSession, d: str) -> DataFrame:
    """corpus, taxonomy_id: market segments and the nations of their customers."""
    return read_table(spark, d, "customer").select(F.col("c_mktsegment").alias("corpus"), (F.col("c_nationkey") + 101).cast("long").alias("taxonomy_id")).distinct()


def corpus_links(spark: SparkSession, d: str) -> DataFrame:
    """corpus_id, taxonomy_id: each corpus at the nation of its number, and every second one at a region too."""
    c = corpora(spark, d).select("corpus_id")
    own = c.select("corpus_id", (F.col("corpus_id") + 100).alias("taxonomy_id"))
    return own.unionByName(c.filter("corpus_id % 2 = 0").select("corpus_id", F.lit(1).cast("long").alias("taxonomy_id")))


def levels(spark: SparkSession, d: str) -> DataFrame:
    """corpus_id, height, name: the three levels of each corpus."""
    names = F.array(*(F.struct(F.lit(h).alias("height"), F.lit(n).alias("name")) for h, n in enumerate(("Line", "Document", "Sources"))))
    return corpora(spark, d).select("corpus_id", F.explode(names).alias("l")).select("corpus_id", "l.height", "l.name")


def source_refs(spark: SparkSession, d: str) -> DataFrame:
    """version_id, url of every version but each third one."""
    v = versions(spark, d).filter("version_id % 3 != 0")
    return v.select("version_id", F.concat(F.lit("https://example.org/"), F.coalesce("source", F.lit(NAMELESS))).alias("url"))


DOMAIN_SQL = """
corpus AS (SELECT row_number() OVER (ORDER BY lang) AS corpus_id, lang AS name FROM (SELECT DISTINCT lang FROM documents)),
version AS (
  SELECT v.version_id, c.corpus_id, v.lang, v.source
  FROM (SELECT row_number() OVER (ORDER BY lang, source) AS version_id, lang, source FROM (SELECT DISTINCT lang, source FROM documents)) v
  JOIN corpus c ON c.name IS NOT DISTINCT FROM v.lang),
doc AS (SELECT d.*, v.version_id, v.corpus_id FROM documents d JOIN version v ON v.lang IS NOT DISTINCT FROM d.lang AND v.source IS NOT DISTINCT FROM d.source),
line AS (
  SELECT doc_id, version_id, corpus_id, source, n, parts[n + 1] AS text
  FROM (SELECT *, unnest(range(len(parts))) AS n FROM (SELECT doc_id, version_id, corpus_id, source, string_split(text, chr(10)) AS parts FROM doc))),
unit AS (
  SELECT version_id AS unit_id, version_id, corpus_id, CAST(NULL AS BIGINT) AS parent_id, 0 AS depth, 2 AS height, coalesce(source, '(none)') AS label, CAST(NULL AS VARCHAR) AS text, '/' || coalesce(source, '(none)') AS path
  FROM version
  UNION ALL
  SELECT doc_id + 1000000000, version_id, corpus_id, version_id, 1, 1, CAST(doc_id AS VARCHAR), NULL, '/' || coalesce(source, '(none)') || '/' || doc_id FROM doc
  UNION ALL
  SELECT doc_id * 100000 + n + 1000000000000, version_id, corpus_id, doc_id + 1000000000, 2, 0, doc_id || ':' || (n + 1), text, '/' || coalesce(source, '(none)') || '/' || doc_id || '/' || doc_id || ':' || (n + 1)
  FROM line),
node AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 0 AS depth FROM region
  UNION ALL SELECT n_nationkey + 1000, n_regionkey + 1, 1 FROM nation
  UNION ALL SELECT s_suppkey + 1000000, s_nationkey + 1000, 2 FROM supplier
  UNION ALL SELECT c_custkey + 100000000, c_nationkey + 1000, 2 FROM customer
  UNION ALL SELECT o_orderkey + 10000000000, o_custkey + 100000000, 3 FROM orders),
bridge AS (
  SELECT vec_id AS span_id, vec_id + o AS unit_id, o AS unit_order, (vec_id % 4) / 4.0 + o AS weight FROM embeddings, (VALUES (0), (1)) t(o)),
taxonomy AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id, 0 AS level FROM region
  UNION ALL SELECT n_nationkey + 101, n_name, n_regionkey + 1, 1 FROM nation),
clink AS (
  SELECT corpus_id, corpus_id + 100 AS taxonomy_id FROM corpus UNION ALL SELECT corpus_id, 1 FROM corpus WHERE corpus_id % 2 = 0),
clevel AS (SELECT corpus_id, height, name FROM (SELECT corpus_id FROM corpus), (VALUES (0, 'Line'), (1, 'Document'), (2, 'Sources')) l(height, name)),
ref AS (SELECT version_id, 'https://example.org/' || coalesce(source, '(none)') AS url FROM version WHERE version_id % 3 <> 0),
link AS (SELECT DISTINCT c_mktsegment AS corpus, CAST(c_nationkey + 101 AS BIGINT) AS taxonomy_id FROM customer)
"""
