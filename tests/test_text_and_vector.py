import math

from pyspark.sql import functions as F

from silvan.functions import text as T
from silvan.functions import vector as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()[0]


def test_spaces_and_words(spark):
    assert one(spark, "  In the\tbeginning \n", T.word_count) == 3
    assert one(spark, "a b", T.collapse_spaces) == "a b"
    assert one(spark, "   ", T.blank_to_null) is None and one(spark, None, T.word_count) == 0
    assert [tuple(x) for x in one(spark, " ab  c ", T.word_spans)] == [(0, 2), (3, 4)]


def test_names(spark):
    assert one(spark, "Old Testament King James Version", T.slug) == "old-testament-king-james-version"
    assert one(spark, "kojiki", T.name_hash) == 33345
    assert [one(spark, r, T.roman_to_int) for r in ("XIV", "mcmxc", "IV.", "")] == [14, 1990, None, None]
    assert one(spark, "Eighty One", T.ordinal_word_to_int) == 81
    assert one(spark, "Chapter 12, 3", T.first_integer) == 12
    assert one(spark, "a10b2", T.natural_key) > one(spark, "a9b7", T.natural_key)


def test_envelope_and_labels(spark):
    assert one(spark, "head\n*** START OF IT\nbody\n*** END OF IT\ntail", T.strip_envelope) == "body"
    assert one(spark, "no marks", T.strip_envelope) == "no marks"
    df = spark.createDataFrame([("1:1", "1:3"), ("1:1", "1:1"), (None, "2")], "a string, b string")
    assert [r[0] for r in df.select(T.span_label(F.col("a"), F.col("b"))).collect()] == ["1:1 - 1:3", "1:1", "2"]
    assert one(spark, "x<td>1</td><TD class=a><b>two</b> 2</TD>", lambda c: T.table_cell(c, 2)) == "two 2"


def test_weighted_average(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0.75), (1, [0.0, 1.0], 0.25), (1, [1.0, 1.0], 0.0)], "k int, v array<float>, w double")
    got = V.weighted_average(df, "k", "v", "w").first()["vector"]
    assert [round(x, 6) for x in got] == [0.813733, 0.581238]


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    rows = df.select(V.cosine(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == 0 and rows[0][1] is None and math.isclose(rows[1][0], 1)
