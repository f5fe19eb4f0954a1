"""The queue for the encoder: all texts, longest first, in ranges of equal bytes."""

from pyspark.sql import functions as F

from silvan.operators import ingest

NONE = "unit_id long"


def units(spark, lines):
    """Documents of as many lines as are given, a line of a few words each."""
    rows = [(1000 + k, None, 1, None) for k in range(len(lines))]
    rows += [(10_000 + 1000 * k + n, 1000 + k, 0, "five words in a line" if n % 10 else " ") for k, many in enumerate(lines) for n in range(many)]
    return spark.createDataFrame(rows, "unit_id long, parent_id long, height int, text string").repartition(5)


def test_ranges_of_bytes_in_order(spark, monkeypatch):
    """A few long texts are most of the bytes, and most rows have one cost: no task gets many times its share of either."""
    monkeypatch.setattr(ingest, "RANGE_BYTES", 4_000)
    u = units(spark, [900, 900, 850, *[5] * 300, 0])
    queue = ingest.embed_queue(u, spark.createDataFrame([(1002,), (10_001,)], NONE))
    got = [tuple(r) for r in queue.withColumn("p", F.spark_partition_id()).select("unit_id", "text", "cost", "p").collect()]
    want = {}
    for r in u.filter("height = 0 and trim(text) != ''").orderBy("unit_id").collect():
        want[r["unit_id"]] = r["text"]
        want[r["parent_id"]] = f"{want[r['parent_id']]} {r['text']}" if r["parent_id"] in want else r["text"]
    want = {k: ("search_document: " + t, len(t.split()) * 13 // 10) for k, t in want.items() if k not in (1002, 10_001)}
    assert [(i, t, c) for i, t, c, _ in got] == sorted(((k, *v) for k, v in want.items()), key=lambda r: (-r[2], r[0]))
    size = {}
    for _, text, _, p in got:
        size[p] = size.get(p, 0) + len(text) - len("search_document: ")
    longest = max(len(t) for _, t, _, _ in got)
    assert len(size) > 10 and sorted(size.values())[-3] <= 2 * 4_000 and max(size.values()) <= longest + 2 * 4_000


def test_small_and_empty_queues(spark):
    done = spark.createDataFrame([], NONE)
    assert [r["unit_id"] for r in ingest.embed_queue(units(spark, [4, 2]), done).collect()] == [1000, 1001, 10_001, 10_002, 10_003, 11_001]
    assert ingest.embed_queue(units(spark, [0]), done).count() == 0
