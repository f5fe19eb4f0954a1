"""Ingest as a stream of files of parsed units.

A version (corpus, translation) belongs to the micro-batch that brings it first, whose number is kept with its rows: rows of
that version in a later batch are left out, and a batch that is run again finds its own rows and adds nothing twice. So a
version must come whole in one batch; `max_files` None takes all files there are in one. A folder that does not exist yet is
told from one that can't be read: any other error of reading it ends the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvan.sources.files import exists

#: The column that says which run of the stream, and which micro-batch of it, a row came with.
BATCH = "batch"


def take_in(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, max_files: int | None = None) -> int:
    """Appends the versions in new files of source that target lacks; the number of micro-batches run."""
    seen = []

    def append(batch: DataFrame, number: int) -> None:
        seen.append(number)
        rows = batch.withColumn(BATCH, F.lit(number).cast("long"))
        if exists(batch.sparkSession, f"{target}/_SUCCESS"):
            there = batch.sparkSession.read.schema(f"{schema}, {BATCH} long").parquet(target)
            rows = rows.join(there.select("corpus", "translation").distinct(), ["corpus", "translation"], "left_anti").select(*there.columns)
        rows.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema)
    if max_files is not None:
        stream = stream.option("maxFilesPerTrigger", max_files)
    run = stream.parquet(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    run.trigger(availableNow=True).start().awaitTermination()
    return len(seen)
