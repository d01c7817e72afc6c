"""Indexing of documents as they arrive, with Structured Streaming.

Each micro-batch writes its postings and document rows under its own number, so
a batch that runs again replaces what it wrote; readers see all batches as one
table.  Documents are indexed once; ids must not come in several batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrove.functions.analysis import types
from lexigrove.functions.stemmer import stem_terms
from lexigrove.operators.index import Index, corpus_stats, doc_stats, table_postings, term_stats


def index_stream(documents: DataFrame, path: str, checkpoint: str, stemmed: bool = True, once: bool = True) -> StreamingQuery:
    """Index a stream of ``(doc_id, title, content, format)`` at ``path``.

    ``once`` takes what is there and stops, else batches follow each other.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        target = f"{path}/postings/batch={number}"
        full = table_postings(batch, stemmed)
        full.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.schema(full.schema).parquet(target).select("doc_id", "term", "tf")
        doc_stats(batch, written).write.mode("overwrite").parquet(f"{path}/doc_stats/batch={number}")
        batch.unpersist()

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def streamed_index(spark: SparkSession, path: str, stemmed: bool = True) -> Index:
    """The index of all batches so far; its term statistics are counted at each use, see :func:`compact`."""
    posted = spark.read.parquet(f"{path}/postings").where("term <> ''").drop("batch")
    stats = spark.read.parquet(f"{path}/doc_stats").drop("batch")
    return Index(posted, term_stats(posted), stats, corpus_stats(stats), stemmed, path)


def compact(spark: SparkSession, path: str, target: str, stemmed: bool = True) -> Index:
    """Write all batches so far as one index at ``target``, ranged by term and with its statistics."""
    full = spark.read.parquet(f"{path}/postings").drop("batch")
    return Index.write(full, spark.read.parquet(f"{path}/doc_stats").select("doc_id", "title"), target, stemmed)


def term_counts(documents: DataFrame, time: str, late: str = "1 hour", width: str = "10 minutes", stemmed: bool = False) -> DataFrame:
    """Streaming counts of each term in tumbling windows of an event time; rows later than ``late`` are left out.

    ``documents`` has the time, ``content`` and perhaps ``format``; terms are those of the index, but for the empty one.
    """
    timed = documents.withWatermark(time, late)
    kind = F.coalesce("format", F.lit("txt")) if "format" in documents.columns else F.lit("txt")
    rows = types(timed.select(F.col(time).alias("at_time"), "content", kind.alias("format")), ("at_time",)).where("term <> ''")
    rows = stem_terms(rows) if stemmed else rows
    return rows.groupBy(F.window("at_time", width).alias("window"), "term").agg(F.count("*").alias("n"))
