"""Streams: documents that arrive, and the ledger of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions import text as T
from lexmill.operators import corpus
from lexmill.sources.sinks import Versions

DOCS = "source string, doc_seq long, sha256 string, text string"


def upsert_batch(store: Versions, batch: DataFrame) -> None:
    """One batch of (source, text) into the store. A batch that comes again changes nothing: its hashes are known."""
    spark = store.spark
    docs = store.read("docs")
    if docs is None:
        docs = spark.createDataFrame([], DOCS)
    # of a source that comes twice in a batch the last text by hash order counts, whatever the order of arrival
    new = batch.filter("source is not null and text is not null").groupBy("source").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    if corpus.upsert_status(new, docs).filter("status <> 'unchanged'").limit(1).count():
        store.write(docs=corpus.upserted(new, docs))


def ingest_stream(incoming: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Runs upserts for every micro-batch of (source, text) until the query is stopped or its input is used up."""
    store = Versions(incoming.sparkSession, root)
    return incoming.writeStream.foreachBatch(lambda df, _: upsert_batch(store, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of text files as they arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.decode("content", "UTF-8").alias("text"))


def windowed_ledger(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(start, tool, calls, served): calls by tool and window; on a stream, rows later than `late` are not waited for."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), T.token_count(F.col("props")).alias("tokens"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    w = e.groupBy(F.window("ts", width).alias("w"), "tool").agg(F.count("*").alias("calls"), F.sum("tokens").alias("served"))
    return w.select(F.col("w.start").alias("start"), "tool", "calls", "served")
