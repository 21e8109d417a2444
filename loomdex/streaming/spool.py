"""Staged ingest: a folder of incoming records is read as a stream, analysed, and appended batch by batch.

Progress is in the checkpoint, so a batch that ran before a failure is not repeated; files per batch bound how much is in
flight. Each record carries a status: CD (a document), DEL (a deletion), IDXW (analysed) or ERR (could not be read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.operators import index, store
from loomdex.schema import Collection

SCHEMA = "oid string, seq long, status string, title string, body string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def checked(records: DataFrame) -> DataFrame:
    """Records with status ERR where key, sequence number or text are missing."""
    bad = F.col("oid").isNull() | F.col("seq").isNull() | (F.col("status") == "CD") & F.col("body").isNull()
    return records.withColumn("status", F.when(bad, "ERR").otherwise(F.col("status")))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, collection: Collection, files_per_batch: int = 100) -> StreamingQuery:
    """Appends records to out/records and postings of documents to out/postings; ends when what is there has been read."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = checked(batch).persist()
        try:
            # a batch that is run again replaces what it wrote
            rows.write.mode("overwrite").parquet(f"{out}/records/epoch={epoch}")
            docs = rows.where("status = 'CD'").select(F.col("seq").alias(collection.id_col), "title", "body")
            index.postings(docs, collection).write.mode("overwrite").parquet(f"{out}/postings/epoch={epoch}")
        finally:
            rows.unpersist()

    return read(spark, folder, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of every key that is not deleted."""
    return upserted(spark.read.parquet(f"{out}/records"))


def upserted(records: DataFrame) -> DataFrame:
    """The newest record of every key, if that is a document; records with status ERR count for nothing."""
    good = records.where("status <> 'ERR'").select("oid", "seq", "status", "title", "body")
    return store.latest(good, "oid", "seq").where("status = 'CD'").select("oid", "seq", "title", "body")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window, with a watermark; works on a stream or a table."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
