"""Documents as they arrive: postings appended in micro-batches, and counts in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import keyword


def document_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def index_stream(docs: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> StreamingQuery:
    """Appends each batch's postings and lengths below path/postings and path/lengths, by batch number.

    A batch that runs again replaces its own folder, so every document is indexed once.
    """

    def write(batch: DataFrame, number: int) -> None:
        keyword.postings(batch, id_col, text_col).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        keyword.lengths(batch, id_col, text_col).write.mode("overwrite").parquet(f"{path}/lengths/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, ts_col: str, key_col: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and window of event time; rows later than `late` are dropped by the watermark of a stream."""
    return events.withWatermark(ts_col, late).groupBy(F.window(ts_col, width), key_col).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key_col, "n")
