"""Documents that arrive as files, chunked and counted as they come.

The batch operators are used as they are: each micro-batch is chunked without a shuffle and appended; mentions are
counted in event-time windows with a watermark, so that state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.chunking import token_chunks
from graphloom.sources.textgraph import found_names

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_chunks(docs: DataFrame, out: str, checkpoint: str, size: int = 256, overlap: float = 0.15) -> StreamingQuery:
    """All that is there, once; a later call goes on from the checkpoint, and each document is chunked exactly once."""
    chunks = token_chunks(docs.select("doc_id", "lang", "source", "text"), size, overlap)
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_mentions(docs: DataFrame, time_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, type, n): mentions by type and window of arrival. docs must have a timestamp column."""
    one = docs.withWatermark(time_col, late).select(time_col, F.explode(found_names(F.col("text"))).alias("m"))
    return one.groupBy(F.window(time_col, window).alias("w"), F.col("m.type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")
