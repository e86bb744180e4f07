"""Structured Streaming of new pages into chunks: beyond what a batch build needs, with the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import text_sha256
from corvane.functions.url import logical_path
from corvane.operators.chunk import chunk_sections
from corvane.operators.html import ParserSettings, parse_pages, sections

PAGE = "page_id bigint, url string, html string, fetched_at timestamp"


def new_chunks(pages: DataFrame, settings: ParserSettings = ParserSettings(), late: str = "1 hour") -> DataFrame:
    """Chunks of pages whose content did not come before within ``late``; state is one hash a page, dropped by watermark."""
    hashed = pages.withColumn("content_sha256", text_sha256(F.col("html")))
    if pages.isStreaming:
        hashed = hashed.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["content_sha256"])
    else:
        hashed = hashed.dropDuplicates(["content_sha256"])
    return chunk_sections(sections(parse_pages(hashed.withColumn("logical_path", logical_path(F.col("url"))), settings)))


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, settings: ParserSettings = ParserSettings()) -> StreamingQuery:
    """Appends the chunks of Parquet pages that arrive in ``source`` to ``sink``, once over what is there."""
    stream = new_chunks(spark.readStream.schema(PAGE).parquet(source), settings)
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
