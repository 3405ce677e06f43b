"""Incremental ingestion: page batches as a file stream, parsed once, split into listings and rejects.

The stream's checkpoint takes the place of a table of file states: a file is seen once, and a batch that
runs again overwrites what it wrote before (one folder per batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from brocade.functions.listing_page import RECORD_SCHEMA, parse_page
from brocade.operators.quarantine import parse_or_reject
from brocade.session import ship

PAGES = "page_id bigint, url string, crawl_date timestamp, html binary, source_bronze_key string"


def parse_stream(pages: DataFrame) -> DataFrame:
    """Parsed pages of a stream or a batch, rejects with their reason_code."""
    return parse_or_reject(pages, ["page_id", "url", "crawl_date", "source_bronze_key"], ["html", "url"], parse_page, T.StructType.fromDDL(RECORD_SCHEMA))


def ingest(spark: SparkSession, source: str, listings: str, rejects: str, checkpoint: str, files_per_batch: int = 64) -> StreamingQuery:
    """Reads what is new under source, parses it and ends. Both outcomes of a batch come from one parse."""
    ship(spark)
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        parsed = batch.persist()
        try:
            parsed.where("reason_code is null").drop("reason_code").write.mode("overwrite").parquet(f"{listings}/batch={number}")
            parsed.where("reason_code is not null").select("page_id", "url", "crawl_date", "source_bronze_key", "reason_code").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        finally:
            parsed.unpersist()

    return parse_stream(pages).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
