"""Page snapshots as a stream: each new page once, classified. An extension: the batch operators on micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listforge.functions import scalars as S
from listforge.operators import pages as P

SCHEMA = "page_id long, url string, html string, fetched_at timestamp"


def read_pages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_pages(stream: DataFrame, keep: str = "1 day") -> DataFrame:
    """url, title, text_sha256, blocked of pages whose normalised URL is new within the watermark: state is bounded by it."""
    rows = stream.withColumn("url", S.normalize_url(F.col("url"))).filter("url <> ''").withWatermark("fetched_at", keep).dropDuplicatesWithinWatermark(["url"])
    text = P.native_text(F.col("html"))
    return rows.select("url", "fetched_at", P.native_title(F.col("html")).alias("title"), F.sha2(text, 256).alias("text_sha256"), S.is_blocked(text).alias("blocked"))
