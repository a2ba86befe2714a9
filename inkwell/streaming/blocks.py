"""Blocks as a stream: late and repeated blocks, counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import predicates as P


def arriving(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each block once, however often it comes within the delay."""
    return stream.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["block_uid"])


def windowed(stream: DataFrame, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """(start, site_id, blocks, noise, numbered): blocks by day of arrival; windows come out when the watermark has passed them."""
    rows = arriving(stream, delay).withColumn("t", F.coalesce("text", F.lit("")))
    counts = [F.count("*").alias("blocks"), F.count_if(P.is_noise(F.col("t"))).alias("noise"), F.count_if(P.question_number(F.col("t"))["kind"] == "main").alias("numbered")]
    return rows.groupBy(F.window("ingested_at", window), "site_id").agg(*counts).select(F.col("window.start").alias("start"), "site_id", "blocks", "noise", "numbered")
