"""Posting lists kept up to date from a stream of forms: each micro-batch is indexed by the same operators and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index


def stream_postings(forms: DataFrame, spec: index.IndexSpec = index.FORM_SPEC) -> DataFrame:
    """A streaming DataFrame of forms (with the spec's columns) to its postings; stateless, so it appends."""
    return index.postings(forms, spec)


def windowed_keyword_counts(forms: DataFrame, time: str = "loaded_at", window: str = "1 day", late: str = "30 days") -> DataFrame:
    """(window, keyword, n): how often forms came in under each exact keyword, by event time; later rows are dropped."""
    rows = index.postings(forms.withWatermark(time, late), index.IndexSpec(("lexeme_no", "form_no"), "word", carry=(time,)))
    return rows.filter(F.col("tier") == index.EXACT).groupBy(F.window(time, window), "keyword").agg(F.count("*").alias("n"))


def append_postings(forms: DataFrame, path: str, checkpoint: str, spec: index.IndexSpec = index.FORM_SPEC, **trigger):
    """Starts the query that appends the postings of a stream to Parquet, in directories by the keyword's hash."""
    rows = stream_postings(forms, spec).withColumn("bucket", F.pmod(F.xxhash64("keyword"), F.lit(64)))
    return rows.writeStream.format("parquet").partitionBy("bucket").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
