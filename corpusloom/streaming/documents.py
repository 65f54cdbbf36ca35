"""Per-document operators over a stream of documents.

An extension: annotation is stateless, and counts are kept by Structured Streaming
itself, with a watermark where documents carry a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.annotate import annotate
from ..operators.counts import frequencies
from ..operators.tokens import with_inclusion


def streamed_frequencies(docs: DataFrame, time: str | None = None, window: str = "1 hour", late: str = "10 minutes", **inclusion) -> DataFrame:
    """Counts by group and item, or by window of ``time`` as well; documents later than ``late`` are dropped."""
    if time:
        docs = docs.withWatermark(time, late)
    tokens = with_inclusion(annotate(docs), **inclusion)
    if not time:
        return frequencies(tokens)
    return tokens.filter("included").groupBy(F.window(time, window), "group", F.col("analysis_key").alias("item")).agg(F.count("*").alias("count"))
