"""Identification of a stream of query hashes against a static index (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching
from ..plans.config import Match


def counts(stream: DataFrame, postings: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """(window, query_id, song_id, delta, cnt) of a stream (ts, query_id, h, t1): a static join and a windowed count whose state the watermark bounds."""
    hits = stream.withWatermark("ts", late).select("ts", "query_id", "h", F.col("t1").alias("tq")).join(postings, "h")
    return hits.groupBy(F.window("ts", width), "query_id", "song_id", (F.col("t1") - F.col("tq")).cast("int").alias("delta")).agg(F.count("*").alias("cnt"))


def start(stream: DataFrame, postings: DataFrame, cfg: Match, sink, checkpoint: str) -> StreamingQuery:
    """Calls sink(decisions) for every micro-batch of whole queries (query_id, h, t1)."""

    def each(batch: DataFrame, _: int) -> None:
        sink(matching.identify(batch.select("query_id").distinct(), batch, postings, cfg))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
