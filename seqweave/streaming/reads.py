"""Reads as a stream: each micro-batch is matched with the collection and written under its batch id.

Matches of a read depend on that read and the collection alone, so a batch needs no state; a batch that is run again after a failure
overwrites its own folder, so results come once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching


def match_stream(reads: DataFrame, refs: DataFrame, out: str, checkpoint: str, k: int = 25, **trigger) -> StreamingQuery:
    """Occurrences (read_id, qs, qe, ref_id, rpos) of the maximal matches of streamed reads, as Parquet under out/batch=N. Empty
    batches and reads without a match write no rows."""

    def run(batch: DataFrame, n: int) -> None:
        matching.occurrences(matching.smems(batch, refs, k)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return reads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_counters(reads: DataFrame, matched: DataFrame) -> DataFrame:
    """One row (processed, aligned) over the reads and what match_stream wrote; counts of single batches add up to it."""
    hit = matched.select("read_id").distinct().withColumn("hit", F.lit(1))
    return reads.join(hit, "read_id", "left").agg(F.count("*").alias("processed"), F.count("hit").alias("aligned"))
