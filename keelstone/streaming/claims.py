"""Validation of a stream of claims, and windowed counts of verdicts (additions to the batch engine)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keelstone.plans.validation import validate_claims


def validate_stream(claims: DataFrame, rules: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options) -> StreamingQuery:
    """Each micro-batch of ``claims`` (``claim_id, claim``) is validated by the batch plan and given to ``sink``."""

    def run(batch: DataFrame, number: int) -> None:
        sink(validate_claims(batch, rules, **options), number)

    return claims.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()


def verdict_counts(verdicts: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Verdicts per window and status; rows later than the watermark are dropped by the stream."""
    return verdicts.withWatermark(time, late).groupBy(F.window(time, window), "status").agg(F.count(F.lit(1)).alias("n"))
