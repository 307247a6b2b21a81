"""Attempt histories: scores, non-improvement streaks, stop points.

All ordered steps run on sampled pieces (see functions.windows), so a report with very many attempts is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.windows import Ordered, ordered

# Stop after this many non-improving attempts; smallest delta that counts as progress.
BACKOFF, MIN_DELTA = 2, "0.2"
_FAR = "9999999.00"


def attempt_score(accepted: Column, similarity: Column, visual: Column, heading_ratio: Column) -> Column:
    """100 when accepted, else half similarity, 0.3 visual and 20 times the heading ratio; nulls count as 0."""

    def dec(c: Column) -> Column:
        return F.coalesce(c.cast("decimal(12,4)"), F.lit(0).cast("decimal(12,4)"))

    def w(x: str) -> Column:
        return F.lit(x).cast("decimal(4,2)")

    mixed = dec(similarity) * w("0.5") + dec(visual) * w("0.3") + dec(heading_ratio) * 20
    return F.when(F.coalesce(accepted, F.lit(False)), 100.0).otherwise(F.round(mixed, 2).cast("double"))


def numbered(scores: DataFrame, order: list[str]) -> DataFrame:
    """scores: report_id, score, order columns -> attempt (1-based) and prev score."""
    return ordered(scores, ["report_id"], order, sums={"attempt": F.lit(1)}, prevs={"prev": F.col("score")})


def streaks(scores: DataFrame, order: list[str]) -> DataFrame:
    """Adds attempt, prev, streak (attempts since the last improvement) and stalled (the last two deltas are small)."""
    pieces = Ordered(scores, ["report_id"], order)
    rows = pieces.running(pieces.rows, sums={"attempt": F.lit(1)}, prevs={"prev": F.col("score")})
    delta = F.col("score").cast("decimal(12,2)") - F.col("prev").cast("decimal(12,2)")
    rows = rows.withColumn("_delta", F.coalesce(delta, F.lit(_FAR).cast("decimal(13,2)")))
    improved = F.col("prev").isNull() | (F.col("score") > F.col("prev"))
    rows = pieces.running(rows, lasts={"_reset": F.when(improved, F.col("attempt"))}, prevs={"_before": F.col("_delta")}).drop("_slot")
    small = F.lit(MIN_DELTA).cast("decimal(12,2)")
    stalled = (F.col("attempt") >= 3) & (F.col("_delta") <= small) & (F.col("_before") <= small)
    return rows.withColumn("streak", F.col("attempt") - F.col("_reset")).withColumn(
        "stalled", F.coalesce(stalled, F.lit(False))
    )


def stop_points(streaked: DataFrame) -> DataFrame:
    """report_id, attempts, stop_attempt, reason: where the retry loop ends, null when it never does. On the same attempt
    the streak rule is tested first."""
    streak_at = F.min(F.when(F.col("streak") >= BACKOFF, F.col("attempt")))
    stall_at = F.min(F.when(F.col("stalled"), F.col("attempt")))
    g = streaked.groupBy("report_id").agg(
        F.count("*").alias("attempts"), streak_at.alias("a"), stall_at.alias("b")
    )
    stop = F.least("a", "b")
    reason = F.when(stop.isNull(), F.lit(None).cast("string")).when(F.col("a") == stop, "backoff").otherwise("unlikely")
    return g.select("report_id", "attempts", stop.alias("stop_attempt"), reason.alias("reason"))


def delta_class(prev: Column, score: Column) -> Column:
    return F.when(prev.isNull(), "first").when(score > prev, "up").when(score < prev, "down").otherwise("flat")
