"""Order book snapshots: queue ahead of a limit and the order mode by snapshot age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

URGENT = ("SL", "LIQUIDATION_PREVENTION", "EMERGENCY_EXIT", "STOP_LOSS", "LIQUIDATION")
EXITS = ("EXIT", "TRAIL_PROFIT", "REGIME_FLIP", "TAKE_PROFIT", "NORMAL_EXIT")


def queue_ahead(books: DataFrame, discount: float = 0.7, avg_volume: str | None = None) -> DataFrame:
    """Volume at or better than the limit on the own side of each snapshot.

    ``books``: side, limit_price, age_ms, bids and asks as arrays of (p, v).
    """
    lim = F.col("limit_price")
    total = lambda levels, keep: F.aggregate(
        F.filter(F.coalesce(levels, F.array().cast("array<struct<p:double,v:double>>")), lambda x: keep(x) & (x["v"] > 0)),
        F.lit(0.0), lambda s, x: s + x["v"],
    )
    seen = F.when(F.col("side") > 0, total(F.col("bids"), lambda x: x["p"] >= lim)).otherwise(total(F.col("asks"), lambda x: x["p"] <= lim))
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    b = books.withColumns({"queue_visible": seen, "valid": F.greatest(n("bids"), n("asks")) > 0})
    b = b.withColumn("queue_effective", F.col("queue_visible") * discount)
    bars = F.when(F.col(avg_volume) > 0, F.col("queue_effective") / F.col(avg_volume)).otherwise(0.0) if avg_volume else F.lit(0.0)
    return b.withColumn("depletion_bars", bars)


def order_mode(books: DataFrame, intent: str, tier1_ms: int = 500, tier2_ms: int = 2000, discount: float = 0.7) -> DataFrame:
    """Fresh snapshots keep the limit, older ones post with a larger queue, stale ones
    fall back by intent."""
    b = queue_ahead(books, discount)
    tier = F.when(~F.col("valid") | (F.col("age_ms") > tier2_ms), 2).when(F.col("age_ms") > tier1_ms, 1).otherwise(0)
    fallback = "FORCE_MARKET" if intent in URGENT else "POSTPONE_NON_EMERGENCY_EXIT" if intent in EXITS else "ABORT_ENTRY"
    b = b.withColumn("tier", tier)
    return b.withColumns(
        {
            "mode": F.when(F.col("tier") == 2, fallback).when(F.col("tier") == 1, "POST_ONLY_LIMIT").otherwise("LIMIT"),
            "queue_effective": F.col("queue_effective") * F.when(F.col("tier") == 1, 1.5).otherwise(1.0),
        }
    )
