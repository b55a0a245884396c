"""Score tables (session_id, job_id, score[, model]): sanitising, normalising, ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(score: Column) -> Column:
    """The score, or 0 for null, NaN and infinities (NaN is tested first: it compares as largest)."""
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(score)


def is_signal(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) != F.lit(float("inf"))) & (score > 0)


def minmax(score: Column, over: Window) -> Column:
    """(x - min) / (max - min); 0 where the range is below 1e-12."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high - low < 1e-12, F.lit(0.0)).otherwise((score - low) / (high - low))


def normalize(scores: DataFrame, mode: str = "minmax", keys: tuple[str, ...] = ("session_id", "model")) -> DataFrame:
    """``score`` normalised within each group: ``none``, ``minmax``, or ``rank`` (1 to 0 in even steps).

    Ranks order by score, ties by ``cand_rank`` if there is such a column, then by job.
    """
    keys = tuple(k for k in keys if k in scores.columns)
    clean, group = scores.withColumn("score", finite(F.col("score"))), Window.partitionBy(*keys)
    if mode == "none":
        return clean
    if mode == "minmax":
        return clean.withColumn("score", minmax(F.col("score"), group))
    if mode == "rank":
        ties = ["cand_rank"] if "cand_rank" in scores.columns else []
        place = F.row_number().over(group.orderBy(F.col("score").desc(), *ties, "job_id")) - 1
        size = F.count(F.lit(1)).over(group)
        return clean.withColumn("score", F.when(size == 1, F.lit(1.0)).otherwise(1 - place / (size - 1)))
    raise ValueError(f"unknown normalisation {mode!r}")


def simplex(weights: dict[str, float]) -> dict[str, float]:
    """Weights clipped at 0 that sum to 1; even ones if all are 0."""
    clipped = {k: max(0.0, float(v)) if math.isfinite(float(v)) else 0.0 for k, v in weights.items()}
    total = sum(clipped.values())
    return {k: v / total for k, v in clipped.items()} if total > 0 else dict.fromkeys(clipped, 1 / max(1, len(clipped)))


def top_k(scores: DataFrame, k: int, ties: tuple[str, ...] = ("job_id",), keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The k best rows of each group with ``rank`` from 1; ties by the named columns."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), *ties)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def max_normalized(scores: DataFrame) -> DataFrame:
    """Scores over their largest, where that is positive. The largest is one aggregate row, not a global window."""
    top = scores.agg(F.max("score").alias("_top"))
    return scores.crossJoin(F.broadcast(top)).withColumn("score", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(F.col("score"))).drop("_top")
