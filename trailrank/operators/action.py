"""Next-action predictors and action statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailrank.functions.schema import action_code


def trailing_views(histories: DataFrame) -> DataFrame:
    """(session_id, n_views, trail_view): views in all, and views since the last other action."""
    other = F.max(F.when(F.col("action") != "view", F.col("pos") + 1))
    return histories.groupBy("session_id").agg(F.sum((F.col("action") == "view").cast("long")).alias("n_views"), (F.count(F.lit(1)) - F.coalesce(other, F.lit(0))).alias("trail_view"))


def action_shares(features: DataFrame, targets: DataFrame, by: str) -> DataFrame:
    """(by, sessions, apply, view): the share of each next action for every value of a feature."""
    both = features.join(targets.select("session_id", "action"), "session_id")
    counts = both.groupBy(by).pivot("action", ["apply", "view"]).count().na.fill(0)
    total = F.col("apply") + F.col("view")
    return counts.select(by, total.alias("sessions"), F.round(F.col("apply") / total, 6).alias("apply"), F.round(F.col("view") / total, 6).alias("view"))


def last_action(histories: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, action): the last action that is not null; ``view`` without history or for an unknown token."""
    last = histories.where("action IS NOT NULL").groupBy("session_id").agg(F.max_by("action", "pos").alias("said"))
    return sessions.select("session_id").join(last, "session_id", "left").select("session_id", said(F.col("said")).alias("action"))


def said(last: Column) -> Column:
    """The last action as a prediction; ``view`` without one or for an unknown token."""
    return F.when(last.isin("view", "apply"), last).otherwise("view")


def last_of(ends: DataFrame) -> DataFrame:
    """``last_action`` of the rows of ``markov.session_ends``, whose actions are not null."""
    return ends.select("session_id", said(F.col("last_action")).alias("action"))


def fit_logistic(features: DataFrame, targets: DataFrame, c: float = 1.0):
    """Logistic regression of apply on ``trail_view``: L2 with strength 1 / (c n), free intercept, no scaling."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = features.join(targets.select("session_id", "action"), "session_id").select(F.col("trail_view").cast("double").alias("trail_view"), action_code(F.col("action")).cast("double").alias("label"))
    # the loss is a sum over rows, so equal rows are one row of their weight
    counts = rows.groupBy("trail_view", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")).coalesce(1).persist()
    ready = VectorAssembler(inputCols=["trail_view"], outputCol="features", handleInvalid="error").transform(counts)
    n = int(counts.agg(F.sum("weight")).first()[0] or 0)
    return LogisticRegression(weightCol="weight", regParam=1 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(ready)


def predict_logistic(model, features: DataFrame) -> DataFrame:
    """(session_id, action, p_apply)."""
    slope, base = float(model.coefficients[0]), float(model.intercept)
    p = 1 / (1 + F.exp(-(F.lit(slope) * F.col("trail_view") + F.lit(base))))
    return features.select("session_id", F.when(p > 0.5, "apply").otherwise("view").alias("action"), p.alias("p_apply"))


def last_seen(histories: DataFrame) -> DataFrame:
    return histories.withColumn("_back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("pos").desc()))).where("_back = 1").drop("_back")
