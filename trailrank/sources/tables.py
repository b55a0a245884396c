"""Adapters from the synthetic tables to interactions and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailrank.functions.schema import dealt


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders_as_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are sessions, parts are jobs, returned items are applications. A session is dealt to one task, so no window over it shuffles again."""
    items = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("session_id").orderBy("l_linenumber", "l_partkey", "l_shipdate")
    items = dealt(items.select(F.col("l_orderkey").cast("string").alias("session_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag"), "session_id")
    return items.select("session_id", F.col("l_partkey").cast("string").alias("job_id"), F.when(F.col("l_returnflag") == "R", "apply").otherwise("view").alias("action"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("l_orderkey").alias("session_ord"))


def users_as_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are sessions, the events' keys are jobs, purchases are applications; other types stay as they are."""
    events = read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "apply").when(F.col("event_type").isin("view", "click"), "view").otherwise(F.col("event_type"))
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    events = dealt(events.select(F.col("user_id").cast("string").alias("session_id"), "user_id", "event_id", "ts", "event_type", "props"), "session_id")
    return events.select("session_id", F.get_json_object("props", "$.k").alias("job_id"), action.alias("action"), (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("user_id").alias("session_ord"))


def parts_as_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, text): a part's name, brand and type."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("job_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))


def documents_as_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"), "text")
