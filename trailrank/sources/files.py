"""CSV and JSON sources and sinks of the session logs, listings and submissions."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSIONS = "session_id STRING, job_ids STRING, actions STRING"
TARGETS = "session_id STRING, job_id STRING, action STRING"
ID_COLUMNS = ("job_id", "id", "listing_id", "key")
TEXT_COLUMNS = ("text", "description", "summary", "content", "job_description", "title")


def read_csv(spark: SparkSession, path: str, schema: str = SESSIONS) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, escape='"')


def read_listings_json(spark: SparkSession, path: str) -> DataFrame:
    """(job_id BIGINT, text) of one JSON object {id: text}; anything else is an error."""
    body = spark.read.text(path, wholetext=True)
    parsed = body.select(F.from_json("value", "map<string,string>").alias("m"), F.trim("value").startswith("{").alias("is_map"))
    checked = parsed.select(F.when(F.col("is_map") & F.col("m").isNotNull(), F.col("m")).otherwise(F.raise_error(F.lit("listings must be a JSON object")).cast("map<string,string>")).alias("m"))
    return checked.select(F.explode("m").alias("k", "text")).select(F.col("k").cast("bigint").alias("job_id"), "text")


def parse_list(cell: Column, kind: str = "string", strict: bool = False) -> Column:
    """A list literal's elements. Strict: malformed cells are an error; else they, and nulls, give an empty list.

    ``None`` outside quotes is a null element, which the tolerant reader spells ``'None'``.
    """
    if strict:
        return F.from_json(cell, f"array<{kind}>", {"mode": "FAILFAST", "allowSingleQuotes": "true"})
    spelled = F.regexp_replace(cell, r"""(?<=[\[,])\s*None\s*(?=[,\]])""", '"None"')
    return F.coalesce(F.from_json(spelled, f"array<{kind}>", {"allowSingleQuotes": "true"}), F.array().cast(f"array<{kind}>"))


def explode_sessions(sessions: DataFrame) -> DataFrame:
    """(session_id, job_id, action, pos) from list cells: aligned up to the shorter list, nulls dropped."""
    lists = sessions.select(F.col("session_id").cast("string").alias("session_id"), parse_list(F.col("job_ids")).alias("j"), parse_list(F.col("actions")).alias("a"))
    n = F.least(F.size("j"), F.size("a"))
    pairs = F.arrays_zip(F.slice("j", F.lit(1), n).alias("job_id"), F.slice("a", F.lit(1), n).alias("action"))
    rows = lists.select("session_id", F.posexplode(pairs).alias("pos", "p"))
    return rows.select("session_id", F.col("p.job_id").alias("job_id"), F.col("p.action").alias("action"), F.col("pos").cast("long").alias("pos")).na.drop()


def session_arrays(interactions: DataFrame) -> DataFrame:
    """(session_id, job_ids, actions): the arrays of each session in order."""
    packed = interactions.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", "job_id", "action"))).alias("rows"))
    return packed.select("session_id", F.col("rows.job_id").alias("job_ids"), F.col("rows.action").alias("actions"))


def append_target(arrays: DataFrame, targets: DataFrame) -> DataFrame:
    """The arrays with each session's target at the end (sessions without one are left out)."""
    goal = targets.select("session_id", F.col("job_id").alias("_job"), F.col("action").alias("_action"))
    both = arrays.join(goal, "session_id")
    return both.select("session_id", F.concat("job_ids", F.array("_job")).alias("job_ids"), F.concat("actions", F.array("_action")).alias("actions"))


def coerce_listings(listings, spark: SparkSession | None = None) -> DataFrame:
    """(job_id, text) of a DataFrame, a mapping or a list of mappings; the last row of an id wins.

    The id and text columns are the first that exist of ``ID_COLUMNS`` and
    ``TEXT_COLUMNS``; without a text column all other columns are joined. A
    DataFrame may have ``ord`` to say which row is last.
    """
    if not isinstance(listings, DataFrame):
        if isinstance(listings, dict):
            rows = [(str(k), listing_text(v), n) for n, (k, v) in enumerate(listings.items())]
        else:
            rows = [(str(next((r[c] for c in ID_COLUMNS if r.get(c) is not None), n)), listing_text({k: v for k, v in r.items() if k not in ID_COLUMNS}), n) for n, r in enumerate(listings or [])]
        listings = (spark or SparkSession.active()).createDataFrame(rows, "job_id string, text string, ord long")
    names = listings.columns
    own = next((c for c in ID_COLUMNS if c in names), None)
    if own is None:
        raise ValueError(f"listings need one of the columns {', '.join(ID_COLUMNS)}")
    body = next((c for c in TEXT_COLUMNS if c in names), None)
    text = F.col(body).cast("string") if body else F.concat_ws(" ", *[F.col(c).cast("string") for c in names if c not in (own, "ord")])
    order = F.col("ord") if "ord" in names else F.coalesce(text, F.lit(""))
    rows = listings.select(F.col(own).cast("string").alias("job_id"), F.coalesce(text, F.lit("")).alias("text"), order.alias("ord"))
    return rows.where("job_id IS NOT NULL").groupBy("job_id").agg(F.max_by("text", "ord").alias("text"))


def listing_text(value) -> str:
    """A string as it is; of a mapping the first text key that is not null, else all scalars joined."""
    if value is None:
        return ""
    if isinstance(value, dict):
        for key in TEXT_COLUMNS:
            if value.get(key) is not None:
                return str(value[key])
        return " ".join(str(v) for v in value.values() if isinstance(v, str | int | float))
    if isinstance(value, list | tuple):
        return " ".join(str(v) for v in value if isinstance(v, str | int | float))
    return str(value)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def next_version(spark: SparkSession, folder: str, stem: str = "submission_hybrid_v") -> int:
    """One more than the largest number after ``stem`` in the folder's names; 1 in an empty or missing folder."""
    where, system = _file_system(spark, folder)
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return 1 + max([int(m[1]) for n in names if (m := re.match(rf"{re.escape(stem)}(\d+)", n))], default=0)


def write_submission(rows: DataFrame, path: str) -> None:
    """CSV with a header; arrays as JSON lists, as CSV has none."""
    flat = [F.to_json(c).alias(c) if k.startswith("array") else F.col(c) for c, k in rows.dtypes]
    rows.select(flat).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')


def write_versioned(rows: DataFrame, folder: str, stem: str = "submission_hybrid_v") -> str:
    path = f"{folder.rstrip('/')}/{stem}{next_version(rows.sparkSession, folder, stem)}.csv"
    write_submission(rows, path)
    return path


def fingerprint(df: DataFrame) -> str:
    """What a table holds, in one value that does not depend on row order."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{row[0]}-{row[1]}"


def cached(build, name: str, params: dict, inputs: list[DataFrame], folder: str) -> DataFrame:
    """The table ``build()`` makes, kept as Parquet under a key of its parameters and of what its inputs hold."""
    spark = inputs[0].sparkSession
    said = json.dumps(params, sort_keys=True, default=str) + "|".join(map(fingerprint, inputs))
    final = f"{folder.rstrip('/')}/{name}-{hashlib.sha256(said.encode()).hexdigest()[:32]}"
    done, system = _file_system(spark, f"{final}/_SUCCESS")
    if not system.exists(done):
        build().write.mode("overwrite").parquet(final)
    return spark.read.parquet(final)


def log_trial(spark: SparkSession, folder: str, number: int, params: dict, value: float) -> None:
    """Append one search trial; a resumed search reads the folder with ``spark.read.json``."""
    line = json.dumps({"number": number, "value": value, "params": params}, sort_keys=True)
    spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("append").text(folder)
