"""Canonical interaction tables: validation and normalisation.

Interactions are (session_id, job_id, action, pos, session_ord): order is data
here, so ``pos`` counts within a session from 0 and ``session_ord`` orders the
sessions; nothing depends on the order of rows in a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REQUIRED = ("session_id", "job_id", "action")
VIEW, APPLY = "view", "apply"


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """TypeError for what is no DataFrame, ValueError for missing columns."""
    if not isinstance(df, DataFrame):
        raise TypeError("a Spark DataFrame is needed")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clean_action(action: Column) -> Column:
    """Trimmed of any white space and lower-cased."""
    return F.lower(F.regexp_replace(action, r"(?U)^\s+|\s+$", ""))


def binary_action(action: Column) -> Column:
    """``apply``, or ``view`` for everything else."""
    return F.when(clean_action(action) == APPLY, F.lit(APPLY)).otherwise(F.lit(VIEW))


def action_code(action: Column, base: int = 0) -> Column:
    """view and unknown: ``base``; apply: ``base`` + 1."""
    return F.when(action == APPLY, F.lit(base + 1)).otherwise(F.lit(base))


def action_weight(action: Column, w_view: float, w_apply: float) -> Column:
    return F.when(action == APPLY, F.lit(float(w_apply))).otherwise(F.lit(float(w_view)))


def by_session() -> Window:
    return Window.partitionBy("session_id").orderBy("pos")


#: Guessed bytes of a table that a task of a shuffle takes.
TASK_BYTES = 8 << 20


def dealt(rows: DataFrame, *keys: str, like: DataFrame | None = None, times: float = 1.0) -> DataFrame:
    """The rows, those of equal keys in one task; the tasks grow in number with the input, so none of them holds more for it.

    The size is Spark's guess for ``like`` (``rows`` itself by default), ``times`` as much. What the session's
    shuffle partitions can take is left to Spark.
    """
    size = int(str((like or rows)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = -(-int(size * times) // TASK_BYTES) if size < 1 << 45 else 0  # more is no guess: rows from Python, or a product of joins
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


def normalize(interactions: DataFrame | None) -> DataFrame:
    """Required columns only, rows with a null dropped, ids as strings, clean actions, positions closed up per session.

    ``pos`` must order each session's rows; ``session_ord`` is kept if present. None gives an empty table.
    """
    if interactions is None:
        return SparkSession.active().createDataFrame([], "session_id string, job_id string, action string, pos long")
    require(interactions, (*REQUIRED, "pos"))
    extra = ["session_ord"] if "session_ord" in interactions.columns else []
    rows = interactions.select(*REQUIRED, "pos", *extra).na.drop(subset=list(REQUIRED))
    rows = rows.select(F.col("session_id").cast("string").alias("session_id"), F.col("job_id").cast("string").alias("job_id"), clean_action(F.col("action")).alias("action"), "pos", *extra)
    return rows.withColumn("pos", (F.row_number().over(by_session()) - 1).cast("long"))


def normalize_targets(targets: DataFrame) -> DataFrame:
    """(session_id, job_id, action); a missing action column means ``view``."""
    require(targets, ("session_id", "job_id"))
    rows = targets if "action" in targets.columns else targets.withColumn("action", F.lit(VIEW))
    rows = rows.select(*REQUIRED).na.drop()
    return rows.select(F.col("session_id").cast("string").alias("session_id"), F.col("job_id").cast("string").alias("job_id"), clean_action(F.col("action")).alias("action"))


def split_last(interactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histories (all but each session's last event) and targets (the last events)."""
    last = F.max("pos").over(Window.partitionBy("session_id"))
    marked = interactions.withColumn("_last", last)
    return marked.where("pos < _last").drop("_last"), marked.where("pos = _last").select(*REQUIRED)


def last_k(interactions: DataFrame, k: int) -> DataFrame:
    """Each session's last ``k`` rows (at least one); positions are closed up."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("pos").desc()))
    kept = interactions.withColumn("_back", back).where(F.col("_back") <= max(1, int(k))).drop("_back")
    return kept.withColumn("pos", (F.row_number().over(by_session()) - 1).cast("long"))


def disjoint_sessions(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with session ids that ``train`` cannot have: moved past train's largest if all ids of both are numbers, else with a prefix."""
    number = F.expr("try_cast(session_id AS BIGINT)")
    odd = F.coalesce(F.max(number.isNull() & F.col("session_id").isNotNull()), F.lit(False))
    top = train.agg(F.max(number).alias("_top"), odd.alias("_odd")).crossJoin(test.agg(odd.alias("_odd_too")))  # one row
    numbers = F.col("_top").isNotNull() & ~F.col("_odd") & ~F.col("_odd_too")
    moved = F.when(numbers, (number + F.col("_top") + 1).cast("string")).otherwise(F.concat(F.lit("test_"), F.col("session_id")))
    return test.crossJoin(F.broadcast(top)).withColumn("session_id", moved).drop("_top", "_odd", "_odd_too")


def union_logs(train: DataFrame, targets: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows, then their targets at the end of their sessions, and test rows of disjoint sessions."""
    columns = [*REQUIRED, "pos"]
    lengths = train.groupBy("session_id").agg(F.count(F.lit(1)).alias("pos"))
    ends = targets.join(lengths, "session_id", "left").withColumn("pos", F.coalesce("pos", F.lit(0)).cast("long"))
    return train.select(columns).unionByName(ends.select(columns)).unionByName(disjoint_sessions(train, test).select(columns))


def vocabulary(*tables: DataFrame) -> DataFrame:
    """(job_id, ord): the distinct jobs of the tables, those of earlier tables first, then by first appearance.

    A table may have a column ``ord``; without it the job id orders.
    """
    tiers = [t.select(F.col("job_id").cast("string").alias("job_id"), F.lit(n).alias("tier"), (F.col("ord") if "ord" in t.columns else F.lit(0)).cast("long").alias("at")) for n, t in enumerate(tables)]
    rows = tiers[0]
    for t in tiers[1:]:
        rows = rows.unionByName(t)
    first = rows.where("job_id IS NOT NULL").groupBy("job_id").agg(F.min(F.struct("tier", "at", "job_id")).alias("first"))
    return first.select("job_id", F.col("first.tier").alias("tier"), F.col("first.at").alias("at"))


def as_int_if_possible(value: Column) -> Column:
    """A whole number's canonical digits, else the string as it is."""
    return F.coalesce(value.try_cast("bigint").cast("string"), value)


def valid_split(session_id: Column, tenths: int = 3) -> Column:
    """Whether a session is held out: by a hash of its id, alike on every engine."""
    return (F.conv(F.substring(F.md5(session_id), 1, 8), 16, 10).cast("long") % 10) < tenths
