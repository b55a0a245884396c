"""Item-item collaborative filtering: Tversky or cosine similarity over decayed session weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailrank.functions.schema import action_weight, dealt, last_k
from trailrank.functions.scores import is_signal


@dataclass(frozen=True)
class Params:
    variant: str = "II_TVERSKY"
    last_n: int = 10
    neighborhood_size: int = 100
    query_recency_decay: float = 0.74
    shrinkage: float = 17.0
    train_recency_decay: float = 0.89
    tversky_alpha: float = 0.29
    tversky_beta: float = 0.03
    w_apply: float = 1.63
    w_view: float = 1.24
    include_self_transition: bool = False


def session_item_weights(interactions: DataFrame, targets: DataFrame | None, p: Params = Params()) -> DataFrame:
    """(session_id, job_id, w): decayed action weights; every target adds max(w_apply, 1)."""
    size = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    weight = action_weight(F.col("action"), p.w_view, p.w_apply) * F.pow(F.lit(p.train_recency_decay), size - 1 - F.col("pos"))
    rows = interactions.select("session_id", "job_id", weight.alias("w"))
    if targets is not None:
        rows = rows.unionByName(targets.select("session_id", "job_id", F.lit(max(p.w_apply, 1.0)).alias("w")))
    return rows.groupBy("session_id", "job_id").agg(F.sum("w").alias("w"))


def similarity(x: DataFrame, p: Params = Params()) -> DataFrame:
    """(job_i, job_j, sim): the ``neighborhood_size`` best of each job.

    A job itself takes a place among its best and is then left out, unless
    ``include_self_transition``. Pairs come from one equi-join on the session, so
    the work is the sum of squared session lengths. Jobs bring their sums along, and
    a pair is added up in one direction only; it is shuffled for its sum and, in both directions, for the best.
    """
    if p.neighborhood_size <= 0:
        return x.sparkSession.createDataFrame([], "job_i string, job_j string, sim double")
    if p.variant == "II_TVERSKY":
        pops = x.groupBy("job_id").agg(F.sum("w").alias("pop"))
    elif p.variant == "II_COSINE":
        pops = x.groupBy("job_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("pop"))
    else:
        raise ValueError(f"unknown variant {p.variant!r}")
    rows = dealt(x.select("session_id", "job_id", "w").join(pops, "job_id"), "session_id", like=x)
    side = lambda n: rows.select("session_id", F.col("job_id").alias(f"job_{n}"), F.col("w").alias(f"w{n}"), F.col("pop").alias(f"pop_{n}"))
    half = side("i").join(side("j"), "session_id").where("job_i <= job_j").groupBy("job_i", "job_j").agg(F.sum(F.col("wi") * F.col("wj")).alias("common"), F.max("pop_i").alias("pop_i"), F.max("pop_j").alias("pop_j"))
    there, back = F.struct("job_i", "job_j", "pop_i", "pop_j"), F.struct(F.col("job_j").alias("job_i"), F.col("job_i").alias("job_j"), F.col("pop_j").alias("pop_i"), F.col("pop_i").alias("pop_j"))
    both = half.select("common", F.explode(F.when(F.col("job_i") == F.col("job_j"), F.array(there)).otherwise(F.array(there, back))).alias("p")).select("p.*", "common")
    common = F.col("common")
    if p.variant == "II_TVERSKY":
        under = common * (1 - p.tversky_alpha - p.tversky_beta) + p.tversky_alpha * F.col("pop_i") + p.tversky_beta * F.col("pop_j")
        sim = common / F.when(under <= 1e-12, F.lit(1.0)).otherwise(under)
    else:
        under = F.col("pop_i") * F.col("pop_j")
        sim = common / F.when(under <= 0, F.lit(1.0)).otherwise(under)
    scored = both.withColumn("sim", F.round(sim * common / (common + p.shrinkage), 9))
    order = Window.partitionBy("job_i").orderBy(F.col("sim").desc(), "job_j")
    best = scored.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= p.neighborhood_size)
    return (best if p.include_self_transition else best.where("job_i <> job_j")).where("sim > 0").select("job_i", "job_j", "sim")


def priors(x: DataFrame, all_jobs: DataFrame | None = None, p: Params = Params()) -> DataFrame:
    """(job_id, prior, fallback): (weight + s) / (all + s n) with s = max(1, shrinkage), and s / the same."""
    s = max(1.0, p.shrinkage)
    raw = x.select("job_id", "w")
    if all_jobs is not None:
        raw = raw.unionByName(all_jobs.select("job_id", F.lit(0.0).alias("w")))
    sums = raw.groupBy("job_id").agg(F.sum("w").alias("raw"))
    total = sums.agg((F.sum("raw") + s * F.count(F.lit(1))).alias("_all"))
    return sums.crossJoin(F.broadcast(total)).select("job_id", ((F.col("raw") + s) / F.col("_all")).alias("prior"), (F.lit(s) / F.col("_all")).alias("fallback"))


def query(histories: DataFrame, known: DataFrame, p: Params = Params()) -> DataFrame:
    """(session_id, job_id, w): the last ``last_n`` events weighted by action and recency; unknown jobs keep their places."""
    recent = last_k(histories, p.last_n)
    size = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    weight = action_weight(F.col("action"), p.w_view, p.w_apply) * F.pow(F.lit(p.query_recency_decay), size - 1 - F.col("pos"))
    weighed = recent.select("session_id", "job_id", weight.alias("w"))
    return weighed.join(known.select("job_id").distinct(), "job_id", "left_semi").groupBy("session_id", "job_id").agg(F.sum("w").alias("w"))


def personal_scores(q: DataFrame, sim: DataFrame) -> DataFrame:
    """(session_id, job_id, score): positive sums of query weight times similarity."""
    rows = q.join(sim, q["job_id"] == sim["job_i"]).groupBy("session_id", F.col("job_j").alias("job_id")).agg(F.sum(F.col("w") * F.col("sim")).alias("score"))
    return rows.where(is_signal(F.col("score")))


def fill_priors(personal: DataFrame, sessions: DataFrame, candidates: DataFrame, prior: DataFrame, at_least_fallback: DataFrame | None = None) -> DataFrame:
    """Every candidate of every session: its personal score, else its prior, else the fallback.

    For the sessions in ``at_least_fallback`` a prior counts at least the fallback.
    """
    rest = prior.agg(F.max("fallback").alias("_rest"))
    cands = candidates.select("job_id").distinct().join(prior.select("job_id", "prior"), "job_id", "left").crossJoin(F.broadcast(rest))
    grid = sessions.select("session_id").distinct().crossJoin(cands)
    rows = grid.join(personal, ["session_id", "job_id"], "left")
    base = F.coalesce("prior", "_rest")
    if at_least_fallback is not None:
        rows = rows.join(at_least_fallback.select("session_id").distinct().withColumn("_q", F.lit(True)), "session_id", "left")
        base = F.when(F.col("_q") & F.col("prior").isNotNull(), F.greatest("prior", "_rest")).otherwise(base)
    return rows.select("session_id", "job_id", F.coalesce("score", base, F.lit(0.0)).alias("score"))


def predict(histories: DataFrame, sessions: DataFrame, candidates: DataFrame, x: DataFrame, sim: DataFrame, p: Params = Params()) -> DataFrame:
    q = query(histories, x, p)
    return fill_priors(personal_scores(q, sim), sessions, candidates, priors(x, p=p), q)


#: Neighbours of a job that the size of an unfolded query is guessed from; only the number of tasks depends on it.
SPREAD = 60


def recommend(histories: DataFrame, sessions: DataFrame, x: DataFrame, sim: DataFrame, k: int = 10, p: Params = Params()) -> DataFrame:
    """(session_id, rank, job_id, score): the k best unseen jobs without scoring every candidate.

    Jobs without a personal score keep the global order of their priors, so only
    the first of it can be among a session's k best: k more than it has seen or
    scored. A job's neighbours are shuffled as one list a query row, and unfolded
    and added up in the session's task.
    """
    seen = histories.select("session_id", "job_id").distinct()
    longest = seen.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    first = (F.col("prior").desc(), F.col("job_id"))
    head = priors(x, p=p).orderBy(*first).limit(longest + max(1, p.last_n) * max(0, p.neighborhood_size) + k).withColumn("place", F.row_number().over(Window.orderBy(*first)))
    head = head.select("job_id", F.greatest("prior", "fallback").alias("score"), "place")
    lists = sim.groupBy(F.col("job_i").alias("job_id")).agg(F.collect_list(F.struct("job_j", "sim")).alias("cells")).select("job_id", F.col("cells.job_j").alias("jobs"), F.col("cells.sim").alias("sims"))
    met = query(histories, x, p).join(lists, "job_id").select("session_id", "w", "jobs", "sims")
    # What was seen comes as lists of one without a similarity.
    own = seen.select("session_id", F.lit(None).cast("double").alias("w"), F.array("job_id").alias("jobs"), F.array(F.lit(None).cast("double")).alias("sims"))
    rows = dealt(met.unionByName(own), "session_id", like=histories, times=SPREAD)
    rows = rows.select("session_id", "w", F.explode(F.arrays_zip("jobs", "sims")).alias("c")).select("session_id", F.col("c.jobs").alias("job_id"), (F.col("w") * F.col("c.sims")).alias("part"))
    sums = rows.groupBy("session_id", "job_id").agg(F.sum("part").alias("score"), F.max(F.col("part").isNull()).alias("seen")).where(F.col("seen") | is_signal(F.col("score")))
    sums = sums.join(F.broadcast(head.select("job_id", "place")), "job_id", "left")
    order = Window.partitionBy("session_id").orderBy("seen", F.col("score").desc(), "job_id")
    kept = sums.withColumn("_at", F.row_number().over(order)).withColumn("_best", ~F.col("seen") & (F.col("_at") <= k)).where(F.col("_best") | F.col("place").isNotNull())
    below = F.struct((-F.col("score")).alias("below"), "job_id")
    own = kept.groupBy("session_id").agg(F.collect_list(F.when(F.col("_best"), below)).alias("best"), F.collect_list("place").alias("barred"))
    asked = sessions.select("session_id").distinct().join(own, "session_id", "left").withColumn("barred", F.coalesce("barred", F.array().cast("array<int>")))
    # A session with n covered jobs in the head finds k others among its first n + k places, and meets those only.
    asked = asked.select("session_id", "best", "barred", F.explode(F.sequence(F.lit(1), F.size("barred") + k)).alias("place")).join(F.broadcast(head.select("job_id", (-F.col("score")).alias("below"), "place")), "place", "left")
    free = F.when(F.col("job_id").isNotNull() & ~F.array_contains("barred", F.col("place")), F.struct("below", "job_id"))
    asked = asked.groupBy("session_id").agg(F.first("best").alias("best"), F.slice(F.array_sort(F.collect_list(free)), 1, k).alias("rest"))
    merged = F.slice(F.array_sort(F.concat(F.coalesce("best", F.array().cast("array<struct<below:double,job_id:string>>")), "rest")), 1, k)
    ranked = asked.select("session_id", F.posexplode(merged).alias("rank", "c"))
    return ranked.select("session_id", F.col("c.job_id").alias("job_id"), (-F.col("c.below")).alias("score"), (F.col("rank") + 1).alias("rank"))
