"""Transitions between adjacent jobs, and the rankers built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailrank.functions.schema import by_session, dealt, last_k
from trailrank.functions.scores import top_k


def transitions(interactions: DataFrame) -> DataFrame:
    """(from_job, to_job, n, prob): adjacent pairs, and their share of all that leave ``from_job``."""
    pairs = interactions.select(F.col("job_id").alias("from_job"), F.lead("job_id").over(by_session()).alias("to_job")).where("to_job IS NOT NULL")
    counts = dealt(pairs, "from_job", like=interactions).groupBy("from_job", "to_job").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("from_job")))


def markov_map(trans: DataFrame, top_n: int = 50) -> DataFrame:
    """The ``top_n`` likeliest transitions of each job, with rank; ties to the smaller job."""
    order = Window.partitionBy("from_job").orderBy(F.col("prob").desc(), "to_job")
    return trans.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def popular_jobs(trans: DataFrame, k: int = 10) -> DataFrame:
    """(job_id, n, rank): the jobs that most transitions enter."""
    top = trans.groupBy(F.col("to_job").alias("job_id")).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "job_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "job_id")))


def popular_next(interactions: DataFrame, k: int = 10) -> DataFrame:
    """``popular_jobs`` of the interactions' transitions; a job's entries are counted where they are read, no pair is shuffled."""
    pairs = interactions.select(F.lead("job_id").over(by_session()).alias("to_job")).where("to_job IS NOT NULL")
    return popular_jobs(pairs.groupBy("to_job").agg(F.count(F.lit(1)).alias("n")), k)


def job_share(interactions: DataFrame) -> DataFrame:
    """(job_id, share): a job's part of all events."""
    counts = interactions.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("job_id", (F.col("n") / F.col("_all")).alias("share"))


def last_jobs(histories: DataFrame) -> DataFrame:
    """(session_id, last_job)."""
    return histories.groupBy("session_id").agg(F.max_by("job_id", "pos").alias("last_job"))


def fallback_popular(ranked: DataFrame, sessions: DataFrame, popular: DataFrame) -> DataFrame:
    """Ranked rows, and for sessions without any the popular list."""
    cold = sessions.select("session_id").join(ranked.select("session_id").distinct(), "session_id", "left_anti")
    filled = cold.crossJoin(F.broadcast(popular.select("rank", "job_id")))
    return ranked.select("session_id", "rank", "job_id").unionByName(filled)


def recommend_last(histories: DataFrame, sessions: DataFrame, trans: DataFrame, popular: DataFrame, k: int = 10) -> DataFrame:
    """(session_id, rank, job_id): the likeliest next jobs of the last one; the popular list for what is unknown."""
    best = markov_map(trans, k).select("from_job", "rank", F.col("to_job").alias("job_id"))
    ranked = last_jobs(histories).join(best, F.col("last_job") == F.col("from_job")).select("session_id", "rank", "job_id")
    return fallback_popular(ranked, sessions, popular)


def session_ends(interactions: DataFrame) -> DataFrame:
    """(session_id, job_id, action, last_job, last_action): each session's last event, its target, and the one before, null without it."""
    order, next_pos = by_session(), F.lead("pos").over(by_session())
    ends = interactions.select("session_id", "job_id", "action", F.lag("job_id").over(order).alias("last_job"), F.lag("action").over(order).alias("last_action"), next_pos.alias("_next"))
    return ends.where("_next IS NULL").drop("_next")


def last_lists(ends: DataFrame, trans: DataFrame, popular: DataFrame, k: int = 10) -> DataFrame:
    """``ends`` with ``jobs``: as ``recommend_last``, but one row a session with its list, null where there is none.

    Only the session's row meets its last job's list, so nothing is shuffled for each place.
    """
    best = markov_map(trans, k).groupBy("from_job").agg(F.array_sort(F.collect_list(F.struct("rank", "to_job"))).alias("best")).select("from_job", F.col("best.to_job").alias("best"))
    none = popular.agg(F.array_sort(F.collect_list(F.struct("rank", "job_id"))).alias("known")).select(F.when(F.size("known") > 0, F.col("known.job_id")).alias("known"))
    rows = ends.join(best, ends["last_job"] == best["from_job"], "left").crossJoin(F.broadcast(none))
    return rows.select(*ends.columns, F.coalesce("best", "known").alias("jobs"))


def listed(lists: DataFrame) -> DataFrame:
    """(session_id, rank, job_id): the lists' places."""
    return lists.select("session_id", F.posexplode("jobs").alias("rank", "job_id")).withColumn("rank", F.col("rank") + 1)


#: Transitions of a job that the size of an expanded history is guessed from; only the number of tasks depends on it.
SPREAD = 40


def _expanded(weighted: DataFrame, trans: DataFrame) -> DataFrame:
    """Rows with ``session_id`` and ``from_job``, one for each transition of the job, with its ``job_id`` and ``prob``.

    A job's transitions are shuffled as one list a row, and unfolded in the session's task.
    """
    lists = trans.groupBy("from_job").agg(F.array_sort(F.collect_list(F.struct("to_job", "prob"))).alias("cells")).select("from_job", F.col("cells.to_job").alias("jobs"), F.col("cells.prob").alias("probs"))
    met = weighted.join(lists, "from_job").drop("from_job")
    met = dealt(met, "session_id", like=weighted, times=SPREAD)
    kept = [c for c in met.columns if c not in ("jobs", "probs")]
    return met.select(*kept, F.posexplode("jobs").alias("_at", "job_id"), "probs").select(*kept, "job_id", F.col("probs")[F.col("_at")].alias("prob"))


def session_scores(histories: DataFrame, trans: DataFrame, last: int | None = None, recency: bool = False) -> DataFrame:
    """(session_id, job_id, score): transition probabilities summed over the history, linearly weighted by recency if asked."""
    rows = last_k(histories, last) if last else histories
    size = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    weight = F.row_number().over(by_session()) / size if recency else F.lit(1.0)
    weighted = rows.withColumn("w", weight).select("session_id", F.col("job_id").alias("from_job"), "w")
    return _expanded(weighted, trans).groupBy("session_id", "job_id").agg(F.round(F.sum(F.col("w") * F.col("prob")), 9).alias("score"))


def recommend_session(histories: DataFrame, sessions: DataFrame, trans: DataFrame, popular: DataFrame, k: int = 10, last: int | None = None, recency: bool = False) -> DataFrame:
    ranked = top_k(session_scores(histories, trans, last, recency), k)
    return fallback_popular(ranked, sessions, popular)


def cold_rate(histories: DataFrame, trans: DataFrame) -> DataFrame:
    """One row (sessions, cold, cold_rate): sessions whose last job starts no transition."""
    known = trans.select(F.col("from_job").alias("last_job")).distinct().withColumn("known", F.lit(1))
    cold = F.col("known").isNull()
    both = last_jobs(histories).join(known, "last_job", "left")
    return both.agg(F.count(F.lit(1)).alias("sessions"), F.sum(cold.cast("long")).alias("cold"), F.round(F.avg(cold.cast("double")), 6).alias("cold_rate"))


def k_sweep(histories: DataFrame, truth: DataFrame, trans: DataFrame, popular: DataFrame, ks=(1, 3, 5, 7, 10), top: int = 10) -> DataFrame:
    """(k, sessions, mrr) of the recency ranker for each history length, in one pass over all lengths.

    As ``metrics.mrr`` of ``recommend_session`` for each length; a target's rank is the number of jobs before it and 1.
    """
    size, back = F.count(F.lit(1)).over(Window.partitionBy("session_id")), F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("pos").desc()))
    rows = histories.select("session_id", F.col("job_id").alias("from_job"), size.alias("size"), back.alias("back")).where(F.col("back") <= max(ks))
    kept = {k: F.least("size", F.lit(k)) for k in ks}
    weights = {k: F.when(F.col("back") <= k, (kept[k] - F.col("back") + 1) / kept[k]) for k in ks}
    sums = _expanded(rows, trans).groupBy("session_id", "job_id").agg(*[F.round(F.sum(weights[k] * F.col("prob")), 9).alias(f"s{k}") for k in ks])
    place = popular.where(F.col("rank") <= top).groupBy(F.col("job_id").cast("string").alias("_true")).agg(F.min("rank").alias("_place"))
    goal = truth.select("session_id", F.col("job_id").cast("string").alias("_true")).join(F.broadcast(place), "_true", "left")
    both, one = goal.join(sums, "session_id", "left"), Window.partitionBy("session_id", "_true")
    for k in ks:
        both = both.withColumn(f"t{k}", F.max(F.when(F.col("job_id").cast("string") == F.col("_true"), F.col(f"s{k}"))).over(one))
    before = {k: (F.col(f"s{k}") > F.col(f"t{k}")) | ((F.col(f"s{k}") == F.col(f"t{k}")) & (F.col("job_id") < F.col("_true"))) for k in ks}
    cells = [c for k in ks for c in (F.count(f"s{k}").alias(f"n{k}"), F.max(f"t{k}").alias(f"t{k}"), F.count(F.when(before[k], 1)).alias(f"b{k}"))]
    found = both.groupBy("session_id", "_true").agg(F.min("_place").alias("_place"), *cells)
    rank = {k: F.when(F.col(f"n{k}") == 0, F.col("_place")).when(F.col(f"t{k}").isNotNull() & (F.col(f"b{k}") < top), F.col(f"b{k}") + 1) for k in ks}
    hits = found.groupBy("session_id").agg(*[F.min(rank[k]).alias(f"r{k}") for k in ks])
    means = hits.agg(F.count(F.lit(1)).alias("sessions"), *[F.round(F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col(f"r{k}"), F.lit(0.0))), F.lit(0.0)), 6).alias(f"m{k}") for k in ks])
    return means.select("sessions", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("mrr")) for k in ks])).alias("x")).select("x.k", "sessions", "x.mrr")


def _packed(table: DataFrame, key: str, job: str, score) -> DataFrame:
    """(last_job, cells): one row a job, its list of (below, job_id), the best first; ``below`` is the score with its sign turned."""
    return table.groupBy(F.col(key).alias("last_job")).agg(F.array_sort(F.collect_list(F.struct((-score).alias("below"), F.col(job).alias("job_id")))).alias("cells"))


def _without(cells, jobs):
    return F.filter(cells, lambda c: ~F.array_contains(jobs, c["job_id"]))


def _seen(histories: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, last_job, seen): one row a session of ``sessions``."""
    own = histories.groupBy("session_id").agg(F.max_by("job_id", "pos").alias("last_job"), F.collect_set("job_id").alias("seen"))
    return sessions.select("session_id").distinct().join(own, "session_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))


def _head(popularity: DataFrame, histories: DataFrame, beyond: int) -> DataFrame:
    """One row (head): as many of the popular jobs, in order, as the longest history and ``beyond``.

    A session with n barred jobs finds k others among the first n + k places, so it looks at those only.
    """
    longest = histories.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    first = popularity.select("job_id", "share").orderBy(F.col("share").desc(), "job_id").limit(longest + beyond)
    return first.agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("below"), "job_id"))).alias("head"))


def _unseen(barred, k: int):
    """The first k popular jobs that are not in the array ``barred``."""
    return F.slice(_without(F.slice("head", F.lit(1), F.size(barred) + k), barred), 1, k)


def hybrid_tiers(histories: DataFrame, sessions: DataFrame, chain: DataFrame, similar: DataFrame | None, popularity: DataFrame, k: int = 10, sim_weight: float = 0.8, pop_weight: float = 0.1, pop_cap: int = 200, gate: int | None = None) -> DataFrame:
    """(session_id, rank, job_id, score) of the three-tier hybrid.

    Unseen next jobs of the last one score their probability. Sessions with fewer
    than k of them gain the last job's text neighbours at ``sim_weight`` times
    their similarity (the larger score of a job counts); those still short gain
    popular jobs, in order, at ``pop_weight`` times their share until ``pop_cap``
    candidates are in. ``gate`` is the number of candidates that counts as enough
    (k by default). ``chain`` is (from_job, to_job, prob), ``similar`` (src,
    dst, sim) or None, ``popularity`` (job_id, share). A session is one row with its
    lists; only that row is shuffled.
    """
    enough = gate or k
    none = F.array().cast("array<struct<below:double,job_id:string>>")
    rows = _seen(histories, sessions).join(_packed(chain, "from_job", "to_job", F.col("prob")), "last_job", "left")
    rows = rows.select("session_id", "last_job", "seen", _without(F.coalesce("cells", none), F.col("seen")).alias("got"))
    if similar is not None:
        rows = rows.join(_packed(similar, "src", "dst", F.lit(sim_weight) * F.col("sim")), "last_job", "left")
        near = F.when(F.size("got") < enough, _without(F.coalesce("cells", none), F.col("seen"))).otherwise(none)
        rows = rows.select("session_id", "seen", F.array_sort(F.concat("got", near)).alias("got"))
        rows = rows.withColumn("got", F.filter("got", lambda c, n: F.array_position(F.col("got.job_id"), c["job_id"]) == n + 1))  # a job's best score comes first
    # popular jobs come in one global order, so k of them unseen are all that can reach the k best
    rows = rows.crossJoin(F.broadcast(_head(popularity, histories, enough + k)))
    rows = rows.withColumn("barred", F.array_union("seen", F.col("got.job_id")))
    room = F.greatest(F.least(F.lit(k), F.lit(pop_cap) - F.size("got")), F.lit(0))
    pops = F.transform(F.slice(_unseen(F.col("barred"), k), F.lit(1), room), lambda c: F.struct((F.lit(pop_weight) * c["below"]).alias("below"), c["job_id"].alias("job_id")))
    best = F.slice(F.array_sort(F.concat("got", F.when(F.size("got") < enough, pops).otherwise(none))), 1, k)
    ranked = rows.select("session_id", F.posexplode(best).alias("rank", "c"))
    return ranked.select("session_id", (F.col("rank") + 1).alias("rank"), F.col("c.job_id").alias("job_id"), (-F.col("c.below")).alias("score"))


def text_only(histories: DataFrame, similar: DataFrame, k: int = 10) -> DataFrame:
    """(session_id, rank, job_id): unseen text neighbours of the last job, at most k, maybe none."""
    seen = histories.select("session_id", "job_id").distinct()
    near = last_jobs(histories).join(similar, F.col("last_job") == F.col("src")).select("session_id", F.col("dst").alias("job_id"), F.col("sim").alias("score"))
    return top_k(near.join(seen, ["session_id", "job_id"], "left_anti"), k).select("session_id", "rank", "job_id")


def pad(ranked: DataFrame, sessions: DataFrame, popularity: DataFrame, histories: DataFrame, k: int = 10) -> DataFrame:
    """(session_id, rank, job_id): ranked rows, then popular unseen jobs, up to k."""
    none = F.array().cast("array<struct<rank:bigint,job_id:string>>")
    lists = ranked.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "job_id"))).alias("have"))
    asked = _seen(histories, sessions).withColumn("_asked", F.lit(True)).join(lists, "session_id", "full").crossJoin(F.broadcast(_head(popularity, histories, 2 * k)))
    asked = asked.withColumn("have", F.coalesce("have", none)).withColumn("barred", F.array_union(F.coalesce("seen", F.array().cast("array<string>")), F.col("have.job_id")))
    more = F.transform(F.slice(_unseen(F.col("barred"), k), F.lit(1), F.greatest(k - F.size("have"), F.lit(0))), lambda c, n: F.struct((F.size("have") + n + 1).cast("long").alias("rank"), c["job_id"].alias("job_id")))
    full = F.concat("have", F.when(F.col("_asked"), more).otherwise(none))
    return asked.select("session_id", F.explode(full).alias("c")).select("session_id", "c.rank", "c.job_id")
