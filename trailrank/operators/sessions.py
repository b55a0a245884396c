"""Session-session collaborative filtering: IUF-weighted cosine neighbours vote for their items."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailrank.functions.schema import action_weight, last_k
from trailrank.functions.scores import is_signal
from trailrank.operators.itemitem import fill_priors


@dataclass(frozen=True)
class Params:
    iuf_exponent: float = 1.40
    neighbor_item_recency_decay: float = 0.94
    query_recency_decay: float = 0.80
    sim_power_gamma: float = 0.87
    top_sessions: int = 83
    w_apply: float = 1.59
    w_view: float = 1.53
    last_n: int = 8
    use_sequence_boost: bool = False
    neighbor_position_boost: float = 1.32
    neighbor_target_boost: float = 1.27


def truncated(interactions: DataFrame, p: Params = Params()) -> DataFrame:
    return last_k(interactions, p.last_n)


def iuf(history: DataFrame, p: Params = Params()) -> DataFrame:
    """(job_id, df, iuf): ln((1 + sessions) / (1 + df) + 1) to a power."""
    total = history.where("session_id IS NOT NULL").select("session_id").distinct().agg(F.count(F.lit(1)).alias("_n"))
    df = history.select("session_id", "job_id").distinct().groupBy("job_id").agg(F.count("session_id").alias("df"))  # counted before the shuffle by job
    return df.crossJoin(F.broadcast(total)).select("job_id", "df", F.pow(F.log((1 + F.col("_n")) / (1 + F.col("df")) + 1), F.lit(p.iuf_exponent)).alias("iuf"))


def vectors(history: DataFrame, weights: DataFrame) -> DataFrame:
    """(session_id, job_id, w): each session's distinct known jobs, IUF-weighted, unit length.

    Squares are summed in the order of the jobs, so sessions with the same jobs get the same vector.
    """
    rows = history.select("session_id", "job_id").distinct().join(weights.select("job_id", "iuf"), "job_id")
    packed = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("job_id", "iuf"))).alias("cells"))
    norm = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["iuf"] * c["iuf"]))
    cells = packed.select("session_id", norm.alias("norm"), F.explode("cells").alias("c"))
    return cells.select("session_id", F.col("c.job_id").alias("job_id"), F.when(F.col("norm") > 0, F.col("c.iuf") / F.col("norm")).otherwise(0.0).alias("w"))


#: Blocks that query classes are dealt into, and classes and queries that meet in one step of a task.
BLOCKS, STEP, ASK = 64, 8192, 512


def _classes(rows: DataFrame) -> DataFrame:
    """(session_id, class, at, size, cells): sessions with the same vector are one class, named by its smallest session and numbered from it."""
    packed = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("job_id", "w"))).alias("cells"))
    same = Window.partitionBy("cells")
    at = F.row_number().over(same.orderBy("session_id"))
    return packed.select("session_id", F.min("session_id").over(same).alias("class"), at.alias("at"), F.count(F.lit(1)).over(same).alias("size"), "cells")


def _flat(cells: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The row, job and weight of every cell."""
    cells = cells.combine_chunks()
    inner = cells.flatten()
    return np.repeat(np.arange(len(cells)), pc.list_value_length(cells).to_numpy(zero_copy_only=False)), inner.field("job_id"), inner.field("w").to_numpy(zero_copy_only=False)


def _postings(rows: np.ndarray, jobs: np.ndarray, w: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(jobs, kind="stable")
    jobs, starts = np.unique(jobs[order], return_index=True)
    return dict(zip(jobs.tolist(), zip(np.split(rows[order], starts[1:]), np.split(w[order], starts[1:]), strict=True), strict=True))


def _best(part: np.ndarray, place: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """The k first of each part by falling similarity, then by place."""
    order = np.lexsort((place, -sim, part))
    rank = np.arange(len(order)) - np.searchsorted(part[order], part[order])
    return order[rank < k]


def _near(k: int):
    schema = pa.schema([("class", pa.string()), ("near", pa.string()), ("sim", pa.float64())])

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        if not asked.num_rows or not blocks.num_rows:
            return schema.empty_table()
        stored = pa.Table.from_struct_array(blocks["rows"].combine_chunks().flatten())
        stored = stored.take(pc.sort_indices(stored["class"]))  # ties go to the smaller class
        size, names = stored["size"].to_numpy(), stored["class"].combine_chunks()
        row, job, w = _flat(stored["cells"])
        asks, ask_job, ask_w = _flat(asked["cells"])
        codes = pa.chunked_array([job, ask_job]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        job, ask_job = codes[: len(job)], codes[len(job) :]
        cuts = np.searchsorted(row, np.arange(0, stored.num_rows, STEP))
        steps = [_postings(r - n * STEP, j, x) for n, (r, j, x) in enumerate(zip(*(np.split(c, cuts[1:]) for c in (row, job, w)), strict=True))]
        out = []
        for start in range(0, asked.num_rows, ASK):
            mine = slice(*np.searchsorted(asks, [start, start + ASK]))
            posts = _postings(asks[mine] - start, ask_job[mine], ask_w[mine])
            found = []
            for n, step in enumerate(steps):
                sims = np.zeros((min(ASK, asked.num_rows - start), min(STEP, stored.num_rows - n * STEP)))
                for j, (a, x) in posts.items():
                    if j in step:
                        b, y = step[j]
                        sims[np.ix_(a, b)] += x[:, None] * y
                least = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.zeros(len(sims))
                part, place = np.nonzero((sims > 0) & (sims >= least[:, None] - 2e-9))
                sim = np.floor(sims[part, place] * 1e9 + 0.5) / 1e9
                part, place, sim = part[sim > 0], place[sim > 0], sim[sim > 0]
                kept = _best(part, place, sim, k)
                found.append((part[kept], place[kept] + n * STEP, sim[kept]))
            part, place, sim = (np.concatenate(c) for c in zip(*found, strict=True))
            kept = _best(part, place, sim, k)
            part, place, sim = part[kept], place[kept], sim[kept]
            # classes behind k sessions that are nearer give no neighbour
            before = np.cumsum(size[place]) - size[place]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            level = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (sim[1:] != sim[:-1])]) if len(part) else []
            nearer = np.repeat(before[level], np.diff(np.r_[level, len(part)])) - np.repeat(before[first], np.diff(np.r_[first, len(part)])) if len(part) else before
            kept = nearer < k
            out.append(pa.table([asked["class"].combine_chunks().take(pa.array(part[kept] + start)), names.take(pa.array(place[kept])), pa.array(sim[kept])], schema=schema))
        return pa.concat_tables(out)

    return run


def class_neighbors(queries: DataFrame, stored: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """``neighbors`` of one session of each class, and the classes' sessions (session_id, class).

    A query class meets the stored classes inside a task, which keeps the best: no
    pair of sessions is shuffled. The first ``top_sessions`` neighbours lie in as many
    first classes, ordered by similarity and smallest session. The work is the sum
    over jobs of query classes times stored classes.
    """
    k = p.top_sessions
    asked, kept = _classes(queries), _classes(stored)
    members = kept.where(F.col("at") <= k).select(F.col("class").alias("near"), F.col("session_id").alias("neighbor"))
    block = F.pmod(F.xxhash64("class"), F.lit(BLOCKS)).cast("int").alias("block")
    packed = kept.where("at = 1").select(block, F.struct("class", "size", "cells").alias("row")).groupBy("block").agg(F.collect_list("row").alias("rows"))
    copies = packed.select("rows", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    near = asked.where("at = 1").select("class", "cells", block).groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(_near(k), "class string, near string, sim double")
    order = Window.partitionBy("class").orderBy(F.col("sim").desc(), "neighbor")
    best = near.join(members, "near").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k)
    return best.select("class", "neighbor", "sim"), asked.select("session_id", "class")


def neighbors(queries: DataFrame, stored: DataFrame, p: Params = Params()) -> DataFrame:
    """(session_id, neighbor, sim): the ``top_sessions`` most alike with positive cosine; ties to the smaller id."""
    near, members = class_neighbors(queries, stored, p)
    return members.join(near, "class").select("session_id", "neighbor", "sim")


def neighbor_items(history: DataFrame, targets: DataFrame | None, p: Params = Params()) -> DataFrame:
    """(neighbor, job_id, v): what a neighbour votes for each of its items: truncated history, then its targets."""
    rows = history.select("session_id", "job_id", "action", "pos")
    if targets is not None:
        ends = history.groupBy("session_id").agg(F.count(F.lit(1)).alias("pos"))
        more = targets.join(ends, "session_id").select("session_id", "job_id", "action", F.col("pos").cast("long").alias("pos"))
        rows = rows.withColumn("pos", F.col("pos").cast("long")).unionByName(more)
    size = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("pos", "job_id")) - 1
    vote = action_weight(F.col("action"), p.w_view, p.w_apply) * F.pow(F.lit(p.neighbor_item_recency_decay), size - 1 - place)
    if p.use_sequence_boost:
        vote = vote * F.when(place >= F.greatest(F.lit(0), size - 2), F.lit(p.neighbor_position_boost)).otherwise(1.0) * F.when(place == size - 1, F.lit(p.neighbor_target_boost)).otherwise(1.0)
    return rows.select(F.col("session_id").alias("neighbor"), "job_id", vote.alias("v")).groupBy("neighbor", "job_id").agg(F.sum("v").alias("v"))


def personal_scores(near: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """(session_id, job_id, score): votes times similarity to a power, over the session's largest."""
    votes = near.join(items, "neighbor").groupBy("session_id", "job_id").agg(F.sum(F.pow("sim", F.lit(p.sim_power_gamma)) * F.col("v")).alias("raw"))
    score = F.col("raw") / F.max("raw").over(Window.partitionBy("session_id"))
    return votes.select("session_id", "job_id", score.alias("score")).where(is_signal(F.col("score")))


def action_priors(interactions: DataFrame, targets: DataFrame | None, p, all_jobs: DataFrame | None = None) -> DataFrame:
    """(job_id, prior, fallback): (action weight + 1) / (all + n), and 1 over the same."""
    weight = action_weight(F.col("action"), p.w_view, p.w_apply).alias("w")
    rows = interactions.select("job_id", weight)
    if targets is not None:
        rows = rows.unionByName(targets.select("job_id", weight))
    if all_jobs is not None:
        rows = rows.unionByName(all_jobs.select("job_id", F.lit(0.0).alias("w")))
    sums = rows.groupBy("job_id").agg(F.sum("w").alias("raw"))
    total = sums.agg((F.sum("raw") + F.count(F.lit(1))).alias("_all"))
    return sums.crossJoin(F.broadcast(total)).select("job_id", ((F.col("raw") + 1) / F.col("_all")).alias("prior"), (1 / F.col("_all")).alias("fallback"))


def predict(histories: DataFrame, sessions: DataFrame, candidates: DataFrame, interactions: DataFrame, targets: DataFrame | None, p: Params = Params()) -> DataFrame:
    """Scores for every candidate. A query keeps its last ``last_n`` known events; stored sessions are cut alike."""
    stored = truncated(interactions, p)
    weights = iuf(stored, p)
    known = histories.join(weights.select("job_id"), "job_id", "left_semi")
    near, members = class_neighbors(vectors(last_k(known, p.last_n), weights), vectors(stored, weights), p)
    votes = personal_scores(near.withColumnRenamed("class", "session_id"), neighbor_items(stored, targets, p), p)
    personal = members.join(votes.withColumnRenamed("session_id", "class"), "class").select("session_id", "job_id", "score")
    return fill_priors(personal, sessions, candidates, action_priors(interactions, targets, p))
