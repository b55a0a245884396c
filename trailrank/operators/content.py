"""Content-based ranking: TF-IDF profiles of the history, lexical, dense, or blended."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailrank.functions.schema import action_weight
from trailrank.functions.scores import is_signal
from trailrank.functions.text import preprocess, tfidf
from trailrank.operators.itemitem import fill_priors
from trailrank.operators.sessions import action_priors


@dataclass(frozen=True)
class Params:
    variant: str = "LEXICAL_DENSE_BLEND"
    preprocess: str = "raw"
    pooling: str = "recency"
    w_view: float = 1.73
    w_apply: float = 2.55
    recency_decay: float = 0.62
    blend_alpha_lexical: float = 0.56
    min_df: int = 2
    max_df: float = 0.95
    max_features: int = 30000
    lsa_components: int = 256
    popularity_weight: float = 0.0


def item_texts(jobs: DataFrame, listings: DataFrame, p: Params = Params()) -> DataFrame:
    """(job_id, text) for every known job; jobs without a listing are empty documents."""
    rows = jobs.select("job_id").distinct().join(listings.select("job_id", "text"), "job_id", "left")
    return rows.select("job_id", preprocess(F.col("text"), p.preprocess).alias("text"))


def lexical_vectors(texts: DataFrame, p: Params = Params()) -> DataFrame:
    return tfidf(texts, p.min_df, p.max_df, p.max_features)


def history_weights(histories: DataFrame, p: Params = Params()) -> DataFrame:
    """(session_id, job_id, pos, hw): action weights, decayed for pooling ``recency`` and ``max_sim``, summing to 1."""
    size = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    raw = action_weight(F.col("action"), p.w_view, p.w_apply)
    if p.pooling in ("recency", "max_sim"):
        raw = raw * F.pow(F.lit(p.recency_decay), size - 1 - F.col("pos"))
    rows = histories.select("session_id", "job_id", "pos", raw.alias("raw"), size.alias("_n"))
    if p.pooling == "last_item":
        rows = rows.where(F.col("pos") == F.col("_n") - 1).withColumn("raw", F.lit(1.0))
    total = F.sum("raw").over(Window.partitionBy("session_id"))
    return rows.select("session_id", "job_id", "pos", F.when(total > 0, F.col("raw") / total).otherwise(F.lit(1.0) / F.col("_n")).alias("hw"))


def lexical_scores(histories: DataFrame, vectors: DataFrame, p: Params = Params(), candidates: DataFrame | None = None) -> DataFrame:
    """(session_id, job_id, score): profile times item vectors; for ``max_sim`` the best weighted similarity to a history item.

    Only ``candidates`` are scored, if given: terms of other items never meet a profile.
    """
    known = vectors.select("job_id").distinct()
    weights = history_weights(histories.join(known, "job_id", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1), p)
    scored = vectors if candidates is None else vectors.join(candidates.select("job_id").distinct(), "job_id", "left_semi")
    items = scored.select(F.col("job_id").alias("cand"), "term", F.col("w").alias("cw"))
    if p.pooling == "max_sim":
        read = vectors.join(histories.select("job_id").distinct(), "job_id", "left_semi")
        pairs = read.select("job_id", "term", "w").join(items, "term").groupBy("job_id", "cand").agg(F.sum(F.col("w") * F.col("cw")).alias("sim"))
        rows = weights.join(pairs, "job_id").groupBy("session_id", F.col("cand").alias("job_id")).agg(F.max(F.col("hw") * F.col("sim")).alias("score"))
    else:
        profile = weights.join(vectors, "job_id").groupBy("session_id", "term").agg(F.sum(F.col("hw") * F.col("w")).alias("pw"))
        rows = profile.join(items, "term").groupBy("session_id", F.col("cand").alias("job_id")).agg(F.sum(F.col("pw") * F.col("cw")).alias("score"))
    return rows.where(is_signal(F.col("score")))


def _packed(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(job_id, cells): one row a job, its sorted list of (t, w), where t numbers the terms; and the number of terms."""
    terms = vectors.select("term").distinct().withColumn("t", (F.row_number().over(Window.orderBy("term")) - 1).cast("int")).persist()
    cell = F.struct("t", F.round("w", 12).alias("w"))  # sums of another order give the same class
    return vectors.join(F.broadcast(terms), "term").groupBy("job_id").agg(F.array_sort(F.collect_list(cell)).alias("cells")), terms.count()


def _classes(listed: DataFrame) -> DataFrame:
    """(cells, class, size): jobs with equal vectors are one class, named by its smallest id."""
    return listed.groupBy("cells").agg(F.min("job_id").alias("class"), F.count(F.lit(1)).alias("size"))


#: Terms whose products with one another are one small matrix (32 MB).
GRAM = 2048


def _axes(classes: DataFrame, width: int, components: int) -> np.ndarray:
    """The right singular vectors (terms by components) of the TF-IDF matrix.

    A class is one row, scaled by the root of its size, so the products of the terms are those of all jobs. Up to
    ``GRAM`` terms these products are summed in one pass and solved whole; more terms take MLlib's distributed SVD.
    """
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    real = classes.where(F.size("cells") > 0)
    k = min(components, width, int(real.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]))
    if k < 1:
        return np.zeros((width, 0))
    rows = real.select("size", F.col("cells.t").alias("t"), F.col("cells.w").alias("w")).rdd.map(lambda r: Vectors.sparse(width, r["t"], [w * r["size"] ** 0.5 for w in r["w"]]))
    kept = RowMatrix(rows)
    if width <= GRAM:
        squares, axes = np.linalg.eigh(kept.computeGramianMatrix().toArray())
        return axes[:, ::-1][:, :k][:, squares[::-1][:k] > 1e-18 * squares[-1]]  # singular values above 1e-9 of the first, as in MLlib
    java = kept._java_matrix_wrapper._java_model.rows()
    java.cache()  # the solver reads them once a step
    axes = kept.computeSVD(k).V.toArray()
    java.unpersist(False)
    return axes


def _along(axes: np.ndarray, at: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows whose cells begin at ``at`` (their number and 1 entries)."""
    out = np.zeros((len(at) - 1, axes.shape[1]))
    for first in range(0, len(out), 2048):
        here = at[first : first + 2049]
        full = np.flatnonzero(np.diff(here))
        if len(full):
            cells = slice(here[0], here[-1])
            out[first + full] = np.add.reduceat(axes[t[cells]] * w[cells, None], here[full] - here[0])
    return out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-12)[:, None]


def _flat(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings, terms and weights of the cells of all rows."""
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(cells).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = cells.flatten()
    return at, flat.field("t").to_numpy(zero_copy_only=False), flat.field("w").to_numpy(zero_copy_only=False)


def _with_axes(packed: DataFrame, axes: np.ndarray) -> DataFrame:
    """``packed`` with the unit vectors ``v``."""
    shared = packed.sparkSession.sparkContext.broadcast(axes)

    def add(batches):
        for batch in batches:
            v = _along(shared.value, *_flat(batch.column("cells")))
            starts = pa.array(np.arange(0, v.size + 1, v.shape[1]) if v.shape[1] else np.zeros(len(v) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(starts, pa.array(v.ravel()))], [*batch.schema.names, "v"])

    return packed.mapInArrow(add, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema) + ", v array<double>")


def dense_vectors(vectors: DataFrame, components: int) -> DataFrame:
    """(job_id, v): unit rows of the truncated SVD of the TF-IDF matrix."""
    packed, width = _packed(vectors.persist())
    packed = packed.persist()
    return _with_axes(packed, _axes(_classes(packed).persist(), width, components)).select("job_id", "v")


def dense_scores(histories: DataFrame, dense: DataFrame, candidates: DataFrame, p: Params = Params()) -> DataFrame:
    """(session_id, job_id, score): cosine of the unit profile and every candidate's vector."""
    known = histories.join(dense.select("job_id"), "job_id", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1)
    cells = history_weights(known, p).join(dense, "job_id").select("session_id", "hw", F.posexplode("v").alias("i", "x"))
    profile = cells.groupBy("session_id", "i").agg(F.sum(F.col("hw") * F.col("x")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("session_id")))
    unit = profile.withColumn("x", F.col("x") / F.greatest(norm, F.lit(1e-12)))
    items = dense.join(candidates.select("job_id").distinct(), "job_id", "left_semi").select("job_id", F.posexplode("v").alias("i", "y"))
    return unit.join(items, "i").groupBy("session_id", "job_id").agg(F.sum(F.col("x") * F.col("y")).alias("score"))


#: Sessions and classes of a group that meets in one task. A session group's classes are copied to it, so its memory does not grow with either table.
SESSIONS, CLASSES = 256, 16384


def _met(axes, rows: pa.Table) -> pa.Table:
    """Of each session: the least and largest lexical and dense score among the classes of the group, and the scores of those asked for.

    A row with a ``session_id`` holds cells of its profile: terms, and from -1 down the dense components. A session's
    rows score by the best of their lexical products (they are several for ``max_sim`` only) and the sum of their dense cells.
    """
    is_class = rows.column("session_id").is_null().combine_chunks()
    classes, read = rows.filter(is_class), rows.filter(pc.invert(is_class)).sort_by("session_id")
    if not len(classes) or not len(read):
        return _MET.empty_table()
    names, owner = np.unique(read.column("session_id").to_numpy(), return_inverse=True)
    at, t, w = _flat(classes.column("cells").combine_chunks())
    read_at, read_t, read_w = _flat(read.column("cells").combine_chunks())
    row = np.repeat(np.arange(len(read)), np.diff(read_at))
    lexical, profile = np.zeros((len(classes), len(names))), np.zeros((axes.shape[1], len(names)))
    dense = read_t < 0
    np.add.at(profile, (-1 - read_t[dense], owner[row[dense]]), read_w[dense])
    profile /= np.maximum(np.sqrt((profile * profile).sum(axis=0)), 1e-12)
    for low in range(0, len(read), SESSIONS):
        high = min(low + SESSIONS, len(read))
        mine = (row >= low) & (row < high) & ~dense
        terms, place = np.unique(read_t[mine], return_inverse=True)
        if not len(terms):
            continue
        table = np.zeros((len(terms), high - low))
        np.add.at(table, (place, row[mine] - low), read_w[mine])
        to = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
        shared = np.flatnonzero(terms[to] == t)
        of = np.searchsorted(at, shared, side="right") - 1  # the class of a shared cell
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        some, begins = np.unique(owner[low:high], return_index=True)
        for n in range(0, len(starts), 1024):
            cells = slice(starts[n], starts[n + 1024] if n + 1024 < len(starts) else len(shared))
            sums = np.add.reduceat(table[to[shared[cells]]] * w[shared[cells], None], starts[n : n + 1024] - starts[n])
            where = np.ix_(of[starts[n : n + 1024]], some)
            lexical[where] = np.maximum(lexical[where], np.maximum.reduceat(sums, begins, axis=1))
    lexical[~np.isfinite(lexical)] = 0.0
    alike = np.nan_to_num(_along(axes, at, t, w) @ profile, nan=0.0, posinf=np.inf, neginf=-np.inf)
    asked = np.flatnonzero(classes.column("asked").to_numpy(zero_copy_only=False))
    ids = classes.column("class").take(pa.array(np.tile(asked, len(names)))).combine_chunks()
    cells = pa.StructArray.from_arrays([ids, pa.array(lexical[asked].T.ravel()), pa.array(alike[asked].T.ravel())], ["class", "a", "b"])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * len(asked), pa.int32()), cells)
    return pa.Table.from_arrays([pa.array(names, pa.string()), lexical.min(axis=0), lexical.max(axis=0), alike.min(axis=0), alike.max(axis=0), lists], schema=_MET)


_MET = pa.schema([("session_id", pa.string()), *((n, pa.float64()) for n in ("low_a", "high_a", "low_b", "high_b")), ("cells", pa.list_(pa.struct([("class", pa.string()), ("a", pa.float64()), ("b", pa.float64())])))])


def blended_scores(histories: DataFrame, vectors: DataFrame, jobs: DataFrame, candidates: DataFrame, p: Params = Params()) -> DataFrame:
    """(session_id, job_id, score) of the candidates: lexical and dense scores min-maxed over all known jobs, then blended.

    Of the jobs that are no candidates only the least and the largest score count, and jobs with equal vectors score
    alike: sessions meet classes, in groups of bounded size, and no pair is shuffled. Jobs without a vector score 0.
    """
    vectors = vectors.persist()
    packed, width = _packed(vectors)
    no_cells = F.array().cast("array<struct<t:int,w:double>>")
    listed = jobs.select(F.col("job_id").cast("string").alias("job_id")).distinct().join(packed, "job_id", "left").select("job_id", F.coalesce("cells", no_cells).alias("cells")).persist()
    classes = _classes(listed).persist()
    axes = _axes(classes, width, p.lsa_components)
    vectors.unpersist()
    asked = listed.join(candidates.select("job_id").distinct(), "job_id", "left_semi")
    of_job = asked.join(classes.select("cells", "class"), "cells").select("job_id", "class")
    marked = classes.join(asked.select("cells").distinct().withColumn("asked", F.lit(True)), "cells", "left").select("class", F.coalesce("asked", F.lit(False)).alias("asked"), "cells")

    real = listed.where(F.size("cells") > 0)
    read = _with_axes(real.join(histories.select("job_id").distinct(), "job_id", "left_semi"), axes)
    known = histories.join(real.select("job_id"), "job_id", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1)
    own = F.transform("v", lambda x, i: F.struct((-1 - i).cast("int").alias("t"), x.alias("w")))
    rows = history_weights(known, p).join(read, "job_id")
    # a lexical profile is one row, but an item each for max_sim; the dense one is always summed
    part = F.when(F.col("c.t") >= 0, F.col("pos")).otherwise(-1) if p.pooling == "max_sim" else F.lit(0)
    sums = rows.select("session_id", "pos", "hw", F.explode(F.concat("cells", own)).alias("c")).groupBy("session_id", part.alias("part"), F.col("c.t").alias("t")).agg(F.sum(F.col("hw") * F.col("c.w")).alias("w"))
    profiles = sums.groupBy("session_id", "part").agg(F.collect_list(F.struct("t", "w")).alias("cells"))

    heads, tails = histories.select("session_id").distinct().count(), classes.count()
    s, c = max(1, -(-heads // SESSIONS)), max(1, -(-tails // CLASSES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = profiles.select("session_id", F.lit(None).cast("string").alias("class"), F.lit(False).alias("asked"), "cells", F.pmod(F.xxhash64("session_id"), F.lit(s)).cast("int").alias("_s"), every(c).alias("_c"))
    right = marked.select(F.lit(None).cast("string").alias("session_id"), "class", "asked", "cells", every(s).alias("_s"), F.pmod(F.xxhash64("class"), F.lit(c)).cast("int").alias("_c"))
    shared = histories.sparkSession.sparkContext.broadcast(axes)
    met = left.unionByName(right).groupBy("_s", "_c").applyInArrow(lambda t: _met(shared.value, t.select(["session_id", "class", "asked", "cells"])), "session_id string, low_a double, high_a double, low_b double, high_b double, cells array<struct<class:string,a:double,b:double>>")
    if c > 1:
        met = met.groupBy("session_id").agg(*[f(n).alias(n) for f, n in ((F.min, "low_a"), (F.max, "high_a"), (F.min, "low_b"), (F.max, "high_b"))], F.flatten(F.collect_list("cells")).alias("cells"))
    unit = lambda n: F.when(F.col(f"high_{n}") - F.col(f"low_{n}") < 1e-12, F.lit(0.0)).otherwise((F.col(f"c.{n}") - F.col(f"low_{n}")) / (F.col(f"high_{n}") - F.col(f"low_{n}")))
    score = F.lit(p.blend_alpha_lexical) * unit("a") + F.lit(1 - p.blend_alpha_lexical) * unit("b")
    scored = met.withColumn("c", F.explode("cells")).select("session_id", F.col("c.class").alias("class"), score.alias("score")).where(is_signal(F.col("score")))
    return scored.join(of_job, "class").select("session_id", "job_id", "score")


def predict(histories: DataFrame, sessions: DataFrame, candidates: DataFrame, interactions: DataFrame, targets: DataFrame | None, listings: DataFrame, p: Params = Params()) -> DataFrame:
    """Every candidate's score: the variant's positive score, else the action prior, else the fallback."""
    jobs = interactions.select("job_id").unionByName(listings.select("job_id"))
    vectors = lexical_vectors(item_texts(jobs, listings, p), p)
    if p.variant == "TFIDF_WORD":
        personal = lexical_scores(histories, vectors, p, candidates)
    elif p.variant == "LSA_TFIDF":
        personal = dense_scores(histories, dense_vectors(vectors, p.lsa_components), candidates, p).where(is_signal(F.col("score")))
    elif p.variant == "LEXICAL_DENSE_BLEND":
        personal = blended_scores(histories, vectors, jobs, candidates, p)
    else:
        raise ValueError(f"unknown variant {p.variant!r}")
    prior = action_priors(interactions, targets, p, listings.select("job_id"))
    if p.popularity_weight > 0:
        pw = float(p.popularity_weight)
        mixed = personal.join(prior.select("job_id", "prior"), "job_id", "left")
        personal = mixed.select("session_id", "job_id", ((1 - pw) * F.col("score") + pw * F.coalesce("prior", F.lit(0.0))).alias("score"))
    return fill_priors(personal, sessions, candidates, prior)
