"""Registered queries over the synthetic tables. Their SQL is in ``oracle.py``, under the same names.

``A`` is the order log (orders are sessions, parts are jobs), ``B`` the event log
(users are sessions). A session's last event is its target, the rest its history.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailrank.functions import metrics, schema, scores, text
from trailrank.operators import action, content, ensemble, factors, graph, itemitem, markov, popularity, sessions
from trailrank.plans import search
from trailrank.plans.oracle import ORACLE_SQL
from trailrank.sources import files, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Weights of the blend that the registered ensemble queries use.
BLEND = {"pop": 0.2, "ii": 0.5, "uu": 0.3}
TRIALS = [BLEND, {"pop": 1.0, "ii": 0.0, "uu": 0.0}, {"pop": 0.0, "ii": 1.0, "uu": 0.0}, {"pop": 0.0, "ii": 0.0, "uu": 1.0}, {"pop": 0.25, "ii": 0.25, "uu": 0.5}]


def query(f):
    QUERIES[f.__name__] = f
    return f


def log_a(spark, d):
    return tables.orders_as_sessions(spark, d)


def log_b(spark, d):
    return schema.normalize(tables.users_as_sessions(spark, d))


def split(log):
    history, truth = schema.split_last(log)
    return history, truth


def r6(name):
    return F.round(F.col(name), 6).alias(name)


def long(name):
    return F.col(name).cast("long").alias(name)


# sources and row transforms


@query
def interactions_norm(spark, d):
    raw = tables.users_as_sessions(spark, d).withColumn("action", F.concat(F.lit("  "), F.upper("action"), F.lit(" ")))
    return schema.normalize(raw).select("session_id", "job_id", "action", "pos")


@query
def explode_sessions(spark, d):
    arrays = files.session_arrays(log_a(spark, d)).select("session_id", F.to_json("job_ids").alias("job_ids"), F.to_json("actions").alias("actions"))
    return files.explode_sessions(arrays)


@query
def session_arrays(spark, d):
    arrays = files.session_arrays(log_a(spark, d))
    return arrays.select("session_id", F.array_join("job_ids", ",").alias("job_ids"), F.array_join("actions", ",").alias("actions"))


@query
def append_target(spark, d):
    history, truth = split(log_a(spark, d))
    out = files.append_target(files.session_arrays(history), truth)
    return out.select("session_id", F.array_join("job_ids", ",").alias("job_ids"), F.array_join("actions", ",").alias("actions"))


@query
def session_split(spark, d):
    rows = log_a(spark, d).withColumn("valid", schema.valid_split(F.col("session_id")))
    return rows.groupBy("valid").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("session_id").alias("n_sessions"))


@query
def targets_norm(spark, d):
    """Targets without actions, some without a job."""
    _, truth = split(log_b(spark, d))
    return schema.normalize_targets(truth.select("session_id", F.when(F.col("session_id").cast("long") % 7 != 0, F.col("job_id")).alias("job_id")))


@query
def id_coercion(spark, d):
    part = tables.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % 3).alias("m"))
    given = F.concat(F.when(F.col("m") == 0, "00").when(F.col("m") == 1, "x").otherwise("-"), F.col("k"))
    return part.select("k", schema.as_int_if_possible(given).alias("job_id"))


@query
def last_k_history(spark, d):
    history, _ = split(log_b(spark, d))
    return schema.last_k(history, 5).select("session_id", "job_id", "action", "pos")


@query
def action_codes(spark, d):
    rows = log_b(spark, d)
    out = rows.select("action", schema.binary_action(F.col("action")).alias("binary"), schema.action_code(F.col("action")).alias("code"))
    return out.groupBy("action", "binary", "code").agg(F.count(F.lit(1)).alias("n"))


@query
def disjoint_union(spark, d):
    """The event log's first half of users as train, the rest as test with ids moved past train's."""
    log = log_b(spark, d).withColumn("valid", schema.valid_split(F.col("session_id")))
    history, truth = split(log.where("NOT valid").drop("valid"))
    out = schema.union_logs(history, truth, log.where("valid"))
    return out.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("job_id", "pos").alias("last_job"))


@query
def vocab_union(spark, d):
    jobs = log_a(spark, d).withColumn("ord", F.col("session_ord") * 1000 + F.col("pos"))
    listings = tables.parts_as_listings(spark, d)
    out = schema.vocabulary(jobs.select("job_id", "ord"), listings.select("job_id"))
    return out.groupBy("tier").agg(F.count(F.lit(1)).alias("jobs"), F.min("at").alias("first_at"))


# transitions and rankers on them


@query
def transitions(spark, d):
    return markov.transitions(log_a(spark, d)).select("from_job", "to_job", "n")


@query
def transition_probs(spark, d):
    return markov.transitions(log_a(spark, d)).select("from_job", "to_job", r6("prob"))


@query
def transition_histogram(spark, d):
    return markov.transitions(log_a(spark, d)).groupBy("n").agg(F.count(F.lit(1)).alias("pairs"))


@query
def markov_topk(spark, d):
    return markov.markov_map(markov.transitions(log_a(spark, d)), 50).select("from_job", "to_job", r6("prob"), long("rank"))


@query
def popular_jobs(spark, d):
    return markov.popular_jobs(markov.transitions(log_a(spark, d))).select("job_id", "n", long("rank"))


@query
def job_share(spark, d):
    return markov.job_share(log_a(spark, d)).select("job_id", r6("share"))


def _markov(spark, d):
    log = log_a(spark, d)
    history, truth = split(log)
    return history, truth, markov.transitions(log), markov.popular_next(log)


def _last_lists(spark, d):
    """One row a session: its target, the event before and the list for it."""
    log = log_a(spark, d)
    return markov.last_lists(markov.session_ends(log), markov.transitions(log), markov.popular_next(log))


@query
def markov_last_recs(spark, d):
    return markov.listed(_last_lists(spark, d)).select("session_id", long("rank"), "job_id")


@query
def markov_session_recs(spark, d):
    history, truth, trans, popular = _markov(spark, d)
    return markov.recommend_session(history, truth, trans, popular).select("session_id", long("rank"), "job_id")


@query
def markov_recency_recs(spark, d):
    history, truth, trans, popular = _markov(spark, d)
    return markov.recommend_session(history, truth, trans, popular, recency=True).select("session_id", long("rank"), "job_id")


@query
def markov_mrr(spark, d):
    return metrics.mean_reciprocal(metrics.list_hits(_last_lists(spark, d)))


@query
def markov_train_only_mrr(spark, d):
    """As ``markov_mrr``, but transitions see the histories only, not the events that are evaluated."""
    log = log_a(spark, d)
    history, _ = split(log)
    return metrics.mean_reciprocal(metrics.list_hits(markov.last_lists(markov.session_ends(log), markov.transitions(history), markov.popular_next(history))))


@query
def k_sweep_mrr(spark, d):
    return markov.k_sweep(*_markov(spark, d))


@query
def topk_stats(spark, d):
    return metrics.hit_stats(metrics.list_hits(_last_lists(spark, d))).select("sessions", "hits", "misses", "miss_rate", "mean_rank", long("min_rank"), long("max_rank"))


@query
def cold_rate(spark, d):
    history, _ = split(log_a(spark, d))
    return markov.cold_rate(history, markov.transitions(history))


# actions


@query
def trailing_views(spark, d):
    history, _ = split(log_b(spark, d))
    return action.trailing_views(history)


@query
def action_by_nview(spark, d):
    history, truth = split(log_a(spark, d))
    return action.action_shares(action.trailing_views(history), truth, "n_views")


@query
def action_by_trail(spark, d):
    history, truth = split(log_a(spark, d))
    return action.action_shares(action.trailing_views(history), truth, "trail_view")


@query
def last_action_acc(spark, d):
    history, truth = split(log_a(spark, d))
    said = action.last_action(history, truth).withColumnRenamed("action", "y_pred")
    return metrics.accuracy(truth.select("session_id", F.col("action").alias("y_true")).join(said, "session_id"))


@query
def action_report(spark, d):
    history, truth = split(log_a(spark, d))
    said = action.last_action(history, truth).withColumnRenamed("action", "y_pred")
    return metrics.class_report(truth.select("session_id", F.col("action").alias("y_true")).join(said, "session_id"))


@query
def action_logreg(spark, d):
    history, truth = split(log_a(spark, d))
    features = action.trailing_views(history)
    model = action.fit_logistic(features, truth)
    return action.predict_logistic(model, features).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_apply"), 6).alias("p_apply"))


# popularity


def _popularity(spark, d, variant, include_target=False):
    history, truth = split(log_a(spark, d))
    p = popularity.Params(variant=variant, include_target=include_target)
    return popularity.fit(history, truth, p=p).select("job_id", r6("score"), r6("fallback"))


@query
def pop_global(spark, d):
    return _popularity(spark, d, "POP_GLOBAL_COUNTS")


@query
def pop_session_weighted(spark, d):
    return _popularity(spark, d, "POP_SESSION_WEIGHTED")


@query
def pop_session_weighted_targets(spark, d):
    return _popularity(spark, d, "POP_SESSION_WEIGHTED", True)


@query
def pop_trending(spark, d):
    return _popularity(spark, d, "POP_TRENDING")


@query
def pop_hybrid(spark, d):
    return _popularity(spark, d, "POP_HYBRID")


# item-item and session-session


@query
def session_item_weights(spark, d):
    history, truth = split(log_a(spark, d))
    return itemitem.session_item_weights(history, truth).select("session_id", "job_id", r6("w"))


def _similar(spark, d, variant):
    history, truth = split(log_a(spark, d))
    p = itemitem.Params(variant=variant)
    return itemitem.similarity(itemitem.session_item_weights(history, truth, p), p)


@query
def ii_tversky(spark, d):
    return _similar(spark, d, "II_TVERSKY")


@query
def ii_cosine(spark, d):
    return _similar(spark, d, "II_COSINE")


@query
def ii_priors(spark, d):
    history, truth = split(log_a(spark, d))
    return itemitem.priors(itemitem.session_item_weights(history, truth)).select("job_id", r6("prior"), r6("fallback"))


def _ii(spark, d):
    history, truth = split(log_b(spark, d))
    x = itemitem.session_item_weights(history, None)
    return itemitem.predict(history, truth, log_b(spark, d).select("job_id"), x, itemitem.similarity(x))


@query
def ii_scores(spark, d):
    return _ii(spark, d).select("session_id", "job_id", r6("score"))


@query
def ii_recs_mrr(spark, d):
    history, truth = split(log_a(spark, d))
    x = itemitem.session_item_weights(history, None)
    return metrics.mrr(itemitem.recommend(history, truth, x, itemitem.similarity(x)), truth)


@query
def iuf(spark, d):
    history, _ = split(log_a(spark, d))
    return sessions.iuf(sessions.truncated(history)).select("job_id", "df", r6("iuf"))


@query
def uu_neighbors(spark, d):
    history, _ = split(log_b(spark, d))
    stored = sessions.truncated(history)
    v = sessions.vectors(stored, sessions.iuf(stored))
    return sessions.neighbors(v, v)


def _uu(spark, d):
    history, truth = split(log_b(spark, d))
    return sessions.predict(history, truth, log_b(spark, d).select("job_id"), history, None)


@query
def uu_scores(spark, d):
    return _uu(spark, d).select("session_id", "job_id", r6("score"))


@query
def uu_scores_boost(spark, d):
    """Session-session scores with the boosts of a neighbour's last places."""
    history, truth = split(log_b(spark, d))
    p = replace(sessions.Params(), use_sequence_boost=True)
    return sessions.predict(history, truth, log_b(spark, d).select("job_id"), history, None, p).select("session_id", "job_id", r6("score"))


@query
def action_priors(spark, d):
    history, truth = split(log_a(spark, d))
    return sessions.action_priors(history, truth, sessions.Params()).select("job_id", r6("prior"), r6("fallback"))


# factors and graph


@query
def mf_ratings(spark, d):
    history, truth = split(log_a(spark, d))
    return factors.ratings(history, truth).select("session_id", "job_id", r6("rating"), r6("raw_signal"), "events")


@query
def mf_priors(spark, d):
    history, truth = split(log_a(spark, d))
    return factors.priors(factors.ratings(history, truth)).select("job_id", r6("support"), r6("prior"), r6("fallback"))


def _mf(spark, d, build):
    history, truth = split(log_b(spark, d))
    rated = factors.ratings(history, truth)
    return factors.predict(history, truth, log_b(spark, d).select("job_id"), rated, build(rated))


@query
def mf_svd_scores(spark, d):
    return _mf(spark, d, lambda r: factors.svd_factors(r, rank=16))


@query
def mf_als_scores(spark, d):
    return _mf(spark, d, lambda r: factors.als_factors(r, rank=16, iterations=5))


@query
def mf_bpr_scores(spark, d):
    return _mf(spark, d, lambda r: factors.bpr_factors(r, rank=16, epochs=20))


@query
def mf_lmf_scores(spark, d):
    return _mf(spark, d, lambda r: factors.lmf_factors(r, rank=16, epochs=20))


@query
def gnn_scores(spark, d):
    """The graph ranker, trained in full."""
    history, truth = split(log_b(spark, d))
    p = graph.Params()
    return graph.predict(history, truth, log_b(spark, d).select("job_id"), history, None, p, graph.train(history, p))


@query
def gnn_edges(spark, d):
    return graph.edges(log_b(spark, d)).select("session_id", "src", "dst", r6("w"))


@query
def gnn_nodes(spark, d):
    return graph.nodes(log_b(spark, d)).select("session_id", "job_id", long("alias"))


@query
def gnn_examples(spark, d):
    rows = graph.examples(log_b(spark, d))
    return rows.select("session_id", "t", F.array_join("prefix_items", ",").alias("prefix_items"), F.array_join("prefix_actions", ",").alias("prefix_actions"), "pos_item")


@query
def gnn_priors(spark, d):
    history, truth = split(log_a(spark, d))
    return graph.priors(history, truth).select("job_id", r6("prior"), r6("fallback"))


@query
def gnn_sampler_pop(spark, d):
    return graph.sampler_popularity(log_a(spark, d)).select("job_id", r6("share"))


# text


@query
def text_clean(spark, d):
    rows = tables.documents_as_listings(spark, d)
    digest = lambda c: F.md5(F.encode(c, "UTF-8"))
    return rows.select("job_id", digest(text.clean_basic(F.col("text"))).alias("basic"), F.length(text.fold_accents(text.clean_basic(F.col("text")))).cast("long").alias("chars"))


@query
def text_modes(spark, d):
    rows = tables.documents_as_listings(spark, d)
    digest = lambda c: F.md5(F.encode(c, "UTF-8"))
    return rows.select("job_id", digest(text.clean_punctuation(F.col("text"))).alias("normalized"), digest(text.clean_listing(F.col("text"))).alias("listing"))


@query
def text_sections(spark, d):
    """Titles and summaries of listings that have both, one or none of them."""
    part, m = tables.read(spark, d, "part"), F.col("p_partkey") % 4
    both, title = F.concat(F.lit("Title: "), "p_name", F.lit("  Summary: "), "p_type"), F.concat(F.lit("TITLE "), "p_name")
    summary, neither = F.concat(F.lit("x summary:"), "p_type"), F.concat_ws(" - ", "p_name", "p_brand")
    rows = part.select(F.col("p_partkey").cast("string").alias("job_id"), F.when(m == 0, both).when(m == 1, title).when(m == 2, summary).otherwise(neither).alias("text"))
    return rows.select("job_id", text.title_summary(F.col("text")).alias("section"), text.preprocess(F.col("text"), "title_summary").alias("cleaned"))


@query
def text_tokens(spark, d):
    rows = tables.documents_as_listings(spark, d).select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def tfidf(spark, d):
    return text.tfidf(tables.parts_as_listings(spark, d)).select("job_id", "term", r6("w"))


@query
def text_neighbors(spark, d):
    return text.neighbors(text.tfidf(tables.parts_as_listings(spark, d), min_df=3, max_df=1.0, max_features=None, sublinear=False), 50).select("src", "dst", r6("sim"), long("rank"))


def _cbf(spark, d, pooling):
    history, truth = split(log_b(spark, d))
    return content.predict(history, truth, log_b(spark, d).select("job_id"), history, None, tables.parts_as_listings(spark, d), replace(content.Params(), variant="TFIDF_WORD", pooling=pooling))


@query
def cbf_recency(spark, d):
    return _cbf(spark, d, "recency").select("session_id", "job_id", r6("score"))


@query
def cbf_mean(spark, d):
    return _cbf(spark, d, "mean").select("session_id", "job_id", r6("score"))


@query
def cbf_max_sim(spark, d):
    return _cbf(spark, d, "max_sim").select("session_id", "job_id", r6("score"))


@query
def cbf_last_item(spark, d):
    return _cbf(spark, d, "last_item").select("session_id", "job_id", r6("score"))


@query
def lsa_blend_scores(spark, d):
    history, truth = split(log_b(spark, d))
    p = replace(content.Params(), lsa_components=16)
    return content.predict(history, truth, log_b(spark, d).select("job_id"), history, None, tables.parts_as_listings(spark, d), p)


def _hybrid(spark, d):
    log = log_a(spark, d)
    history, truth = split(log)
    chain = markov.markov_map(markov.transitions(log), 50).select("from_job", F.col("to_job"), "prob")
    return history, truth, chain, markov.job_share(log)


@query
def hybrid_recs(spark, d):
    history, truth, chain, share = _hybrid(spark, d)
    vectors = text.tfidf(tables.parts_as_listings(spark, d), min_df=3, max_df=1.0, max_features=None, sublinear=False)
    rounded = chain.withColumn("prob", F.round("prob", 9))
    ranked = markov.hybrid_tiers(history, truth, rounded, text.neighbors(vectors, 50).select("src", "dst", "sim"), share.withColumn("share", F.round("share", 9)))
    return ranked.select("session_id", long("rank"), "job_id")


@query
def text_only_recs(spark, d):
    history, _ = split(log_a(spark, d))
    vectors = text.tfidf(tables.parts_as_listings(spark, d), min_df=3, max_df=1.0, max_features=None, sublinear=False)
    return markov.text_only(history, text.neighbors(vectors, 50).select("src", "dst", "sim")).select("session_id", long("rank"), "job_id")


@query
def markov_only_mrr(spark, d):
    history, truth, chain, share = _hybrid(spark, d)
    ranked = markov.hybrid_tiers(history, truth, chain.withColumn("prob", F.round("prob", 9)), None, share.withColumn("share", F.round("share", 9)), pop_weight=0.01, pop_cap=500, gate=500)
    return metrics.mrr(ranked, truth)


# normalisation, blending, evaluation


def _stack(spark, d):
    log = log_b(spark, d)
    history, truth = split(log)
    pop = popularity.predict(popularity.fit(history), truth, log.select("job_id"))
    return ensemble.stack({"pop": pop, "ii": _ii(spark, d), "uu": _uu(spark, d)}).withColumn("score", F.round("score", 9)), history, truth, ensemble.candidate_order(history)


@query
def norm_minmax(spark, d):
    stacked, *_ = _stack(spark, d)
    return scores.normalize(stacked, "minmax").select("session_id", "job_id", "model", r6("score"))


@query
def norm_rank(spark, d):
    stacked, *_ = _stack(spark, d)
    return scores.normalize(stacked, "rank").select("session_id", "job_id", "model", r6("score"))


@query
def ensemble_recs(spark, d):
    stacked, history, truth, candidates = _stack(spark, d)
    return ensemble.recommend(ensemble.blend(stacked, BLEND), truth, history, candidates)


@query
def weight_grid_mrr(spark, d):
    stacked, history, truth, candidates = _stack(spark, d)
    return ensemble.trial_mrr(scores.normalize(stacked, "minmax"), TRIALS, history, truth, candidates)


@query
def model_breakdown(spark, d):
    stacked, history, truth, candidates = _stack(spark, d)
    names = sorted(BLEND)
    out = ensemble.trial_mrr(scores.normalize(stacked, "minmax"), ensemble.one_hot_trials(names), history, truth, candidates)
    return out.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("trial") + 1).alias("model"), "sessions", "mrr")


@query
def challenge_score(spark, d):
    """Both metrics are means over the same rows, one a session."""
    lists = _last_lists(spark, d)
    both = lists.select("job_id", "jobs", F.col("action").alias("y_true"), action.said(F.col("last_action")).alias("y_pred"), "session_id")
    return metrics.scored(both).select("mrr", "accuracy", F.round(metrics.challenge_score(F.col("mrr"), F.col("accuracy")), 6).alias("score"))


@query
def submission(spark, d):
    history, truth = split(log_a(spark, d))
    full = markov.pad(markov.listed(_last_lists(spark, d)), truth, markov.job_share(log_a(spark, d)), history)
    lists = full.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "job_id"))), lambda r: r["job_id"]), ",").alias("job_id"))
    return action.last_action(history, truth).join(lists, "session_id").select("session_id", "action", "job_id")


@query
def submission_blend(spark, d):
    """The blend refitted on the training sessions with their targets and on the asked sessions' histories."""
    log, valid = log_b(spark, d), schema.valid_split(F.col("session_id"))
    history, truth = split(log)
    known = log.where(~valid).unionByName(history.where(valid))
    weights = {"popularity": BLEND["pop"], "item_item": BLEND["ii"], "user_user": BLEND["uu"]}
    return search.refit_submission(weights, known, history.where(valid), truth.where(valid), log.select("job_id"))


@query
def submission_checks(spark, d):
    return metrics.list_checks(_last_lists(spark, d))
