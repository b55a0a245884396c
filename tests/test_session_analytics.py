"""Hand-computed cases and edge cases of the session operators."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailrank.functions import metrics, schema, scores, text
from trailrank.operators import action, content, ensemble, factors, graph, itemitem, markov, popularity, sessions
from trailrank.plans import catalog
from trailrank.sources import files

LOG = "session_id string, job_id string, action string, pos long, session_ord long"


def log(spark, **rows):
    """Sessions as lists of (job, action); the order of the names is the order of the sessions."""
    data = [(s, j, a, n, k) for k, (s, events) in enumerate(rows.items()) for n, (j, a) in enumerate(events)]
    return spark.createDataFrame(data, LOG)


def views(*jobs):
    return [(j, "view") for j in jobs]


def table(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_normalize_drops_nulls_and_closes_positions(spark):
    rows = spark.createDataFrame([("1", "a", " Apply ", 0), ("1", None, "view", 1), ("1", "b", "\tVIEW", 2), (None, "c", "view", 0)], "session_id string, job_id string, action string, pos long")
    assert [tuple(r) for r in schema.normalize(rows).orderBy("pos").collect()] == [("1", "a", "apply", 0), ("1", "b", "view", 1)]
    with pytest.raises(ValueError):
        schema.normalize(rows.drop("action"))
    with pytest.raises(TypeError):
        schema.require([1])


def test_targets_without_action_are_views(spark):
    rows = spark.createDataFrame([(1, 2)], "session_id int, job_id int")
    assert tuple(schema.normalize_targets(rows).first()) == ("1", "2", "view")


def test_list_cells(spark):
    cells = ["[1, 2]", "['view', 'apply']", "bad", "(1,2)", "[]", "[1, None]", None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(files.parse_list(F.col("c")).alias("v"))
    assert [r["v"] for r in rows.collect()] == [["1", "2"], ["view", "apply"], [], [], [], ["1", "None"], []]


def test_explode_sessions_cuts_to_the_shorter_list(spark):
    rows = spark.createDataFrame([("7", "[5, 6, 7]", "['view', 'apply']"), ("8", "[]", "[]")], files.SESSIONS)
    assert [tuple(r) for r in files.explode_sessions(rows).collect()] == [("7", "5", "view", 0), ("7", "6", "apply", 1)]


def test_files_round_trip(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('session_id,job_ids,actions\n1,"[1, 2]","[\'view\', \'view\']"\n')
    assert files.explode_sessions(files.read_csv(spark, str(path))).count() == 2
    (tmp_path / "l.json").write_text('{"3": "three", "4": "four"}')
    assert {tuple(r) for r in files.read_listings_json(spark, str(tmp_path / "l.json")).collect()} == {(3, "three"), (4, "four")}
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="JSON object"):
        files.read_listings_json(spark, str(tmp_path / "bad.json")).collect()
    recs = spark.createDataFrame([("1", ["a", "b"])], "session_id string, job_id array<string>")
    out = tmp_path / "out"
    assert files.write_versioned(recs, str(out)).endswith("v1.csv")
    second = files.write_versioned(recs, str(out))
    assert second.endswith("v2.csv")
    assert spark.read.csv(second, header=True, escape='"').first()["job_id"] == '["a","b"]'


def test_listings_from_mappings(spark):
    assert {tuple(r) for r in files.coerce_listings({"1": "x", 2: {"title": "t", "text": None}}, spark).collect()} == {("1", "x"), ("2", "t")}
    rows = spark.createDataFrame([(1, "old", 0), (1, "new", 1)], "id int, text string, ord int")
    assert [tuple(r) for r in files.coerce_listings(rows).collect()] == [("1", "new")]


def test_cache_follows_params_and_data(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    data = spark.range(2)
    for params, table_ in (({"a": 1}, data), ({"a": 1}, data), ({"a": 2}, data), ({"a": 1}, spark.range(4))):
        assert files.cached(build, "m", params, [table_], str(tmp_path)).count() == 3
    assert len(calls) == 3


def test_transitions(spark):
    trans = markov.transitions(log(spark, s1=views("1", "2", "3"), s2=views("1", "2"), s3=views("1", "3")))
    rows = table(trans, "from_job", "to_job")
    assert (rows["1", "2"]["n"], rows["1", "2"]["prob"]) == (2, pytest.approx(2 / 3))
    assert rows["1", "3"]["prob"] == pytest.approx(1 / 3) and rows["2", "3"]["prob"] == 1.0
    assert [r["job_id"] for r in markov.popular_jobs(trans).orderBy("rank").collect()] == ["2", "3"]
    got = table(markov.session_scores(log(spark, q=views("2", "1")), trans, recency=True), "job_id")
    assert got["3"]["score"] == pytest.approx(0.833333, abs=1e-6) and got["2"]["score"] == pytest.approx(0.666667, abs=1e-6)


def test_last_lists_are_the_recommended_rows(spark):
    """One row a session gives the places, hits and checks of the rows, also with short, single and cold sessions."""
    rows = log(spark, a=views("1", "2", "3"), b=views("1", "2"), c=views("9"), d=views("1", "3", "9"), e=views("3", "8"), f=views("7", "1", "2", "8"), g=views("2", None))
    history, truth = schema.split_last(rows)
    for known in (rows, rows.limit(0)):
        trans = markov.transitions(known)
        popular = markov.popular_jobs(trans, 3)
        assert sorted(map(tuple, markov.popular_next(known, 3).collect())) == sorted(map(tuple, popular.collect()))
        recs = markov.recommend_last(history, truth, trans, popular, 3).persist()
        lists = markov.last_lists(markov.session_ends(rows), trans, popular, 3).persist()
        assert sorted(map(tuple, markov.listed(lists).collect())) == sorted(map(tuple, recs.collect()))
        for k in (1, 3):
            assert table(metrics.list_hits(lists, k).select("session_id", "hit_rank"), "session_id") == table(metrics.hits(recs, truth, k), "session_id")
            assert metrics.list_checks(lists, k).collect() == metrics.submission_checks(recs, truth, k).collect()
    ends = markov.session_ends(rows)
    said = action.last_action(history, truth)
    assert table(action.last_of(ends), "session_id") == table(said, "session_id")


@pytest.mark.parametrize("name", ["submission_checks", "challenge_score"])
def test_last_job_queries_shuffle_pairs_once_and_no_places(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(from_job") == 1 and plan.count("hashpartitioning(session_id") == 3


def test_mrr_cases(spark):
    truth = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "session_id string, job_id string")
    recs = spark.createDataFrame([("a", 1, "1"), ("a", 2, "9"), ("b", 1, "9"), ("b", 2, "2"), ("c", 1, "9"), ("c", 2, "8")], "session_id string, rank int, job_id string")
    assert metrics.mrr(recs, truth).first()["mrr"] == 0.5
    assert metrics.mrr(recs, truth, 1).first()["mrr"] == pytest.approx(1 / 3, abs=1e-6)
    assert metrics.mrr(recs.limit(0), truth.limit(0)).first()["mrr"] == 0.0
    assert metrics.challenge_score(0.12, 0.8) == pytest.approx(0.324)
    stats = metrics.topk_stats(recs, truth).first()
    assert (stats["hits"], stats["misses"], stats["mean_rank"]) == (2, 1, 1.5)
    typed = spark.createDataFrame([(7, ["7"])], "t int, p array<string>").select(metrics.reciprocal_rank(F.col("t"), F.col("p")).alias("r"))
    assert typed.first()["r"] == 1.0
    pairs = spark.createDataFrame([(0, 0), (1, 1), (1, 0)], "y_true int, y_pred int")
    assert metrics.accuracy(pairs).first()["accuracy"] == pytest.approx(2 / 3, abs=1e-6)


def test_trailing_views_and_last_action(spark):
    rows = log(spark, a=[("1", "view"), ("2", "apply"), ("3", "view"), ("4", "view")], b=[("1", "apply")], c=[("1", "view")], d=[("1", "foo")])
    got = table(action.trailing_views(rows), "session_id")
    assert [got[s]["trail_view"] for s in "abcd"] == [2, 0, 1, 0]
    asked = spark.createDataFrame([(s,) for s in "abcde"], "session_id string")
    said = table(action.last_action(rows, asked), "session_id")
    assert [said[s]["action"] for s in "abcde"] == ["view", "apply", "view", "view", "view"]


def test_session_weighted_popularity(spark):
    rows = log(spark, s=[("a", "view"), ("b", "apply"), ("a", "view")])
    p = popularity.Params(recency_decay=0.5, w_view=1.0, w_apply=2.0, smooth_alpha=0.0)
    got = table(popularity.fit(rows, p=p), "job_id")
    assert got["a"]["score"] == 1.0 and got["b"]["score"] == pytest.approx(0.8) and got["a"]["fallback"] == 0
    got = table(popularity.fit(rows, p=popularity.Params(recency_decay=0.5, w_view=1.0, w_apply=2.0, smooth_alpha=1.0)), "job_id")
    assert got["b"]["score"] == pytest.approx(0.888889, abs=1e-6) and got["b"]["fallback"] == pytest.approx(0.444444, abs=1e-6)


def test_trending_popularity(spark):
    got = table(popularity.trending(log(spark, s1=views("a"), s2=views("b")), None, popularity.Params(trending_halflife=1.0)), "job_id")
    assert got["a"]["score"] == pytest.approx(0.25) and got["b"]["score"] == pytest.approx(0.5)


def test_tversky_cosine_and_scores(spark):
    x = spark.createDataFrame([("S1", "a", 1.0), ("S1", "b", 1.0), ("S2", "a", 1.0)], "session_id string, job_id string, w double")
    even = itemitem.Params(shrinkage=0.0, tversky_alpha=1.0, tversky_beta=1.0, w_view=1.0, w_apply=1.0)
    assert table(itemitem.similarity(x, even), "job_i", "job_j")["a", "b"]["sim"] == pytest.approx(0.5)
    lean = table(itemitem.similarity(x, itemitem.Params(shrinkage=0.0, tversky_alpha=0.5, tversky_beta=0.0)), "job_i", "job_j")
    assert lean["a", "b"]["sim"] == pytest.approx(2 / 3, abs=1e-6) and lean["b", "a"]["sim"] == pytest.approx(1.0)
    cosine = table(itemitem.similarity(x, itemitem.Params(variant="II_COSINE", shrinkage=0.0)), "job_i", "job_j")
    assert cosine["a", "b"]["sim"] == pytest.approx(0.707107, abs=1e-6)
    asked = spark.createDataFrame([("q",), ("cold",)], "session_id string")
    cands = spark.createDataFrame([("a",), ("b",), ("zz",)], "job_id string")
    got = table(itemitem.predict(log(spark, q=views("a")), asked, cands, x, itemitem.similarity(x, even), even), "session_id", "job_id")
    assert got["q", "b"]["score"] == pytest.approx(0.5) and got["q", "a"]["score"] == pytest.approx(0.6) and got["q", "zz"]["score"] == pytest.approx(0.2)
    assert got["cold", "b"]["score"] == pytest.approx(0.4)
    narrow = itemitem.Params(shrinkage=0.0, tversky_alpha=1.0, tversky_beta=1.0, neighborhood_size=1)
    assert itemitem.similarity(x, narrow).count() == 0


def test_session_neighbors_by_force_with_copies(spark, monkeypatch):
    """Classes of equal sessions in many small steps, ties and copies that cross the cut."""
    monkeypatch.setattr(sessions, "STEP", 7)
    monkeypatch.setattr(sessions, "ASK", 5)
    rows = [(f"s{n}", f"j{j}", float(w)) for n in range(60) for j, w in ([(n % 4, 0.6), (9, 0.8)] if n % 3 else [(n % 7, 1.0)])]
    v = spark.createDataFrame(rows, "session_id string, job_id string, w double")
    p = replace(sessions.Params(), top_sessions=6)
    vec = {}
    for s, j, w in rows:
        vec.setdefault(s, {})[j] = w
    want = []
    for s, a in vec.items():
        sims = sorted((-round(sum(w * b[j] for j, w in a.items() if j in b), 9), t) for t, b in vec.items())
        want += [(s, t, -x) for x, t in sims if x < 0][:6]
    near = sessions.neighbors(v, v, p)
    assert sorted(map(tuple, near.collect())) == sorted(want)
    assert near._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1  # no pair of sessions is shuffled


def test_session_neighbors(spark):
    stored = sessions.truncated(log(spark, S1=views("a", "b"), S2=views("a")))
    p = sessions.Params(iuf_exponent=1.0)
    weights = sessions.iuf(stored, p)
    got = table(weights, "job_id")
    assert got["a"]["iuf"] == pytest.approx(0.693147, abs=1e-6) and got["b"]["iuf"] == pytest.approx(0.916291, abs=1e-6)
    near = sessions.neighbors(sessions.vectors(log(spark, q=views("b")), weights), sessions.vectors(stored, weights), p).collect()
    assert [(r["neighbor"], round(r["sim"], 6)) for r in near] == [("S1", 0.797516)]


def test_rating(spark):
    got = factors.ratings(log(spark, s=[("a", "apply")])).first()
    assert got["rating"] == pytest.approx(0.908259, abs=1e-6) and got["events"] == 1


def test_factor_models_score_every_candidate(spark):
    rows = log(spark, s1=views("a", "b", "c"), s2=views("a", "b"), s3=views("c", "d"), s4=views("b", "d"))
    rated = factors.ratings(rows)
    cands = spark.createDataFrame([(j,) for j in "abcdz"], "job_id string")
    for build in (lambda r: factors.svd_factors(r, rank=2), lambda r: factors.als_factors(r, rank=2, iterations=2), lambda r: factors.bpr_factors(r, rank=2, epochs=2)):
        got = factors.predict(rows, rows.select("session_id").distinct(), cands, rated, build(rated)).collect()
        assert len(got) == 20 and all(math.isfinite(r["score"]) for r in got)


def test_graph_edges_and_examples(spark):
    rows = log(spark, s=[("x", "view"), ("y", "view"), ("x", "apply"), ("y", "apply")])
    got = table(graph.edges(rows, graph.Params(apply_view_ratio=1.2)), "src", "dst")
    assert got["x", "y"]["w"] == pytest.approx(2.2) and got["y", "x"]["w"] == pytest.approx(1.2)
    last = graph.examples(rows).orderBy(F.col("t").desc()).first()
    assert last["prefix_items"] == ["x", "y", "x"] and last["pos_item"] == "y"
    assert {r["job_id"]: r["alias"] for r in graph.nodes(rows).collect()} == {"x": 0, "y": 1}


def test_graph_encoder_and_sampler():
    import numpy as np

    p = graph.sanitize({"d_model_global": 8, "apply_view_ratio": float("nan")})
    assert p.d_model == 8 and p.apply_view_ratio == graph.Params().apply_view_ratio
    v = graph.Encoder(5, p).encode([1, 2, 1], ["view", "apply", "view"])
    assert np.linalg.norm(v) == pytest.approx(1.0) and not graph.Encoder(5, p).encode([], []).any()
    picked = graph.sample_negatives(np.array([0, 1, 2]), np.full(4, 0.25), 50, 0.8, 1)
    assert picked.shape == (3, 50) and not (picked == np.array([[0], [1], [2]])).any()
    items, acts = graph.collate([[3, 4]], [[1, 2]], 3)
    assert items.tolist() == [[0, 4, 5]] and acts.tolist() == [[0, 1, 2]]


def test_tfidf(spark):
    rows = spark.createDataFrame([("1", "aa bb bb"), ("2", "bb"), ("3", None)], "job_id string, text string")
    got = table(text.tfidf(rows.where("job_id <> '3'"), min_df=1, max_df=1.0, upper=1), "job_id", "term")
    assert got["1", "aa"]["w"] == pytest.approx(0.638711, abs=1e-6) and got["1", "bb"]["w"] == pytest.approx(0.769447, abs=1e-6) and got["2", "bb"]["w"] == 1.0
    assert text.tfidf(rows, min_df=1, upper=2).where("term = 'bb bb'").count() == 1


def test_text_sections_and_cleaning(spark):
    cases = ["TITLE dev SUMMARY builds x", "SUMMARY only", "plain", "a​b__x000D_c  d", None]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in rows.select(text.title_summary(F.col("t"))).collect()] == ["dev [SEP] builds x", "only", "plain", "a b c d", ""]
    assert rows.select(text.clean_punctuation(F.lit("Ça, va! c++"))).first()[0] == "ça va c"


def test_content_scores_fall_back_to_priors(spark):
    rows = log(spark, s1=views("1", "2"), s2=views("3"))
    listings = spark.createDataFrame([("1", "red apple"), ("2", "red apple pie"), ("4", "red apple")], "job_id string, text string")
    cands = spark.createDataFrame([("2",), ("3",), ("4",)], "job_id string")
    for variant in ("TFIDF_WORD", "LSA_TFIDF", "LEXICAL_DENSE_BLEND"):
        for pooling in ("mean", "recency", "max_sim", "last_item"):
            p = content.Params(variant=variant, pooling=pooling, lsa_components=2, min_df=1)
            got = content.predict(rows, rows.select("session_id").distinct(), cands, rows, None, listings, p).collect()
            assert len(got) == 6 and all(math.isfinite(r["score"]) for r in got)
            if variant != "LEXICAL_DENSE_BLEND":
                break


@pytest.mark.parametrize(("pooling", "gram"), [("recency", 2048), ("max_sim", 0)])
def test_blend_is_the_product_of_all_sessions_and_jobs(spark, monkeypatch, pooling, gram):
    """Against every session times every job in numpy; sessions meet classes of jobs in groups of a few."""
    for name, value in (("SESSIONS", 3), ("CLASSES", 4), ("GRAM", gram)):
        monkeypatch.setattr(content, name, value)
    words = ["red", "old", "big", "new", "ring", "bolt", "plate", "gear"]
    rng = random.Random(4)
    texts = {str(k): " ".join(rng.choice(words) for _ in range(1 + k % 4)) for k in range(30)} | {"30": "", "31": "zz unseen"}
    rows = log(spark, **{f"s{n}": [(str((n * 7 + k * k) % 34), "apply" if k % 3 else "view") for k in range(n % 6 + 1)] for n in range(11)})
    listings = spark.createDataFrame(list(texts.items()), "job_id string, text string")
    jobs = sorted({r["job_id"] for r in rows.collect()} | set(texts))
    p = content.Params(pooling=pooling, lsa_components=3, min_df=2)
    known = rows.select("job_id").unionByName(listings.select("job_id"))
    vectors = content.lexical_vectors(content.item_texts(known, listings, p), p)
    candidates = spark.createDataFrame([(j,) for j in [*jobs[::2], "never"]], "job_id string")
    found = content.blended_scores(rows, vectors, known, candidates, p)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["session_id"], r["job_id"]): r["score"] for r in found.collect()}

    cells = vectors.collect()
    at = {t: n for n, t in enumerate(sorted({r["term"] for r in cells}))}
    a = np.zeros((len(jobs), len(at)))
    for r in cells:
        a[jobs.index(r["job_id"]), at[r["term"]]] = r["w"]
    v = a @ np.linalg.svd(a, full_matrices=False)[2][:3].T
    v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    unit = lambda x: np.zeros(len(x)) if np.ptp(x) < 1e-12 else (x - x.min()) / np.ptp(x)
    want, history = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["pos"]):
        if a[jobs.index(r["job_id"])].any():
            history.setdefault(r["session_id"], []).append((jobs.index(r["job_id"]), (p.w_apply if r["action"] == "apply" else p.w_view)))
    for session, items in history.items():
        w = np.array([x * p.recency_decay ** (len(items) - 1 - n) for n, (_, x) in enumerate(items)])
        w, read = w / w.sum(), [j for j, _ in items]
        lexical = (w[:, None] * (a[read] @ a.T)).max(axis=0) if pooling == "max_sim" else w @ a[read] @ a.T
        profile = w @ v[read]
        score = p.blend_alpha_lexical * unit(lexical) + (1 - p.blend_alpha_lexical) * unit(v @ profile / max(np.linalg.norm(profile), 1e-12))
        want |= {(session, j): s for j, s in zip(jobs, score, strict=True) if j in jobs[::2]}
    assert {k: got.get(k, 0.0) for k in want} == pytest.approx(want, abs=1e-7) and set(got) <= set(want) and len(got) > 50


def test_normalisation(spark):
    rows = spark.createDataFrame([("s", j, x) for j, x in zip("abc", (2.0, 4.0, 3.0), strict=True)] + [("t", "a", 5.0), ("t", "b", 5.0), ("u", "a", float("nan"))], "session_id string, job_id string, score double")
    got = {(r["session_id"], r["job_id"]): r["score"] for r in scores.normalize(rows).collect()}
    assert [got["s", j] for j in "abc"] == [0, 1, 0.5] and got["t", "a"] == 0 and got["u", "a"] == 0
    tied = spark.createDataFrame([("s", "a", 3.0), ("s", "b", 1.0), ("s", "c", 3.0), ("t", "a", 9.0)], "session_id string, job_id string, score double")
    got = {(r["session_id"], r["job_id"]): r["score"] for r in scores.normalize(tied, "rank").collect()}
    assert [got["s", j] for j in "abc"] == [1, 0, 0.5] and got["t", "a"] == 1
    with pytest.raises(ValueError):
        scores.normalize(tied, "other")


def test_ensemble_ranks_unseen_first_and_pads(spark):
    rows = log(spark, s=views("a"))
    stacked = ensemble.stack({"m": spark.createDataFrame([("s", "a", 1.0), ("s", "b", 0.5)], "session_id string, job_id string, score double")})
    cands = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "job_id string, cand_rank int")
    every = spark.createDataFrame([("a",), ("d",)], "job_id string")
    got = ensemble.recommend(ensemble.blend(stacked, {"m": 1.0, "off": 0.0}), rows.select("session_id"), rows, cands, every, k=4)
    assert [r["job_id"] for r in got.orderBy("rank").collect()] == ["b", "c", "a", "d"]


def test_hybrid_gates_its_tiers(spark):
    rows = log(spark, s=views("a"))
    chain = spark.createDataFrame([("a", "b", 0.9)], "from_job string, to_job string, prob double")
    near = spark.createDataFrame([("a", "c", 0.5), ("a", "b", 0.1)], "src string, dst string, sim double")
    share = spark.createDataFrame([("a", 0.6), ("d", 0.3), ("e", 0.1)], "job_id string, share double")
    asked = spark.createDataFrame([("s",), ("cold",)], "session_id string")
    got = markov.hybrid_tiers(rows, asked, chain, near, share, k=3).orderBy("rank").collect()
    assert [r["job_id"] for r in got if r["session_id"] == "s"] == ["b", "c", "d"]
    assert [r["job_id"] for r in got if r["session_id"] == "cold"] == ["a", "d", "e"]
    assert [r["job_id"] for r in markov.hybrid_tiers(rows, asked.where("session_id = 's'"), chain, near, share, k=1).collect()] == ["b"]
    assert [r["job_id"] for r in markov.text_only(rows, near).orderBy("rank").collect()] == ["c", "b"]


def test_logistic_matches_newton(spark):
    import numpy as np

    data = [(str(k), k % 5, "apply" if (k * 7) % 10 > 2 * (k % 5) else "view") for k in range(200)]
    features = spark.createDataFrame([(s, v) for s, v, _ in data], "session_id string, trail_view long")
    model = action.fit_logistic(features, spark.createDataFrame([(s, "x", a) for s, _, a in data], "session_id string, job_id string, action string"))
    x, y, w = np.array([[v, 1.0] for _, v, _ in data]), np.array([float(a == "apply") for *_, a in data]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        penalty = np.diag([1.0, 0.0])
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    assert [model.coefficients[0], model.intercept] == pytest.approx(list(w), abs=1e-4)


@given(st.dictionaries(st.text("abc", min_size=1), st.floats(-5, 5), max_size=4))
@settings(max_examples=50, deadline=None)
def test_weights_are_a_simplex(weights):
    got = scores.simplex(weights)
    assert not weights or (sum(got.values()) == pytest.approx(1) and min(got.values()) >= 0)


def test_results_do_not_depend_on_partitions(spark):
    rows = log(spark, **{f"s{k}": views(*[str((k * j) % 7) for j in range(1, 6)]) for k in range(30)})
    a, b = (sorted(map(tuple, markov.transitions(r).collect())) for r in (rows.repartition(7), rows.coalesce(1).orderBy(F.rand(3))))
    assert a == b
    sums = {}
    for f, _, _, p in a:
        sums[f] = sums.get(f, 0) + p
    assert all(v == pytest.approx(1) for v in sums.values())


def test_terms_are_not_broadcast_and_vectors_are_made_once(spark, tmp_path):
    """The counts of terms are guessed from the listings' small file; neighbours hold the plan of the vectors once."""
    spark.createDataFrame([(str(n), f"w{n % 7} x{n % 5} y") for n in range(70)], "job_id string, text string").write.parquet(str(tmp_path / "listings"))
    vectors = text.tfidf(spark.read.parquet(str(tmp_path / "listings")), min_df=3, max_df=1.0, max_features=None, sublinear=False)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(vectors)
    near = text.neighbors(vectors, 5)
    optimized = near._jdf.queryExecution().optimizedPlan()
    assert not [n for n in optimized.collectLeaves().mkString("|").split("|") if "parquet" in n and "InMemoryRelation" not in n]
    assert near.count() > 0


def test_text_neighbors_compare_classes_of_copies(spark, monkeypatch):
    words = [("a b", 9), ("a c", 3), ("b c d", 1), ("d e", 7), ("q", 2)]
    listings = [(f"{k}{n}", t) for k, (t, copies) in enumerate(words) for n in range(copies)]
    vectors = [(j, w, 1 / math.sqrt(len(t.split()))) for j, t in listings for w in t.split()]
    met = []
    pairs = text._pairs
    monkeypatch.setattr(text, "_pairs", lambda a, b, name: met.append((a, b)) or pairs(a, b, name))
    got = text.neighbors(spark.createDataFrame(vectors, "job_id string, term string, w double"), 4, 5)
    want = []
    for j, t in listings:
        sims = sorted((-round(len(set(t.split()) & set(u.split())) / math.sqrt(len(t.split()) * len(u.split())), 6), i) for i, u in listings if i != j)
        want += [(j, i, -s, n + 1) for n, (s, i) in enumerate([x for x in sims if x[0] < 0][:4])]
    assert sorted((r["src"], r["dst"], r["sim"], r["rank"]) for r in got.collect()) == sorted(want)
    assert all(x.select("job_id").distinct().count() <= len(words) for x in met[0])


def test_adagrad_step_touches_its_rows_only():
    side, pace, index, slope = np.zeros((4, 2)), np.full((4, 2), 1e-8), np.array([2, 0, 2]), np.array([[1.0, 2.0], [3.0, 0.0], [1.0, -1.0]])
    pace[[1, 3]] = np.nan  # would spread to a row that is looked at
    factors.climb(side, pace, index, slope, 0.5)
    assert side[2].tolist() == pytest.approx([0.5, 0.5]) and side[0].tolist() == pytest.approx([0.5, 0.0]) and not side[[1, 3]].any()


def test_item_item_sessions_meet_few_places(spark):
    """One long session must not lengthen what every other one meets."""
    rows = [("long", f"j{k:02}", "view", k) for k in range(40)] + [(f"s{n}", f"j{n % 5:02}", "view", 0) for n in range(20)]
    history = spark.createDataFrame(rows, "session_id string, job_id string, action string, pos long")
    x = itemitem.session_item_weights(history, None)
    asked = history.select("session_id").distinct()
    recs = itemitem.recommend(history, asked, x, itemitem.similarity(x), 3)
    assert "explode(sequence(1" in recs._jdf.queryExecution().optimizedPlan().toString()  # places, not every session times the head
    every = itemitem.predict(history, asked, history.select("job_id"), x, itemitem.similarity(x)).collect()
    seen = {(r[0], r[1]) for r in rows}
    want = []
    for s in sorted({r[0] for r in rows}):
        best = sorted((-r["score"], r["job_id"]) for r in every if r["session_id"] == s and (s, r["job_id"]) not in seen) if s in ("long", "s0", "s7") else []
        want += [(s, n + 1, j) for n, (_, j) in enumerate(best[:3])]
    got = [(r["session_id"], r["rank"], r["job_id"]) for r in recs.collect() if r["session_id"] in ("long", "s0", "s7")]
    assert sorted(got) == sorted(want)


def test_markov_rankers_shuffle_lists_not_transitions(spark):
    rows = log(spark, **{f"s{n}": views(*[str((n * j * j + j) % 9) for j in range(1, 3 + n % 5)]) for n in range(40)}, long=views(*[str(k % 9) for k in range(30)]))
    history, truth = schema.split_last(rows)
    trans = markov.transitions(history)
    popular = markov.popular_jobs(trans)
    scored = markov.session_scores(history, trans, recency=True)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate posexplode")]  # the first is the last operator
    swept = {r["k"]: r["mrr"] for r in markov.k_sweep(history, truth, trans, popular).collect()}
    for k in (1, 3, 5, 7, 10):
        recs = markov.recommend_session(history, truth, trans, popular, last=k, recency=True)
        assert swept[k] == metrics.mrr(recs, truth).first()["mrr"]


def test_hybrid_and_padding_keep_one_row_a_session(spark):
    rows = log(spark, **{f"s{n}": views(*[f"j{(n * j) % 11}" for j in range(1, 2 + n % 6)]) for n in range(30)})
    share, asked = markov.job_share(rows), rows.select("session_id").unionByName(spark.createDataFrame([("cold",)], "session_id string")).distinct()
    chain = markov.transitions(rows).select("from_job", "to_job", "prob")
    got = markov.hybrid_tiers(rows, asked, chain, None, share, k=4, gate=500)
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()
    seen, order = {}, [r["job_id"] for r in share.orderBy(F.col("share").desc(), "job_id").collect()]
    for r in rows.collect():
        seen.setdefault(r["session_id"], set()).add(r["job_id"])
    few = spark.createDataFrame([("s3", 1, "j10"), ("cold", 1, "j1")], "session_id string, rank int, job_id string")
    padded = {}
    for r in markov.pad(few, asked, share, rows, 4).orderBy("session_id", "rank").collect():
        padded.setdefault(r["session_id"], []).append(r["job_id"])
    for s in [*seen, "cold"]:
        own = {"s3": ["j10"], "cold": ["j1"]}.get(s, [])
        assert padded.get(s, []) == (own + [j for j in order if j not in seen.get(s, set()) | set(own)])[:4]


def test_item_item_lists_are_unfolded_in_the_sessions_task(spark):
    """A job's neighbours are shuffled as one list, no scored job of a session is; repeated and unknown jobs, sessions without history."""
    rows = [(f"s{n:02}", f"j{(n * k * k + k) % 11:02}", ("view", "apply")[(n + k) % 2], k) for n in range(30) for k in range(1 + n % 6)]
    log_ = spark.createDataFrame(rows, "session_id string, job_id string, action string, pos long")
    x = itemitem.session_item_weights(log_.where("session_id < 's25'"), None)
    asked = log_.select("session_id").distinct().unionByName(spark.createDataFrame([("new",)], "session_id string"))
    sim = itemitem.similarity(x).persist()
    recs = itemitem.recommend(log_, asked, x, sim, 3)
    plan = recs._jdf.queryExecution().executedPlan().toString()
    assert "cells" in plan and not [line for line in plan.splitlines() if "Exchange hashpartitioning(session_id" in line and "job_j" in line]
    every = itemitem.predict(log_, asked, x.select("job_id"), x, sim).collect()
    seen, want = {(r[0], r[1]) for r in rows}, []
    for s in sorted({r["session_id"] for r in every}):
        best = sorted((-round(r["score"], 12), r["job_id"]) for r in every if r["session_id"] == s and (s, r["job_id"]) not in seen)
        want += [(s, n + 1, j) for n, (_, j) in enumerate(best[:3])]
    assert sorted((r["session_id"], r["rank"], r["job_id"]) for r in recs.collect()) == sorted(want)
