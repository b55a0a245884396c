"""The pipeline's stages, each on what the stage before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DIR).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert [n for n, *_ in stages] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_labelled_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    _, before, after = stages[0]
    clean = before.join(labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id")
    assert clean.count() > 0 and clean.join(after, "doc_id", "left_anti").count() <= 0.03 * clean.count()


def test_line_dedup_keeps_rows_and_follows_lengths(stages):
    _, before, after = stages[1]
    assert before.count() == after.count()
    assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0


def test_near_dedup_leaves_one_of_each_group(stages):
    from test_llm import groups_by_force

    _, before, after = stages[2]
    rows = sorted(map(tuple, before.select("doc_id", "text").collect()))
    kept = [rows[k][0] for k, _, _, first in groups_by_force([t for _, t in rows], 80) if first]
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == kept


def test_mixing_takes_half_as_much_again(stages):
    from trailrank.llm.mixing import word_count

    _, before, after = stages[3]
    words = lambda df: df.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert words(after) == pytest.approx(1.5 * words(before), rel=0.01)


def test_packing_covers_every_document(stages):
    _, before, after = stages[4]
    sums = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert sums.select("doc_id").exceptAll(before.select("doc_id").distinct()).count() == 0
    assert sums.count() == before.select("doc_id").distinct().count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, DIR).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[4][2].select(columns).collect()))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty, blank and very long texts, repeated rows, and columns with the stages' own names."""
    import random

    from test_llm import prose

    rng = random.Random(5)
    common = "a line that many documents hold"
    rows = [(k, f"{prose(rng, 60)}\n{common}\n{prose(rng, 20)}", ["a", "b", None][k % 3]) for k in range(30)]
    near = prose(rng, 90)
    rows += [(3, near, "a"), (5, rows[4][1], "a"), (5, near + " more", "a"), (5, near + " more", "a"), (None, near, "b"), (None, near, "b")]
    rows += [(40, None, "a"), (41, "", "b"), (42, " \n\t", None), (43, prose(rng, 40_000), "b"), (44, None, None), (44, None, None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    named = ["text_hash", "_size", "_hash", "score", "n_lines", "n_dropped", "copies", "node", "hits", "id_key", "Member"]
    return docs.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(-1))) for c in named})


def _rows(df):
    from collections import Counter

    return Counter(map(tuple, df.select(sorted(df.columns)).collect()))


def test_quality_stage_keeps_rows_as_they_are(spark, odd):
    after = corpus_pipeline.filter_quality(spark, odd, DIR)
    assert after.columns == odd.columns and _rows(after) <= _rows(odd)
    assert corpus_pipeline.filter_quality(spark, odd.limit(0), DIR).count() == 0


def test_line_stage_changes_texts_only(spark, odd):
    after = corpus_pipeline.dedup_lines(spark, odd, DIR)
    assert after.columns == odd.columns and after.count() == odd.count()
    assert after.where("text LIKE '%a line that many%' OR text IS NULL OR n_chars <> char_length(text)").count() == 0
    others = [c for c in odd.columns if c not in ("text", "n_chars")]
    assert _rows(after.select(others)) == _rows(odd.select(others))
    assert corpus_pipeline.dedup_lines(spark, odd.limit(0), DIR).count() == 0


def test_near_dedup_stage_judges_rows_by_their_texts(spark, odd):
    from test_llm import groups_by_force

    after = corpus_pipeline.dedup_documents(spark, odd, DIR)
    assert after.columns == odd.columns
    rows = sorted({(r["doc_id"], r["text"]) for r in odd.where("doc_id IS NOT NULL").collect()}, key=lambda r: (r[0], r[1] or ""))
    want = {rows[k] for k, *_, first in groups_by_force([t for _, t in rows], 80) if first}
    got = [tuple(r) for r in after.where("doc_id IS NOT NULL").select("doc_id", "text").collect()]
    assert sorted(i for i, _ in got) == sorted(i for i, _ in want) and len(got) == len(set(got))
    assert {r for r in got if r[0] != 3} == {r for r in want if r[0] != 3}
    twice = odd.unionAll(odd.where("doc_id = 6").withColumn("text", F.concat("text", F.lit(" more"))))
    assert corpus_pipeline.dedup_documents(spark, twice, DIR).where("doc_id = 6").count() == 1
    assert _rows(after.where("doc_id IS NULL")) == _rows(odd.where("doc_id IS NULL"))
    assert corpus_pipeline.dedup_documents(spark, odd.limit(0), DIR).count() == 0


def test_mixing_stage_takes_rows_as_they_are(spark, odd):
    from trailrank.llm import mixing

    after = corpus_pipeline.mix_sources(spark, odd, DIR)
    decided = mixing.mix(odd).groupBy("source").agg(F.sum("taken").alias("n"), F.sum("copies").alias("k"))
    taken = after.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"), F.count(F.lit(1)).alias("k"))
    assert after.columns == odd.columns and _rows(taken) == _rows(decided) and set(_rows(after)) <= set(_rows(odd))
    assert after.where("doc_id IS NULL").count() > 0
    assert corpus_pipeline.mix_sources(spark, odd.limit(0), DIR).count() == 0


def test_packing_stage_takes_every_row(spark, odd):
    after = corpus_pipeline.pack_sequences(spark, odd, DIR)
    assert after.where("start = 0").count() == odd.count()
    assert corpus_pipeline.pack_sequences(spark, odd.limit(0), DIR).count() == 0
