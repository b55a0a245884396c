"""Corpus pipeline: quality filter, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. A stage works on everything that its predecessor
kept. SQL cannot express the classifier, so the rows have no oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailrank.llm import linededup, minhash, mixing, packing, quality
from trailrank.llm._store import cut, fresh

#: Documents whose quality score is lower are rejected.
LEAST_QUALITY = 0.5


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte classifier scores at ``LEAST_QUALITY`` or more.

    Null and empty texts are scored like others, as are rows with null or repeated
    ids. All columns come back as they are, also one named ``score``.
    """
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (name,) = fresh(docs.columns, "score")
    return quality.score(docs, net, name=name).where(F.col(name) >= LEAST_QUALITY).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that 10 documents or more hold; n_chars follows.

    Every row stays, each counting as a document of its own; a null text comes back
    empty. Other columns come back as they are.
    """
    names = tuple(fresh(docs.columns, "n_lines", "n_dropped"))
    return _with_length(linededup.dedup_lines(docs, names=names).select(docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more): the one with the least id.

    Of rows with equal ids and texts one stays; rows with equal ids and unlike texts
    are documents of their own, the one with the lesser hash of its text before the other. Rows with a null id, and null, empty and blank
    texts, are near nothing: all of those with a null id stay, and one row of each
    id without words. Other columns come back as they are.
    """
    doc_id, mark, member = fresh(docs.columns, "id_key", "text_key", "member")
    found = minhash.near_duplicates(docs, percent=80, with_hash=True).where("first AND doc_id IS NOT NULL")
    kept = found.select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(mark)).distinct()
    keyed = docs.withColumns({doc_id: F.col("doc_id").cast("long"), mark: F.xxhash64("text")})
    # A merge join at every size, as the ids grow with the documents; one row stays of each key without another shuffle.
    out = keyed.where(F.col(doc_id).isNotNull()).join(kept.hint("merge"), [doc_id, mark], "left_semi")
    out = out.groupBy(doc_id, mark).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(member)).select(f"{member}.*")
    return out.unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source targets take them.

    A null source is a source of its own; rows with null or repeated ids count like
    others. Texts without words are taken no times. Columns come back as they are.
    """
    return _with_length(mixing.apply_mix(docs, mixing.mix(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the packed sequences, of every row; a null text is its end token alone."""
    return packing.pack(docs)


STAGES = [("quality", filter_quality), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("mixing", mix_sources), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``, each one's rows written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
