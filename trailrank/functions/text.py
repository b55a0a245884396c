"""Listing texts: cleaning, sections, terms, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailrank.functions.schema import dealt

#: Letters whose accents are dropped before tokenising, and what is left of them. Fixed values.
ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěìíîïīįıłñńňòóôõöøōőŕřśšşťțţùúûüūůűųýÿźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
PLAIN = "aaaaaaaaacccddeeeeeeeeiiiiiiilnnnoooooooorrssstttuuuuuuuuyyzzzAAAAAACEEEEIIIINOOOOOOUUUUY"


def clean_basic(text: Column) -> Column:
    """Zero-width spaces and ``_x000D_`` become blanks, white space is collapsed; null becomes empty."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "​", " "), "_+x000D_+", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def clean_punctuation(text: Column) -> Column:
    """Lower case, everything but word characters and white space to blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean_basic(text)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def clean_listing(text: Column) -> Column:
    """As ``clean_punctuation``, but ``-``, ``/`` and ``+`` stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s\-/+]", " "), r"(?U)\s+", " "))


def title_summary(text: Column) -> Column:
    """``title [SEP] summary`` of a text with TITLE and SUMMARY sections; one of them alone; else the text."""
    body = clean_basic(text)
    title = F.trim(F.regexp_extract(body, r"(?is)\btitle\b\s*:?\s*(.*?)\s*(?:\bsummary\b|$)", 1))
    summary = F.trim(F.regexp_extract(body, r"(?is)\bsummary\b\s*:?\s*(.*)$", 1))
    return F.when((title != "") & (summary != ""), F.concat(title, F.lit(" [SEP] "), summary)).when(title != "", title).when(summary != "", summary).otherwise(body)


def preprocess(text: Column, mode: str = "raw") -> Column:
    if mode == "raw":
        return clean_basic(text)
    if mode == "normalized":
        return clean_punctuation(text)
    if mode == "title_summary":
        return clean_punctuation(title_summary(text))
    raise ValueError(f"unknown text mode {mode!r}")


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of two or more letters and numbers of any script and _ in the lower-cased text, Latin accents dropped."""
    return F.regexp_extract_all(fold_accents(F.lower(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(words: Column, upper: int = 2) -> Column:
    """One to ``upper`` adjacent words, joined by blanks."""

    def adjacent(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *[adjacent(n) for n in range(2, upper + 1)])


def tfidf(listings: DataFrame, min_df: int = 2, max_df: float = 0.95, max_features: int | None = 30000, upper: int = 2, sublinear: bool = True) -> DataFrame:
    """(job_id, term, w): unit-length rows of tf * idf, idf = ln((1 + n) / (1 + df)) + 1, tf or 1 + ln(tf).

    Terms need a document frequency between ``min_df`` and ``max_df`` of all
    listings; of more than ``max_features`` the most frequent stay, ties by term.
    Listings without text count in n.
    """
    dealt_once = dealt(listings.select("job_id", "text"), "job_id", times=8)  # terms of a listing are counted and weighed in its task
    counts = dealt_once.select("job_id", F.explode(ngrams(tokens(F.col("text")), upper)).alias("term")).groupBy("job_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    total = listings.agg(F.count(F.lit(1)).alias("n"))
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("all")).crossJoin(F.broadcast(total))
    terms = terms.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    if max_features:
        terms = terms.orderBy(F.col("all").desc(), "term").limit(max_features)
    terms = terms.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = (1 + F.log("tf")) if sublinear else F.col("tf").cast("double")
    # Spark guesses the counts from the listings' file, not from their terms, so it would send all of them to every task.
    raw = counts.join(F.broadcast(terms) if max_features and max_features <= 100_000 else terms.hint("merge"), "term").select("job_id", "term", (tf * F.col("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("job_id")))
    return raw.select("job_id", "term", (F.col("x") / norm).alias("w"))


#: Terms in more listings are common: pairs of listings that share only such terms are scored where they may rank.
COMMON_DF = 1000


def _pairs(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    left, right = a.select(F.col("job_id").alias("src"), "term", F.col("w").alias("wa")), b.select(F.col("job_id").alias("dst"), "term", F.col("w").alias("wb"))
    return left.join(right, "term").where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias(name))


def neighbors(vectors: DataFrame, top_n: int = 50, common_df: int = COMMON_DF) -> DataFrame:
    """(src, dst, sim, rank): the nearest other listings by cosine, those that share a term; ties to the smaller id.

    Listings with the same vector are one class, named by its smallest id; only
    classes are compared. A listing's ``top_n`` others lie in its own class and in
    the first ``top_n`` other classes, ordered by similarity and smallest id, and
    are among the first ``top_n`` + 1 of each. What is read more than once is kept,
    so a plan holds the steps before it once.
    """
    vectors = vectors.persist()
    packed = vectors.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("term", F.round("w", 12).alias("w")))).alias("cells"))
    same = Window.partitionBy("cells")
    at = F.row_number().over(same.orderBy("job_id"))
    listed = packed.select("job_id", F.min("job_id").over(same).alias("class"), at.alias("at"), F.count(F.lit(1)).over(same).alias("size"), "cells").persist()
    first = listed.where("at = 1").select("job_id")
    apart = class_neighbors(vectors.join(first, "job_id", "left_semi"), top_n, common_df).select(F.col("src").alias("class"), F.col("dst").alias("near"), "sim")
    # A class that k listings of nearer classes precede gives none of the k best.
    sizes = listed.where("at = 1").select("class", "size", F.round(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["w"] * c["w"]), 6).alias("sim"))
    own = sizes.select("class", F.col("class").alias("near"), "sim", (F.col("size") - 1).alias("size"))
    met = apart.join(sizes.select(F.col("class").alias("near"), "size"), "near").select("class", "near", "sim", "size").unionByName(own)
    nearer = Window.partitionBy("class").orderBy(F.col("sim").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.sum("size").over(Window.partitionBy("class", "sim"))
    met = met.withColumn("_before", F.sum("size").over(nearer) - level).where(F.col("_before") < top_n)
    members = listed.where(F.col("at") <= top_n + 1).select(F.col("class").alias("near"), F.col("job_id").alias("dst"), "at")
    order = Window.partitionBy("class").orderBy(F.col("sim").desc(), "dst")
    shared = met.join(members, "near").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n + 1)
    lists = shared.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("place", "dst", "sim"))).alias("list"))
    # one's own place is left out; a member behind the list's end was not in it
    others = listed.select(F.col("job_id").alias("src"), "class").join(lists, "class").select("src", F.slice(F.filter("list", lambda x: x["dst"] != F.col("src")), 1, top_n).alias("list"))
    return others.select("src", F.posexplode("list").alias("rank", "x")).select("src", F.col("x.dst").alias("dst"), F.col("x.sim").alias("sim"), (F.col("rank") + 1).alias("rank"))


def class_neighbors(vectors: DataFrame, top_n: int = 50, common_df: int = COMMON_DF) -> DataFrame:
    """(src, dst, sim, rank): ``neighbors`` of listings whose vectors differ.

    Weights are not negative, so what common terms can add to a pair is at most the
    product of the two listings' norms on them. Pairs that share a rarer term are
    scored on those terms first; those that the common terms may lift into the
    ``top_n`` are scored exactly. A listing whose last place stays within reach of
    pairs without a rarer term, which is rare, meets all listings by all terms.
    """
    vectors = vectors.persist()
    df = vectors.groupBy("term").agg((F.count(F.lit(1)) > common_df).alias("common"))
    marked = vectors.join(df, "term")
    rare, common = marked.where("NOT common"), marked.where("common")
    parts = common.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).persist()
    most = parts.agg(F.coalesce(F.max("norm"), F.lit(0.0)).alias("most"))
    side = lambda c, m, n: parts.select(F.col("job_id").alias(c), F.col("m").alias(m), F.col("norm").alias(n))
    # a fixed number of tasks: few bytes of terms make many pairs
    rare = rare.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "term")
    near = _pairs(rare, rare, "part").join(side("src", "ma", "na").drop("ma"), "src", "left").join(side("dst", "mb", "nb").drop("mb"), "dst", "left").na.fill(0.0, ["na", "nb"])
    at = F.row_number().over(Window.partitionBy("src").orderBy(F.col("part").desc()))
    last = F.max(F.when(F.col("at") == top_n, F.col("part"))).over(Window.partitionBy("src"))
    slack = 2e-6  # similarities are rounded before they are ranked
    near = near.withColumn("at", at).withColumn("last", F.coalesce(last, F.lit(0.0))).where(F.col("part") + F.col("na") * F.col("nb") + slack >= F.col("last"))
    both = near.select("src", "dst", "part").join(side("src", "ma", "na").drop("na"), "src", "left").join(side("dst", "mb", "nb").drop("nb"), "dst", "left")
    shared = F.aggregate(F.map_entries("ma"), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at("mb", e["key"]), F.lit(0.0)))
    exact = both.select("src", "dst", F.round(F.col("part") + F.coalesce(shared, F.lit(0.0)), 6).alias("sim"))
    order = Window.partitionBy("src").orderBy(F.col("sim").desc(), "dst")
    ranked = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).persist()
    ends = ranked.groupBy("src").agg(F.max("rank").alias("have"), F.min("sim").alias("end"))
    reach = parts.select(F.col("job_id").alias("src"), "norm").crossJoin(F.broadcast(most)).join(ends, "src", "left")
    short = (F.coalesce("have", F.lit(0)) < top_n) | (F.col("norm") * F.col("most") + slack >= F.col("end"))
    again = reach.where(short).select("src")
    full = _pairs(vectors.join(again.withColumnRenamed("src", "job_id"), "job_id", "left_semi"), vectors, "sim").withColumn("sim", F.round("sim", 6))
    full = full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return ranked.join(again, "src", "left_anti").select("src", "dst", "sim", "rank").unionByName(full.select("src", "dst", "sim", "rank"))
