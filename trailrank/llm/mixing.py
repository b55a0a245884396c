"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets: a share of all words is dealt to the sources by weight; a source stops
at ``cap`` times its size and the excess goes to the others by weight.

Rates: among all document rates r, those that meet every source's word target
and are nearest to 1 in relative entropy (documents weighed by their words) are
r = exp(lambda_source). The dual is convex; Newton steps on it are aggregations
over the (source, size) histogram of the documents joined with the multipliers.

Copies: texts are never cut. A rate's whole part is taken of every document. The
rest is rounded systematically by cumulated words: sizes are gone through from
the longest, each is dealt its share of the words that the source still needs,
and what rounding leaves over goes to the shorter ones. So a source misses its
target by about its shortest documents, or, where one text outweighs all shorter
ones together, by up to about that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailrank.llm._store import cut, fresh

WEIGHTS = (5, 2, 1)
TOLERANCE, MAX_STEPS = 1e-9, 60
#: Rows of one (source, size) that are numbered in one task.
CELL = 1000


def word_count(text: Column) -> Column:
    """Runs of ``[^\\x20\\x09-\\x0D]`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Weights repeat over the sources by code point, null last. Sources without
    words have target 0. The windows below have a row for each source.
    """
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio")
    before = F.coalesce(F.sum("most").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("most").over(Window.partitionBy("ratio")), F.lit(0.0))
    after = F.sum("weight").over(Window.orderBy(F.col("ratio").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    everything = Window.partitionBy(F.lit(0))
    level = (share * F.sum("source_size").over(everything) - before) / after
    levels = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))
    levels = levels.withColumn("water", F.min(fits).over(everything)["level"])
    target = F.when(F.col("water").isNull(), F.col("most")).otherwise(F.least("most", F.col("water") * F.col("weight")))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def balance(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, rate): exp of the multipliers at which sum(n * size * rate) is each source's target.

    ``histogram`` is (source, size, n), ``goals`` (source, target). A source
    without target or words has rate 0.
    """
    state = cut(goals.select("source", "target", F.lit(0.0).alias("dual")), "dual")
    for _ in range(MAX_STEPS):
        both = histogram.join(state, histogram["source"].eqNullSafe(state["source"])).select(state["source"], "size", "n", "target", "dual")
        moment = both.groupBy("source", "target", "dual").agg(F.sum(F.col("n") * F.col("size") * F.exp("dual")).alias("moment"))
        usable = (F.col("moment") > 0) & (F.col("target") > 0)
        step = F.when(usable, F.greatest(F.col("target") / F.col("moment") - 1, F.lit(-1.0)))
        after = cut(moment.select("source", "target", F.when(usable, F.col("dual") + F.least(step, F.lit(1.0))).alias("dual"), F.abs(step).alias("off")), "dual")
        worst = after.agg(F.max("off")).first()[0]
        state = after.select("source", "target", F.coalesce("dual", F.lit(float("-inf"))).alias("dual"))
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("source", F.exp("dual").alias("rate"))


def deal(histogram: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, size, n, more): ``more`` of the ``n`` documents of a size get a copy beyond the whole part of the rate.

    ``plan`` is (source, source_size, target, rate). Documents of one size are
    interchangeable, so a row for each source with its distinct sizes is enough.
    """
    sizes = histogram.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    both = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    left = F.col("target") - F.floor("rate") * F.col("source_size")
    none = F.array().cast("array<struct<size:bigint,n:bigint,more:bigint>>")

    def step(state: Column, cell: Column) -> Column:
        share = F.when(state["words"] > 0, F.least(F.greatest(state["left"] / state["words"], F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        wanted = share * cell["n"] + state["carry"]  # carry is in [-0.5, 0.5), so 0 <= more <= n
        more = F.floor(wanted + 0.5)
        dealt = F.array_append(state["dealt"], F.struct(cell["size"].alias("size"), cell["n"].alias("n"), more.alias("more")))
        words = cell["size"] * cell["n"]
        return F.struct((state["left"] - more * cell["size"]).alias("left"), (state["words"] - words).alias("words"), (wanted - more).alias("carry"), dealt.alias("dealt"))

    start = F.struct(left.cast("double").alias("left"), F.col("source_size").cast("double").alias("words"), F.lit(0.0).alias("carry"), none.alias("dealt"))
    dealt = both.select("source", F.explode(F.aggregate("sizes", start, step)["dealt"]).alias("cell"))
    return dealt.select("source", "cell.size", "cell.n", "cell.more")


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, taken, copies, text_hash) for every row.

    ``taken`` is the number of words the mix takes of the row, repeats counted:
    ``copies`` whole texts, never more than ``cap`` rounded up. A null text has size 0 and takes 0; a
    null source is a source of its own. Repeated rows are documents of their own.
    The choice depends on ids and texts only, so reruns agree. An empty table
    gives no rows.
    """
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = cut(sized, "sized")
    histogram = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    goals = cut(targets(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap), "goals")
    rates = balance(histogram, goals)

    plan = goals.join(rates, goals["source"].eqNullSafe(rates["source"])).select(goals["source"], "source_size", "target", F.least("rate", F.lit(float(cap))).alias("rate"))
    plan = cut(plan, "rates")
    cells = cut(deal(histogram, plan).withColumn("salts", F.ceil(F.col("n") / CELL).cast("int")), "cells")
    keyed = sized.withColumn("mark", F.xxhash64("doc_id", "text_hash", "size"))
    placed = keyed.join(cells, keyed["source"].eqNullSafe(cells["source"]) & (keyed["size"] == cells["size"]))
    placed = placed.select("doc_id", keyed["source"], keyed["size"], "text_hash", "mark", "more", F.pmod("mark", "salts").cast("int").alias("salt"))
    placed = cut(placed, "placed")
    salted = placed.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = cut(salted.withColumn("earlier", F.coalesce(F.sum("m").over(earlier), F.lit(0))), "salted")
    in_cell = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("mark", "doc_id", "text_hash"))
    numbered = placed.withColumn("place", in_cell)
    joined = numbered.join(salted, numbered["source"].eqNullSafe(salted["source"]) & (numbered["size"] == salted["size"]) & (numbered["salt"] == salted["salt"]))
    joined = joined.select("doc_id", numbered["source"], numbered["size"], "text_hash", (F.col("earlier") + F.col("place") <= F.col("more")).alias("again"))
    out = joined.join(plan, joined["source"].eqNullSafe(plan["source"])).select("doc_id", joined["source"], "size", "source_size", "target", "rate", "text_hash", "again")

    copies = F.floor("rate") + F.col("again").cast("int")
    out = out.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "taken", "copies", "text_hash")


def apply_mix(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``documents`` as often as ``mixed`` takes them, texts and other columns unchanged.

    Rows are matched by id, source and text, and nulls match nulls. Rows equal in
    all three share their copies as evenly as whole copies allow. Columns may have
    any names. Null and empty texts are taken no times; an empty table gives no rows.
    """
    names = documents.columns
    doc_id, source, mark, copies, rows, place, times, copy = fresh(names, "id_key", "source_key", "text_key", "copies", "rows", "place", "times", "copy")
    keys = [doc_id, source, mark]
    decided = mixed.groupBy(F.col("doc_id").alias(doc_id), F.col("source").alias(source), F.col("text_hash").alias(mark))
    decided = cut(decided.agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)).where(f"{copies} > 0"), "decided")
    uneven = decided.where(f"{copies} % {rows} <> 0").limit(1).count()
    keyed = documents.withColumns({doc_id: F.col("doc_id").cast("long"), source: F.col("source").cast("string"), mark: F.xxhash64("text")})
    held = decided.hint("merge")  # at every size alike: both sides grow with the documents
    both = keyed.join(held, keyed[doc_id].eqNullSafe(held[doc_id]) & keyed[source].eqNullSafe(held[source]) & (keyed[mark] == held[mark])).drop(*[held[c] for c in keys])
    often = F.floor(F.col(copies) / F.col(rows))
    if uneven:
        both = both.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*names))))
        often = F.floor(F.col(copies) * F.col(place) / F.col(rows)) - F.floor(F.col(copies) * (F.col(place) - 1) / F.col(rows))
    both = both.withColumn(times, often.cast("int")).where(f"{times} > 0")
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
