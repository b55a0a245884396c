"""SimHash fingerprints, and all fingerprints within a Hamming radius.

Terms are a text's distinct words and word pairs, weighed 1 + ln(count). Each
term's 128-bit hash votes with its weight, for or against, on each bit of the
fingerprint. Votes are tallied per hash byte, so a text costs one weighted
histogram rather than 128 additions a term.

All fingerprints within ``radius`` of queries are found by permuted block tables:
of ``radius + prefix`` blocks at least ``prefix`` agree wherever at most ``radius``
bits differ, so every choice of ``prefix`` blocks makes one table, keyed by those
blocks' bits. ``near_pairs`` lists the pairs, ``near_counts`` counts them without
making rows of pairs: a table's key meets its queries in blocks of bounded size,
and a pair counts in the first table that holds it.

``fingerprint_edits`` needs each document's successor. Rows are range-dealt by
descending id and read in order with one document in hand; only the documents at
the partitions' edges meet in a second step, each by the number of its partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailrank.llm import _text
from trailrank.llm._store import cut

BITS = 128
PREFIX = 2
#: Fingerprints of one key that meet the key's queries in one task.
KEY_BLOCK = 50_000
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2) - 1
_PLACES = (np.arange(BITS // 8) * 256)[None, :]
_OTHER = np.uint64(0xA0761D6478BD642F)


def _fingerprint(words: np.ndarray) -> np.ndarray:
    """The fingerprint of a text's word hashes as 16 bytes; all zero without words."""
    if not len(words):
        return np.zeros(BITS // 8, np.uint8)
    pairs = _text.mix(words[:-1] * np.uint64(3) + words[1:])
    terms, counts = np.unique(np.concatenate([words, pairs]), return_counts=True)
    hashes = np.stack([_text.mix(terms ^ _OTHER), _text.mix(terms + _OTHER)], axis=1).view(np.uint8)
    weights = np.repeat(1 + np.log(counts), BITS // 8)
    tally = np.bincount((hashes + _PLACES).ravel(), weights, BITS // 8 * 256).reshape(BITS // 8, 256)
    return np.packbits(np.round(tally @ _SIGNS, 6) > 0, axis=1)[:, 0]


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(texts, 16) bytes; null counts as empty."""
    raw, offs = _text.text_buffers(texts)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for first, _, part, part_offs in _text.chunks(raw, offs):
        words, bounds = _text.hash_words(part, part_offs)
        for k in range(len(part_offs) - 1):
            out[first + k] = _fingerprint(words[bounds[k] : bounds[k + 1]])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - Hamming distance / bits, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def fingerprint(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row, as 32 hexadecimal digits; a null or empty text has all bits 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [x.tobytes().hex() for x in fingerprints(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(marks, pa.string())], ["doc_id", "fingerprint"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


_DONE = pa.schema([("part", pa.int32()), ("edge", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_DONE_DDL = "part int, edge int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _judged(part: int, ids: list, texts: list[str], marks: np.ndarray, after: list[str], after_marks: np.ndarray) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)]
    new = fingerprints(pa.array(edited, pa.large_string()))
    n = len(ids)
    columns = [[part] * n, [None] * n, ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [x.tobytes().hex() for x in marks], [x.tobytes().hex() for x in new], likeness(marks, new), likeness(marks, after_marks), [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _DONE, strict=True)], schema=_DONE)


def _edge(part: int, edge: int, doc_id, text: str, mark: np.ndarray) -> pa.RecordBatch:
    row = [part, edge, doc_id, None, None, mark.tobytes().hex(), None, None, None, text]
    return pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(row, _DONE, strict=True)], schema=_DONE)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge each row by the next; the partition's first (edge 0) and last (edge 1) rows are passed on with their texts."""
    context = TaskContext.get()
    part, held = context.partitionId() if context else 0, None
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            ids, texts, marks = batch["doc_id"].to_pylist(), [t or "" for t in batch["text"].to_pylist()], fingerprints(batch["text"])
            if held is None:
                yield _edge(part, 0, ids[0], texts[0], marks[0])
            else:
                ids, texts, marks = [held[0], *ids], [held[1], *texts], np.concatenate([held[2][None], marks])
            if len(ids) > 1:
                yield _judged(part, ids[:-1], texts[:-1], marks[:-1], texts[1:], marks[1:])
            held = (ids[-1], texts[-1], marks[-1])
    if held is not None:
        yield _edge(part, 1, *held)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            marks, after_marks = (np.array([np.frombuffer(bytes.fromhex(x), np.uint8) for x in batch[c].to_pylist()]) for c in ("fingerprint", "next_fingerprint"))
            yield _judged(0, batch["doc_id"].to_pylist(), batch["text"].to_pylist(), marks, batch["next_text"].to_pylist(), after_marks)


def fingerprint_edits(documents: DataFrame, partitions: int | None = None, radius: int = 3, every: int = 50) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) for every row.

    The edited text is the text with its last floor(n/2) code points replaced by
    as many, or all, of the first of the next document in descending doc_id; the
    first follows the last. Null texts are empty, null ids come last, rows with
    one id follow in order of the text's hash. A single row follows itself.
    ``n_near`` is, for rows whose id is divisible by ``every``, the number of
    other rows with fingerprints within ``radius`` bits, else null. Extra columns
    are ignored; an empty table gives no rows.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark"), F.col("n")]  # rows with one id are spread as well
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    done = cut(dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_in_order, _DONE_DDL), "fingerprints")
    heads = done.where("edge = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    numbers = done.where("edge = 0").select("part")  # one number a partition
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0))))
    last = done.where("edge = 1").select("part", "doc_id", "text", "fingerprint").join(numbers.select("part", after.alias("next_part")), "part").join(heads, "next_part")
    last = last.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_at_edges, _DONE_DDL)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out = cut(done.where("edge IS NULL").select(names).unionByName(last.select(names)), "edits")
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    near = near_counts(out.where(asks).select("fingerprint"), out.select("fingerprint"), radius)
    asked = out.where(asks).join(near.hint("merge"), "fingerprint").select(*names, (F.col("n_near") - 1).alias("n_near"))
    return asked.unionByName(out.where(~asks).withColumn("n_near", F.lit(None).cast("long")))


def _table_masks(radius: int, prefix: int) -> np.ndarray:
    """(tables, 2) words with ones at the bits of each table's blocks."""
    ends = [round(BITS * k / (radius + prefix)) for k in range(radius + prefix + 1)]
    bits = np.zeros((radius + prefix, BITS), np.uint8)
    for k in range(radius + prefix):
        bits[k, ends[k] : ends[k + 1]] = 1
    tables = np.array([bits[list(t)].max(axis=0) for t in combinations(range(radius + prefix), prefix)])
    return np.packbits(tables, axis=1).view(np.uint64)


_KEYED = pa.schema([("table", pa.int32()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _into_tables(masks: np.ndarray):
    """A row for each table: its key and the fingerprint's two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.frombuffer(bytes.fromhex("".join(batch["fingerprint"].to_pylist())), np.uint64).reshape(-1, 2)
            for table, mask in enumerate(masks):
                held = marks & mask
                key = _text.mix(_text.mix(held[:, 0]) + held[:, 1])
                columns = [np.full(len(marks), table, np.int32), key.view(np.int64), marks[:, 0].view(np.int64), marks[:, 1].view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch["n"]], schema=_KEYED)

    return run


def _count_near(radius: int, masks: np.ndarray):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_near", pa.int64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        table = asked["table"][0].as_py()
        words = lambda t: np.stack([t[c].to_numpy().view(np.uint64) for c in ("a", "b")], axis=1)
        one, two, times = words(asked), words(held), held["n"].to_numpy()
        counts = np.zeros(len(one), np.int64)
        step = max(1, (1 << 21) // len(two))
        for at in range(0, len(one), step):
            off = one[at : at + step, None] ^ two[None]
            near = np.bitwise_count(off).sum(axis=2) <= radius
            near &= ~(off & masks[table]).any(axis=2)
            for before in masks[:table]:  # an earlier table has counted it
                near &= (off & before).any(axis=2)
            counts[at : at + step] = near @ times
        some = np.flatnonzero(counts)
        return pa.table([asked["a"].take(pa.array(some)), asked["b"].take(pa.array(some)), pa.array(counts[some])], schema=schema)

    return run


def near_counts(queries: DataFrame, all_rows: DataFrame, radius: int = 3, prefix: int = 1) -> DataFrame:
    """(fingerprint, n_near): for each distinct query fingerprint the rows of ``all_rows`` within ``radius`` bits, equal ones included.

    Both tables have a column fingerprint of 32 hexadecimal digits; nulls are
    ignored. Repeats of a fingerprint are counted before they are dealt to tables,
    and the fingerprints of one key meet its queries in blocks, so that neither
    copies nor a crowded key land in one task. Queries without a row within the
    radius have no row.
    """
    masks = _table_masks(radius, prefix)
    ddl = "table int, key long, a long, b long, n long"
    tally = lambda df: df.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    asked = cut(tally(queries).mapInArrow(_into_tables(masks), ddl).drop("n"), "asked")
    wanted = asked.select("table", "key").distinct()
    held = cut(tally(all_rows).mapInArrow(_into_tables(masks), ddl).join(wanted.hint("merge"), ["table", "key"], "left_semi"), "held")
    blocks = held.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / KEY_BLOCK).cast("int").alias("blocks"))
    dealt = held.join(blocks.hint("merge"), ["table", "key"]).withColumn("block", F.pmod(F.xxhash64("a", "b"), "blocks").cast("int")).drop("blocks")
    copies = asked.join(blocks.hint("merge"), ["table", "key"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["table", "key", "block"]
    counted = copies.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_count_near(radius, masks), "a long, b long, n_near long")
    word = lambda c: F.concat(*[F.substring(F.lower(F.lpad(F.hex(c), 16, "0")), 15 - 2 * k, 2) for k in range(8)])
    return counted.groupBy("a", "b").agg(F.sum("n_near").alias("n_near")).select(F.concat(word("a"), word("b")).alias("fingerprint"), "n_near")


def _tables(radius: int) -> list[tuple[int, ...]]:
    return list(combinations(range(radius + PREFIX), PREFIX))


def _keys(radius: int) -> F.Column:
    """For each table its number and the bits of its blocks."""
    bits = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(BITS // 32)])
    ends = [round(BITS * k / (radius + PREFIX)) for k in range(radius + PREFIX + 1)]
    block = lambda b: F.substring(bits, ends[b] + 1, ends[b + 1] - ends[b])
    return F.array(*[F.xxhash64(F.lit(n), *[block(b) for b in table]) for n, table in enumerate(_tables(radius))])


def near_pairs(queries: DataFrame, all_rows: DataFrame, radius: int = 6) -> DataFrame:
    """(fingerprint, near_fingerprint, distance): all distinct pairs within ``radius`` bits, the equal one included.

    Both tables have a column fingerprint of 32 hexadecimal digits; nulls are
    ignored and repeats count once. Every table's bucket is joined whole: no
    partner is dropped.
    """
    if not 0 <= radius <= 14:
        raise ValueError("radius must be between 0 and 14")
    one = queries.select("fingerprint").where("fingerprint IS NOT NULL").distinct().withColumn("key", F.explode(_keys(radius)))
    two = all_rows.select("fingerprint").where("fingerprint IS NOT NULL").distinct().withColumn("key", F.explode(_keys(radius))).withColumnRenamed("fingerprint", "near_fingerprint")
    half = lambda c, k: F.conv(F.substring(c, 1 + 8 * k, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(half("fingerprint", k).bitwiseXOR(half("near_fingerprint", k))) for k in range(BITS // 32)), F.lit(0))
    return one.join(two, "key").withColumn("distance", distance).where(F.col("distance") <= radius).select("fingerprint", "near_fingerprint", "distance").distinct()
