"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

State is two written tables. ``counts`` has, for each line key, the number of
documents that hold it (key hash of 128 bits, hash-sharded). ``filters`` has one
cuckoo filter for each shard, with the keys found in at least ``min_docs``
documents. Documents can be added and removed: counts move up and down, and
keys that cross the threshold enter or leave their shard's filter, so removing
what was added gives the earlier state back.

A document's lines are probed in the filters first: (text, key) rows are dealt
by shard, each shard in groups of bounded size, and meet the shard's filter.
Only what the filters may hold goes on to the exact counts by an equi-join, so a
false hit never drops a line. The keys that a text loses then meet the text by
its hash. It is one path at every size: filters and counts may outgrow any memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailrank.llm._store import cut, fresh

_STRIP = b" \t\n\x0b\x0c\r"
SLOTS = 4
MAX_KICKS = 500
#: Keys to a shard for which filters are sized when the caller names no shard count.
SHARD_KEYS = 100_000
#: Probes, (text, key) rows, that meet a shard's filter in one task.
PROBES = 250_000


class CuckooFilter:
    """Partial-key cuckoo filter with 16-bit fingerprints; insert, delete and contains on uint64 hashes."""

    def __init__(self, n_keys: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(3, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.8)))))
            table = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.table, self.mask = table, len(table) - 1

    @staticmethod
    def _spread(marks):
        return (np.uint64(0x5BD1E9955BD1E995) * np.asarray(marks, dtype=np.uint64)) >> np.uint64(20)

    def places(self, keys: np.ndarray):
        """Fingerprint (never 0), first and second bucket of each key."""
        keys = np.asarray(keys, dtype=np.uint64)
        marks = (keys >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        first = keys & np.uint64(self.mask)
        return marks, first, (first ^ self._spread(marks)) & np.uint64(self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, first, second = self.places(keys)
        return ((self.table[first] == marks[:, None]) | (self.table[second] == marks[:, None])).any(axis=1)

    def insert(self, key: int) -> bool:
        """False when the table is too full; the filter is then as it was before the call."""
        marks, first, second = self.places(np.array([key], dtype=np.uint64))
        mark, path = marks[0], []
        for at in (int(first[0]), int(second[0])):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = int(second[0])
        for kick in range(MAX_KICKS):
            slot = (kick * 7 + at) % SLOTS
            path.append((at, slot))
            mark, self.table[at, slot] = self.table[at, slot], mark
            at = int((np.uint64(at) ^ self._spread(mark)) & np.uint64(self.mask))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for at, slot in reversed(path):
            mark, self.table[at, slot] = self.table[at, slot], mark
        return False

    def delete(self, key: int) -> bool:
        marks, first, second = self.places(np.array([key], dtype=np.uint64))
        for at in (int(first[0]), int(second[0])):
            held = np.flatnonzero(self.table[at] == marks[0])
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(blob, dtype=np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = len(keys)
        while True:
            made = cls(size)
            if all(made.insert(k) for k in np.sort(keys)):
                return made
            size *= 2


def line_key(line: bytes) -> bytes:
    """The line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased (UTF-8)."""
    return line.strip(_STRIP).lower()


def _hash(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _points(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def _lines(text: pa.Scalar) -> list[bytes]:
    value = text.as_buffer()
    return value.to_pybytes().split(b"\n") if value is not None else [b""]


_KEYS = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])
_TEXT_KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), *_KEYS])


def _keys_of(text: pa.Scalar, min_chars: int) -> set[bytes]:
    keys = {line_key(x) for x in _lines(text)}
    return {k for k in keys if len(k) >= min_chars and (min_chars <= 1 or _points(k) >= min_chars)}


def _distinct_keys(min_chars: int):
    """(hi, lo) of every text's distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [_hash(k) for text in batch["text"] for k in _keys_of(text, min_chars)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*hashes, strict=True) if hashes else ([], []))], schema=_KEYS)

    return run


def _text_keys(min_chars: int):
    """(h1, h2, hi, lo): a text's hash with each of its distinct keys; equal texts of a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for text, h1, h2 in zip(batch["text"], batch["h1"].to_pylist(), batch["h2"].to_pylist(), strict=True):
                if (h1, h2) not in done:
                    done.add((h1, h2))
                    rows += [(h1, h2, *_hash(k)) for k in _keys_of(text, min_chars)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_TEXT_KEYS)

    return run


def line_counts(documents: DataFrame, min_chars: int = 1) -> DataFrame:
    """(hi, lo, n_docs): for every line key of at least ``min_chars`` code points the documents that hold it."""
    keys = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_distinct_keys(min_chars), "hi long, lo long")
    return keys.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"))


def _shard(shards: int):
    return F.pmod(F.col("hi"), F.lit(shards)).cast("int").alias("shard")


def _build(table: pa.Table) -> pa.Table:
    blob = CuckooFilter.of(table["lo"].to_numpy().view(np.uint64)).to_bytes()
    return pa.table([table["shard"].slice(0, 1), pa.array([blob], pa.binary())], names=["shard", "filter"])


class LineIndex:
    """Counts and filters of a set of documents; ``add`` and ``remove`` return the index after the change.

    Each removed document must have been added before. A null text is one empty
    line, which has no key.
    """

    def __init__(self, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.counts, self.filters, self.shards, self.min_docs, self.min_chars = counts, filters, shards, min_docs, min_chars

    @classmethod
    def build(cls, documents: DataFrame, min_docs: int = 10, min_chars: int = 1, shards: int | None = None) -> LineIndex:
        return cls.of(cut(line_counts(documents, min_chars), "line-counts"), min_docs, min_chars, shards)

    @classmethod
    def of(cls, counts: DataFrame, min_docs: int, min_chars: int, shards: int | None = None) -> LineIndex:
        """The index of exact counts: the filters hold the keys at or over the threshold."""
        frequent = counts.where(F.col("n_docs") >= min_docs)
        shards = shards or 1 + frequent.count() // SHARD_KEYS
        filters = frequent.select("lo", _shard(shards)).groupBy("shard").applyInArrow(_build, "shard int, filter binary")
        return cls(counts, cut(filters, "line-filters"), shards, min_docs, min_chars)

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("hi", "lo")

    def _changed(self, documents: DataFrame, sign: int) -> LineIndex:
        moved = line_counts(documents, self.min_chars).select("hi", "lo", (F.col("n_docs") * sign).alias("moved"))
        both = self.counts.select("hi", "lo", "n_docs", F.lit(0).cast("long").alias("moved")).unionByName(moved.withColumn("n_docs", F.lit(0).cast("long")))
        both = cut(both.groupBy("hi", "lo").agg(F.sum("n_docs").alias("before"), F.sum("moved").alias("moved")).withColumn("n_docs", F.col("before") + F.col("moved")), "line-moves")
        counts = cut(both.where("n_docs > 0").select("hi", "lo", "n_docs"), "line-counts")
        over = lambda c: F.col(c) >= self.min_docs
        keys = both.where(over("n_docs")).select("lo", _shard(self.shards))
        if keys.count() > 2 * SHARD_KEYS * self.shards:  # the shards have grown too large: deal the keys to more
            return LineIndex.of(counts, self.min_docs, self.min_chars)
        crossed = both.where(over("before") != over("n_docs")).select("lo", over("n_docs").alias("enters"), _shard(self.shards))
        filters = cut(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(_move, "shard int, filter binary"), "line-filters")
        full = filters.where("filter IS NULL")
        if not full.isEmpty():  # these grow: they are built again from the exact counts
            grown = keys.join(full.select("shard"), "shard", "left_semi").groupBy("shard").applyInArrow(_build, "shard int, filter binary")
            filters = cut(filters.where("filter IS NOT NULL").unionByName(grown), "line-filters")
        return LineIndex(counts, filters, self.shards, self.min_docs, self.min_chars)

    def add(self, documents: DataFrame) -> LineIndex:
        """The index with ``documents`` too. Filters that get full grow."""
        return self._changed(documents, 1)

    def remove(self, documents: DataFrame) -> LineIndex:
        return self._changed(documents, -1)

    def suspects(self, texts: DataFrame) -> DataFrame:
        """(h1, h2, hi, lo): the keys of texts (h1, h2, text) that the filters may hold.

        A shard's probes are dealt to groups of about ``PROBES`` rows by text and
        task, so that a line or text that most rows hold is spread as well.
        """
        found = texts.mapInArrow(_text_keys(self.min_chars), "h1 long, h2 long, hi long, lo long")
        load = self.counts.groupBy(_shard(self.shards)).agg(F.ceil(F.sum("n_docs") / PROBES).cast("int").alias("salts"))
        held = self.filters.join(load, "shard")
        salts = F.broadcast(held.select("shard", "salts"))  # a row for each SHARD_KEYS frequent keys
        dealt = found.withColumn("shard", _shard(self.shards)).join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("h1", F.spark_partition_id()), "salts").cast("int")).drop("salts")
        copies = held.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter")
        return dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_probe, "h1 long, h2 long, hi long, lo long")

    def apply(self, documents: DataFrame, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
        """``documents`` with text without its frequent lines, and two columns ``names``: lines before, lines dropped.

        Columns of ``documents`` that have these names already are replaced.
        """
        kept = [c for c in documents.columns if c not in names]
        rows = documents.select(kept)
        h1, h2, hits = fresh([*kept, *names], "h1", "h2", "hits")
        marks = {h1: F.xxhash64("text"), h2: F.xxhash64(F.lit(1), F.md5(F.col("text").cast("binary")))}
        texts = documents.select(F.col("text").cast("string").alias("text")).select("text", marks[h1].alias("h1"), marks[h2].alias("h2"))
        exact = self.suspects(texts).join(self.frequent().hint("merge"), ["hi", "lo"])
        lost = exact.groupBy("h1", "h2").agg(F.collect_set(F.struct("hi", "lo")).alias(hits))
        lost = lost.select(F.col("h1").alias(h1), F.col("h2").alias(h2), hits)
        # A merge join at every size: both sides grow with the documents.
        joined = rows.withColumn("text", F.col("text").cast("string")).withColumns(marks).join(lost.hint("merge"), [h1, h2], "left").select(*kept, hits)
        out = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema) + f", `{names[0]}` long, `{names[1]}` long"
        return joined.mapInArrow(_drop_listed(self.min_chars, hits, names), out)


def _probe(probes: pa.Table, filters: pa.Table) -> pa.Table:
    if not filters.num_rows or not probes.num_rows:
        return _TEXT_KEYS.empty_table()
    probes = probes.select(_TEXT_KEYS.names)
    held = CuckooFilter.from_bytes(filters["filter"][0].as_py())
    return probes.take(pa.array(np.flatnonzero(held.contains(probes["lo"].to_numpy().view(np.uint64))))).group_by(_TEXT_KEYS.names).aggregate([])


def _move(key, filters: pa.Table, crossed: pa.Table) -> pa.Table:
    """The filter after keys left and entered it; null when it is too small for them."""
    blob = filters["filter"][0].as_py() if filters.num_rows else CuckooFilter(len(crossed)).to_bytes()
    made = CuckooFilter.from_bytes(blob)
    enters = np.array(crossed["enters"].to_pylist(), dtype=bool)
    los = crossed["lo"].to_numpy().view(np.uint64)
    for lo in los[~enters]:
        made.delete(lo)
    blob = made.to_bytes() if all(made.insert(lo) for lo in los[enters]) else None
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "filter"])


def _drop_listed(min_chars: int, hits: str, names: tuple[str, str]):
    """Texts without the lines whose keys are in column ``hits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != hits]
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(batch["text"], batch[hits].to_pylist(), strict=True):
                lines = stay = _lines(text)
                if lost:
                    known = {(h["hi"], h["lo"]) for h in lost}
                    stay = [x for x in lines if len(k := line_key(x)) < min_chars or (min_chars > 1 and _points(k) < min_chars) or _hash(k) not in known]
                texts.append(b"\n".join(stay).decode("utf-8"))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch[c] for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*kept, *names])

    return run


def dedup_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All columns of ``documents``, text without the lines whose key is in ``min_docs`` documents or more, and columns ``names``.

    A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at its
    ends, A-Z lower-cased; keys under ``min_chars`` code points always stay. A
    null or empty text is one empty line and comes back as an empty text. Rows
    with equal ids are documents of their own. An empty table gives no rows.
    """
    return LineIndex.build(documents, min_docs, min_chars).apply(documents, names)


def sha256_hex(column: str = "text") -> F.Column:
    return F.sha2(F.col(column).cast("binary"), 256)
