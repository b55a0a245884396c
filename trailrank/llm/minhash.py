"""MinHash near-duplicate groups with sequential Bayesian verification.

1. Every text becomes its set of word shingles (64-bit hashes), a 144-value
   MinHash signature kept to one byte a value, and 24 band keys of six values.
   Texts with equal sets form a class with one representative.
2. In each bucket (band, key) the member that shares most buckets is the pivot.
   Members are compared with their pivots only, batch by batch of the
   signature: a pair goes when the posterior chance that its similarity
   reaches the bound is below ``miss``. Survivors are verified on full sets.
3. Jaccard distance is a metric, so when a member is at most
   ``near - (1 - threshold)`` from its pivot, every text linked with it lies
   within ``near`` of the pivot: the pivot's ball settles the member. Members of
   a ball that are not linked with its pivot meet all members by exact set
   products, in blocks of bounded size.
4. Members that no ball settles get new pivots, ``TURNS`` times in all. What is
   left then has as many unlike clusters in one bucket; it is compared by
   signatures, in blocks, and survivors are verified.
5. Links are joined into components; each document gets its component's least id.

Groups of near copies are settled by their pivots, so no step emits all pairs of
them, and none caps a member's partners. Shingle sets are read again for texts in
buckets only; that join shuffles at every size alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailrank.llm import _text
from trailrank.llm._store import cut, drop
from trailrank.llm.components import components

BANDS, ROWS, BATCH = 24, 6, 24
N_HASHES = BANDS * ROWS
#: Members of one block in a task that compares a ball or a bucket.
BLOCK = 192
#: Rounds of pivots.
TURNS = 3
_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**63, (N_HASHES, 1), dtype=np.uint64)
_MUL = _rng.integers(0, 2**62, (N_HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MUL = _rng.integers(0, 2**62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The ``N_HASHES`` minima (uint64) of a non-empty set of shingle hashes."""
    low = np.full(N_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, ((shingles[None, at : at + 1024] ^ _XOR) * _MUL).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    return _text.mix(((low >> np.uint64(20)).reshape(BANDS, ROWS) * _BAND_MUL).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def least_agreements(bound: float, miss: float) -> np.ndarray:
    """For each number n of compared bytes: the fewest agreements at which P(similarity >= bound) >= miss.

    Uniform prior; bytes of different minima agree by chance once in 256, so a
    similarity s shows as s + (1 - s) / 256. The posterior is a beta
    distribution, whose tail is a binomial sum.
    """
    seen = bound + (1 - bound) / 256
    out = np.zeros(N_HASHES + 1, dtype=np.int64)
    for n in range(1, N_HASHES + 1):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * seen**m * (1 - seen) ** (n + 1 - m)
            if tail >= miss:
                out[n] = m
                break
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indices of the rows of two byte-signature tables that no batch prunes."""
    alive, agreed = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for at in range(0, N_HASHES, BATCH):
        agreed = agreed + (a[alive, at : at + BATCH] == b[alive, at : at + BATCH]).sum(axis=1)
        keep = agreed >= least[at + BATCH]
        alive, agreed = alive[keep], agreed[keep]
    return alive


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def byte_signature(low: np.ndarray) -> bytes:
    """One byte of each minimum. Minima of large sets have high bits 0, so the byte is taken after mixing."""
    return (_text.mix(low) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # equal rows meet in one task and give one set
        for batch in batches:
            rows = []
            for node, x in zip(batch["node"].to_pylist(), _text.shingle_sets(batch["text"], width), strict=True):
                if node not in seen and node == _digest(x):
                    seen.add(node)
                    rows.append((node, x.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["node", "shingles"])

    return run


def _signatures(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, mark, shingles in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), _text.shingle_sets(batch["text"], width), strict=True):
                if doc_id is None or not len(shingles):
                    rows.append((doc_id, mark, len(shingles), None, None, None))
                    continue
                low = signature(shingles)
                rows.append((doc_id, mark, len(shingles), _digest(shingles), byte_signature(low), band_keys(low)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)

    return run


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), N_HASHES)


def _prune(bound: float, miss: float):
    least = least_agreements(bound, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["u", "v"]).take(pa.array(survivors(_bytes(batch["sig_u"]), _bytes(batch["sig_v"]), least)))

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, total = [], []
        for a, b in zip(batch["set_u"], batch["set_v"], strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            n = len(np.intersect1d(x, y, assume_unique=True))
            shared.append(n)
            total.append(len(x) + len(y) - n)
        yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["u", "v", "shared", "total"])


def _products(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Intersection sizes of the first ``left`` sets with all sets."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], place[column[keep]]
    out = np.zeros((left, len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(256, (1 << 22) // max(1, len(sets)))
    for at in range(0, int(often.sum()), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        part = np.zeros((len(sets), step), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part[:left] @ part.T
    return out.astype(np.int64)


_PAIR = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _block_pairs(table: pa.Table):
    """The two sides of a task: rows of its first block, then, if they differ, those of its second."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    block = table["block"].to_numpy()
    first = np.flatnonzero(block == i)
    second = np.flatnonzero(block == j) if i != j else first[:0]
    return first, second


def _finish_ball(percent: int):
    """Links, on full sets, of a block of loose members with another such block or with one of the pivot's linked members."""

    def run(table: pa.Table) -> pa.Table:
        loose = np.array(table["loose"].to_pylist(), dtype=bool)
        within = table["kind"][0].as_py() == "loose"
        first, second = _block_pairs(table) if within else (np.flatnonzero(loose), np.flatnonzero(~loose))
        order = np.concatenate([first, second])
        if not len(first) or len(order) < 2:
            return _PAIR.empty_table()
        nodes, labels = table["node"].to_pylist(), table["label"].to_pylist()
        blobs = table["shingles"].to_pylist()
        sets = [np.frombuffer(blobs[k], np.uint64) for k in order]
        sizes = np.array([len(x) for x in sets])
        shared = _products(sets, len(first))
        a, b = np.nonzero(100 * shared >= percent * (sizes[: len(first), None] + sizes[None, :] - shared))
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        us, vs = [], []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if y < len(first) and (len(second) or y <= x):
                continue
            p, q = root(labels[order[x]]), root(labels[order[y]])
            if p != q:
                parent[max(p, q)] = min(p, q)
                us.append(nodes[order[x]])
                vs.append(nodes[order[y]])
        return pa.table([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=_PAIR)

    return run


def _compare_bucket(bound: float, miss: float):
    """Pairs in a bucket that the posterior does not prune."""
    least = least_agreements(bound, miss)

    def run(table: pa.Table) -> pa.Table:
        first, second = _block_pairs(table)
        if not len(first):
            return _PAIR.empty_table()
        nodes, sigs = table["node"].to_pylist(), _bytes(table["sig"])
        us, vs = [], []
        for k, x in enumerate(first):
            others = second if len(second) else first[k + 1 :]
            if len(others):
                kept = others[survivors(np.repeat(sigs[x : x + 1], len(others), axis=0), sigs[others], least)]
                us += [nodes[x]] * len(kept)
                vs += [nodes[y] for y in kept]
        return pa.table([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], schema=_PAIR)

    return run


def _in_blocks(members: DataFrame, group: list[str], counts: DataFrame) -> DataFrame:
    """Each member once for every pair of blocks that its block is in; counts has n for each group."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.join(counts, group).withColumn("g", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("n", "g", "other")


def _ball_blocks(ball: DataFrame) -> DataFrame:
    """(pivot, kind, i, j, block, node, label, loose): loose members for each block of loose and of linked members, linked ones for each block of loose members.

    Balls without a loose member, or with a single one and nobody but the pivot, need no task.
    """
    marked = ball.withColumn("loose", F.col("label") != F.col("pivot"))
    sizes = marked.groupBy("pivot").agg(F.sum(F.col("loose").cast("long")).alias("u"), F.sum((~F.col("loose")).cast("long")).alias("l"))
    sizes = cut(sizes.where("u > 0 AND u + l > 2"), "open")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = marked.join(sizes, "pivot").withColumn("gu", blocks("u")).withColumn("gl", blocks("l"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("loose"), F.col("gu")).otherwise(F.col("gl"))).cast("int"))
    to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    among = F.transform(to("gu"), lambda o: task("loose", F.least("block", o), F.greatest("block", o)))
    against = F.transform(to("gl"), lambda o: task("linked", F.col("block"), o))
    mine = F.transform(to("gu"), lambda o: task("linked", o, F.col("block")))
    dealt = dealt.withColumn("task", F.explode(F.when(F.col("loose"), F.concat(among, against)).otherwise(mine)))
    return dealt.select("pivot", "task.kind", "task.i", "task.j", "block", "node", "label", "loose")


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 85, miss: float = 1e-4, near: float = 0.5, with_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept[, text_hash, first]) for every row of ``documents``.

    Texts are linked when 100 * |A and B| >= percent * |A or B| on their sets of
    distinct ``width``-word shingles. ``miss`` is the chance at which a pair is
    pruned unseen, ``near`` the distance from a pivot within which a group is
    finished exactly. ``with_hash`` adds Spark's xxhash64 of the text, and whether the
    row's id and text are the first of its group: so one text of each group, also
    where rows with equal ids have unlike texts.

    A text of fewer words is one shingle; null, empty and blank texts have none
    and are linked with nothing. Rows with equal ids or texts each give a row. A
    row with a null id is linked with nothing: its component_id is null and it is
    kept. Columns besides doc_id and text are ignored. An empty table gives no rows.
    """
    threshold = percent / 100
    linked = F.expr(f"100 * shared >= {percent} * total")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = cut(docs.mapInArrow(_signatures(width), "doc_id long, text_hash long, n_shingles long, node binary, sig binary, bands array<long>"), "signatures")
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    classes = signed.where("node IS NOT NULL").groupBy("node").agg(least, F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = cut(classes.select("node", "least.doc_id", "least.text_hash", "sig", "bands"), "classes")
    sigs = classes.select("node", "sig")

    rows = classes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("key"))
    buckets = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = cut(rows.join(buckets, "key"), "shared")
    weight = cut(shared.groupBy("node").agg(F.sum("n").alias("weight")), "weight")
    rest = cut(shared.select("key", "node").join(weight, "node"), "held")

    chosen = classes.join(weight.select("node"), "node", "left_semi").select("doc_id", "text_hash", "node")
    sets = docs.join(chosen.hint("merge"), ["doc_id", "text_hash"]).select("node", "text").mapInArrow(_sets(width), "node binary, shingles binary")
    sets = cut(sets, "sets")
    spent = [buckets, shared, weight]

    def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        left, right = (table.select(F.col("node").alias(c), F.col(column).alias(f"{column}_{c}")) for c in "uv")
        return pairs.join(left, "u").join(right, "v")

    def verified(pairs: DataFrame) -> DataFrame:
        both = with_both(pairs, sets.withColumnRenamed("shingles", "set"), "set")
        return both.mapInArrow(_overlap, "u binary, v binary, shared long, total long")

    found = []
    for _ in range(TURNS):
        pivots = cut(rest.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "pivots")
        placed = cut(rest.join(pivots, "key").where("node <> pivot"), "placed")
        stars = placed.select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
        kept = cut(with_both(stars, sigs, "sig").mapInArrow(_prune(1 - near, miss), "u binary, v binary"), "kept")
        measured = cut(verified(kept), "measured")
        inside = measured.where(F.col("shared") >= (1 - near) * F.col("total"))
        ball = inside.select(F.col("v").alias("pivot"), F.col("u").alias("node"), F.when(linked, F.col("v")).otherwise(F.col("u")).alias("label"))
        ball = ball.unionByName(inside.select(F.col("v").alias("pivot"), F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        tasks = _ball_blocks(ball).join(sets, "node").groupBy("pivot", "kind", "i", "j")
        found += [measured.where(linked).select("u", "v"), cut(tasks.applyInArrow(_finish_ball(percent), "u binary, v binary"), "finished")]
        settled = measured.where(F.col("shared") >= (2 - near - threshold) * F.col("total")).select(F.col("u").alias("node"), F.col("v").alias("pivot"))
        spent += [rest, pivots, placed, kept, measured]
        rest = cut(placed.where("n > 2").join(settled, ["node", "pivot"], "left_anti").select("key", "node", "weight"), "rest")
        if rest.isEmpty():
            break

    open_keys = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tasks = _in_blocks(rest.select("key", "node"), ["key"], open_keys).join(sigs, "node")
    pairs = tasks.groupBy("key", "i", "j").applyInArrow(_compare_bucket(threshold, miss), "u binary, v binary")
    pairs = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    found.append(verified(pairs).where(linked).select("u", "v"))

    labels = components(reduce(DataFrame.unionByName, found))
    named = classes.select("node", "doc_id", "text_hash").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = cut(named.select("node", "doc_id", "text_hash", "label"), "named")
    first = named.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    component = cut(named.join(first, "label").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash")), "component")
    drop(*spent, rest, pairs, sets, named, classes, *found[1:-1:2])
    out = signed.select("doc_id", "n_shingles", "node", "text_hash").join(component, "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    out = out.select("doc_id", "n_shingles", component_id, "text_hash", "first_hash").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = F.col("kept") & (F.coalesce("first_hash", "text_hash") == F.col("text_hash"))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *["text_hash", first.alias("first")][: 2 * with_hash])
