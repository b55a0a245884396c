"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors become integers floor(256 * x). Rows are dealt into blocks. A block's
index has, for each dimension, the rows ordered by component and cut into posting
segments by quantised impact level. For a positive query weight a row's impact is
its component above the dimension's least one, for a negative weight the distance
below the greatest one; so impacts are never negative, and a query's score is a
constant plus the sum of weight times impact.

A query takes the segments of all dimensions in descending order of weight times
greatest impact and adds to its rows' accumulators; the queries of a block do so
together, each with its own order. From time to time each row's score is bounded:
by what it has gathered plus, for every dimension that has not reached it yet,
the best impact of its segment there. The rows with the best bounds are scored
exactly; when few rows' bounds still reach the k-th best of these scores, the
query stops and scores all of those exactly. That is the proof: no other row can
enter. Sums are exact integers throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailrank.llm._store import cut

SCALE = 256
LEVELS = 4
#: Components of an index block, and of a query block.
CELLS = 1 << 19
#: Queries of a block that are answered together.
QUERIES = 256
#: A query ends when no more rows than this may still be members.
FEW = 64
#: Shares of all postings after which bounds are looked at.
LOOKS = (0.75,)


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, vector, dim): floor(scale * x) of every component; null ids and vectors that are null, empty or hold null or non-finite components are left out."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(F.col(id_column).isNotNull() & (F.size(vector) > 0) & ~bad)
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("vector"), F.size(vector).alias("dim"))


def _pack(table: pa.Table) -> pa.Table:
    """One row for a block: its rows' numbers and ids, and its components in the narrowest type that holds them."""
    order = np.argsort(table["row"].to_numpy(), kind="stable")
    numbers, ids = table["row"].to_numpy()[order], table["vec_id"].to_numpy()[order]
    matrix = table["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
    width = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= matrix.min() and matrix.max() <= np.iinfo(t).max)
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (numbers, ids, matrix.astype(width))]
    return pa.table([table["dim"].slice(0, 1), table["block"].slice(0, 1), *blobs], names=["dim", "block", "rows", "ids", "matrix"])


_PACKED = "dim int, block int, rows binary, ids binary, matrix binary"


def _unpack(row: dict, side: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    numbers, ids = (np.frombuffer(row[side + c], np.int64) for c in ("rows", "ids"))
    size = len(row[side + "matrix"]) // (len(ids) * row["dim"])
    return numbers, ids, np.frombuffer(row[side + "matrix"], f"i{size}").reshape(len(ids), row["dim"]).astype(np.int64)


class Postings:
    """The posting segments of one block of integer vectors; ``exact`` is the float type that holds all sums.

    ``marks`` has a row for each segment (dimension, level) that marks its members,
    ``values`` their components, so many queries' accumulators gather a look's
    segments by one product.
    """

    def __init__(self, matrix: np.ndarray, exact: type = np.float64):
        self.matrix, self.exact = matrix, exact
        n, dims = matrix.shape
        self.low, self.high = matrix.min(axis=0), matrix.max(axis=0)
        width = -(-(self.high - self.low + 1) // LEVELS)
        segment = (matrix - self.low) // width + np.arange(dims) * LEVELS
        self.marks, self.values = (np.zeros((dims * LEVELS, n), exact) for _ in range(2))
        self.marks[segment, np.arange(n)[:, None]] = 1
        self.values[segment, np.arange(n)[:, None]] = matrix
        self.sizes = self.marks.sum(axis=1).astype(np.int64)
        self.top, self.bottom = (np.zeros(dims * LEVELS, np.int64) for _ in range(2))
        np.maximum.at(self.top, segment.ravel(), (matrix - self.low).ravel())
        np.maximum.at(self.bottom, segment.ravel(), (self.high - matrix).ravel())

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the possible members of the k best, row ``own`` left out (-1: none)."""
        return self.search_all(query[None, :], np.array([own]), k)[1:]

    def search_all(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, row, score) of the possible members of the k best of each query."""
        n = len(self.matrix)
        if n - 1 <= max(FEW, k):
            at, rows = np.nonzero(np.arange(n) != own[:, None])
            return at, rows, np.einsum("ij,ij->i", self.matrix[rows], queries[at])
        weight, up = np.abs(queries), queries > 0
        edge = np.where(up, self.low, self.high)
        base = np.einsum("ij,ij->i", edge, queries)
        spread = lambda x: np.repeat(x, LEVELS, axis=1)
        best = np.where(spread(up), self.top, self.bottom) * spread(weight)
        order = np.argsort(-best, axis=1, kind="stable")
        sizes = np.where(best > 0, self.sizes, 0)
        before = np.empty_like(sizes)  # postings of the segments before each one, in the query's order
        falling = np.take_along_axis(sizes, order, 1)
        np.put_along_axis(before, order, np.cumsum(falling, axis=1) - falling, 1)
        share = before / np.maximum(sizes.sum(axis=1), 1)[:, None]
        found, left = [], np.arange(len(queries))
        for look in (*LOOKS, 1.0):
            # A taken segment adds its rows' own impacts, another one at most its greatest.
            taken = share[left] < look if look < 1 else np.ones((len(left), len(self.sizes)), bool)
            ask = spread(queries[left])
            sure = np.where(taken, ask, 0).astype(self.exact)
            rest = np.where(taken, -ask * spread(edge[left]), best[left]).astype(self.exact)
            bound = sure @ self.values + rest @ self.marks
            mine = np.flatnonzero(own[left] >= 0)
            bound[mine, own[left[mine]]] = -1
            likely = np.argpartition(bound, n - k, axis=1)[:, n - k :]
            least = np.einsum("ijk,ik->ij", self.matrix[likely], queries[left]).min(axis=1) - base[left]
            reach = bound >= least[:, None]
            done = (reach.sum(axis=1) <= max(FEW, 4 * k)) | (look == 1.0)
            at, rows = np.nonzero(reach[done])
            at = left[done][at]
            found.append((at, rows, np.einsum("ij,ij->i", self.matrix[rows], queries[at])))
            left = left[~done]
            if not len(left):
                break
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def search_block(postings: Postings, numbers: np.ndarray, ids: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score): the k best of a block for each query, ties to the smaller id, the query's own row left out."""
    at = np.searchsorted(numbers, query_rows)  # numbers ascend
    own = np.where((at < len(numbers)) & (numbers[at.clip(max=len(numbers) - 1)] == query_rows), at, -1)
    parts = []
    for start in range(0, len(queries), QUERIES):
        part, rows, scores = postings.search_all(queries[start : start + QUERIES], own[start : start + QUERIES], k)
        order = np.lexsort((ids[rows], -scores, part))
        part, rows, scores = part[order], rows[order], scores[order]
        rank = np.arange(len(part)) - np.searchsorted(part, part)
        parts.append((query_rows[start + part[rank < k]], ids[rows[rank < k]], scores[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def sum_type(matrix: np.ndarray, largest: int) -> type:
    """A float type in which sums of products of a matrix' impacts with weights up to ``largest`` are exact."""
    reach = 2 * int(np.abs(matrix).max(initial=1)) * max(1, largest) * matrix.shape[1]
    if reach >= 2**52:
        raise ValueError("components are too large for exact sums")
    return np.float32 if reach < 2**23 else np.float64


def _search(k: int):
    schema = pa.schema([("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, postings = None, None
        for batch in batches:
            for row in batch.to_pylist():
                numbers, ids, matrix = _unpack(row)
                query_rows, _, queries = _unpack(row, "query_")
                exact = sum_type(matrix, int(np.abs(queries).max()))
                if block != (row["dim"], row["block"], exact):  # a block's rows follow each other
                    block, postings = (row["dim"], row["block"], exact), Postings(matrix, exact)
                found = search_block(postings, numbers, ids, query_rows, queries, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=schema)

    return run


def top_k(rows: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own, of the query's dimension. Fewer than k candidates
    give fewer rows; ties go to the smaller id. Null, empty or non-finite vectors
    take no part. Rows with one id are rows of their own: each is a query, and a
    candidate of the others. An empty table gives no rows.

    Index blocks go through a shuffle once; query blocks, a fiftieth of the rows,
    are copied to each index block.
    """
    vectors = cut(integer_vectors(rows, id_column, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asks = F.col("vec_id") % every == 0
    blocks = lambda n: F.ceil(n * F.col("dim") / CELLS).cast("int")
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(asks.cast("long")).alias("q")).where("q > 0")
    sizes = cut(sizes.select("dim", blocks(F.col("n")).alias("blocks"), blocks(F.col("q")).alias("query_blocks")), "sizes")
    dealt = lambda of, n: of.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("row"), n).cast("int")).select("dim", "block", "row", "vec_id", "vector")
    index = dealt(vectors, "blocks").groupBy("dim", "block").applyInArrow(_pack, _PACKED)
    asked = cut(dealt(vectors.where(asks), "query_blocks").groupBy("dim", "block").applyInArrow(_pack, _PACKED), "asked")
    copies = asked.join(sizes, "dim").select("dim", *[F.col(c).alias(f"query_{c}") for c in ("rows", "ids", "matrix")], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # A block costs the same work however few bytes it has, so its number and not its size sets the tasks.
    tasks = max(1, min(4096, 2 * (sizes.agg(F.sum("blocks")).first()[0] or 0)))
    index, copies = (x.repartition(tasks, "dim", "block") for x in (index, copies))
    found = index.join(copies.hint("merge"), ["dim", "block"]).mapInArrow(_search(k), "query_row long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    found = found.withColumn("rank", best).where(F.col("rank") <= k)
    names = vectors.where(asks).select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return found.join(names, "query_row").select("query_id", "rank", "vec_id", "score")
