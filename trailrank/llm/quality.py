"""Byte-level convolutional quality classifier in numpy.

A text's UTF-8 bytes are read in overlapping chunks that cover it whole: 64
windows of 8 bytes, 4 apart, a chunk, and the last window reaches into the next
chunk. Each byte has a learned embedding, each window passes learned filters,
and a filter's largest response in a chunk is kept. The largest and the mean
response over all chunks go through one logistic unit.

Scoring is one pass over the partitions with the weights (about 20 KB) sent
along. Training takes a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailrank.llm import _text
from trailrank.llm._sample import hash_share

EMBED, STRIDE, WINDOWS, FILTERS = 8, 4, 64, 16
CHUNK = STRIDE * WINDOWS
#: Bound of the training sample: rows, and bytes of a text (longer ones are not sampled; all are scored).
TRAIN_ROWS, TRAIN_BYTES = 4000, 32_768
EPOCHS, BATCH_DOCS, RATE = 14, 32, 4e-3
#: Chunks scored at once.
BLOCK = 2048


def chunk_bytes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk bytes, first chunk of each text and the number of chunks); bytes beyond a text's end are 0."""
    sizes = np.diff(offs)
    counts = np.maximum(1, -(-np.maximum(0, sizes - STRIDE) // CHUNK))
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(sizes)), counts)
    start = offs[:-1][owner] + (np.arange(first[-1]) - first[owner]) * CHUNK
    at = start[:, None] + np.arange(CHUNK + STRIDE)
    inside = at < offs[1:][owner][:, None]
    if not len(raw):
        return np.zeros(at.shape, np.uint8), first
    return np.where(inside, raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8), first


class ByteNet:
    """Embedding, filters (two halves of 4 bytes) and the logistic unit."""

    NAMES = ("embed", "filters", "bias", "out", "base")

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(2 * STRIDE * EMBED), (STRIDE * EMBED, 2 * FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, windows, filters) before the rectifier."""
        n = len(chunks)
        both = self.embed[chunks].reshape(n * (WINDOWS + 1), STRIDE * EMBED) @ self.filters
        both = both.reshape(n, WINDOWS + 1, 2 * FILTERS)
        return both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        out = [self.responses(chunks[k : k + BLOCK]).max(axis=1) for k in range(0, len(chunks), BLOCK)]
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def logits(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(pooled, first[:-1], axis=0)
        mean = np.add.reduceat(pooled, first[:-1], axis=0) / np.diff(first)[:, None]
        return np.concatenate([top, mean], axis=1) @ self.out + self.base[0]

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each text."""
        chunks, first = chunk_bytes(raw, offs)
        return 1 / (1 + np.exp(-self.logits(self.pooled(chunks), first).astype(np.float64)))

    def gradients(self, chunks: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        n, docs = len(chunks), len(labels)
        response = self.responses(chunks)
        best = response.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(response, best[:, None], 1)[:, 0] + self.bias, 0)
        owner = np.repeat(np.arange(docs), np.diff(first))
        top = np.maximum.reduceat(pooled, first[:-1], axis=0)
        mean = np.add.reduceat(pooled, first[:-1], axis=0) / np.diff(first)[:, None]
        features = np.concatenate([top, mean], axis=1)
        slope = ((1 / (1 + np.exp(-(features @ self.out + self.base[0])))) - labels).astype(np.float32) / docs
        leads = pooled == top[owner]
        leads &= pooled > 0
        ties = np.add.reduceat(leads, first[:-1], axis=0).clip(1)
        back = slope[owner, None] * (leads / ties[owner] * self.out[:FILTERS] + self.out[FILTERS:] / np.diff(first)[owner, None]) * (pooled > 0)
        back = back.astype(np.float32)
        grads = {"out": slope @ features, "base": slope.sum(keepdims=True), "bias": back.sum(axis=0)}
        bytes_at = best[:, :, None] * STRIDE + np.arange(2 * STRIDE)
        seen = chunks[np.arange(n)[:, None, None], bytes_at]
        inputs = self.embed[seen].reshape(n, FILTERS, 2, STRIDE * EMBED)
        halves = np.einsum("nf,nfhe->ehf", back, inputs)
        grads["filters"] = halves.reshape(STRIDE * EMBED, 2 * FILTERS)
        weights = self.filters.reshape(STRIDE, EMBED, 2, FILTERS).transpose(3, 2, 0, 1).reshape(FILTERS, 2 * STRIDE, EMBED)
        grads["embed"] = np.zeros_like(self.embed)
        flat = (back[:, :, None, None] * weights).reshape(-1, EMBED)
        codes = seen.reshape(-1)
        for k in range(EMBED):
            grads["embed"][:, k] = np.bincount(codes, flat[:, k], 256)
        return grads

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 9) -> ByteNet:
        """Adam on the logistic loss; batches in an order fixed by the seed."""
        rng, step = np.random.default_rng(seed), 0
        rate = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
        self.base[0] = np.log(rate / (1 - rate))
        first = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        second = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        batches = max(1, len(texts) // BATCH_DOCS)
        epochs = max(epochs, -(-400 // batches)) if len(texts) else 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for part in np.array_split(order, batches):
                raw = np.frombuffer(b"".join(texts[k] for k in part), np.uint8)
                offs = np.concatenate([[0], np.cumsum([len(texts[k]) for k in part])])
                step += 1
                pace = RATE * (1 - 0.9 * epoch / epochs)
                for name, grad in self.gradients(*chunk_bytes(raw, offs), labels[part]).items():
                    first[name] += 0.1 * (grad - first[name])
                    second[name] += 0.001 * (grad * grad - second[name])
                    change = pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, name, (getattr(self, name) - change).astype(np.float32))
        return self


def held_out() -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> ByteNet:
    """Fit on at most ``rows`` labelled texts of at most ``most_bytes`` bytes, the first by hash of id and text.

    Rows that ``held_out`` names, null ids and null labels are not used. Without
    any usable row the untrained network stays, which scores all texts about alike.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out())
    chosen = hash_share(marks, rows, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    sample = texts.where(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), "doc_id")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows).toArrow()
    pairs = sorted(zip(sample["doc_id"].to_pylist(), sample["text"].to_pylist(), sample["y"].to_pylist(), strict=True))
    return ByteNet().fit([t.encode() for _, t, _ in pairs], np.array([y for *_, y in pairs], dtype=np.float32))


def _score(sent, out: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = ByteNet()
        for name, value in zip(ByteNet.NAMES, sent.value, strict=True):
            setattr(net, name, value)
        for batch in batches:
            raw, offs = _text.text_buffers(batch["text"])
            scores = [net.scores(part, part_offs) for _, _, part, part_offs in _text.chunks(raw, offs)]
            scores = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in out), scores], [*out, name])

    return run


def score(documents: DataFrame, net: ByteNet, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` (all, if None) of every row and its score as column ``name``, which replaces one of that name; a null text is scored as an empty one."""
    keep = [c for c in documents.columns if c != name] if keep is None else keep
    rows = documents.select(*dict.fromkeys([*keep, "text"]))
    sent = documents.sparkSession.sparkContext.broadcast([getattr(net, k) for k in ByteNet.NAMES])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` double"
    return rows.mapInArrow(_score(sent, keep, name), schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row: predicted is 1 where score >= ``threshold``.

    Empty and null texts are scored like others (one chunk of zero bytes). Rows
    with a null id are scored and not held out. Extra columns are ignored.
    """
    scored = score(documents.select("doc_id", "text"), train(documents, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
