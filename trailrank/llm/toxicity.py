"""Toxicity severity by cumulative-link (proportional-odds) logistic regression.

Features are a text's distinct words and word beginnings, hashed and looked up
among those of the training sample; P(grade > j) = sigmoid(w . x - threshold_j), with one weight
vector for all thresholds. Weights are fitted by proximal gradient steps with an
L1 penalty, so only telling words keep weights and long clean texts stay clean;
a second fit on the words left lifts the penalty's pull.

The labels say toxic or not. Grades above 0 are the thirds of the labelled toxic
texts by how many of their words tell toxicity (log odds on the sample).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailrank.llm import _text
from trailrank.llm._sample import hash_share

GRADES = 4
#: Bound of the training sample: rows, and bytes of a text (longer ones are not sampled; all are scored).
TRAIN_ROWS, TRAIN_BYTES = 6000, 32_768
STEPS, PENALTY = 300, 6e-4
#: Penalty of the second fit, on the words that the first one left.
LAST_PENALTY = 3e-5
#: P(grade > 0) from which a text counts as toxic.
TOXIC = 0.25
#: Lengths in bytes of the word beginnings that are features beside whole words.
PREFIXES = (5, 6, 7, 8)
#: Words in fewer sample texts are no features.
LEAST_TEXTS = 3


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes with ASCII punctuation and digits as blanks, so that ``idiot,`` is ``idiot``."""
    keep = (raw >= 128) | ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))
    return np.where(keep, raw, 32).astype(np.uint8)


def distinct_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """For every text: the hashes of its distinct words and word beginnings."""
    raw, offs = _text.text_buffers(texts)
    for _, _, part, part_offs in _text.chunks(raw, offs):
        words, bounds, prefixes = _text.hash_words_and_prefixes(_letters(part), part_offs, PREFIXES)
        for k in range(len(part_offs) - 1):
            here = slice(bounds[k], bounds[k + 1])
            begins = prefixes[:, here]
            yield np.unique(np.concatenate([words[here], begins[begins != 0]]))


class OrdinalModel:
    """``vocabulary`` ascending word hashes, their ``weights``, and ascending ``thresholds``."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds

    def links(self, words: np.ndarray) -> float:
        if not len(self.vocabulary):
            return 0.0
        at = np.searchsorted(self.vocabulary, words).clip(max=len(self.vocabulary) - 1)
        return float(self.weights[at[self.vocabulary[at] == words]].sum())

    def beyond(self, link: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold."""
        return _sigmoid(np.asarray(link)[:, None] - self.thresholds[None, :])


def fit(texts: list[np.ndarray], toxic: np.ndarray, grades: int = GRADES) -> OrdinalModel:
    """From each text's distinct word hashes and its 0/1 label."""
    n = len(texts)
    if not n or toxic.min() == toxic.max():
        rate = float(toxic.mean()) if n else 0.0
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(grades - 1, 8.0 if rate < 0.5 else -8.0))
    flat, owner = np.concatenate(texts), np.repeat(np.arange(n), [len(x) for x in texts])
    vocabulary, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    often = counts >= LEAST_TEXTS
    place = np.cumsum(often) - 1
    keep = often[column]
    vocabulary, column, owner, counts = vocabulary[often], place[column[keep]], owner[keep], counts[often]
    size = len(vocabulary)

    hits = np.bincount(column, toxic[owner], size)
    odds = np.log((hits + 0.5) / (toxic.sum() + 1)) - np.log((counts - hits + 0.5) / ((1 - toxic).sum() + 1))
    sure = (odds > np.log(6)) & (hits >= LEAST_TEXTS)
    told = np.bincount(owner, sure[column], n)
    grade = np.zeros(n, dtype=np.int64)
    bad = np.flatnonzero(toxic == 1)
    ends = np.quantile(told[bad], np.arange(1, grades - 1) / (grades - 1)) if len(bad) else np.zeros(grades - 2)
    grade[bad] = 1 + (told[bad, None] > ends[None, :]).sum(axis=1)

    above = (grade[:, None] > np.arange(grades - 1)[None, :]).astype(float)
    rates = above.mean(axis=0).clip(1e-3, 1 - 1e-3)
    thresholds, used = -np.log(rates / (1 - rates)), np.arange(size)
    for penalty in (PENALTY, LAST_PENALTY):
        weights, thresholds = _descend(column, owner, counts[used], above, thresholds, penalty)
        left = weights != 0
        used, weights = used[left], weights[left]
        place = np.cumsum(left) - 1
        keep = left[column]
        column, owner = place[column[keep]], owner[keep]
    return OrdinalModel(vocabulary[used], weights, thresholds)


def _descend(column, owner, counts, above, thresholds, penalty):
    """Accelerated proximal steps on the mean loss from zero weights, kept non-negative: no word excuses another."""
    n, size = len(above), len(counts)
    pace, before, ahead = 1.0, np.zeros(size), np.zeros(size)
    step = 0.5 / np.sqrt(np.maximum(counts, 1) / n)
    for _ in range(STEPS):
        link = np.bincount(owner, ahead[column], n)
        off = _sigmoid(link[:, None] - thresholds[None, :]) - above
        slope = np.bincount(column, off.sum(axis=1)[owner], size) / n
        new = ahead - step * slope
        new = np.maximum(new - step * penalty, 0)
        thresholds = np.sort(thresholds + off.mean(axis=0))
        grown = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        momentum = min((pace - 1) / grown, 0.9)
        ahead, before, pace = new + momentum * (new - before), new, grown
    return before, thresholds


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Fit on at most ``rows`` labelled texts, the first by hash of the id; null ids and labels are not used."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL")
    chosen = hash_share(marks, rows, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    sample = texts.where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id")
    table = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows).toArrow()
    if not table.num_rows:
        return fit([], np.zeros(0))
    return fit(list(distinct_words(table["text"])), np.array(table["y"].to_pylist(), dtype=float))


def _score(sent):
    schema = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            beyond = model.beyond(np.array([model.links(x) for x in distinct_words(batch["text"])]))
            grade = (beyond >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(beyond.sum(axis=1)), pa.array(beyond[:, 0]), pa.array(grade, pa.int32())], schema=schema)

    return run


def severity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for every row.

    ``severity`` is the expected grade (0 to 3), ``p_toxic`` P(grade > 0), ``grade``
    the number of thresholds passed at even odds, ``toxic`` whether p_toxic is at least ``TOXIC``.
    Whole texts count; a null or empty text has no words and gets the base rate.
    Rows with a null id are scored. Extra columns are ignored.
    """
    model = train(documents, labels)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(sent), "doc_id long, severity double, p_toxic double, grade int").withColumn("toxic", F.col("p_toxic") >= TOXIC)
