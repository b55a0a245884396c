"""Bounded samples by hash, whose cost in a single task does not grow with the number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_share(rows: DataFrame, wanted: int, key: str) -> DataFrame:
    """The rows whose hash of ``key`` is in the lowest share of all hashes that holds about twice ``wanted`` rows; all, if there are fewer.

    Rows with one key stay together. Ordering the result by the hash and taking
    ``wanted`` rows gives the same rows as doing so with all of ``rows``, unless
    most rows share a few keys; then it may give fewer.
    """
    share = min(1.0, 2 * wanted / max(1, rows.select(key).count()))
    return rows if share == 1 else rows.where(F.xxhash64(key) < int(-(2**63) + share * 2**64))
