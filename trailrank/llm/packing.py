"""Harmonic packing of tokenised documents into fixed-capacity sequences.

A document of n ids, n at most the capacity, belongs to class k = capacity // n,
and a bin of class k takes exactly k documents, whole. Longer documents are cut
into whole sequences and a tail. What a full bin leaves free is filled with
pieces of tails; tails that no bin needs are packed like documents. A bin waits
for its filling; when ``WAITING`` bins do, the next documents are cut for them.

Every worker fills the bins of its own classes while it reads its partition:
nothing is shuffled, and a lost partition is rebuilt with the same ids. What is
open at a partition's end, at most one bin of each class and the waiting ones, is
packed first-fit by falling length; the emptiest bins' documents then fill the
others, and the last bin is cut into sequences of power-of-two length. So no
sequence needs padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: Distinct word chunks whose ids a worker remembers.
CACHE = 400_000
#: Full bins that may wait for tails, and tails that may wait for bins.
WAITING, TAILS = 256, 64
_OTHER_SPACE = re.compile(r"[^\S \n]")
_CHUNKS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space whose tokens depend on more than the next word.
_RUNS = re.compile(r"  | \n|\n\n[ \n]|\n\n\Z|[^\S \n]")


class _Cache(dict):
    """Ids of chunks as bytes; ``before`` is put before those that begin with a word."""

    def __init__(self, ids, before: str):
        super().__init__()
        self.ids, self.before = ids, before

    def __missing__(self, chunk: str) -> bytes:
        ids = self.ids(chunk if chunk[:1] == "\n" else self.before + chunk)
        if len(chunk) <= 40:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """ids of a byte-level BPE vocabulary as little-endian uint32 bytes.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)``: words end where
    white space begins, so a word with the blank or newline before it is encoded
    on its own and remembered. Where blanks or newlines come in longer runs, a word
    is remembered with its whole run. Such words get their ids from the ranks of the
    same vocabulary, which costs a third; texts with other white space, or with a
    special token's own string, are encoded whole by the tokenizer.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words, self.chunks = _Cache(self._ids, " "), _Cache(self._ids, "")

    def _ids(self, text: str) -> bytes:
        return array("I", self.ranks.encode_ordinary(text)).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self._whole(text)
        odd = _RUNS.search(text)
        if odd is None:
            first, *rest = text.replace("\n", " \n").split(" ")
            return self.chunks[first] + b"".join(map(self.words.__getitem__, rest))
        if _OTHER_SPACE.search(text):
            return self._whole(text)
        return b"".join(map(self.chunks.__getitem__, _CHUNKS.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The encoder of the public tokenizer file ``<tokenizer>.json``, whose ranks are in ``<tokenizer>.tiktoken``."""
    if tokenizer not in _encoders:
        import public_tokenizers

        paths = [public_tokenizers.path(f"{tokenizer}.{end}") for end in ("json", "tiktoken")]
        _encoders[tokenizer] = Encoder(*paths, public_tokenizers.PATTERN)
    return _encoders[tokenizer]


class Piece:
    """Ids ``start`` to ``start + length`` of a document, as bytes."""

    __slots__ = ("doc_id", "start", "length", "total", "ids")

    def __init__(self, doc_id, start: int, length: int, total: int, ids: bytes):
        self.doc_id, self.start, self.length, self.total, self.ids = doc_id, start, length, total, ids

    def take(self, n: int) -> Piece:
        """The first ``n`` ids; they leave this piece."""
        first = Piece(self.doc_id, self.start, n, self.total, self.ids[: 4 * n])
        self.start, self.length, self.ids = self.start + n, self.length - n, self.ids[4 * n :]
        return first


class Bins:
    """One worker's bins; ``add`` and ``close`` return rows of pieces that have got their places."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, waiting: int = WAITING, tails: int = TAILS):
        self.next_id, self.capacity, self.most_waiting, self.most_tails = first_id, capacity, waiting, tails
        self.open: dict[int, list[Piece]] = {}
        self.waiting: deque[list[Piece]] = deque()
        self.tails: deque[Piece] = deque()
        self.done: list[list] = []

    def _place(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.done.append([p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.total, self.next_id, at, p.ids])
            at += p.length
        self.next_id += 1

    def _room(self, pieces: list[Piece]) -> int:
        return self.capacity - sum(p.length for p in pieces)

    def _classed(self, piece: Piece) -> None:
        k = self.capacity // piece.length
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.open[k] = []
            self.waiting.append(held)
            self._fill()

    def _fill(self) -> None:
        """Tails into what waiting bins have free."""
        while self.waiting:
            held = self.waiting[0]
            room = self._room(held)
            while room and self.tails:
                tail = self.tails[0]
                held.append(tail.take(room) if tail.length > room else self.tails.popleft())
                room -= held[-1].length
            if room:
                return
            self._place(self.waiting.popleft())

    def add(self, doc_id, ids: bytes) -> list[list]:
        piece = Piece(doc_id, 0, len(ids) // 4, len(ids) // 4, ids)
        while piece.length > self.capacity:
            self._place([piece.take(self.capacity)])
        if piece.total <= self.capacity and len(self.waiting) <= self.most_waiting or piece.length == self.capacity:
            self._classed(piece)
        else:
            self.tails.append(piece)
            self._fill()
            if len(self.tails) > self.most_tails:
                self._classed(self.tails.popleft())
        done, self.done = self.done, []
        return done

    def close(self) -> list[list]:
        bins = list(self.waiting)
        rooms = [self._room(b) for b in bins]
        left = [*self.tails, *(p for held in self.open.values() for p in held)]
        for piece in sorted(left, key=lambda p: -p.length):
            at = next((k for k, room in enumerate(rooms) if room >= piece.length), len(bins))
            if at == len(bins):
                bins.append([])
                rooms.append(self.capacity)
            bins[at].append(piece)
            rooms[at] -= piece.length
        order = deque(sorted(bins, key=self._room))
        while order:
            held = order.popleft()
            room = self._room(held)
            while room and order:
                last = order[-1]
                held.append(last[-1].take(room) if last[-1].length > room else last.pop())
                room -= held[-1].length
                if not last:
                    order.pop()
            while held:  # whole, or of a power of two
                size = self.capacity - room
                part, want = [], 1 << (size.bit_length() - 1)
                room += want
                while want:
                    part.append(held[0].take(want) if held[0].length > want else held.pop(0))
                    want -= part[-1].length
                self._place(part)
        self.open, self.waiting, self.tails = {}, deque(), deque()
        done, self.done = self.done, []
        return done


_OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pack(tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    schema = _OUT.append(pa.field("ids", pa.binary())) if with_ids else _OUT

    def rows(done: list[list]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)  # noqa: B905

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), array("I", [end_id]).tobytes()
        context = TaskContext.get()
        bins = Bins((context.partitionId() if context else 0) << 40, capacity)
        for batch in batches:
            done: list[list] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                done += bins.add(doc_id, encode(text.as_py() or "") + end)
                if len(done) >= 20_000:
                    yield rows(done)
                    done = []
            yield rows(done)
        yield rows(bins.close())

    return run


def pack(documents: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    ``capacity`` is a power of two. Every sequence is full or of a power-of-two length.
    A null or empty text is the end id alone. A
    text that holds a special token's own string gets that token's id. Repeated
    rows and ids, and null ids, are documents like others. Other columns are
    ignored; an empty table gives no rows. sequence_id is unique over all
    workers (the partition's number times 2^40 plus a running number).
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(tokenizer, capacity, end_id, with_ids), schema)
