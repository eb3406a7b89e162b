"""Byte-level BPE from a file of ranks, with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary finds the id of a whole
pre-token that is itself a token. Tier two, for the others: the bytes are a
linked list, neighbouring pairs wait in a heap by (rank, place), and the best
pair is merged until none is in the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from logtide.llm.pieces import PieceEncoder, gather

_SLICE = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank from lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _slots(hashes: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    x = hashes ^ (shifts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


@dataclass
class PerfectHash:
    """Minimal perfect hash by displacement: the keys of a bucket share a shift that sends them to free slots.

    A bucket of one key names its slot itself (as -1 - slot). ``keys`` has the
    vocabulary in slot order, ``ids`` its ids; a lookup compares the key found.
    """

    shifts: np.ndarray
    keys: list[bytes]
    ids: np.ndarray

    @classmethod
    def build(cls, ids: dict[bytes, int]) -> PerfectHash:
        keys = list(ids)
        n, m = len(keys), max(1, len(keys) // 4)
        hashes = cls._hash(keys)
        if len(np.unique(hashes)) < n:
            raise ValueError("two tokens with one hash")
        bucket = (hashes % np.uint64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=m)
        starts = np.cumsum(sizes) - sizes
        taken, slot_of, shifts = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(m, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            mine = order[starts[b] : starts[b] + sizes[b]]
            at = 1
            while not shifts[b]:
                tries = np.arange(at, at + 64)
                slots = _slots(hashes[mine][None, :], tries[:, None], n)
                free = ~taken[slots].any(1)
                for t in np.flatnonzero(free):
                    if len(set(slots[t].tolist())) == len(mine):
                        shifts[b], slot_of[mine] = tries[t], slots[t]
                        taken[slots[t]] = True
                        break
                at += 64
        single = order[starts[sizes == 1]]
        open_ = np.flatnonzero(~taken)
        slot_of[single] = open_
        shifts[bucket[single]] = -1 - open_
        by_slot = np.argsort(slot_of)
        return cls(shifts, [keys[i] for i in by_slot], np.array([ids[keys[i]] for i in by_slot], np.int64))

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The id of each word, -1 for words outside the vocabulary."""
        if not words or not self.keys:
            return np.full(len(words), -1)
        hashes = self._hash(words)
        shift = self.shifts[(hashes % np.uint64(len(self.shifts))).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, _slots(hashes, np.maximum(shift, 0), len(self.keys)))
        same = np.fromiter((self.keys[s] == w for s, w in zip(slots.tolist(), words)), bool, len(words))
        return np.where(same, self.ids[slots], -1)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the neighbours with the lowest rank (the leftmost of equals) are merged until none is a token."""
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i stops; 0 once it is part of another
    before = list(range(-1, n))
    wide = n + 1
    heap = [(r * wide + i) * wide + i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        at, stop = divmod(heappop(heap), wide)
        i = at % wide
        j = end[i]
        if not j or j >= n or end[j] != stop:  # merged meanwhile
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            k = end[stop]
            if (r := get(piece[i:k])) is not None:
                heappush(heap, (r * wide + i) * wide + k)
        h = before[i]
        if h >= 0 and (r := get(piece[h:stop])) is not None:
            heappush(heap, (r * wide + h) * wide + stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes whole texts; built once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], perfect: PerfectHash):
        self.ranks, self.perfect = ranks, perfect
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.token_flat, self.token_starts, self.token_lengths = _table(tokens)
        self.digit_flat, self.digit_starts, self.digit_lengths = _table([b"%d," % i for i in range(len(tokens))])
        self.encode = PieceEncoder(self._encode_pieces).encode

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        ids = self.perfect.lookup(data)
        lengths = np.ones(len(data), np.int64)
        missed = np.flatnonzero(ids < 0).tolist()
        rows = [merge_bytes(data[i], self.ranks) for i in missed]
        lengths[missed] = [len(r) for r in rows]
        starts = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.uint32)
        out[starts[ids >= 0]] = ids[ids >= 0]
        for i, row in zip(starts[missed].tolist(), rows):
            out[i : i + len(row)] = row
        return out, lengths

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_flat, self.token_starts[ids], self.token_lengths[ids]).tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return gather(self.digit_flat, self.digit_starts[ids], self.digit_lengths[ids]).tobytes()[:-1]


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


_codecs: dict[str, Codec] = {}


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the bytes the ids decode to).

    ``path`` names a rank file on the driver, for ``pieces.PATTERN``; its content
    (bounded by the vocabulary) is broadcast. Null and empty texts have no ids and decode to
    nothing. Each row gives a row; other columns are not read.
    """
    ranks = read_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash.build(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _codecs:
            _codecs.clear()
            _codecs[path] = Codec(*sent.value)
        codec = _codecs[path]
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                part = batch.slice(start, _SLICE)
                counts, id_marks, text_marks = [], [], []
                for _, ids in codec.encode(part.column(1).to_pylist()):
                    counts.append(len(ids))
                    id_marks.append(hashlib.sha256(codec.decimal(ids)).hexdigest())
                    text_marks.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(id_marks, pa.string()), pa.array(text_marks, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
