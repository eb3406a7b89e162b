"""Texts split into pre-tokens and encoded by way of their distinct pre-tokens, in numpy.

The split is that of byte-level BPE with ``PATTERN``. It follows from runs of
characters of one class (letter, number, white space, other):

* a run that is no white space is a piece, together with one space (U+0020)
  before it;
* white space left over: all but its last character is a piece if text
  follows, and the last one too, unless it is the space that joined the next
  run; at the end of a text it is one piece;
* an apostrophe alone, with no space before it, takes ``s t re ve m ll d`` from
  the letters that follow.

Pieces are found by 64-bit hashes of their characters (a polynomial, from
prefix sums). A piece seen before is a lookup in a numpy hash table; a new one is
cut out and encoded once. The characters of the piece found are compared with those
of the piece looked up: where they differ (two pieces of one hash), the piece is encoded by
itself. The cache is bounded; when full it keeps the pieces that
came up again since it was last full. Long texts are worked on in parts, cut before a space between two other characters,
which always begins a piece.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from logtide.llm.hashing import mixed

# Fixed value: the pattern of byte-level BPE vocabularies that this module splits by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE_PIECES = 300_000  # about 100 bytes each
GROUP_CHARS = 1 << 18
_POINT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_OTHER, _LETTER, _NUMBER, _SPACE, _BREAK = range(5)
_END = 0x110000  # stands between texts; no character
_SAFE = re.compile(r"\S (?=\S)")
_state: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    if "classes" not in _state:
        kinds = {"L": _LETTER, "N": _NUMBER}
        t = np.full(_END + 1, _OTHER, np.uint8)  # no letter or number is assigned above the third plane
        t[:0x40000] = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x40000)), np.uint8, 0x40000)
        t[_END] = _BREAK
        # The characters with the Unicode property White_Space.
        t[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _state["classes"] = t
    return _state["classes"]


def codes_of(texts: list[str]) -> np.ndarray:
    """Code points of the texts, ``_END`` after each."""
    end = _END.to_bytes(4, "little")
    return np.frombuffer(b"".join(x for t in texts for x in (t.encode("utf-32-le", "surrogatepass"), end)), "<u4")


def piece_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pieces of all texts, in order."""
    kind = _classes()[codes]
    first = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(codes) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(codes))
    k = kind[first]
    begin, stop = first.copy(), last.copy()
    space = k == _SPACE
    follows = np.append(k[1:], _BREAK) != _BREAK
    joined = space & follows & (codes[last - 1] == 32)  # its last space belongs to the next run
    stop[joined] -= 1
    begin[1:][joined[:-1]] -= 1
    # White space before text that does not end in U+0020: the last character is a piece of its own.
    apart = space & follows & ~joined & (last - first > 1)
    stop[apart] -= 1
    extra = last[apart] - 1
    # Contractions.
    alone = (k == _OTHER) & (last - first == 1) & (begin == first) & (codes[first] == 39)
    alone[:-1] &= k[1:] == _LETTER
    alone[-1:] = False
    at = np.flatnonzero(alone)
    if len(at):
        a, room = codes[first[at] + 1], last[at + 1] - first[at + 1]
        b = codes[np.minimum(first[at] + 2, len(codes) - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (room > 1) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        take = np.where(one, 1, np.where(two, 2, 0))
        stop[at] += take
        begin[at + 1] += take
    keep = (stop > begin) & (k != _BREAK)
    begin, stop = begin[keep], stop[keep]
    if len(extra):
        begin, stop = np.append(begin, extra), np.append(stop, extra + 1)
        order = np.argsort(begin, kind="stable")
        begin, stop = begin[order], stop[order]
    return begin, stop


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd point and of its inverse modulo 2^64."""
    if len(_state.get("up", ())) < n:
        size = max(n, GROUP_CHARS + GROUP_CHARS // 4)
        for name, base in (("up", _POINT), ("down", pow(_POINT, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _state[name] = np.multiply.accumulate(steps)
    return _state["up"], _state["down"]


def _hashes(codes: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    h = mixed((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    return np.where(h == 0, np.uint64(1), h)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + lengths[i]], one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(ends[-1])
    return flat[at]


class _Table:
    """hash -> number for non-zero 64-bit hashes: open addressing, whole arrays at a time."""

    def __init__(self, most: int):
        self.bits = max(4, (2 * most).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.numbers = np.zeros(1 << self.bits, np.int32)
        self.size = 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash: its own, or the free one where it would go."""
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.keys[slots]
        open_ = np.flatnonzero((found != hashes) & (found != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            open_ = open_[(found != hashes[open_]) & (found != 0)]
        return slots

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where it is new."""
        slots = self._slots(hashes)
        return np.where(self.keys[slots] == hashes, self.numbers[slots], -1)

    def make_room(self, more: int) -> None:
        """A larger table where ``more`` hashes would fill this one beyond a half (a text with very many pieces)."""
        if self.size + more > 1 << (self.bits - 1):
            there = np.flatnonzero(self.keys)
            order = there[np.argsort(self.numbers[there])]
            hashes = self.keys[order]
            self.__init__(self.size + more)
            self.add(hashes)

    def add(self, hashes: np.ndarray) -> None:
        """New distinct hashes get the next numbers, in order."""
        numbers = np.arange(self.size, self.size + len(hashes), dtype=np.int32)
        self.size += len(hashes)
        while len(hashes):
            slots = self._slots(hashes)
            _, first = np.unique(slots, return_index=True)  # one for each free slot, the others go on
            self.keys[slots[first]], self.numbers[slots[first]] = hashes[first], numbers[first]
            rest = np.ones(len(hashes), bool)
            rest[first] = False
            hashes, numbers = hashes[rest], numbers[rest]


class _Growing:
    """An array that rows are appended to; its room doubles."""

    def __init__(self, dtype):
        self.rows, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.rows):
            room = np.zeros(2 * (self.n + len(values)), self.rows.dtype)
            room[: self.n] = self.rows[: self.n]
            self.rows = room
        self.rows[self.n : self.n + len(values)] = values
        self.n += len(values)


class PieceEncoder:
    """Ids of whole texts; ``encode_pieces`` gives (flat ids, lengths) for a list of distinct pieces."""

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode_pieces = encode_pieces
        self._clear()

    def _clear(self) -> None:
        self.table = _Table(CACHE_PIECES)
        self.flat, self.starts, self.lengths = _Growing(np.uint32), _Growing(np.int64), _Growing(np.int64)
        self.codes, self.code_starts, self.code_lengths = _Growing(np.uint32), _Growing(np.int64), _Growing(np.int64)
        self.hashes, self.uses = _Growing(np.uint64), _Growing(np.int32)

    def _add(self, hashes: np.ndarray, codes: np.ndarray, code_lengths: np.ndarray, flat: np.ndarray, lengths: np.ndarray, uses: np.ndarray) -> None:
        self.table.add(hashes)
        self.code_starts.add(self.codes.n + np.cumsum(code_lengths) - code_lengths)
        self.code_lengths.add(code_lengths)
        self.codes.add(codes)
        self.starts.add(self.flat.n + np.cumsum(lengths) - lengths)
        self.lengths.add(lengths)
        self.flat.add(flat)
        self.hashes.add(hashes)
        self.uses.add(uses)

    def _shrink(self) -> None:
        """Keep the most used half at most, of the pieces used again."""
        n = self.table.size
        uses = self.uses.rows[:n]
        kept = np.flatnonzero(uses > 0)
        if len(kept) > CACHE_PIECES // 2:
            kept = kept[np.argsort(-uses[kept], kind="stable")[: CACHE_PIECES // 2]]
        lengths, hashes = self.lengths.rows[kept], self.hashes.rows[kept]
        flat = gather(self.flat.rows, self.starts.rows[kept], lengths)
        code_lengths = self.code_lengths.rows[kept]
        codes = gather(self.codes.rows, self.code_starts.rows[kept], code_lengths)
        self._clear()
        self._add(hashes, codes, code_lengths, flat, lengths, np.zeros(len(kept), np.int32))

    def _encoded(self, codes: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, lengths) of the pieces cut out."""
        text = codes.tobytes()
        return self.encode_pieces([text[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(begin.tolist(), stop.tolist())])

    def _numbers(self, codes: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        hashes = _hashes(codes, begin, stop)
        if self.table.size > CACHE_PIECES:
            self._shrink()
        numbers = self.table.lookup(hashes)
        old = numbers >= 0
        self.uses.rows[: self.table.size] += np.bincount(numbers[old], minlength=self.table.size).astype(np.int32)
        new = np.flatnonzero(~old)
        if len(new):
            names, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            flat, lengths = self._encoded(codes, begin[at], stop[at])
            sizes = (stop - begin)[at]
            self.table.make_room(len(names))
            self._add(names, gather(codes, begin[at], sizes), sizes, flat, lengths, np.zeros(len(names), np.int32))
            numbers[new] = self.table.lookup(hashes[new])
        return numbers

    def _strangers(self, codes: np.ndarray, begin: np.ndarray, stop: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Places of the pieces that are not the piece of their number."""
        sizes = stop - begin
        same = self.code_lengths.rows[numbers] == sizes
        if not same.all():
            at = np.flatnonzero(same)
            own, found = gather(codes, begin[at], sizes[at]), gather(self.codes.rows, self.code_starts.rows[numbers[at]], sizes[at])
            same[at[np.searchsorted(np.cumsum(sizes[at]), np.flatnonzero(own != found), "right")]] = False
            return np.flatnonzero(~same)
        found = gather(self.codes.rows, self.code_starts.rows[numbers], sizes)
        differs = codes[codes != _END] != found  # the pieces are all characters, in order
        return np.unique(np.searchsorted(np.cumsum(sizes), np.flatnonzero(differs), "right")) if differs.any() else np.zeros(0, np.int64)

    def _group(self, parts: list[str], owner: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
        codes = codes_of(parts)
        begin, stop = piece_bounds(codes)
        numbers = self._numbers(codes, begin, stop)
        starts, lengths, flat = self.starts.rows[numbers], self.lengths.rows[numbers], self.flat.rows
        strange = self._strangers(codes, begin, stop, numbers)
        if len(strange):
            ids, lengths[strange] = self._encoded(codes, begin[strange], stop[strange])
            starts[strange] = self.flat.n + np.cumsum(lengths[strange]) - lengths[strange]
            flat = np.concatenate([flat[: self.flat.n], ids.astype(flat.dtype)])
        ends = np.cumsum([len(p) + 1 for p in parts])
        part = np.searchsorted(ends, begin, "right")
        counts = np.bincount(np.array(owner, np.int64)[part], lengths, n).astype(np.int64)
        return gather(flat, starts, lengths), counts

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids) of each text, in order; null is empty."""
        parts: list[str] = []
        owner: list[int] = []
        first, size, kept = 0, 0, []

        def flush(upto: int, whole: bool) -> Iterator[tuple[int, np.ndarray]]:
            """Texts first..upto - 1; a last text that goes on is kept back."""
            nonlocal kept
            ids, counts = self._group(parts, owner, upto - first)
            runs = np.split(ids, np.cumsum(counts)[:-1])
            for k, run in enumerate(runs):
                run = np.concatenate([*kept, run]) if kept else run
                kept = []
                if k + 1 < len(runs) or whole:
                    yield first + k, run
                else:
                    kept = [run]

        for i, text in enumerate(texts):
            text = text or ""
            at = 0
            while True:
                m = _SAFE.search(text, at + GROUP_CHARS) if len(text) - at > 2 * GROUP_CHARS else None
                stop = m.start() + 1 if m else len(text)
                parts.append(text[at:stop])
                owner.append(i - first)
                size += stop - at
                at = stop
                done = at >= len(text)
                if size >= GROUP_CHARS:
                    yield from flush(i + 1, done)
                    first, size = i + done, 0
                    parts.clear()
                    owner.clear()
                if done:
                    break
        if parts:
            yield from flush(len(texts), True)
