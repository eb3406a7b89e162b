"""Token ids in binary files: fixed-width bit packing with block offsets.

A file holds the ids of documents in a row, each id in the fewest bits that
the vocabulary needs:

* 8 bytes ``LTIDS001``;
* the blocks: ``BLOCK`` ids each (the last one fewer), packed from the low bit
  of little-endian 64-bit words, padded to whole words;
* the index: block offsets (blocks + 1, from the start of the file), document
  starts (documents + 1, in ids), document ids and a byte each that is 1 for a
  null id; all numbers 64 bits, little-endian;
* the tail, 6 numbers of 64 bits: bits, block length, documents, ids, blocks,
  place of the index.

Block offsets let a reader unpack any run of ids by reading only its blocks.
A writer keeps one block and the index of its file in memory. Files are
written by the tasks themselves, under a name of the attempt's own, then moved
to their place, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.pieces import PieceEncoder
from logtide.llm.store import cut, new_path

MAGIC = b"LTIDS001"
BLOCK = 4096  # a multiple of 64
_SLICE = 512


def bits_for(vocabulary: int) -> int:
    """Bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, padded to whole 64-bit words. 64 ids fill ``bits`` words, so one step packs a column of all groups."""
    groups = -(-len(ids) // 64)
    x = np.zeros((groups, 64), np.uint64)
    x.ravel()[: len(ids)] = ids
    out = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= x[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= x[:, j] >> np.uint64(64 - shift)
    return out.ravel()[: -(-len(ids) * bits // 64)].astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    groups = -(-n // 64)
    words = np.zeros(groups * bits, np.uint64)
    raw = np.frombuffer(data, "<u8")[: groups * bits]
    words[: len(raw)] = raw
    words = words.reshape(groups, bits)
    mask = np.uint64((1 << bits) - 1)
    out = np.empty((groups, 64), np.uint32)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.ravel()[:n]


class IdWriter:
    """Writes one file; ``add`` takes a document at a time."""

    def __init__(self, sink, bits: int):
        self.sink, self.bits = sink, bits
        self.pending: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.place = len(MAGIC)
        self.offsets, self.starts = [self.place], [0]
        self.doc_ids: list[int | None] = []
        sink.write(MAGIC)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        whole = len(ids) // BLOCK * BLOCK
        if whole:  # full blocks end at whole words, so they are packed at once
            data = pack(ids[:whole], self.bits)
            self.sink.write(data)
            step = len(data) * BLOCK // whole
            self.offsets += range(self.place + step, self.place + len(data) + 1, step)
            self.place += len(data)
        ids = ids[whole:].copy()
        if last and len(ids):
            data = pack(ids, self.bits)
            self.sink.write(data)
            self.place += len(data)
            self.offsets.append(self.place)
            ids = ids[:0]
        self.pending, self.waiting = [ids], len(ids)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.pending.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        self.starts.append(self.ids)
        if self.waiting >= 64 * BLOCK:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        null = np.array([i is None for i in self.doc_ids], np.uint8)
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(np.array([i or 0 for i in self.doc_ids], "<i8").tobytes())
        self.sink.write(null.tobytes())
        tail = [self.bits, BLOCK, len(self.doc_ids), self.ids, len(self.offsets) - 1, self.place]
        self.sink.write(np.array(tail, "<u8").tobytes())


class IdFile:
    """Reads a file: ``ids(a, b)`` any run, ``document(i)`` one document."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(0)
        if size < len(MAGIC) + 48 or source.read(len(MAGIC)) != MAGIC:
            raise ValueError("no file of token ids")
        source.seek(size - 48)
        self.bits, self.block, n_docs, self.n_ids, n_blocks, index = np.frombuffer(source.read(48), "<u8").astype(np.int64).tolist()
        source.seek(index)
        data = source.read(size - 48 - index)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1).astype(np.int64)
        at = 8 * (n_blocks + 1)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        numbers, null = np.frombuffer(data, "<i8", n_docs, at), np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(numbers.tolist(), null)]

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1 of the file; reads and unpacks only the blocks they lie in."""
        if not 0 <= a <= b <= self.n_ids:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        n = min((last + 1) * self.block, self.n_ids) - first * self.block
        return unpack(data, self.bits, n)[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class AddedTokens:
    """Ids of whole texts, cut at the contents of added tokens as the library cuts them; the rest goes to ``encoder``."""

    def __init__(self, encoder: PieceEncoder, passes: list[dict[str, int]]):
        self.encoder = encoder
        self.ids = {content: np.array([i], np.uint32) for tokens in passes for content, i in tokens.items()}
        # The first place counts, and the longest token there.
        self.cuts = [re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")") for tokens in passes]

    def _parts(self, text: str) -> list[str]:
        """Text, token, text, token, ..., text; the texts may be empty."""
        parts = [text]
        for cut_at in self.cuts:
            parts = [x for k, part in enumerate(parts) for x in ([part] if k % 2 else cut_at.split(part))]
        return parts

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, ids) of each text, in order; null is empty."""
        split = [self._parts(text or "") for text in texts]
        plain = self.encoder.encode([part for parts in split for part in parts[::2]])
        for i, parts in enumerate(split):
            ids = [self.ids[part] if k % 2 else next(plain)[1] for k, part in enumerate(parts)]
            yield i, np.concatenate(ids) if len(ids) > 1 else ids[0]


def library_encoder(definition: str, encode_special_tokens: bool = True) -> tuple[PieceEncoder | AddedTokens, int]:
    """(encoder, size of the vocabulary) of a byte-level tokenizer of the tokenizers library, whose model encodes each piece.

    For definitions that split by ``pieces.PATTERN`` and have no normalizer or
    post-processor, and whose added tokens are matched as they stand (no
    ``single_word``, ``lstrip`` or ``rstrip``). ``encode_special_tokens`` is the
    library's attribute of that name: special tokens' texts are ordinary text if
    it is set, else they become their ids, which is the library's default.
    Added tokens that are not special always become theirs.
    """
    from tokenizers import Tokenizer

    split = json.loads(definition)["pre_tokenizer"] or {}
    tokenizer = Tokenizer.from_str(definition)
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain or tokenizer.normalizer is not None or tokenizer.post_processor is not None:
        raise ValueError("not a plain byte-level tokenizer")
    added = [(i, t) for i, t in tokenizer.get_added_tokens_decoder().items() if t.content and not (t.special and encode_special_tokens)]
    if any(t.single_word or t.lstrip or t.rstrip for _, t in added):
        raise ValueError("added tokens with single_word, lstrip or rstrip")
    encode, letters = tokenizer.model.tokenize, _byte_letters()

    def ids(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [[t.id for t in encode(p.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))] for p in pieces]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((i for row in rows for i in row), np.uint32, int(lengths.sum())), lengths

    # The library looks for tokens of the text as given first, then for those of the normalized text.
    passes = [{t.content: i for i, t in added if t.normalized == normalized} for normalized in (False, True)]
    passes = [tokens for tokens in passes if tokens]
    encoder = PieceEncoder(ids)
    return AddedTokens(encoder, passes) if passes else encoder, tokenizer.get_vocab_size(with_added_tokens=True)


_encoders: dict[tuple[int, bool], tuple[PieceEncoder | AddedTokens, int]] = {}


def write_ids(docs: DataFrame, definition: str, end_id: int, folder: str, encode_special_tokens: bool = True) -> DataFrame:
    """One file for each range of doc_ids below ``folder``; returns file, no (its place in the order), n_docs, n_ids.

    Documents are in ascending doc_id order (null last, ties by text hash)
    within and across files; null texts are empty; ``end_id`` ends each one.
    The returned table has a row a file and is written to the shared folder.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_hash")]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    sent = spark.sparkContext.broadcast(definition)
    key = zlib.crc32(definition.encode()), encode_special_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = library_encoder(sent.value, encode_special_tokens)
        encoder, vocabulary = _encoders[key]
        bits = bits_for(vocabulary)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        no = TaskContext.get().partitionId()
        final, own = f"{base}/part-{no:06d}.ids", f"{base}/.part-{no:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], np.uint32)
        with store.open_output_stream(own) as sink:
            out = IdWriter(sink, bits)
            for batch in batches:
                for start in range(0, batch.num_rows, _SLICE):
                    part = batch.slice(start, _SLICE)
                    names = part.column(0).to_pylist()
                    for i, ids in encoder.encode(part.column(1).to_pylist()):
                        out.add(names[i], np.concatenate([ids, end]))
            out.close()
        store.move(own, final)
        yield pa.RecordBatch.from_pydict({"file": [final], "no": [no], "n_docs": [len(out.doc_ids)], "n_ids": [out.ids]})

    return cut(rows.select("doc_id", "text").mapInArrow(run, "file string, no long, n_docs long, n_ids long"), "manifest")


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32, read from the files of ``write_ids``.

    The starts of the files are running sums over the manifest, a row a file.
    Each task reads its files a few blocks at a time.
    """
    before = F.sum("n_ids").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    todo = files.select("file", F.coalesce(before, F.lit(0)).alias("start"), "n_docs").filter("n_docs > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(name) as source:
                    f = IdFile(source)
                    for a in range(0, len(f.doc_ids), _SLICE):
                        b = min(a + _SLICE, len(f.doc_ids))
                        starts = f.starts[a : b + 1]
                        ids = f.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                        at = starts - starts[0]
                        marks = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(at, at[1:])]
                        cols = [pa.array(f.doc_ids[a:b], pa.int64()), pa.array(first + starts[:-1]), pa.array(np.diff(starts)), pa.array(marks, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return todo.repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _arrow_uri(path: str) -> str:
    """A path of the shared folder as ``pyarrow.fs`` names it."""
    if path.startswith("s3a://"):
        return "s3://" + path[len("s3a://") :]
    if "://" not in path:
        return "file://" + path.removeprefix("file:")
    return path


def tokenize_to_files(docs: DataFrame, path: str, end_id: int = 0, encode_special_tokens: bool = True) -> DataFrame:
    """Encode with the tokenizer in ``path`` (a file on the driver), write files of ids, read them back: see ``read_ids``.

    A special token's text in a document is ordinary text if
    ``encode_special_tokens`` is set, else its id, as by the library's
    ``encode(text, add_special_tokens=False)``. Each row gives a row; an empty
    table gives none. Other columns are not read.
    """
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    folder = _arrow_uri(new_path(docs.sparkSession, "ids"))
    return read_ids(write_ids(docs, definition, end_id, folder, encode_special_tokens), folder)
