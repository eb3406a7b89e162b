"""BPE and id files against the two libraries, and round trips."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from logtide.llm import bpe, idfiles, pieces

ODD = [
    "", None, "  a", " ", "a ", "a  ", "a \n b", "\n \n", "a  b", "don't 's x's  I'll", "<|endoftext|> hi", "日本語 テスト",
    "\x1c \x1c x", "a \x85 b", "é x   \t\t y", "\n a", "a \n \n", "  \n", "😀😀 👍🏽 x", "nul \0 in \0\0", "  wide 　",
    "x" * 5000, "!!!! ... ,,, " * 50, "1234567890 " * 30, "a b   c", "zzzzqqqqxxxx" * 40,
]


def texts(n=150, seed=1):
    rnd = random.Random(seed)
    alphabet = list("abcdefghij   \n\t.,'!éß漢😀09 ") + ["the ", "tion", " 's", "  "]
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(120))) for _ in range(n)]


@pytest.fixture(scope="module")
def multi():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def test_perfect_hash(multi):
    h = bpe.PerfectHash.build(multi)
    keys = list(multi)
    assert h.lookup(keys).tolist() == [multi[k] for k in keys] and len(h.keys) == len(keys)
    assert h.lookup([b"", b"no such token here", keys[0] * 9]).tolist() == [-1, -1, -1]
    assert bpe.PerfectHash.build({b"x": 0}).lookup([b"x", b"y"]).tolist() == [0, -1]


def test_merge_order():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5, b"aa": 6}
    assert bpe.merge_bytes(b"abc", ranks) == [5] and bpe.merge_bytes(b"abbc", ranks) == [3, 4]
    assert bpe.merge_bytes(b"aaa", ranks) == [6, 0] and bpe.merge_bytes(b"a", ranks) == [0]


def test_split_is_the_pattern(monkeypatch):
    import regex

    assert pieces.PATTERN == P.PATTERN
    split = regex.compile(P.PATTERN).findall
    ts = [t or "" for t in texts(2000, 7)] + ["it's I'll 'tis we've'd o'rest x're\nx'S '", "'", "''s", "a'", "\n's", "'sx'llama'l 'r"]
    codes = pieces.codes_of(ts)
    text = codes.tobytes()
    got = [text[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(*(x.tolist() for x in pieces.piece_bounds(codes)))]
    assert got == [p for t in ts for p in split(t)]


@pytest.mark.parametrize("cache", [400_000, 5])
def test_codec_is_the_library(multi, cache, monkeypatch):
    import tiktoken

    monkeypatch.setattr(pieces, "CACHE_PIECES", cache)
    monkeypatch.setattr(pieces, "GROUP_CHARS", 100)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=multi, special_tokens={})
    codec = bpe.Codec(multi, bpe.PerfectHash.build(multi))
    got = list(codec.encode(texts()))
    assert [i for i, _ in got] == list(range(len(texts())))
    for t, (_, ids) in zip(texts(), got, strict=True):
        assert ids.tolist() == library.encode_ordinary(t or ""), t
        assert codec.decode(ids) == (t or "").encode() and codec.decimal(ids) == ",".join(map(str, ids.tolist())).encode()


# Pairs of pieces that any polynomial modulo 2^64 gives one hash.
PATTERNED = [f(t) for n in (10, 11, 12, 13) for t in ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1 << n)) for k in (0, 1)) for f in (str, "some {0} words {0} here".format)]


def test_pieces_of_one_hash(spark, multi, tmp_path):
    import tiktoken

    from logtide.llm import queries

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=multi, special_tokens={})
    codec = bpe.Codec(multi, bpe.PerfectHash.build(multi))
    for ts in (PATTERNED, PATTERNED[::-1], [" ".join(PATTERNED)]):
        assert [ids.tolist() for _, ids in codec.encode(ts)] == [library.encode_ordinary(t) for t in ts]
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    assert [x.tolist() for _, x in idfiles.library_encoder(definition)[0].encode(PATTERNED)] == default_ids(definition, PATTERNED)
    rows_of(spark, PATTERNED).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.queries()["op6_byte_bpe"](spark, str(tmp_path)).collect()
    want = sorted(hashlib.sha256(t.encode()).hexdigest() for t in PATTERNED)
    assert sorted(r.decoded_sha256 for r in rows) == want
    assert sorted(r.n_tokens for r in queries.queries()["op4_id_files"](spark, str(tmp_path)).collect()) == sorted(len(x) + 1 for x in default_ids(definition, PATTERNED))


def library_ids(path, ts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in ts], add_special_tokens=False)]


def test_library_encoder_is_the_library():
    path = P.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        encoder, size = idfiles.library_encoder(f.read())
    got = [x.tolist() for _, x in encoder.encode(texts(seed=2))]
    assert got == library_ids(path, texts(seed=2)) and size == 50257
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        idfiles.library_encoder(f.read())


QUOTING = [
    "a <|endoftext|> hi", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y", "it<|endoftext|>'s", "<|endoftext|", "<<|endoftext|>>",
    "\n<|endoftext|>\n", "a " * 300_000 + "<|endoftext|> b" * 3,
]


def default_ids(definition, ts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(definition)
    return [t.encode(x or "", add_special_tokens=False).ids for x in ts]


def test_added_tokens_are_the_library_s():
    from tokenizers import AddedToken, Tokenizer

    path = P.path("byte_bpe_50k.json")
    ts = QUOTING + texts(seed=3) + ["<a>", "<a>b <a> <a", "in <a><|endoftext|>b>", "up <A>"]
    more = Tokenizer.from_file(path)
    more.add_tokens([AddedToken("<a>", normalized=True), AddedToken("<a>b", normalized=True), AddedToken("<|endoftext|>b", normalized=False)])
    for definition in (Tokenizer.from_file(path).to_str(), more.to_str()):
        encoder, _ = idfiles.library_encoder(definition, encode_special_tokens=False)
        got = list(encoder.encode(ts))
        assert [i for i, _ in got] == list(range(len(ts)))
        assert [x.tolist() for _, x in got] == default_ids(definition, ts)
    more.add_tokens([AddedToken("<b>", lstrip=True)])
    with pytest.raises(ValueError):
        idfiles.library_encoder(more.to_str())


def test_op4_is_the_library_s_default(spark, tmp_path):
    from logtide.llm import queries

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    ts = QUOTING + [t for t in texts(seed=4) if not t or "\0" not in t]
    rows_of(spark, ts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.queries()["op4_id_files"](spark, str(tmp_path)).collect()}
    by_id = dict(zip([(i * 37) % 1009 for i in range(len(ts))], default_ids(definition, ts)))
    start = 0
    for i in sorted(by_id):
        ids = np.array(by_id[i] + [0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 32])
def test_pack_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 4096, 5000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = idfiles.pack(ids, bits)
        assert len(data) == 8 * -(-n * bits // 64) and idfiles.unpack(data, bits, n).tolist() == ids.tolist()
    assert [idfiles.bits_for(v) for v in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_file_random_access():
    rng = np.random.default_rng(0)
    docs = [(i if i % 7 else None, rng.integers(0, 900, rng.choice([0, 1, 50, 9000])).astype(np.uint32)) for i in range(60)]

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    sink = Source()
    out = idfiles.IdWriter(sink, 10)
    for i, ids in docs:
        out.add(i, ids)
    out.close()
    f = idfiles.IdFile(sink)
    flat = np.concatenate([x for _, x in docs])
    assert f.doc_ids == [i for i, _ in docs] and f.n_ids == len(flat) and f.bits == 10
    assert all(f.document(k).tolist() == x.tolist() for k, (_, x) in enumerate(docs))
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert f.ids(a, b).tolist() == flat[a:b].tolist()
    with pytest.raises(IndexError):
        f.ids(0, len(flat) + 1)
    with pytest.raises(ValueError):
        idfiles.IdFile(Source(b"x" * 80))


def rows_of(spark, ts):
    return spark.createDataFrame([((i * 37) % 1009, t) for i, t in enumerate(ts)], "doc_id long, text string").repartition(6)


def test_id_files(spark):
    path = P.path("byte_bpe_50k.json")
    ts = [t for t in texts() if not t or "\0" not in t]
    t = rows_of(spark, ts)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in idfiles.tokenize_to_files(t, path).collect()}
    start = 0
    by_id = dict(zip([(i * 37) % 1009 for i in range(len(ts))], library_ids(path, ts)))
    for i in sorted(by_id):
        ids = np.array(by_id[i] + [0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_encode_and_decode(spark, multi):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=multi, special_tokens={})
    ts = [t for t in texts() if not t or "\0" not in t]
    for r in bpe.encode_and_decode(rows_of(spark, ts), P.path("byte_bpe_multi_50k.tiktoken")).collect():
        t = next(x for i, x in enumerate(ts) if (i * 37) % 1009 == r.doc_id) or ""
        ids = library.encode_ordinary(t)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_odd_rows(spark, odd_docs, no_docs):
    path = P.path("byte_bpe_50k.json")
    rows = idfiles.tokenize_to_files(odd_docs, path).collect()
    assert len(rows) == odd_docs.count()
    at = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in at] == [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, None, None]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(at, at[1:]))
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    assert idfiles.tokenize_to_files(no_docs, path).collect() == []
    rank_file = P.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode_and_decode(odd_docs, rank_file).collect()
    assert len(rows) == odd_docs.count() and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert bpe.encode_and_decode(no_docs, rank_file).collect() == []
