"""Records, byte-pair encoding and packing against the libraries and brute force."""

import base64
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridspark.llm import bpe, packing, pieces, records
from gridspark.scratch import scratch_path

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, offset int, _part string, ids int, sequence_id string"
TEXTS = ["", None, "a", "It's we'll 'tis ''s x'd 5's\n's \n 're  'll", "  two  spaces\n\n\tand tabs  x ", "Ünï çö∂é 中文 𝔘 १२", "x" * 5000,
         "the quick brown fox, " * 3000, "<|endoftext|> a<|endoftext|>", "trailing ", " leading", "\x1c\x1d a", "a\r\nb", "ΑΣ Σ"]


def rows():
    ids = [7, None, 3, 3, 3, 12, -5, 100, 101, 102, 103, 104, 105, 2**60]
    return [(i, t, "x", 1, "p", 2, "s") for i, t in zip(ids, TEXTS, strict=True)] + [(3, "a", None, None, None, None, None)]


@pytest.fixture(scope="module")
def tik():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab stmdrevl'’5é \n\t .,-中१")), max_size=4))
def test_bpe_equals_tiktoken(texts):
    own = bpe.rank_encoder(MULTI)
    if not hasattr(test_bpe_equals_tiktoken, "tik"):
        test_bpe_equals_tiktoken.tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text, (ids, offsets) in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == test_bpe_equals_tiktoken.tik.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
        assert not text or offsets[0] == 0


def test_bpe_query_shapes(spark, tik):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode(df, MULTI).collect()}
    for doc_id, text, *_ in rows():
        ids = tik.encode_ordinary(text or "")
        r = got[doc_id, len(ids)]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
    assert bpe.digests(df.limit(0), MULTI).count() == 0
    assert {r.decoded_sha256 for r in bpe.digests(df, MULTI).collect()} == {__import__("hashlib").sha256((t or "").encode()).hexdigest() for t in TEXTS}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abS 's\n\t .中́")), max_size=4))
def test_pieces_equal_library(texts):
    for file, spaced in ((BYTE, True), (WORD, False)):
        own = pieces.encoder(file, spaced)
        plain = [x.ids for x in own.library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == plain


def test_crc32c_known_values():
    # published check value, and the four test strings of RFC 3720
    datas = [b"123456789", bytes(32), b"\xff" * 32, bytes(range(32)), bytes(range(31, -1, -1))]
    assert records.crc32c(datas).tolist() == [0xE3069283, 0x8A9136AA, 0x62A8AB43, 0x46DD794E, 0x113FDB5C]


def _slow_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (records.CASTAGNOLI if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=4, max_size=900), min_size=1, max_size=6))
def test_crc32c_and_frames(datas):
    assert records.crc32c(datas).tolist() == [_slow_crc(x) for x in datas]
    framed = records.frame(datas)
    assert records.unframe(framed) == datas
    assert struct.unpack("<Q", framed[0][:8])[0] == len(datas[0])
    with pytest.raises(ValueError, match="damaged"):
        records.unframe([framed[0][:-5] + bytes([framed[0][-5] ^ 1]) + framed[0][-4:]])


@pytest.mark.parametrize("seed", [None, 3])
def test_records_round_trip(spark, seed):
    df, path = spark.createDataFrame(rows(), SCHEMA).repartition(3), scratch_path(spark, "records")
    records.write_records(df, path, BYTE, parts=4)
    got = records.read_records(spark, path, seed).orderBy("start").collect()
    library = Tokenizer.from_file(BYTE)
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, text, *_) in zip(got, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        start += len(ids)


def test_records_of_nothing(spark):
    df, path = spark.createDataFrame([], SCHEMA), scratch_path(spark, "records")
    records.write_records(df, path, BYTE)
    assert records.read_records(spark, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(np.array(lengths), 64)
    free: list[int] = []
    for size, item in sorted(((s, i) for i, s in enumerate(lengths)), key=lambda x: (-x[0], x[1])):  # the plain rule
        at = next((k for k, room in enumerate(free) if room >= size), len(free))
        if at == len(free):
            free.append(64)
        assert (bins[item], offsets[item]) == (at, 64 - free[at])
        free[at] -= size


def test_packing(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = packing.pack(df, WORD, 2, keep_ids=True).cache()
    library = Tokenizer.from_file(WORD)
    whole = sorted((doc_id is not None, doc_id or 0, ids) for doc_id, text, *_ in rows() for ids in [[*library.encode(text or "", add_special_tokens=False).ids, 2]])
    assert got.filter("start = 0").count() == len(whole)
    assert got.selectExpr("sum(length)").first()[0] == sum(len(x) for *_, x in whole)
    for r in got.collect():
        options = [ids for *_, d, ids in whole if (d or None) == (r.doc_id or None) and len(ids) == r.doc_tokens]
        piece = np.frombuffer(bytes(r.ids), "<u4")
        assert any(ids[r.start:r.start + r.length] == piece.tolist() for ids in options)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for r in got.groupBy("sequence_id").agg({"length": "sum"}).collect():
        assert r[1] <= 4096
    ends = got.selectExpr("sequence_id", "offset", "offset + length as e").orderBy("sequence_id", "offset").collect()
    at = {}
    for r in ends:
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.e
    for r in packing.sequences(got).collect():
        assert len(r.ids) // 4 == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 4096)
    assert packing.pack(df.limit(0), WORD, 2).count() == 0


def test_packing_groups(spark):
    df = spark.range(900).selectExpr("id % 300 as doc_id", "repeat('word ', cast(id * 7 % 900 as int)) as text")
    got = packing.pack(df, WORD, 2, group_docs=100)
    assert got.filter("start = 0").count() == 900
    assert got.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0
    assert got.selectExpr("count(distinct sequence_id >> 32)").first()[0] > 1


def test_pieces_that_name_special_tokens():
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>c <|startoftext|>", " <|endoftext|>a <|endoftext|>a"]
    for file, spaced in ((BYTE, True), (WORD, False)):
        own = pieces.encoder(file, spaced)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [x.ids for x in own.library.encode_batch(texts, add_special_tokens=False)]
