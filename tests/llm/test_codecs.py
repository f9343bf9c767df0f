"""Token counts, token-ID shards and the piece codec against the libraries."""

import io
import itertools
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillstone.llm import bpe_count, piece_codec, token_store

ODD = [
    "", " ", "a  b", "a   b", " a", "a ", "a \n b", "x\n\n\n y  ", "\t\t a\r\n", "don't we'll x y'tis",
    "<|endoftext|>hi <|endoftext|>", "<|ENDOFTEXT|> A<|endoftext|>.. b<|.. q—.. É..", "İstanbul.. ½² ΑΣ ς", "日本語 テキスト", "é é    x",
    "<s> </s> <unk>", "w" * 3000, "ab " * 3000,
]


def texts():
    rng = random.Random(4)
    alphabet = "abcdeéüñ THE.,!?'%-_019\n "
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(200)]


def test_token_counts_match_the_library(spark):
    path = bpe_count.default_tokenizer()
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts(), add_special_tokens=False)]
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(None, None, 1), (0, None, 1)]
    got = {(r.doc_id, r.n_bytes): r for r in bpe_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(2)).collect()}
    assert [got[i, len(t.encode())].n_tokens for i, t in enumerate(texts())] == want
    assert got[None, 0].n_tokens == 0 and not got[None, 0].over_limit
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.values()) and any(r.over_limit for r in got.values())


def test_white_space_of_all_kinds_is_cut_as_the_library_cuts_it():
    kinds = ["a", " ", "\n", "\xa0", "\u3000", "\x85", "\u2003", "\x1c", "'s"]
    tok, c = Tokenizer.from_file(bpe_count.default_tokenizer()), bpe_count.TokenCounter(bpe_count.default_tokenizer())
    rng = random.Random(9)
    more = kinds + list("bc\u00e91.,!?\u65e5\t\r\u2028\u2029\u202f\u205f\u1680\x1f\x0b\u200b\ufeff\u180e") + ["<|endoftext|>", "don't", " the"]
    strings = ["".join(x) for n in range(6) for x in itertools.product(kinds, repeat=n)] + ["".join(rng.choice(more) for _ in range(rng.randrange(60))) for _ in range(8000)]
    want = [len(e.ids) for e in tok.encode_batch(strings, add_special_tokens=False)]
    assert [c.count(t.encode()) for t in strings] == want


def test_small_caches_change_nothing(monkeypatch):
    want = [bpe_count.TokenCounter(bpe_count.default_tokenizer()).count(t.encode()) for t in texts()]
    monkeypatch.setattr(bpe_count, "CACHE_MOST", 3)
    c = bpe_count.TokenCounter(bpe_count.default_tokenizer())
    assert [c.count(t.encode()) for t in texts()] == want
    e = list(token_store.ChunkEncoder(token_store.default_tokenizer()).encode_all([t.encode() for t in texts()]))
    monkeypatch.setattr(token_store, "CACHE_MOST", 3)
    assert list(token_store.ChunkEncoder(token_store.default_tokenizer()).encode_all([t.encode() for t in texts()])) == e


def test_shards_match_the_library(spark):
    want, start = [], 0
    tok = Tokenizer.from_file(token_store.default_tokenizer())
    rows = [(5 * i % 1009 - 3, t) for i, t in enumerate(texts())] + [(3000, None), (3001, "twice"), (3001, "twice")]
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((d, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    frame = spark.createDataFrame([(*r, 0) for r in [*rows, (None, "x")]], "doc_id long, text string, start int").repartition(3)
    assert sorted(map(tuple, token_store.store_tokens(frame).collect())) == want
    assert token_store.store_tokens(frame.limit(0)).count() == 0


def test_shard_reader_reads_what_is_asked_for_and_checks_it(monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_IDS", 5)
    sink = io.BytesIO()
    out = token_store.ShardWriter(sink)
    docs = {1: b"abcd" * 3, 4: b"", 9: b"wxyz" * 23}
    for d, ids in docs.items():
        out.add(d, ids)
    out.close()
    data = sink.getvalue()
    shard = token_store.ShardReader(io.BytesIO(data))
    assert [shard.ids(shard.find(d)[0]) for d in docs] == [*docs.values()] and shard.find(5) == []
    hurt = bytearray(data)
    hurt[3] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        token_store.ShardReader(io.BytesIO(bytes(hurt))).ids(0)
    assert token_store.ShardReader(io.BytesIO(bytes(hurt))).ids(2) == docs[9]
    with pytest.raises(ValueError):
        token_store.ShardReader(io.BytesIO(data[:-1]))


def test_pieces_without_dropout_are_the_models_own():
    path = piece_codec.default_model()
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.segmenter(path, 0.0, 1, 0)
    for t in texts():
        assert np.frombuffer(own.encode(t), "<i4").tolist() == sp.encode(t), t


def test_dropout_varies_and_loses_nothing(spark):
    rows = [(i, t) for i, t in enumerate([*texts(), "a▁b \x00"])] + [(None, None), (3, "  "), (3, "  ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    a, b = (piece_codec.encode(frame, rate=0.3, seed=s) for s in (1, 2))
    assert all(r.lossless for r in a.collect()) and sorted(a.collect(), key=str) == sorted(a.collect(), key=str)
    assert sorted(a.collect(), key=str) != sorted(b.collect(), key=str)
    assert sorted(map(str, piece_codec.decode(a).collect())) == sorted(map(str, frame.fillna("").collect()))
    full = piece_codec.encode(frame, rate=1.0).filter("doc_id = 9").first()
    assert full.n_tokens >= len(texts()[9])
    assert piece_codec.encode(frame.limit(0)).count() == 0
