"""Byte-level BPE: against the library on whole tables and on odd texts, and exact round trips."""

import hashlib
import random

import pytest
from conftest import SF
from tokenizers import Tokenizer

from tallyshelf.llm import byte_bpe, registry


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(registry.byte_model())


@pytest.fixture(scope="module")
def model():
    with open(registry.byte_model(), "rb") as file:
        return byte_bpe.ByteModel(file.read())


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


ODD = [
    "", " ", "\n\n a", "   x  \t\n  ", "I'll they're 'S 'll don't", "\x00\x1c \x1d\x1f", "　　a b",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endof", "é" * 500, "ab" * 3000, "!" * 999,
    "Ɥ՘\U000323b0x Ᲊ \U00010d40", "\U0001f600\U0001f468‍\U0001f469 ½²Ⅷ",
]


def test_odd_texts_equal_the_library(model, library):
    rng = random.Random(3)
    spans = [(32, 127), (9, 14), (0xA0, 0x3000), (0x3000, 0xD800), (0x10000, 0x33500)]
    texts = ODD + [
        "".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randrange(200))) for _ in range(400)
    ]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = byte_bpe._numbers(model.encode(text)).tolist()
        assert ids == want
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
        begins, ends = model.spans(text)
        data = text.encode()
        assert [data[b:e] for b, e in zip(begins, ends)] == [model.bytes_of[i] for i in ids]
        assert begins == [0, *ends[:-1]] or not ids


def test_heap_and_scan_agree(model):
    rng = random.Random(4)
    for _ in range(300):
        word = bytes(rng.choice(b"aeinrst \xc3\xa9") for _ in range(rng.randrange(2, byte_bpe.SHORT)))
        first = [model.first[b] for b in word]
        assert model._merge_long(list(first)) == model.merge(word)


def test_broken_bytes_decode_as_the_library_does(model, library):
    for ids in ([model.first[0xE2], model.first[0x82]], [model.first[0xFF], 50256, model.first[65]]):
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memo_is_bounded(model, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 10)
    fresh = byte_bpe.Memo(model)
    words = [f"word{i % 37}" for i in range(500)]
    assert [fresh[w] for w in words] == [model.merge(w.encode())[0].tobytes() for w in words]
    assert len(fresh) <= 10 and len(fresh.older) <= 10


def test_query_equals_the_library_on_all_documents(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in registry.op13_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {d.doc_id: digests(library, d.text) for d in docs} and len(got) == len(docs)


def test_nulls_repeats_and_clashing_columns(spark, library):
    texts = [(1, None), (1, "a b"), (None, "a b"), (2, ""), (2, ""), (3, "x" * 300_000)]
    df = spark.createDataFrame(
        [(i, t, "z", 7, 1.5) for i, t in texts], "doc_id bigint, text string, ids string, n_tokens int, begins double"
    )
    got = byte_bpe.encode_digests(df, registry.byte_model()).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, *digests(library, t)) for i, t in texts], key=repr)
    encoded = byte_bpe.encode_documents(df, registry.byte_model())
    back = byte_bpe.decode_documents(encoded, registry.byte_model()).collect()
    assert sorted(map(tuple, back), key=repr) == sorted([(i, t or "") for i, t in texts], key=repr)
    assert byte_bpe.encode_documents(df.limit(0), registry.byte_model()).collect() == []


def test_unsupported_files_are_refused():
    with pytest.raises(ValueError):
        byte_bpe.ByteModel(b'{"model": {"type": "WordPiece"}, "pre_tokenizer": null}')
