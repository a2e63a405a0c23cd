import hashlib
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyshelf.llm import pieces
from tallyshelf.llm.registry import piece_model


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def model():
    with open(piece_model(), "rb") as file:
        return pieces.PieceModel(file.read())


TEXTS = [
    "", " ", "a", "  two  spaces ", "line\nends\r\n\ttab", "Ünïcödé ß 漢字 🙂", "a▁b ▁", "<0x0A> </s> <unk>",
    "x" * 500, "ab" * 3000, "the of and that " * 40, "1234567890 3.14", "\u0000\u0001 é", "    def f():\n        return 1",
]


def spans(library, text):
    from sentencepiece import sentencepiece_pb2

    parsed = sentencepiece_pb2.SentencePieceText()
    parsed.ParseFromString(library.encode(text, out_type="serialized_proto"))
    return [(p.id, p.begin, p.end) for p in parsed.pieces]


def check(library, model, text):
    want = library.encode(text, add_eos=True)
    ids, begins, ends = (part.tolist() for part in model.encode(text))
    assert ids == want
    assert model.decode(ids) == library.decode(want)
    assert list(zip(ids, begins, ends))[:-1] == spans(library, text)
    def again():
        return tuple(part.tolist() for part in model.encode_words(*model.prepare(text)))

    alike = again()
    model.learn(set(model.prepare(text)[0]))
    assert alike == again() == (ids, begins, ends)


def test_many_words_at_once(library):
    with open(piece_model(), "rb") as file:
        fresh = pieces.PieceModel(file.read())
    for text, got in zip(TEXTS, fresh.encode_many(TEXTS)):
        assert list(got[0]) == library.encode(text, add_eos=True)


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_the_library(library, model, text):
    check(library, model, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁abetho.é漢"), st.characters(codec="utf-8")), max_size=80))
def test_same_as_the_library_on_any_text(library, model, text):
    check(library, model, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_decodes_any_ids_as_the_library(library, model, ids):
    if 0 not in ids:
        assert model.decode(ids) == library.decode(ids)


def trie(keys):
    """A double array for ASCII keys given as {key: text}, built plainly for the test."""
    texts, place = b"", {}
    for key, text in keys.items():
        place[key] = len(texts)
        texts += text.encode() + b"\0"
    units = {0: 0}
    used = {0}

    def build(node, prefix):
        nexts = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        labels = [ord(c) for c in nexts]
        base = 256
        while any((base ^ x) in used for x in [*labels, *([0] if leaf else [])]):
            base += 256
        offset = node ^ base
        units[node] = units.get(node, 0) | (offset << 10) | (256 if leaf else 0)
        if leaf:
            units[base] = place[prefix] | 0x80000000
            used.add(base)
        for x in labels:
            used.add(base ^ x)
            units[base ^ x] = x
        for c in nexts:
            build(base ^ ord(c), prefix + c)

    build(0, "")
    flat = [units.get(i, 0) for i in range(max(units) + 1)]
    blob = struct.pack(f"<{len(flat)}I", *flat)
    return struct.pack("<I", len(blob)) + blob + texts


def test_longest_prefix_of_the_character_map():
    charmap = pieces.CharMap(trie({"a": "x", "ab": "yy", "abcd": ""}))
    assert charmap.longest(b"abc", 0) == (2, "yy")
    assert charmap.longest(b"zabcd", 1) == (4, "")
    assert charmap.longest(b"ac", 0) == (1, "x")
    assert charmap.longest(b"c", 0) is None


def test_normalised_text_knows_its_source(model):
    mapped = pieces.PieceModel.__new__(pieces.PieceModel)
    mapped.__dict__.update(model.__dict__, map=pieces.CharMap(trie({"fi": "ph", "Q": ""})), squeeze=True, known={}, older={})
    normal, source = mapped.normalise("  fiQ  aé ")
    assert normal == "▁ph▁aé"
    assert source[:6] == [2, 2, 2, 5, 7, 8]
    ids, begins, ends = mapped.encode("  fiQ  aé ")
    assert all(b <= e for b, e in zip(begins, ends))


def test_frames(spark, library):
    rows = [(1, "to be\nor not", "x"), (1, "to be\nor not", "x"), (None, None, "y"), (2, "", None), (3, "w" * 70_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    encoded = pieces.encode_documents(docs, piece_model())
    got = sorted((r.doc_id or 0, list(r.ids), len(r.begins)) for r in encoded.collect())
    want = sorted((d or 0, library.encode(t or "", add_eos=True)) for d, t, _ in rows)
    assert [g[:2] for g in got] == want
    back = sorted((r.doc_id or 0, r.text) for r in pieces.decode_documents(encoded, piece_model()).collect())
    assert back == sorted((d or 0, t or "") for d, t, _ in rows)
    short = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_bytes)
             for r in pieces.encode_digests(docs, piece_model()).collect()}
    for d, t, _ in rows:
        ids = library.encode(t or "", add_eos=True)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (d, len(ids), digest, text, len((t or "").encode())) in short
    assert pieces.encode_documents(docs.limit(0), piece_model()).count() == 0
