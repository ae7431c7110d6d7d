import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from furrow.llm import bpe_prefix as op

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as file:
    VOCABULARY = op.Vocabulary(file.read())
ENCODER = op.Encoder(VOCABULARY, public_tokenizers.PATTERN)
with open(PATH, "rb") as file:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = st.lists(st.sampled_from(list("aabcdehillnoorstt'  \n\t.,!é😀漢1") + ["'ll", "ing", " the"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_equals_plain_merging(text):
    assert ENCODER.text(text) == PLAIN.encode_ordinary(text)
    assert op.Prefixes(VOCABULARY, b"").tokens() == []
    for piece in ENCODER.pieces(text):
        prefixes = op.Prefixes(VOCABULARY)
        for byte in piece.encode():
            prefixes.append(bytes([byte]))  # appends never change what is there
        assert prefixes.tokens() == PLAIN.encode_ordinary(piece)
        prefixes.truncate(len(prefixes.data) // 2)
        assert prefixes.last == op.Prefixes(VOCABULARY, prefixes.data).last


@settings(max_examples=150, deadline=None)
@given(TEXTS, TEXTS, st.integers(0, 40), st.integers(0, 40))
def test_edits_and_appends_are_exact(text, new, a, b):
    start, end = sorted((min(a, len(text)), min(b, len(text))))
    held = op.Encoded(ENCODER, text)
    held.replace(start, end, new)
    assert held.text() == text[:start] + new + text[end:]
    assert held.tokens() == PLAIN.encode_ordinary(held.text())
    held.append(new)
    assert held.tokens() == PLAIN.encode_ordinary(text[:start] + new + text[end:] + new)


def test_long_pieces_and_small_memory():
    vocabulary = op.Vocabulary(open(PATH, "rb").read())
    encoder = op.Encoder(vocabulary, public_tokenizers.PATTERN)
    encoder.tokens.size = vocabulary.last.size = vocabulary.fits.size = 5
    for text in ["a" * 3000, " " * 700, "abc" * 500, "the cat sat on the mat and the dog lay down by the door " * 3]:
        assert encoder.text(text) == PLAIN.encode_ordinary(text)
    assert len(encoder.tokens) <= 5 and len(encoder.tokens.older) <= 5


def test_table(frame, odd):
    docs = frame([(*row, "x", [1]) for row in odd], "doc_id long, text string, ids string, other array<int>")
    rows = op.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(odd) and rows[0].asDict().keys() == {"doc_id", "text", "other", "ids", "decoded"}
    for row in rows:
        assert row.ids == PLAIN.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    split = op.decode(op.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted(map(str, split)) == sorted(map(str, rows))
    empty = op.round_trip(docs.where("false"), PATH, public_tokenizers.PATTERN)
    assert empty.count() == 0


def test_unknown_id_raises(frame):
    with pytest.raises(Exception, match="not in the vocabulary"):
        op.decode(frame([([50_256],)], "ids array<int>"), PATH).collect()
    assert bytes(op.decode(frame([(None,)], "ids array<int>"), PATH).first().decoded) == b""


def test_query(spark, documents):
    from furrow.llm.queries import op6_bpe_prefix

    texts = {r.doc_id: r.text for r in documents.collect()}
    for row in op6_bpe_prefix(spark, "/root/testdata/sf0.001").collect():
        import hashlib

        ids = PLAIN.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids) and row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
