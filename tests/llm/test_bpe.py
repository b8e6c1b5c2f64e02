"""Encoding and decoding against the tokenizers library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowlark.llm import bpe
from flowlark.llm.queries import op1_bpe, vocabulary


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def mine():
    with open(vocabulary(), "rb") as f:
        return bpe.Codec(f.read())


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_whole_table(spark, sf_dir, documents, library):
    text = {r.doc_id: r.text for r in documents.collect()}
    rows = op1_bpe(spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, text[r.doc_id])


def test_edges(edges, empty, library):
    want = sorted((repr(r.doc_id), *digests(library, r.text)) for r in edges.collect())
    assert sorted((repr(r[0]), *r[1:]) for r in bpe.round_trip(edges, vocabulary()).collect()) == want
    assert bpe.round_trip(empty, vocabulary()).count() == 0


def test_encode_then_decode(edges):
    back = bpe.decode(bpe.encode(edges, vocabulary()), vocabulary())
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in edges.collect())


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\t'saAéß1,.")), max_size=80))
def test_any_text(mine, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text).tolist() == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)
