"""Token counts against the libraries, and what the cache saves."""

import os

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from flowlark.llm import token_counts
from flowlark.llm.queries import op12_token_counts, word_vocabulary

ODD = [
    "J̌ ǰ H̱ ẖ İ İx ẞ ΑΣ ας ſt K Å é é É", "a\x1cb\x85c d e f　g​h", "DON'T don't I'LL 's 'S x'll'll ''ve", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b <|start oftext|>",
    "mid.dot a.b, c!? (x) [1]. 12,5 x2 ..., ?! word. word? été. naïve; Œuvre: ŉ ŀ ſ ž Ž", "日本語 テキスト。 한국어 עברית ١٢٣ ²½", "\U0001f600\U0001f468‍\U0001f469 ﬁ ǅ ǆ", "", " ", "a", "Ａ ﬀ Ⅻ",
    "x" * 5000, "é" * 3000 + " " + "Z" * 70 + ".", "\0 \x7f �",
]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_whole_table_equals_library(spark, sf_dir, documents, file):
    docs = {r.doc_id: r.text or "" for r in documents.collect()}
    path = public_tokenizers.path(file)
    if file.endswith(".json"):
        library = Tokenizer.from_file(path)
        library.no_truncation()
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    rows = (op12_token_counts(spark, sf_dir) if path == word_vocabulary() else token_counts.count_tokens(documents, path)).collect()
    want = {d: (len(t.encode()), n := count(t), n > 2048) for d, t in docs.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == want and len(rows) == len(docs)


def test_odd_texts_by_word_and_whole():
    with open(word_vocabulary(), "rb") as f:
        counter = token_counts.Counter("word.json", f.read())
    assert counter.by_word
    library = Tokenizer.from_file(word_vocabulary())
    letters = [chr(c) for c in range(1, 0x250)] + [f"{chr(c)}." for c in range(33, 0x180)] + [f"a{chr(c)}b" for c in range(1, 0x180)]
    for text in ODD + letters + [a + b for a in ODD for b in ODD]:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text.encode()) == want, repr(text)
        assert len(library.encode(counter.normal(text.encode()).decode(), add_special_tokens=False).ids) == want, repr(text)


def test_normal_form_joins_and_keeps_apart():
    with open(word_vocabulary(), "rb") as f:
        counter = token_counts.Counter("word.json", f.read())
    assert counter.normal(b" The  cat\n") == counter.normal(b"the cat")
    assert counter.normal(b"<|ENDOFTEXT|>") != counter.normal(b"<|endoftext|>")
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        assert token_counts.Counter("byte.json", f.read()).normal(b" The  cat") == b" The  cat"


def test_edges(spark, edges, empty):
    rows = token_counts.count_tokens(edges, word_vocabulary(), limit=100).collect()
    library = Tokenizer.from_file(word_vocabulary())
    want = sorted((repr(r.doc_id), len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 100) for r in edges.collect())
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts.count_tokens(empty, word_vocabulary()).count() == 0


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = f"file://{tmp_path}/counts"
    stored = lambda: spark.read.parquet(*[f"file://{tmp_path}/counts/{v}" for v in os.listdir(f"{tmp_path}/counts")])
    one = spark.createDataFrame([(i, f"Text  number {i % 50}") for i in range(1000)], "doc_id long, text string")
    first = {tuple(r) for r in token_counts.count_tokens(one, word_vocabulary(), cache=cache).collect()}
    assert stored().count() == 50 and len(first) == 1000
    two = spark.createDataFrame([(i, f"TEXT number\t{i % 60}") for i in range(1000)], "doc_id long, text string")
    second = token_counts.count_tokens(two, word_vocabulary(), cache=cache).collect()
    assert stored().count() == 60 and len(second) == 1000  # ten are new, the others differ from stored ones in case and blanks only
    # counts come from the cache: a stored figure is believed
    forged = stored().selectExpr("digest", "n_tokens + 100 as n_tokens")
    version = os.listdir(f"{tmp_path}/counts")[0]
    forged.write.parquet(f"file://{tmp_path}/forged/{version}")
    third = token_counts.count_tokens(two, word_vocabulary(), cache=f"file://{tmp_path}/forged").collect()
    assert {(r.doc_id, r.n_tokens) for r in third} == {(r.doc_id, r.n_tokens + 100) for r in second}
    # another tokenizer has counts of its own, and a digest appended twice is read once
    token_counts.count_tokens(one, public_tokenizers.path("byte_bpe_50k.json"), cache=cache).collect()
    assert len(os.listdir(f"{tmp_path}/counts")) == 2
    spark.read.parquet(f"file://{tmp_path}/forged/{version}").write.mode("append").parquet(f"file://{tmp_path}/forged/{version}")
    assert token_counts.count_tokens(two, word_vocabulary(), cache=f"file://{tmp_path}/forged").count() == 1000
