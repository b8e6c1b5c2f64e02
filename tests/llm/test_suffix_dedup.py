"""Removal of repeated bytes against a table of all windows."""

import random

from brute import removal, repeats
from compare import difference

from flowlark.llm import suffix_dedup
from flowlark.llm.queries import op5_suffix_dedup, oracle_sql


def raw(text):
    return (text or "").encode()


def check(rows, docs, length=200):
    want = dict(zip([d for d, _ in docs], removal([raw(t) for _, t in docs], length), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_whole_table(spark, sf_dir, documents):
    check(op5_suffix_dedup(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_whole_table_by_sql(spark, sf_dir):
    assert difference(op5_suffix_dedup(spark, sf_dir), oracle_sql()["op5_suffix_dedup"], sf_dir) is None


def test_planted_passages(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [noise(n) for n in (150, 160, 199, 200, 201, 260, 700)]
    docs = [(i, noise(rng.randrange(300)) + "".join(rng.choice(shared) + noise(rng.randrange(40)) for _ in range(rng.randrange(5)))) for i in range(120)]
    docs += [(200, "z" * 900), (201, "z" * 199), (202, "yz" * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(suffix_dedup.removal_digests(df).collect(), docs)
    check(suffix_dedup.removal_digests(df, length=90, gram=24, step=7).collect(), docs, 90)


def test_texts_beyond_a_part(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffix_dedup, "PART", 1 << 20)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    long = "".join(rng.choice("abcdefgh ") for _ in range((1 << 20) - 450)) + passage + "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    docs = [(1, long), (2, "q" * 100 + passage)]
    rows = {r.doc_id: r for r in suffix_dedup.removal_digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (rows[1].n_removed, rows[1].n_spans) == (900, 1) == (rows[2].n_removed, rows[2].n_spans)


def test_edges(edges, empty):
    rows = suffix_dedup.removal_digests(edges).collect()
    texts = [(r.doc_id, raw(r.text)) for r in edges.collect()]
    want = sorted((repr(d), *w) for (d, _), w in zip(texts, removal([t for _, t in texts]), strict=True))
    assert sorted((repr(r[0]), *r[1:]) for r in rows) == want
    assert suffix_dedup.removal_digests(empty).count() == 0


def test_stripped_texts(edges):
    rows = edges.collect()
    gone = repeats([raw(r.text) for r in rows])
    want = sorted(repr(None if r.text is None else bytes(b for b, g in zip(raw(r.text), x, strict=True) if not g).decode("utf-8", "ignore")) for r, x in zip(rows, gone, strict=True))
    out = suffix_dedup.strip_repeats(edges, carry=["lang", "k"])
    assert out.columns == ["doc_id", "text", "lang", "k"]
    assert sorted(repr(r.text) for r in out.collect()) == want
