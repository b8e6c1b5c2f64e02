"""The stages of the pipeline on repeated rows, null ids and ids that several texts share."""

import random
from collections import Counter

import corpus_pipeline


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(n))


def kept(stage, spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, None)
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_rows_are_judged_one_by_one(spark):
    good, short = [prose(i) for i in range(4)], "too short"
    rows = [(1, good[0]), (1, short), (None, good[1]), (None, short), (2, good[2]), (2, good[2]), (3, short)]
    want = Counter({(1, good[0]): 1, (None, good[1]): 1, (2, good[2]): 2})
    assert kept(corpus_pipeline.quality_rules, spark, rows) == want


def test_one_row_of_each_component_stays(spark):
    a, b, c, d, e = (prose(10 + i) for i in range(5))
    near = " ".join(c.split()[:-1])
    rows = [(5, a), (5, a), (7, a), (None, a), (None, b), (None, b), (None, c), (None, near), (4, d), (4, e), (9, e), (8, ""), (None, "")]
    got = kept(corpus_pipeline.near_dedup, spark, rows)
    cs = got.pop((None, c), 0), got.pop((None, near), 0)
    assert sum(cs) == 1
    assert got == Counter({(5, a): 1, (None, b): 1, (4, d): 1, (4, e): 1, (8, ""): 1, (None, ""): 1})


def test_a_repeated_document_is_not_lost(spark):
    a = prose(20)
    docs = spark.createDataFrame([(1, a, "en", "web", len(a))] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.cut(stage(spark, docs, None))
    assert [(r.doc_id, r.text) for r in docs.collect()] == [(1, a)]
