"""Near-duplicates against all pairs."""

import random

import pytest
from brute import near_duplicates as all_pairs

from flowlark.llm import minhash
from flowlark.llm.queries import op2_minhash


def check(rows, docs, width):
    want = all_pairs(docs, width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("width", [2, 5])
def test_whole_table(spark, sf_dir, documents, width):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    rows = op2_minhash(spark, sf_dir) if width == 2 else minhash.near_duplicates(documents)
    check(rows.collect(), docs, width)


def test_chains_and_large_groups(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for _ in range(4):  # chains: each text a little off the one before
        text = rng.sample(words, 60)
        for _ in range(30):
            text = list(text)
            text[rng.randrange(60)] = rng.choice(words)
            docs.append((n := n + 1, " ".join(text)))
    docs += [(n := n + 1, docs[0][1].upper()) for _ in range(50)]
    rng.shuffle(docs)
    check(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=2).collect(), docs, 2)


def test_one_large_near_copy_group(spark, monkeypatch):
    """500 edits of one text, many of them just beyond the threshold, cut short or made longer: no link is lost, and the
    pairs that are confirmed grow with the group, not with its square."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = rng.sample(words, 120)
    docs = [(1, " ".join(base))]
    for i in range(2, 501):
        text = list(base)
        for _ in range(rng.randrange(4, 16)):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text = text[: rng.randrange(80, 120)] if rng.random() < 0.5 else text + rng.sample(words, rng.randrange(30))
        docs.append((i, " ".join(text)))
    met, confirm = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *a: met.append(pairs.count()) or confirm(pairs, *a))
    check(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=2).collect(), docs, 2)
    assert sum(met) < 60 * len(docs)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 99, 1000, 123_457])
def test_bands_cover_every_size(n):
    bands = minhash._bands_of_sizes(n, 80)
    fits = [m for m in range(-(-n * 80 // 100), n * 100 // 80 + 1) if 100 * min(m, n) >= 80 * max(m, n)] if n < 2000 else [-(-n * 80 // 100), n, n * 100 // 80]
    least = dict(bands)
    assert len(least) == len(bands) and all(least[minhash._band(m)] <= m for m in fits)


def test_edges(edges, empty):
    rows = minhash.near_duplicates(edges, width=2).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_shingles, by[1].component_id, by[1].kept) == (0, 1, True)
    assert by[2].component_id == 2 and by[3].component_id == 3
    assert by[4].component_id == 4 == by[5].component_id and not by[5].kept
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id is None} == {(1, 6), (0, None)}
    assert by[8].component_id == 8 == by[9].component_id
    assert minhash.near_duplicates(empty).count() == 0
