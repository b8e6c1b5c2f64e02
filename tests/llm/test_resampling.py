"""Importance resampling against a plain version, and its parts against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from compare import difference

from flowlark.llm import resampling
from flowlark.llm.queries import oracle_sql, op11_resampling

CASE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(CASE))
    features = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in features]


def brute(docs, target, percent=25, least=20, seed=7):
    """Sorted (doc_id as text, n_features, weight, score, rank)."""
    s, t = [0] * 10000, [0] * 10000
    each = [(d, *buckets(x)) for d, x in docs]
    for _, _, found in each:
        for b in found:
            s[b] += 1
    for x in target:
        for b in buckets(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out, fit = [], []
    for i, (d, words, found) in enumerate(each):
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if words >= least:
            fit.append(i)
    fit.sort(key=lambda i: (-out[i][3], out[i][0] is not None, out[i][0] or 0))
    for rank, i in enumerate(fit[: percent * len(fit) // 100]):
        out[i][4] = rank + 1
    return sorted(map(tuple, out), key=repr)


def test_whole_table(spark, sf_dir, documents):
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute([(r.doc_id, r.text) for r in documents.collect()], target)
    rows = op11_resampling(spark, sf_dir).collect()
    assert sorted(map(tuple, rows), key=repr) == want
    assert any(r.rank for r in rows) and any(r.rank is None for r in rows)


def test_equals_sql(spark, sf_dir):
    assert difference(op11_resampling(spark, sf_dir), oracle_sql()["op11_resampling"], sf_dir) is None


def test_edges(spark, edges, empty):
    docs = [(r.doc_id, r.text) for r in edges.collect()]
    for target in (["ab w1 w2 the same line", None, ""], []):
        table = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
        rows = resampling.resample(edges, table, percent=60).collect()
        want = brute(docs, target, percent=60)
        assert sorted((tuple(r)[:4] for r in rows), key=repr) == sorted((w[:4] for w in want), key=repr)  # rows alike in all keys share their ranks in any order
        assert sorted(r.rank for r in rows if r.rank) == sorted(w[4] for w in want if w[4])
    assert resampling.resample(empty, empty).count() == 0
    assert [r.rank for r in resampling.resample(edges, empty, percent=0).collect()] == [None] * len(docs)


def test_pairs_are_hashed_as_whole_strings():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé9", k=rng.choice([1, 2, 5, 31, 63, 64, 65, 300]))) for _ in range(400)]
    texts = [" ".join(words), "", "one", " ".join(words[:7]) + "," + words[-1]]
    one, two, sizes = resampling.Features(10000).of([t.encode() for t in texts])
    assert sizes.tolist() == [400, 0, 1, 8]
    at = 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        found = one[at : at + n].tolist() + two[at : at + n][:-1].tolist()
        assert found == buckets(text)[1] and (not n or two[at + n - 1] == -1)
        at += n


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_kth_key(spark, bits):
    rng = np.random.default_rng(bits)
    wide = [-(1 << 63), (1 << 63) - 1, 0, -1]
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.integers(-3, 3, 60), rng.choice(wide, 60), strict=True))]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for keys, place in ((["a", "b", "c"], (0, 1, 2)), (["b", "a", "c"], (1, 0, 2))):
        order = sorted(tuple(r[i] for i in place) for r in rows)
        for k in (1, 2, 30, 60) if bits > 1 else (17,):
            found = resampling.kth_key(df, keys, k, bits)
            assert tuple(found) == order[k - 1]
            assert df.filter(resampling.up_to(keys, found)).count() == k
    assert resampling.kth_key(df, ["a"], 61, bits) is None
    df.unpersist()


def test_repeated_rows_have_ranks_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text)] * 8 + [(None, text)] * 8, "doc_id long, text string")
    rows = resampling.resample(df, df, percent=50).collect()
    drawn = [r for r in rows if r.rank]
    assert sorted(r.rank for r in drawn) == list(range(1, 9)) and len({r.doc_id for r in drawn}) == 1
