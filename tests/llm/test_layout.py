"""Packing, sharding and the whole pipeline."""

import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowlark.llm import packing, sharding
from flowlark.llm.queries import op6_packing, op7_sharding, vocabulary


def check_packing(rows, docs, capacity=2048, slack=1):
    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in docs}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        n = len(ids[d])
        first = n if n <= capacity else n % capacity or capacity
        want = [first] + [capacity] * ((n - first) // capacity)
        assert [r.length for r in own] == want and [r.piece for r in own] == list(range(len(want)))
        assert [r.start for r in own] == [sum(want[:i]) for i in range(len(want))]
        assert all(r.ids_crc32 == zlib.crc32(ids[d][r.start : r.start + r.length].tobytes()) for r in own)
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= capacity
    sizes = np.array([r.length for r in rows])
    assert len(bins) <= packing.lower_bound(sizes, capacity) * 1.005 + slack


def test_packing_of_all_documents(spark, sf_dir, documents):
    check_packing(op6_packing(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_packing_edges(spark, edges, empty):
    rows = packing.pack(edges, vocabulary()).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    distinct = edges.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(distinct, vocabulary(), per_partition=3).collect(), [(r.doc_id, r.text) for r in distinct.collect()], slack=5)  # one open sequence for each of its partitions
    assert packing.pack(empty, vocabulary()).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + " \n" * 1_000_000 + "y", "-" * 500_000, "1" * 500_000, "a b " * 300_000], ids=lambda t: repr(t[:4]))
def test_encoder_on_long_runs(text):
    with open(vocabulary(), "rb") as f:
        encoder = packing._encoding(f.read())
    ids = encoder.encode(text)
    assert encoder.fast.decode(ids) == text and len(ids) <= len(text)
    short = text[:1500]
    assert encoder.fast.encode(short, allowed_special="all") == list(encoder.codec.encode(short))


@pytest.mark.parametrize("run", ["ab" * 95_000, "a" * 9_000, "-+" * 95_000, " " * 1_999, "\n" * 1_999, "Zq" * 95_000 + "="], ids=lambda t: f"{t[:2]!r}x{len(t)}")
def test_long_runs_inside_a_text_take_linear_time(run):
    """Texts of 2 MB whose runs stay just below the limits, over and over, between other characters."""
    between = "x." if run.isspace() else " x. "
    text = (run + between) * (2_000_000 // (len(run) + 4)) if len(run) < 10_000 else "some words. " * 80_000 + run + " and more. " * 80_000
    began = time.perf_counter()
    assert packing._LONG_RUN.search(text) is None
    assert time.perf_counter() - began < 5
    for long in ("w" * 10_000, "\u00e9" * 10_000, " " * 2_000, "ab" * 100_000, "-+" * 100_000):
        before, after = ("some.", "more") if long[0] == " " else ("some. ", " more")
        assert packing._LONG_RUN.search(before + long + after) and not packing._LONG_RUN.search(before + long[:-1] + after)


def test_gaps_certify(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 101, 6000))]
    out = packing.place(spark.createDataFrame(rows, "pid long, length long"), 100, per_partition=700).collect()
    assert len(out) == len(rows) and all(r.gap >= 0 for r in out)
    used = len({r.sequence_id for r in out})
    assert used <= packing.lower_bound(np.array([n for _, n in rows]), 100) * 1.02
    assert any(r.gap == 0 for r in out)


def test_lower_bound_never_exceeds_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(1, 101, rng.integers(1, 200))
        assert packing.lower_bound(sizes, 100) <= len(packing.best_fit_decreasing(sizes, 100)[1])
    assert packing.lower_bound(np.array([51] * 7), 100) == 7


def test_sharding(spark, sf_dir, documents, edges, empty):
    for df, out in ((documents, op7_sharding(spark, sf_dir)), (edges, sharding.shard(edges))):
        rows = out.collect()
        want = [(repr(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect()]
        assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(want)
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert sharding.shard(empty).count() == 0


def test_shards_hold_whole_groups_and_all_three_resources(spark, documents):
    """Ten copies of the table under other ids and words, so that a shard has enough documents to be even."""
    many = documents.crossJoin(spark.range(10)).selectExpr("doc_id * 10 + id as doc_id", "concat(text, ' ', id) as text")
    rows = sharding.shard(many.repartition(3)).join(many, "doc_id").collect()
    sums, homes = np.zeros((40, 3)), defaultdict(set)
    for r in rows:
        sums[r.shard] += (r.size, len(r.text.split(" ")), 1)
        homes[r.text].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    spread = sums.max(axis=0) / sums.mean(axis=0)
    print("most of a shard over the mean: bytes, tokens, rows", spread)
    assert spread[0] <= 1.01 and spread[1] <= 1.05 and spread[2] <= 1.05


def test_shards_are_balanced_under_a_hot_group(spark):
    rows = [(i, "same text " * 30) for i in range(8000)] + [(i, "word " * (i % 97)) for i in range(8000, 24000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r[1] for r in out.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 40 and max(sizes) <= 1.02 * min(sizes)
    # the group is larger than a shard: it lies in few shards, not strewn over all
    assert out.filter("doc_id < 8000").select("shard").distinct().count() <= 40


def test_pipeline_stages(spark, sf_dir, documents):
    docs, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        assert after <= before and (len(after) < len(before)) == (name in ("quality rules", "near dedup"))
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing(last, [(r.doc_id, r.text) for r in docs.collect()])


def test_near_dedup_stage_keeps_one_of_each_component(spark, sf_dir, documents):
    from brute import near_duplicates

    small = documents.limit(120)
    docs = [(r.doc_id, r.text) for r in small.collect()]
    want = {d for d, (_, c) in near_duplicates(docs, 5).items() if c == d}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, sf_dir).collect()} == want


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_edges_and_nothing(spark, sf_dir, edges, empty, stage):
    stage(spark, edges, sf_dir).collect()
    assert stage(spark, empty, sf_dir).count() == 0
