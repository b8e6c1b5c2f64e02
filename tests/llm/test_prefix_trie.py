"""The trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import difference

from flowlark.llm import prefix_trie
from flowlark.llm.queries import oracle_sql, op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, len string"


def conversations(rows, shared=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    if not shared:
        return own
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(c - 100 * int(c / 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes[tuple(convs[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p, m: hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in nodes.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("local", [prefix_trie.LOCAL, 6])
def test_whole_table(spark, sf_dir, local):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    want = brute(conversations(rows))
    found = op13_prefix_trie(spark, sf_dir) if local == prefix_trie.LOCAL else prefix_trie.rebuilt_trie(df, local)
    assert rows_of(found) == want


def test_equals_sql(spark, sf_dir):
    assert difference(op13_prefix_trie(spark, sf_dir), oracle_sql()["op13_prefix_trie"], sf_dir) is None


@pytest.mark.parametrize("local", [4, 100_000])
def test_random_tries(spark, local, monkeypatch):
    """Few turns, so that prefixes branch everywhere; copies, prefixes of others, and conversations without turns of their own."""
    monkeypatch.setattr(prefix_trie, "_JOINED", 3)
    rng = random.Random(local)
    rows = []
    for c in rng.sample(range(-150, 700), 100):
        for turn in range(rng.randrange(1, 8)):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(["a", "bb", "", None])))
    rng.shuffle(rows)
    df = table(spark, rows)
    assert rows_of(prefix_trie.rebuilt_trie(df, local)) == brute(conversations(rows))
    assert rows_of(prefix_trie.prefix_trie(df, local=local)) == brute(conversations(rows, shared=False))


def test_long_copies_take_few_rounds(spark, monkeypatch):
    """A third of all conversations are copies of one of 300 turns: they are passed over in one round."""
    turns = [f"turn {i % 7}" for i in range(300)]
    rows = [(c, i, "user", t) for c in range(20) for i, t in enumerate(turns)] + [(c, i, "user", f"{c % 5} {i}") for c in range(20, 60) for i in range(3)]
    met, seen = [], prefix_trie.cut
    monkeypatch.setattr(prefix_trie, "cut", lambda df: met.append("kid" in df.columns) or seen(df))
    assert rows_of(prefix_trie.prefix_trie(table(spark, rows), local=50)) == brute(conversations(rows, shared=False))
    assert sum(met) <= 4


def test_one_long_conversation_spans_partitions(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_LONG", 1000)
    rows = [(7, i, "user", str(i % 3)) for i in range(6000)] + [(c, 0, "user", "0") for c in range(8, 30)]
    random.Random(1).shuffle(rows)
    found = rows_of(prefix_trie.prefix_trie(table(spark, rows).repartition(5)))
    convs = conversations(rows, shared=False)
    assert len(found) == 6001 and found[0][0] == 7
    nobody, own = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"7").hexdigest()
    deep = [r for r in found if r[1] > 1]
    assert [r[1:] for r in sorted(deep, key=lambda r: r[1])] == [(d, 7, 1, int(d < 6000), 1, 0, own if d == 6000 else nobody) for d in range(2, 6001)]
    assert len(convs[7]) == 6000


def test_edges(spark):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, 1, None, None), (2, 3, "", ""), (2, None, "user", "b"), (3, None, "user", "b"), (250, 0, "user", "x")]
    df = table(spark, rows)
    assert rows_of(prefix_trie.prefix_trie(df)) == brute(conversations(rows, shared=False))
    assert rows_of(prefix_trie.rebuilt_trie(df)) == brute(conversations(rows))
    assert prefix_trie.rebuilt_trie(table(spark, [])).count() == 0
    assert prefix_trie.rebuilt_trie(df.filter("conv_id is null")).count() == 0
