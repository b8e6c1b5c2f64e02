"""Counts of windows and of the last connections against loops over all rows before."""

import random

import pytest

from flowlark.operators import history

SCHEMA = "seq long, start_us long, dst string, service string, dport int, flag string, note string"


def plain(rows, window, last):
    out = []
    for i, (seq, t, dst, service, port, _, _) in enumerate(rows):
        near = [r for r in rows[:i] if t is not None and r[1] is not None and r[1] >= t - window]
        late = [r for r in rows[:i] if r[0] >= seq - last]
        sets = {
            "h": [r for r in near if r[2] == dst], "s": [r for r in near if r[3] == service], "hs": [r for r in near if r[2:4] == (dst, service)],
            "d": [r for r in late if r[2] == dst], "ds": [r for r in late if r[2:4] == (dst, service)], "dp": [r for r in late if (r[2], r[4]) == (dst, port)],
        }
        flags = {"n": None, "e": ("s0", "s1", "s2", "s3"), "r": ("rej", "rsto", "rstr")}
        out.append((seq, *(sum(f is None or (r[5] or "").lower() in f for r in sets[p]) for p, k in (c.split("_") for c in history.COUNTS) for f in [flags[k]])))
    return out


@pytest.mark.parametrize("chunk, gap", [(7, 3), (7, 200), (50, 40), (1 << 20, 10)])
def test_counts(spark, monkeypatch, chunk, gap):
    """Chunks smaller and larger than windows; equal starts, nulls, and windows that no row or all rows are in."""
    rng = random.Random(chunk + gap)
    t, rows = 0, []
    for seq in range(400):
        t += rng.choice([0, 0, 1, gap, 3 * gap])
        rows.append((seq, None if seq < 5 else t, rng.choice(["a", "b", "a", None]), rng.choice(["x", "y", None]), rng.choice([1, 2, None]), rng.choice(["S0", "rej", "sf", None]), f"n{seq}"))
    monkeypatch.setattr(history, "_edges", lambda df, w, h, f=history._edges: _small(df, w, h, chunk, f))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for window, last in ((25, 10), (1000, 100), (0, 1)):
        got = history.with_counts(df, window, last)
        assert got.columns == [*df.columns, *history.COUNTS]
        found = sorted(got.collect())
        assert [tuple(r)[:7] for r in found] == rows
        assert [(r.seq, *(r[c] for c in history.COUNTS)) for r in found] == plain(rows, window, last)
    assert history.with_history(df.limit(0), 10).count() == 0


def _small(df, window, last, chunk, plain_edges):
    import numpy as np

    size, firsts = plain_edges(df, window, last)
    if chunk >= 1 << 20 or not len(firsts):
        return size, firsts
    size = max(chunk, last)
    rows = sorted((r.seq, r.start_us) for r in df.collect())
    least = np.iinfo(np.int64).min
    each = [min((t for s, t in rows if s // size == c and t is not None), default=least) for c in range(rows[-1][0] // size + 1)]
    return size, np.maximum.accumulate(np.array(each))


def test_parts_do_not_grow_with_windows():
    """However many rows a window holds, a task gets the rows of two chunks and the last ones before; each row is in one part."""
    import numpy as np

    size, last, n = 50, 20, 5000
    seq, start = np.arange(n), np.concatenate([np.full(70, history._LEAST), np.sort(np.random.default_rng(5).integers(0, 900, n - 70))])
    firsts = np.array([start[i] for i in range(0, n, size)])
    for window in (0, 10, 300, 2000):
        parts = history._Parts(size, firsts, int(start[-1]), window)
        row, part = parts.shown(seq, start, last)
        assert np.bincount(part).max() <= 2 * size + last and len(row) <= 6 * n
        assert len(set(zip(row.tolist(), part.tolist()))) == len(row)
        own, begin = parts.of(seq, start)
        assert set(zip(seq.tolist(), (parts.first[own] + begin - parts.low[own]).tolist())) <= set(zip(row.tolist(), part.tolist()))


def test_chunks_do_not_grow_with_the_table(spark):
    """A task's rows are the same few over four times as many connections."""
    sizes = [history._edges(spark.range(n).selectExpr("id as seq", "id as start_us"), 1000, 100)[0] for n in (1_000_000, 4_000_000)]
    assert sizes[0] == sizes[1] <= 20_000


def test_rows_are_dealt_a_few_at_a_time():
    """After a burst within one window and a pause, the windows of one chunk's rows start in all chunks before, and each row of it
    is shown to hundreds of parts. The copies of a batch are made a few at a time, whatever the number of chunks."""
    import numpy as np
    import pyarrow as pa

    size, last, n = 1000, 100, 400_500
    seq = np.arange(n)
    start = np.concatenate([np.arange(n - 500), np.arange(500) * 1000 + n + 400_000])  # the last chunk's second half starts later
    window = 500_000
    parts = history._Parts(size, np.array([start[i] for i in range(0, n, size)]), int(start[-1]), window)
    batch = pa.record_batch({"seq": pa.array(seq[-2 * size :]), "start_us": pa.array(start[-2 * size :]), "dst": pa.array(["a"] * 2 * size)})
    row, part = parts.shown(seq[-2 * size :], start[-2 * size :], last)
    assert len(row) > 4 * history.SHOWN
    assert (np.bincount(row) <= parts.times(seq[-2 * size :], start[-2 * size :], last)).all()
    got = list(history._deal(iter([batch]), parts, last))
    assert max(b.num_rows for b in got) <= history.SHOWN + len(parts.firsts) * 2
    dealt = [(p, s) for b in got for p, s in zip(b.column("part").to_pylist(), b.column("seq").to_pylist())]
    assert sorted(dealt) == sorted(zip(part.tolist(), seq[-2 * size :][row].tolist()))
