"""Trailing-window and recent-history features of connections.

A window over all connections of a host would put a busy host into one task, and a window's rows grow with the traffic.
Connections are therefore dealt by their sequence number into chunks of bounded size, whatever their keys, and a window's count is
the difference of two places in its key's run: the row's own, and that of the window's start. A task sees the chunks of these
two places in a few narrow columns, never what lies between them; that is a running sum over chunks. Results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark import fixed
from flowlark.session import table


def _dealt(df: DataFrame, place: str, reach: int, spans: int) -> DataFrame:
    """_span, and _own: false for the copies that are only context."""
    length = reach * spans
    span = F.floor(F.col(place) / F.lit(length)).cast("long")
    near_end = F.col(place) - span * length >= length - reach
    copies = F.array(F.struct(span.alias("_span"), F.lit(True).alias("_own")), F.struct((span + 1).alias("_span"), F.lit(False).alias("_own")))
    copies = F.filter(copies, lambda c: c["_own"] | near_end)
    return df.withColumn("_c", F.explode(copies)).select("*", "_c._span", "_c._own").drop("_c")


def rate(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


#: Rows of a chunk at most; a task holds two chunks' rows in seven narrow columns. Small enough that they are little beside
#: the libraries that a worker loads, so its memory is the same for any table that has more rows than a few chunks.
CHUNK = 1 << 14
_LEAST = np.iinfo(np.int64).min


def _edges(df: DataFrame, window_us: int, history: int) -> tuple[int, np.ndarray]:
    """Rows of a chunk and the start of the first connection of each chunk (the least number if that has none)."""
    last = df.agg(F.max("seq")).first()[0]
    if last is None:
        return 1, np.zeros(0, np.int64)
    size = max(1024, history, min(CHUNK, -(-(last + 1) // (2 * df.sparkSession.sparkContext.defaultParallelism))))
    start = F.coalesce("start_us", F.lit(_LEAST))
    rows = df.groupBy(F.floor(F.col("seq") / size).cast("long").alias("c")).agg(F.min(start).alias("t")).collect()  # a row a chunk
    firsts = np.full(int(last // size) + 1, _LEAST)
    for r in rows:
        firsts[r["c"]] = r["t"]
    return size, np.maximum.accumulate(firsts)


class _Parts:
    """Parts of the sequence: each is the rows of one chunk whose windows start in one chunk. Both rise along the sequence, so
    parts are less than twice as many as chunks, and each chunk is the start of few."""

    def __init__(self, size: int, firsts: np.ndarray, last: int | None, window_us: int) -> None:
        self.size, self.firsts, self.window = size, firsts, window_us
        self.low = self.before(firsts)
        self.high = np.append(self.low[1:], self.before(np.array([_LEAST if last is None else last])))
        self.first = np.cumsum(self.high - self.low + 1) - (self.high - self.low + 1)  # number of each chunk's first part

    def before(self, start: np.ndarray) -> np.ndarray:
        """The chunk that holds the last row before the windows that end at ``start``, or chunk 0."""
        timed = start > _LEAST
        return np.where(timed, np.maximum(np.searchsorted(self.firsts, np.where(timed, start, 0) - self.window, side="left") - 1, 0), 0)

    def of(self, seq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk of each row, and chunk where its window starts."""
        own = seq // self.size
        return own, np.clip(self.before(start), self.low[own], self.high[own])

    def times(self, seq: np.ndarray, start: np.ndarray, history: int) -> np.ndarray:
        """To how many parts shown() shows each row, at most."""
        own, start_in = self.of(seq, start)
        n = self.high[own] - start_in + 1 + np.searchsorted(self.low, own, side="right") - np.searchsorted(self.high, own, side="left")
        after = np.minimum(own + 1, len(self.firsts) - 1)
        return n + np.where(seq >= (own + 1) * self.size - history, self.high[after] - self.low[after] + 1, 0)

    def shown(self, seq: np.ndarray, start: np.ndarray, history: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) for every part that needs the row: its own and later ones of its chunk, those whose windows start in its
        chunk, and those of the next chunk if the row is among the ``history`` rows before it."""
        own, start_in = self.of(seq, start)
        rows, parts = [], []

        def add(which: np.ndarray, low: np.ndarray, n: np.ndarray) -> None:
            each = np.repeat(np.arange(len(which)), n)
            rows.append(which[each])
            parts.append(low[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))

        every, base = np.arange(len(seq)), self.first - self.low
        add(every, base[own] + start_in, self.high[own] - start_in + 1)
        c = np.searchsorted(self.high, own, side="left")
        to = np.searchsorted(self.low, own, side="right")
        add(every, c, to - c)  # chunks first, parts below
        chunk = parts[-1]
        keep = chunk != own[rows[-1]]
        rows[-1], chunk = rows[-1][keep], chunk[keep]
        parts[-1] = base[chunk] + own[rows[-1]]
        near = np.flatnonzero((seq >= (own + 1) * self.size - history) & (own + 1 < len(self.firsts)))
        after = own[near] + 1
        add(near, self.first[after], self.high[after] - self.low[after] + 1)
        keep = parts[-1] != base[own[rows[-1]] + 1] + own[rows[-1]]  # shown already, if windows start in its chunk
        rows[-1], parts[-1] = rows[-1][keep], parts[-1][keep]
        return np.concatenate(rows), np.concatenate(parts)


#: Copies of rows that are made at a time: few rows may be shown to many parts, where their windows start far apart.
SHOWN = 1 << 16


def _deal(batches, parts: _Parts, history: int) -> Iterator[pa.RecordBatch]:
    """The rows with each part that needs them, at most SHOWN at a time and a row's parts more."""
    for b in batches:
        seq, start = b.column("seq").to_numpy(), _starts(b.column("start_us"))
        piece = np.cumsum(parts.times(seq, start, history)) // SHOWN
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(seq)]
        for low, high in zip(cuts, cuts[1:]):
            row, part = parts.shown(seq[low:high], start[low:high], history)
            some = b.slice(low, high - low).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *some.columns], names=["part", *some.schema.names])


def _starts(c) -> np.ndarray:
    return pc.fill_null(c, int(_LEAST)).to_numpy()


#: Counted keys: prefix, columns, what of them (all, half-open, rejected), and whether in the time window or the last rows.
_SETS = (("h", ("dst",), "ner", True), ("s", ("service",), "ner", True), ("hs", ("dst", "service"), "ner", True), ("d", ("dst",), "ner", False), ("ds", ("dst", "service"), "ner", False), ("dp", ("dst", "dport"), "n", False))


def counts_of(seq: np.ndarray, start: np.ndarray, codes: dict[str, np.ndarray], states: dict[str, np.ndarray], at: np.ndarray, chunk: tuple[int, int], begin: tuple[int, int], window_us: int, history: int) -> dict[str, np.ndarray]:
    """prefix_k of the rows at the places ``at`` among rows in order of seq, of which n all, e half-open and r rejected. For the last
    rows: how many of them share the keys. For the time window: how many of the rows from place chunk[0] up to the row do, less those
    between places begin[0] and begin[1] that started before the window.

    Rows of a key are brought together, in order; the rows of a range are then a run, and a count is the difference of two places in
    it, or of two running sums, so the time does not depend on how many rows a window holds.
    """
    n = len(seq)
    upto = begin[0] + np.searchsorted(start[begin[0] : begin[1]], start[at] - window_us, side="left")
    recent = np.searchsorted(seq, seq[at] - history, side="left")
    out, runs = {}, {}
    for prefix, keys, kinds, in_time in _SETS:
        if keys not in runs:
            code = joined(codes, keys)
            _, code = np.unique(code, return_inverse=True)
            place = code * n + np.arange(n)
            order = np.argsort(place, kind="stable")
            sums = {k: np.concatenate([[0], np.cumsum(states[k][order])]) for k in "er"}
            runs[keys] = code[at] * n, place[order], sums
        code, places, sums = runs[keys]
        ranges = ((chunk[0], at, 1), (begin[0], upto, -1)) if in_time else ((recent, at, 1),)
        for low, high, sign in ranges:
            low, high = np.searchsorted(places, code + low), np.searchsorted(places, code + high)
            for k in kinds:
                found = high - low if k == "n" else sums[k][high] - sums[k][low]
                out[f"{prefix}_{k}"] = out.get(f"{prefix}_{k}", 0) + sign * found
    return out


def joined(codes: dict[str, np.ndarray], keys: tuple[str, ...]) -> np.ndarray:
    """One number for the codes of several columns."""
    code = codes[keys[0]].astype(np.int64)
    for k in keys[1:]:
        code = code * (int(codes[k].max(initial=0)) + 1) + codes[k]
    return code


_NARROW = "part long, seq long, start_us long, dst string, service string, dport string, e int, r int"
_CELLS = "part long, chunk long, begin long, dst string, service string, n long, e long, r long"
_TIMED = [(i, prefix, keys) for i, (prefix, keys, _, in_time) in enumerate(_SETS) if in_time]


def _between(cells: DataFrame) -> DataFrame:
    """part, set, dst, service, n, e, r: the rows of each key of a part in the chunks from that where its windows start up to the one
    before its own. A key's window has a few rows for each chunk, however many connections the key has."""
    sets = F.array(*(F.struct(F.lit(i).alias("set"), *((F.col(c) if c in keys else F.lit(None).cast("string")).alias(c) for c in ("dst", "service"))) for i, _, keys in _TIMED))
    key = ["set", "dst", "service"]
    each = cells.withColumn("_s", F.explode(sets)).select("part", "chunk", "begin", "n", "e", "r", "_s.*")
    held = each.groupBy(*key, F.col("chunk").alias("at")).agg(*(F.sum(c).alias(c) for c in "ner")).select(*key, "at", F.lit(None).cast("long").alias("part"), F.lit(0).alias("sign"), *"ner")
    asked = each.filter("begin < chunk").select(*key, "part", "chunk", "begin").distinct()
    ends = F.array(F.struct(F.col("chunk").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("begin").alias("at"), F.lit(-1).alias("sign")))
    asked = asked.withColumn("_e", F.explode(ends)).select(*key, "_e.at", "part", "_e.sign", *(F.lit(0).cast("long").alias(c) for c in "ner"))
    upto = Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    run = held.union(asked).select(*key, "part", "sign", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in "ner"))
    return run.filter("part is not null").groupBy("part", *key).agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in "ner"))


def with_counts(df: DataFrame, window_us: int, history: int = 100) -> DataFrame:
    """Adds COUNTS. h_, s_, hs_: of the earlier connections that started at most ``window_us`` before and share dst, service or
    both. d_, ds_, dp_: of the last ``history`` connections (of all) that share dst, dst and service, or dst and port.
    n all, e half-open, r rejected. Earlier is by seq, which numbers rows from 0 by start_us (null first); a null key is a key like any other.
    ``df`` is read several times.
    """
    size, firsts = _edges(df, window_us, history)
    parts = _Parts(size, firsts, df.agg(F.max("start_us")).first()[0], window_us) if len(firsts) else None
    flag = F.lower("flag")
    state = {"e": flag.isin(fixed.HALF_OPEN), "r": flag.isin(fixed.REJECTED)}
    rows = df.select("seq", "start_us", *(F.col(c).cast("string").alias(c) for c in ("dst", "service", "dport")), *(F.coalesce(v, F.lit(False)).cast("int").alias(k) for k, v in state.items()))

    def deal(batches) -> Iterator[pa.RecordBatch]:
        return _deal(batches, parts, history)

    def summed(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, begin = parts.of(b.column("seq").to_numpy(), _starts(b.column("start_us")))
            part = parts.first[own] + begin - parts.low[own]
            t = pa.table({"part": part, "chunk": own, "begin": begin, **{c: b.column(c) for c in ("dst", "service")}, "n": np.ones(len(own), np.int64), **{c: pc.cast(b.column(c), pa.int64()) for c in "er"}})
            keys = ["part", "chunk", "begin", "dst", "service"]
            t = t.group_by(keys).aggregate([(c, "sum") for c in "ner"]).select([*keys, "n_sum", "e_sum", "r_sum"])
            yield from t.rename_columns([*keys, *"ner"]).to_batches()

    def count(rows: pa.Table, between: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table([pa.array([], pa.int64())] * (1 + len(COUNTS)), ["seq", *COUNTS])
        rows = rows.sort_by("seq")
        seq, start, part = rows.column("seq").to_numpy(), _starts(rows.column("start_us")), rows.column("part")[0].as_py()
        c = int(np.searchsorted(parts.first, part, side="right")) - 1
        p = int(part - parts.first[c] + parts.low[c])
        own, begin = parts.of(seq, start)
        at = np.flatnonzero((own == c) & (begin == p))
        code = lambda c: np.unique(pc.fill_null(pc.index_in(c, pc.unique(c)), -1).to_numpy(), return_inverse=True)[1]
        both = {c: code(pa.chunked_array([*rows.column(c).chunks, *between.column(c).chunks], pa.string())) for c in ("dst", "service")}
        codes = {c: v[: len(seq)] for c, v in both.items()} | {"dport": code(rows.column("dport"))}
        place = lambda chunk: int(np.searchsorted(seq, chunk * size))
        found = counts_of(seq, start, codes, {k: rows.column(k).to_numpy() for k in "er"}, at, (place(c), place(c + 1)), (place(p), place(p + 1)), window_us, history)
        which = between.column("set").to_numpy()
        timed = start[at] > _LEAST
        for i, prefix, keys in _TIMED:
            every = joined(both, keys)
            held = np.flatnonzero(which == i)
            held = held[np.argsort(every[len(seq) + held])]
            key, mine = every[len(seq) + held], every[at]
            where = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
            for k in "ner":
                more = np.where(key[where] == mine, between.column(k).to_numpy()[held][where], 0) if len(key) else 0
                found[f"{prefix}_{k}"] = np.where(timed, found[f"{prefix}_{k}"] + more, 0)
        return pa.table([pa.array(seq[at]), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["seq", *COUNTS])

    kind = ", ".join(f"{c} long" for c in ("seq", *COUNTS))
    if parts is None:
        return df.withColumns({c: F.lit(0).cast("long") for c in COUNTS})
    cells = table(rows.mapInArrow(summed, _CELLS).groupBy("part", "chunk", "begin", "dst", "service").agg(*(F.sum(c).alias(c) for c in "ner")))
    counted = rows.mapInArrow(deal, _NARROW).groupBy("part").cogroup(_between(cells).groupBy("part")).applyInArrow(count, kind)  # two chunks' rows
    return df.join(counted, "seq").select(*df.columns, *COUNTS)


COUNTS = [f"{p}_{k}" for p in ("h", "s", "hs", "d", "ds") for k in "ner"] + ["dp_n"]


def features(counted: DataFrame) -> DataFrame:
    """The count and rate features from with_counts()."""
    one_less = lambda part, whole: F.when(F.col(whole) > 0, 1.0 - F.col(part) / F.col(whole)).otherwise(0.0)
    out = {
        "count": F.col("h_n").cast("double"),
        "srv_count": F.col("s_n").cast("double"),
        "serror_rate": rate("h_e", "h_n"),
        "srv_serror_rate": rate("s_e", "s_n"),
        "rerror_rate": rate("h_r", "h_n"),
        "srv_rerror_rate": rate("s_r", "s_n"),
        "same_srv_rate": rate("hs_n", "h_n"),
        "diff_srv_rate": one_less("hs_n", "h_n"),
        "srv_diff_host_rate": one_less("hs_n", "s_n"),
        "dst_host_count": F.col("d_n").cast("double"),
        "dst_host_srv_count": F.col("ds_n").cast("double"),
        "dst_host_same_srv_rate": rate("ds_n", "d_n"),
        "dst_host_diff_srv_rate": one_less("ds_n", "d_n"),
        "dst_host_same_src_port_rate": rate("dp_n", "d_n"),
        "dst_host_srv_diff_host_rate": F.lit(0.0),  # connections that share dst never differ in it
        "dst_host_serror_rate": rate("d_e", "d_n"),
        "dst_host_srv_serror_rate": rate("ds_e", "ds_n"),
        "dst_host_rerror_rate": rate("d_r", "d_n"),
        "dst_host_srv_rerror_rate": rate("ds_r", "ds_n"),
    }
    return counted.withColumns(out).drop(*COUNTS)


def with_history(df: DataFrame, window_us: int = 2_000_000, history: int = 100) -> DataFrame:
    """All history features of connections (start_us, seq, dst, dport, service, flag)."""
    return features(with_counts(df, window_us, history))
