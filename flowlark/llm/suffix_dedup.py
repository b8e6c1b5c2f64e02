"""Operator 5: exact removal of repeated byte passages by a depth-limited, most-significant-digit radix sort.

Suffixes are ordered only through their first ``length`` bytes, their windows; after the last pass the equal groups are
exactly the repeated windows. A pass splits groups by one more digit, and whatever is alone in its group leaves at
once. What makes this fit a cluster is the choice of digits, which are read from a window's anchor outward:

* Pass 1 takes the window's anchor, the fingerprint of the smallest of its ``gram``-byte strings. Equal windows have
  equal anchors at equal offsets, and about ``2 / (length - gram)`` of all positions are anchors, so only those are
  shuffled. An anchor whose fingerprint occurs once ends all windows that belong to it.
* Each later pass has items, runs of neighbouring windows at fixed offsets from an anchor, with two digits: what all
  windows of the run have in common (the core) and what they cover together (the hull). If the core is alone, no window
  repeats; if the hull occurs twice, all repeat; else the run is divided. The last pass has single windows.

Groups of equal digits are found by hash partitioning, not put in lexical order, which the result does not need. Cores
are 64-bit polynomials and only rule out; two cores that fall together cost time. What removes bytes is a hull's own
xxh3 fingerprint within its core's group, and for single windows both numbers, 128 bits.

Groups are only counted (with partial sums before each shuffle) and joined back, never gathered, so a passage in a third
of all documents needs no task of its own. Each pass is written as a table, and the tables before it are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from flowlark.llm.common import arrow_rows, cut, documents, free, mix, row_key

#: Bytes of text that are fingerprinted at a time; texts beyond it are taken in overlapping parts.
PART = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> np.ndarray:
    if len(_tables.get("powers", ())) < n:
        with np.errstate(over="ignore"):
            _tables["powers"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
    return _tables["powers"]


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
    return _tables["letters"]


class Spans:
    """Fingerprints of any span of a buffer, from one running sum."""

    TOP = 4 * PART

    def __init__(self, data: np.ndarray) -> None:
        if len(data) > self.TOP:
            raise ValueError("buffer too long")
        self.powers = _powers(self.TOP)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_letters()[data] * self.powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.powers[self.TOP - start])

    def grams(self, width: int) -> np.ndarray:
        """Of all spans of ``width``, in order."""
        n = len(self.sums) - width
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:n]) * self.powers[self.TOP - n + 1 : self.TOP + 1][::-1])


def _running(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``width`` values."""
    out, have = values, 1
    while have < width:
        by = min(have, width - have)
        out = pick(out[:-by], out[by:]) if by else out
        have += by
    return out


def anchors(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Positions of the anchors of all windows that start where ``valid``, the nearest and the farthest start (as a
    distance before the anchor) of those windows, and the buffer's Spans."""
    spans = Spans(data)
    keys = (spans.grams(gram) >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    reach = length - gram + 1
    least = _running(keys, reach, np.minimum)
    least = np.where(valid[: len(least)], least, np.uint32(0))
    padded = np.concatenate([np.zeros(reach - 1, np.uint32), least, np.zeros(reach - 1, np.uint32)])
    at = np.flatnonzero(_running(padded, reach, np.maximum)[: len(keys)] == keys)
    near, far = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(padded, reach)
    for i in range(0, len(at), 4096):
        own = at[i : i + 4096]
        mine = windows[own] == keys[own][:, None]  # column c: the window that starts reach - 1 - c before the anchor
        far[i : i + 4096] = reach - 1 - mine.argmax(axis=1)
        near[i : i + 4096] = mine[:, ::-1].argmax(axis=1)
    return at, near, far, spans


def _parts(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers over texts: data, valid window starts, and of each text in it number, buffer place and offset."""
    margin = 2 * length
    group, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > PART:
            for lo in range(0, len(t) - length + 1, PART):
                left = max(0, lo - margin)
                piece = np.frombuffer(t[left : lo + PART + margin], np.uint8)
                valid = np.zeros(len(piece), bool)
                valid[lo - left : min(lo + PART, len(t) - length + 1) - left] = True
                yield piece, valid, np.array([i]), np.array([0]), np.array([left])
            continue
        if size + len(t) > PART:
            yield _joined(group, length)
            group, size = [], 0
        group.append((i, t))
        size += len(t)
    if group:
        yield _joined(group, length)


def _joined(group: list[tuple[int, bytes]], length: int):
    sizes = np.array([len(t) for _, t in group])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    edge = np.zeros(ends[-1] + 1, np.int8)
    edge[starts] += 1
    edge[ends - length + 1] -= 1
    data = np.frombuffer(b"".join(t for _, t in group), np.uint8)
    return data, np.cumsum(edge[:-1]) > 0, np.array([i for i, _ in group]), starts, np.zeros(len(group), np.int64)


_ROWS = "core long, hull long, k long, at long"


def _batch(core, hull, k, at) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (core, hull, k, at)], ["core", "hull", "k", "at"])


def _digests(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    found = [xxhash.xxh3_64_intdigest(text[a:z]) for a, z in zip(start.tolist(), end.tolist(), strict=True)]
    return np.array(found, np.uint64)


def _alone(k: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Instead of a hull that leaves its text: a number of its own."""
    with np.errstate(over="ignore"):
        return mix(mix(k.astype(np.uint64)) + at.astype(np.uint64))


def _utf8(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "replace")


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """core: the gram's fingerprint; at: position << 32 | nearest << 16 | farthest."""

    def batch(core, k, at):
        return pa.record_batch([pa.array(core.view(np.int64)), pa.array(k), pa.array(at)], ["core", "k", "at"])

    def work(batches):
        for b in arrow_rows(batches, PART):
            texts = [_utf8(t) for t in b.column(2)]
            keys = b.column(0).to_numpy()
            long: dict[int, list] = {}
            for data, valid, number, place, offset in _parts(texts, length, gram):
                at, near, far, spans = anchors(data, valid, length, gram)
                which = np.searchsorted(place, at, side="right") - 1
                own, pos = number[which], at - place[which] + offset[which]
                core = spans.of(at, at + gram)
                if len(number) == 1 and len(texts[number[0]]) > PART:
                    long.setdefault(int(number[0]), []).append((core, pos, near, far))
                else:
                    yield batch(core, keys[own], pos << 32 | near << 16 | far)
            for i, found in long.items():  # an anchor of windows on both sides of a seam counts once
                core, pos, near, far = (np.concatenate(x) for x in zip(*found, strict=True))
                one, first, back = np.unique(pos, return_index=True, return_inverse=True)
                lo, hi = np.full(len(one), 1 << 15), np.zeros(len(one), np.int64)
                np.minimum.at(lo, back, near)
                np.maximum.at(hi, back, far)
                yield batch(core[first], np.full(len(one), keys[i]), one << 32 | lo << 16 | hi)

    return docs.mapInArrow(work, "core long, k long, at long")


def _hulls(length: int, gram: int):
    """Gives anchors their hull: from the first byte of the farthest to the last of the nearest of their windows. Of
    anchors of a text with the same gram and the same windows (the gram occurs twice in each) only the first stays, for
    a hull counts once for each place."""

    def work(batches):
        for b in arrow_rows(batches, PART):
            for k, text, ats in zip(b.column(0).to_numpy(), b.column(2), _flat(b.column(3)), strict=True):
                text, ats = _utf8(text), np.sort(ats)
                pos, near, far = ats >> 32, ats >> 16 & 0xFFFF, ats & 0xFFFF
                lo, hi = pos - far, pos - near + length
                core, hull = np.empty(len(ats), np.uint64), _digests(text, lo, hi)
                for part, left, spans in _spans_in_parts(text, pos, 2 * length):
                    core[part] = spans.of(pos[part] - left, pos[part] + gram - left)
                with np.errstate(over="ignore"):
                    _, one = np.unique(mix(core + mix((lo << 32 | hi).astype(np.uint64))), return_index=True)
                if len(one):
                    yield _batch(core[one], hull[one], np.full(len(one), k), ats[one])

    return work


def _settle(rows: DataFrame) -> DataFrame:
    """One pass over (core, hull, k, at), a table that is deleted: k, at, whole, divided.

    whole: the run repeats as a whole. divided: its windows must be looked at; its hull is alone but its core is not, or
    it stands in for those with its hull, in case a divided one shares windows with them (one document of each hull).
    """
    hulls = cut(rows.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min("k").alias("stand_in")))
    cores = hulls.groupBy("core").agg(F.sum("n").alias("of_core"), F.sum(F.expr("if(n = 1, 1, 0)")).alias("open"))
    cores = cut(cores.filter("of_core > 1").select("core", F.expr("open > 0").alias("open")))
    # both sides of each join are dealt for it, so that a key with many rows can be split between tasks
    told = cut(hulls.join(cores, "core"))
    marked = rows.join(told, ["core", "hull"]).select("k", "at", F.expr("n > 1").alias("whole"), F.expr("n = 1 or (open and k = stand_in)").alias("divided"))
    out = cut(marked)
    free(rows, hulls, cores, told)
    return out


def _divide(docs: DataFrame, items: DataFrame, work) -> DataFrame:
    """``work`` over (k, doc_id, text) with the array of the items of each text."""
    per_text = items.groupBy("k").agg(F.collect_set("at").alias("ats"))
    return docs.join(per_text, "k").mapInArrow(work, _ROWS)


def _flat(column: pa.Array) -> Iterator[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for x in column:
        yield np.asarray(x.values if x.is_valid else [], dtype=np.int64)


def _spans_in_parts(text: bytes, at: np.ndarray, reach: int) -> Iterator[tuple[slice, int, Spans]]:
    """Sorted places in parts: slice of ``at``, offset of the part's buffer, its Spans (``reach`` bytes either side)."""
    i = 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + PART))
        left = max(0, int(at[i]) - reach)
        yield slice(i, j), left, Spans(np.frombuffer(text[left : int(at[j - 1]) + reach], np.uint8))
        i = j


def _runs(length: int, gram: int, step: int):
    """Divides anchors into runs of ``step`` windows; at: first window start << 32 | number of windows - 1."""
    reach = length - gram + 1
    first = np.arange(0, reach, step)  # distance of the run's last window start before the anchor
    last = np.minimum(first + step, reach) - 1

    def work(batches):
        for b in arrow_rows(batches, PART):
            for k, text, ats in zip(b.column(0).to_numpy(), b.column(2), _flat(b.column(3)), strict=True):
                text = _utf8(text)
                pos, near, far = ats >> 32, ats >> 16 & 0xFFFF, ats & 0xFFFF
                take = (first[None, :] <= far[:, None]) & (last[None, :] >= near[:, None])
                lo, hi = (pos[:, None] - last[None, :])[take], (pos[:, None] - first[None, :])[take]
                inside = (hi >= 0) & (lo + length <= len(text))
                both = np.unique(lo[inside] << 32 | (hi - lo)[inside])
                yield from _core_rows(k, text, both, length)

    return work


def _core_rows(k: int, text: bytes, items: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    lo, hi = items >> 32, (items >> 32) + (items & 0xFFFFFFFF)
    for part, left, spans in _spans_in_parts(text, lo, 3 * length):
        a, z = lo[part], hi[part]
        core_a, core_z = np.maximum(z, 0), np.minimum(a + length, len(text))
        core = spans.of(core_a - left, np.maximum(core_z, core_a) - left)
        inside = (a >= 0) & (z + length <= len(text))
        owner = np.full(len(a), k)
        # a run that leaves its text has no hull; its core is cut nowhere, for hi >= 0 and lo + length <= size
        hull = _alone(owner, items[part])
        hull[inside] = _digests(text, a[inside], z[inside] + length)
        yield _batch(core, hull, owner, items[part])


def _windows(length: int):
    """Divides runs into single windows: core and hull are two fingerprints of the same bytes."""

    def work(batches):
        for b in arrow_rows(batches, PART):
            for k, text, ats in zip(b.column(0).to_numpy(), b.column(2), _flat(b.column(3)), strict=True):
                text = _utf8(text)
                lo, more = ats >> 32, ats & 0xFFFFFFFF
                ends = np.cumsum(more + 1)
                starts = np.arange(ends[-1]) - np.repeat(ends - more - 1, more + 1) + np.repeat(lo, more + 1)
                starts = np.unique(starts[(starts >= 0) & (starts + length <= len(text))])
                for part, left, spans in _spans_in_parts(text, starts, 2 * length):
                    at = starts[part]
                    yield _batch(spans.of(at - left, at + length - left), _digests(text, at, at + length), np.full(len(at), k), at << 32)

    return work


def repeated(docs: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """k, spans, a table: for each text (k, doc_id, text) that has any, the byte ranges (start << 32 | end, not yet
    merged) of the windows that start anywhere else too."""
    if not 0 < gram < length < 1 << 15:
        raise ValueError("0 < gram < length < 32768 is needed")
    every = cut(_anchor_rows(docs, length, gram))
    alive = cut(every.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"))
    anchors_left = cut(every.join(alive, "core").select("k", "at"))
    free(every, alive)
    marked = _settle(cut(_divide(docs, anchors_left, _hulls(length, gram))))
    free(anchors_left)
    pos, near, far = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(0xFFFF), F.col("at").bitwiseAND(0xFFFF)
    lo, more = F.shiftright("at", 32), F.col("at").bitwiseAND(0xFFFFFFFF)
    packed = lambda start, end: F.shiftleft(F.greatest(start, F.lit(0)).cast("long"), 32).bitwiseOR(end).alias("span")
    spans = [marked.filter("whole").select("k", packed(pos - far, pos - near + length))]
    # only texts with anchors to divide are read again
    items = marked.filter("divided").groupBy("k").agg(F.collect_set("at").alias("ats"))
    left = cut(docs.join(items, "k"))
    marked_runs = _settle(cut(left.mapInArrow(_runs(length, gram, step), _ROWS)))
    spans.append(marked_runs.filter("whole").select("k", packed(lo, lo + more + length)))
    windows = cut(_divide(left.select("k", "doc_id", "text"), marked_runs.filter("divided"), _windows(length)))
    twice = cut(windows.groupBy("core", "hull").agg(F.count("*").alias("n")).filter("n > 1").select("core", "hull"))
    spans.append(windows.join(twice, ["core", "hull"]).select("k", packed(lo, lo + length)))
    found = cut(spans[0].union(spans[1]).union(spans[2]).groupBy("k").agg(F.collect_set("span").alias("spans")))
    free(marked, left, marked_runs, windows, twice)
    return found


def merged(spans: np.ndarray, size: int) -> np.ndarray:
    """Start and end of the maximal runs that ranges cover together, in order."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.minimum(spans & 0xFFFFFFFF, size)
    upto = np.maximum.accumulate(end) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > upto[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1) if len(start) else np.zeros(0, np.int64)
    return np.stack([start[new], upto[last]], axis=1)


def _judged(df: DataFrame, length: int, gram: int, step: int, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """k, doc_id, text, spans and the columns to carry, the latter as one."""
    whole = documents(df, F.struct(*carry).alias("carry") if carry else F.lit(None).alias("carry"), id_col=id_col, text_col=text_col)
    docs = whole.select(row_key().alias("k"), "doc_id", "text")
    if not carry:
        return docs.join(repeated(docs, length, gram, step), "k", "left")
    spans = repeated(docs, length, gram, step)
    return whole.select(row_key().alias("k"), "doc_id", "text", "carry").join(spans, "k", "left").select("k", "doc_id", "text", "spans", "carry")


def _kept(text: bytes, runs: np.ndarray) -> list[bytes]:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return [text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]


def removal_digests(
    df: DataFrame, length: int = 200, gram: int = 64, step: int = 12, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row for each row of ``df``.

    Every byte covered by a ``length``-byte string that also starts anywhere else, in the same text or another, counts
    as removed; strings never cross texts and are judged on the input. Null texts are empty; texts shorter than
    ``length`` lose nothing. Rows that repeat a text lose all of it (if it is long enough). Extra columns are ignored; an empty
    table gives an empty table.
    """

    def work(batches):
        for b in arrow_rows(batches):
            out = []
            for t, spans in zip(b.column(2), _flat(b.column(3)), strict=True):
                text = _utf8(t)
                runs = merged(spans, len(text))
                kept = b"".join(_kept(text, runs))
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            n, gone, count, sha = zip(*out, strict=True)
            yield pa.record_batch(
                [b.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _judged(df, length, gram, step, id_col, text_col).mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def strip_repeats(
    df: DataFrame, length: int = 200, gram: int = 64, step: int = 12, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, text without the bytes that removal_digests() counts, and the columns ``carry``. A character cut in half
    at the edge of a removed run goes as a whole; null texts stay null."""

    def work(batches):
        for b in arrow_rows(batches):
            texts = []
            for t, spans in zip(b.column(2), _flat(b.column(3)), strict=True):
                text = _utf8(t)
                kept = _kept(text, merged(spans, len(text)))
                texts.append("".join(p.decode("utf-8", "ignore") for p in kept) if t.is_valid else None)
            more = [b.column(4)] if carry else []
            yield pa.record_batch([b.column(1), pa.array(texts, pa.string()), *more], ["doc_id", "text", "carry"][: 2 + len(more)])

    kinds = {f.name: f.dataType for f in df.schema}
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    if carry:
        schema.add("carry", StructType([StructField(c, kinds[c]) for c in carry]))
    out = _judged(df, length, gram, step, id_col, text_col, carry).mapInArrow(work, schema)
    return out.select("doc_id", "text", *(F.col(f"carry.`{c}`") for c in carry))
