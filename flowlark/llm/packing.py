"""Operator 6: packing documents into token sequences by best-fit decreasing with certified repacking.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces are dealt evenly over partitions and each partition
packs its own best-fit decreasing. Dual feasible functions bound the number of sequences that its pieces need from
below; a partition that meets the bound is done. The others give up their emptiest sequences, whose pieces meet those
of other partitions in the next round, in fewer partitions, until all meet their bound or a round saves nothing. Each
piece carries its partition's gap, the sequences beyond the bound: 0 certifies that the partition needs no fewer.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm import bpe
from flowlark.llm.common import arrow_rows, cut, documents

_encodings: dict[int, Encoder] = {}
#: Runs from which the fast encoder's pattern, which backtracks, is not trusted. Each is looked for at the beginning of a run
#: only, so the search is linear.
_LONG_RUN = re.compile(r"(?<!\s)\s{2000}|([^\W\d_])(?<!\1\1)\1{9999}|(?<!\w)\w{200000}|(?<![^\s\w])[^\s\w]{200000}")


class Encoder:
    """The vocabulary in the form whose encoder is fastest on whole texts. Texts with very long runs are encoded by the
    dynamic program of op1, whose time and memory they do not hurt; ids and splits are the same."""

    def __init__(self, fast: tiktoken.Encoding, codec: bpe.Codec) -> None:
        self.fast, self.codec = fast, codec

    def encode(self, text: str) -> list[int]:
        if _LONG_RUN.search(text):
            return list(self.codec.encode(text))
        return self.fast.encode(text, allowed_special="all")


def _encoding(vocabulary: bytes) -> Encoder:
    name = zlib.crc32(vocabulary)
    if name not in _encodings:
        c = bpe.Codec(vocabulary, remember=1)
        special = {t: i for t, i in c.special.items()}
        ranks = {b: i for i, b in c.bytes_of.items() if i not in special.values()}
        pattern = bpe.PIECES.pattern
        _encodings[name] = Encoder(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), c)
    return _encodings[name]


def pieces(df: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and ``end_id``, uncut if they fit, else in pieces of
    ``capacity`` of which the first may be shorter. A null or empty text is ``end_id`` alone."""
    shared = bpe.share(df.sparkSession, vocabulary)

    def work(batches):
        enc = _encoding(shared.value)
        for b in arrow_rows(batches):
            out = []
            for doc, t in zip(b.column(0), b.column(1), strict=True):
                text = (t.as_py() or "").encode("utf-8", "replace").decode()
                ids = np.array([*enc.encode(text), end_id], "<u4")
                edges = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((doc.as_py(), k, a, z - a, zlib.crc32(ids[a:z].tobytes())))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents(df, id_col=id_col, text_col=text_col).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Sequences that pieces of these sizes need at least: the greatest bound of a family of dual feasible functions.

    For a limit e up to half the capacity, a size over capacity - e counts as a whole sequence, one below e as nothing
    and any other as itself; and for each k, a size counts as floor((k + 1) * size / capacity) / k, unless that product
    is whole, when it counts as size / capacity. Sums of these never exceed 1 in a sequence that fits.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    at = np.arange(capacity + 1)
    total, number = np.cumsum(count * at), np.cumsum(count)
    e = np.arange(0, capacity // 2 + 1)
    middle = total[capacity - e] - np.where(e > 0, total[np.maximum(e - 1, 0)], 0)
    large = number[-1] - number[capacity - e]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 30):
        scaled = (k + 1) * at
        whole = scaled % capacity == 0
        parts = np.where(whole, k * at, scaled // capacity * capacity)
        best = max(best, int(-(-int((count * parts).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Bin of each size, largest sizes first, each into the fullest bin that has room; and what each bin holds."""
    order = np.argsort(-sizes, kind="stable")
    bins, held = np.empty(len(sizes), np.int64), []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms for which a bin is open
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            target, room = len(held), capacity
            held.append(0)
        else:
            room = rooms[at]
            target = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop(at)
        bins[i] = target
        held[target] += size
        if left := room - size:
            if not open_by_room[left]:
                bisect.insort(rooms, left)
            open_by_room[left].append(target)
    return bins, held


_PLACED = "pid long, length long, bin long, offset long, again boolean, gap int"


def _round(items: DataFrame, number: int, capacity: int) -> DataFrame:
    """Packs each partition (column ``part``); again: the piece is given up to the next round; gap: the partition's
    sequences beyond its lower bound."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "pid"], ascending=[False, True], kind="stable")
        sizes, part = group["length"].to_numpy(), int(group["part"].iloc[0])
        bins, held = best_fit_decreasing(sizes, capacity)
        gap = len(held) - lower_bound(sizes, capacity)
        give = np.zeros(len(held), bool)
        if gap:
            by_room = np.argsort(held, kind="stable")
            room = np.cumsum(capacity - np.array(held)[by_room])
            give[by_room[: max(64, 1 + int(np.searchsorted(room, 8 * gap * capacity)))]] = True
        order = np.argsort(bins, kind="stable")
        sums = np.cumsum(sizes[order])
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        base = np.maximum.accumulate(np.where(first, sums - sizes[order], 0))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = sums - sizes[order] - base
        return pd.DataFrame(
            {"pid": group["pid"], "length": sizes, "bin": (number << 48) | (part << 24) | bins, "offset": offset, "again": give[bins], "gap": np.int32(gap)}
        )

    return items.groupBy("part").applyInPandas(work, _PLACED)


def place(items: DataFrame, capacity: int = 2048, per_partition: int = 40_000) -> DataFrame:
    """pid, sequence_id, offset, gap for items (pid long, length long), lengths from 1 to ``capacity``. A pid names one
    item; ties between equal lengths go by pid. Each partition holds about ``per_partition`` items. Rounds go on while
    sequences are given up and the round before has saved some."""
    kept = ("pid", F.col("bin").alias("sequence_id"), "offset", "gap")
    zero = F.lit(0)
    full = items.filter(F.col("length") == capacity).select("pid", F.col("pid").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), zero.cast("long").alias("offset"), zero.alias("gap"))
    rest, done = items.filter(F.col("length") < capacity), [full]
    n, given, number = rest.count(), None, 1
    while n:
        parts = -(-n // per_partition)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("pid", F.lit(number)), F.lit(parts)))
        placed = cut(_round(dealt, number, capacity))
        opens = F.expr("if(offset = 0, 1, 0)")  # one piece of each sequence
        made = placed.agg(F.sum(opens).alias("made"), F.sum(F.when(F.col("again"), opens)).alias("given"), F.count_if("again").alias("n")).first()
        last = parts == 1 or not made["n"] or (given is not None and made["made"] >= given)
        done.append((placed if last else placed.filter("not again")).select(*kept))
        if last:
            break
        rest, given, n, number = placed.filter("again").select("pid", "length"), made["given"], made["n"], number + 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def pack(df: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 40_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap, one row for each piece of each row.

    gap: how many sequences the piece's partition has beyond the fewest that its pieces can need. Null and empty texts
    are one token, the end id. Rows that repeat a doc_id are packed one by one, each with its own pieces; null doc_ids
    stay null. Extra columns are ignored; an empty table gives an empty table. No sequence holds more than ``capacity``
    tokens, and offsets in a sequence are gapless from 0.
    """
    # the number is written with the piece, so that it names the piece whenever it is read
    numbered = cut(pieces(df, vocabulary, capacity, id_col=id_col, text_col=text_col).withColumn("pid", F.monotonically_increasing_id()))
    return numbered.join(place(numbered.select("pid", "length"), capacity, per_partition), "pid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap"
    )
