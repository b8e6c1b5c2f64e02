"""Packets from classic capture files, read in byte ranges.

The text reader cuts files in ranges at a separator and hands on bytes as they are, from any store that Spark reads; put together
again with the separator, the lines of a range are its bytes. A range does not know where its first record begins: it looks for a
place from which a chain of plausible record headers leads on. What lies before that place, and from the last record of the range
on, is kept as its ends. Ends that meet are decoded afterwards and must be whole records, to the byte; as the first range begins at
a known place, that verifies every range. Files where it fails (a capture of captures, say) are decoded from the front, in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlark.session import table

PACKETS = "file string, pkt_idx long, ts double, src string, dst string, proto string, sport int, dport int, length int, flags int, icmp_type int, frag_bad int"
_KINDS = [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string(), pa.string(), *[pa.int32()] * 6]
_NAMES = [c.split()[0] for c in PACKETS.split(", ")]
_PIECE = PACKETS + ", start long, n int, size long, first boolean, head binary, tail binary"
_PIECE_KINDS = [*_KINDS, pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
_PIECE_NAMES = [c.split()[0] for c in _PIECE.split(", ")]

# First four bytes of a capture -> byte order and fraction of a second; link types; protocol numbers.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
ETHERNET, RAW_IP, LINUX_COOKED = 1, 101, 113
IPV4, VLAN = 0x0800, (0x8100, 0x88A8)
ICMP, TCP, UDP = 1, 6, 17

#: Where fields lie in their header: offset and bytes.
_LINK = {ETHERNET: (12, 2), LINUX_COOKED: (14, 2)}
_IP = {"version": (0, 1), "total": (2, 2), "fragment": (6, 2), "proto": (9, 1), "src": (12, 4), "dst": (16, 4)}
_PORTS = {"sport": (0, 2), "dport": (2, 2)}
#: Of each protocol: its name, the bytes of its header that must be there, and the size of the header itself.
_TRANSPORT = {TCP: ("tcp", 14, None), UDP: ("udp", 8, 8), ICMP: ("icmp", 4, 8)}

#: Begins most IPv4 headers: about one line for each packet.
_SEPARATOR = "E\0"
#: Headers that must follow each other, and bytes in which a range looks for the first of them.
_CHAIN, _LOOK = 8, 4 << 20
#: The longest record that is plausible, and seconds between records next to each other.
_LARGEST, _APART = 1 << 18, 7 * 86_400


# ---- frames of a buffer at once ----------------------------------------------------------------------------------


class _Fields:
    """Big-endian fields of many headers in one buffer; bytes beyond the buffer read as 0."""

    def __init__(self, raw: np.ndarray) -> None:
        self.raw = np.concatenate([raw, np.zeros(64, np.uint8)])

    def __call__(self, base: np.ndarray, layout: tuple[int, int]) -> np.ndarray:
        offset, size = layout
        out = np.zeros(len(base), np.int64)
        for i in range(size):
            out = out << 8 | self.raw[np.minimum(base + offset + i, len(self.raw) - 1)]
        return out


def decode(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, link: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which frames (from begin to end in the buffer) are IPv4, and of those src, dst (as numbers), proto, ports and the rest."""
    field = _Fields(raw)
    if link == RAW_IP:
        ip, there = begin, np.ones(len(begin), bool)
    elif link in _LINK:
        offset, size = _LINK[link]
        at, there = begin.copy(), end - begin >= offset + size
        while link == ETHERNET:  # tags push the type on
            tagged = there & np.isin(field(at, _LINK[link]), VLAN) & (end - at >= offset + size + 4)
            if not tagged.any():
                break
            at[tagged] += 4
        there &= field(at, _LINK[link]) == IPV4
        ip = at + offset + size
    else:
        return np.zeros(0, np.int64), {}
    kept = np.flatnonzero(there & (end - ip >= 20) & (field(ip, _IP["version"]) >> 4 == 4))
    ip, end = ip[kept], end[kept]
    head = {name: field(ip, layout) for name, layout in _IP.items()}
    size = (head["version"] & 15) * 4
    body, data = np.maximum(head["total"] - size, 0), ip + size
    # the last fragment of a packet with next to nothing in it: an overlap attack
    bad = (head["fragment"] & 0x1FFF > 0) & (head["fragment"] & 0x2000 == 0) & (body < 40)
    zero = np.zeros(len(ip), np.int64)
    out = {"src": head["src"], "dst": head["dst"], "proto": np.full(len(ip), "other", object), "sport": zero.copy(), "dport": zero.copy()}
    out |= {"length": body.copy(), "flags": zero.copy(), "icmp_type": zero - 1, "frag_bad": bad.astype(np.int64)}
    for number, (name, least, header) in _TRANSPORT.items():
        at = np.flatnonzero((head["proto"] == number) & (end - data >= least))
        out["proto"][at] = name
        inner = (field(data[at], (12, 1)) >> 4) * 4 if header is None else header
        out["length"][at] = np.maximum(body[at] - inner, 0)
        if number == ICMP:
            out["icmp_type"][at] = field(data[at], (0, 1))
            continue
        for port, layout in _PORTS.items():
            out[port][at] = field(data[at], layout)
        if number == TCP:
            out["flags"][at] = field(data[at], (13, 1))
    return kept, out


def _dotted(numbers: np.ndarray) -> list[str]:
    each, where = np.unique(numbers, return_inverse=True)
    names = np.array([".".join(str(v >> s & 255) for s in (24, 16, 8, 0)) for v in each.tolist()], object)
    return names[where].tolist() if len(each) else []


# ---- records -----------------------------------------------------------------------------------------------------


class Capture:
    """What a capture's first 24 bytes say."""

    def __init__(self, head: bytes, name: str = "capture") -> None:
        if len(head) < 24:
            raise ValueError(f"{name}: too short for a capture")
        if head[:4] not in MAGICS:
            raise ValueError(f"{name}: not a classic capture (first bytes {head[:4].hex()})")
        self.order, self.unit = MAGICS[head[:4]]
        self.link = struct.unpack_from(self.order + "I", head, 20)[0]
        self.record = struct.Struct(self.order + "IIII")

    def chain(self, raw: bytes, at: int) -> Iterator[tuple[int, float, int]]:
        """(place, seconds, bytes) of the records from ``at`` on whose headers are whole."""
        while at + 16 <= len(raw):
            seconds, part, size, _ = self.record.unpack_from(raw, at)
            yield at, seconds + part / self.unit, size
            at += 16 + size

    def first(self, raw: bytes, least: int = _CHAIN) -> int | None:
        """The first place from which ``least`` plausible headers, or all until the end, follow each other."""
        cells = np.frombuffer(raw, np.uint8)[: _LOOK + 16]
        n = len(cells) - 15
        if n <= 0:
            return None
        kind = "<u4" if self.order == "<" else ">u4"
        word = lambda k: np.ndarray((n,), kind, cells.tobytes(), 4 * k, (1,))
        part, size, whole = word(1), word(2), word(3)
        best = (0, None)  # chains that end with the buffer, the longest
        for at in np.flatnonzero((part < self.unit) & (size > 0) & (size <= _LARGEST) & (size <= whole) & (whole <= _LARGEST)).tolist():
            met, last, end = 0, None, at
            for place, seconds, size in self.chain(raw, at):
                _, part, _, whole = self.record.unpack_from(raw, place)
                if not (part < self.unit and 0 < size <= min(whole, _LARGEST) and whole <= _LARGEST and (last is None or abs(seconds - last) < _APART)):
                    break
                met, last, end = met + 1, seconds, place + 16 + size
                if met == least:
                    return at
            else:
                if end >= len(raw) - 15 and met > best[0]:
                    best = (met, at)
        return best[1]

    def rows(self, raw: bytes, at: int, stop: int | None = None) -> tuple[list, int]:
        """Columns (ts to frag_bad) of the IPv4 packets of the records from ``at`` on that begin before ``stop``, the last one
        cut off where the buffer ends; and where the next record begins."""
        stop = len(raw) if stop is None else stop
        places, times = [], []
        for place, seconds, size in self.chain(raw, at):
            if place >= stop:
                break
            places.append((place + 16, min(place + 16 + size, len(raw))))
            times.append(seconds)
            at = place + 16 + size
        spans = np.array(places, np.int64).reshape(-1, 2)
        kept, found = decode(np.frombuffer(raw, np.uint8), spans[:, 0], spans[:, 1], self.link)
        if not len(kept):
            return [[] for _ in range(10)], at
        columns = [np.array(times)[kept].tolist(), _dotted(found["src"]), _dotted(found["dst"])]
        return [*columns, *(found[c].tolist() for c in _NAMES[5:])], at


def packets(raw: bytes, name: str = "capture", limit: int | None = None) -> Iterator[tuple]:
    """(ts, src, ..., frag_bad) of a capture's IPv4 packets; a record whose header is cut off ends it."""
    columns, _ = Capture(raw[:24], name).rows(raw, 24)
    for i, row in enumerate(zip(*columns, strict=True)):
        if limit and i >= limit:
            return
        yield row


class _Range:
    """The records of one byte range as its bytes come in."""

    def __init__(self, capture: Capture, file: str, start: int) -> None:
        self.capture, self.file, self.start = capture, file, start
        self.held = bytearray()
        self.at: int | None = 24 if start == 0 else None  # of the next record in ``held``
        self.head = b""
        self.n = self.size = 0
        self.ended = False  # no record begins here

    def take(self, more: bytes, last: bool) -> Iterator[pa.RecordBatch]:
        self.held += more
        self.size += len(more)
        if self.at is None and not self.ended and (last or len(self.held) >= _LOOK + 16):
            self.at = self.capture.first(bytes(self.held))
            self.head = bytes(self.held[: self.at]) if self.at is not None else b""
            self.ended = self.at is None
        if self.at is None or (len(self.held) < 1 << 20 and not last):
            return
        # the last whole record stays: it belongs to the range's end
        raw, stop = bytes(self.held), self.at
        for place, _, size in self.capture.chain(raw, self.at):
            if place + 16 + size > len(raw):
                break
            stop = place
        if stop > self.at:
            columns, at = self.capture.rows(raw, self.at, stop)
            k = len(columns[0])
            if k:
                idx = list(range(self.n, self.n + k))
                arrays = [pa.array(v, kind) for v, kind in zip([[self.file] * k, idx, *columns], _KINDS, strict=True)]
                yield pa.record_batch([*arrays, pa.array([self.start] * k, pa.int64()), *(pa.nulls(k, kind) for kind in _PIECE_KINDS[-5:])], _PIECE_NAMES)
            self.n += k
            del self.held[:at]
            self.at = 0

    def close(self) -> pa.RecordBatch:
        begun = self.at is not None
        tail = bytes(self.held[self.at :]) if begun else bytes(self.held)
        row = [self.file, *[None] * 11, self.start, self.n, self.size, begun, self.head, tail]
        return pa.record_batch([pa.array([v], kind) for v, kind in zip(row, _PIECE_KINDS, strict=True)], _PIECE_NAMES)


# ---- files -------------------------------------------------------------------------------------------------------


def _plain(name: str) -> str:
    """A file's name without scheme and slashes in front, as which it is known whoever lists it."""
    return name.split(":", 1)[-1].lstrip("/")


def _heads(spark: SparkSession, path: str) -> dict[str, tuple[bytes, int]]:
    """First 24 bytes and size of each file; an error for a file that is no capture."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = {}
    for found in files.globStatus(place) or []:
        inside = files.listStatus(found.getPath()) if found.isDirectory() else [found]
        for f in inside:
            if f.isDirectory() or f.getPath().getName()[0] in "._":
                continue
            stream = files.open(f.getPath())
            try:
                head = b"".join(struct.pack(">q", stream.readLong()) for _ in range(3)) if f.getLen() >= 24 else b""
            finally:
                stream.close()
            name = f.getPath().toString()
            Capture(head, name)
            out[name] = (head, f.getLen())
    return out


def _pieces(spark: SparkSession, path: str | list[str], heads: dict[str, tuple[bytes, int]]) -> DataFrame:
    """Packets of ranges, with a row for each range's ends."""
    shared = spark.sparkContext.broadcast({_plain(k): h for k, (h, _) in heads.items()})  # 24 bytes a file
    separator = _SEPARATOR.encode()

    def work(batches) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None
        for b in batches:
            files, starts = b.column(1).to_pylist(), b.column(2).to_numpy()
            lines = b.column(0).to_pylist()
            i = 0
            while i < len(lines):
                j = i
                while j < len(lines) and starts[j] == starts[i] and files[j] == files[i]:
                    j += 1
                if now is None or (now.file, now.start) != (files[i], int(starts[i])):
                    if now is not None:
                        yield from now.take(b"", True)
                        yield now.close()
                    now = _Range(Capture(shared.value[_plain(files[i])]), files[i], int(starts[i]))
                yield from now.take(separator.join(lines[i:j]) + separator, False)
                i = j
        if now is not None:
            yield from now.take(b"", True)
            yield now.close()

    lines = spark.read.option("lineSep", _SEPARATOR).text(path)
    lines = lines.select(F.col("value").cast("binary"), F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return lines.mapInArrow(work, _PIECE)


def _seams(pieces: DataFrame, heads: dict[str, tuple[bytes, int]]) -> DataFrame:
    """Packets at the ends of ranges that meet, ``at`` the range after whose packets they come; and of each such place a row with the
    number ``k`` of its packets and whether its bytes ``fits``: they are whole records, or the file ends there."""
    shared = pieces.sparkSession.sparkContext.broadcast({_plain(k): v for k, v in heads.items()})
    along, whole = Window.partitionBy("file").orderBy("start"), Window.partitionBy("file")  # one row a range
    ends = pieces.filter("n is not null").select("file", "start", "size", "first", "head", "tail")
    ends = ends.withColumns({"seam": F.sum(F.col("first").cast("int")).over(along), "all": F.sum("size").over(whole)})
    none = F.lit(None).cast("long")
    tails = ends.select("file", "all", "seam", (2 * F.col("start") + 1).alias("order"), F.col("tail").alias("part"), F.when(F.col("first"), F.col("start")).alias("at"))
    begun = ends.filter("first").select("file", "all", (F.col("seam") - 1).alias("seam"), (2 * F.col("start")).alias("order"), F.col("head").alias("part"), none.alias("at"))
    met = tails.unionByName(begun).filter("seam > 0").groupBy("file", "all", "seam").agg(F.array_sort(F.collect_list(F.struct("order", "part"))).alias("parts"), F.max("at").alias("at"))
    met = met.withColumn("final", F.col("seam") == F.max("seam").over(whole)).select("file", "all", "at", "final", F.transform("parts", lambda p: p["part"]).alias("parts"))
    schema, kinds = PACKETS + ", at long, fits boolean, k int", [*_KINDS, pa.int64(), pa.bool_(), pa.int32()]

    def work(batches) -> Iterator[pa.RecordBatch]:
        names = [*_NAMES, "at", "fits", "k"]
        for b in batches:
            for file, size, at, final, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head, there = shared.value[_plain(file)]
                raw = b"".join(parts)
                if final and size > there:  # the separator after the last line is not in the file
                    raw = raw[: there - size]
                columns, end = Capture(head).rows(raw, 0)
                k = len(columns[0])
                rows = [[file] * k, list(range(k)), *columns, [at] * k, [None] * k, [None] * k]
                told = [[file], *[[None]] * 11, [at], [final or end == len(raw)], [k]]
                yield pa.record_batch([pa.array(v + t, kind) for v, t, kind in zip(rows, told, kinds, strict=True)], names)

    return met.mapInArrow(work, schema)


def read_packets(spark: SparkSession, path: str, max_packets: int | None = None) -> DataFrame:
    """IPv4 packets of all captures at ``path`` (a file, a folder or a glob). pkt_idx is a packet's place in its file, from 0;
    ``max_packets`` is for each file. The bytes of a record that the file cuts off are decoded as far as they go.

    Files are decoded in ranges of spark.sql.files.maxPartitionBytes. A file without a single usual IPv4 header has no place to
    be cut and is one range, of 2 GB at most.
    """
    heads = _heads(spark, path)
    if not heads:
        raise FileNotFoundError(f"no files: {path}")
    pieces = table(_pieces(spark, path, heads))
    seams = table(_seams(pieces, heads))
    odd = [r["file"] for r in seams.filter("not fits").select("file").distinct().collect()]  # names of files, as listed before
    if odd:
        ours = {k: v for k, v in heads.items() if _plain(k) in set(map(_plain, odd))}
        again = _undivided(spark, list(ours), ours)
        pieces = pieces.join(F.broadcast(spark.createDataFrame([(f,) for f in odd], "file string")), "file", "left_anti").unionByName(again)
        pieces = table(pieces)
        seams = table(_seams(pieces, heads))
    ranges = pieces.filter("first").select("file", "start", "n").join(seams.filter("k is not null").select("file", F.col("at").alias("start"), "k"), ["file", "start"], "left")
    total = F.col("n") + F.coalesce("k", F.lit(0))
    ranges = table(ranges.withColumn("before", (F.sum(total).over(Window.partitionBy("file").orderBy("start")) - total).cast("long")).drop("k"))
    inside = pieces.filter("n is null").select(*_NAMES, "start").join(ranges, ["file", "start"]).withColumn("pkt_idx", F.col("pkt_idx") + F.col("before"))
    between = seams.filter("k is null").withColumnRenamed("at", "start").select(*_NAMES, "start").join(ranges, ["file", "start"])
    between = between.withColumn("pkt_idx", F.col("pkt_idx") + F.col("before") + F.col("n"))
    out = inside.select(*_NAMES).unionByName(between.select(*_NAMES))
    return out.filter(F.col("pkt_idx") < max_packets) if max_packets else out


def _undivided(spark: SparkSession, files: list[str], heads: dict[str, tuple[bytes, int]]) -> DataFrame:
    """Pieces of files that are each one range, decoded from the front."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, str(max(size for _, size in heads.values()) + 1))
    try:
        return table(_pieces(spark, files, heads))
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def load_captures(spark: SparkSession, path: str, max_packets: int | None = None) -> DataFrame:
    """Connection features of captures; an error if there are none."""
    from flowlark.operators.flows import assemble, connections

    found = table(read_packets(spark, path, max_packets))
    if found.isEmpty():
        raise ValueError(f"{path}: no IPv4 packets")
    # files are told apart in the order of packets only; a flow may span several of them
    found = found.withColumn("pkt_idx", F.col("pkt_idx") + F.shiftleft(F.pmod(F.xxhash64("file"), F.lit(1 << 20)), 40))
    return connections(assemble(found))
