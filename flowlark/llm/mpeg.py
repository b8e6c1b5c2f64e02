"""Operator 9: media columns as MPEG audio (version 1, layer III).

``mux`` stores bytes as the main data of checksummed frames behind an ID3v2 tag and a frame with a variable-bitrate
table; ``demux`` reads any such stream: it parses the tag, finds frame headers anew after damage, parses the
variable-bitrate table, verifies checksums, and returns exact durations and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import arrow_rows, documents

# Fixed values of the format: kbit/s by index for layer III, and samples a second, for version 1 and the half rates.
BITRATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {3: 1152, 2: 576, 0: 576}


@dataclass
class Frame:
    offset: int
    size: int
    rate: int
    samples: int
    protected: bool
    side: int  # bytes of side information
    header: bytes

    @property
    def data(self) -> int:
        """Place of the main data in the frame."""
        return 4 + 2 * self.protected + self.side


def header(raw: bytes, at: int) -> Frame | None:
    """The frame whose header is at ``at``, or None if no valid layer III header is there."""
    if at + 4 > len(raw) or raw[at] != 0xFF or raw[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = raw[at + 1], raw[at + 2], raw[at + 3]
    version, layer, rate, rates = b1 >> 3 & 3, b1 >> 1 & 3, b2 >> 2 & 3, b2 >> 4
    if version == 1 or layer != 1 or rate == 3 or rates in (0, 15) or b3 & 3 == 2:
        return None
    hertz, mono = RATES[version][rate], b3 >> 6 == 3
    samples = SAMPLES[version]
    size = samples // 8 * BITRATES[1 if version == 3 else 2][rates] * 1000 // hertz + (b2 >> 1 & 1)
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return Frame(at, size, hertz, samples, not b1 & 1, side, bytes(raw[at : at + 4]))


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    """The checksum of the last two header bytes and the side information."""
    c = start
    for b in data:
        c = (c << 8 ^ _CRC[c >> 8 ^ b]) & 0xFFFF
    return c


@dataclass
class Audio:
    payload: bytes
    frames: int
    samples: int
    rate: int
    tags: dict[str, str]
    table: dict[str, object]
    bad_checksums: int
    resyncs: int
    skipped: int
    offsets: list[int] = field(repr=False)

    @property
    def duration(self) -> Fraction:
        """Seconds, exact."""
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(fields: dict[str, str]) -> bytes:
    body = b""
    for name, value in fields.items():
        text = b"\3" + name.encode() + b"\0" + value.encode()
        body += b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + _syncsafe(len(body)) + body


def _read_tag(raw: bytes) -> tuple[dict[str, str], int]:
    """Text fields of an ID3v2 tag at the start (of TXXX fields by their description) and where audio starts."""
    if raw[:3] != b"ID3" or len(raw) < 10:
        return {}, 0
    size = lambda b: (b[0] & 0x7F) << 21 | (b[1] & 0x7F) << 14 | (b[2] & 0x7F) << 7 | b[3] & 0x7F
    end, at, out = min(len(raw), 10 + size(raw[6:10])), 10, {}
    while at + 10 <= end and raw[at : at + 4].isalnum():
        n = size(raw[at + 4 : at + 8]) if raw[3] >= 4 else int.from_bytes(raw[at + 4 : at + 8], "big")
        value = raw[at + 10 : min(end, at + 10 + n)]
        name = raw[at : at + 4].decode("latin-1")
        if name.startswith("T") and value:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            text = value[1:].decode(codec, "replace")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            out[name] = text.rstrip("\0")
        at += 10 + n
    return out, end


def _read_table(body: bytes) -> dict[str, object] | None:
    """A Xing or Info table at the place of a frame's main data."""
    if body[:4] not in (b"Xing", b"Info") or len(body) < 8:
        return None
    flags, at, out = int.from_bytes(body[4:8], "big"), 8, {"kind": body[:4].decode()}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit and at + 4 <= len(body):
            out[name] = int.from_bytes(body[at : at + 4], "big")
            at += 4
    if flags & 4 and at + 100 <= len(body):
        out["seek"] = list(body[at : at + 100])
        at += 100
    if flags & 8 and at + 4 <= len(body):
        out["quality"] = int.from_bytes(body[at : at + 4], "big")
    return out


def _read_fixed_table(frame: bytes) -> dict[str, object] | None:
    """The other table in use, VBRI, which lies 32 bytes after the frame's header whatever the side information: version, delay and
    quality, sizes, and the bytes of so many frames each, in entries of 1 to 4 bytes and a common scale."""
    if frame[36:40] != b"VBRI" or len(frame) < 62:
        return None
    version, delay, quality, size, frames, entries, scale, width, per = struct.unpack_from(">HHHIIHHHH", frame, 40)
    if not 1 <= width <= 4:
        return None
    cells = frame[62 : 62 + entries * width]
    steps = [int.from_bytes(cells[i : i + width], "big") * scale for i in range(0, len(cells) - width + 1, width)]
    return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "version": version, "delay": delay, "frames_per_entry": per, "entries": steps}


def demux(raw: bytes) -> Audio:
    """Everything a stream holds; see the module's text. A header counts only if the next frame (or the end) follows
    where it says, or, as long as frames follow each other, if its checksum is right. The variable-bitrate frame is not audio and counts in no figure but ``table``."""
    tags, at = _read_tag(raw)
    table: dict[str, object] = {}
    data, offsets, bad, resyncs, skipped, rate, samples = [], [], 0, 0, 0, 0, 0
    lost, sums = False, {}

    def sound(f: Frame) -> bool:
        covered = raw[f.offset + 2 : f.offset + 4] + raw[f.offset + 6 : f.offset + f.data]
        if covered not in sums:
            if len(sums) > 4096:
                sums.clear()
            sums[covered] = crc16(covered)
        return sums[covered] == int.from_bytes(raw[f.offset + 4 : f.offset + 6], "big")

    while at + 4 <= len(raw):
        f = header(raw, at)
        if f and f.size < f.data:
            f = None
        if f and at + f.size != len(raw) and header(raw, at + f.size) is None and (lost or not (f.protected and sound(f))):
            f = None
        if f is None or at + f.size > len(raw):
            resyncs += not lost
            lost = True
            nxt = raw.find(b"\xff", at + 1)
            nxt = len(raw) if nxt < 0 else nxt
            skipped += nxt - at
            at = nxt
            continue
        lost = False
        main = at + f.data
        if f.protected:
            bad += not sound(f)
        body = raw[main : at + f.size]
        found = (_read_table(body) or _read_fixed_table(raw[at : at + f.size])) if not offsets and not table else None
        if found:
            table = found
        else:
            data.append(body)
            offsets.append(at)
            samples += f.samples
            rate = rate or f.rate
        at += f.size
    payload = b"".join(data)
    if "payload_bytes" in tags and tags["payload_bytes"].isdigit():
        payload = payload[: int(tags["payload_bytes"])]
    return Audio(payload, len(offsets), samples, rate, tags, table, bad, resyncs, skipped + len(raw) - at, offsets)


def _frame_start(index: int) -> bytes:
    """Header, checksum and empty side information of a mono frame of 48 kHz."""
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


_STARTS = {i: _frame_start(i) for i in range(1, 15)}
_SIZES = {i: 144 * BITRATES[1][i] * 1000 // 48000 for i in range(1, 15)}


def mux(payload: bytes, rates: tuple[int, ...] = (14,), kind: str = "Xing") -> bytes:
    """``payload`` in frames of 320 kbit/s (or of the bitrates at ``rates`` in turn) and a last one of the least bitrate that
    holds the rest, behind a table of either ``kind``."""
    overhead = len(_STARTS[14])
    frames, at = [], 0
    while at < len(payload):
        index = rates[len(frames) % len(rates)]
        if len(payload) - at <= _SIZES[index] - overhead:
            index = next(i for i in range(1, 15) if _SIZES[i] - overhead >= len(payload) - at)
        room = _SIZES[index] - overhead
        frames.append((_STARTS[index] + payload[at : at + room]).ljust(_SIZES[index], b"\0"))
        at += room
    audio, n = b"".join(frames), len(frames)
    if kind == "VBRI":
        per = max(1, -(-n // 100))
        steps = [sum(map(len, frames[i : i + per])) for i in range(0, n, per)]
        info = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, len(audio), n, len(steps), 1, 4, per) + b"".join(struct.pack(">I", v) for v in steps)
        lead = 36 - len(_STARTS[1])
        info = bytes(lead) + info
    else:
        seek = bytes(min(255, 256 * i // 100) for i in range(100)) if n > 1 else bytes(100)
        if n > 1 and len(rates) > 1:
            starts = [0]
            for f in frames:
                starts.append(starts[-1] + len(f))
            seek = bytes(min(255, 256 * starts[i * n // 100] // len(audio)) for i in range(100))
        info = b"Xing" + struct.pack(">III", 7, n, len(audio)) + seek
    index = next(i for i in range(1, 15) if _SIZES[i] - overhead >= len(info))
    first = (_STARTS[index] + info).ljust(_SIZES[index], b"\0")
    return _tag({"payload_bytes": str(len(payload))}) + first + audio


def padded(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """UTF-8 of a text with zeros up to a positive multiple of ``unit``, and its length without them."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b"\0"), len(raw)


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media (binary): every text's padded bytes as an MPEG audio stream."""

    def work(batches):
        for b in arrow_rows(batches):
            yield pa.record_batch([b.column(0), pa.array([mux(padded(t.as_py())[0]) for t in b.column(1)], pa.binary())], ["doc_id", "media"])

    return documents(df, id_col=id_col, text_col=text_col).mapInArrow(work, "doc_id long, media binary")


READ = "doc_id long, payload binary, n_frames long, n_samples long, sample_rate int, duration_ms double, tags map<string,string>, table_frames long, bad_checksums int, resyncs int, skipped_bytes long, frame_offsets array<long>"


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What demux() finds in each stream; a null stream is an empty one."""

    def work(batches):
        for b in arrow_rows(batches):
            found = [demux(m.as_py() or b"") for m in b.column(1)]
            col = lambda f, kind: pa.array([f(a) for a in found], kind)
            yield pa.record_batch(
                [
                    b.column(0), col(lambda a: a.payload, pa.binary()), col(lambda a: a.frames, pa.int64()), col(lambda a: a.samples, pa.int64()), col(lambda a: a.rate, pa.int32()),
                    col(lambda a: float(a.duration * 1000), pa.float64()), col(lambda a: list(a.tags.items()), pa.map_(pa.string(), pa.string())), col(lambda a: a.table.get("frames"), pa.int64()),
                    col(lambda a: a.bad_checksums, pa.int32()), col(lambda a: a.resyncs, pa.int32()), col(lambda a: a.skipped, pa.int64()), col(lambda a: a.offsets, pa.list_(pa.int64())),
                ],
                ["doc_id", "payload", "n_frames", "n_samples", "sample_rate", "duration_ms", "tags", "table_frames", "bad_checksums", "resyncs", "skipped_bytes", "frame_offsets"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(work, READ)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text (null: empty) as a stream, reads the stored bytes back, and returns digests of both with
    a feature string: frames, exact duration in samples, rate, checksum failures, resynchronisations and a checksum of
    the frames' seek offsets. Equal texts give equal values; repeated rows and null doc_ids stay as they are; an empty
    table gives an empty table."""

    def work(batches):
        for b in arrow_rows(batches):
            out = []
            for t in b.column(1):
                payload, n = padded(t.as_py())
                media = mux(payload)
                a = demux(media)
                seek = zlib.crc32(struct.pack(f"<{len(a.offsets)}Q", *a.offsets))
                feature = f"frames={a.frames};samples={a.samples};rate={a.rate};table_frames={a.table['frames']};bad_crc={a.bad_checksums};resyncs={a.resyncs};seek_crc32={seek}"
                out.append((n, len(a.payload), hashlib.sha256(a.payload).hexdigest(), zlib.crc32(a.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return documents(df, id_col=id_col, text_col=text_col).mapInArrow(work, DIGESTS)
