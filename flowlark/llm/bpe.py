"""Operator 1: byte-level BPE encoding and decoding by per-prefix dynamic programming.

Every prefix of a piece of text has one BPE encoding, so it has one last token. An automaton over the vocabulary gives
all tokens that are suffixes of a prefix; of these just one is compatible with the last token of the prefix before it
(a pair is compatible if the merges, undone step by step on both sides of the seam, never offer an earlier merge
across it). The last tokens are stored as back-pointers and followed from the end of the piece.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from flowlark.llm.common import arrow_rows, documents

# The white space of Unicode, and the published pattern that splits text before the merges.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A blank before white space or the end can't start a chunk, for then it belongs to a longer run.
_RUN = re.compile(rf" (?=[{SPACE}]|\Z)")
_CHUNK = re.compile(rf" (?=[^{SPACE}])")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stays, other bytes follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


class _Chunks(dict):
    """Chunk of text -> its ids as little-endian 32-bit integers, for a chunk that follows a blank.

    Two generations of ``limit`` entries each: what was not asked for during one of them is forgotten.
    """

    def __init__(self, codec: Codec, limit: int) -> None:
        super().__init__()
        self.codec, self.limit, self.older = codec, limit, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._compute(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def _compute(self, chunk: str) -> bytes:
        encode = self.codec.piece_bytes
        if chunk.isalpha():
            return encode(" " + chunk)
        if chunk[:-1].isalpha() and chunk[-1] in ".,":
            return self[chunk[:-1]] + encode(chunk[-1])
        return b"".join([encode(p) for p in PIECES.findall(" " + chunk)])


class Codec:
    """Encodes and decodes with one byte-level BPE vocabulary (the JSON form of the tokenizers library).

    ``remember`` bounds the number of chunks of text whose ids are kept for reuse (twice that at most).
    """

    def __init__(self, vocabulary: bytes, remember: int = 400_000) -> None:
        spec = json.loads(vocabulary)
        to_byte = byte_alphabet()
        raw = {t: bytes(to_byte[c] for c in t) for t in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {ids[t]: b for t, b in raw.items()} | {i: t.encode() for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: rank of the merge of two tokens; of each token the rank at which it is made and the two it is made of
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
        self.made = dict.fromkeys(ids.values(), -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            whole = ids[a + b]
            if whole not in self.halves:
                self.made[whole], self.halves[whole] = r, (ids[a], ids[b])
        self._build_automaton({b: ids[t] for t, b in raw.items()})
        self._fits: dict[int, bool] = {}
        self.chunks = _Chunks(self, remember)

    def _build_automaton(self, tokens: dict[bytes, int]) -> None:
        """States are the prefixes of tokens; ``step`` holds the moves state << 8 | byte -> state, those through
        suffix links included once they have been taken; ``suffixes`` the tokens that end in a state, longest first."""
        state_of = {p: i for i, p in enumerate(dict.fromkeys(t[:n] for t in tokens for n in range(len(t) + 1)))}
        self.step = {state_of[p[:-1]] << 8 | p[-1]: i for p, i in state_of.items() if p}
        self.link = [0] * len(state_of)
        self.suffixes: list[tuple[tuple[int, int], ...]] = [()] * len(state_of)
        for p, i in sorted(state_of.items(), key=lambda x: len(x[0])):
            if len(p) > 1:
                self.link[i] = self._move(self.link[state_of[p[:-1]]], p[-1])
            own = ((tokens[p], len(p)),) if p in tokens else ()
            self.suffixes[i] = own + (self.suffixes[self.link[i]] if p else ())

    def _move(self, state: int, byte: int) -> int:
        """Where ``byte`` leads from a state: the longest prefix of a token that is a suffix of what was read."""
        key, back = state << 8 | byte, state
        while (to := self.step.get(back << 8 | byte)) is None:
            if not back:
                to = 0
                break
            back = self.link[back]
        if back != state:
            self.step[key] = to
        return to

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side.

        The merges that made both are undone from the latest on. As long as parts x and y touch at the seam, their
        merge would come first if its rank is below that of the merge which takes x away to the left, and not above
        that of the merge which takes y away to the right (of equal ranks the left one goes first).
        """
        x, y = left, right
        x_gone = y_gone = len(self.rank)
        rank, made, halves = self.rank, self.made, self.halves
        while True:
            r = rank.get((x, y))
            if r is not None and r < x_gone and r <= y_gone:
                return False
            at_x, at_y = made[x], made[y]
            if at_x < 0 and at_y < 0:
                return True
            if at_x > at_y:
                x_gone, x = at_x, halves[x][1]
            else:
                y_gone, y = at_y, halves[y][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of bytes that no split divides."""
        last, size = [-1], [0]
        fits, step, suffixes = self._fits, self.step, self.suffixes
        state = 0
        for end, byte in enumerate(piece, 1):
            to = step.get(state << 8 | byte)
            state = self._move(state, byte) if to is None else to
            for token, n in suffixes[state]:
                if n == end:
                    break
                before = last[end - n]
                key = before << 24 | token
                good = fits.get(key)
                if good is None:
                    if len(fits) > 2_000_000:
                        fits.clear()
                    good = fits[key] = self.compatible(before, token)
                if good:
                    break
            else:
                raise ValueError("the vocabulary has no token for some byte")
            last.append(token)
            size.append(n)
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def piece_bytes(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        chunks = _CHUNK.split(text) if _RUN.search(text) else text.split(" ")
        first = b"".join([self.piece_bytes(p) for p in PIECES.findall(chunks[0])])
        return first + b"".join(map(self.chunks.__getitem__, chunks[1:]))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers; none for null. Added tokens in the text get their own ids."""
        if not text:
            return np.zeros(0, "<u4")
        if self._special is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self._special.split(text)
        return np.frombuffer(
            b"".join(
                np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) if p else b""
                for i, p in enumerate(parts)
            ),
            "<u4",
        )

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Codec] = {}


def codec(vocabulary: bytes) -> Codec:
    """One Codec for each vocabulary in a worker process."""
    name = hashlib.sha256(vocabulary).hexdigest()
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Codec(vocabulary)
    return _loaded[name]


def share(spark: SparkSession, vocabulary: str):
    """The vocabulary file (a few MB whatever the corpus) as a broadcast of its bytes."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; null and empty texts have no ids. Repeated rows stay repeated."""
    shared = share(df.sparkSession, vocabulary)

    def work(batches):
        c = codec(shared.value)
        for b in arrow_rows(batches):
            ids = [c.encode(t.as_py()).astype(np.int32) for t in b.column(1)]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return _mapped(documents(df, id_col=id_col, text_col=text_col), work, "doc_id long, ids array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text, unknown ids an error."""
    shared = share(df.sparkSession, vocabulary)

    def work(batches):
        c = codec(shared.value)
        for b in arrow_rows(batches):
            yield pa.record_batch(
                [b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"]
            )

    return _mapped(df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids"), work, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids again and returns digests of both, one row for each row of ``df``.

    Null texts count as empty: no tokens, and the digests of nothing. Repeated rows and null doc_ids are kept as they
    are; an empty table gives an empty table. Nothing is shuffled.
    """
    shared = share(df.sparkSession, vocabulary)

    def work(batches):
        c = codec(shared.value)
        sha, decimal = hashlib.sha256, c.decimal
        for b in arrow_rows(batches):
            counts, of_ids, of_text = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py()).tolist()
                counts.append(len(ids))
                of_ids.append(sha(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                of_text.append(sha(c.decode(ids).encode()).hexdigest())
            yield pa.record_batch(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _mapped(documents(df, id_col=id_col, text_col=text_col), work, DIGESTS)
