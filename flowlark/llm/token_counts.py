"""Operator 12: token counts through a cache of digests.

A text's digest is the SHA-256 of its normalised content; a tokenizer's version is the SHA-256 of its file. Counts are
stored by both. One narrow pass gives each document its digest; the distinct digests are joined to the stored counts, one
text of each digest that misses is encoded, and its count is appended to the cache; the documents then take their counts by
digest. Copies are encoded once, and a later run over the same or a grown table encodes only what is new.

The text of a miss is that of the smallest doc_id among its copies, found by joining digest and doc_id, so no task gets more
of a large group of copies than of other texts. Texts are shuffled packed.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.llm.common import append, arrow_rows, cut, documents, exists, free, scratch

#: Words whose counts a task remembers, and the longest that it does.
_REMEMBERED, _LONGEST = 400_000, 64
#: Rows that a task remembers to know those repeated whole; beyond that it forgets them all, and such a row is shuffled again.
_KNOWN = 1_000_000


class Counter:
    """Counts of one tokenizer's ids: a ``.json`` file of the tokenizers library or a sentencepiece ``.model``.

    Special strings inside texts are handled as the library's default; no special tokens are added, nothing is truncated.
    If the file drops white space and lower-cases, ``normal`` maps texts that differ only so to the same bytes, and words
    between blanks are counted by themselves: no token, composition of code points or special string reaches over a blank.
    """

    def __init__(self, name: str, content: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.by_word = False
        self.counts: dict[bytes, int] = {}
        if name.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encoded = lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
            return
        import tokenizers

        library = tokenizers.Tokenizer.from_str(content.decode())
        library.no_truncation()
        library.no_padding()
        self.encoded = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        told = json.loads(content)
        self.by_word = _drops_blanks(told)
        self.model = library.model
        self.marks = dict(zip(b".,;:!?", self.encoded(list(".,;:!?")), strict=True))
        self.specials = [t["content"].encode() for t in told["added_tokens"]]

    def normal(self, raw: bytes) -> bytes:
        """Equal for texts of equal counts only. Letters A-Z are lowered unless the text might hold a special string, or
        combining marks (lead bytes cc and cd), which compose with some capitals otherwise than with their small letters."""
        if not self.by_word:
            return raw
        folded = b" ".join(raw.split())
        lower = folded.lower()
        if any(s.lower() in lower for s in self.specials) or b"\xcc" in raw or b"\xcd" in raw:
            return folded
        return lower

    def count(self, raw: bytes) -> int:
        if not self.by_word:
            return self.encoded([raw.decode("utf-8", "replace")])[0]
        words, counts = raw.split(), self.counts
        if len(counts) > _REMEMBERED:
            counts.clear()
        new = [w for w in set(words) if w not in counts]
        rest = []
        for w in new:
            # a word of plain letters, with a mark behind it or not, is one piece or two; the rest is for the whole library
            mark = self.marks.get(w[-1], 0)
            if (piece := _piece(w[:-1] if mark else w)) is None:
                rest.append(w)
            else:
                counts[w] = len(self.model.tokenize(piece)) + mark
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            counts.update(zip(some, self.encoded([w.decode("utf-8", "replace") for w in some]), strict=True))
        total = sum(map(counts.__getitem__, words))
        for w in new:
            if len(w) > _LONGEST:
                del counts[w]
        return total


#: Characters that stand for bytes in the vocabulary: a printable byte for itself, the others from 256 on in their order.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SHOWN = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _piece(word: bytes) -> str | None:
    """What the vocabulary's merges are given for a word of Latin letters, composed ones among them; None for any other word."""
    if word.isalpha():  # A-Z and a-z only, for bytes
        return word.lower().decode()
    try:
        text = word.decode()
    except UnicodeDecodeError:
        return None
    if not text.isalpha() or max(text) > "\u017e" or "\u0130" in text:
        return None
    return text.lower().encode().decode("latin-1").translate(_SHOWN)


def _drops_blanks(told: dict) -> bool:
    """Whether a tokenizer's file is known to lower-case, and to let no piece hold a blank: its normalisers are NFC, blanks to one
    space and lower case, and it keeps only matches of a pattern of letters, digits and what is neither those nor blank."""
    norm, split = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    kinds = [n["type"] for n in norm.get("normalizers", [])]
    first = (split.get("pretokenizers") or [{}])[0]
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and first["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in told["added_tokens"])
    )


def _with_content(tokenizer: str) -> tuple[str, bytes, str]:
    with open(tokenizer, "rb") as f:
        content = f.read()
    return os.path.basename(tokenizer), content, hashlib.sha256(os.path.basename(tokenizer).encode() + b"\0" + content).hexdigest()


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 2048, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row for each row of ``df``.

    ``cache`` is a folder in storage that all machines share; counts are kept there by tokenizer version and digest, and
    runs may share it, also at once: a digest appended twice is read once. Without it the run has a cache of its own, empty at
    first. Null texts count as empty: no bytes, no tokens. Null and repeated doc_ids and repeated rows each keep a row;
    extra columns are ignored; an empty table gives an empty table and appends nothing.
    """
    spark = df.sparkSession
    name, content, version = _with_content(tokenizer)
    file = spark.sparkContext.broadcast(content)  # the tokenizer's file, of a size that its vocabulary sets
    own = f"{cache or scratch(spark, 'token-counts')}/{version}"
    docs = documents(df, id_col=id_col, text_col=text_col)

    def digests(batches) -> Iterator[pa.RecordBatch]:
        counter = Counter(name, file.value)
        for b in arrow_rows(batches):
            sizes, found = [], []
            for t in b.column(1):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                sizes.append(len(raw))
                found.append(hashlib.sha256(counter.normal(raw)).digest())
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_bytes", "digest"])

    def packed(batches) -> Iterator[pa.RecordBatch]:
        counter, seen, pack = Counter(name, file.value), set(), zstandard.ZstdCompressor(level=3)
        for b in arrow_rows(batches):
            out: list[tuple] = []
            for d, t in zip(b.column(0), b.column(1), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                digest = hashlib.sha256(counter.normal(raw)).digest()
                if (key := (digest, d.as_py())) not in seen:  # rows repeated whole
                    seen.add(key)
                    out.append((key[1], digest, pack.compress(raw)))
            if len(seen) > _KNOWN:
                seen.clear()
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "digest", "packed"])

    def encode(batches) -> Iterator[pa.RecordBatch]:
        counter, before, unpack = Counter(name, file.value), None, zstandard.ZstdDecompressor()
        for b in arrow_rows(batches):
            ids, counts = [], []
            for digest, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if digest != before:  # rows of a digest lie together
                    ids.append(digest)
                    counts.append(counter.count(unpack.decompress(p.as_buffer().to_pybytes())))
                before = digest
            yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    keyed = cut(docs.mapInArrow(digests, "doc_id long, n_bytes long, digest binary"))
    wanted = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))  # one document stands for all of a digest
    misses = cut(wanted.join(_stored(spark, own), "digest", "left_anti"))
    texts = docs.mapInArrow(packed, "doc_id long, digest binary, packed binary").alias("t").join(
        misses.alias("m"), (F.col("t.digest") == F.col("m.digest")) & F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")), "left_semi"
    )
    if not misses.isEmpty():
        append(texts.select("digest", "packed").sortWithinPartitions("digest").mapInArrow(encode, "digest binary, n_tokens long"), own)
    counts = cut(_stored(spark, own).join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")))
    free(misses)
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = "digest binary, n_tokens long"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
