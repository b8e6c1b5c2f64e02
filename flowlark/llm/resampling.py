"""Operator 11: importance resampling towards a target's distribution of hashed word n-grams.

Corpus and target are counted in buckets of hashed features; the log ratio of the two is a bucket's gain, and a document's
weight is the mean gain of its features. One more pass scores whole texts against the array of gains, plus a Gumbel draw that
depends on doc_id and seed alone, so that the highest scores are a sample without replacement in proportion to the weights.

The k-th highest score is found by radix selection: the key (score falling, doc_id, row) is read as digits, most significant
first; each pass counts the rows of each digit among those that share the k-th row's digits so far. No sort, no collected scores:
a pass brings as many counts to the driver as a digit has values. Only the drawn rows are then range-sorted and ranked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import arrow_rows, cut, documents

#: Bits of a digit; a pass collects at most 2 ** BITS counts.
BITS = 12
#: Lower-case A-Z; whatever of ASCII is neither letter nor digit parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of words that a task remembers, and the longest word for which there is a table.
_REMEMBERED, _LONGEST = 16 << 20, 64


class Features(dict):
    """Bucket numbers of all runs of one and two words, by CRC-32 of their UTF-8 bytes joined by a space. word -> its number.

    The CRC of a pair follows from those of its words: it is linear, so the first word's part is moved on by the length of what
    follows (four lookups for each length, made by rule), and no pair is built as a string unless its second word is very long.
    """

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets
        self.held = 0
        self.alone = np.zeros(1024, np.uint32)  # CRC of the word
        self.after = np.zeros(1024, np.uint32)  # CRC of a space and the word
        self.size = np.zeros(1024, np.int32)  # the length of both, 0 for the very long
        self.moves = np.stack([self._move(n) for n in range(_LONGEST + 2)]).reshape(-1)

    @staticmethod
    def _move(length: int) -> np.ndarray:
        """A table by place and value of a CRC's four bytes that moves it on by ``length`` bytes."""
        zero = b"\0" * length
        nothing = crc32(zero, 0)
        table = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            # crc32(zero, c) xor crc32(zero, 0) is linear in c
            table[bit // 8, np.arange(256) >> bit % 8 & 1 == 1] ^= np.uint32(crc32(zero, 1 << bit) ^ nothing)
        return table

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.alone):
            self.alone, self.after, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.alone, self.after, self.size))
        self.alone[n], self.after[n] = crc32(word), crc32(b" " + word)
        self.size[n] = len(word) + 1 if len(word) <= _LONGEST else 0
        self.held += len(word) + 32
        self[word] = n
        return n

    def of(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the words of all texts, those of the pairs that begin at each of them (the last of a text begins none: -1), and
        the number of words of each text."""
        each = [raw.translate(_FOLD).split() for raw in raws]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        words = list(chain.from_iterable(each))
        if self.held > _REMEMBERED:
            self.clear()
            self.held = 0
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        one = self.alone.take(ids)
        two = np.full(len(words), -1, np.int64)
        if len(words) > 1:
            first, size = one[:-1], self.size.take(ids[1:])
            pair, at = self.after.take(ids[1:]), size << 10
            for part in range(4):
                pair ^= self.moves.take(at + (first >> np.uint32(8 * part) & np.uint32(255)).astype(np.int32) + 256 * part)
            for i in np.flatnonzero(size == 0).tolist():
                pair[i] = crc32(b" " + words[i + 1], int(first[i]))
            two[:-1] = pair % np.uint32(self.buckets)
            ends = np.cumsum(sizes)[sizes > 0] - 1
            two[ends] = -1
        return (one % np.uint32(self.buckets)).astype(np.int64), two, sizes


def _raws(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts (the one column of ``texts``) fall in each bucket."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        features, sums = Features(buckets), np.zeros(buckets, np.int64)
        for b in arrow_rows(batches):
            one, two, _ = features.of(_raws(b.column(0)))
            sums += np.bincount(one, minlength=buckets) + np.bincount(two[two >= 0], minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(held, pa.int64()), pa.array(sums[held], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares of target and corpus), for each bucket."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = lambda a, b: ((b + 1.0) * (s + n)) / ((a + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(ratio(float(a), float(b)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def draw_of(doc_id: int | None, seed: int) -> int:
    """A Gumbel variate in thousandths; a null doc_id counts as the empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def work(batches) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        features = Features(len(gain))
        for b in arrow_rows(batches):
            one, two, words = features.of(_raws(b.column(1)))
            upto = np.concatenate([[0], np.cumsum(gain[one] + np.where(two >= 0, gain[two], 0))])
            ends = np.cumsum(words)
            total, n = upto[ends] - upto[ends - words], np.maximum(2 * words - 1, 0)
            weight = total // np.maximum(n, 1)
            ids = b.column(0).to_pylist()
            score = weight + np.array([draw_of(d, seed) for d in ids], np.int64)
            yield pa.record_batch([b.column(0), *(pa.array(x, pa.int64()) for x in (words, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long, score long")


def kth_key(rows: DataFrame, keys: list[str], k: int, bits: int = BITS) -> list[int] | None:
    """The k-th smallest (from 1) of the keys, whose columns are longs without nulls; None if there are fewer rows.

    Each column is read as a 64-bit number of unsigned order. A pass takes one digit; leading digits that the column's
    least and greatest value share are passed over. It ends early once the rows left are one.
    """
    found: list[int] = []
    left, within, n = k, rows, 0
    for i, key in enumerate(keys):
        bounds = within.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
        lo, hi, n = bounds["lo"], bounds["hi"], bounds["n"]
        if n < left:
            return None
        if n == 1:
            return found + _only(within, keys[i:])
        if hi - lo < 1 << 63:
            offset = F.col(key) - F.lit(lo)
        else:
            lo, offset = -(1 << 63), F.col(key).bitwiseXOR(F.lit(-(1 << 63)))  # 64 bits, read without a sign
        at = lo
        for d in range(-(-(hi - lo).bit_length() // bits) - 1, -1, -1):
            digit = F.shiftrightunsigned(offset, d * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
            for value, n in sorted(tuple(r) for r in within.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()):
                if left <= n:
                    break
                left -= n
            within = within.filter(digit == value)
            at += value << (d * bits)
            if n == 1:
                return found + _only(within, keys[i:])
        found.append(at)
    return found


def _only(within: DataFrame, keys: list[str]) -> list[int]:
    row = within.select(*keys).first()
    return [row[k] for k in keys]


def up_to(keys: list[str], last: list[int]) -> Column:
    """Whether a row's keys are not beyond ``last``."""
    out = F.lit(True)
    for key, value in reversed(list(zip(keys, last, strict=True))):
        out = (F.col(key) < value) | ((F.col(key) == value) & out)
    return out


def resample(
    df: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank, one row for each row of ``df``; rank is null for rows not drawn.

    Of the N documents with ``least_words`` words or more, floor(percent * N / 100) are drawn by highest score, ties to the
    smaller doc_id; a null doc_id comes first, and rows that share doc_id and score are drawn in any order, each with a
    rank of its own. Null and empty texts have no features and weigh 0. Extra columns are ignored. An empty target counts no
    features; an empty table gives an empty table.
    """
    docs = documents(df, id_col=id_col, text_col=text_col)
    gains = gains_of(bucket_counts(docs.select("text"), buckets), bucket_counts(target.select(F.col(target_col).alias("text")), buckets))
    # sorted as longs: the score turned round, null ids before all others, and a number for rows alike in both
    rows = cut(
        scored(docs, gains, seed).withColumns({
            "_score": -F.col("score"), "_none": F.col("doc_id").isNotNull().cast("long"), "_id": F.coalesce("doc_id", F.lit(0)), "_row": F.monotonically_increasing_id(),
        })
    )
    keys = ["_score", "_none", "_id", "_row"]
    fit = rows.filter(F.col("n_words") >= least_words)
    k = percent * fit.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if k == 0:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & up_to(keys, kth_key(fit, keys, k))
    return ranked(rows.filter(drawn), keys).select(*out, "rank").unionByName(rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rank`` from 1 in the order of the keys: range partitions, each sorted by itself, after the rows of those before."""
    parts = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("least")).orderBy("_part").collect()  # one row a partition
    before, plan = 0, []
    for r in counts:
        plan.append((r["_part"], before - r["least"] + 1))
        before += r["n"]
    shift = rows.sparkSession.createDataFrame(plan, "_part int, _shift long")
    return parts.join(F.broadcast(shift), "_part").withColumn("rank", F.col("_at") + F.col("_shift"))
