"""Helpers shared by the corpus operators: lineage cuts, document frames and word fingerprints."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.session import shared_folder

#: With this set, a query's shuffle files go when the query ends; the table that it wrote is all that is read later.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's file system closes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    return path


def append(df: DataFrame, path: str) -> None:
    """Adds the rows of ``df`` to the table at ``path``: all of them or, if the job fails, none."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: later reads neither repeat the work nor depend on
    an executor. free() deletes the table; else it goes when the driver's file system closes."""
    spark = df.sparkSession
    path = scratch(spark, "flowlark")
    append(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote, once nothing that reads them is to run any more."""
    for t in tables:
        place, files = _place(t.sparkSession, t.cut_path)
        files.delete(place, True)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def documents(df: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long and text string of ``df``, then the columns named; whatever else it has is left behind, so extra
    columns never clash with those that an operator adds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)


def row_key() -> Column:
    """A key for (doc_id, text): rows that repeat both share it, rows that only repeat doc_id do not."""
    return F.xxhash64("doc_id", "text")


def arrow_rows(batches: Iterable[pa.RecordBatch], bytes_each: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``bytes_each``, so that a run of long texts never piles up in a worker."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, min(batch.num_rows, int(bytes_each * batch.num_rows / max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


class WordHashes(dict):
    """word (bytes) -> eight bytes of its xxh3 fingerprint; at most ``limit`` are remembered."""

    def __init__(self, limit: int = 300_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = xxhash.xxh3_64_digest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u8")


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit of the input moves about half of the output's."""
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A fingerprint for each run of ``width`` words."""
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in range(1, width):
            out = mix(out) + words[k : k + n]
        return mix(out)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
