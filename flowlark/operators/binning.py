"""Quantile bins, Gini splits and novelty ranks as aggregations and windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.session import table


#: Ranges into which a column's values are counted before the ranges that hold a wanted rank are ordered.
RANGES = 1024


def _thinned(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most RANGES of the values that stand for about as many each, and for how many; value i stands for n[i]."""
    if len(values) <= RANGES:
        return values, n
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(n[order])
    at = np.searchsorted(upto, (np.arange(RANGES) + 0.5) * upto[-1] / RANGES)
    return values[order][at], np.full(RANGES, upto[-1] / RANGES)


def quantiles(df: DataFrame, columns: list[Column], at: list[float]) -> list[list[float]]:
    """For each column its exact quantiles at the shares ``at``, between two values in proportion; none for a column of nulls.

    Selection for all ranks of all columns at once: a mergeable sketch gives points that cut each column in ranges of about
    equal size, one pass counts the ranges exactly (where the cuts are plays no part in the result), and only the values of ranges that hold a wanted rank are ordered, each
    range by itself and equal values as one row. Nulls are left out, NaN is the largest value.
    """
    many = len(columns)
    rows = df.select(F.array(*(c.cast("double") for c in columns)).alias("x"))

    def values(b: pa.RecordBatch) -> np.ndarray:
        x = b.column(0).flatten()
        return x.to_numpy(zero_copy_only=False).reshape(-1, many), x.is_valid().to_numpy(zero_copy_only=False).reshape(-1, many)

    def sketch(batches) -> Iterator[pa.RecordBatch]:
        held = [[] for _ in range(many)]  # of each column points and what each stands for
        for b in batches:
            x, there = values(b)
            for i, points in enumerate(held):
                v = np.sort(x[there[:, i], i])
                if len(v):
                    points.append(_thinned(v, np.ones(len(v))))
                if len(points) == 32:
                    points[:] = [_thinned(*map(np.concatenate, zip(*points)))]
        for i, points in enumerate(held):
            if points:
                v, n = _thinned(*map(np.concatenate, zip(*points)))
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64())), pa.array([n.tolist()], pa.list_(pa.float64()))], ["column", "points", "n"])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        v, _ = _thinned(np.concatenate(list(pdf["points"])), np.concatenate(list(pdf["n"])))
        return pd.DataFrame({"column": pdf["column"].iloc[:1], "points": [np.unique(v)]})

    cuts = [np.zeros(0) for _ in range(many)]
    for r in rows.mapInArrow(sketch, "column int, points array<double>, n array<double>").groupBy("column").applyInPandas(cut, "column int, points array<double>").collect():  # RANGES points a column
        cuts[r["column"]] = np.array(r["points"], float)

    def count(batches) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(c) + 1, np.int64) for c in cuts]
        for b in batches:
            x, there = values(b)
            for i, c in enumerate(cuts):
                sums[i] += np.bincount(np.searchsorted(c, x[there[:, i], i], side="left"), minlength=len(c) + 1)
        column = np.repeat(np.arange(many), [len(s) for s in sums])
        place = np.concatenate([np.arange(len(s)) for s in sums])
        yield pa.record_batch([pa.array(column, pa.int32()), pa.array(place, pa.int32()), pa.array(np.concatenate(sums), pa.int64())], ["column", "place", "n"])

    sizes = [np.zeros(len(c) + 1, np.int64) for c in cuts]
    for r in rows.mapInArrow(count, "column int, place int, n long").groupBy("column", "place").agg(F.sum("n").alias("n")).collect():  # RANGES rows a column
        sizes[r["column"]][r["place"]] = r["n"]
    wanted, ways = [], []  # (column, range, rank in it); and for each column (position, lower rank, higher rank)
    for i, size in enumerate(sizes):
        upto = np.cumsum(size)
        n = int(upto[-1])
        ways.append([(q * (n - 1), math.floor(q * (n - 1)), math.ceil(q * (n - 1))) for q in at] if n else [])
        for rank in sorted({r for _, low, high in ways[i] for r in (low, high)}):
            place = int(np.searchsorted(upto, rank, side="right"))
            wanted.append((i, place, rank - int(upto[place] - size[place]), rank))
    if not wanted:
        return [[] for _ in columns]
    hit = [np.isin(np.arange(len(c) + 1), [p for j, p, _, _ in wanted if j == i]) for i, c in enumerate(cuts)]

    def pick(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, there = values(b)
            for i, c in enumerate(cuts):
                v, n = np.unique(x[there[:, i], i], return_counts=True)
                place = np.searchsorted(c, v, side="left")
                held = hit[i][place]
                if held.any():
                    k = int(held.sum())
                    yield pa.record_batch([pa.array(np.full(k, i), pa.int32()), pa.array(place[held], pa.int32()), pa.array(v[held]), pa.array(n[held], pa.int64())], ["column", "place", "value", "n"])

    picked = rows.mapInArrow(pick, "column int, place int, value double, n long").groupBy("column", "place", "value").agg(F.sum("n").alias("n"))
    placed = picked.withColumn("upto", F.sum("n").over(Window.partitionBy("column", "place").orderBy("value")))
    ranks = F.broadcast(df.sparkSession.createDataFrame(wanted, "column int, place int, inner long, rank long"))  # two a share and column
    found = placed.join(ranks, ["column", "place"]).filter("inner >= upto - n and inner < upto").select("column", "rank", "value").collect()
    value = {(r["column"], r["rank"]): r["value"] for r in found}
    # between equal values lies that value: a weighted sum of the two may be off by a bit, and >= would then miss all of them
    between = lambda i, x, low, high: value[i, low] if value[i, low] == value[i, high] else (high - x) * value[i, low] + (x - low) * value[i, high]
    return [[between(i, *w) for w in ways[i]] for i in range(many)]


def exact_quantiles(df: DataFrame, columns: list[Column], bins: int) -> list[list[float]]:
    """For each column the distinct exact quantiles at i / bins."""
    return [sorted(set(q)) for q in quantiles(df, columns, [i / bins for i in range(1, bins)])]


def bin_edges(df: DataFrame, column: str, bins: int = 64) -> list[float]:
    """Distinct exact quantiles of one column at i / bins."""
    return exact_quantiles(df, [F.col(column)], bins)[0]


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of edges below the value (a value on an edge belongs below it)."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value)) if edges else F.lit(0)


def gini_splits(df: DataFrame, bin_col: str, class_col: str, weight: Column | None = None) -> DataFrame:
    """bin, left_n, right_n, gain: impurity decrease of the split after each bin, from one histogram."""
    w = F.lit(1.0) if weight is None else weight
    cells = df.groupBy(F.col(bin_col).alias("bin"), F.col(class_col).alias("class")).agg(F.sum(w).alias("w"))
    bins = cells.select("bin").distinct()  # at most as many as there are bins
    classes = cells.groupBy("class").agg(F.sum("w").alias("all"))
    grid = F.broadcast(bins).join(F.broadcast(classes)).join(cells, ["bin", "class"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    left = grid.withColumn("l", F.sum("w").over(Window.partitionBy("class").orderBy("bin")))
    right = F.col("all") - F.col("l")
    per = left.groupBy("bin").agg(
        F.sum("l").alias("left_n"), F.sum(right).alias("right_n"), F.sum(F.col("l") ** 2).alias("l2"), F.sum(right**2).alias("r2"), F.sum(F.col("all") ** 2).alias("a2"), F.sum("all").alias("n")
    )
    gini = lambda squares, n: 1.0 - F.try_divide(squares, n * n)
    gain = gini(F.col("a2"), F.col("n")) - (F.col("left_n") * gini(F.col("l2"), F.col("left_n")) + F.col("right_n") * gini(F.col("r2"), F.col("right_n"))) / F.col("n")
    return per.filter("right_n > 0").select("bin", "left_n", "right_n", gain.alias("gain"))


def novelty(scored: DataFrame, benign: DataFrame, score: str = "score", stored: bool = False) -> DataFrame:
    """Adds novelty: the share of benign scores that are at most the row's score. Rows whose score is null or NaN have none, and
    such benign scores are left out.

    Rows and benign scores are range-partitioned together by score, benign before others of the same score, and each partition
    runs its own count; what lies in the partitions before is one number for each of them. Rows are carried along, nothing is
    joined by value, and equal scores, however many, are dealt over partitions by a number of their own. ``scored`` is read more
    than once: it is written first unless it is ``stored`` already.
    """
    real = lambda d: d.filter(F.col(score).isNotNull() & ~F.isnan(score))
    columns = scored.columns
    scored = scored if stored else table(scored)
    both = real(scored).withColumn("_benign", F.lit(0).cast("long")).unionByName(real(benign).select(F.col(score).cast("double").alias(score), F.lit(1).cast("long").alias("_benign")), allowMissingColumns=True)
    order = [F.col(score), F.desc("_benign"), F.col("_number")]
    both = both.withColumn("_number", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    both = table(both.withColumn("_part", F.spark_partition_id()))
    before, plan = 0, []
    for r in both.groupBy("_part").agg(F.sum("_benign").alias("n")).orderBy("_part").collect():  # one row a partition
        plan.append((r["_part"], before))
        before += r["n"]
    if not before:
        raise ValueError("no benign scores")
    shift = F.broadcast(scored.sparkSession.createDataFrame(plan, "_part int, _before long"))
    upto = F.sum("_benign").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = both.withColumn("_rank", upto).filter("_benign = 0").join(shift, "_part")
    ranked = ranked.select(*columns, ((F.col("_before") + F.col("_rank")) / F.lit(float(before))).alias("novelty"))
    return ranked.unionByName(scored.filter(F.col(score).isNull() | F.isnan(score)).withColumn("novelty", F.lit(None).cast("double")))
