"""Connection records and flow exports from CSV files."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowlark import fixed
from flowlark.functions.columns import category_of, clean_label, finite, found, is_attack
from flowlark.session import table


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A header-less file of 43 columns: numbers that are none become 0, labels lose blanks and final dots, and
    category and is_attack are added. Rows are numbered by flow_id in no order that means anything."""
    text = StructType([StructField(c, StringType()) for c in fixed.COLUMNS])
    raw = spark.read.schema(text).csv(path)
    out = []
    for c in fixed.COLUMNS:
        if c in fixed.CATEGORICAL:
            out.append(F.lower(F.trim(c)).alias(c))
        elif c == "label":
            out.append(clean_label(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(F.nanvl(F.expr(f"try_cast({c} as double)"), F.lit(0.0)), F.lit(0.0)).alias(c))
    rows = raw.select(*out).withColumn("category", category_of(F.col("label")))
    return rows.withColumns({"is_attack": is_attack(F.col("category")), "flow_id": F.monotonically_increasing_id()})


def load_records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """(train, test, provenance) from KDDTrain+.txt and KDDTest+.txt in ``folder``; both must be there."""
    paths = {k: os.path.join(folder, f"KDD{k}+.txt") for k in ("Train", "Test")}
    if absent := [p for p in paths.values() if not _exists(spark, p)]:
        raise FileNotFoundError(f"no such files: {absent}")
    train, test = read_records(spark, paths["Train"]), read_records(spark, paths["Test"])
    about = {"source": "real", "name": "NSL-KDD (KDDTrain+ / KDDTest+)", "note": f"read from {folder}"}
    unmapped = train.select("label", "category").union(test.select("label", "category")).filter("category = 'unknown'")
    about["unmapped_labels"] = sorted(r[0] for r in unmapped.select("label").distinct().collect())
    about["novel_in_test"] = sorted(r["label"] for r in novel_families(train, test).collect())
    return train, test, about


def novel_families(train: DataFrame, test: DataFrame) -> DataFrame:
    """Attack labels of the test rows that no training row has."""
    attacks = lambda d: d.filter("category <> 'normal'").select("label").distinct()
    return attacks(test).join(train.select("label").distinct(), "label", "left_anti")


def category_counts(df: DataFrame) -> DataFrame:
    """category, flows, share; most frequent first."""
    counts = df.groupBy("category").agg(F.count("*").alias("flows"))
    total = counts.agg(F.sum("flows").alias("total"))
    return counts.join(F.broadcast(total)).select("category", "flows", (F.col("flows") / F.col("total")).alias("share")).orderBy(F.desc("flows"), "category")


def family_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category", "label").agg(F.count("*").alias("flows")).orderBy("category", F.desc("flows"), "label")


def clean_names(df: DataFrame) -> DataFrame:
    """Column names with white space collapsed and trimmed, in lower case."""
    return df.toDF(*(" ".join(c.split()).lower() for c in df.columns))


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(f.getPath().toString() for f in found or [])


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place), "UTF-8"))
    try:
        return lines.readLine() or ""
    finally:
        lines.close()


def read_flow_exports(spark: SparkSession, folder: str, max_rows_per_file: int | None = 200_000, seed: int = 0) -> tuple[DataFrame, dict]:
    """(rows, provenance) of all CSV files of a folder with header. Files are put together by column name; a column that
    a file lacks is a gap there. Columns that hold nothing but numbers are doubles, infinities and gaps 0; label,
    category, is_attack and __source_file are added. Of a file the ``max_rows_per_file`` rows with the lowest hashes
    are taken (None: all)."""
    paths = _paths(spark, f"{folder}/*.csv")
    if not paths:
        raise FileNotFoundError(f"no CSV files in {folder}")
    # files of one header are read together, so the plan grows with the headers, not with the files
    of_header: dict[str, list[str]] = {}
    for p in paths:
        of_header.setdefault(_first_line(spark, p), []).append(p)
    parts = []
    for group in of_header.values():
        read = spark.read.option("header", True).csv(group)
        values = clean_names(read).columns
        parts.append(read.select("*", F.col("_metadata.file_name").alias("__source_file")).toDF(*values, "__source_file"))
    named = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "label" not in named.columns:
        raise ValueError(f"no label column; found {named.columns[:8]}")
    named = table(named.withColumn("_row", F.monotonically_increasing_id()))
    values = [c for c in named.columns if c not in ("label", "__source_file", "_row")]
    as_number = lambda c: F.col(f"`{c}`").try_cast("double")
    odd = named.agg(*(F.count_if((F.trim(f"`{c}`") != "") & as_number(c).isNull()).alias(f"c{i}") for i, c in enumerate(values))).first() if values else []
    numeric = [c for c, n in zip(values, odd, strict=True) if not n]
    out = [finite(as_number(c)).alias(c) if c in numeric else F.col(f"`{c}`") for c in values]
    data = named.select(*out, F.lower(F.trim("label")).alias("label"), "__source_file", "_row")
    if max_rows_per_file:
        data = lowest_hashes(data, F.least(F.col("_all"), F.lit(max_rows_per_file)), "__source_file", "_row", seed).filter("_low").drop("_low")
    data = data.withColumn("category", found(fixed.FLOW_CSV_CATEGORY, F.col("label"), "unknown"))
    data = data.withColumns({"is_attack": is_attack(F.col("category"))}).withColumnRenamed("_row", "flow_id")
    about = {"source": "real", "name": "flow exports (CSV)", "note": f"read from {folder}", "numeric_features": numeric}
    unmapped = sorted(r[0] for r in data.filter("category = 'unknown'").select("label").distinct().collect() if r[0])
    return data, about | ({"unmapped_labels": unmapped} if unmapped else {})


def stratified_split(df: DataFrame, test_fraction: float = 0.3, seed: int = 0, row_id: str = "flow_id", stratum: str = "category") -> DataFrame:
    """Adds is_test: in each stratum the rounded share of rows with the lowest hashes."""
    return lowest_hashes(df, F.round(F.col("_all") * test_fraction), stratum, row_id, seed).withColumnRenamed("_low", "is_test")


def lowest_hashes(df: DataFrame, quota: Column, stratum: str, row_id: str, seed: int) -> DataFrame:
    """Adds _low: whether a row is among the ``quota`` (of _all, its stratum's rows) rows of its stratum with the lowest
    hashes of seed and ``row_id``.

    The number is exact: hashes are counted in 4096 ranges first, and only the range in which the cut lies is ordered,
    so no task sees a whole stratum.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(row_id).cast("string"))), 1, 13), 16, 10).cast("long")
    rows = df.withColumns({"_h": h}).withColumn("_r", F.shiftright("_h", 40))
    ranges = rows.groupBy(stratum, "_r").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(stratum).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumns({"_before": F.sum("n").over(upto) - F.col("n"), "_all": F.sum("n").over(Window.partitionBy(stratum))}).withColumn("_quota", quota)
    ranges = ranges.select(F.col(stratum).alias("_stratum"), F.col("_r").alias("_range"), "_before", "_quota", "n")
    rows = rows.join(ranges, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_r") == F.col("_range")))  # rows without a stratum are one
    cut_here = (F.col("_before") < F.col("_quota")) & (F.col("_before") + F.col("n") > F.col("_quota"))
    place = F.row_number().over(Window.partitionBy(stratum, "_r").orderBy("_h", row_id))
    low = F.when(cut_here, F.col("_before") + place <= F.col("_quota")).otherwise(F.col("_before") < F.col("_quota"))
    return rows.withColumn("_low", low).drop("_h", "_r", "_stratum", "_range", "_before", "_quota", "n")
