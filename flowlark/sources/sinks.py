"""JSON files of alerts, provenance and reports."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession


def write_alerts(records: DataFrame, path: str) -> None:
    """Explained alerts (rows of Detector.explain()) as JSON lines, written by the tasks that hold them."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report(tables: dict[str, DataFrame], about: dict | None = None) -> dict:
    """A report of small aggregates (confusion, recall by family, severity and the like; never of rows of the input): each table's rows as a list of records, under its name, and what ``about`` says.
    Numbers that JSON does not know (not a number, infinite) become null."""
    plain = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    rows = {name: [{k: plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()] for name, df in tables.items()}
    return {"about": about or {}} | rows


def write_report(spark: SparkSession, content: dict, path: str) -> None:
    """One JSON document, in whatever store Spark writes to."""
    text = json.dumps(content, indent=1, default=str, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
