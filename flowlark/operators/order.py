"""Global row numbers without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlark.session import table


def with_sequence(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """``df`` with its place (from 0) in the order of the columns ``order``, which should have no ties.

    Rows are range-partitioned and sorted; a row's place is its place in its partition after the rows of the partitions
    before. Only one count for each partition reaches the driver. The sorted rows are a table, for a second pass over
    the plan might draw other range bounds.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = table(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("least")).orderBy("_part").collect()
    before, plan = 0, []
    for r in counts:
        plan.append((r["_part"], before - r["least"]))
        before += r["n"]
    shift = df.sparkSession.createDataFrame(plan, "_part int, _shift long")
    return rows.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
