"""Sessions and the tables that cut a job's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the command line; a cluster's own session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, shared by driver and executors. Only a session on one machine may name none: there a temporary
    folder stands in, and is set for the session. On a cluster that would lose tables, so it is refused."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tables-"))
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back: it is computed once and survives lost executors. What is one already stays as it is."""
    if getattr(df, "_flowlark_table", False):
        return df
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._flowlark_table = True
    return out
