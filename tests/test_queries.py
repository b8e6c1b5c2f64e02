"""Every traffic query against its SQL, and the driver's contract."""

import pytest
from compare import difference

import __spark_entry__
from flowlark.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir) is None


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_sql_is_registered_for_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_derived_of_more_services_than_a_plan_holds(spark, tmp_path):
    """Each connection has the share of its service, however many there are; a map of 10,000 left the others without."""
    from pyspark.sql import functions as F

    n = 10_040
    rows = spark.range(n + 60).select(
        F.col("id").alias("event_id"), F.timestamp_micros(1_704_067_200_000_000 + F.col("id") * 1_000_000).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.format_string("type%d", F.col("id") % n).alias("event_type"), (F.col("id") % 90).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["q_derived_all"](spark, str(tmp_path))
    held = {tuple(r) for r in got.select((F.col("flow_id") % n < 60).alias("twice"), F.round(F.col("service_freq") * (n + 60)).alias("n")).distinct().collect()}
    assert got.count() == n + 60 and held == {(True, 2.0), (False, 1.0)}
    assert difference(got, ORACLE["q_derived_all"], str(tmp_path)) is None
