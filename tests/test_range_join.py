"""The prior count of every connection against all pairs."""

import random

from flowlark.plans.queries import QUERIES, conn, prior_counts

WINDOW = 3_600_000_000


def brute(rows):
    def prior(i, d, t):
        return sum(e == d and t - WINDOW <= u and (u, j) < (t, i) for j, e, u in rows if e is not None and u is not None)

    return sorted((i, 0 if d is None or t is None else prior(i, d, t)) for i, d, t in rows)


def test_every_connection_has_its_prior_count(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b"]), rng.randrange(-40, 400) * WINDOW // 10 + rng.choice((0, 0, 1))) for i in range(1500)]
    rows += [(2000, None, 5), (2001, None, 6), (2002, "hot", None), (2003, "hot", 0), (2004, "hot", WINDOW), (2005, "hot", WINDOW + 1)]
    df = spark.createDataFrame(rows, "flow_id long, dst string, start_us long")
    for spans in (1, 16):
        assert sorted(map(tuple, prior_counts(df, spans=spans).collect())) == brute(rows)


def test_range_join_of_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in conn(spark, sf_dir).select("flow_id", "dst", "start_us").collect()]
    assert sorted(map(tuple, QUERIES["q_range_join_all"](spark, sf_dir).collect())) == brute(rows)
