"""The histogram forest against a plain recursive tree, and its votes out of the bag."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlark.operators import forests, histogram
from flowlark.operators.binning import quantiles

K, WIDTH, BINS = 3, 6, 16
WEIGHTS = [0.8, 1.0, 1.7]


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n), np.zeros(n), rng.exponential(size=n).round(1), rng.normal(size=n), rng.integers(0, 100, n)], axis=1)
    y = ((x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int) + (x[:, 3] > 1.2)).astype(int)
    return x, y


@pytest.fixture(scope="module")
def points(spark):
    x, y = made(500)
    return x, y, spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(500)], "id long, x array<double>, y int").repartition(4)


def cart(x, y, times, tree, node, depth, leaf, tried, seed):
    """(node, feature, threshold) by trying every split of every feature tried, from its definition."""
    rows = np.flatnonzero(times)
    out = {}

    def impurity(part):
        w = np.array([times[part][y[part] == k].sum() * WEIGHTS[k] for k in range(K)])
        return w.sum(), 1 - ((w / w.sum()) ** 2).sum() if w.sum() else 0.0, w

    def down(part, node):
        w, g, each = impurity(part)
        best = None
        if node.bit_length() - 1 < depth and (each > 0).sum() > 1 and times[part].sum() >= max(4, 2 * leaf):
            for f in histogram.features_of(tree, node, WIDTH, tried, seed):
                for edge in EDGES[f]:
                    low = part[x[part, f] <= edge]
                    high = part[x[part, f] > edge]
                    (wl, gl, _), (wr, gr, _) = impurity(low), impurity(high)
                    if wl >= leaf and wr >= leaf:
                        loss = (wl * gl + wr * gr) / w
                        if loss < g - 1e-9 and (best is None or loss < best[0] - 1e-10):
                            best = (loss, int(f), float(edge), low, high)
        if best is None:
            out[node] = (-1, 0.0)
            return
        out[node] = best[1:3]
        down(best[3], 2 * node)
        down(best[4], 2 * node + 1)

    down(rows, 1)
    return out


@pytest.mark.parametrize("local", [10_000, 60])
def test_splits_equal_plain_trees(points, local):
    """Whether nodes are split in a pass over all rows or in the task that finishes them, the trees are the same."""
    global EDGES
    x, y, df = points
    nodes = histogram.fit(df, "id", F.col("x"), F.col("y"), WEIGHTS, WIDTH, trees=4, depth=7, bins=BINS, tried=3, seed=5, local=local)
    EDGES = [sorted({float(v) for v in np.quantile(x[:, f], [i / BINS for i in range(1, BINS)])}) for f in range(WIDTH)]
    rows = nodes.collect()
    for t in range(4):
        times = histogram.bag_weights(np.arange(500), t, 5)
        want = cart(x, y, times, t, 1, 7, 2.0, 3, 5)
        got = {r.node: (r.feature, r.threshold) for r in rows if r.tree == t}
        assert {n: f for n, (f, _) in got.items()} == {n: f for n, (f, _) in want.items()}
        assert all(math.isclose(got[n][1], want[n][1], abs_tol=1e-9) for n in want)
        root = next(r for r in rows if r.tree == t and r.node == 1)
        each = np.array([times[y == k].sum() * WEIGHTS[k] for k in range(K)])
        assert root.size == times.sum() and np.allclose(root.value, each / each.sum()) and root.weight == pytest.approx(each.sum())
        assert all(r.gain > 0 for r in rows if r.feature >= 0)


def test_bag_weights_are_poisson_and_repeatable():
    rows = np.concatenate([np.arange(-50_000, 50_000), np.arange(1 << 40, (1 << 40) + 100_000)])
    w = histogram.bag_weights(rows, 3, 9)
    share = np.bincount(w, minlength=6)[:6] / len(w)
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(6)], atol=0.005)
    assert (w == histogram.bag_weights(rows, 3, 9)).all() and abs(np.corrcoef(w, histogram.bag_weights(rows, 4, 9))[0, 1]) < 0.01


def test_votes_out_of_the_bag(points):
    x, y, df = points
    nodes = histogram.fit(df, "id", F.col("x"), F.col("y"), WEIGHTS, WIDTH, trees=5, depth=7, bins=BINS, seed=2)
    f = forests.Forest.of(nodes)
    votes = np.zeros((500, K))
    seen = np.zeros(500, bool)
    for i, row in enumerate(x):
        for t, at in enumerate(f.roots.tolist()):
            if histogram.bag_weights(np.array([i]), t, 2)[0]:
                continue
            while f.feature[at] >= 0:
                at = f.left[at] + int(row[f.feature[at]] > f.threshold[at])
            votes[i] += f.value[at]
            seen[i] = True
    got = histogram.oob_accuracy(df, "id", F.col("x"), F.col("y"), nodes, 2).first()
    right = int((votes.argmax(axis=1) == y)[seen].sum())
    assert (got.n_rows, got.n_voted, got.n_right) == (500, int(seen.sum()), right) and got.accuracy == right / seen.sum() > 0.8


def test_walks_agree(points):
    """Leaves found tree by tree are those found by steps of all trees, at thresholds, infinities and NaN as well."""
    x, _, df = points
    nodes = histogram.fit(df, "id", F.col("x"), F.col("y"), WEIGHTS, WIDTH, trees=6, depth=12, bins=BINS, seed=2)
    f = forests.Forest.of(nodes)
    some = np.concatenate([x, np.full((3, WIDTH), np.nan), np.full((2, WIDTH), np.inf), np.full((2, WIDTH), -np.inf), f.threshold[f.feature >= 0][:20, None] * np.ones(WIDTH)])
    for inclusive in (True, False):
        at, depth = np.broadcast_to(f.roots, (len(some), 6)), 0
        for _, feature, to in f.walk(some, inclusive):
            at, depth = to, depth + (feature >= 0)
        leaf, deep = f.leaves(some, inclusive)
        assert (leaf == at).all() and (deep == depth).all()


@pytest.mark.parametrize("kind", ["plain", "ties", "few"])
def test_quantiles(spark, kind):
    rng = np.random.default_rng(4)
    n = 7 if kind == "few" else 5000
    a = rng.normal(size=n) if kind != "ties" else rng.choice([0.0, 1.0, 2.5], n, p=[0.9, 0.05, 0.05])
    b = [None if i % 3 == 0 else float(v) for i, v in enumerate(rng.integers(-5, 2000, n))]
    df = spark.createDataFrame(list(zip(a.tolist(), b, strict=True)), "a double, b double").repartition(3)
    at = [0.0, 1e-3, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = quantiles(df, [F.col("a"), F.col("b"), F.lit(None)], at)
    there = np.array([v for v in b if v is not None])
    assert np.allclose(got[0], np.quantile(a, at)) and np.allclose(got[1], np.quantile(there, at)) and got[2] == []
    assert quantiles(df.limit(0), [F.col("a")], at) == [[]]


def test_quantile_between_equal_values(spark):
    """It is that value to the bit, so that >= finds the rows that have it."""
    values = [0.1 + 0.2, 0.7, 1.1, 2.0 / 3.0]
    df = spark.createDataFrame([(v,) for v in values for _ in range(113)], "a double")
    for v in values:
        assert set(quantiles(df.filter(F.col("a") == v), [F.col("a")], [i / 64 for i in range(65)])[0]) == {v}


def test_samples_are_exact_for_every_tree(spark):
    """Each tree has the rows with its smallest draws, no fewer and no more, also where the first limit is too low."""
    rng = np.random.default_rng(3)
    ids = rng.permutation(5000).tolist()
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=2)]) for i in ids], "id long, x array<double>").repartition(5)
    for size in (1, 16, 64):
        nodes = forests.fit_isolation(df, F.col("x"), trees=500, sample=size, seed=size, row_id="id")
        roots = nodes.filter("node = 0").collect()
        assert len(roots) == 500 and {r["size"] for r in roots} == {size}
    # a tree's sample by definition: its root splits between the least and greatest of the sampled rows
    x = {r.id: r.x for r in df.collect()}
    nodes = {r.tree: r for r in forests.fit_isolation(df, F.col("x"), trees=20, sample=16, seed=9, row_id="id").filter("node = 0").collect()}
    for t, root in nodes.items():
        drawn = sorted(x, key=lambda i: (int(forests.draws(np.array([i]), t, 9)[0]) >> 1, i))[:16]
        again = forests.isolation_tree(np.array([x[i] for i in drawn]), np.random.default_rng([9, t]), 4)[0]
        assert (root.feature, root.threshold) == (again[1], again[2])
    assert forests.fit_isolation(df.filter("id < 3"), F.col("x"), trees=2, sample=64, row_id="id").filter("node = 0").agg(F.max("size")).first()[0] == 3


def test_novelty_with_ties_nulls_and_nan(spark):
    from flowlark.operators.binning import novelty

    rng = np.random.default_rng(8)
    benign = [*rng.choice([0.1, 0.5, 0.5, 0.9], 3000).tolist(), None, float("nan"), *rng.normal(size=50).tolist()]
    rows = [(i, v, "x") for i, v in enumerate([*rng.choice([0.1, 0.5, 0.7], 4000).tolist(), None, float("nan"), -9.0, 9.0, float("inf"), 0.9])]
    got = novelty(spark.createDataFrame(rows, "id long, score double, note string").repartition(7), spark.createDataFrame([(v,) for v in benign], "score double"))
    assert got.columns == ["id", "score", "note", "novelty"]
    real = np.array([v for v in benign if v is not None and not math.isnan(v)])
    found = {r.id: r for r in got.collect()}
    assert len(found) == len(rows) == got.count()
    for i, v, _ in rows:
        if v is None or math.isnan(v):
            assert found[i].novelty is None
        else:
            assert found[i].novelty == pytest.approx((real <= v).mean())
    with pytest.raises(ValueError):
        novelty(got.drop("novelty"), got.select("score").limit(0))


def test_forest_is_made_without_an_object_for_each_node(spark):
    """The driver holds columns of numbers; before, each node's distribution was a Python object of its own."""
    import tracemalloc

    # a hundred trees: a chain of 200 inner nodes, each with a leaf on its left
    nodes = spark.range(100).withColumnRenamed("id", "t").crossJoin(spark.range(401)).select(
        F.col("t").cast("int").alias("tree"), F.col("id").cast("int").alias("node"), F.expr("if(id % 2 = 0 and id < 400, 1, -1)").alias("feature"), F.lit(0.5).alias("threshold"),
        (F.col("id") + 1).cast("int").alias("left"), (F.col("id") + 2).cast("int").alias("right"), F.lit(3).cast("long").alias("size"), F.array(F.col("id") / 401, 1 - F.col("id") / 401).alias("value"),
    )
    forests.Forest.of(nodes.filter("tree = 0"))  # imports
    tracemalloc.start()
    f = forests.Forest.of(nodes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(f.roots) == 100 and len(f.feature) == nodes.count() == 40_100 and f.depth.max() == 200
    assert peak < 400 * len(f.feature)


def test_open_nodes_are_counted_in_passes(points, monkeypatch):
    """With fewer cells at once there are more passes, each of a bounded number of nodes, and the same trees."""
    _, _, df = points
    grown = lambda: sorted((r.tree, r.node, r.feature, r.threshold, r.size) for r in histogram.fit(df, "id", F.col("x"), F.col("y"), WEIGHTS, WIDTH, trees=4, depth=7, bins=BINS, tried=3, seed=5, local=60).collect())
    want, seen, splits = grown(), [], histogram._splits
    monkeypatch.setattr(histogram, "_DENSE", 3 * 3 * BINS * K)
    monkeypatch.setattr(histogram, "_splits", lambda rows, arrays, open_, *rest: seen.append(len(open_)) or splits(rows, arrays, open_, *rest))
    assert grown() == want
    assert seen[:2] == [3, 1] and max(seen) == 3


def test_small_nodes_are_split_together():
    """Many nodes at once, of which only bins with rows are looked at, are split as each is by all its counts."""
    rng = np.random.default_rng(12)
    p = {"weights": np.array(WEIGHTS), "bins": BINS, "tried": 3, "leaf": 2.0}
    sizes = rng.integers(1, 40, 300)
    n, node = sizes.sum(), np.repeat(np.arange(300), sizes)
    part, label, times = rng.integers(0, BINS, (n, 3)).astype(np.uint8) // rng.integers(1, 9, (300, 1))[node].astype(np.uint8), rng.integers(0, K, n), rng.integers(1, 4, n)
    counts, want = np.zeros((300, K), np.int64), []
    for i in range(300):
        cells = np.zeros((3, BINS, K))
        for f in range(3):
            np.add.at(cells[f], (part[node == i, f], label[node == i]), times[node == i])
        counts[i] = cells[0].sum(axis=0)
        want.append(histogram.best_split(cells, p["weights"], 2.0))
    slot, b = histogram.best_splits(part, label, times, sizes, counts, p)
    assert [None if f < 0 else (f, c) for f, c in zip(slot.tolist(), b.tolist(), strict=True)] == want and None in want and len(set(want)) > 20
