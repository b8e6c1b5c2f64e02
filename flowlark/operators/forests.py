"""Isolation forest and random forest: fitted as Spark jobs, applied from broadcast node tables.

A node table has one row for each node: tree, node, feature (-1 for a leaf), threshold, left, right, size and, for the
random forest, the class distribution. Its size depends on the model's parameters only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.session import table


def usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 1e-9
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


#: Nodes of a forest that is broadcast; about 100 bytes each.
MOST_NODES = 4_000_000
NODES = "tree int, node int, feature int, threshold double, left int, right int, size long"


def isolation_tree(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree: a random feature among those that vary, a uniform threshold, values below go left."""
    out: list[list] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(out)
        out.append([me, -1, float("nan"), -1, -1, len(rows)])
        if depth < limit and len(rows) > 1:
            low, high = rows.min(axis=0), rows.max(axis=0)
            vary = np.flatnonzero(high > low)
            if len(vary):
                f = int(rng.choice(vary))
                at = float(rng.uniform(low[f], high[f]))
                left = rows[:, f] < at
                out[me][1:3] = f, at
                out[me][3] = grow(rows[left], depth + 1)
                out[me][4] = grow(rows[~left], depth + 1)
        return me

    grow(points, 0)
    return [tuple(n) for n in out]


def draws(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number of 64 bits for each row (64-bit ids) in a tree; the rows with the smallest are the tree's sample."""
    with np.errstate(over="ignore"):
        h = rows.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finaliser of the public SplitMix64
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def fit_isolation(df: DataFrame, vector: Column, trees: int = 150, sample: int = 256, seed: int = 0, row_id: str = "flow_id") -> DataFrame:
    """Node table of an isolation forest. Each tree grows in its own task on exactly ``sample`` rows (all, if there are
    fewer), those with the smallest draws. Draws are counted in ranges first, so what is shuffled is little more than
    trees * sample rows whatever the input."""
    n = df.count()
    size = min(sample, n)
    rows = df.select(F.col(row_id).cast("long").alias("id"), vector.alias("x"))
    limit, ranges = max(1, math.ceil(math.log2(max(size, 2)))), 256
    share = min(1.0, 2.0 * size / max(1, n))
    while True:
        width = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))) // ranges + 1)

        def count(batches, width=width):
            sums = np.zeros((trees, ranges + 1), np.int64)
            for b in batches:
                ids = b.column(0).to_numpy()
                for t in range(trees):
                    sums[t] += np.bincount(np.minimum(draws(ids, t, seed) // width, np.uint64(ranges)).astype(np.int64), minlength=ranges + 1)
            tree, place = np.nonzero(sums[:, :ranges])
            yield pa.record_batch([pa.array(tree, pa.int32()), pa.array(place, pa.int32()), pa.array(sums[tree, place], pa.int64())], ["tree", "place", "n"])

        held = np.zeros((trees, ranges), np.int64)
        for r in rows.select("id").mapInArrow(count, "tree int, place int, n long").groupBy("tree", "place").agg(F.sum("n").alias("n")).collect():  # trees * ranges
            held[r["tree"], r["place"]] = r["n"]
        upto = np.cumsum(held, axis=1)
        if (upto[:, -1] >= size).all() or share >= 1.0:
            break
        share = min(1.0, 4 * share)  # some tree has too few below the limit
    last = [int(np.searchsorted(u, size)) for u in upto]

    def pick(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for t in range(trees):
                h = draws(ids, t, seed)
                at = np.flatnonzero(h // width <= np.uint64(last[t]))
                if len(at):
                    some = pa.array(at)
                    yield pa.record_batch([pa.array(np.full(len(at), t), pa.int32()), pa.array((h[at] >> np.uint64(1)).astype(np.int64)), b.column(0).take(some), b.column(1).take(some)], ["tree", "h", "id", "x"])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"]).head(size)
        tree = int(pdf["tree"].iloc[0])
        nodes = isolation_tree(np.stack(pdf["x"].to_numpy()), np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([(tree, *x) for x in nodes], columns=[c.split()[0] for c in NODES.split(", ")])

    return table(rows.mapInArrow(pick, "tree int, h long, id long, x array<double>").groupBy("tree").applyInPandas(grow, NODES))


@dataclass
class Forest:
    """Nodes of all trees as arrays, level by level in each tree, a right child next to its left one; ``roots`` are the places of
    the trees' first nodes, ``trees`` their numbers, ``depth`` that of each node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    size: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    trees: list[int]
    value: np.ndarray | None = None

    @classmethod
    def of(cls, nodes: DataFrame) -> Forest:
        if (n := nodes.count()) > MOST_NODES:
            raise ValueError(f"{n} nodes are too many for every task to hold; fit fewer or shallower trees")
        # columns as they are: a Python object for each node's distribution would be most of the driver's memory
        t = nodes.select("tree", "node", "feature", "threshold", "left", "right", "size", *(["value"] if "value" in nodes.columns else [])).toArrow()
        at = np.lexsort([t.column(c).to_numpy() for c in ("node", "tree")])
        col = lambda c, kind: t.column(c).to_numpy().astype(kind)[at]
        tree = col("tree", np.int64)
        key = tree << 32 | col("node", np.int64)
        feature, children = col("feature", np.int64), [col(c, np.int64) for c in ("left", "right")]
        threshold, size = col("threshold", float), col("size", np.int64)
        value = pc.list_flatten(t.column("value")).to_numpy().reshape(n, -1)[at] if "value" in t.column_names else None
        del t
        roots = np.flatnonzero(np.diff(tree, prepend=-1))
        order, depth, cur = [], [], roots
        while len(cur):
            order.append(cur)
            depth.append(np.full(len(cur), len(depth)))
            inner = cur[feature[cur] >= 0]
            cur = np.stack([np.searchsorted(key, tree[inner] << 32 | c[inner]) for c in children], axis=1).ravel()
        order, depth = np.concatenate(order), np.concatenate(depth)
        at = np.lexsort((np.arange(len(order)), tree[order]))  # one tree after the other
        order, depth = order[at], depth[at]
        place = np.empty(n, np.int64)
        place[order] = np.arange(len(order))
        feature, inner = feature[order], feature[order] >= 0
        left = np.arange(len(order))
        left[inner] = place[np.searchsorted(key, tree[order][inner] << 32 | children[0][order][inner])]
        return cls(feature, threshold[order], left, size[order], depth, place[roots], tree[roots].tolist(), value if value is None else value[order])

    def walk(self, x: np.ndarray, inclusive: bool):
        """Yields (place, feature, next place) for each step of all rows (first axis) in all trees (second axis); steps
        of those that have arrived have feature -1. ``inclusive``: values equal to the threshold go left."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return
            v = x[rows, np.maximum(f, 0)]
            go = v <= self.threshold[at] if inclusive else v < self.threshold[at]
            to = np.where(inner, self.left[at] + ~go, at)
            yield at, f, to
            at = to

    def leaves(self, x: np.ndarray, inclusive: bool) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and depth of every row in every tree. One tree at a time, whose nodes then stay in the processor's cache; a step
        is two lookups of the node and one of the row, as the right child is next to the left. NaN goes right."""
        rows, width = x.shape
        most = np.finfo(float).max
        flat = np.where(np.isnan(x) | (x > most), most, x).ravel()
        out = np.empty((rows, len(self.roots)), np.int64)
        bounds = [*self.roots.tolist(), len(self.feature)]
        for t in range(len(self.roots)):
            nodes = slice(bounds[t], bounds[t + 1])
            feature, left = np.maximum(self.feature[nodes], 0), self.left[nodes] - bounds[t]
            # a leaf is its own left child, and no value is beyond it
            threshold = np.where(self.feature[nodes] >= 0, self.threshold[nodes], np.inf)
            last = np.zeros(rows, np.int64)
            live, at, base = np.arange(rows), np.zeros(rows, np.int64), np.arange(rows) * width
            for step in range(int(self.depth[nodes].max(initial=0))):
                v, edge = flat.take(base + feature.take(at)), threshold.take(at)
                at = left.take(at) + (v > edge if inclusive else v >= edge)
                if step % 4 == 3:  # those that have arrived leave
                    going = threshold.take(at) < np.inf
                    last[live] = at
                    live, at, base = live[going], at[going], base[going]
            last[live] = at
            out[:, t] = last + bounds[t]
        return out, self.depth[out].astype(float)


def shared(nodes: DataFrame) -> Broadcast:
    """The forest of a node table, sent out once however often the table is used."""
    if (found := getattr(nodes, "_flowlark_forest", None)) is None:
        found = nodes._flowlark_forest = nodes.sparkSession.sparkContext.broadcast(Forest.of(nodes))
    return found


def isolation_score(nodes: DataFrame, sample: int):
    """A function of the (scaled) feature array: 2 ^ -(mean depth / usual depth)."""
    forest = shared(nodes)
    usual = usual_path(sample)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        f = forest.value
        rest = np.array([usual_path(s) for s in f.size])
        out = []
        for i in range(0, len(x), 2048):
            leaf, depth = f.leaves(np.stack(x.iloc[i : i + 2048].to_numpy()), inclusive=False)
            out.append(2.0 ** (-(depth + rest[leaf]).mean(axis=1) / usual))
        return pd.Series(np.concatenate(out) if out else [])

    return score


#: Places of features and what each amounts to, largest first.
TOP = "places array<int>, amounts array<double>"


def largest(amounts: np.ndarray, top: int) -> tuple[list, list]:
    """Of each row the places of the ``top`` amounts that are largest without their sign, of equal ones the first, and these amounts."""
    places = np.argsort(-np.abs(amounts), axis=1, kind="stable")[:, :top]
    return list(places.astype(np.int32)), list(np.take_along_axis(amounts, places, axis=1))


def _weights(f: Forest, x: pd.Series) -> Iterator[np.ndarray]:
    for i in range(0, len(x), 512):
        rows = np.stack(x.iloc[i : i + 512].to_numpy())
        total, depth = np.zeros(rows.shape), 0
        for at, feature, to in f.walk(rows, inclusive=False):
            shrink = np.where(feature >= 0, 1.0 - f.size[to] / np.maximum(f.size[at], 1), 0.0) / (depth + 1.0)
            np.add.at(total, (np.repeat(np.arange(len(rows)), feature.shape[1]), np.maximum(feature, 0).ravel()), shrink.ravel())
            depth += 1
        sums = total.sum(axis=1, keepdims=True)
        yield total / np.where(sums > 0, sums, 1.0)


def isolation_weights(nodes: DataFrame):
    """A function of the feature array: how much each feature isolated the row, as shares. For explained rows only."""
    forest = shared(nodes)

    @F.pandas_udf("array<double>")
    def weights(x: pd.Series) -> pd.Series:
        return pd.Series([w for part in _weights(forest.value, x) for w in part])

    return weights


def top_weights(nodes: DataFrame, top: int):
    """A function of the feature array: the ``top`` features of isolation_weights(), as TOP."""
    forest = shared(nodes)

    @F.pandas_udf(TOP)
    def weights(x: pd.Series) -> pd.DataFrame:
        places, amounts = [], []
        for part in _weights(forest.value, x):
            p, a = largest(part, top)
            places += p
            amounts += a
        return pd.DataFrame({"places": places, "amounts": amounts})

    return weights


def class_weights(df: DataFrame, target: str) -> dict[str, float]:
    """n / (classes * n of the class)."""
    rows = df.groupBy(target).count().collect()
    n = sum(r["count"] for r in rows)
    return {r[target]: n / (len(rows) * r["count"]) for r in rows}


def _contributions(f: Forest, x: pd.Series, classes: int) -> Iterator[np.ndarray]:
    """Contributions of up to 512 rows by (row, feature, class)."""
    for i in range(0, len(x), 512):
        rows = np.stack(x.iloc[i : i + 512].to_numpy())
        n, width = rows.shape
        total = np.zeros((n * width, classes))
        for at, feature, to in f.walk(rows, inclusive=True):
            row, tree = np.nonzero(feature >= 0)
            cell = row * width + feature[row, tree]
            step = f.value[to[row, tree]] - f.value[at[row, tree]]
            for k in range(classes):
                total[:, k] += np.bincount(cell, weights=step[:, k], minlength=n * width)
        yield total.reshape(n, width, classes) / len(f.roots)


def contributions(nodes: DataFrame, classes: int):
    """A function of the feature array: features * classes contributions, row by row, and after them the bias of each
    class. Added up over features and bias they are the probabilities. For explained rows only."""
    forest = shared(nodes)

    @F.pandas_udf("array<double>")
    def share(x: pd.Series) -> pd.Series:
        f, out = forest.value, []
        bias = f.value[f.roots].mean(axis=0)
        for part in _contributions(f, x, classes):
            out += list(np.concatenate([part.reshape(len(part), -1), np.broadcast_to(bias, (len(part), classes))], axis=1))
        return pd.Series(out)

    return share


def top_contributions(nodes: DataFrame, classes: int, top: int):
    """A function of the feature array and a class number: the ``top`` features of contributions() to that class, as TOP."""
    forest = shared(nodes)

    @F.pandas_udf(TOP)
    def share(x: pd.Series, k: pd.Series) -> pd.DataFrame:
        of, places, amounts = k.to_numpy(np.int64), [], []
        for part in _contributions(forest.value, x, classes):
            here = of[len(places) : len(places) + len(part)]
            p, a = largest(part[np.arange(len(part)), :, here], top)
            places += p
            amounts += a
        return pd.DataFrame({"places": places, "amounts": amounts})

    return share


def node_probabilities(nodes: DataFrame):
    """A function of the feature array: the mean of the leaves' class distributions, from a node table with value."""
    forest = shared(nodes)

    @F.pandas_udf("array<double>")
    def proba(x: pd.Series) -> pd.Series:
        f, out = forest.value, []
        for i in range(0, len(x), 2048):
            leaf, _ = f.leaves(np.stack(x.iloc[i : i + 2048].to_numpy()), inclusive=True)
            sums = np.zeros((len(leaf), f.value.shape[1]))
            for t in range(leaf.shape[1]):
                sums += f.value.take(leaf[:, t], axis=0)
            out += list(sums / leaf.shape[1])
        return pd.Series(out)

    return proba


def importances(nodes: DataFrame) -> DataFrame:
    """feature, importance: weighted impurity decrease of its splits, as shares."""
    per = nodes.filter("feature >= 0").groupBy("feature").agg(F.sum(F.greatest(F.col("gain") * F.col("weight"), F.lit(0.0))).alias("v"))
    total = per.agg(F.sum("v").alias("total"))
    return per.join(F.broadcast(total)).select("feature", F.coalesce(F.try_divide("v", "total"), F.lit(0.0)).alias("importance"))


def importances_on(nodes: DataFrame, rows: DataFrame, vector: Column, label: Column, classes: int) -> DataFrame:
    """feature, importance: the impurity decrease of a forest's splits on other rows than it was fitted to, as shares. What is
    collected is one count for each leaf and class. ``label`` is a class number; rows of other numbers or of null play no part."""
    forest = shared(nodes)

    def count(batches):
        f = forest.value
        sums = np.zeros((len(f.feature), classes), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                leaf, _ = f.leaves(np.stack(part.column(0).to_numpy(zero_copy_only=False)), inclusive=True)
                np.add.at(sums, (leaf, part.column(1).to_numpy()[:, None]), 1)
        place, klass = np.nonzero(sums)
        yield pa.record_batch([pa.array(place, pa.int64()), pa.array(klass, pa.int32()), pa.array(sums[place, klass], pa.int64())], ["place", "class", "n"])

    known = rows.select(vector.alias("x"), label.cast("int").alias("k")).filter(F.col("k").between(0, classes - 1))
    f = forest.value
    held = np.zeros((len(f.feature), classes))
    for r in known.mapInArrow(count, "place long, class int, n long").groupBy("place", "class").agg(F.sum("n").alias("n")).collect():  # leaves * classes
        held[r["place"], r["class"]] = r["n"]
    inner = f.feature >= 0
    for d in range(int(f.depth.max(initial=0)), -1, -1):  # counts of the nodes above
        at = np.flatnonzero(inner & (f.depth == d))
        held[at] = held[f.left[at]] + held[f.left[at] + 1]
    n = held.sum(axis=1)
    impurity = n - (held**2).sum(axis=1) / np.maximum(n, 1)  # Gini impurity times rows
    at = np.flatnonzero(inner)
    gain = np.maximum(impurity[at] - impurity[f.left[at]] - impurity[f.left[at] + 1], 0.0)
    used, place = np.unique(f.feature[at], return_inverse=True)
    sums = np.bincount(place, weights=gain, minlength=len(used))
    total = float(sums.sum())
    found = [(int(u), float(v) / total if total > 0 else 0.0) for u, v in zip(used, sums, strict=True)]
    return nodes.sparkSession.createDataFrame(found, "feature int, importance double")
