"""A random forest on binned features, grown for all trees at once, with votes out of the bag.

Rows become bytes of bin codes once. A row's weight in a tree is a Poisson draw from a hash of both, so no bootstrap is
stored and any task can redraw it. Nodes with many rows are split level by level: one pass counts (tree, node, feature, bin,
class) for all open nodes, partial counts are summed in one shuffle, and each node's best split is found from its cells alone.
A node whose rows fit a task is finished there, with the same counts and the same choice of features, so where that
happens does not change the trees. Rows travel to that task in blocks of many rows, not one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.operators.binning import exact_quantiles
from flowlark.operators.forests import MOST_NODES, NODES, shared
from flowlark.session import table

#: Weighted rows of a node that one task finishes: some 200 bytes each there.
LOCAL = 2_000_000
#: Rows that a task looks at together, and rows of small nodes that are split together.
_SLAB, _TOGETHER = 131_072, 16_384
#: Rows from which a node of a task is counted by itself.
_LARGE = 1_024
#: Rows of a node below which it is not split.
LEAST_ROWS = 4
#: Cells that a task counts at once; open nodes with more are counted in several passes, each over the trees that it counts.
_DENSE = 4_000_000

_SPLIT = "tree int, node long, feature int, bin int, left array<long>, right array<long>"
_GROWN = "tree int, node long, feature int, bin int, counts array<long>, gain double"


# ---- bootstrap weights ------------------------------------------------------------------------------------------


def mixed(h: np.ndarray) -> np.ndarray:
    """32 bits stirred; the finaliser of the public MurmurHash3."""
    h = h.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)  # modulo 2 ** 32
    return h ^ (h >> np.uint32(16))


def tree_key(tree: int, seed: int) -> int:
    return int(mixed(mixed(np.array([seed & 0xFFFFFFFF])) ^ np.uint32(tree + 1))[0])


#: A draw of 32 bits that reaches so many of these is the weight: the Poisson distribution of mean 1.
POISSON = [math.floor(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def bag_weights(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (64-bit ids) is in the tree's bag."""
    return _bag(*_halves(rows), tree, seed)


def _halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = rows.astype(np.int64).view(np.uint64)
    return r.astype(np.uint32), (r >> np.uint64(32)).astype(np.uint32)


def _bag(low: np.ndarray, high: np.ndarray, tree: int, seed: int) -> np.ndarray:
    h = mixed(mixed(low ^ np.uint32(tree_key(tree, seed))) ^ high)
    out = np.zeros(len(h), np.uint8)
    for p in POISSON:
        out += h >= np.uint32(p)
    return out


# ---- one node ----------------------------------------------------------------------------------------------------


def features_of(tree: int, node: int, features: int, tried: int, seed: int) -> np.ndarray:
    """The features that a node tries, in order of preference among equal scores."""
    return np.random.default_rng([seed, tree, node]).permutation(features)[:tried]


def best_split(cells: np.ndarray, weights: np.ndarray, leaf: float) -> tuple[int, int] | None:
    """Place of the feature and bin after which a node is best split, from counts by (feature, bin, class).

    The score is the sum over both sides of squared class weights over the side's weight; it grows as Gini impurity falls.
    None if no split leaves ``leaf`` on both sides or improves on the whole.
    """
    left = np.cumsum(cells, axis=1) * weights
    whole = left[:, -1:]
    right = whole - left
    nl, nr = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((nl >= leaf) & (nr >= leaf), (left**2).sum(axis=2) / nl + (right**2).sum(axis=2) / nr, -np.inf)
    total, top = whole[0].sum(), score.max()
    at = int((score >= top - 1e-10 * total).argmax())  # of equal scores, however rounded, the first
    if not score.flat[at] > (whole[0] ** 2).sum() / total + 1e-9:
        return None
    return at // score.shape[1], at % score.shape[1]


def best_splits(part: np.ndarray, label: np.ndarray, times: np.ndarray, sizes: np.ndarray, counts: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """best_split() of many small nodes: place of the feature (-1: none) and bin of each. ``part`` has the codes of the features
    that a row's node tries; rows are in the order of nodes, of which each has ``sizes``. Only bins that have rows are looked at."""
    k, tried, m = len(p["weights"]), part.shape[1], len(sizes)
    label_bits, bin_bits = (k - 1).bit_length(), (p["bins"] - 1).bit_length()
    node = np.repeat(np.arange(m), sizes)
    key = (((node[:, None] * tried + np.arange(tried)) << bin_bits | part) << label_bits | label[:, None]) << 4 | times[:, None]  # times are 12 at most
    key = np.sort(key.ravel().astype(np.int32 if (m * tried) << (bin_bits + label_bits + 4) < 1 << 31 else np.int64))
    each, of = key & 15, (key >> 4) & ((1 << label_bits) - 1)
    cell = key >> (label_bits + 4)
    at = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))  # the last entry of each bin
    run = cell[at] >> bin_bits  # node and feature
    node = run // tried
    begin = (np.repeat(tried * (np.cumsum(sizes) - sizes), tried) + np.tile(np.arange(tried), m) * np.repeat(sizes, tried))[run]
    nl, nr, sl, sr = (np.zeros(len(at)) for _ in range(4))
    total, square = np.zeros(m), np.zeros(m)
    for j, weight in enumerate(p["weights"]):
        upto = np.concatenate([[0], np.cumsum(each * (of == j), dtype=np.int64)])
        whole = counts[:, j] * weight
        left = (upto[at + 1] - upto[begin]) * weight
        right = whole[node] - left
        nl, nr, sl, sr = nl + left, nr + right, sl + left**2, sr + right**2
        total, square = total + whole, square + whole**2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((nl >= p["leaf"]) & (nr >= p["leaf"]), sl / nl + sr / nr, -np.inf)
    top = np.maximum.reduceat(score, np.searchsorted(node, np.arange(m)))
    near = np.flatnonzero(score >= (top - 1e-10 * total)[node])
    first = near[np.append(True, np.diff(node[near]) > 0)]  # every node has one
    better = score[first] > square / total + 1e-9
    return np.where(better, run[first] % tried, -1), cell[at[first]] & ((1 << bin_bits) - 1)


def is_leaf(counts: np.ndarray, depth: int, most: int, leaf: float) -> bool:
    return depth >= most or (counts > 0).sum() <= 1 or counts.sum() < max(LEAST_ROWS, 2 * leaf)


def mass(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight times Gini impurity of nodes (counts by class on the last axis)."""
    w = counts * weights
    total = w.sum(axis=-1)
    return total - (w**2).sum(axis=-1) / np.where(total > 0, total, 1.0)


def gain_of(counts: np.ndarray, left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Impurity that a split takes away."""
    return (mass(counts, weights) - mass(left, weights) - mass(right, weights)) / (counts * weights).sum(axis=-1)


def grow(codes: np.ndarray, label: np.ndarray, times: np.ndarray, tree: int, node: int, p: dict) -> dict[str, np.ndarray]:
    """node, feature, bin, counts and gain of the subtree at ``node`` over rows that are ``times`` in the bag; ``codes`` by feature and row.

    All nodes of a level at once: rows lie in the order of nodes. Nodes of many rows are counted one by one, others together.
    """
    k, bins, width, weights = len(p["weights"]), p["bins"], len(codes), p["weights"]
    by_row = np.ascontiguousarray(codes.T).ravel()
    joint = codes.astype(np.int16 if bins * k < 1 << 15 else np.int32) * k + label.astype(np.int16)
    kept = {f: i for i, f in enumerate(p["kept"])}  # other features have one value
    column = np.full(p["features"], -1)
    column[p["kept"]] = np.arange(width)
    times8, out = times.astype(np.int64), []
    heap, sizes, rows = np.array([node]), np.array([len(label)]), np.arange(len(label))
    while len(heap):
        at = np.repeat(np.arange(len(heap)), sizes)
        y, t = label[rows].astype(np.int64), times8[rows]
        counts = np.bincount(at * k + y, weights=t, minlength=len(heap) * k).reshape(-1, k).astype(np.int64)
        leaf = ((counts > 0).sum(axis=1) <= 1) | (counts.sum(axis=1) < max(LEAST_ROWS, 2 * p["leaf"])) | (int(heap[0]).bit_length() - 1 >= p["depth"])
        feature, bin_, starts = np.full(len(heap), -1), np.full(len(heap), -1), np.cumsum(sizes) - sizes
        inner = np.flatnonzero(~leaf)
        tried = np.full((len(heap), p["tried"]), -1)
        for i in inner:
            tried[i] = features_of(tree, int(heap[i]), p["features"], p["tried"], p["seed"])
        large = sizes[inner] >= _LARGE
        for i in inner[large]:
            here = slice(starts[i], starts[i] + sizes[i])
            some, tw = rows[here], t[here].astype(float)
            cells = np.zeros((p["tried"], bins, k))
            cells[:, 0] = counts[i]
            for slot, f in enumerate(tried[i]):
                if (f := int(f)) in kept:
                    cells[slot] = np.bincount(joint[kept[f]].take(some), weights=tw, minlength=bins * k).reshape(bins, k)
            if (found := best_split(cells, weights, p["leaf"])) is not None:
                feature[i], bin_[i] = tried[i, found[0]], found[1]
        small = inner[~large]
        piece = np.cumsum(sizes[small]) // _TOGETHER
        for some in np.split(small, np.flatnonzero(np.diff(piece)) + 1):
            if not len(some):
                continue
            n = sizes[some]
            where = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            columns = np.repeat(column[tried[some]], n, axis=0)
            part = np.where(columns >= 0, by_row.take(rows[where][:, None] * width + columns), 0)
            slot, b = best_splits(part, y[where], t[where], n, counts[some], p)
            feature[some] = np.where(slot >= 0, tried[some, slot], -1)
            bin_[some] = np.where(slot >= 0, b, -1)
        split = feature >= 0
        gain = np.zeros(len(heap))
        going = split[at]
        at, rows, y, t = at[going], rows[going], y[going], t[going]
        right = by_row.take(rows * width + column[feature][at]) > bin_[at]
        both, child = np.flatnonzero(split), np.cumsum(split) - 1
        to = child[at] * 2 + right
        under = np.bincount(to * k + y, weights=t, minlength=len(both) * 2 * k).reshape(-1, 2, k)
        gain[both] = gain_of(counts[both], under[:, 0], under[:, 1], weights)
        out.append((heap, feature, bin_, counts, gain))
        sizes = np.bincount(to, minlength=2 * len(both))
        before = np.cumsum(right) - right  # rows before that go right
        first = np.cumsum(sizes) - sizes
        start = first[0::2]  # of a node's rows, that of its left child's
        less = before - (before[start] if len(start) else before)[child[at]]
        place = np.where(right, first[to] + less, start[child[at]] + np.arange(len(at)) - start[child[at]] - less)
        moved = np.empty_like(rows)
        moved[place] = rows
        rows = moved
        heap = (heap[both, None] * 2 + np.arange(2)).ravel()
    return dict(zip(("node", "feature", "bin", "counts", "gain"), map(np.concatenate, zip(*out)), strict=True))


# ---- all trees ---------------------------------------------------------------------------------------------------


class _Trees:
    """The trees as far as they are grown, for walking rows of codes: numbered as in a heap, from 1."""

    def __init__(self, trees: int) -> None:
        self.tree, self.node = list(range(trees)), [1] * trees
        self.feature, self.bin, self.left = [-1] * trees, [-1] * trees, [-1] * trees
        self.state = [0] * trees  # -1 for a node that a task is to finish

    def split(self, place: int, feature: int, bin_: int) -> int:
        """Place of the left child; the right one follows."""
        first = len(self.tree)
        self.feature[place], self.bin[place], self.left[place], self.state[place] = feature, bin_, first, 0
        for side in (0, 1):
            self.tree.append(self.tree[place])
            self.node.append(2 * self.node[place] + side)
            self.feature.append(-1)
            self.bin.append(-1)
            self.left.append(-1)
            self.state.append(0)
        return first

    def arrays(self) -> dict[str, np.ndarray]:
        return {c: np.array(getattr(self, c), np.int64) for c in ("tree", "node", "feature", "bin", "left", "state")}


def _places(a: dict[str, np.ndarray], tree: int, codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Place in the tree of each of the ``rows`` of ``codes``."""
    out, flat = np.empty(len(rows), np.int64), codes.ravel()
    at, base, live = np.full(len(rows), tree, np.int64), rows * codes.shape[1], np.arange(len(rows))
    while True:
        feature = a["feature"].take(at)
        going = feature >= 0
        if not going.all():
            out[live[~going]] = at[~going]
            feature, at, base, live = feature[going], at[going], base[going], live[going]
        if not len(live):
            return out
        at = a["left"].take(at) + (flat.take(base + feature) > a["bin"].take(at))


def coded(df: DataFrame, row_id: str, vector: Column, label: Column, edges: list[np.ndarray]) -> DataFrame:
    """row, label and a byte for each feature: how many of the feature's edges are below the value."""
    n = len(edges)

    def work(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            codes = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, n), np.uint8)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([r.tobytes() for r in codes], pa.binary())], ["row", "label", "codes"])

    rows = df.select(F.col(row_id).cast("long").alias("row"), label.cast("int").alias("label"), vector.alias("x"))
    return rows.mapInArrow(work, "row long, label int, codes binary")


def _slabs(batches, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and codes (by row) of some _SLAB rows at a time."""
    held, rows = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, n)))
        rows += b.num_rows
        if rows >= _SLAB:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, rows = [], 0
    if rows:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def fit(
    df: DataFrame, row_id: str, vector: Column, label: Column, weights: list[float], features: int, trees: int = 120, depth: int = 20,
    leaf: float = 2.0, bins: int = 64, tried: int | None = None, seed: int = 0, local: int = LOCAL,
) -> DataFrame:
    """Node table of the forest over rows with a label from 0 below len(weights); ``weights`` are the classes'.

    Each node tries ``tried`` features (the root of their number, if None). Bins are cut at exact quantiles. row_id must
    tell rows apart. The table has NODES and value (class distribution), gain (impurity decrease), impurity, weight.
    """
    tried = tried or max(1, math.isqrt(features))
    edges = [np.array(e) for e in exact_quantiles(df, [F.get(vector, F.lit(i)) for i in range(features)], bins)]
    return table(_nodes(grown(table(coded(df, row_id, vector, label, edges)), features, weights, trees, depth, leaf, bins, tried, seed, local), weights, edges))


def _varying(rows: DataFrame, features: int) -> np.ndarray:
    """The features that have any code but 0; others have no split and need not travel."""

    def look(batches) -> Iterator[pa.RecordBatch]:
        found = np.zeros(features, bool)
        for _, _, codes in _slabs(batches, features):
            found |= codes.any(axis=0)
        yield pa.record_batch([pa.array(np.flatnonzero(found), pa.int32())], ["feature"])

    return np.array(sorted(r["feature"] for r in rows.mapInArrow(look, "feature int").distinct().collect()), int)


def grown(rows: DataFrame, features: int, weights: list[float], trees: int, depth: int, leaf: float, bins: int, tried: int, seed: int, local: int = LOCAL) -> DataFrame:
    """tree, node, feature, bin, counts, gain of all nodes over rows of codes, numbered as in a heap."""
    spark, k = rows.sparkSession, len(weights)
    p = {"weights": np.array(weights), "bins": bins, "depth": depth, "leaf": leaf, "tried": tried, "seed": seed, "features": features, "kept": _varying(rows, features)}
    state = _Trees(trees)
    done: list[tuple] = []

    def roots(batches) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trees, k), np.int64)
        for b in batches:
            halves, y = _halves(b.column(0).to_numpy()), b.column(1).to_numpy()
            for t in range(trees):
                sums[t] += np.bincount(y, weights=_bag(*halves, t, seed), minlength=k).astype(np.int64)
        yield pa.record_batch([pa.array(np.repeat(np.arange(trees), k), pa.int32()), pa.array(np.tile(np.arange(k), trees), pa.int32()), pa.array(sums.ravel(), pa.int64())], ["tree", "label", "n"])

    first = np.zeros((trees, k), np.int64)
    for r in rows.mapInArrow(roots, "tree int, label int, n long").groupBy("tree", "label").agg(F.sum("n").alias("n")).collect():  # trees * classes
        first[r["tree"], r["label"]] = r["n"]
    fresh = [(t, first[t]) for t in range(trees)]
    while True:
        open_: list[int] = []
        for place, counts in fresh:
            node = state.node[place]
            if is_leaf(counts, node.bit_length() - 1, depth, leaf):
                done.append((state.tree[place], node, -1, -1, counts.tolist(), 0.0))
            elif counts.sum() <= local:
                state.state[place] = -1
            else:
                open_.append(place)
        if not open_:
            break
        if len(state.tree) > MOST_NODES:
            raise ValueError("the forest has too many nodes for every task to hold; fit fewer or shallower trees")
        counts_of = dict(fresh)
        fresh = []
        open_.sort(key=lambda place: state.tree[place])
        arrays, most = state.arrays(), max(1, _DENSE // (tried * bins * k))
        passes = (open_[i : i + most] for i in range(0, len(open_), most))
        found = {(r["tree"], r["node"]): r for part in passes for r in _splits(rows, arrays, part, features, p).collect()}  # one row an open node
        for place in open_:
            key = (state.tree[place], state.node[place])
            if (r := found.get(key)) is None:
                done.append((*key, -1, -1, counts_of[place].tolist(), 0.0))
                continue
            left, right = np.array(r["left"]), np.array(r["right"])
            done.append((*key, r["feature"], r["bin"], counts_of[place].tolist(), float(gain_of(counts_of[place], left, right, p["weights"]))))
            child = state.split(place, r["feature"], r["bin"])
            fresh += [(child, left), (child + 1, right)]
    out = spark.createDataFrame(done, _GROWN)
    if -1 in state.state:
        out = out.unionByName(_finished(rows, state.arrays(), features, p))
    return out


def _splits(rows: DataFrame, arrays: dict[str, np.ndarray], open_: list[int], features: int, p: dict) -> DataFrame:
    """The best split of each open node (in order of trees) that has one."""
    k, bins, tried = len(p["weights"]), p["bins"], p["tried"]
    of = np.stack([features_of(int(arrays["tree"][i]), int(arrays["node"][i]), features, tried, p["seed"]) for i in open_])
    number = np.full(len(arrays["tree"]), -1)
    number[open_] = np.arange(len(open_))
    mine, first = np.unique(arrays["tree"][open_], return_index=True)
    ranges = [(int(t), int(low), int(high)) for t, low, high in zip(mine, first, [*first[1:], len(open_)], strict=True)]
    shared = rows.sparkSession.sparkContext.broadcast(({**arrays, "number": number}, of, np.array(open_)))  # bounded by MOST_NODES

    def count(batches) -> Iterator[pa.RecordBatch]:
        a, of, places = shared.value
        dense = np.zeros((len(of), tried, bins * k))
        for ids, y, codes in _slabs(batches, features):
            halves = _halves(ids)
            joint = codes.T.astype(np.int16 if bins * k < 1 << 15 else np.int32, order="C") * k + y.astype(np.int16)
            for t, low, high in ranges:  # a tree's open nodes are next to each other
                w = _bag(*halves, t, p["seed"])
                at = np.flatnonzero(w > 0)  # the others need not walk the tree
                number = a["number"].take(_places(a, t, codes, at))
                order = np.argsort(number, kind="stable")
                at, number = at[order], number[order]
                for i, begin, end in zip(range(low, high), *(np.searchsorted(number, np.arange(low, high), side=side) for side in ("left", "right")), strict=True):
                    some = at[begin:end]
                    times = w[some].astype(float)
                    for slot, f in enumerate(of[i]):
                        dense[i, slot] += np.bincount(joint[f].take(some), weights=times, minlength=bins * k)
        for i in range(len(of)):
            if dense[i].any():
                yield pa.record_batch([pa.array([a["tree"][places[i]]], pa.int32()), pa.array([a["node"][places[i]]], pa.int64()), pa.array([dense[i].astype(np.int64).tobytes()], pa.binary())], ["tree", "node", "cells"])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        cells = sum(np.frombuffer(c, np.int64) for c in pdf["cells"]).reshape(tried, bins, k)
        found = best_split(cells, p["weights"], p["leaf"])
        if found is None:
            return pd.DataFrame([], columns=[c.split()[0] for c in _SPLIT.split(", ")])
        slot, b = found
        f = int(features_of(tree, node, features, tried, p["seed"])[slot])
        left = cells[slot, : b + 1].sum(axis=0)
        return pd.DataFrame([(tree, node, f, b, left.tolist(), (cells[slot].sum(axis=0) - left).tolist())], columns=[c.split()[0] for c in _SPLIT.split(", ")])

    cells = rows.mapInArrow(count, "tree int, node long, cells binary")
    return cells.groupBy("tree", "node").applyInPandas(best, _SPLIT)  # tried * bins * classes counts of each task a node


def _finished(rows: DataFrame, arrays: dict[str, np.ndarray], features: int, p: dict) -> DataFrame:
    """Subtrees of the nodes whose rows fit a task. Of each slab a node has one row: its labels, times and codes, feature by feature."""
    shared = rows.sparkSession.sparkContext.broadcast(arrays)
    trees = sorted({int(t) for t, s in zip(arrays["tree"], arrays["state"], strict=True) if s < 0})
    kept = p["kept"]

    def deal(batches) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for ids, y, codes in _slabs(batches, features):
            halves, columns, label = _halves(ids), np.ascontiguousarray(codes.T[kept]), y.astype(np.uint8)
            for t in trees:
                w = _bag(*halves, t, p["seed"])
                at = np.flatnonzero(w > 0)
                place = _places(a, t, codes, at)
                unfinished = a["state"][place] < 0
                at, place = at[unfinished], place[unfinished]
                order = np.argsort(place, kind="stable")
                at, place = at[order], place[order]
                cuts = [*np.flatnonzero(np.diff(place, prepend=-1)).tolist(), len(at)]
                for low, high in zip(cuts, cuts[1:]):
                    some = at[low:high]
                    packed = np.concatenate([label[some], w[some], *(c.take(some) for c in columns)])
                    yield pa.record_batch([pa.array([t], pa.int32()), pa.array([a["node"][place[low]]], pa.int64()), pa.array([packed.tobytes()], pa.binary())], ["tree", "node", "packed"])

    def finish(blocks: pa.Table) -> pa.Table:
        tree, node = (blocks.column(c)[0].as_py() for c in ("tree", "node"))
        parts = [np.frombuffer(v, np.uint8).reshape(2 + len(kept), -1) for v in blocks.column("packed").to_pylist()]
        rows = np.concatenate(parts, axis=1)
        del parts
        out = grow(rows[2:], rows[0], rows[1], tree, node, p)
        n, k = out["counts"].shape
        counts = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k), pa.int32()), pa.array(out["counts"].ravel()))
        columns = [pa.array(np.full(n, tree), pa.int32()), pa.array(out["node"], pa.int64()), *(pa.array(out[c], pa.int32()) for c in ("feature", "bin")), counts, pa.array(out["gain"])]
        return pa.table(columns, [c.split()[0] for c in _GROWN.split(", ")])

    dealt = rows.mapInArrow(deal, "tree int, node long, packed binary")
    return dealt.groupBy("tree", "node").applyInArrow(finish, _GROWN)  # LOCAL weighted rows at most


def _nodes(found: DataFrame, weights: list[float], edges: list[np.ndarray]) -> DataFrame:
    """The node table of grown(): thresholds for bins and distributions for counts."""
    w = F.array(*map(F.lit, map(float, weights)))
    # a split after bin b sends values up to the b-th edge to the left
    flat = [[float(v) for v in e] or [0.0] for e in edges]
    part = F.zip_with("counts", w, lambda n, x: n * x)
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    rows = found.withColumn("parts", part).withColumn("weight", total).withColumn("value", F.transform("parts", lambda x: F.try_divide(x, F.col("weight"))))
    inner = F.col("feature") >= 0
    at = F.get(F.get(F.lit(flat), F.col("feature")), F.col("bin"))
    return rows.select(
        "tree", F.col("node").cast("int").alias("node"), "feature", F.when(inner, at).otherwise(0.0).alias("threshold"),
        F.when(inner, 2 * F.col("node")).otherwise(-1).cast("int").alias("left"), F.when(inner, 2 * F.col("node") + 1).otherwise(-1).cast("int").alias("right"),
        F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"), "value",
        "gain", (1.0 - F.aggregate("value", F.lit(0.0), lambda a, x: a + x * x)).alias("impurity"), "weight",
    )


# ---- out of the bag ----------------------------------------------------------------------------------------------


def oob_votes(nodes: DataFrame, seed: int):
    """A function of row id and feature array: class votes of the trees that did not see the row; null if all did."""
    forest = shared(nodes)

    @F.pandas_udf("array<double>")
    def votes(row: pd.Series, x: pd.Series) -> pd.Series:
        f, out = forest.value, []
        for i in range(0, len(x), 2048):
            leaf, _ = f.leaves(np.stack(x.iloc[i : i + 2048].to_numpy()), inclusive=True)
            ids = row.iloc[i : i + 2048].to_numpy(np.int64)
            outside = np.stack([bag_weights(ids, t, seed) == 0 for t in f.trees], axis=1)
            sums = np.zeros((len(ids), f.value.shape[1]))
            for t in range(len(f.trees)):
                sums += np.where(outside[:, t, None], f.value[leaf[:, t]], 0.0)
            out += [s if seen else None for s, seen in zip(sums, outside.any(axis=1), strict=True)]
        return pd.Series(out, dtype=object)

    return votes


def oob_accuracy(df: DataFrame, row_id: str, vector: Column, label: Column, nodes: DataFrame, seed: int) -> DataFrame:
    """n_rows, n_voted, n_right, accuracy (of those with votes) in one row; ties go to the first class."""
    voted = df.select(label.alias("label"), oob_votes(nodes, seed)(F.col(row_id), vector).alias("v"))
    right = (F.array_position("v", F.array_max("v")) - 1) == F.col("label")
    out = voted.agg(F.count("*").alias("n_rows"), F.count("v").alias("n_voted"), F.coalesce(F.sum(right.cast("long")), F.lit(0).cast("long")).alias("n_right"))
    return out.withColumn("accuracy", F.try_divide(F.col("n_right").cast("double"), F.col("n_voted")))


__all__ = ["NODES", "bag_weights", "fit", "grown", "oob_accuracy", "oob_votes"]
