"""Operator 2: near-duplicate detection with circulant MinHash, banding and exact Jaccard verification.

Two permutations make all coordinates of a signature: the first scatters the shingles over a ring, the second gives the
values on the ring, and coordinate k reads them k places further on. A shingle therefore gives one contiguous window of
the second permutation, and the signature is the minimum over its shingles' windows.

Links are confirmed on full shingle sets. No group is ever expanded into all its pairs: texts with equal sets are one
node; in each bucket the nodes are held against one leader, the node that meets most others in all of its buckets. Where
a bucket's nodes are then still in several components, they are matched by their rarest shingles: two sets that are
similar enough share one of the few rarest of each, and how few depends on both sizes. Shingles that no other node in
question has, most of what tells a near copy that went too far from its like, match nothing, so such nodes meet no one
instead of everyone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import WordHashes, arrow_rows, cut, documents, mix, window_hashes

#: Size of the ring, a power of two.
RING_BITS = 21
_state: dict = {}


def ring(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation and the values, the latter continued so that each window is contiguous."""
    if coordinates not in _state:
        rng = np.random.default_rng(20260101)
        scatter = rng.permutation(1 << RING_BITS).astype(np.uint32)
        values = rng.permutation(1 << RING_BITS).astype(np.int32)
        _state[coordinates] = scatter, np.concatenate([values, values[:coordinates]])
    return _state[coordinates]


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Minimum of each coordinate over a non-empty array of shingle fingerprints."""
    scatter, values = ring(coordinates)
    windows = np.lib.stride_tricks.sliding_window_view(values, coordinates)
    places = scatter[(shingles >> np.uint64(64 - RING_BITS)).astype(np.int64)]
    out = np.full(coordinates, np.iinfo(np.int32).max, np.int32)
    for start in range(0, len(places), 2048):
        np.minimum(out, windows[places[start : start + 2048]].min(axis=0), out=out)
    return out


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct fingerprints of the ``width``-word shingles of the whole text, A-Z lower-cased; a text with
    fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], np.uint64)
    return np.unique(window_hashes(h, width))


def _signatures(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """h1, h2 (fingerprint of doc_id and text), doc_id, row, n_shingles, set_id (16 bytes, null for no shingles) and the
    keys of the bands."""

    def work(batches):
        hashes = WordHashes()
        for b in arrow_rows(batches):
            n, ids, keys = [], [], []
            for t in b.column(3):
                s = shingle_set(t.as_py(), width, hashes)
                n.append(len(s))
                if len(s):
                    ids.append(xxhash.xxh3_128_digest(s.tobytes()))
                    parts = signature(s, bands * rows).astype(np.uint64).reshape(bands, rows)
                    key = np.arange(bands, dtype=np.uint64)
                    with np.errstate(over="ignore"):
                        for k in range(rows):
                            key = mix(key) + parts[:, k]
                        keys.append(mix(key).astype(np.int64))
                else:
                    ids.append(None)
                    keys.append(np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.record_batch(
                [b.column(0), b.column(1), b.column(2), b.column(4), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["h1", "h2", "doc_id", "row", "n_shingles", "set_id", "keys"],
            )

    return df.select(*_of_row(), "doc_id", "text", "row").mapInArrow(
        work, "h1 long, h2 long, doc_id long, row long, n_shingles long, set_id binary, keys array<long>"
    )


def _of_row() -> list[Column]:
    """128 bits that rows share only if they repeat both doc_id and text."""
    return [F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64("text", "doc_id").alias("h2")]


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose full sets are similar enough. ``texts``: node, text, one row each."""
    sides = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    packed = texts.join(sides, "node", "left_semi")

    def sets(batches):
        hashes = WordHashes()
        for b in arrow_rows(batches):
            found = [shingle_set(t.as_py(), width, hashes).tobytes() for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(found, pa.binary())], ["node", "set"])

    packed = packed.mapInArrow(sets, "node long, set binary")
    both = pairs.join(packed.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
        packed.select(F.col("node").alias("b"), F.col("set").alias("y")), "b"
    )

    def test(batches):
        for b in arrow_rows(batches):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                good = 100 * len(small) >= percent * len(large)
                if good:
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    common = int((large[at] == small).sum())
                    good = 100 * common >= percent * (len(x) + len(y) - common)
                keep.append(good)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that the links (a, b) connect each of their nodes with.

    Each round a node takes the smallest root among its neighbours' and then its root's root; the roots of long chains
    halve their distance each time. Only tables of nodes and links are read; each round's roots are checkpointed.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(rounds):
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        lower = roots.join(near, "node").select("node", "root", F.least("root", "m").alias("m"))
        # a root hears of the lower roots its members have found, and members take over what their root has heard
        hooks = lower.groupBy("root").agg(F.min("m").alias("hook")).select(F.col("root").alias("m"), "hook")
        jumped = lower.join(hooks, "m", "left").select("node", "root", F.least("m", F.coalesce("hook", "m")).alias("next"))
        jumped = cut(jumped)
        changed = jumped.filter("next < root").limit(1).count()
        roots = jumped.select("node", F.col("next").alias("root"))
        if not changed:
            return roots
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _sizes_allow(a: str, b: str, percent: int):
    """Sets of these sizes can be similar enough: an exact test that needs no set."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _bands_of_sizes(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, least size in it) of the sizes that a set of ``n`` can be similar enough to; bands widen by ``_WIDER``."""
    low, high = -(-n * percent // 100), n * 100 // percent
    out, size = [], low
    while size <= high:
        band = _band(size)
        out.append((band, size))
        size = int(math.exp(band * _WIDER)) + 1
        while _band(size) == band:
            size += 1
    return out


def _band(size: int) -> int:
    return math.floor(math.log(size) / _WIDER) + 1


#: Logarithm of the ratio between the edges of a band of set sizes.
_WIDER = math.log(1.03)


def _rare_matches(split: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): the pairs of nodes of different components, one of them odd, that can be similar enough by their rarest
    shingles. ``split``: node, root, odd. No pair that is similar enough is left out.

    With i common shingles needed, a pair shares one of the n - i + 1 rarest of either side, in any one order of all
    shingles. i is known from the sizes: odd nodes give their rarest for each band of partners' sizes, by what the least
    size in the band needs; the others give what they need against the smallest partner, and the exact sizes decide.
    """
    sides = texts.join(split, "node")

    def sets(batches):
        hashes = WordHashes()
        for b in arrow_rows(batches):
            found = [shingle_set(t.as_py(), width, hashes).astype(np.int64) for t in b.column(1)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "root", "odd", "shingles"])

    held = cut(sides.select("node", "text", "root", "odd").mapInArrow(sets, "node long, root long, odd boolean, shingles array<long>"))
    each = held.select("node", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("often")).filter("often > 1")
    # ties between equally rare shingles go by the shingle, so that the order is one and the same everywhere
    rare = each.join(often, "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("rare"))
    rare = held.select("node", "root", "odd", F.size("shingles").alias("n")).join(rare.select("node", F.col("rare.s").alias("rare")), "node")

    def give(odd: bool):
        def work(batches):
            for b in batches:
                cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
                for node, root, n, shingles in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                    s = np.asarray(shingles.values, np.int64)
                    alone = n - len(s)  # those that no one else has come first in the order
                    for band, least in _bands_of_sizes(n, percent) if odd else [(_band(n), -(-n * percent // 100))]:
                        need = -(-percent * (n + least) // (100 + percent))
                        first = s[: max(0, n - need + 1 - alone)]
                        for c, v in zip(cols, (first, band, node, root, n, alone + np.arange(len(first))), strict=True):
                            c.append(v if isinstance(v, np.ndarray) else np.full(len(first), v, np.int64))
                yield pa.record_batch([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in cols], ["s", "band", "node", "root", "n", "place"])

        return work

    rows = "s long, band long, node long, root long, n long, place long"
    given = rare.select("node", "root", "n", "rare")
    x = given.filter(rare["odd"]).mapInArrow(give(True), rows).select("s", "band", F.col("node").alias("x"), F.col("root").alias("x_root"), F.col("n").alias("x_n"), F.col("place").alias("x_place"))
    y = given.mapInArrow(give(False), rows)
    need = F.expr(f"({percent} * (n + x_n) + {99 + percent}) div {100 + percent}")
    return (
        x.join(y, ["s", "band"])
        .filter(F.expr("x_root <> root") & _sizes_allow("n", "x_n", percent) & (F.col("place") + need <= F.col("n")) & (F.col("x_place") + need <= F.col("x_n")))
        .select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b"))
        .distinct()
    )


def near_duplicates(
    df: DataFrame, width: int = 5, percent: int = 80, bands: int = 64, rows: int = 7, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) and kept, one row for
    each row of ``df``.

    Two texts are linked if 100 * intersection >= percent * union of their sets of ``width``-word shingles. A pair at
    the threshold misses all ``bands`` with a probability of (1 - 0.8^7)^64 = 3e-7. Texts without words (null, empty,
    blank) have no shingles and are linked with nothing. Rows that repeat a doc_id are linked if their texts are; null
    doc_ids never count as the smallest, and in a component that has no other the id is null and all are kept. An
    empty table gives an empty table.

    ``row_col`` names a number of each row, to be given back as row. Then exactly one row of each component is kept: the
    one with the smallest doc_id (null last), and of those the one with the smallest number.
    """
    row = (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row")
    docs = documents(df, row, id_col=id_col, text_col=text_col)
    sign = cut(_signatures(docs, width, bands, rows).withColumn("num", F.monotonically_increasing_id()))
    # equal sets are one node, named by the number of one of its rows
    turn = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    nodes = sign.filter("set_id is not null").groupBy("set_id")
    nodes = cut(nodes.agg(F.min("num").alias("node"), F.min("doc_id").alias("doc_id"), F.min(turn).alias("turn"), F.min("n_shingles").alias("n")))
    # a key holds its band's number; of the rows of a node one gives the keys, and most keys are alone
    one = sign.withColumnRenamed("num", "node").join(nodes.select("node"), "node", "left_semi")
    keyed = one.select("node", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1")
    members = cut(keyed.join(met, "key").select("key", "node", "n", "met"))
    # the node that meets most others in all its buckets stands in the middle of its like: it leads wherever it is
    busy = members.groupBy("node").agg(F.sum("met").alias("busy"))
    leads = members.join(busy, "node").groupBy("key").agg(F.max(F.struct("busy", "node", "n")).alias("l")).select("key", F.col("l.node").alias("lead"), F.col("l.n").alias("lead_n"))
    led = members.join(leads, "key")
    pairs = led.filter("node <> lead").filter(_sizes_allow("n", "lead_n", percent))
    pairs = cut(pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())
    own = one.join(members.select("node").distinct(), "node", "left_semi").select("h1", "h2", "node")
    texts = cut(docs.select(*_of_row(), "text").join(own, ["h1", "h2"]).dropDuplicates(["node"]).select("node", "text"))
    links = cut(_confirmed(pairs, texts, width, percent))
    roots = components(links)
    # buckets in which several components are left: whoever is not in the largest is held against the others
    seen = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = seen.groupBy("key", "root").agg(F.count("*").alias("held"))
    main = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("root", "held").alias("main")).filter("parts > 1")
    split = seen.join(main.select("key", "main"), "key").groupBy("node", "root").agg(F.max(F.col("root") != F.col("main")).alias("odd"))
    more = _rare_matches(split, texts, width, percent).join(pairs, ["a", "b"], "left_anti")
    late = cut(_confirmed(cut(more), texts, width, percent))
    # the late links tie whole components: a component is one node here, and few are left
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    tops = late.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    tops = components(tops.filter("a <> b"))
    alone = tops.join(roots, "node", "left_anti")  # nodes without a link until now
    merged = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    roots = cut(merged.select("node", F.coalesce("top", "root").alias("root")).union(alone.select("node", "root")))
    tied = cut(nodes.join(roots, "node").select("set_id", "root", "doc_id", "turn"))
    least = cut(tied.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("turn").alias("turn")))
    tied = tied.select("set_id", "root").join(least, "root").select("set_id", "component_id", F.col("turn.row").alias("kept_row"))
    free = nodes.join(roots, "node", "left_anti").select("set_id", F.col("doc_id").alias("component_id"), F.col("turn.row").alias("kept_row"))
    one_row = F.col("bare") | (F.col("row") == F.col("kept_row"))
    return (
        sign.select("row", "doc_id", "n_shingles", "set_id", F.col("set_id").isNull().alias("bare"))
        .join(tied.union(free), "set_id", "left")
        .withColumn("component_id", F.when(F.col("bare"), F.col("doc_id")).otherwise(F.col("component_id")))
        .withColumn("kept", one_row if row_col else F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(*(["row"] if row_col else []), "doc_id", "n_shingles", "component_id", "kept")
    )
