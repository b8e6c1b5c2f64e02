"""Operator 13: the trie of conversations' prefixes, by distributed radix partitioning of turn ids.

Turns are dictionary-encoded: equal (role, text) have one id. A bucket holds the conversations that share their first turns,
to begin with all of them. A round takes the buckets that are too large for a task, passes over the turns that all members of a
bucket still share (so long copies take one round, not one a turn), and parts each by the id of the next turn, most significant
first. Buckets of one conversation need no more work; those that fit are each finished in a task by multikey quicksort, which
emits a node whenever a group of equal turns is complete. Sums over subtrees then go up the rounds, bucket by bucket.

A conversation of any length, a turn or a whole conversation that a third of all share: places come from a range partitioning,
joins are by plain keys whose large partitions Spark splits, and what all members of a node contribute is summed, not gathered.
Only SHA-256 over the members that end at a node must run through them in order; it is fed with strings joined beforehand.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.llm.common import arrow_rows, cut, free

#: Turns and members of a bucket that one task finishes.
LOCAL = 1 << 14
#: Conversations of more turns than this have their last nodes dealt over tasks.
_LONG = 1 << 16
#: Members in a string that is joined before it is hashed.
_JOINED = 20_000

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NAMES = [x.split()[0] for x in NODE.split(", ")]
_NOBODY = hashlib.sha256(b"").hexdigest()


def encoded_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), tid, chars for each turn: its place, its dictionary id and its text's code points.

    Turns are ordered by turn, null first; equal turns by a digest of role and text. Null roles and texts are empty.
    Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns each.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    told = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    raw = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), told.alias("digest"), F.length(text).cast("long").alias("chars"))
    raw = cut(raw.filter("conv_id is not null").withColumn("row", F.monotonically_increasing_id()))
    order = ["conv_id", "turn", "digest", "row"]
    rows = cut(raw.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    # a conversation that lies in several partitions begins there after its turns in those before
    edges = rows.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).collect()  # one row a partition
    met = Counter(c for r in edges for c in {r["a"], r["b"]})
    over = df.sparkSession.createDataFrame([(c,) for c, n in met.items() if n > 1], "conv_id long")
    parts = rows.join(F.broadcast(over), "conv_id").groupBy("conv_id", "part").count().orderBy("conv_id", "part").collect()  # two rows a partition at most
    before, plan = {}, []
    for r in parts:
        plan.append((r["conv_id"], r["part"], before.get(r["conv_id"], 0)))
        before[r["conv_id"]] = before.get(r["conv_id"], 0) + r["count"]
    shift = df.sparkSession.createDataFrame(plan, "conv_id long, part int, shift long")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest", "row"))
    placed = rows.withColumn("at", place).join(F.broadcast(shift), ["conv_id", "part"], "left")
    words = cut(raw.groupBy("digest").agg(F.max("chars").alias("chars")).withColumn("tid", F.monotonically_increasing_id()))
    out = cut(placed.drop("chars").join(words, "digest").select("conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("pos"), "tid", "chars"))
    free(raw, rows, words)
    return out


def lengths(turns: DataFrame) -> DataFrame:
    """conv_id, len of conversations with turns."""
    return turns.groupBy("conv_id").agg(F.max("pos").alias("len"))


def rebuilt(turns: DataFrame, span: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin as another one does.

    Conversation c takes the first h turns of conversation c - c % ``span`` as they were (all if it has fewer, none if it
    is absent), then its own after its first h; h is CRC-32 of the decimal c modulo ``most``. A remainder has c's sign, so c
    below zero takes from the multiple nearer to zero. Conversations that are left without turns have length 0.
    """
    of = lambda c: F.pmod(F.crc32(F.encode(F.col(c).cast("string"), "UTF-8")), F.lit(most))
    base = (F.col("conv_id") - F.col("conv_id") % span).alias("base")
    own = cut(lengths(turns))
    heads = own.filter(F.col("conv_id") % span == 0).select(F.col("conv_id").alias("base"), F.col("len").alias("there"))
    info = own.select("conv_id", "len", base, of("conv_id").alias("h")).join(heads, "base", "left")
    info = cut(info.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))  # at most ``span`` conversations share a base
    starts = turns.filter((F.col("conv_id") % span == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), "pos", "tid", "chars")
    first = info.select("conv_id", "base", "taken").join(starts, "base").filter("pos <= taken").select("conv_id", "pos", "tid", "chars")
    rest = turns.join(info.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    out = cut(first.unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "tid", "chars")))
    return out, info.select("conv_id", (F.col("taken") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("len"))


def _hash(members: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, members)).encode()).hexdigest() if members else _NOBODY


def finish(convs: list[int], turns: list[list[int]], chars: dict[int, int], depth: int, parent: int | None, own_chars: int) -> list[tuple]:
    """Nodes of a bucket, its own first: conversations (rising ids) that share ``depth`` turns, and the turns that follow.

    Multikey quicksort: what is left of a group is parted at the turn after its common ones in less, equal and greater; the
    equal ones are a child, whose node is emitted at once; less and greater are parted further at the same turn.
    """
    nodes: list[list] = []  # conv, depth, parent's conv, members, children, leaves, saved, hash, parent's place
    stack = [(list(range(len(convs))), 0, -1, own_chars)]
    while stack:
        group, at, above, last = stack.pop()
        if last >= 0:  # a group that is complete: emit its node; else it belongs to the node above
            place, n = len(nodes), len(group)
            nodes.append([convs[group[0]], depth + at, nodes[above][0] if above >= 0 else parent, n, 0, 0, (n - 1) * last, _NOBODY, above])
            if above >= 0:
                nodes[above][4] += 1
            ended = [m for m in group if len(turns[m]) == at]
            if ended:
                nodes[place][7] = _hash([convs[m] for m in ended])
                group = [m for m in group if len(turns[m]) > at]
            above = place
        if not group:
            continue
        pivot = turns[group[len(group) // 2]][at]
        less, same, more = [], [], []
        for m in group:
            t = turns[m][at]
            (same if t == pivot else less if t < pivot else more).append(m)
        for part in (less, more):
            if part:
                stack.append((part, at, above, -1))
        stack.append((same, at + 1, above, chars[pivot]))
    for node in reversed(nodes):  # children come after their parents
        node[5] = node[5] or 1
        if node[8] >= 0:
            nodes[node[8]][5] += node[5]
            nodes[node[8]][6] += node[6]
    return [tuple(n[:8]) for n in nodes]


def _finished(rows: DataFrame) -> DataFrame:
    """Nodes of the buckets in ``rows`` (round, bucket, conv_id, depth, pmc, top_chars, pos, tid, chars), and whether a node is its bucket's own."""
    columns = ["round", "bucket", "conv_id", "depth", "pmc", "top_chars", "pos", "tid", "chars"]

    def work(batches) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def close() -> None:
            convs, turns, chars = [], [], {}
            for _, _, c, _, _, _, pos, tid, n in held:
                if not convs or convs[-1] != c:
                    convs.append(c)
                    turns.append([])
                if pos is not None:
                    turns[-1].append(tid)
                    chars[tid] = n
            for i, node in enumerate(finish(convs, turns, chars, held[0][3], held[0][4], held[0][5])):
                out.append((*key, i == 0, *node))

        def batch() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 7, pa.string()]
            made = pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["round", "bucket", "top", *_NAMES])
            out.clear()
            return made

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != key:
                    if held:
                        close()
                        held.clear()
                    key = row[:2]
                held.append(row)
            if len(out) > 20_000:
                yield batch()
        if held:
            close()
        yield batch()

    rows = rows.select(*columns).repartition("round", "bucket").sortWithinPartitions("round", "bucket", "conv_id", "pos")
    return rows.mapInArrow(work, "round int, bucket long, top boolean, " + NODE)


def ends_of(members: DataFrame) -> DataFrame:
    """round, bucket, ends_sha256 over the conv_ids of (round, bucket, conv_id), numerically ascending.

    Range partitions join their members' numbers to strings; a bucket's strings pass through one hash in order, none is gathered.
    """

    def join(batches) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            rounds, buckets, convs = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero((rounds[1:] != rounds[:-1]) | (buckets[1:] != buckets[:-1])) + 1
            starts = sorted({0, *cuts.tolist(), *range(0, len(convs), _JOINED)})
            spans = list(zip(starts, [*starts[1:], len(convs)], strict=True))
            text = [",".join(map(str, convs[a:z].tolist())) for a, z in spans]
            at = np.array(starts, np.int64)
            yield pa.record_batch([pa.array(rounds[at], pa.int32()), pa.array(buckets[at], pa.int64()), pa.array(convs[at], pa.int64()), pa.array(text, pa.string())], ["round", "bucket", "least", "joined"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        key = state = None
        out: list[tuple] = []
        for b in batches:
            for r, k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (r, k) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (r, k), hashlib.sha256()
                state.update(text.encode())
        if key is not None:
            out.append((*key, state.hexdigest()))
        yield pa.record_batch([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.string()))], ["round", "bucket", "ends_sha256"])

    order = ["round", "bucket", "conv_id"]
    joined = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "round int, bucket long, least long, joined string")
    return joined.repartition("round", "bucket").sortWithinPartitions("round", "bucket", "least").mapInArrow(run, "round int, bucket long, ends_sha256 string")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def trie(turns: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """A row for each distinct prefix of the conversations ``convs`` (conv_id, len) with ``turns`` (conv_id, pos from 1, tid, chars).

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id (root: null); n_convs, n_children, n_leaves
    (childless nodes of its subtree, itself included); saved_tokens: of its subtree's nodes, members but one times the last
    turn's chars; ends_sha256 of the members without further turns. No conversations: no node, not even the root.
    """
    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("mc")).first()
    spark = turns.sparkSession
    if not total["n"]:
        return spark.createDataFrame([], NODE)
    zero = lambda kind: F.lit(0).cast(kind)
    members = convs.select(zero("long").alias("bucket"), zero("long").alias("depth"), F.lit(total["n"]).cast("long").alias("n"), "conv_id", "len")
    buckets = spark.createDataFrame([(0, 0, total["n"], total["mc"], None, 0)], "bucket long, depth long, n long, mc long, pmc long, top_chars long")
    rounds = []
    while True:
        r = len(rounds)
        rows = cut(members.join(turns, "conv_id").filter("pos > depth").select("bucket", "n", "conv_id", "len", "pos", "tid", "chars"))
        level = cut(rows.groupBy("bucket", "n", "pos").agg(F.count("*").alias("here"), F.min("tid").alias("a"), F.max("tid").alias("b"), F.max("chars").alias("chars")))
        parted = level.filter("here < n or a <> b").groupBy("bucket").agg((F.min("pos") - 1).alias("parted"))
        most = members.groupBy("bucket").agg(F.max("len").alias("most"))
        # all members of a bucket share their turns up to ``common``
        known = cut(buckets.join(most, "bucket").join(parted, "bucket", "left").withColumn("common", F.coalesce("parted", "most")).drop("parted", "most"))
        next_turn = rows.join(known.select("bucket", "mc", "common"), "bucket").filter("pos = common + 1")
        kids = next_turn.groupBy("bucket", "pos", "tid").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("mc"), F.max("mc").alias("pmc"), F.max("chars").alias("top_chars"), F.sum(F.col("len") - F.col("pos")).alias("left")
        )
        kind = F.when(F.col("n") == 1, "single").when(F.col("n") + F.col("left") <= local, "local").otherwise("active")
        kids = cut(kids.withColumns({"kid": F.monotonically_increasing_id(), "kind": kind}))
        moved = next_turn.select("bucket", "tid", "conv_id", "len").join(kids.select("bucket", "pos", "tid", "kid", "kind", "n", "pmc", "top_chars"), ["bucket", "tid"])
        moved = cut(moved.select(F.lit(r).alias("round"), F.col("kid").alias("bucket"), F.col("pos").alias("depth"), "n", "conv_id", "len", "kind", "pmc", "top_chars"))
        ended = members.join(known.select("bucket", "common"), "bucket").filter("len = common").select(F.lit(r).alias("round"), "bucket", "conv_id")
        rounds.append({"known": known, "level": level, "kids": kids, "moved": moved, "ended": ended})
        free(rows)
        buckets = kids.filter("kind = 'active'").select(F.col("kid").alias("bucket"), F.col("pos").alias("depth"), "n", "mc", "pmc", "top_chars")
        if buckets.isEmpty():
            break
        members = moved.filter("kind = 'active'").select("bucket", "depth", "n", "conv_id", "len")
    moved = _union([x["moved"] for x in rounds])
    ends = cut(ends_of(_union([x["ended"] for x in rounds])))
    held = moved.filter("kind = 'local'").alias("m").join(turns.alias("t"), (F.col("m.conv_id") == F.col("t.conv_id")) & (F.col("pos") > F.col("depth")), "left")
    done = cut(_finished(held.select("round", "bucket", "m.conv_id", "depth", "pmc", "top_chars", "pos", "tid", "chars")))
    tops = done.filter("top").select("round", F.col("bucket").alias("kid"), "n_leaves", "saved_tokens")
    out, above = [done.select(*_NAMES), _tails(moved.filter("kind = 'single'"))], None
    for r in range(len(rounds) - 1, -1, -1):
        x = rounds[r]
        sums = tops.filter(F.col("round") == r).drop("round")
        sums = sums if above is None else sums.unionByName(above)
        below = x["kids"].select("bucket", "kid").join(sums, "kid", "left").groupBy("bucket").agg(
            F.count("*").alias("kids"), F.sum(F.coalesce("n_leaves", F.lit(1))).alias("leaves"), F.sum(F.coalesce("saved_tokens", F.lit(0))).alias("below")
        )
        known = x["known"].join(below, "bucket", "left").join(ends.filter(F.col("round") == r).drop("round"), "bucket", "left")
        path = x["level"].select("bucket", "pos", "chars").join(known, "bucket").filter("pos <= common").withColumn("own", F.lit(False))
        path = path.unionByName(known.withColumns({"pos": F.col("depth"), "chars": F.col("top_chars"), "own": F.lit(True)}))
        deeper = Window.partitionBy("bucket").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)  # one row for each shared turn
        last = F.col("pos") == F.col("common")
        nodes = cut(path.select(
            "bucket", "own", F.col("mc").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("own"), F.col("pmc")).otherwise(F.col("mc")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("below", F.lit(0)) + F.sum((F.col("n") - 1) * F.col("chars")).over(deeper)).cast("long").alias("saved_tokens"),
            F.when(last, F.coalesce("ends_sha256", F.lit(_NOBODY))).otherwise(_NOBODY).alias("ends_sha256"),
        ))
        out.append(nodes.select(*_NAMES))
        above = nodes.filter("own").select(F.col("bucket").alias("kid"), "n_leaves", "saved_tokens")
    return _union(out)


def _tails(alone: DataFrame) -> DataFrame:
    """Nodes that a single conversation passes: one for each of its turns from ``depth`` on."""
    step = 1024
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(len - depth) div {step}")))
    parts = alone.select("conv_id", "depth", "len", "pmc", parts.alias("part"))
    long = F.col("len") - F.col("depth") > _LONG
    parts = parts.filter(~long).unionByName(parts.filter(long).repartition("conv_id", "part"))
    first = F.col("depth") + F.col("part") * step
    at: Column = F.explode(F.sequence(first, F.least(first + step - 1, F.col("len"))))
    rows = parts.withColumn("at", at)
    return rows.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("pmc")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (F.col("at") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("at") == F.col("len"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_NOBODY).alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", local: int = LOCAL) -> DataFrame:
    """The trie of conversations as they are; see encoded_turns() for nulls and ties and trie() for the columns."""
    turns = encoded_turns(df, conv_col, turn_col, role_col, text_col)
    return trie(turns, cut(lengths(turns)), local)


def rebuilt_trie(df: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of conversations rebuilt on the first turns of others; see rebuilt()."""
    turns, convs = rebuilt(encoded_turns(df))
    return trie(turns, convs, local)
