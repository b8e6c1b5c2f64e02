"""Operator 7: sharding by vector bin packing over bytes, tokens and rows.

Groups of equal texts stay together unless one is larger than a part of a shard; then it is divided by row. Items, largest
first, go where the dot product of their vector with the residual capacity is highest, among the shards that have room
for all three resources. Every group that matters is an item of its own: those above a fixed share of any resource, of
which there can be only so many. The tail of smaller groups is gathered by hash in a fixed number of cells, of several
sizes so that the smallest fill what the large items leave; they are items too. So the driver sees a bounded table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlark.llm.common import cut, documents, free

#: Cells of each size class of the tail: (number of cells, share of the groups).
CLASSES = ((2048, 0.8), (1024, 0.17), (1024, 0.025), (1024, 0.005))
#: A group with more than this share of all bytes, tokens or rows is an item of its own: 3 * 5000 groups at most.
OWN = 1 / 5000
#: Rows of a group larger than a shard are dealt over items of this part of a shard.
PART = 1 / 64


def place(vectors: np.ndarray, shards: int, moves: int = 4000) -> np.ndarray:
    """Shard of each row of ``vectors`` (items by bytes, tokens, rows).

    Items go by their largest share of a resource. Among the shards with room for all of an item, it goes where the dot
    product of its vector with the residual capacity is highest (both in units of the capacity); if none has room, where
    the overflow is least. Then single items are moved while that lessens the sum of squared deviations, in which bytes
    weigh most.
    """
    total = vectors.sum(axis=0).astype(float)
    unit = np.where(total > 0, total / shards, 1.0)
    scaled = vectors / unit
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -scaled.max(axis=1, initial=0))):
        fits = (residual >= scaled[i] - 1e-12).all(axis=1)
        score = np.where(fits, residual @ scaled[i], -np.inf) if fits.any() else -np.maximum(scaled[i] - residual, 0).sum(axis=1)
        out[i] = best = int(score.argmax())
        residual[best] -= scaled[i]
    weight = np.array([20.0, 1.0, 1.0])[: vectors.shape[1]]
    stuck = np.zeros(shards, bool)
    for _ in range(moves if len(vectors) else 0):
        off = np.where(stuck, -1.0, residual**2 @ weight)
        one = int(off.argmax())
        if off[one] <= 1e-9:
            break
        # change of the weighted squares when an item leaves its shard, and when it comes to another
        leave = ((2 * residual[out] + scaled) * scaled) @ weight
        if residual[one] @ weight < 0:
            own = np.flatnonzero(out == one)
            gain = leave[own, None] + ((scaled[own, None, :] - 2 * residual) * scaled[own, None, :]) @ weight
            gain[:, one] = 0.0
            at = int(gain.argmin()) if gain.size else 0
            best, item, to = (gain.flat[at], own[at // shards], at % shards) if gain.size else (0.0, 0, one)
        else:
            gain = np.where(out == one, 0.0, leave + ((scaled - 2 * residual[one]) * scaled) @ weight)
            item, to = int(gain.argmin()), one
            best = gain[item]
        if best > -1e-9:
            stuck[one] = True
            continue
        for s, sign in ((out[item], 1), (to, -1)):
            residual[s] += sign * scaled[item]
            stuck[s] = False
        out[item] = to
    return out


def shard(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row for each row of ``df``.

    The law is ``bytes``: sizes (UTF-8 bytes of the text plus 16) are near equal; tokens (words) and rows are balanced
    along. grown_shard is null. Null texts count no bytes and are a group of their own, apart from empty ones. Slots
    run from 0 in each shard without gaps. Rows that repeat, even wholly, each have a slot; null doc_ids come first in
    their item; an empty table gives an empty table.
    """
    text = F.col("text")
    rows = documents(df, id_col=id_col, text_col=text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).alias("text_crc32"),
        F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\n\\x0B\f\r]+"), lambda w: w != "")).alias("tokens"),
        F.md5(F.coalesce(F.encode(text, "UTF-8"), F.unhex(F.lit("ff")))).alias("group_id"),  # byte ff is in no UTF-8 text
    )
    rows = cut(rows.withColumn("num", F.monotonically_increasing_id()))
    groups = cut(rows.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.sum("tokens").alias("t")))
    total = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "btn")).first()
    share = F.greatest(*(F.col(c) / F.lit(float(max(total[c], 1))) for c in "btn"))
    # a group larger than a shard is divided; all others, whatever their size, stay whole
    parts = F.when((share * shards > 1) & (F.col("n") > 1), F.ceil(share * shards / PART)).otherwise(1).cast("int")
    own = groups.filter(share > OWN).select("group_id", parts.alias("parts"))
    own = own.withColumn("own", (F.row_number().over(Window.orderBy("group_id")) - 1).cast("long"))  # at most 3 / OWN rows
    turn = F.pmod(F.xxhash64("group_id"), F.lit(1_000_000)) / 1_000_000.0
    within = F.pmod(F.xxhash64("group_id", F.lit(1)), F.lit(1 << 31))
    cell, base, upto = None, 0, 0.0
    for n, part in CLASSES:
        upto += part
        mine = (F.lit(base) + F.pmod(within, F.lit(n))).cast("long")
        cell = F.when(turn < upto, mine) if cell is None else cell.when(turn < upto, mine)
        base += n
    cell = cell.otherwise(mine)
    many = 1 << 20  # more than a group can have parts
    piece = F.lit(base) + F.col("own") * many + F.pmod(F.xxhash64("num"), F.col("parts"))
    placed = rows.join(F.broadcast(own), "group_id", "left").withColumn("item", F.coalesce(piece, cell))
    placed = cut(placed.select("doc_id", "size", "text_crc32", "tokens", "item"))
    free(rows, groups)
    sums = placed.groupBy("item").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).orderBy("item").collect()
    to = place(np.array([[r["b"], r["t"], r["n"]] for r in sums], dtype=float).reshape(-1, 3), shards)
    first, plan = [0] * shards, {}
    for r, s in zip(sums, to.tolist(), strict=True):
        plan[r["item"]] = (s, first[s])
        first[s] += r["n"]
    rows, spans = numbered(placed)
    slots = df.sparkSession.createDataFrame([(part, item, plan[item][0], plan[item][1] + start) for part, item, start in spans], "_part int, item long, shard int, start long")
    return rows.join(F.broadcast(slots), ["_part", "item"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("_at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def numbered(placed: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The rows in order of item and doc_id with _part and _at, and for each item in each part what to add to _at for the place in
    the item, from 0. Ranges cut an item of any size; there are at most as many (part, item) as items and parts together."""
    order = ["item", "doc_id", "text_crc32", "size", "_tie"]
    rows = placed.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before: dict[int, int] = {}
    spans = []
    for r in rows.groupBy("_part", "item").agg(F.min("_at").alias("least"), F.count("*").alias("n")).orderBy("_part", "item").collect():
        spans.append((r["_part"], r["item"], before.get(r["item"], 0) - r["least"]))
        before[r["item"]] = before.get(r["item"], 0) + r["n"]
    return rows, spans
