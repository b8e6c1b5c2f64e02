"""Bidirectional flows from packets.

A flow ends when its key is silent for over ``timeout`` seconds. Packets are dealt by key and span of time with the
last packets of the span before as context, cut at the gaps and summed; the partial flows of a key that meet at a
span's edge are then joined. However long a flow, its packets are never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlark import fixed
from flowlark.functions.columns import service_of, state_of
from flowlark.operators.history import _dealt
from flowlark.operators.order import with_sequence

_KEY = ["proto", "a_ip", "a_port", "b_ip", "b_port"]


def assemble(packets: DataFrame, timeout: float = 64.0, spans: int = 32) -> DataFrame:
    """Flows of packets (ts, pkt_idx, src, dst, proto, sport, dport, length, flags, icmp_type, frag_bad): src, dst,
    sport, dport, proto, start, end, bytes and packets of either side, fragments, urgent packets, flag bits, icmp_types,
    first_idx. The originator is the source of the first packet, by address."""
    low = (F.col("src") < F.col("dst")) | ((F.col("src") == F.col("dst")) & (F.col("sport") <= F.col("dport")))
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    keyed = packets.withColumns({"a_ip": pick("src", "dst"), "a_port": pick("sport", "dport"), "b_ip": pick("dst", "src"), "b_port": pick("dport", "sport")})
    reach = int(timeout) + 1
    rows = _dealt(keyed, "ts", reach, spans)
    order = Window.partitionBy("_span", *_KEY).orderBy("ts", "pkt_idx")
    before = F.lag("ts").over(order)
    rows = rows.withColumn("_new", (before.isNull() | (F.col("ts") - before > timeout)).cast("int"))
    rows = rows.withColumn("_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_own")
    a_side = F.col("src") == F.col("a_ip")
    add = lambda c, side: F.sum(F.when(side, c).otherwise(0))
    either = lambda side: F.bit_or(F.when(side, F.col("flags")).otherwise(0))
    first = lambda c: F.min_by(c, F.struct("ts", "pkt_idx"))
    parts = rows.groupBy(*_KEY, "_span", "_part").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), first("pkt_idx").alias("first_idx"), first("_new").alias("_new"),
        first("src").alias("src"), first("dst").alias("dst"), first("sport").alias("sport"), first("dport").alias("dport"),
        *(add(F.col("length"), s).alias(f"{n}_bytes") for n, s in (("a", a_side), ("b", ~a_side))),
        *(add(F.lit(1), s).alias(f"{n}_pkts") for n, s in (("a", a_side), ("b", ~a_side))),
        *(either(s).alias(f"{n}_flags") for n, s in (("a", a_side), ("b", ~a_side))),
        F.sum("frag_bad").alias("wrong_fragment"), F.sum((F.col("flags").bitwiseAND(F.lit(fixed.URG)) != 0).cast("int")).alias("urgent"),
        F.collect_set(F.when(F.col("icmp_type") >= 0, F.col("icmp_type"))).alias("icmp_types"),
    )
    along = Window.partitionBy(*_KEY).orderBy("start", "first_idx").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_flow", F.sum("_new").over(along))
    first = lambda c: F.min_by(c, F.struct("start", "first_idx"))
    whole = parts.groupBy(*_KEY, "_flow").agg(
        first("src").alias("src"), first("dst").alias("dst"), first("sport").alias("sport"), first("dport").alias("dport"), F.min("start").alias("start"), F.max("end").alias("end"),
        *(F.sum(c).alias(c) for c in ("a_bytes", "b_bytes", "a_pkts", "b_pkts", "wrong_fragment", "urgent")), *(F.bit_or(c).alias(c) for c in ("a_flags", "b_flags")),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("icmp_types")))).alias("icmp_types"), first("first_idx").alias("first_idx"),
    )
    from_a = F.col("src") == F.col("a_ip")
    side = lambda what, orig: F.when(from_a == orig, F.col(f"a_{what}")).otherwise(F.col(f"b_{what}"))
    return whole.select(
        "src", "dst", "sport", "dport", "proto", "start", "end", side("bytes", True).alias("src_bytes"), side("bytes", False).alias("dst_bytes"),
        side("pkts", True).alias("src_pkts"), side("pkts", False).alias("dst_pkts"), "wrong_fragment", "urgent",
        side("flags", True).alias("orig_flags"), side("flags", False).alias("resp_flags"), "icmp_types", "first_idx",
    )


def sessions(df: DataFrame, gap_us: int, key: str = "src", at: str = "start_us", value: str = "src_bytes", spans: int = 32) -> DataFrame:
    """key, part (from 1), first_us, last_us, n and bytes of runs of a key's rows with at most ``gap_us`` between neighbours.

    As in assemble(), rows are dealt by key and span of time; the runs of a key that meet at the edge of a span are joined
    afterwards, so no task holds all rows of a busy key. A null key is a key; rows without a time are left out.
    """
    rows = _dealt(df.filter(F.col(at).isNotNull()).select(key, at, F.col(value).alias("_value")), at, gap_us + 1, spans)
    order = Window.partitionBy("_span", key).orderBy(at)
    before = F.lag(at).over(order)
    rows = rows.withColumn("_new", (before.isNull() | (F.col(at) - before > gap_us)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_own")
    runs = rows.groupBy(key, "_span", "_run").agg(F.max_by("_new", F.struct(-F.col(at), "_new")).alias("_new"), F.min(at).alias("first_us"), F.max(at).alias("last_us"), F.count("*").alias("n"), F.sum("_value").alias("_value"))
    along = Window.partitionBy(key).orderBy("first_us").rowsBetween(Window.unboundedPreceding, 0)  # one row a run and span
    runs = runs.withColumn("part", F.sum("_new").over(along))
    return runs.groupBy(key, "part").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("n").alias("n"), F.round(F.sum("_value"), 3).alias("bytes"))


def connections(flows: DataFrame, window: float = 2.0, history: int = 100) -> DataFrame:
    """Connection features of flows in order of start (ties by first packet), with src_ip, dst_ip, dst_port and
    start_time. Features that need packet contents are 0."""
    from flowlark.operators.history import with_history

    named = flows.select(
        "*", service_of(F.col("proto"), F.col("dport"), F.col("icmp_types")).alias("service"), state_of(F.col("proto"), F.col("orig_flags"), F.col("resp_flags")).alias("flag")
    ).withColumn("start_us", F.round(F.col("start") * 1e6).cast("long"))
    ordered = with_history(with_sequence(named, "start_us", "first_idx"), int(window * 1e6), history)
    made = {
        "duration": F.round(F.col("end") - F.col("start"), 6), "protocol_type": F.col("proto"), "land": (F.col("src") == F.col("dst")).cast("double"),
        **{c: F.col(c).cast("double") for c in ("src_bytes", "dst_bytes", "wrong_fragment", "urgent")}, "label": F.lit("unknown"),
    }
    full = ordered.withColumns(made)
    rest = {c: F.lit(0.0) for c in fixed.NUMERIC if c not in full.columns}
    full = full.withColumns(rest)
    return full.select(
        F.col("seq").alias("flow_id"), *(c for c in fixed.COLUMNS if c != "difficulty"),
        F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"), F.col("dport").alias("dst_port"), F.col("start").alias("start_time"),
        F.lit("unknown").alias("category"), F.lit(0).alias("is_attack"),
    )
