"""Captures in byte ranges against a decoder of single frames, and from file to alerts."""

import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowlark.operators import fusion, rules
from flowlark.sources import pcap

FIELDS = "ts src dst proto sport dport length flags icmp_type frag_bad".split()


def ip(proto, src, dst, data, fragment=0, options=0, total=None):
    head = 20 + options
    total = head + len(data) if total is None else total
    return struct.pack(">BBHHHBBH4s4s", 0x40 | head // 4, 0, total, 0, fragment, 64, proto, 0, ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed) + b"\1" * options + data


def tcp(sport, dport, flags, size=0, header=20):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, header // 4 << 4, flags, 0, 0, 0) + b"\0" * (header - 20) + b"E\0" * (size // 2) + b"x" * (size % 2)


def udp(sport, dport, size=0):
    return struct.pack(">HHHH", sport, dport, 8 + size, 0) + b"u" * size


def ether(packet, tags=0, kind=0x0800):
    return b"\0" * 12 + b"\x81\x00\x00\x05" * tags + struct.pack(">H", kind) + packet


def capture(frames, order="<", link=1, nano=False, cut=0):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for t, f in frames:
        out += struct.pack(order + "IIII", int(t), int(t % 1 * (1e9 if nano else 1e6)), len(f), len(f)) + f
    return out[: len(out) - cut]


def test_fields_by_hand():
    a, b = "10.0.0.1", "192.168.7.255"
    cases = [
        (ether(ip(6, a, b, tcp(1000, 80, 0x12, 7))), ("tcp", 1000, 80, 7, 0x12, -1, 0)),
        (ether(ip(6, a, b, tcp(1, 65535, 2, 5, header=32), options=8)), ("tcp", 1, 65535, 5, 2, -1, 0)),
        (ether(ip(17, a, b, udp(53, 5353, 11)), tags=2), ("udp", 53, 5353, 11, 0, -1, 0)),
        (ether(ip(1, a, b, b"\x08\0\0\0" + b"p" * 20)), ("icmp", 0, 0, 16, 0, 8, 0)),
        (ether(ip(47, a, b, b"g" * 9)), ("other", 0, 0, 9, 0, -1, 0)),
        (ether(ip(17, a, b, udp(1, 2, 3), fragment=0x2005)), ("udp", 1, 2, 3, 0, -1, 0)),
        (ether(ip(17, a, b, udp(1, 2, 3), fragment=5)), ("udp", 1, 2, 3, 0, -1, 1)),
        (ether(ip(17, a, b, udp(1, 2, 40), fragment=5)), ("udp", 1, 2, 40, 0, -1, 0)),
        (ether(ip(6, a, b, b"\0" * 13)), ("other", 0, 0, 13, 0, -1, 0)),  # too short for its protocol
        (ether(ip(6, a, b, tcp(7, 8, 1), total=10)), ("tcp", 7, 8, 0, 1, -1, 0)),
    ]
    nothing = [b"", b"\0" * 13, ether(ip(6, a, b, tcp(1, 2, 3)), kind=0x86DD), ether(b"\x60" + b"\0" * 30), ether(ip(6, a, b, b"")[:19]), b"\0" * 12 + b"\x81\x00"]
    frames = [(100 + i / 4, f) for i, f in enumerate([c for c, _ in cases] + nothing)]
    for order, nano in (("<", False), (">", False), ("<", True), (">", True)):
        got = list(pcap.packets(capture(frames, order, nano=nano)))
        assert got == [(100 + i / 4, a, b, *want) for i, (_, want) in enumerate(cases)]
    bare = [(1.0, ip(17, a, b, udp(9, 10)))]
    assert [g[3:6] for g in pcap.packets(capture(bare, link=101))] == [("udp", 9, 10)]
    cooked = [(1.0, b"\0" * 14 + b"\x08\x00" + bare[0][1]), (2.0, b"\0" * 14 + b"\x86\xdd" + bare[0][1]), (3.0, b"\0" * 15)]
    assert [g[0] for g in pcap.packets(capture(cooked, link=113))] == [1.0]
    assert list(pcap.packets(capture(bare, link=999))) == []
    for bad in (b"short", b"\x0a\x0d\x0d\x0a" + b"\0" * 40):
        with pytest.raises(ValueError):
            list(pcap.packets(bad))


def frames(n, seed, most=600):
    rng = random.Random(seed)
    out, t = [], 1000.0
    for _ in range(n):
        t += rng.choice([0.0, 0.25, 0.5])
        a, b = (f"10.0.{rng.randrange(3)}.{rng.randrange(256)}" for _ in range(2))
        size = rng.choice([0, 1, 30, most])
        packet = rng.choice([ip(6, a, b, tcp(rng.randrange(65536), 80, rng.randrange(256), size)), ip(17, a, b, udp(5, 53, size)), ip(1, a, b, b"\3\0\0\0" + b"\0" * size)])
        out.append((t, ether(packet, rng.randrange(2)) if rng.random() < 0.9 else ether(b"v6" * 30, kind=0x86DD)))
    return out


def got(spark, path, **more):
    rows = pcap.read_packets(spark, path, **more).orderBy("file", "pkt_idx").collect()
    by = {}
    for r in rows:
        by.setdefault(r.file.rsplit("/", 1)[1], []).append((r.pkt_idx, *(r[f] for f in FIELDS)))
    return by


def want(raw):
    return [(i, *p) for i, p in enumerate(pcap.packets(raw))]


@pytest.fixture
def ranges(spark):
    """Ranges of 64 kB."""
    key, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key), spark.conf.get(cost)
    spark.conf.set(key, "65536")
    spark.conf.set(cost, "1")
    yield
    spark.conf.set(key, before[0])
    spark.conf.set(cost, before[1])


def test_ranges_give_what_one_pass_gives(spark, tmp_path, ranges):
    raws = {
        "a one.pcap": capture(frames(3000, 1)), "b+2.pcap": capture(frames(1500, 2), ">", nano=True), "c.pcap": capture(frames(400, 3, most=30_000), link=1),
        "d.pcap": capture([]), "e.pcap": capture(frames(500, 5), cut=5), "f.pcap": capture(frames(500, 6), cut=1), "g.pcap": capture(frames(5, 7)) + b"E\0", "h.pcap": capture(frames(5, 7)) + b"\0\0E",
        "i.pcap": capture(frames(2, 8)[:1] + [(1001.0, ether(ip(17, "1.1.1.1", "2.2.2.2", udp(1, 2))) + b"z" * 199_000)] + frames(900, 9)),
    }
    for name, raw in raws.items():
        (tmp_path / name).write_bytes(raw)
    found = got(spark, f"file://{tmp_path}")
    assert pcap._pieces(spark, f"file://{tmp_path}", pcap._heads(spark, f"file://{tmp_path}")).filter("n is not null").count() > 20
    for name, raw in raws.items():
        assert found.get(name, []) == want(raw), name
    assert {k: len(v) for k, v in got(spark, f"file://{tmp_path}/*.pcap", max_packets=7).items()} == {k: min(7, len(want(raw))) for k, raw in raws.items() if want(raw)}


def test_a_capture_of_captures_is_decoded_from_the_front(spark, tmp_path, ranges):
    """Payloads that are captures themselves look like chains of records; the seams tell, and no packet is wrong."""
    inner = capture(frames(150, 3, most=1))[24:]
    raw = capture([(1000.0 + i, ether(ip(17, "1.1.1.1", "2.2.2.2", udp(1, 2) + inner))) for i in range(60)])
    (tmp_path / "x.pcap").write_bytes(raw)
    assert got(spark, f"file://{tmp_path}/x.pcap")["x.pcap"] == want(raw)
    assert len(want(raw)) == 60
    heads = pcap._heads(spark, f"file://{tmp_path}/x.pcap")
    assert not pcap._seams(pcap._pieces(spark, f"file://{tmp_path}/x.pcap", heads), heads).filter("not fits").isEmpty()


def test_errors(spark, tmp_path):
    (tmp_path / "n.txt").write_bytes(b"not a capture, but longer than its header")
    with pytest.raises(ValueError):
        pcap.read_packets(spark, f"file://{tmp_path}/n.txt")
    with pytest.raises(FileNotFoundError):
        pcap.read_packets(spark, f"file://{tmp_path}/none*.pcap")
    (tmp_path / "empty.pcap").write_bytes(capture([]))
    with pytest.raises(ValueError):
        pcap.load_captures(spark, f"file://{tmp_path}/empty.pcap")


def test_capture_to_alerts(spark, tmp_path, ranges):
    """A web session, a lookup, an echo, and a burst of unanswered connection attempts that a rule must find."""
    a, b, c = "10.0.0.1", "10.0.0.2", "10.9.9.9"
    rows = [(0.0, ip(6, a, b, tcp(4000, 80, 2))), (0.1, ip(6, b, a, tcp(80, 4000, 0x12))), (0.2, ip(6, a, b, tcp(4000, 80, 0x10, 300))), (0.3, ip(6, b, a, tcp(80, 4000, 0x18, 1000)))]
    rows += [(0.4, ip(6, a, b, tcp(4000, 80, 0x11))), (0.5, ip(6, b, a, tcp(80, 4000, 0x11))), (0.6, ip(17, a, b, udp(5000, 53, 30))), (0.7, ip(17, b, a, udp(53, 5000, 90))), (0.8, ip(1, a, b, b"\x08\0\0\0" + b"\0" * 56))]
    rows += [(10 + i / 100, ip(6, c, b, tcp(20_000 + i, 80, 2))) for i in range(150)]
    (tmp_path / "s.pcap").write_bytes(capture([(t, ether(p)) for t, p in rows]))
    found = pcap.load_captures(spark, f"file://{tmp_path}/s.pcap").orderBy("flow_id").collect()
    assert len(found) == 153 and [r.flow_id for r in found] == list(range(153))
    web = found[0]
    assert (web.src_ip, web.dst_ip, web.dst_port, web.service, web.flag.lower(), web.src_bytes, web.dst_bytes) == (a, b, 80, "http", "sf", 300.0, 1000.0) and web.duration == pytest.approx(0.5)
    assert (found[1].protocol_type, found[1].src_bytes, found[1].dst_bytes) == ("udp", 30.0, 90.0) and found[2].protocol_type == "icmp"
    last = found[-1]
    assert last.flag.lower() == "s0" and last["count"] >= 99 and last.serror_rate == pytest.approx(1.0) and web["count"] == 0
    told = rules.with_hits(pcap.load_captures(spark, f"file://{tmp_path}/s.pcap")).withColumns(
        {"attack_prob": F.lit(0.1), "novelty": F.lit(0.0), "supervised_category": F.lit("normal"), "supervised_alert": F.lit(False), "anomaly_alert": F.lit(False)}
    )
    alerts = fusion.queue(fusion.fuse(told)).collect()
    assert len(alerts) >= 50 and {r.src_ip for r in alerts} == {c} and all(r.category_out == "dos" for r in alerts)
