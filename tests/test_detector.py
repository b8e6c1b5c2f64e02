"""The fitted detector on connections with history, and packets from capture bytes."""

import struct

import pytest
from pyspark.sql import functions as F

from flowlark.operators import forests, fusion
from flowlark.plans.detector import Detector, additivity_gap
from flowlark.plans.queries import hist
from flowlark.session import table
from flowlark.sources import pcap, sinks


@pytest.fixture(scope="module")
def traffic(spark, sf_dir):
    return table(hist(spark, sf_dir))


@pytest.fixture(scope="module")
def fitted(traffic):
    """Trained on some of the connections; the others are scored."""
    det = Detector.fit(traffic.filter("flow_id % 4 <> 0"), trees=10, isolation_trees=20, sample=64, depth=8)
    return det, det.predict(traffic.filter("flow_id % 4 = 0"))


def test_scores_are_in_range_and_useful(fitted, traffic):
    rows = fitted[1].select("category", "attack_prob", "score", "novelty", "fused_score", "is_alert", F.array_max("proba").alias("p")).collect()
    assert len(rows) == traffic.filter("flow_id % 4 = 0").count()
    for r in rows:
        assert 0 <= r.attack_prob <= 1 and 0 < r.score <= 1 and 0 <= r.novelty <= 1 and 0 <= r.fused_score <= 1
    mean = lambda which: sum(r.attack_prob for r in rows if (r.category == "normal") == which) / sum((r.category == "normal") == which for r in rows)
    assert mean(False) > mean(True) + 0.2


def test_accuracy_out_of_the_bag(fitted, traffic):
    det, _ = fitted
    train = traffic.filter("flow_id % 4 <> 0")
    got = det.oob_accuracy(train).first()
    assert got.n_rows == train.count() and got.n_voted > 0.95 * got.n_rows and 0.6 < got.accuracy <= 1  # ten trees: 1 % of the rows are in all bags


def test_contributions_add_up(fitted):
    det, rows = fitted
    assert additivity_gap(det, rows.limit(50)) < 1e-9


def test_explained_alerts(fitted):
    det, rows = fitted
    told = det.explain(fusion.queue(rows).limit(10)).collect()
    assert len(told) == 10
    for r in told:
        assert r.narrative and r.corroboration and r.layers and len(r.supervised.features) <= 5
        weights = [abs(f.contribution) for f in r.supervised.features]
        assert weights == sorted(weights, reverse=True) and sum(r.supervised.class_probabilities.values()) == pytest.approx(1)
        assert r.supervised.attack_probability == pytest.approx(1 - r.supervised.class_probabilities["normal"])
        assert all(f.z == pytest.approx((f.observed - f.benign_mean) / f.benign_sd) and f.weight >= 0 for f in r.anomaly.features)


def test_save_and_load(fitted, traffic, spark, tmp_path):
    det, rows = fitted
    det.save(f"file://{tmp_path}/d")
    again = Detector.load(spark, f"file://{tmp_path}/d")
    assert again.threshold == det.threshold and again.classes == det.classes
    verdicts = lambda d: sorted((r.flow_id, r.attack_prob, r.score, r.novelty, r.category_out) for r in d.collect())
    some = rows.limit(200).select("flow_id")
    test = traffic.join(some, "flow_id", "left_semi")
    assert verdicts(again.predict(test)) == verdicts(det.predict(test)) and again.nodes.count() == det.nodes.count()


def test_isolation_path_lengths():
    assert forests.usual_path(2) == 1.0 and forests.usual_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_fit_needs_benign_rows(traffic):
    with pytest.raises(ValueError):
        Detector.fit(traffic.filter("category <> 'normal'"))


def test_alerts_and_reports_as_json(fitted, spark, tmp_path):
    det, rows = fitted
    told = det.explain(fusion.queue(rows).limit(5))
    sinks.write_alerts(told, f"file://{tmp_path}/alerts")
    back = spark.read.json(f"file://{tmp_path}/alerts").collect()
    assert sorted(r.narrative for r in back) == sorted(r.narrative for r in told.collect())
    content = sinks.report({"importances": det.importances().limit(3), "odd": spark.sql("select double('nan') as x, 1 as y")}, {"source": "events"})
    sinks.write_report(spark, content, f"file://{tmp_path}/report")
    again = sinks.read_report(spark, f"file://{tmp_path}/report")
    assert again["about"] == {"source": "events"} and len(again["importances"]) == 3 and again["odd"] == [{"x": None, "y": 1}]


def frame(src, dst, sport, dport, flags, payload=b""):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, bytes(src), bytes(dst))
    return b"\0" * 12 + b"\x08\x00" + ip + tcp


@pytest.mark.parametrize("order", "<>")
def test_packets_of_a_capture(order):
    a, b = (10, 0, 0, 1), (10, 0, 0, 2)
    raw = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate((frame(a, b, 1000, 80, 2), frame(b, a, 80, 1000, 18), b"\0" * 20)):
        raw += struct.pack(order + "IIII", 100 + i, 500_000, len(f), len(f)) + f
    got = list(pcap.packets(raw + b"\1\2\3"))
    assert [(p[0], p[1], p[2], p[4], p[5], p[7]) for p in got] == [(100.5, "10.0.0.1", "10.0.0.2", 1000, 80, 2), (101.5, "10.0.0.2", "10.0.0.1", 80, 1000, 18)]


def test_detector_of_existing_trees(fitted, traffic):
    """Calibration on the rows of fit() gives the detector of fit()."""
    det, _ = fitted
    again = Detector.around(traffic.filter("flow_id % 4 <> 0"), det.space, det.classes, det.nodes, det.isolation, det.sample)
    assert again.threshold == det.threshold and again.benign_std == pytest.approx(det.benign_std) and again.benign_scores.count() == det.benign_scores.count()
    with pytest.raises(ValueError):
        Detector.around(traffic.filter("category <> 'normal'"), det.space, det.classes, det.nodes, det.isolation, det.sample)


def test_feature_columns_are_kept_by_what_a_frame_has(fitted, traffic):
    space = fitted[0].space
    some = traffic.limit(50).cache()
    whole, fewer = space.transform(some), space.transform(some.drop("hot", "service"))
    assert space.transform(some.withColumn("extra", F.lit(1))).columns == whole.columns
    assert whole.agg(F.max("hot")).first()[0] > 0 and fewer.agg(F.max("hot"), F.max("service_freq")).first()[:] == (0.0, 0.0)


def test_importances_on_other_rows(spark):
    nodes = spark.createDataFrame(
        [(0, 0, 0, 0.5, 1, 2, 4, [0.5, 0.5]), (0, 1, -1, 0.0, -1, -1, 2, [1.0, 0.0]), (0, 2, 1, 0.5, 3, 4, 2, [0.0, 1.0]), (0, 3, -1, 0.0, -1, -1, 1, [0.0, 1.0]), (0, 4, -1, 0.0, -1, -1, 1, [0.0, 1.0])],
        forests.NODES + ", value array<double>",
    )
    rows = spark.createDataFrame([([0.0, 0.0], 0), ([0.0, 1.0], 0), ([1.0, 0.0], 1), ([1.0, 1.0], 0), ([1.0, 1.0], None), ([1.0, 1.0], 7)], "x array<double>, k int")
    got = {r.feature: r.importance for r in forests.importances_on(nodes, rows, F.col("x"), F.col("k"), 2).collect()}
    # root: 4 rows, 3 and 1, 1.5; left pure; right one and one, 1.0; its children pure
    assert got == pytest.approx({0: 0.5 / 1.5, 1: 1.0 / 1.5})
    assert all(r.importance == 0 for r in forests.importances_on(nodes, rows.filter("k > 5"), F.col("x"), F.col("k"), 2).collect())
