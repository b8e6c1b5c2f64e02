"""One report on fitted models against counts by hand, and its way through storage."""

import math

import pytest

from flowlark import fixed
from flowlark.plans import report
from flowlark.plans.detector import Detector
from flowlark.plans.queries import hist
from flowlark.session import table
from flowlark.sources import records, sinks


@pytest.fixture(scope="module")
def split(spark, sf_dir):
    rows = table(records.stratified_split(hist(spark, sf_dir), 0.3, 7))
    train, test = (table(rows.filter("is_test" if t else "not is_test").drop("is_test")) for t in (False, True))
    det = Detector.fit(train.filter("label <> 'apache2'"), trees=8, isolation_trees=10, sample=64, depth=8)
    return det, train.filter("label <> 'apache2'"), test


def test_stages_see_all_rows_and_change_nothing(split):
    det, _, test = split
    rows, times = report.staged(det, test)
    got = times.collect()
    assert [r.stage for r in got] == [*fixed.LAYERS, "fusion"] and all(r.rows == test.count() and r.seconds > 0 for r in got)
    assert got[-1].alerts == rows.filter("is_alert").count()
    verdict = ("flow_id", "attack_prob", "score", "novelty", "fused_score", "category_out")
    assert sorted(rows.select(*verdict).collect()) == sorted(det.predict(test).select(*verdict).collect())


def test_report(split, spark, tmp_path):
    det, train, test = split
    content = report.run(det, train, test, {"source": "events"}, capture=f"file://{tmp_path}/none.pcap", path=f"file://{tmp_path}/report")
    assert sinks.read_report(spark, f"file://{tmp_path}/report")["ablation"] == content["ablation"]
    assert content["about"]["families_absent_from_training"] == ["apache2"] and "no files" in content["about"]["scenario_6_error"]
    rows = det.predict(test).collect()
    attacks = [r for r in rows if r.category != "normal"]
    hybrid = next(r for r in content["ablation"] if r["config"] == "hybrid")
    assert (hybrid["tp"], hybrid["fn"]) == (sum(r.is_alert for r in attacks), sum(not r.is_alert for r in attacks))
    assert hybrid["fp"] + hybrid["tn"] == len(rows) - len(attacks)
    right = sum(r.category == r.supervised_category for r in rows)
    assert content["multiclass"][0]["accuracy"] == pytest.approx(right / len(rows))
    pairs = [(a.attack_prob > b.attack_prob) + (a.attack_prob == b.attack_prob) / 2 for a in attacks for b in rows if b.category == "normal"]
    area = next(r["auc"] for r in content["auc"] if r["layer"] == "supervised")
    assert area == pytest.approx(sum(pairs) / len(pairs)) and area > 0.6
    gap = content["scenario_5.gap"][0]
    unseen = [r.is_alert for r in attacks if r.label == "apache2"]
    assert gap["unseen_recall"] == pytest.approx(sum(unseen) / len(unseen)) and gap["worst_family"] == "apache2"
    dos = [r for r in rows if r.is_alert and r.category == "dos"]
    queue = content["scenario_3.queue"][0]
    assert queue["alerts"] == len(dos) and queue["signatures"] == len({(tuple(r.hits), r.service, r.flag) for r in dos})
    assert [r["stage"] for r in content["scenario_3.stages"]] == [*fixed.LAYERS, "fusion"]
    fired = {}
    for r in rows:
        if r.category == "probe":
            for h in r.hits:
                fired[h] = fired.get(h, 0) + 1
    top = sorted(fired, key=lambda h: (-fired[h], h))[:3]
    assert {(r["rule"], r["on_category"]) for r in content["scenario_2.overlap"]} == {(h, fired[h]) for h in top}
    assert all(len(content[k]) <= 101 for k in ("roc_anomaly", "roc_supervised", "pr_hybrid")) and len(content["example_true_positive"]) == 3
    wrong = [r for r in rows if r.is_alert and r.category == "normal"]
    best = sorted(wrong, key=lambda r: (-r.fused_score, r.flow_id))[:3]
    assert [r["flow_id"] for r in content["scenario_1.examples"]] == [r.flow_id for r in best]
    assert all(v is None or not isinstance(v, float) or math.isfinite(v) for r in content["rule_coverage"] for v in r.values())
