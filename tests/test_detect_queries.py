"""The detector over the whole events table, with forests walked in plain Python."""

import bisect
import math

import numpy as np
import pytest

from flowlark import fixed
from flowlark.operators.forests import usual_path
from flowlark.plans.queries import QUERIES, conn, detected, hist


def trees_of(nodes):
    out = {}
    for n in nodes.collect():
        out.setdefault(n.tree, {})[n.node] = n
    return [dict(sorted(t.items())) for t in out.values()]


def leaf(tree, x, inclusive):
    at, depth = next(iter(tree)), 0
    while tree[at].feature >= 0:
        n = tree[at]
        v = x[n.feature]
        at, depth = (n.left if v <= n.threshold and inclusive or v < n.threshold else n.right), depth + 1
    return tree[at], depth


def test_detector_over_all_connections(spark, sf_dir):
    rows = hist(spark, sf_dir)
    det, out = detected(rows, trees=4, isolation_trees=5, sample=64, depth=6)
    x = {r.flow_id: (r.x, r.xs) for r in rows.select("flow_id", det.space.vector(rows).alias("x"), det.space.vector(rows, scaled=True).alias("xs")).collect()}
    forest, isolation, benign = trees_of(det.nodes), trees_of(det.isolation), sorted(r[0] for r in det.benign_scores.collect())
    got, q = out.collect(), fixed.ANOMALY_PERCENTILE / 100
    assert {r.flow_id for r in got} == set(x) and len(got) == conn(spark, sf_dir).count()
    for r in got:
        plain, scaled = x[r.flow_id]
        p = np.mean([np.asarray(leaf(t, plain, True)[0].value) / np.sum(leaf(t, plain, True)[0].value) for t in forest], axis=0)
        assert r.attack_prob == pytest.approx(1 - p[det.classes.index("normal")], abs=1e-6)
        ends = [leaf(t, scaled, False) for t in isolation]
        score = 2.0 ** (-np.mean([d + usual_path(n.size) for n, d in ends]) / usual_path(det.sample))
        assert r.score == pytest.approx(score, abs=1e-9)
        low, high = (f(benign, r.score) / len(benign) for f in (bisect.bisect_left, bisect.bisect_right))
        assert low - 1e-9 <= r.novelty <= high + 1e-9
        s = {"signature": r.rule_score, "supervised": r.attack_prob if r.supervised_alert else 0, "anomaly": min(max((r.novelty - q) / (1 - q), 0), 1) if r.anomaly_alert else 0}
        on = [a for a, b in zip(fixed.LAYERS, (r.rule_score > 0, r.supervised_alert, r.anomaly_alert), strict=True) if b]
        want = 1 - math.prod(1 - min(max(fixed.LAYER_WEIGHT[a] * s[a], 0), 1) for a in fixed.LAYERS)
        assert r.fused_score == pytest.approx(want * (fixed.ALONE[on[0]] if len(on) == 1 else 1), abs=1e-9)
    alerts = out.filter("is_alert")
    assert det.explain(alerts).count() == alerts.count() > 0


def test_detector_queries_are_registered():
    assert {"q_detect", "q_detect_explained"} <= set(QUERIES)


def test_connections_are_explained_once(spark, sf_dir):
    """Both layers' features come from one pass of the trees; they are those that a plain sort of all amounts finds."""
    from flowlark.operators import forests

    plan = QUERIES["q_top_features"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    amounts = np.random.default_rng(3).integers(-3, 4, (200, 9)).astype(float)
    places, found = forests.largest(amounts, 4)
    for row, p, a in zip(amounts, places, found, strict=True):
        assert p.tolist() == sorted(range(9), key=lambda i: (-abs(row[i]), i))[:4] and a.tolist() == row[p].tolist()


def test_evaluated_computes_history_once(spark, sf_dir, monkeypatch):
    """Both parts are read from a table; neither plan counts history again."""
    from flowlark.plans import queries

    class Seen(Exception):
        pass

    def fit(train):
        raise Seen(train)

    monkeypatch.setattr(queries.Detector, "fit", fit)
    with pytest.raises(Seen) as seen:
        QUERIES["q_evaluated"](spark, sf_dir)
    plan = seen.value.args[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Window" not in plan


@pytest.mark.parametrize("name, step", [("q_detect", "fit"), ("q_detect_explained", "fit"), ("q_detect_oob", "oob")])
def test_detection_computes_history_once(spark, sf_dir, monkeypatch, name, step):
    """Models are fitted to a table and applied to it; the history of connections was computed for both."""
    from flowlark.plans import queries

    class Seen(Exception):
        pass

    def seen(train):
        raise Seen(train)

    monkeypatch.setattr(queries.Detector, step, seen)
    with pytest.raises(Seen) as found:
        QUERIES[name](spark, sf_dir)
    plan = found.value.args[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Window" not in plan


def test_accuracy_out_of_the_bag_needs_no_other_model(spark, sf_dir):
    """The supervised forest alone gives what the whole detector does, from features that are stored once."""
    from flowlark.plans.detector import Detector
    from flowlark.session import table

    rows = table(hist(spark, sf_dir))
    det = Detector.fit(rows, trees=3, isolation_trees=2, sample=32, depth=5)
    assert Detector.oob(rows, trees=3, depth=5).collect() == det.oob_accuracy(rows).collect()
    stored = det.space.stored(rows)
    assert "CreateArray" not in (plan := stored.select(det.space.vector(stored))._jdf.queryExecution().optimizedPlan().toString()) and "log1p" not in plan.lower()
