"""The evaluation report and the scenarios, all from one detection pass over rows that the models have not seen."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowlark import fixed
from flowlark.operators import fusion, metrics, rules
from flowlark.operators.binning import novelty
from flowlark.plans.detector import Detector
from flowlark.session import table
from flowlark.sources import pcap, records, sinks


def attack() -> Column:
    return F.col("category") != "normal"


def staged(det: Detector, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of Detector.predict(), and of each stage its rows, its alerts and the seconds that it took.

    Stages are tables one after the other, so that a time is one stage's own; what a stage has seen is observed as it runs.
    """
    stages = (
        ("signature", rules.with_hits, F.col("rule_score") > 0), ("supervised", det.supervised, F.col("supervised_alert")), ("anomaly", det.anomaly, F.col("anomaly_alert")),
        ("fusion", lambda d: fusion.fuse(novelty(d, det.benign_scores, stored=True), det.percentile), F.col("is_alert")),
    )
    rows, told = df, []
    for name, work, alert in stages:
        seen, began = Observation(f"{name}-{time.monotonic_ns()}"), time.perf_counter()
        rows = table(work(rows).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(alert).alias("alerts")))
        told.append((name, seen.get["rows"], seen.get["alerts"], time.perf_counter() - began))
    times = df.sparkSession.createDataFrame(told, "stage string, rows long, alerts long, seconds double")
    return rows, times.withColumn("rows_per_second", F.try_divide("rows", "seconds"))


def novel_labels(train: DataFrame, test: DataFrame) -> list[str]:
    """Attack labels of the test rows that training lacks; labels are a vocabulary of the domain, not of the rows."""
    return sorted(r["label"] for r in records.novel_families(train, test).collect())


def rule_counts(rows: DataFrame) -> DataFrame:
    """rule, n: on how many rows each rule fired."""
    return rows.select(F.explode("hits").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def rule_overlap(rows: DataFrame, category: str = "probe", top: int = 3) -> DataFrame:
    """rule, on_category, on_benign: the rules that fire most on a category, and how often the same fire on benign rows."""
    most = rule_counts(rows.filter(F.col("category") == category)).orderBy(F.desc("n"), "rule").limit(top).withColumnRenamed("n", "on_category")
    return most.join(rule_counts(rows.filter(~attack())), "rule", "left").select("rule", "on_category", F.coalesce("n", F.lit(0)).alias("on_benign"))


def rules_strongest(rows: DataFrame, categories: Sequence[str] = ("r2l", "u2r")) -> DataFrame:
    """category, families, rules_strongest: in how many families the rules recall more than either model."""
    per = metrics.family_recall(rows.filter(F.col("category").isin(list(categories))))
    strongest = F.col("signature_recall") > F.greatest("supervised_recall", "anomaly_recall")
    return per.groupBy("category").agg(F.count("*").alias("families"), F.count_if(strongest).alias("rules_strongest"))


def weak_families(rows: DataFrame, category: str = "dos", least: int = 10, below: float = 0.9, top: int = 3) -> DataFrame:
    per = metrics.family_recall(rows.filter(F.col("category") == category)).select("family", "support", F.col("hybrid_recall").alias("recall"))
    return per.filter((F.col("support") >= least) & (F.col("recall") < below)).orderBy("recall", "family").limit(top)


def signatures(rows: DataFrame, category: str = "dos") -> DataFrame:
    """alerts, signatures (distinct rules, service and state), all_alerts, share of all alerts that are of the category."""
    mine = F.col("category") == category
    what = F.struct(F.concat_ws(",", "hits"), "service", "flag")
    out = rows.filter("is_alert").agg(F.count_if(mine).alias("alerts"), F.countDistinct(F.when(mine, what)).alias("signatures"), F.count("*").alias("all_alerts"))
    return out.withColumn("share_of_all_alerts", metrics.share(F.col("alerts"), F.col("all_alerts")))


def by_source(rows: DataFrame, source: str = "src_ip") -> DataFrame:
    """flows, alerts, alert_rate and top_severity of each source."""
    rank = F.array_position(F.lit(fixed.SEVERITY_ORDER), F.col("severity"))
    return rows.groupBy(source).agg(
        F.count("*").alias("flows"), F.count_if("is_alert").alias("alerts"), F.avg(F.col("is_alert").cast("int")).alias("alert_rate"),
        F.coalesce(F.max_by("severity", F.when(F.col("is_alert"), rank)), F.lit("none")).alias("top_severity"),
    )


def search(rows: DataFrame, text: str) -> DataFrame:
    """Alerts of which the nine fields that are searched hold ``text``, in either case: addresses, service, state, category,
    truth, rules, layers and what the forest says, one after the other."""
    src, dst = ("src_ip", "dst_ip") if "src_ip" in rows.columns else ("src", "dst")
    shown = F.concat_ws(" ", src, dst, "service", "flag", "category_out", "category", F.concat_ws(" ", "hits"), F.concat_ws(" ", "layers"), "supervised_category")
    return rows.filter(F.col("is_alert") & F.contains(F.lower(shown), F.lit(text.lower())))


def thinned(points: DataFrame, x: str, y: str) -> DataFrame:
    """The highest ``y`` for each hundredth of ``x``: 101 points of a curve of any length."""
    return points.groupBy((F.floor(F.col(x) * 100) / 100).alias(x)).agg(F.max(y).alias(y)).orderBy(x)


def examples(det: Detector, rows: DataFrame, each: int = 3) -> dict[str, DataFrame]:
    """Explained records: the surest right and wrong alerts, and the attacks without an alert that came nearest to one."""
    missed = rows.filter(attack() & ~F.col("is_alert")).orderBy(F.desc("novelty"), "flow_id").limit(each)
    best = lambda which: fusion.queue(rows.filter(which)).limit(each)
    return {"true_positive": det.explain(best(attack())), "false_positive": det.explain(best(~attack())), "false_negative": det.explain(missed)}


def evaluation(det: Detector, rows: DataFrame, novel: Sequence[str], each: int = 3) -> dict[str, DataFrame]:
    """The tables of the report on verdicts (rows of predict()) with their truth."""
    classes = metrics.per_class(metrics.confusion(rows, "category", "supervised_category"))
    scores = {"anomaly": "score", "supervised": "attack_prob", "hybrid": "fused_score"}
    areas = [metrics.auc(rows, attack(), c).select(F.lit(k).alias("layer"), "auc") for k, c in scores.items()]
    return {
        "ablation": metrics.ablation(rows, attack()), "confusion": metrics.confusion(rows, "category", "supervised_category"), "per_class": classes, "multiclass": metrics.macro(classes),
        "families": metrics.family_recall(rows, novel), "severity": metrics.severity_table(rows), "precision_at_k": metrics.precision_at_k(rows), "auc": reduce(DataFrame.union, areas),
        "roc_anomaly": thinned(metrics.curve(rows, attack(), "score"), "fpr", "tpr"), "roc_supervised": thinned(metrics.curve(rows, attack(), "attack_prob"), "fpr", "tpr"),
        "pr_hybrid": thinned(metrics.curve(rows, attack(), "fused_score"), "tpr", "precision"), "rule_coverage": rules.coverage(rows), "queue": metrics.breakdown(rows.filter("is_alert")),
        "importances": det.importances().limit(20), **{f"example_{k}": v for k, v in examples(det, rows, each).items()},
    }


def scenarios(det: Detector, rows: DataFrame, novel: Sequence[str], times: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five scenarios' tables, by number and name, from one set of verdicts."""
    of = lambda *c: rows.filter(F.col("category").isin(*c))
    wrong, probe, dos, rare = rows.filter(~attack() & F.col("is_alert")), of("probe"), of("dos"), of("r2l", "u2r")
    per = metrics.family_recall(rows, novel)
    worst = metrics.seen_unseen(rows, novel)
    near = rows.filter(attack() & ~F.col("is_alert")).join(F.broadcast(worst), F.col("label") == F.col("worst_family"), "left_semi").orderBy(F.desc("novelty"), "flow_id").limit(2)
    out = {
        "1.scores": metrics.slice_scores(rows.filter(~attack()), F.lit("normal")), "1.false_positives": metrics.breakdown(wrong), "1.examples": det.explain(fusion.queue(wrong).limit(3)),
        "2.scores": metrics.slice_scores(probe, F.lit("probe")), "2.families": metrics.family_recall(probe, novel), "2.rules": rule_counts(probe), "2.overlap": rule_overlap(rows),
        "3.scores": metrics.slice_scores(dos, F.lit("dos")), "3.families": metrics.family_recall(dos, novel), "3.queue": signatures(rows), "3.weakest": weak_families(rows),
        "4.scores": metrics.slice_scores(rare, F.col("category")), "4.families": metrics.family_recall(rare, novel), "4.gain": metrics.gain(rare, 3), "4.rules_strongest": rules_strongest(rows),
        "5.gap": worst, "5.families": per.filter(~F.col("in_training")).orderBy("hybrid_recall", F.desc("support"), "family"), "5.near_misses": det.explain(near),
    }
    return out | ({"3.stages": times} if times is not None else {})


def capture_scenario(det: Detector, spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """From a capture's packets to its queue: flows by source, rules of each source, the stages' times, and the first alerts explained."""
    rows, times = staged(det, table(pcap.load_captures(spark, path)))
    fired = rows.filter("is_alert").select("src_ip", F.explode("hits").alias("rule")).groupBy("src_ip", "rule").agg(F.count("*").alias("n"))
    return {
        "6.sources": by_source(rows).orderBy(F.desc("alerts"), "src_ip").limit(1000), "6.rules": fired.orderBy(F.desc("n"), "src_ip", "rule").limit(1000), "6.stages": times,
        "6.queue": metrics.breakdown(rows.filter("is_alert")), "6.examples": det.explain(fusion.queue(rows).limit(2)),
    }


def run(det: Detector, train: DataFrame, test: DataFrame, about: dict | None = None, capture: str | None = None, path: str | None = None) -> dict:
    """The whole report as one document: data, evaluation, scenarios 1 to 5 and, with a ``capture``, 6; written to ``path`` if given.

    All of it comes from one detection pass over ``test``. A capture that cannot be read is reported, not raised.
    """
    spark, novel = test.sparkSession, novel_labels(train, test)
    rows, times = staged(det, test)
    tables = {"train_categories": records.category_counts(train), "test_categories": records.category_counts(test), "performance": times}
    tables |= evaluation(det, rows, novel) | {f"scenario_{k}": v for k, v in scenarios(det, rows, novel, times).items()}
    about = {"families_absent_from_training": novel, **(about or {})}
    if capture:
        try:
            tables |= {f"scenario_{k}": v for k, v in capture_scenario(det, spark, capture).items()}
        except (ValueError, FileNotFoundError) as e:
            about["scenario_6_error"] = str(e)
    content = sinks.report(tables, about)
    if path:
        sinks.write_report(spark, content, path)
    return content
