"""Evaluation of verdicts against the truth, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark import fixed


def _n(test: Column) -> Column:
    return F.coalesce(F.sum(test.cast("long")), F.lit(0))


def share(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores() -> dict[str, Column]:
    """Rates from the counts tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
        "fpr": share(fp, fp + tn),
        "fnr": share(fn, fn + tp),
        "accuracy": share(tp + tn, tp + fp + fn + tn),
        "support_positive": tp + fn,
        "support_negative": tn + fp,
    }


def binary(df: DataFrame, truth: Column, verdicts: dict[str, Column], name: str = "config") -> DataFrame:
    """One row of counts and rates for each verdict, from one pass over ``df``."""
    cells = lambda v: {"tp": truth & v, "fp": ~truth & v, "fn": truth & ~v, "tn": ~truth & ~v}
    one = df.agg(*(_n(c).alias(f"{cell}_{i}") for i, v in enumerate(verdicts.values()) for cell, c in cells(v).items()))
    rows = F.array(
        *(
            F.struct(F.lit(v).alias(name), *(F.col(f"{cell}_{i}").alias(cell) for cell in ("tp", "fp", "fn", "tn")))
            for i, v in enumerate(verdicts)
        )
    )
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumns(scores())


def ablation(df: DataFrame, truth: Column) -> DataFrame:
    """The layers alone, together, and two unions."""
    rule, sup, ano = F.col("rule_score") > 0, F.col("supervised_alert"), F.col("anomaly_alert")
    verdicts = {
        "signature_only": rule, "supervised_only": sup, "anomaly_only": ano, "hybrid": F.col("is_alert"),
        "signature_or_supervised": rule | sup, "signature_or_anomaly": rule | ano,
    }
    return binary(df, truth, verdicts)


def confusion(df: DataFrame, true: str, predicted: str, classes: Sequence[str] = tuple(fixed.CATEGORIES)) -> DataFrame:
    """truth, predicted, n for every pair of classes; rows of other true classes are left out."""
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "truth string, predicted string")
    found = df.groupBy(F.col(true).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(found, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """One-vs-rest counts and rates of each class from a confusion matrix."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = matrix.select("truth", "predicted", "n", hit.alias("hit"))
    true = rows.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum("hit").alias("tp"))
    said = rows.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    both = true.join(said, "class").withColumn("all", F.sum("support").over(Window.partitionBy()))
    both = both.withColumns({"fp": F.col("said") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    both = both.withColumn("tn", F.col("all") - F.col("tp") - F.col("fp") - F.col("fn"))
    s = scores()
    return both.select("class", s["precision"].alias("precision"), s["recall"].alias("recall"), s["f1"].alias("f1"), "support", F.col("tp").alias("detected"))


def family_recall(df: DataFrame, novel: Sequence[str] = tuple(fixed.NOVEL)) -> DataFrame:
    """Recall of the hybrid and of each layer for each attack family; category, then most frequent first."""
    mean = lambda c: F.avg(c.cast("double"))
    return (
        df.filter("category <> 'normal'")
        .groupBy(F.col("label").alias("family"))
        .agg(
            F.min("category").alias("category"),
            F.count("*").alias("support"),
            mean(F.col("is_alert")).alias("hybrid_recall"),
            mean(F.col("rule_score") > 0).alias("signature_recall"),
            mean(F.col("supervised_alert")).alias("supervised_recall"),
            mean(F.col("anomaly_alert")).alias("anomaly_recall"),
        )
        .withColumn("in_training", ~F.col("family").isin(list(novel)))
        .orderBy("category", F.desc("support"), "family")
    )


def severity_table(df: DataFrame) -> DataFrame:
    """Alerts of each severity, their precision and their share of the queue."""
    bands = df.filter("is_alert").groupBy("severity").agg(F.count("*").alias("alerts"), _n(F.col("category") != "normal").alias("hits"))
    total = F.sum("alerts").over(Window.partitionBy())  # over four rows at most
    return bands.select("severity", "alerts", share(F.col("hits"), F.col("alerts")).alias("precision"), share(F.col("alerts"), total).alias("share_of_queue"))


def precision_at_k(df: DataFrame, ks: Sequence[int] = (50, 100, 250, 500, 1000, 2000, 5000), row_id: str = "flow_id") -> DataFrame:
    """k, true_positives, precision over the first k alerts of the queue, for each k the queue is long enough for."""
    head = df.filter("is_alert").orderBy(F.desc("fused_score"), row_id).limit(max(ks))
    ranked = head.select((F.col("category") != "normal").cast("long").alias("hit"), F.row_number().over(Window.orderBy(F.desc("fused_score"), row_id)).alias("rank"))
    table = ranked.agg(*(F.sum(F.when(F.col("rank") <= k, F.col("hit"))).alias(f"tp_{k}") for k in ks), F.count("*").alias("n"))
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"tp_{k}").alias("true_positives")) for k in ks))
    return table.select("n", F.explode(rows).alias("r")).select("n", "r.*").filter("k <= n").select("k", "true_positives", (F.col("true_positives") / F.col("k")).alias("precision"))


def curve(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """threshold, tp, fp, tpr, fpr, precision at each distinct score, highest first.

    Ties are one point. Scores are counted first, so the running sums are over distinct scores. They run in ranges of
    scores: each range's sums come from the ranges before it, and no partition holds them all.
    """
    counts = df.groupBy(F.col(score).alias("threshold")).agg(_n(truth).alias("p"), _n(~truth).alias("q"))
    low, high = counts.agg(F.min("threshold"), F.max("threshold")).first()
    if low is None:
        return counts.select("threshold", *(F.lit(0).alias(c) for c in ("tp", "fp")), *(F.lit(0.0).alias(c) for c in ("tpr", "fpr", "precision")))
    width = (high - low) / 1024 or 1.0
    spans = counts.withColumn("span", F.floor((F.lit(high) - F.col("threshold")) / width))
    per = spans.groupBy("span").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))  # at most 1025 rows
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    per = per.select(
        "span", F.coalesce(F.sum("sp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("sq").over(before), F.lit(0)).alias("q0"),
        F.sum("sp").over(all_rows).alias("all_p"), F.sum("sq").over(all_rows).alias("all_q"),
    )
    upto = Window.partitionBy("span").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = spans.join(F.broadcast(per), "span").withColumns({"tp": F.col("p0") + F.sum("p").over(upto), "fp": F.col("q0") + F.sum("q").over(upto)})
    return run.select("threshold", "tp", "fp", share(F.col("tp"), F.col("all_p")).alias("tpr"), share(F.col("fp"), F.col("all_q")).alias("fpr"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def auc(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """Area under the ROC curve: the share of (attack, benign) pairs that the score orders rightly, ties half.

    From the running count of attacks above each distinct score, no neighbouring points need to meet.
    """
    points = curve(df, truth, score)
    counts = df.groupBy(F.col(score).alias("threshold")).agg(_n(truth).alias("p"), _n(~truth).alias("q"))
    both = points.join(counts, "threshold")
    right = F.sum(F.col("q") * ((F.col("tp") - F.col("p")) + F.col("p") / 2.0))
    return both.agg(share(right, F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def macro(classes: DataFrame) -> DataFrame:
    """macro_f1, the plain mean of the classes' F1, and accuracy over all classes, from per_class()."""
    return classes.agg(F.avg("f1").alias("macro_f1"), share(F.sum("detected"), F.sum("support")).alias("accuracy"))


def slice_scores(df: DataFrame, slice_of: Column) -> DataFrame:
    """Connections, attacks, alerts, recall, precision and false-positive rate of each slice."""
    attack, alert = F.col("category") != "normal", F.col("is_alert")
    per = df.groupBy(slice_of.alias("slice")).agg(F.count("*").alias("connections"), _n(attack).alias("attacks"), _n(alert).alias("alerts"), _n(attack & alert).alias("tp"))
    benign, wrong = F.col("connections") - F.col("attacks"), F.col("alerts") - F.col("tp")
    return per.select("slice", "connections", "attacks", "alerts", share(F.col("tp"), F.col("attacks")).alias("recall"), share(F.col("tp"), F.col("alerts")).alias("precision"), share(wrong, benign).alias("fpr"))


def breakdown(alerts: DataFrame) -> DataFrame:
    """kind, name, n: the rows of ``alerts`` by severity, by layer (each layer has a row) and by rule."""
    layers = alerts.agg(*(_n(F.array_contains("layers", x)).alias(x) for x in fixed.LAYERS))
    layers = layers.select(F.explode(F.create_map(*(c for x in fixed.LAYERS for c in (F.lit(x), F.col(x))))).alias("name", "n"))
    severity = alerts.groupBy(F.col("severity").alias("name")).agg(F.count("*").alias("n"))
    rules = alerts.select(F.explode("hits").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    kinds = (("layer", layers), ("severity", severity), ("rule", rules))
    return reduce(DataFrame.union, (d.select(F.lit(k).alias("kind"), "name", "n") for k, d in kinds))


def seen_unseen(df: DataFrame, novel: Sequence[str] = tuple(fixed.NOVEL)) -> DataFrame:
    """seen_recall, unseen_recall, their gap, and the novel family with the least recall (then the most rows)."""
    per = family_recall(df, novel)
    alerts = F.col("hybrid_recall") * F.col("support")
    mean = lambda which: F.try_divide(F.sum(F.when(which, alerts)), F.sum(F.when(which, F.col("support"))))
    novel_row = ~F.col("in_training")
    worst = F.min(F.when(novel_row, F.struct("hybrid_recall", (-F.col("support")).alias("by"), "family")))
    out = per.agg(mean(F.col("in_training")).alias("seen_recall"), mean(novel_row).alias("unseen_recall"), worst.alias("w"))
    return out.select("seen_recall", "unseen_recall", (F.col("seen_recall") - F.col("unseen_recall")).alias("gap"), F.col("w.family").alias("worst_family"))


def gain(df: DataFrame, top: int) -> DataFrame:
    """family, gain: the hybrid's recall less the supervised layer's; the ``top`` largest."""
    return family_recall(df).select("family", (F.col("hybrid_recall") - F.col("supervised_recall")).alias("gain")).orderBy(F.desc("gain"), "family").limit(top)
