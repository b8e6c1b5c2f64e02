"""Fusion of the three layers into one ranked alert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark import fixed


def band(score: Column) -> Column:
    out = F
    for least, name in fixed.BANDS:
        out = out.when(score >= least, name)
    return out.otherwise("low")


def fuse(df: DataFrame, percentile: float = fixed.ANOMALY_PERCENTILE) -> DataFrame:
    """Adds layers, is_alert, fused_score, severity, corroboration and category_out to scored rows.

    Needs hits, rule_score, rule_category, attack_prob, supervised_alert, supervised_category, novelty, anomaly_alert.
    Each layer that alerts takes its weighted share of what the others leave (noisy or); a finding of one layer alone
    is discounted.
    """
    q = percentile / 100.0
    above = F.least(F.greatest((F.col("novelty") - q) / max(1e-9, 1 - q), F.lit(0.0)), F.lit(1.0))
    alert = {"signature": F.col("rule_score") > 0, "supervised": F.col("supervised_alert"), "anomaly": F.col("anomaly_alert")}
    strength = {"signature": F.col("rule_score"), "supervised": F.col("attack_prob"), "anomaly": above}
    rest = reduce(
        lambda a, b: a * b,
        (1.0 - F.least(F.greatest(fixed.LAYER_WEIGHT[x] * F.when(alert[x], strength[x]).otherwise(0.0), F.lit(0.0)), F.lit(1.0)) for x in fixed.LAYERS),
    )
    layers = F.filter(F.array(*(F.when(alert[x], x) for x in fixed.LAYERS)), lambda x: x.isNotNull())
    df = df.withColumn("layers", layers)
    n, only = F.size("layers"), F.try_element_at("layers", F.lit(1))
    alone = F
    for name, share in fixed.ALONE.items():
        alone = alone.when((n == 1) & (only == name), share)
    df = df.withColumn("is_alert", n > 0).withColumn("fused_score", (1.0 - rest) * alone.otherwise(1.0))
    return df.withColumns(
        {
            "severity": F.when(F.col("is_alert"), band(F.col("fused_score"))).otherwise("info"),
            "corroboration": corroboration(),
            "category_out": F.when(F.col("rule_score") > 0, F.col("rule_category"))
            .when(F.col("supervised_alert"), F.col("supervised_category"))
            .when(F.col("anomaly_alert"), "unknown")
            .otherwise("normal"),
        }
    )


def corroboration() -> Column:
    """How the layers support each other, in words, with the figures of those that are raised."""
    n, only = F.size("layers"), F.try_element_at("layers", F.lit(1))
    whole = lambda c, of: F.floor(F.col(c) * of).cast("int").cast("string")
    rule = F.concat(F.lit("by rule "), F.concat_ws(", ", "hits"))
    forest = F.concat(F.lit("at an attack probability of "), whole("attack_prob", 100), F.lit(" %"))
    unusual = F.concat(F.lit("more unusual than "), whole("novelty", 1000), F.lit(" in 1000 benign connections"))
    raised = lambda layer, text: F.when(F.array_contains("layers", layer), text)
    figures = F.concat_ws("; ", raised("signature", rule), raised("supervised", forest), raised("anomaly", unusual))
    return (
        F.when(n == 0, "nothing raised by any layer")
        .when(n >= 2, F.concat(F.lit("raised by "), F.concat_ws(" and ", "layers"), F.lit(": "), figures))
        .when(only == "signature", F.concat(F.lit("a rule alone, "), figures, F.lit("; neither model is raised, so the score is lowered")))
        .when(only == "supervised", F.concat(F.lit("the forest alone, "), figures, F.lit("; no rule and no anomaly, so the score is lowered")))
        .otherwise(F.concat(F.lit("an anomaly alone, "), figures, F.lit("; this says least of the three, so the score is lowered most")))
    )


def queue(df: DataFrame, row_id: str = "flow_id") -> DataFrame:
    """Alerts, highest score first, ties in row order."""
    return df.filter("is_alert").orderBy(F.desc("fused_score"), row_id)


def at_least(df: DataFrame, severity: str, column: str = "severity") -> DataFrame:
    return df.filter(F.col(column).isin(fixed.SEVERITY_ORDER[fixed.SEVERITY_ORDER.index(severity) :]))
