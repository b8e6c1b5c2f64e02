"""The detector: features, rules, supervised forest, isolation forest and fusion as one fitted object."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark import fixed
from flowlark.operators import forests, fusion, histogram, rules
from flowlark.operators.binning import novelty, quantiles
from flowlark.operators.features import STORED, FeatureSpace
from flowlark.session import table

IDENTITY = "src_ip dst_ip dst_port start_time protocol_type service flag duration src_bytes dst_bytes count srv_count".split()


@dataclass
class Detector:
    space: FeatureSpace
    classes: list[str]
    nodes: DataFrame  # of the supervised forest
    isolation: DataFrame  # nodes of the isolation forest
    benign_scores: DataFrame
    sample: int
    threshold: float
    benign_mean: list[float]
    benign_std: list[float]
    percentile: float = fixed.ANOMALY_PERCENTILE
    seed: int = fixed.SEED

    @classmethod
    def fit(cls, train: DataFrame, trees: int = 120, isolation_trees: int = 150, sample: int = 256, seed: int = fixed.SEED, depth: int = 20, benign: Column | None = None) -> Detector:
        """Fits all layers to rows with flow_id and category. Benign rows (category normal, or ``benign``) must be 50 or
        more; the feature space and the forest see all rows, the isolation forest benign ones only."""
        train = table(train)
        benign_rows = train.filter(F.col("category") == "normal" if benign is None else benign)
        if benign_rows.limit(50).count() < 50:
            raise ValueError("at least 50 benign rows are needed")
        space, train, classes, nodes = cls._forest(train, trees, seed, depth)
        space.scale(train)
        benign_rows = train.filter(F.col("category") == "normal" if benign is None else benign)
        isolation = forests.fit_isolation(benign_rows, space.vector(benign_rows, scaled=True), isolation_trees, sample, seed)
        return cls.around(train, space, classes, nodes, isolation, min(sample, benign_rows.count()), seed, benign)

    @classmethod
    def _forest(cls, train: DataFrame, trees: int, seed: int, depth: int) -> tuple[FeatureSpace, DataFrame, list[str], DataFrame]:
        """The feature space without its scale, the rows with stored features, the classes and the supervised forest."""
        space = FeatureSpace.worded(train)
        train = space.stored(train)
        weights = forests.class_weights(train, "category")
        classes = sorted(weights)
        nodes = histogram.fit(train, "flow_id", space.vector(train), cls._label(classes), [weights[c] for c in classes], len(fixed.FEATURES), trees, depth, seed=seed)
        forests.shared(nodes)  # a fitted model is ready to use
        return space, train, classes, nodes

    @classmethod
    def oob(cls, train: DataFrame, trees: int = 120, seed: int = fixed.SEED, depth: int = 20) -> DataFrame:
        """oob_accuracy() of a detector fitted to ``train``, of which only the supervised forest is needed."""
        space, train, classes, nodes = cls._forest(table(train), trees, seed, depth)
        return histogram.oob_accuracy(train, "flow_id", space.vector(train), cls._label(classes), nodes, seed)

    @classmethod
    def around(
        cls, train: DataFrame, space: FeatureSpace, classes: list[str], nodes: DataFrame, isolation: DataFrame, sample: int, seed: int = fixed.SEED, benign: Column | None = None
    ) -> Detector:
        """A detector of node tables that exist, calibrated on the benign rows of ``train``: their scores, the threshold that one
        in a hundred of them reaches, and mean and deviation of their features. ``sample`` is the size of the isolation trees' samples."""
        benign_rows = train.filter(F.col("category") == "normal" if benign is None else benign)
        score = forests.isolation_score(isolation, sample)
        scores = table(benign_rows.select(score(space.vector(benign_rows, scaled=True)).alias("score")))
        threshold = quantiles(scores, [F.col("score")], [fixed.ANOMALY_PERCENTILE / 100])[0]
        if not threshold:
            raise ValueError("no benign rows")
        raw = space.transform(benign_rows).agg(*(f(c).alias(f"{k}{c}") for c in fixed.FEATURES for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        std = [s if (s := raw[f"s{c}"]) >= 1e-12 else 1.0 for c in fixed.FEATURES]
        return cls(space, classes, nodes, isolation, scores, sample, threshold[0], [raw[f"m{c}"] for c in fixed.FEATURES], std, seed=seed)

    @staticmethod
    def _label(classes: list[str]) -> Column:
        return F.array_position(F.lit(classes), F.col("category")).cast("int") - 1

    def oob_accuracy(self, train: DataFrame) -> DataFrame:
        """n_rows, n_voted, n_right, accuracy of the forest on the rows that it was fitted to, each by the trees that did not see it."""
        return histogram.oob_accuracy(train, "flow_id", self.space.vector(train), self._label(self.classes), self.nodes, self.seed)

    def supervised(self, df: DataFrame) -> DataFrame:
        """Adds the forest's proba, attack_prob, supervised_category and supervised_alert."""
        out = df.withColumn("proba", forests.node_probabilities(self.nodes)(self.space.vector(df)))
        normal = self.classes.index("normal") if "normal" in self.classes else -1
        attack = 1.0 - F.col("proba")[normal] if normal >= 0 else F.array_max("proba")
        best = F.array_position("proba", F.array_max("proba")).cast("int")
        out = out.withColumns({"supervised_category": F.element_at(F.array(*map(F.lit, self.classes)), best), "attack_prob": attack})
        return out.withColumn("supervised_alert", F.col("attack_prob") >= fixed.SUPERVISED_THRESHOLD)

    def anomaly(self, df: DataFrame) -> DataFrame:
        """Adds the isolation forest's score and anomaly_alert."""
        out = df.withColumn("score", forests.isolation_score(self.isolation, self.sample)(self.space.vector(df, scaled=True)))
        return out.withColumn("anomaly_alert", F.col("score") >= self.threshold)

    def score(self, df: DataFrame) -> DataFrame:
        """Rule, forest and isolation results for each row (flow_id and connection features)."""
        return self.anomaly(self.supervised(rules.with_hits(self.space.stored(df)))).drop(STORED)

    def predict(self, df: DataFrame) -> DataFrame:
        """Scored and fused rows. They are a table: models run once, however the result is used."""
        return fusion.fuse(novelty(self.score(df), self.benign_scores), self.percentile)

    def explain(self, alerts: DataFrame, top: int = 5) -> DataFrame:
        """The explained record of each row of ``alerts`` (rows of predict(), filtered and limited before)."""
        x, xs = self.space.vector(alerts), self.space.vector(alerts, scaled=True)
        klass = F.array_position(F.lit(self.classes), F.col("supervised_category")).cast("int") - 1
        rows = alerts.withColumns({"_x": x, "_k": klass, "_c": forests.top_contributions(self.nodes, len(self.classes), top)(x, klass), "_w": forests.top_weights(self.isolation, top)(xs)})
        names, groups, meanings = (F.array(*map(F.lit, v)) for v in (fixed.FEATURES, [*map(fixed.group_of, fixed.FEATURES)], [*map(fixed.meaning_of, fixed.FEATURES)]))
        mean, std = (F.array(*map(F.lit, v)) for v in (self.benign_mean, self.benign_std))
        at = lambda a, i: F.get(a, i)
        supervised = F.struct(
            F.col("supervised_category").alias("predicted"), F.get("proba", F.col("_k")).alias("probability"), F.col("attack_prob").alias("attack_probability"),
            F.map_from_arrays(F.lit(self.classes), F.col("proba")).alias("class_probabilities"),
            F.zip_with("_c.places", "_c.amounts", lambda i, share: F.struct(
                at(names, i).alias("feature"), at(groups, i).alias("group"), share.alias("contribution"), F.get("_x", i).alias("observed"),
                F.when(share > 0, "raises").otherwise("lowers").alias("direction"), at(meanings, i).alias("meaning"))).alias("features"),
        )
        anomaly = F.struct(
            "score", F.lit(self.threshold).alias("threshold"), F.col("novelty").alias("more_unusual_than"), F.col("anomaly_alert").alias("alerted"),
            F.zip_with("_w.places", "_w.amounts", lambda i, weight: F.struct(
                at(names, i).alias("feature"), at(groups, i).alias("group"), weight.alias("weight"), F.get("_x", i).alias("observed"), at(mean, i).alias("benign_mean"),
                at(std, i).alias("benign_sd"), ((F.get("_x", i) - at(mean, i)) / at(std, i)).alias("z"), at(meanings, i).alias("meaning"))).alias("features"),
        )
        identity = F.struct(*(c for c in IDENTITY if c in alerts.columns))
        truth = [F.col(c).cast("string").alias(c) for c in ("label", "category", "is_attack") if c in alerts.columns]
        out = rows.select(
            "flow_id", "severity", F.col("fused_score").alias("confidence"), F.col("category_out").alias("attributed"), "layers", "corroboration", identity.alias("identity"),
            rules.explanations(rows).alias("rules"), supervised.alias("supervised"), anomaly.alias("anomaly"), *([F.struct(*truth).alias("ground_truth")] if truth else []),
        )
        return out.withColumn("narrative", narrative(out))

    def importances(self) -> DataFrame:
        names = self.space and [(i, c, fixed.group_of(c), fixed.meaning_of(c)) for i, c in enumerate(fixed.FEATURES)]
        named = self.isolation.sparkSession.createDataFrame(names, "feature int, name string, group string, meaning string")
        found = named.join(forests.importances(self.nodes), "feature", "left")
        return found.select(F.col("name").alias("feature"), "group", F.coalesce("importance", F.lit(0.0)).alias("importance"), "meaning").orderBy(F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        """Models and tables as Parquet, parameters as JSON. Rules are code and not saved."""
        for name in ("nodes", "isolation", "benign_scores"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        rest = {"classes": self.classes, "sample": self.sample, "threshold": self.threshold, "benign_mean": self.benign_mean, "benign_std": self.benign_std, "percentile": self.percentile, "seed": self.seed, "space": self.space.to_json()}
        spark = self.nodes.sparkSession
        spark.createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parameters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Detector:
        rest = json.loads(spark.read.text(f"{path}/parameters", wholetext=True).first()["value"])
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "isolation", "benign_scores")}
        space = FeatureSpace.from_json(rest.pop("space"))
        return cls(space=space, **tables, **rest)


def additivity_gap(det: Detector, rows: DataFrame) -> float:
    """Largest difference between a probability and its bias plus contributions, over the rows of predict()."""
    f, k = len(fixed.FEATURES), len(det.classes)
    c = rows.select("proba", forests.contributions(det.nodes, k)(det.space.vector(rows)).alias("c"))
    total = lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(f)), F.lit(0.0), lambda a, i: a + F.get("c", i * k + j))
    return c.agg(F.max(F.greatest(F.lit(0.0), *(F.abs(F.get("proba", F.lit(j)) - total(j)) for j in range(k))))).first()[0] or 0.0


def narrative(rec: DataFrame) -> Column:
    """A few sentences on an explained record: what agrees, what each layer saw, and then the verdict."""
    has = set(rec.select("identity.*").columns)
    show = lambda c: F.coalesce(F.col(f"identity.{c}").cast("string"), F.lit("unknown")) if c in has else F.lit("unknown")
    way = F.concat(F.lit(" from "), show("src_ip"), F.lit(" to "), show("dst_ip"), F.lit(" port "), show("dst_port")) if {"src_ip", "dst_ip"} <= has else F.lit("")
    what = F.concat(F.lit("A "), show("service"), F.lit(" connection"), way, F.lit(" that ended in state "), show("flag"), F.lit(": "), F.col("corroboration"), F.lit("."))
    listed = lambda values, each: F.concat_ws(", ", F.transform(values, each))
    rule = F.transform("rules", lambda r: F.concat(F.lit(" "), r["rule_id"], F.lit(" holds because "), listed(F.map_entries(r["observed"]), lambda e: F.concat(e["key"], F.lit(" is "), F.coalesce(e["value"], F.lit("absent")))), F.lit(".")))
    head = lambda layer: F.slice(f"{layer}.features", 1, 3)
    forest = F.when(
        F.array_contains("layers", "supervised"),
        F.concat(F.format_string(" The forest puts %s at %.2f, mostly by ", "supervised.predicted", "supervised.probability"), listed(head("supervised"), lambda f: F.concat(f["feature"], F.format_string(" (%+.3f)", f["contribution"]))), F.lit(".")),
    )
    unusual = F.when(
        F.col("anomaly.alerted"),
        F.concat(F.format_string(" Only %.2f%% of benign traffic is as far out; what stands out is ", (1 - F.col("anomaly.more_unusual_than")) * 100), listed(head("anomaly"), lambda f: F.concat(f["feature"], F.format_string(" (z %+.1f)", f["z"]))), F.lit(".")),
    )
    verdict = F.format_string(" Verdict: %s, severity %s, score %.3f.", "attributed", "severity", "confidence")
    return F.concat(what, F.concat_ws("", rule), F.coalesce(forest, F.lit("")), F.coalesce(unusual, F.lit("")), verdict)
