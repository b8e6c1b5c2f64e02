"""The feature space: 38 raw, 14 derived and 3 code columns, fitted on a training frame."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark import fixed
from flowlark.functions.columns import derived, finite, number, words
from flowlark.session import table

#: A categorical column with more values than this is refused: vocabularies are part of the plan.
MOST_VALUES = 10_000
#: The column of FeatureSpace.stored().
STORED = "_features"


def service_shares(df: DataFrame) -> DataFrame:
    """service, n, share of the rows."""
    counts = df.select(words(df, "service").alias("service")).groupBy("service").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("service", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def ordinal(word: Column, vocabulary: list[str]) -> Column:
    """Place of the word in the sorted vocabulary; its length for words that are not in it."""
    at = F.array_position(F.lit(vocabulary) if vocabulary else F.array().cast("array<string>"), word)
    return F.when(at > 0, at - 1).otherwise(len(vocabulary)).cast("double")


def word_of(code: Column, vocabulary: list[str]) -> Column:
    """The word at a place of the sorted vocabulary; <unseen> for a place that it has not."""
    return F.coalesce(F.get(F.lit(vocabulary) if vocabulary else F.array().cast("array<string>"), code.cast("int")), F.lit("<unseen>"))


def vocabulary_of(df: DataFrame, column: str) -> list[str]:
    """The sorted distinct words of a column; an error if they are more than a plan can hold."""
    rows = df.select(words(df, column).alias("w")).distinct().limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"{column} has over {MOST_VALUES} values")
    return sorted(r["w"] for r in rows)


@dataclass
class FeatureSpace:
    vocabularies: dict[str, list[str]] = field(default_factory=dict)
    shares: dict[str, float] = field(default_factory=dict)
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame) -> FeatureSpace:
        """Vocabularies and service shares, then mean and deviation of every feature, in two passes of aggregation."""
        space = cls.worded(df)
        space.scale(df)
        return space

    @classmethod
    def worded(cls, df: DataFrame) -> FeatureSpace:
        """Vocabularies and service shares alone."""
        space = cls()
        for c in fixed.CATEGORICAL:
            rows = df.select(words(df, c).alias("w")).groupBy("w").count().limit(MOST_VALUES + 1).collect()
            if len(rows) > MOST_VALUES:
                raise ValueError(f"{c} has over {MOST_VALUES} values")
            space.vocabularies[c] = sorted(r["w"] for r in rows)
            if c == "service":
                total = sum(r["count"] for r in rows)
                space.shares = {r["w"]: r["count"] / total for r in rows}
        return space

    def scale(self, df: DataFrame) -> None:
        """Takes mean and deviation of every feature from ``df``."""
        sums = self.transform(df).agg(*(f(c).alias(f"{k}_{c}") for c in fixed.FEATURES for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        self.mean = [sums[f"m_{c}"] or 0.0 for c in fixed.FEATURES]
        self.std = [s if (s := sums[f"s_{c}"] or 0.0) >= 1e-12 else 1.0 for c in fixed.FEATURES]

    def stored(self, df: DataFrame) -> DataFrame:
        """``df`` as a table with this space's features beside its columns. To read them takes far less than to compute them, so
        frames of which they are used more than once are stored; STORED is to be dropped before another space sees the rows."""
        return table(df.withColumn(STORED, self.vector(df)))

    def columns(self, df: DataFrame) -> dict[str, Column]:
        """The features by name. They depend on which columns there are and on nothing else of ``df``, so they are kept for
        other frames: some thousand calls to the JVM, which took longer than scoring a small frame."""
        names = df.columns
        key = (df.sparkSession, STORED if STORED in names else tuple(c for c in fixed.COLUMNS if c in names))
        made = self.__dict__.setdefault("_columns", {})
        if key not in made and STORED in names:
            made[key] = {c: F.get(STORED, F.lit(i)) for i, c in enumerate(fixed.FEATURES)}
        if key not in made:
            there = SimpleNamespace(columns=names)  # names are asked for each feature
            service = words(there, "service")
            share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in self.shares.items() for x in kv)), service), F.lit(0.0)) if self.shares else F.lit(0.0)
            out = {c: number(there, c) for c in fixed.NUMERIC} | derived(there, share)
            out |= {f"{c}_code": ordinal(words(there, c), self.vocabularies.get(c, [])) for c in fixed.CATEGORICAL}
            made[key] = {c: finite(out[c]) for c in fixed.FEATURES}
        return made[key]

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """The 55 features (after the columns ``keep``)."""
        return df.select(*keep, *(c.alias(name) for name, c in self.columns(df).items()))

    def vector(self, df: DataFrame, scaled: bool = False) -> Column:
        """The features as one array."""
        cols = self.columns(df)
        if not scaled:
            return F.col(STORED) if STORED in df.columns else F.array(*cols.values())
        made = self.__dict__.setdefault("_scaled", {})
        if (key := (id(cols), tuple(self.mean), tuple(self.std))) not in made:
            made[key] = F.array(*((c - m) / s for c, m, s in zip(cols.values(), self.mean, self.std, strict=True)))
        return made[key]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> FeatureSpace:
        return cls(**json.loads(text))
