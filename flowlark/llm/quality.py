"""Operator 4: quality rules whose thresholds adapt to language and source.

One pass measures every whole text. Quantile sketches (KLL, mergeable) of the measures are built per language and
source and merged per language and over all. A group's usual rate of a measure, and how far its texts spread around it, come
from the quartiles alone, so junk moves nothing unless it is a quarter of a group; where it is more, the group is held to twice its
language's rate. Small groups are drawn to their language, small languages to all texts, the more the fewer texts there are.
The rates are joined back, and a text fails if it has more symbols, repeated lines and so on than its length lets expect.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlark.llm.common import WordHashes, arrow_rows, cut, window_hashes

# White space and symbols of the contract.
BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = re.compile(r"[#*$%&|<>]")

#: The highest usual rate lies ``WIDTHS`` times the distance from the median to the upper quartile above the median.
WIDTHS = 6.0
#: A count may exceed what is expected by so many of its standard deviations, and by so many more.
CHANCE, SPARE = 6.0, 3.0
#: Share of the texts below the upper quartile. If they have none of a thing, a text of the usual length has none with that chance.
_QUARTILE = 0.75
#: Counts and what they are counted in: of words, lines or characters.
RATES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "stutters": ("n_stutters", "n_words"), "upper": ("n_upper", "word_chars")}
#: A group's rates are at most so many times its language's.
MOST = 2.0


def measure(text: str | None, hashes: WordHashes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper (upper-case characters), n_lines (lines
    with a word), n_stutters (words equal to the one before) of a whole text; all zero for null."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip(BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = stutters = 0
    if n >= 9:
        each = hashes.of(words)
        stutters = int((each[1:] == each[:-1]).sum())
        h = window_hashes(each, 8)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            edge = np.zeros(n + 1, np.int32)
            starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
            edge[starts] += 1
            edge[starts + 8] -= 1
            repeated = int((np.cumsum(edge) > 0).sum())
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, len(text) - blanks, len(_SYMBOLS.findall(text)), dup, repeated, upper, lines, stutters


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_stutters")


def _measured(df: DataFrame) -> DataFrame:
    """Of (doc_id, lang, source, row, text) all but the text, and its counts."""

    def work(batches):
        hashes = WordHashes()
        for b in arrow_rows(batches):
            counts = zip(*(measure(t.as_py(), hashes) for t in b.column(4)), strict=True)
            yield pa.record_batch([*(b.column(i) for i in range(4)), *(pa.array(c, pa.int64()) for c in counts)], ["doc_id", "lang", "source", "row", *_COUNTS])

    return df.mapInArrow(work, "doc_id long, lang string, source string, row long, " + ", ".join(f"{c} long" for c in _COUNTS))


def _values() -> dict[str, Column]:
    """What is sketched: the shares of the counts, the mean length of words, and the sizes that counts are measured by."""
    per = lambda a, b: F.col(a).cast("double") / F.greatest(b, F.lit(1))
    out = {name: per(count, unit) for name, (count, unit) in RATES.items()} | {"word_length": per("word_chars", "n_words")}
    return out | {f"of_{unit}": F.col(unit).cast("double") for unit in sorted({u for _, u in RATES.values()})}


def thresholds(measured: DataFrame, least: int = 200, widths: float = WIDTHS) -> DataFrame:
    """lang, source, for each of RATES the highest usual rate, and the usual mean length of words with its spread to either
    side (length, longer, shorter), from the texts that pass the base rules.

    A group of n texts weighs n / (n + ``least``) against its language, a language against all texts likewise.
    """
    names = list(_values())
    good = measured.filter("not base_failed")
    own = good.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(c).alias(c) for c in names))
    own = cut(own)  # a few hundred bytes for each group
    merge = lambda g: g.agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(c).alias(c) for c in names))
    by_lang = merge(own.groupBy("lang"))
    overall = merge(own.groupBy())
    groups = measured.select("lang", "source").distinct()
    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    wide = (
        groups.alias("g")
        .join(own.alias("o"), same("g", "o", ["lang", "source"]), "left")
        .join(by_lang.alias("l"), same("g", "l", ["lang"]), "left")
        .join(F.broadcast(overall.alias("a")))  # one row
    )

    def drawn(value, most: float | None = None) -> Column:
        """``value`` of a level for all texts, the language and the group, each drawn to the one before."""
        out = None
        for level in ("a", "l", "o"):
            at = lambda c, q: F.kll_sketch_get_quantile_double(F.col(f"{level}.{c}"), F.lit(q))  # noqa: B023, E731
            n = F.coalesce(F.col(f"{level}.n"), F.lit(0)).cast("double")
            if out is None:
                out = value(at)
                continue
            mine = F.when(n > 0, (n * value(at) + least * out) / (n + least)).otherwise(out)
            out = F.least(mine, most * out) if most and level == "o" else mine
        return out

    def rate(name: str) -> Column:
        unit = RATES[name][1]
        # where the quartile is zero: the rate at which a text of the usual length has none with that chance
        rare = lambda at: -math.log(_QUARTILE) / F.greatest(at(f"of_{unit}", 0.5), F.lit(1.0))
        return drawn(lambda at: F.greatest(at(name, 0.5) + widths * (at(name, _QUARTILE) - at(name, 0.5)), rare(at)), MOST)

    length = lambda value: drawn(lambda at: value(*(at("word_length", q) for q in (0.25, 0.5, 0.75))))
    spread = {"length": length(lambda a, m, b: m), "longer": length(lambda a, m, b: b - m), "shorter": length(lambda a, m, b: m - a)}
    return wide.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *(rate(c).alias(f"{c}_rate") for c in RATES), *(c.alias(k) for k, c in spread.items()))


def _fits(widths: float = WIDTHS) -> Column:
    """Whether a text's counts and the length of its words are what its group's rates let expect of its size."""
    out = F.lit(True)
    for name, (count, unit) in RATES.items():
        expected = F.col(unit) * F.col(f"{name}_rate")
        out &= F.coalesce(F.col(count) <= expected + CHANCE * F.sqrt(expected) + SPARE, F.lit(True))
    # single words spread by about half their mean length, a text's mean by that over the root of their number
    chance = 4.0 * F.col("length") / 2 / F.sqrt(F.greatest("n_words", F.lit(1)))
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    near = mean.between(F.col("length") - widths * F.col("shorter") - chance, F.col("length") + widths * F.col("longer") + chance)
    return out & F.coalesce(near, F.lit(True))


def judge(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 200, row_col: str | None = None
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, one row for each row.

    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows found twice or more in the text.
    kept: not base_failed, and no count is beyond what the rates of the text's language and source let expect. Null texts
    have no words and fail. Null languages and sources are groups like any other. Repeated rows are judged alike, extra
    columns ignored; an empty table gives an empty table. ``row_col`` names a number of each row, to be given back as row.
    """
    row = F.col(row_col) if row_col else F.lit(None)
    plain = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        row.cast("long").alias("row"), F.col(text_col).alias("text"),
    )
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = cut(_measured(plain)).withColumn("base_failed", base)
    limits = thresholds(measured.withColumns(_values()), least)
    on = [F.col("m.lang").eqNullSafe(F.col("t.lang")), F.col("m.source").eqNullSafe(F.col("t.source"))]
    return (
        measured.alias("m")
        .join(limits.alias("t"), on, "left")
        .select(*(["row"] if row_col else []), "doc_id", *_COUNTS[:5], "base_failed", (~F.col("base_failed") & _fits()).alias("kept"))
    )
