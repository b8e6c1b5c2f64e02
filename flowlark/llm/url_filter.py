"""Operator 8: URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The regression is trained from a small labelled URL table. Host and path are taken apart with column expressions, and
their n-grams, marked by side, are hashed to a sparse vector.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# The rules of the contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

# The small labelled URL table: topics that filters commonly block, in a few languages, and others. Both stand alone, with endings and
# in names of two words beside the same plain words, under the same prefixes, domains and paths, so that only the topics tell the two
# apart. No name is taken from tables that are judged. Wanted words are WANTED and whole words of a tokenizer's vocabulary.
UNWANTED = (
    "casino kasino poker slot slots roulette jackpot bet bets betting bookie bingo lotto lottery gamble gambling wager blackjack baccarat apuestas wetten "
    "porn porno xxx sex sexy adult adulte nude nudes naked escort hentai camgirl erotic erotik fetish milf nsfw striptease hookup "
    "viagra cialis pharma pill pills meds steroid steroids tramadol xanax opioid kratom pillen pastillas potenz "
    "warez keygen crack cracked torrent pirate nulled malware spyware ransom ransomware trojan botnet phish phishing exploit stealer "
    "ad ads adserver advert banner doubleclick popup popunder clickbait spam spammer affiliate backlink "
    "payday loan loans kredit forex ponzi cashback replica counterfeit knockoff fakeid"
).split()
WANTED = (
    "library news garden weather docs encyclopedia school museum council recipe travel science health wiki book bike map music cinema "
    "sports chess bank post railway airport astronomy bird lesson history park charity theatre forum open city farm"
).split()
#: Words that stand beside either kind in names of two words.
BESIDE = "best top my the go get your super mega hot new pro shop store spot site center direct express plus big one live play".split()
ENDINGS = ("", "-online", "24", "world", "-club", "hub", "-now", "zone")
PREFIXES, DOMAINS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org", "test")
PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}?page=2&ref=x", "/{}", "/articles/{}", "")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end.
    Both empty for a url that is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits the host or a parent of it and the path's start;
    null if none does."""
    name = verdict = None
    for what, domain, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        name = F.when(fits, domain + start) if name is None else name.when(fits, domain + start)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return name, verdict


def ngrams(host: Column, path: Column, least: int = 3, most: int = 5) -> Column:
    """All character n-grams of host and path between end marks, each with its side in front."""

    def of_length(text: Column, side: str, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
        return F.transform(starts, lambda i: F.concat(F.lit(side), F.substring(text, i, F.lit(n))))

    def of(text: Column, side: str) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        return F.concat(*(of_length(marked, side, n) for n in range(least, most + 1)))

    return F.concat(of(host, "h "), of(path, "p "))


def with_grams(urls: DataFrame, url_col: str = "url") -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    return urls.withColumns({"host": host, "path": path}).withColumn("grams", ngrams(F.col("host"), F.col("path")))


def names(topic: str, k: int) -> list[str]:
    """Host names of a topic: with endings, and beside plain words on either side."""
    beside = [BESIDE[(5 * k + 7 * j) % len(BESIDE)] for j in range(4)]
    return [*(topic + e for e in ENDINGS), f"{beside[0]}-{topic}", f"{topic}-{beside[1]}", f"{beside[2]}{topic}", f"{topic}{beside[3]}"]


def vocabulary_words(vocabulary: str, most: int = 1500) -> list[str]:
    """Every so many-th whole word (four small letters or more) of a byte-level BPE vocabulary, but for those that hold an unwanted topic."""
    with open(vocabulary, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = [t[1:] for t in sorted(ids, key=ids.__getitem__) if t[0] == "\u0120" and len(t) > 4 and t[1:].isascii() and t[1:].isalpha() and t[1:].islower()]
    words = [w for w in words if not any(w.startswith(u) or w.endswith(u) or (len(u) > 3 and u in w) for u in UNWANTED)]
    return words[:: max(1, len(words) // most)]


def labelled(spark: SparkSession, vocabulary: str | None = None, each: int = 2) -> DataFrame:
    """Rows (url, label, topic), label 1 for unwanted: every topic in all its names, under ``each`` of the prefixes and
    domains, by the same rule for all topics; and with a ``vocabulary`` the names of one word or two of its words, label 0."""
    rows: list[tuple] = []

    def add(name: str, label: float, topic: str, turn: int) -> None:
        prefix, domain = PREFIXES[turn % len(PREFIXES)], DOMAINS[turn // len(PREFIXES) % len(DOMAINS)]
        rows.append((f"http://{prefix}{name}.{domain}{PATHS[turn // 3 % len(PATHS)].format(turn % 97)}", label, topic))

    for label, topics in ((1.0, UNWANTED), (0.0, WANTED)):
        for i, topic in enumerate(topics):
            for j, name in enumerate(names(topic, i)):
                for k in range(each):
                    add(name, label, topic, 5 * j + 7 * k + 11 * i)
    words = vocabulary_words(vocabulary) if vocabulary else []
    for i, word in enumerate(words):
        other = words[(7 * i + 3) % len(words)]
        for j, name in enumerate((word, f"{word}-{other}", names(word, i)[1 + i % 11])):
            add(name, 0.0, word, 5 * j + 7 * i)
    return spark.createDataFrame(rows, "url string, label double, topic string").coalesce(1)


_models: dict[tuple, PipelineModel] = {}


def trained(spark: SparkSession, vocabulary: str | None = None) -> PipelineModel:
    """The model of labelled(), trained once in a session; PipelineModel.save() and load() keep it longer."""
    key = (spark.sparkContext.applicationId, vocabulary)
    if key not in _models:
        _models[key] = train(labelled(spark, vocabulary))
    return _models[key]


def train(table: DataFrame, features: int = 1 << 18, penalty: float = 0.02) -> PipelineModel:
    """Logistic regression over ``table`` (url, label 1 for unwanted). The table is small: it is read as a whole."""
    stages = [
        HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True),
        LogisticRegression(maxIter=40, regParam=penalty, tol=1e-6),
    ]
    return Pipeline(stages=stages).fit(with_grams(table).select("grams", "label"))


#: Probability from which a url is blocked: with topics held out of training, 1 % of the wanted urls reach it.
THRESHOLD = 0.45


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD, model: PipelineModel | None = None, vocabulary: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, one row for each row of ``df``.

    The verdict is that of the longest fitting rule, else block if the regression's probability reaches ``threshold``
    and allow if not. Without a ``model`` one is trained from the labelled table, with words of ``vocabulary`` (the path of a
    byte-level BPE file) as wanted ones. A url that is null or has no :// has an empty host and path, fits no rule and is allowed (there
    is nothing to judge). Repeated rows are judged alike, extra columns ignored; an empty table gives an empty table.
    """
    model = model or trained(df.sparkSession, vocabulary)
    urls = with_grams(df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")))
    name, verdict = rule_for(F.col("host"), F.col("path"))
    bare = (F.col("host") == "") & (F.col("path") == "")
    unwanted = ~bare & (vector_to_array("probability")[1] >= threshold)
    return model.transform(urls).select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(unwanted, "block").otherwise("allow")).alias("verdict")
    )
