"""Judge URLs by rules and, where none fits, by logistic regression on hashed character n-grams of host and path.

Everything is DataFrame operations. The training table is small by definition: at most MAX_TRAINING rows of it are used,
those with the smallest hashes. Every step of the training is one aggregate over that table that returns one gradient
sum per bucket, so the driver holds two numbers for each of BUCKETS buckets and never a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

BUCKETS = 1 << 12
GRAMS = 4
#: Bound of the labelled table that the weights are fitted on.
MAX_TRAINING = 1000
STEPS = 12
RATE, L2 = 0.5, 1e-4
# Names labelled by hand: 1 is a site to block (gambling, pills, adult, advertising, spam), 0 an ordinary one. None is a host
# of the tables that the registered query judges.
BLOCKED_NAMES = (
    "mega-casino", "lucky-casino", "casino-bonus", "poker-room", "slots-bonus", "lottery-cash", "online-casino", "casino-royal",
    "best-bets", "sports-bets", "pills-shop", "diet-pills", "adult-video", "xxx-adult", "ads-server", "click-ads",
    "track-clicks", "ad-tracker", "spam-mail", "spam-offers", "win-cash", "free-win", "poker-win", "cheap-loans",
    "free-spins", "free-poker", "cheap-meds", "buy-pills", "adult-cams", "ads-banner", "web-tracker", "link-farm",
)
ORDINARY_NAMES = (
    "thenews", "library", "theatre", "station", "nation", "weather", "history", "kitchen", "garden", "museum",
    "schools", "science", "thehouse", "another", "reading", "walking", "things", "mothers", "sandwich", "lectures",
    "townhall", "theshore", "inthend", "thoughts", "hospital", "orchestra", "football", "maps", "council", "railways",
    "editions", "onthehill", "restore", "standard", "thehand", "theland", "motion", "rations", "theor", "thewest",
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case; path: from there up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, else nulls; expects columns ``host`` and ``path``."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: each name once with either scheme, subdomains and paths dealt out alike to both labels."""
    before, end, lang = ("", "www.", "m.", "blog."), ("com", "org", "net"), ("en", "de", "fr", "es")
    tail = ("", ".html", "/", "?page=2&ref=x", "#top")
    return [
        (f"http{'s' * (i % 2)}://{before[(i + k) % 4]}{name}.example.{end[(i + k) % 3]}/{lang[(i + k) % 4]}/{(1709 * i + 977 * k) % 50_000}{tail[(i + k) % 5]}", label)
        for label, names in ((1, BLOCKED_NAMES), (0, ORDINARY_NAMES))
        for i, name in enumerate(names)
        for k in range(5)
    ]


def labelled_table(spark: SparkSession) -> DataFrame:
    """``labelled_urls`` as a relation of literals: no Python worker takes part."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{url}', {label})" for url, label in labelled_urls()) + " AS t(url, label)")


def _grams(part: str) -> str:
    """Hashed n-grams of a part with its ends marked; which part it is goes into the hash."""
    whole = f"concat('^', {part}, '$')"
    return (
        f"transform(sequence(1, greatest(1, length({whole}) - {GRAMS - 1})),"
        f" i -> cast(pmod(xxhash64('{part}', substr({whole}, i, {GRAMS})), {BUCKETS}) as int))"
    )


def features(df: DataFrame) -> DataFrame:
    """Adds ``grams``: the distinct buckets of the n-grams of host and path."""
    return df.withColumn("grams", F.expr(f"array_distinct(concat({_grams('host')}, {_grams('path')}))"))


def margin(weights: list[float]) -> Column:
    """Sum of the weights of a row's buckets over the root of their number, plus the bias, the last weight."""
    table = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(table, g))
    return total / F.sqrt(F.size("grams")) + F.lit(weights[-1])


def probability(weights: list[float]) -> Column:
    return 1 / (1 + F.exp(-margin(weights)))


def train(labelled: DataFrame) -> list[float]:
    """Weights from rows (url, label: 1 block, 0 allow). Null labels teach nothing; without labels all weights are 0."""
    host, path = host_and_path(F.col("url"))
    small = (
        labelled.where("label is not null")
        .select("url", "label")
        .orderBy(F.xxhash64("url"), "url", "label")
        .limit(MAX_TRAINING)
        .select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label"))
    )
    small = written(features(small), "url-training")
    weights, squares = [0.0] * (BUCKETS + 1), [0.0] * (BUCKETS + 1)
    n = small.count()
    for _ in range(STEPS if n else 0):
        error = small.select((probability(weights) - F.col("label")).alias("e"), "grams")
        share = error.select(F.explode("grams").alias("g"), (F.col("e") / F.sqrt(F.size("grams"))).alias("e"))
        sums = share.unionByName(error.select(F.lit(BUCKETS).alias("g"), "e")).groupBy("g").agg((F.sum("e") / n).alias("e"))
        for g, e in sums.collect():  # at most BUCKETS + 1 rows
            slope = e + L2 * weights[g]
            squares[g] += slope * slope
            weights[g] -= RATE * slope / (math.sqrt(squares[g]) + 1e-9)
    return weights


def filter_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of block) for every row of ``pages``.

    A null url, or one without ://, has an empty host and path, fits no rule whose path is not empty, and is judged by
    the weights like any other. Rows that repeat are judged alike. ``labelled`` has rows (url, label: 1 block, 0 allow).
    """
    host, path = host_and_path(F.col("url"))
    name, verdict = rule_for(rules)
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": name, "by_rule": verdict})
    weights = train(labelled)
    return (
        features(parts)
        .withColumn("score", probability(weights))
        .select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
    )
