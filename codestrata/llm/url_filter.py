"""URL verdicts: explicit rules first, a logistic regression for the rest.

The regression's features are hashed character n-grams of host and path. It is
trained by gradient steps over a small table of labelled URLs. Only DataFrame and
SQL functions run: scoring is row-local, a training step is one grouping, and the
weights are one array of fixed length.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits
no rule and is scored on those; repeated rows get equal verdicts; long URLs are read
whole; an empty table gives no rows, and without labels of both kinds the weights stay
zero and the verdict is ``allow``; other columns are not looked at.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import Scratch

BUCKETS = 4096
GRAMS = (3, 4)
STEPS = 12
RATE = 0.5
# Labelled URLs used for training at most, those with the smallest hash.
SAMPLE = 4096
# Errors enter the sums as whole numbers of this resolution, so the order of addition never matters.
UNIT = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, _, path = text.partition("/")
        return cls(host, "/" + path, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null. Rules are few and travel with the plan."""
    kind = "struct<rule:string,verdict:string>"
    chosen = F.lit(None).cast(kind)
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest ends up outermost
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def features(host: Column, path: Column, grams: Sequence[int] = GRAMS, buckets: int = BUCKETS) -> Column:
    """Distinct bucket numbers of the n-grams of host and path, each marked with where it stands."""
    parts = []
    for mark, text in (("h", host), ("p", path)):
        chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        for n in grams:
            # A text of fewer characters than n has no n-gram: the sequence then runs over no position.
            places = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(places, _bucket_at(chars, mark, n, buckets)))
    return F.array_distinct(F.concat(*parts))


def _bucket_at(chars: Column, mark: str, n: int, buckets: int) -> Callable[[Column], Column]:
    return lambda i: F.pmod(F.xxhash64(F.concat(F.lit(mark), *[F.get(chars, i + k) for k in range(n)])), F.lit(buckets)).cast("int")


def _score(bucket_list: Column, weights: Sequence[float]) -> Column:
    table = F.from_json(F.lit(json.dumps(list(weights))), "array<double>")
    return F.aggregate(bucket_list, F.lit(float(weights[-1])), lambda total, b: total + F.get(table, b))


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked", sample: int = SAMPLE, steps: int = STEPS, rate: float = RATE, buckets: int = BUCKETS) -> list[float]:
    """Weights by bucket, the last one the constant, from rows of a URL and a boolean.

    At most ``sample`` distinct rows are used. Steps are scaled per bucket by the root of its
    summed squared gradients (Duchi et al., 2011). Every sum is over whole numbers.
    """
    chosen = labelled.select(url, blocked).where(F.col(blocked).isNotNull()).distinct().orderBy(F.xxhash64(url, blocked), url).limit(sample)
    weights, squares = [0.0] * (buckets + 1), [0.0] * (buckets + 1)
    with Scratch(labelled.sparkSession) as scratch:
        rows = scratch.keep(chosen.select(features(*host_path(F.col(url)), buckets=buckets).alias("at"), F.col(blocked).cast("double").alias("y")))
        count, ones = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
        if not 0 < ones < count:
            return weights
        for _ in range(steps):
            chance = 1 / (1 + F.exp(-_score(F.col("at"), weights)))
            errors = rows.select(F.concat("at", F.array(F.lit(buckets))).alias("at"), F.round((F.col("y") - chance) * UNIT).cast("long").alias("e"))
            for bucket, total in errors.select(F.explode("at").alias("b"), "e").groupBy("b").agg(F.sum("e")).collect():
                slope = total / UNIT / count
                squares[bucket] += slope * slope
                weights[bucket] = round(weights[bucket] + (rate * slope / math.sqrt(squares[bucket]) if slope else 0.0), 9)
    return weights


def judge(pages: DataFrame, rules: Sequence[Rule], weights: Sequence[float], id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: id, host, path, the rule that fits, the verdict and the model's score."""
    host, path = host_path(F.coalesce(F.col(url), F.lit("")))
    split = pages.select(F.col(id).alias(id), host.alias("host"), path.alias("path"))
    scored = split.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("score", _score(features(F.col("host"), F.col("path")), weights))
    by_model = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select(id, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", by_model).alias("verdict"), F.round("score", 6).alias("score"))


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """URLs that fit a rule, labelled with its verdict."""
    found = pages.select(F.col(url).alias("url"), fitting_rule(*host_path(F.coalesce(F.col(url), F.lit(""))), rules).alias("found"))
    return found.where(F.col("found").isNotNull()).select("url", (F.col("found.verdict") == "block").alias("blocked"))
