"""Mixing sources to target weights by soft membership, in DataFrame functions only.

A naive Bayes classifier, fitted to a labelled table, predicts each document's posterior
over domains.  Nonnegative document rates are then fitted so that the expected token total of
every domain, sum over documents of rate x tokens x posterior, matches its target: least
squares over domains, by projected gradient.

Residuals are weighted by the domains' present shares and gradients by tokens, which makes
the step matrix stochastic: a step of one is safe and needs no line search.  A rate depends
on the residuals so far and on its own posterior alone, so a round is one aggregation to as
many sums as there are domains; the driver keeps the few residual vectors, and rates are
recomputed from them.  No round shuffles documents.

The classifier is fitted to at most `Settings.train_rows` labelled ids, by hash of the id;
words are weighed by presence, with `Settings.vocabulary` words of largest chi-square and
bins of the shares of symbols and capitals.  All documents are classified and counted.

Null or empty text has no tokens and the posterior of a text without any known word.  Null
domains are not learned; an id with several domains counts for the least.  Without labelled
rows all domains are equally likely.  Repeated rows each get a row; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm._stage import staged

TARGETS = {"clean": 0.95, "junk": 0.04, "toxic": 0.01}
_PUNCTUATION = ".,;:!?\"'()\n\t\r"
_SYMBOLS = "[#*$%&<>|!]"
_BINS = (0.0, 0.002, 0.02, 0.06, 0.12, 0.3)


@dataclass(frozen=True)
class Settings:
    train_rows: int = 4_000
    vocabulary: int = 128
    rounds: int = 40
    tolerance: float = 1e-4  # largest residual, as a share of all tokens


def _let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, wherever the planner may write the whole out."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum_of(table: Column):
    return lambda total, i: total + F.element_at(table, i)


@dataclass(frozen=True)
class Classifier:
    """log P(domain) for a document without features, and each feature's addition."""

    domains: tuple[str, ...]
    base: tuple[float, ...]
    gains: dict[str, tuple[float, ...]]


def words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _PUNCTUATION, string.ascii_lowercase + " " * len(_PUNCTUATION))
    return F.array_remove(F.split(plain, " +"), "")


def _bin(name: str, text: Column, pattern: str) -> Column:
    def named(share: Column) -> Column:
        at = F.lit(0)
        for i, least in enumerate(_BINS, 1):
            at = F.when(share > least, i).otherwise(at)
        return F.concat(F.lit(f"<{name} "), at.cast("string"), F.lit(">"))

    return _let(F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1)), named)


def _bins() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.array(_bin("symbols", text, _SYMBOLS), _bin("capitals", text, "[A-Z]"))


def train(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], how: Settings = Settings()) -> Classifier:
    """Bernoulli naive Bayes from labels(doc_id, domain); the driver gets `vocabulary` rows."""
    known = labels.where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(how.train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = staged(rows.select("domain", F.array_distinct(F.concat(words(F.col("text")), _bins())).alias("features")), "training")
    size = {r.domain: r.n for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    if not total:
        return Classifier(domains, tuple(math.log(1 / len(domains)) for _ in domains), {})
    counts = [F.count_if(F.col("domain") == d).cast("double").alias(f"n{k}") for k, d in enumerate(domains)]
    table = rows.select("domain", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").cast("double").alias("n"), *counts)
    chi = sum(((F.col(f"n{k}") - F.col("n") * size.get(d, 0) / total) ** 2 / (F.col("n") * max(size.get(d, 0), 0.5) / total) for k, d in enumerate(domains)), F.lit(0.0))
    kept = table.withColumn("chi", F.when(F.col("feature").startswith("<"), F.lit(float("inf"))).otherwise(chi)).orderBy(F.desc("chi"), "feature").limit(how.vocabulary).collect()
    base = [math.log((size.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    gains = {}
    for r in kept:
        p = [(r[f"n{k}"] + 0.5) / (size.get(d, 0) + 1) for k, d in enumerate(domains)]
        p = [min(max(x, 1e-4), 1 - 1e-4) for x in p]
        base = [b + math.log(1 - x) for b, x in zip(base, p)]
        gains[r.feature] = tuple(math.log(x / (1 - x)) for x in p)
    return Classifier(domains, tuple(base), gains)


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """Adds tokens (words) and posterior, an array over the model's domains, to every row."""
    table = docs.withColumn("_words", words(F.col("text"))).withColumn("tokens", F.size("_words").cast("long"))
    names = sorted(model.gains)
    known = F.lit(names) if names else F.array().cast("array<string>")
    gains = [F.lit([model.gains[n][k] for n in names]) for k in range(len(model.domains))] if names else []

    def logs(at: Column) -> Column:
        return F.array(*(F.aggregate(at, F.lit(b), _sum_of(g)) for b, g in zip(model.base, gains))) if names else F.array(*map(F.lit, model.base))

    def shares(odds: Column) -> Column:
        return _let(F.aggregate(odds, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(odds, lambda x: x / total))

    hits = F.concat(F.array_intersect("_words", known), F.array_intersect(_bins(), known))
    at = F.transform(hits, lambda w: F.array_position(known, w).cast("int"))
    odds = _let(_let(at, logs), lambda x: _let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return table.withColumn("posterior", _let(odds, shares)).drop("_words")


def rate(steps: list[list[float]]) -> Column:
    """The rate that the gradient steps so far give a document: from 1, never below 0."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*(F.array(*map(F.lit, s)) for s in steps))

    def folded(p: Column) -> Column:
        dot = lambda h: sum((F.get(p, F.lit(k)) * F.get(h, F.lit(k)) for k in range(len(steps[0]))), F.lit(0.0))
        return F.aggregate(history, F.lit(1.0), lambda r, h: F.greatest(F.lit(0.0), r - dot(h)))

    return _let(F.col("posterior"), folded)


def fit_rates(members: DataFrame, targets: dict[str, float], domains: tuple[str, ...], how: Settings = Settings()) -> list[list[float]]:
    """Gradient steps that bring the expected domain totals of members(tokens, posterior) to
    the targets' shares of all tokens.  Warns where `rounds` of them leave a larger residual than
    `tolerance`; targets that no nonnegative rates reach (a domain without documents) are met as
    closely as least squares can."""
    goal = [targets[d] / sum(targets.values()) for d in domains]
    steps: list[list[float]] = []
    share: list[float] = []
    for _ in range(how.rounds + 1):
        part = F.col("tokens") * rate(steps)
        sums = members.agg(F.sum("tokens").alias("all"), *(F.sum(part * F.get("posterior", F.lit(k))).alias(f"d{k}") for k in range(len(domains)))).first()
        if not sums["all"]:
            return []
        now = [sums[f"d{k}"] / sums["all"] for k in range(len(domains))]
        share = share or [max(x, 1e-9) for x in now]
        residual = [x - g for x, g in zip(now, goal)]
        if max(map(abs, residual)) <= how.tolerance:
            break
        steps.append([round(r / s, 12) for r, s in zip(residual, share)])
    else:
        logging.getLogger(__name__).warning("after %d rounds the largest residual is %.2g of all tokens (tolerance %.2g): %s", how.rounds, max(map(abs, residual)), how.tolerance, dict(zip(domains, residual)))
    return steps[: how.rounds]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, how: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row with tokens, posterior (in the targets' sorted order) and
    rate.  Texts are not written to intermediate tables: if kept, they are classified again."""
    domains = tuple(sorted(targets))
    model = train(docs, labels, domains, how)
    found = classify(docs.select(*keep, *({"text"} - {*keep})), model)
    members = staged(found.select(*(c for c in keep if c != "text"), "tokens", "posterior"), "members")
    steps = fit_rates(members, targets, domains, how)
    return (found if "text" in keep else members).select(*keep, "tokens", "posterior").withColumn("rate", rate(steps))


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, else junk where quality is 0, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op9_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")))
