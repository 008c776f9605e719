"""A training-corpus pipeline: five operators in turn, each on all that its predecessor kept.

language         drops documents without a recognised language and sets lang to the prediction
near_duplicates  keeps one document of each group of near copies: the smallest id, then the smallest
                 hash of the text; null ids come last
decontaminate    drops documents that hold a window of a benchmark item
pii              replaces personal data in texts by its kind
mixing           drops documents of rate 0 and adds tokens, posterior and rate

Decisions hold for rows, named by id and hash of the text: rows that share an id are judged each by
its own text, and rows with null ids like any other.  Of exact repeats of a row one stays; texts
without words are no copies of each other.  Stages with Python steps set small Arrow batches in the
session, as their results are evaluated later; `run` sets them back at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import decontaminate as _decontaminate
from linkloom.llm import jaccard, language, mixing, pii
from linkloom.llm._stage import keep_batches_small, small_batches, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_ROWS = 1_000_000  # names of dropped rows, 16 bytes each
ABOVE_CHANCE = 0.2  # how far a language prediction lies between chance and certainty, at least


def least_score(languages: int) -> float:
    """The score that a prediction needs; 0.4 for four languages, where chance is 0.25."""
    chance = 1 / max(languages, 1)
    return chance + ABOVE_CHANCE * (1 - chance)


def _same_row(prefix: str) -> Column:
    """A row of documents is the one named by {prefix}id and {prefix}hash."""
    return F.col("doc_id").eqNullSafe(F.col(f"{prefix}id")) & (F.xxhash64("text") == F.col(f"{prefix}hash"))


def _named(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(F.col("doc_id").alias(f"{prefix}id"), F.col("text_hash").alias(f"{prefix}hash")).distinct()


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows of dropped(doc_id, text_hash); their names are sent to all tasks where they
    are few, and else joined by a shuffle."""
    names = staged(_named(dropped, "_"), "dropped")
    return docs.join(F.broadcast(names) if names.count() <= BROADCAST_ROWS else names, _same_row("_"), "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep_batches_small(spark)
    samples = language.learn(docs)
    found = language.predict_language(docs.select(*COLUMNS), samples, keep=COLUMNS)
    found = found.where((F.col("lang_pred") != language.UND) & (F.col("score") >= least_score(len(samples))))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep_batches_small(spark)
    found = staged(jaccard.jaccard_components(docs.select("doc_id", "text")).select("doc_id", "text_hash", "component"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    first = staged(found.where("component is not null").groupBy("component").agg(first, F.count("*").alias("m")).where("m > 1"), "first")
    rows = found.join(first, "component")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    kept = _without(docs.select(*COLUMNS), rows.where(~stays))
    again = staged(_named(rows.where(stays).groupBy("doc_id", "text_hash").count().where("count > 1"), "_"), "repeated")
    if again.isEmpty():
        return kept
    once, more = kept.join(again, _same_row("_"), "left_anti"), kept.join(again, _same_row("_"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(more)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs.select(*COLUMNS), _decontaminate.find_windows(docs.select("doc_id", "text"), items).where("contaminated"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep_batches_small(spark)
    clean = pii.redact(docs.select(*COLUMNS), pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs.select(*COLUMNS), labels, keep=COLUMNS).where("rate > 0")


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontaminate", drop_contaminated), ("pii", redact_personal_data), ("mixing", mix_sources)]

#: Language parsing, EM and gradient steps have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each is written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        for name, stage in STAGES[:-1]:
            docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
