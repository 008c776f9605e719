"""The whole linkage job, from records to written and checked matches, in steps that are tables.

    train     index, candidates, 33 features, first model (cross-scored for the second), decisions,
              24 group features, second model, report on the holdout
    score     the same up to both probabilities, with given models
    deliver   list files of matches and candidates, checked before they are handed on

Each step is written into the job's folder; a job that was stopped goes on at its first step
without a complete table.  All countries go through one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import views as V
from linkloom.operators import decide, groups, metrics, models, pairs, retrieval, splits
from linkloom.sources import records as R
from linkloom.sources.staging import Steps


@dataclass(frozen=True)
class Plan:
    """One set of retrieval parameters for training and scoring alike."""

    views: tuple[str, ...] = V.DEFAULT_VIEWS
    k: int = 5
    cap: float = 0.02
    floor: float = 0.0
    keep_floor: float = 0.02
    first_threshold: float = 0.7
    margin: float = 0.0
    second_threshold: float = 0.5
    second_countries: tuple[str, ...] | None = None  # None: all
    holdout: float = 0.18
    one: models.Boosting = models.STAGE_ONE
    two: models.Boosting = models.STAGE_TWO


def pair_table(steps: Steps, records: DataFrame, plan: Plan) -> DataFrame:
    """Steps parsed, index, candidates and pairs: the 33 features of every retrieved pair."""
    parsed = steps.table("parsed", lambda: V.parsed(records))
    entities, queries = parsed.where("source = 1"), parsed.where("source > 1")
    at = steps.made("index", "postings", lambda path: retrieval.write_index(V.postings(entities, plan.views), path, plan.cap))
    vocab, postings = retrieval.read_index(steps.spark, at)

    def found() -> DataFrame:
        known = retrieval.weighted(V.postings(queries, plan.views), vocab)
        ranked = retrieval.top_k(retrieval.scores(known, postings, plan.floor), plan.k)
        return retrieval.with_context(retrieval.union_of_views(ranked, plan.views))

    candidates = steps.table("candidates", found)
    return steps.table("pairs", lambda: pairs.pair_features(candidates, parsed, V.postings(parsed, plan.views), vocab))


def _groups(steps: Steps, decisions: DataFrame, plan: Plan, name: str = "groups") -> DataFrame:
    """The 24 features of decisions, from the texts of the records and entities that they name."""
    parsed = steps.table("parsed", lambda: None)
    named = decisions.select(F.explode(F.array("record_id", "entity_id")).alias("id")).distinct()
    source = parsed.select(F.col("id").alias("record_id"), "source")
    return steps.table(name, lambda: groups.group_features(decisions.join(source, "record_id"), parsed.join(named, "id", "left_semi"), plan.keep_floor))


def train(steps: Steps, records: DataFrame, links: DataFrame, plan: Plan = Plan(), by: splits.Hash = splits.hashed) -> DataFrame:
    """Trains both models into the job's folder; the report of `holdout_report`."""
    table = pair_table(steps, records, plan)
    entities = records.where("source = 1").select("id", "country")
    split = steps.table("splits", lambda: splits.holdout(entities, plan.holdout, by))
    valid = split.where("split = 'valid'").select(F.col("id").alias("entity_id"))
    labelled = steps.table("labelled", lambda: splits.halves(pairs.labelled(table, links, valid), "record_id", by))
    seen = labelled.where("is_valid = 0")
    first = models.load(steps.made("first_model", "metadata", lambda path: models.save(models.train(seen, pairs.FEATURES, plan.one), path)))
    columns = ["country", "record_id", "entity_id", "probability"]
    scored = steps.table("scored", lambda: models.cross_score(seen, pairs.FEATURES, plan.one).select(*columns).unionByName(models.score(labelled.where("is_valid = 1"), first).select(*columns)))
    decided = steps.table("decisions", lambda: decide.decisions(scored, plan.keep_floor))
    own = links.select("record_id", F.col("entity_id").alias("owner"))
    features = _groups(steps, decided, plan).join(own, "record_id", "left").withColumn("label", F.coalesce(F.col("owner") == F.col("entity_id"), F.lit(False)).cast("int"))
    second = models.load(steps.made("second_model", "metadata", lambda path: models.save(models.train(features.join(valid, "entity_id", "left_anti"), groups.FEATURES, plan.two), path)))
    both = steps.table("rescored", lambda: models.score(features, second).select("country", "record_id", "entity_id", F.col("prob").alias("first"), F.col("margin"), F.col("probability").alias("second")))
    return holdout_report(both, links, valid, plan, by)


def score(steps: Steps, records: DataFrame, first_model: str, second_model: str, plan: Plan = Plan()) -> DataFrame:
    """(country, record_id, entity_id, first, margin, second) of every decision above the floor."""
    table = pair_table(steps, records, plan)
    first = models.score(table, models.load(first_model)).select("country", "record_id", "entity_id", "probability")
    decided = steps.table("decisions", lambda: decide.decisions(first, plan.keep_floor))
    features = _groups(steps, decided, plan)
    return steps.table("rescored", lambda: models.score(features, models.load(second_model)).select("country", "record_id", "entity_id", F.col("prob").alias("first"), "margin", F.col("probability").alias("second")))


def assigned(both: DataFrame, plan: Plan) -> DataFrame:
    """(country, record_id, entity_id): the second stage decides in its countries, the first elsewhere."""
    first = both.withColumn("probability", F.when(F.col("margin") >= plan.margin, F.col("first")).otherwise(F.lit(0.0)))
    second = both.select("country", "record_id", F.col("second").alias("probability"))
    where = plan.second_countries
    if where is None:
        return second.where(F.col("probability") >= plan.second_threshold).join(both.select("country", "record_id", "entity_id"), ["country", "record_id"]).select("country", "record_id", "entity_id")
    return decide.staged_scope(first, second, list(where), plan.first_threshold, plan.second_threshold).select("country", "record_id", "entity_id")


def deliver(both: DataFrame, candidates: DataFrame, entities: DataFrame, path: str, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """Writes path/matches and path/candidates, a row for each entity, and returns them as read
    back; raises if they do not fit together."""
    spark: SparkSession = both.sparkSession
    R.write_lists(R.complete_lists(entities, assigned(both, plan)), f"{path}/matches")
    R.write_lists(R.complete_lists(entities, candidates, "candidate_entity_ids"), f"{path}/candidates")
    matches, pool = R.read_lists(spark, f"{path}/matches"), R.read_lists(spark, f"{path}/candidates", "candidate_entity_ids")
    wrong = R.problems(entities, matches, pool).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.problem}: {r.n}" for r in wrong))
    return matches, pool


def holdout_report(both: DataFrame, links: DataFrame, valid: DataFrame, plan: Plan, by: splits.Hash = splits.hashed) -> DataFrame:
    """(stage, half, entities, predicted, hits, macro_f, accepted) over held-out entities; accepted
    where the second stage is better than the first in both halves."""
    held = splits.halves(valid, by=by)
    found = []
    for stage, rows in ((1, decide.by_threshold(both.withColumn("probability", F.col("first")), plan.first_threshold, plan.margin)), (2, both.where(F.col("second") >= plan.second_threshold))):
        counts = metrics.entity_scores(metrics.entity_counts(*metrics.on_holdout(rows.select("record_id", "entity_id"), links, valid)))
        found.append(counts.join(held, "entity_id").groupBy("half").agg(F.count("*").alias("entities"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"), F.round(F.avg("f"), 6).alias("macro_f")).select(F.lit(stage).alias("stage"), "*"))
    accepted = metrics.both_halves_improve(*(f.select("half", "macro_f") for f in found))
    return found[0].unionByName(found[1]).crossJoin(F.broadcast(accepted))  # accepted is one row
