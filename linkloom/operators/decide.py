"""From scored pairs to assignments: one decision per record, and rules over decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6


def top_n(scored: DataFrame, n: int = 3) -> DataFrame:
    """The n likeliest entities of each record, place from 1."""
    best = Window.partitionBy("country", "record_id").orderBy(F.desc("probability"), "entity_id")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def decisions(scored: DataFrame, keep_floor: float = 0.0) -> DataFrame:
    """(country, record_id, entity_id, probability, margin): the likeliest entity and its lead over
    the runner-up (over 0 without one).  Ties go to the smaller entity id."""
    two = top_n(scored, 2).groupBy("country", "record_id")
    found = two.agg(F.max(F.when(F.col("place") == 1, F.struct("entity_id", "probability"))).alias("b"), F.max(F.when(F.col("place") == 2, F.col("probability"))).alias("second"))
    found = found.select("country", "record_id", "b.entity_id", "b.probability", F.round(F.col("b.probability") - F.coalesce("second", F.lit(0.0)), PLACES).alias("margin"))
    return found.where(F.col("probability") >= keep_floor) if keep_floor > 0 else found


def by_threshold(found: DataFrame, threshold: float, margin: float = 0.0) -> DataFrame:
    return found.where((F.col("probability") >= threshold) & (F.col("margin") >= margin))


def with_place(found: DataFrame) -> DataFrame:
    """Adds place: a record's order inside its entity, likeliest first."""
    own = Window.partitionBy("country", "entity_id").orderBy(F.desc("probability"), "record_id")
    return found.withColumn("place", F.row_number().over(own))


def by_place(found: DataFrame, first: float, extra: float) -> DataFrame:
    """One threshold for an entity's best record, another for the rest."""
    return with_place(found).where(F.col("probability") >= F.when(F.col("place") == 1, first).otherwise(F.lit(extra)))


def gated(found: DataFrame, gate: float) -> DataFrame:
    """Records of entities whose best record reaches the gate."""
    best = F.max("probability").over(Window.partitionBy("country", "entity_id"))
    return found.withColumn("best", best).where(F.col("best") >= gate).drop("best")


def expected_prefix(found: DataFrame, floor: float = 0.02, inflation: float = 1.0, beta: float = 0.5) -> DataFrame:
    """Each entity's prefix of records, likeliest first, with the largest expected F-beta; none
    where the chance that no record matches scores at least as well."""
    own = Window.partitionBy("country", "entity_id")
    order = own.orderBy(F.desc("probability"), "record_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    kept = found.where(F.col("probability") >= floor)
    kept = kept.withColumns({"place": F.row_number().over(order), "sum": F.sum("probability").over(so_far), "all": F.sum("probability").over(own)})
    sure = F.max((F.col("probability") >= 1).cast("int")).over(own) == 1
    kept = kept.withColumn("none", F.when(sure, F.lit(0.0)).otherwise(F.exp(F.sum(F.log(F.when(F.col("probability") < 1, 1 - F.col("probability")).otherwise(F.lit(1.0)))).over(own))))
    precision, recall = F.col("sum") / F.col("place"), F.col("sum") / F.greatest(F.col("all") * inflation, F.lit(1e-9))
    kept = kept.withColumn("score", F.round(F.coalesce(F.try_divide((1 + beta**2) * precision * recall, beta**2 * precision + recall), F.lit(0.0)), PLACES))
    best = kept.withColumn("top", F.max("score").over(own)).withColumn("cut", F.min(F.when(F.col("score") == F.col("top"), F.col("place"))).over(own))
    return best.where((F.col("place") <= F.col("cut")) & (F.round("none", PLACES) < F.col("top"))).select(*found.columns)


def staged_scope(first: DataFrame, second: DataFrame, countries: list[str], threshold_1: float, threshold_2: float) -> DataFrame:
    """Second-stage probabilities decide in `countries`, first-stage ones elsewhere."""
    p2 = second.select("country", "record_id", F.col("probability").alias("p2"))
    both = first.join(p2, ["country", "record_id"], "left")
    return both.where(F.when(F.col("country").isin(countries), F.coalesce("p2", F.lit(0.0)) >= threshold_2).otherwise(F.col("probability") >= threshold_1)).drop("p2")


def inverted(assigned: DataFrame) -> DataFrame:
    """(entity_id, record_ids) of assigned records, sorted."""
    return assigned.groupBy("entity_id").agg(F.array_sort(F.collect_set("record_id")).alias("record_ids"))
