"""The driver's tables in the roles of linkage inputs.

Records come from `documents`: three sources by id, the language as country, the first line as
name, all that follows as address, and the text of both.  A record of the second or third
source belongs to the smallest entity of the first with the same whole text in lower case.
Words, and queries over plain text, are those of the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions import views as V
from linkloom.operators import cells, decide, retrieval

#: Tokens of more than this share of a country's entities are not searched by.
CAP = 0.02


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = (F.col("doc_id") % 3 + 1).cast("int")
    name = F.substring_index("text", "\n", 1)
    address = F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("id"), source.alias("source"), F.col("lang").alias("country"), name.alias("name"), address.alias("address"), "text")


def links(rows: DataFrame) -> DataFrame:
    """(record_id, entity_id) of the truth.  Whole texts are compared by SHA-256, so that they are not moved."""
    key = F.sha2(F.lower("text"), 256)
    first = rows.where("source = 1").groupBy("country", key.alias("key")).agg(F.min("id").alias("entity_id"))
    return rows.where("source > 1").select("country", key.alias("key"), F.col("id").alias("record_id")).join(first, ["country", "key"]).select("record_id", "entity_id")


def entities(rows: DataFrame) -> DataFrame:
    return rows.where("source = 1").select(F.col("id").alias("entity_id"), "country")


def word_postings(rows: DataFrame) -> DataFrame:
    """(country, view, id, token): distinct lower-case words of the text."""
    token = F.explode(F.array_distinct(T.tokens(F.lower("text"))))
    return rows.select("country", F.lit("words").alias("view"), "id", token.alias("token"))


def word_sets(rows: DataFrame) -> DataFrame:
    """(country, view, id, tokens): the same, whole sets in a row."""
    tokens = F.array_join(F.array_distinct(T.tokens(F.lower("text"))), cells.SEP)
    return rows.select("country", F.lit("words").alias("view"), "id", F.coalesce(tokens, F.lit("")).alias("tokens"))


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records to link, and entities."""
    return rows.where("source > 1"), rows.where("source = 1")


def word_candidates(rows: DataFrame, k: int = 5, cap: float | None = CAP, floor: float = 0.0) -> DataFrame:
    """Top k entities of each record by shared words; without a cap, by all of them."""
    queries, index = sides(rows)
    return retrieval.retrieve_sets(word_sets(queries), word_sets(index), k, cap, floor)


def word_decisions(rows: DataFrame) -> DataFrame:
    """Decisions with the cosine as probability."""
    return decided(word_candidates(rows))


def decided(candidates: DataFrame) -> DataFrame:
    return decide.decisions(candidates.withColumnRenamed("score", "probability"))


def view_candidates(parsed: DataFrame, k: int = 5, cap: float = CAP) -> DataFrame:
    """Union of the default views with context."""
    queries, index = sides(parsed)
    return retrieval.with_context(retrieval.union_of_views(retrieval.retrieve(V.postings(queries), V.postings(index), k, cap)))
