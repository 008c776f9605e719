"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of `Settings.window` consecutive words (an item with
fewer words is one window).  A document that contains a window contains all of its
shingles, so one shingle is a sufficient prefix: the rarest in the documents.  Document
shingles are joined to these prefixes; the prefix's place in its window bounds where the
window may start, the document's length bounds where it may end, and whole windows are
compared word by word.

Prefixes are broadcast in blocks of at most `Settings.block_windows` windows, each block
against all documents, so the broadcast does not grow with the benchmark; documents are
never shuffled, only their verified hits are.  The shuffled rows are one for each document
and one for each hit.

Null or empty text has no words and is clean.  Items without words never occur; items
without an id count as hits but are not listed.  Repeated documents each get a row, repeated
items count once.  Extra columns are ignored; empty tables give empty or clean results.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm._stage import staged

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Settings:
    window: int = 10
    shingle: int = 3
    block_windows: int = 200_000


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAPS), "")


def _token(array: str, at: Column, size: int) -> Column:
    """Hash of `size` words from 0-based `at`; null beyond the end."""
    parts = [F.get(array, at + j) for j in range(size)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(*parts))


def windows(items: DataFrame, how: Settings) -> DataFrame:
    """(item_id, words) of every window, without repeats."""
    found = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("_all")).where(F.size("_all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_all") - how.window, F.lit(0)))
    return found.select("item_id", "_all", F.explode(starts).alias("_at")).select("item_id", F.slice("_all", F.col("_at") + 1, how.window).alias("words")).distinct()


def _tokens(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every place of every document with its token; place -1 stands for the document itself."""
    table = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    table = table.select("doc_id", "text_hash", "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("place"))
    token = [F.when(F.col("place") >= 0, _token("words", F.col("place"), k)) for k in sizes]
    if len(sizes) == 1:
        return table.withColumn("token", token[0]).withColumn("k", F.lit(sizes[0]))
    both = F.array(*(F.struct(F.lit(k).alias("k"), t.alias("token")) for k, t in zip(sizes, token)))
    return table.withColumn("_t", F.explode(both)).where((F.col("place") >= 0) | (F.col("_t.k") == sizes[0])).select("doc_id", "text_hash", "words", "place", "_t.token", "_t.k")


def find_windows(docs: DataFrame, items: DataFrame, how: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, text_hash (xxhash64), n_words, n_hit, n_items, items_sha256,
    contaminated, and spans (start, length in words) of the windows found."""
    wins = staged(windows(items, how).withColumn("k", F.least(F.size("words"), F.lit(how.shingle))), "windows")
    sizes = [r.k for r in wins.select("k").distinct().orderBy(F.desc("k")).limit(how.shingle).collect()] or [how.shingle]
    token = F.lit(None).cast("long")
    for k in sizes:
        token = F.when(F.col("k") == k, _token("words", F.col("offset"), k)).otherwise(token)
    parts = wins.select("*", F.explode(F.expr("sequence(0, size(words) - k)")).alias("offset")).withColumn("token", token)
    parts = staged(parts, "window_tokens")
    known = parts.select("k", "token").distinct()
    if known.count() <= how.block_windows * how.window:
        known = F.broadcast(known)
    seen = _tokens(docs, sizes).join(known, ["k", "token"]).groupBy("k", "token").agg(F.count("*").alias("seen"))
    rarest = Window.partitionBy("item_id", "words").orderBy(F.coalesce("seen", F.lit(0)), "offset")
    prefix = parts.join(staged(seen, "rarity"), ["k", "token"], "left").withColumn("_rank", F.row_number().over(rarest)).where("_rank = 1")
    prefix = staged(prefix.select("k", "token", "offset", F.size("words").alias("length"), F.col("words").alias("window"), "item_id"), "prefixes")
    blocks = max(1, -(-prefix.count() // how.block_windows))
    hits = None
    for b in range(blocks):
        part = prefix if blocks == 1 else prefix.where(F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == b)
        near = _tokens(docs, sizes).join(F.broadcast(part), ["k", "token"], "left").withColumn("start", F.col("place") - F.col("offset"))
        bounded = (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("words"))
        same = F.slice("words", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("length")) == F.col("window")
        itself = F.col("place") == -1
        kept = near.where((itself if b == 0 else F.lit(False)) | (bounded & same))
        kept = kept.select("doc_id", "text_hash", F.size("words").alias("n_words"), itself.alias("itself"), F.when(~itself, F.struct("start", "length")).alias("span"), F.when(~itself, F.col("item_id")).alias("item_id"))
        hits = kept if hits is None else hits.union(kept)
    found = hits.groupBy("doc_id", "text_hash", "n_words").agg(F.count_if("itself").cast("int").alias("_rows"), F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("item_id")).alias("_items"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s.length - 1))))
    found = found.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return found.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def op10_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
