"""Candidate retrieval: an IDF-weighted sparse-cosine top-k join on tokens.

Everything is one lazy plan for all countries: `country` leads every join, group and window key.
The searched side defines document frequencies.  Tokens above the frequency cap leave the
vocabulary before any join, which bounds every posting list, and the rank filter is written on
the window column itself so that each task cuts to k before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.operators import cells
from linkloom.operators.cells import PLACES
from linkloom.sources.staging import spread


def vocabulary(index: DataFrame, cap: float = 0.02, min_df: int = 1) -> DataFrame:
    """(country, view, token, df, idf) of postings(country, view, id, token): idf = ln(1 + n / df),
    without tokens in more than max(1, cap * n) documents or fewer than min_df."""
    n = index.groupBy("country", "view").agg(F.countDistinct("id").alias("n"))
    df = index.groupBy("country", "view", "token").agg(F.count("*").alias("df"))
    found = df.join(n, ["country", "view"])
    kept = found.where((F.col("df") <= F.greatest(F.lit(1.0), F.lit(cap) * F.col("n"))) & (F.col("df") >= min_df))
    return kept.select("country", "view", "token", "df", F.log(1 + F.col("n") / F.col("df")).alias("idf"))


def weighted(postings: DataFrame, vocab: DataFrame) -> DataFrame:
    """(country, view, id, token, w): rows of unit length over the vocabulary's tokens."""
    own = Window.partitionBy("country", "view", "id")
    known = postings.join(vocab.select("country", "view", "token", "idf"), ["country", "view", "token"])
    return known.select("country", "view", "id", "token", (F.col("idf") / F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(own))).alias("w"))


def scores(queries: DataFrame, index: DataFrame, floor: float = 0.0) -> DataFrame:
    """(country, view, record_id, entity_id, score): cosine of all pairs that share a token."""
    q = queries.select("country", "view", "token", F.col("id").alias("record_id"), F.col("w").alias("wq"))
    e = index.select("country", "view", "token", F.col("id").alias("entity_id"), F.col("w").alias("we"))
    found = q.join(e, ["country", "view", "token"]).groupBy("country", "view", "record_id", "entity_id")
    found = found.agg(F.round(F.sum(F.col("wq") * F.col("we")), PLACES).alias("score"))
    return found.where(F.col("score") > floor) if floor > 0 else found


def top_k(scored: DataFrame, k: int = 5, by: str = "record_id", other: str = "entity_id") -> DataFrame:
    """The k best of each record and view, with a 0-based rank; equal scores by id."""
    best = Window.partitionBy("country", "view", by).orderBy(F.desc("score"), other)
    return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).withColumn("rank", (F.col("_n") - 1).cast("int")).drop("_n")


def sets(postings: DataFrame) -> DataFrame:
    """(country, view, id, tokens): one row for each id, its tokens joined by `cells.SEP`."""
    return postings.groupBy("country", "view", "id").agg(F.array_join(F.collect_list("token"), cells.SEP).alias("tokens"))


def retrieve(queries: DataFrame, index: DataFrame, k: int = 5, cap: float = 0.02, floor: float = 0.0) -> DataFrame:
    """Top k entities of each record and view, from postings of both sides."""
    return retrieve_sets(sets(queries), sets(index), k, cap, floor)


def retrieve_sets(queries: DataFrame, index: DataFrame, k: int = 5, cap: float | None = 0.02, floor: float = 0.0, entities: int = 1 << 16, records: int = 1 << 15) -> DataFrame:
    """The same from token sets (country, view, id, tokens) of both sides; without a cap, all tokens are searched by.

    Neither postings nor pairs are moved.  Entities are dealt by id into blocks of about `entities`,
    records into so many that a country and view has a cell (pair of blocks) for each `records`
    records.  Whole sets go to the cells in compressed packs, with the vocabulary; each cell gives k entities a record."""
    own = ["country", "view"]
    n = index.where(F.col("tokens") != "").groupBy(*own).agg(F.countDistinct("id").alias("n"))
    blocks = F.ceil(F.col("n") / entities).cast("int")
    asked = queries.groupBy(*own).agg(F.count("*").alias("asked"))
    size = F.broadcast(n.join(asked, own).select(*own, "n", blocks.alias("xs"), F.ceil(F.col("asked") / records / blocks).cast("int").alias("ys")))
    df = index.select(*own, F.explode(F.split("tokens", cells.SEP)).alias("token")).where("token <> ''").groupBy(*own, "token").agg(F.count("*").alias("df"))
    vocab = df.join(size, own)
    if cap is not None:
        vocab = vocab.where(F.col("df") <= F.greatest(F.lit(1.0), F.lit(cap) * F.col("n")))
    vocab = vocab.groupBy(*own, "n", "xs", "ys", F.pmod(F.hash("token"), F.lit(256)).alias("bucket")).agg(F.collect_list(F.struct("token", "df")).alias("held"))
    none = lambda kind: F.lit(None).cast(kind)
    words = vocab.select(*own, F.lit(cells.VOCABULARY).alias("kind"), F.lit(0).alias("block"), "xs", "ys", "n", none("string").alias("id"), F.array_join("held.token", cells.SEP).alias("tokens"), F.col("held.df").alias("df"))
    side = lambda df, kind, blocks: df.join(size, own).select(*own, F.lit(kind).alias("kind"), F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int").alias("block"), "xs", "ys", none("bigint").alias("n"), "id", "tokens", none("array<bigint>").alias("df"))
    packs = words.unionByName(side(index, cells.ENTITIES, "xs")).unionByName(side(queries, cells.RECORDS, "ys")).mapInArrow(cells.pack, cells.PACKED)
    block, every = F.array("block"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    x, y = F.when(F.col("kind") == cells.ENTITIES, block).otherwise(every("xs")), F.when(F.col("kind") >= cells.IDS, block).otherwise(every("ys"))
    cell = [*own, "x", "y"]
    dealt = spread(packs.withColumn("x", F.explode(x)).withColumn("y", F.explode(y)).select(*cell, "kind", "n", "pack"), *cell).sortWithinPartitions(*cell, "kind")
    return top_k(dealt.mapInArrow(lambda batches: cells.search(batches, k, floor), cells.FOUND), k)


def pruned_scores(queries: DataFrame, index: DataFrame, floor: float, share: float = 0.5) -> DataFrame:
    """Like `scores` for floor > 0, by exact prefix filtering: of each record, heaviest first, tokens
    are joined until the rest has a norm below `share` of the floor.  A pair's score is at most that of
    these heads plus that norm; only pairs that can still reach the floor are joined to the rest."""
    if floor <= 0:
        raise ValueError("prefix filtering needs a positive floor")
    own = ["country", "view"]
    onward = Window.partitionBy(*own, "id").orderBy(F.desc("w"), "token").rowsBetween(0, Window.unboundedFollowing)
    cut = floor * share
    parts = queries.withColumn("_rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(onward))).withColumn("_left", F.max(F.when(F.col("_rest") < cut, F.col("_rest"))).over(Window.partitionBy(*own, "id")))
    parts = parts.select(*own, "token", F.col("id").alias("record_id"), F.col("w").alias("wq"), (F.col("_rest") >= cut).alias("_head"), F.coalesce("_left", F.lit(0.0)).alias("_left"))
    e = index.select(*own, "token", F.col("id").alias("entity_id"), F.col("w").alias("we"))
    product = F.sum(F.col("wq") * F.col("we"))
    heads = parts.where("_head").join(e, [*own, "token"]).groupBy(*own, "record_id", "entity_id").agg(product.alias("head"), F.max("_left").alias("_left"))
    near = heads.where(F.col("head") + F.col("_left") >= floor - 10**-PLACES).select(*own, "record_id", "entity_id", "head")
    tails = near.join(parts.where("not _head").select(*own, "record_id", "token", "wq"), [*own, "record_id"]).join(e, [*own, "token", "entity_id"])
    tails = tails.groupBy(*own, "record_id", "entity_id").agg(product.alias("tail"))
    found = near.join(tails, [*own, "record_id", "entity_id"], "left").withColumn("score", F.round(F.col("head") + F.coalesce("tail", F.lit(0.0)), PLACES))
    return found.where(F.col("score") > floor).select(*own, "record_id", "entity_id", "score")


def write_index(postings: DataFrame, path: str, cap: float = 0.02) -> None:
    """A searched side as tables: the vocabulary and the weighted postings, by country and view."""
    vocab = vocabulary(postings, cap)
    vocab.write.mode("overwrite").partitionBy("country", "view").parquet(f"{path}/vocabulary")
    vocab = read_table(postings.sparkSession, f"{path}/vocabulary")
    weighted(postings, vocab).write.mode("overwrite").partitionBy("country", "view").parquet(f"{path}/postings")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by country and view; partition values stay strings, whatever they look like."""
    found = spark.read.option("basePath", path).parquet(path)
    return found.withColumns({c: F.col(c).cast("string") for c in ("country", "view")})


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, weighted postings) of `write_index`."""
    return read_table(spark, f"{path}/vocabulary"), read_table(spark, f"{path}/postings")


def union_of_views(ranked: DataFrame, views: tuple[str, ...] = ("composite", "ngram")) -> DataFrame:
    """One row per pair that any view retrieved: rank_/score_ of each view (99 and 0 where it did
    not), rank_best and score_best."""
    each = []
    for v in views:
        each += [F.coalesce(F.min(F.when(F.col("view") == v, F.col("rank"))), F.lit(99)).cast("int").alias(f"rank_{v}"), F.coalesce(F.max(F.when(F.col("view") == v, F.col("score"))), F.lit(0.0)).alias(f"score_{v}")]
    return ranked.groupBy("country", "record_id", "entity_id").agg(*each, F.min("rank").alias("rank_best"), F.max("score").alias("score_best"))


def with_context(pairs: DataFrame) -> DataFrame:
    """Adds n_candidates_for_record and score_margin_to_next: the own best score less the
    strongest rival's, with 0 for no rival."""
    own = Window.partitionBy("country", "record_id")
    by_score = own.orderBy(F.desc("score_best"), "entity_id")
    top = pairs.withColumns({"_first": F.max("score_best").over(own), "_place": F.row_number().over(by_score), "n_candidates_for_record": F.count("*").over(own)})
    second = F.coalesce(F.max(F.when(F.col("_place") == 2, F.col("score_best"))).over(own), F.lit(0.0))
    rival = F.when(F.col("_place") == 1, second).otherwise(F.col("_first"))
    return top.withColumn("score_margin_to_next", F.round(F.col("score_best") - F.greatest(rival, F.lit(0.0)), PLACES)).drop("_first", "_place")


def inverted(ranked: DataFrame) -> DataFrame:
    """Retrieved pairs by entity: (country, entity_id, candidates), best first."""
    held = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "record_id", "rank")))
    return ranked.groupBy("country", "entity_id").agg(held.alias("candidates"))


def recall_at(ranked: DataFrame, truth: DataFrame, cuts: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """(k, links, found, recall, entities_full) of truth(record_id, entity_id): share of links
    whose entity is among the record's first k, and matched entities with all links found."""
    best = ranked.groupBy("record_id", "entity_id").agg(F.min("rank").alias("rank"))
    held = truth.join(best, ["record_id", "entity_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(1 << 20)))
    per = held.groupBy("entity_id").agg(F.count("*").alias("links"), *(F.count_if(F.col("rank") < k).alias(f"f{k}") for k in cuts))
    sums = per.agg(F.sum("links").alias("links"), *(x for k in cuts for x in (F.sum(f"f{k}").alias(f"f{k}"), F.count_if(F.col(f"f{k}") == F.col("links")).alias(f"e{k}"))))
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"f{k}").alias("found"), F.col(f"e{k}").alias("entities_full")) for k in cuts))
    return sums.select("links", F.explode(each).alias("c")).select(F.col("c.k").alias("k"), "links", F.col("c.found").alias("found"), F.round(F.col("c.found") / F.col("links"), PLACES).alias("recall"), F.col("c.entities_full").alias("entities_full"))


def miss_reasons(ranked: DataFrame, truth: DataFrame, records: DataFrame) -> DataFrame:
    """(reason, n) of links that were not retrieved: empty_address, cross_script or other."""
    got = ranked.select("record_id", "entity_id").distinct()
    missed = truth.join(got, ["record_id", "entity_id"], "left_anti")
    r = records.select(F.col("id").alias("record_id"), F.col("name").alias("rn"), F.col("address").alias("ra"))
    e = records.select(F.col("id").alias("entity_id"), F.col("name").alias("en"))
    outside = r"[^\x00-\x{024F}]"
    reason = F.when(F.trim("ra") == "", "empty_address").when(F.col("rn").rlike(outside) != F.col("en").rlike(outside), "cross_script").otherwise("other")
    return missed.join(r, "record_id").join(e, "entity_id").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def budget_sweep(ranked: DataFrame, truth: DataFrame, entities: int, grid: list[tuple[int, float, int]]) -> DataFrame:
    """(k, floor, cap, pairs, per_entity, found): what each budget keeps.  One pass: ranks within
    records and within entities are taken for every grid point by exploding pairs to the points
    they survive."""
    points = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(f).alias("floor"), F.lit(c).alias("cap")) for k, f, c in grid))
    kept = ranked.withColumn("g", F.explode(points)).where((F.col("rank") < F.col("g.k")) & (F.col("score") >= F.col("g.floor")))
    kept = kept.select("record_id", "entity_id", "score", "g.*")
    own = Window.partitionBy("k", "floor", "cap", "entity_id").orderBy(F.desc("score"), "record_id")
    kept = kept.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= F.col("cap"))
    hit = truth.select("record_id", "entity_id", F.lit(1).alias("hit"))
    found = kept.join(hit, ["record_id", "entity_id"], "left").groupBy("k", "floor", "cap").agg(F.count("*").alias("pairs"), F.count("hit").alias("found"))
    return found.select("k", "floor", "cap", "pairs", F.round(F.col("pairs") / entities, PLACES).alias("per_entity"), "found")


def key_coverage(keys: DataFrame, truth: DataFrame) -> DataFrame:
    """(key, links, equal, coverage): share of true links whose two records have an equal key."""
    a = keys.select(F.col("id").alias("record_id"), "key", F.col("value").alias("x"))
    b = keys.select(F.col("id").alias("entity_id"), "key", F.col("value").alias("y"))
    both = truth.join(a, "record_id").join(b, ["entity_id", "key"])
    return both.groupBy("key").agg(F.count("*").alias("links"), F.count_if(F.col("x") == F.col("y")).alias("equal")).withColumn("coverage", F.round(F.col("equal") / F.col("links"), PLACES))


def key_selectivity(keys: DataFrame) -> DataFrame:
    """(key, records, buckets, unique_share, expected_size): expected bucket size of a record."""
    size = keys.where("value is not null").groupBy("key", "value").agg(F.count("*").alias("v"))
    found = size.groupBy("key").agg(F.sum("v").alias("records"), F.count("*").alias("buckets"), F.count_if(F.col("v") == 1).alias("one"), F.sum(F.col("v") * F.col("v")).alias("square"))
    return found.select("key", "records", "buckets", F.round(F.col("one") / F.col("buckets"), PLACES).alias("unique_share"), F.round(F.col("square") / F.col("records"), PLACES).alias("expected_size"))


def hard_negatives(queries: DataFrame, index: DataFrame, truth: DataFrame, n: int = 3, longest: int = 3000) -> DataFrame:
    """(record_id, entity_id, shared): entities that share most tokens without being the owner;
    tokens of more than `longest` entities are left out."""
    short = index.groupBy("country", "view", "token").agg(F.count("*").alias("df")).where(F.col("df") <= longest).drop("df")
    e = index.join(short, ["country", "view", "token"]).select("country", "token", F.col("id").alias("entity_id"))
    shared = queries.select("country", "token", F.col("id").alias("record_id")).join(e, ["country", "token"]).groupBy("record_id", "entity_id").agg(F.count("*").alias("shared"))
    rest = shared.join(truth, ["record_id", "entity_id"], "left_anti")
    best = Window.partitionBy("record_id").orderBy(F.desc("shared"), "entity_id")
    return rest.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n).drop("_n")


def hashed_postings(texts: DataFrame, buckets: int = 1 << 20, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(country, view, id, token, tf) of texts(country, id, text): hashed character n-grams inside
    words, each word padded with a space at both ends."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(n: int):
        return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))))

    each = texts.select("country", "id", F.explode(F.concat(*(grams(n) for n in sizes))).alias("gram"))
    token = F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("string")
    return each.groupBy("country", F.lit("hashed").alias("view"), "id", token.alias("token")).agg(F.count("*").alias("tf"))


def hashed_retrieve(queries: DataFrame, index: DataFrame, k: int = 10) -> DataFrame:
    """Top k by cosine of (1 + ln tf) x smoothed idf over hashed n-grams."""
    n = index.groupBy("country", "view").agg(F.countDistinct("id").alias("n"))
    df = index.groupBy("country", "view", "token").agg(F.count("*").alias("df")).join(n, ["country", "view"])
    idf = df.select("country", "view", "token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def unit(side: DataFrame) -> DataFrame:
        own = Window.partitionBy("country", "view", "id")
        x = side.join(idf, ["country", "view", "token"]).withColumn("x", (1 + F.log("tf")) * F.col("idf"))
        return x.select("country", "view", "id", "token", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(own))).alias("w"))

    return top_k(scores(unit(queries), unit(index)), k)


def cost_curve(ranked: DataFrame, cuts: tuple[int, ...] = (1, 2, 3, 5), target: int = 1_000_000) -> DataFrame:
    """(k, pairs, per_query, projected): pairs at each cut, carried on to `target` queries."""
    sums = ranked.agg(F.countDistinct("record_id").alias("n"), *(F.count_if(F.col("rank") < k).alias(f"p{k}") for k in cuts))
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("pairs")) for k in cuts))
    found = sums.select("n", F.explode(each).alias("c"))
    return found.select("c.k", "c.pairs", F.round(F.col("c.pairs") / F.col("n"), PLACES).alias("per_query"), F.round(F.col("c.pairs") / F.col("n") * target, 0).cast("long").alias("projected"))
