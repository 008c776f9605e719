"""Every operator of the engine as a query over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import text as T
from linkloom.functions import views as V
from linkloom.operators import decide, diagnostics, groups, metrics, models, pairs, retrieval, splits
from linkloom.plans import adapter as A
from linkloom.plans import job
from linkloom.sources import records as R
from linkloom.sources.staging import Steps, shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
THRESHOLD = 0.5
BROADCAST_IDS = 1_000_000  # changes the plan only, not rows


def query(f: Callable) -> Callable:
    """Registers f(rows) -> DataFrame, rows being the records of the adapter."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(A.records(spark, sf_dir))
    return f


def tabled(f: Callable) -> Callable:
    """Registers f(spark, sf_dir) -> DataFrame."""
    QUERIES[f.__name__] = f
    return f


@query
def flagship_cosine_topk(rows):
    return A.word_candidates(rows, cap=None).select("country", "record_id", "entity_id", "score", "rank")


# Text ---------------------------------------------------------------------------------------


@query
def tokenize_names(rows):
    tokens = T.name_tokens(F.lower(T.clean_name(F.col("text"))))
    return rows.select("id", F.array_join(tokens, " ").alias("tokens"), F.array_join(T.name_core(tokens), " ").alias("core"))


@tabled
def canon_numbers(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").select("c_custkey", T.canon_number(F.lower("c_name")).alias("canon"))


@query
def abbrev_address(rows):
    return rows.select("id", F.array_join(T.address_tokens(F.lower(T.strip_junk(F.col("text")))), " ").alias("tokens"))


@tabled
def dba_tail(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    marker = F.element_at(F.array(*map(F.lit, (" d/b/a ", " doing business as ", " T/A ", " aka ", " and "))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", T.trade_name(F.concat("p_name", marker, "p_brand")).alias("name"))


@tabled
def ordinal_strip(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    suffix = F.element_at(F.array(*map(F.lit, ("st", "ND", "Rd", "th", "xx"))), (F.col("p_size") % 5 + 1).cast("int"))
    return p.select("p_partkey", T.strip_ordinals(F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"), suffix, F.lit(" floor"))).alias("text"))


@query
def non_latin_flag(rows):
    return rows.select("id", T.non_latin(F.col("text")).alias("non_latin"))


@tabled
def numeric_keys(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    tokens = T.tokens(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))))
    return c.select("c_custkey", F.array_join(F.array_sort(T.numeric_keys(tokens)), " ").alias("numbers"))


@query
def fold_accents(rows):
    return rows.select("id", T.fold(F.col("text")).alias("folded"))


@query
def romanised_names(rows):
    return rows.select("id", F.lower(T.romanise(F.col("text"))).alias("latin"))


# Views and vocabulary -----------------------------------------------------------------------


@query
def char_ngram_df(rows):
    return rows.where("source = 1").select("country", F.explode(T.char_ngrams(F.lower("text"))).alias("gram")).groupBy("country", "gram").agg(F.count("*").alias("df")).where("df >= 3")


@query
def token_df_idf(rows):
    vocab = retrieval.vocabulary(A.word_postings(A.sides(rows)[1]), 1.0)
    return vocab.select("country", "token", "df", F.round("idf", 6).alias("idf"))


@query
def df_cap_sweep(rows):
    p = A.word_postings(A.sides(rows)[1])
    n = p.groupBy("country").agg(F.countDistinct("id").alias("n"))
    df = p.groupBy("country", "token").agg(F.count("*").alias("df")).join(n, "country")
    each = df.withColumn("cap", F.explode(F.array(*map(F.lit, (0.002, 0.02, 0.1, 0.5, 1.0))))).where(F.col("df") <= F.greatest(F.lit(1.0), F.col("cap") * F.col("n")))
    return each.groupBy("cap", "country").agg(F.count("*").alias("tokens"), F.max("df").alias("longest"), F.sum("df").alias("postings"))


@query
def composite_keys(rows):
    p = V.parsed(rows)
    return p.select("id", F.array_join(F.array_sort(V.VIEWS["composite"]()), " ").alias("keys"))


@query
def exact_key_coverage(rows):
    return retrieval.key_coverage(V.exact_keys(V.parsed(rows)), A.links(rows))


@query
def exact_key_selectivity(rows):
    return retrieval.key_selectivity(V.exact_keys(V.parsed(rows)))


# Retrieval ----------------------------------------------------------------------------------


@query
def view_union_topk(rows):
    queries, index = A.sides(V.parsed(rows))
    found = retrieval.retrieve(V.postings(queries, ("name", "address")), V.postings(index, ("name", "address")), 5, A.CAP)
    return retrieval.union_of_views(found, ("name", "address"))


@query
def shortlist_context(rows):
    queries, index = A.sides(V.parsed(rows))
    found = retrieval.retrieve(V.postings(queries, ("name", "address")), V.postings(index, ("name", "address")), 5, A.CAP)
    return retrieval.with_context(retrieval.union_of_views(found, ("name", "address"))).select("record_id", "entity_id", "score_best", "score_margin_to_next", "n_candidates_for_record")


@query
def s1_side_topk(rows):
    """Roles swapped: records are searched for each entity, and define document frequencies."""
    queries, index = A.sides(rows)
    return retrieval.retrieve_sets(A.word_sets(index), A.word_sets(queries), 3, A.CAP).select("country", F.col("record_id").alias("query_entity"), F.col("entity_id").alias("found_record"), "score", "rank")


@query
def floored_topk(rows):
    return A.word_candidates(rows, floor=0.3).select("record_id", "entity_id", "score", "rank")


@query
def pruned_topk(rows):
    """The same by prefix filtering."""
    queries, index = A.sides(rows)
    vocab = retrieval.vocabulary(A.word_postings(index), A.CAP)
    q, e = retrieval.weighted(A.word_postings(queries), vocab), retrieval.weighted(A.word_postings(index), vocab)
    return retrieval.top_k(retrieval.pruned_scores(q, e, 0.3), 5).select("record_id", "entity_id", "score", "rank")


@query
def invert_shortlists(rows):
    found = retrieval.inverted(A.word_candidates(rows))
    return found.select("country", "entity_id", F.size("candidates").alias("n"), F.get("candidates", F.lit(0)).getField("record_id").alias("best_record"))


@query
def recall_at_k(rows):
    return retrieval.recall_at(A.word_candidates(rows, 10), A.links(rows))


@query
def miss_reasons(rows):
    return retrieval.miss_reasons(A.word_candidates(rows, 1), A.links(rows), rows)


@query
def budget_sweep(rows):
    n = A.entities(rows).count()
    return retrieval.budget_sweep(A.word_candidates(rows), A.links(rows), n, [(5, 0.0, 1000), (3, 0.2, 50), (2, 0.3, 10), (5, 0.3, 3)])


@query
def candidate_cost_curve(rows):
    return retrieval.cost_curve(A.word_candidates(rows))


@query
def candidate_score_percentiles(rows):
    return diagnostics.score_percentiles(A.word_candidates(rows))


@query
def hashed_tfidf_topk(rows):
    queries, index = A.sides(rows.select("source", "country", "id", "text"))
    return retrieval.hashed_retrieve(retrieval.hashed_postings(queries), retrieval.hashed_postings(index)).select("record_id", "entity_id", "score", "rank")


@query
def hard_negatives(rows):
    queries, index = A.sides(rows)
    return retrieval.hard_negatives(A.word_postings(queries), A.word_postings(index), A.links(rows), 2)


# Pair features ------------------------------------------------------------------------------


def _pairs(rows: DataFrame) -> DataFrame:
    """Two candidates of each record with the texts of both sides, parsed once."""
    return pairs.side_by_side(A.word_candidates(rows, 2).select("country", "record_id", "entity_id"), written(V.parsed(rows), "parsed"))


@query
def pair_set_features(rows):
    each = {k: F.round(v, 6) for k, v in pairs.set_features().items()}
    return _pairs(rows).withColumns(each).select("record_id", "entity_id", *each)


@query
def pair_idf_overlap(rows):
    parsed = V.parsed(rows)
    p = V.postings(parsed, ("name",))
    vocab = retrieval.vocabulary(V.postings(A.sides(parsed)[1], ("name",)), A.CAP)
    found = pairs.idf_overlap(A.word_candidates(rows, 2), p, vocab, "n", "name")
    return found.select("record_id", "entity_id", F.round("name_idf_overlap", 6).alias("overlap"), F.round("name_rare_shared", 6).alias("rare"))


@query
def pair_jaro_winkler(rows):
    x = _pairs(rows)
    return x.select("record_id", "entity_id", F.round(S.jaro_winkler_similarity(F.col("l_name_joined"), F.col("r_name_joined")), 6).alias("similarity"))


@query
def pair_fuzzy_ratios(rows):
    x = _pairs(rows)
    each = {k: F.round(v, 6) for k, v in pairs.string_features().items() if k != "name_jaro_winkler"}
    return x.withColumns(each).select("record_id", "entity_id", *each)


@query
def pair_features_33(rows):
    return _features(rows)


def _features(rows: DataFrame) -> DataFrame:
    parsed = written(V.parsed(rows), "parsed")
    index = A.sides(parsed)[1]
    return pairs.pair_features(written(A.view_candidates(parsed), "candidates"), parsed, V.postings(parsed), retrieval.vocabulary(V.postings(index), A.CAP))


# Decisions ----------------------------------------------------------------------------------


@query
def assign_argmax_margin(rows):
    return A.word_decisions(rows)


@query
def assign_threshold(rows):
    return decide.by_threshold(A.word_decisions(rows), THRESHOLD, 0.01).select("record_id", "entity_id")


@query
def top3_candidates(rows):
    return decide.top_n(A.word_candidates(rows).withColumnRenamed("score", "probability")).select("record_id", "entity_id", "probability", "place")


@query
def first_vs_extra(rows):
    return decide.by_place(A.word_decisions(rows), 0.4, 0.6).select("record_id", "entity_id", "place")


@query
def singleton_gate(rows):
    return decide.gated(A.word_decisions(rows), 0.6).select("record_id", "entity_id")


@query
def expected_f_prefix(rows):
    return decide.expected_prefix(A.word_decisions(rows), 0.1, 1.1).select("record_id", "entity_id", "probability")


@query
def stage_scope(rows):
    first = written(A.word_decisions(rows), "decisions")
    second = first.withColumn("probability", F.round(F.col("probability") * 0.9, 6))
    return decide.staged_scope(first, second, ["en", "fr"], 0.5, 0.45).select("country", "record_id", "entity_id")


# Metrics ------------------------------------------------------------------------------------


def _counts(rows: DataFrame) -> DataFrame:
    return metrics.entity_counts(decide.by_threshold(A.word_decisions(rows), THRESHOLD), A.links(rows), A.entities(rows))


@query
def entity_fbeta(rows):
    return metrics.entity_scores(_counts(rows))


@query
def macro_fbeta_report(rows):
    return metrics.report(_counts(rows))


@query
def threshold_margin_sweep(rows):
    return metrics.sweep(A.word_decisions(rows), A.links(rows), A.entities(rows), [0.2, 0.4, 0.5, 0.6, 0.8, 1.0], [0.0, 0.05])


@query
def sweep_leaderboard(rows):
    return metrics.leaderboard(metrics.sweep(A.word_decisions(rows), A.links(rows), A.entities(rows), [0.2, 0.4, 0.5, 0.6, 0.8, 1.0], [0.0, 0.05]), 5)


def _held(rows: DataFrame) -> DataFrame:
    return splits.holdout(rows.where("source = 1").select("id", "country"), by=splits.number).where("split = 'valid'").select(F.col("id").alias("entity_id"))


@query
def holdout_report(rows):
    """The report over held-out entities only."""
    found, own, held = metrics.on_holdout(decide.by_threshold(A.word_decisions(rows), THRESHOLD), A.links(rows), _held(rows))
    return metrics.report(metrics.entity_counts(found, own, held))


@query
def halves_improve(rows):
    """Whether a lower threshold is better than a higher one in both halves."""
    found, halves = written(A.word_decisions(rows), "decisions"), splits.halves(A.entities(rows), by=splits.number)

    def by_half(threshold: float) -> DataFrame:
        scored = metrics.entity_scores(metrics.entity_counts(decide.by_threshold(found, threshold), A.links(rows), A.entities(rows)))
        return scored.join(halves, "entity_id").groupBy("half").agg(F.round(F.avg("f"), 6).alias("macro_f"))

    return metrics.both_halves_improve(by_half(0.9), by_half(0.4))


@query
def loss_buckets(rows):
    return metrics.link_fates(A.word_decisions(rows), A.links(rows), THRESHOLD).groupBy("fate").agg(F.count("*").alias("n"))


@query
def wrong_accepts(rows):
    return metrics.wrong_accepts(A.word_decisions(rows), A.links(rows), THRESHOLD)


@query
def oracle_pricing(rows):
    return metrics.oracle_prices(written(A.word_decisions(rows), "decisions"), A.links(rows), A.entities(rows), THRESHOLD)


@query
def record_precision_recall(rows):
    return metrics.record_rates(A.word_decisions(rows), A.links(rows), [0.2, 0.5, 0.8])


@query
def blocking_recall_sampled(rows):
    """Share of sampled owned records whose owner was retrieved."""
    some = splits.sample(rows.where("source > 1"), 0.5, by=splits.number).select(F.col("id").alias("record_id"))
    owned = A.links(rows).join(some, "record_id", "left_semi")
    got = A.word_candidates(rows).select("record_id", "entity_id", F.lit(1).alias("hit"))
    return owned.join(got, ["record_id", "entity_id"], "left").agg(F.count("*").alias("links"), F.count("hit").alias("found"))


# Groups -------------------------------------------------------------------------------------


@query
def group_shape_features(rows):
    found = groups.shape_features(A.word_decisions(rows).join(rows.select(F.col("id").alias("record_id"), "source"), "record_id"))
    return found.select("record_id", "entity_id", *(c for c in groups.FEATURES if c in found.columns and c not in ("prob", "margin")))


@query
def sibling_agreement(rows):
    kept, parsed = _kept(rows)
    texts = groups.parsed_for_groups(parsed)
    return groups.sibling_features(kept, texts, strings=False).join(groups.self_features(kept, texts, strings=False), "record_id")


def _kept(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions of some weight, and the parsed texts of the records and entities that they name."""
    kept = written(decide.by_threshold(A.word_decisions(rows), 0.3), "decisions")
    named = kept.select(F.explode(F.array("record_id", "entity_id")).alias("id")).distinct()
    few = named.count() <= BROADCAST_IDS  # else whole texts are moved to their ids
    texts = rows.select("id", "source", "country", "name", "address").join(F.broadcast(named) if few else named, "id", "left_semi")
    return kept, written(V.parsed(texts).select("id", "source", "name_joined", "addr_joined"), "parsed")


@query
def group_features_24(rows):
    kept, parsed = _kept(rows)
    return groups.group_features(kept.join(parsed.select(F.col("id").alias("record_id"), "source"), "record_id"), parsed, 0.3)


@query
def group_duplicate_agreement(rows):
    """Agreement of names across the second and third source inside true groups."""
    p = groups.parsed_for_groups(_owned(rows)).join(rows.select("id", "source"), "id")
    side = lambda n, x: A.links(rows).join(p.where(F.col("source") == n), F.expr("id = record_id")).select("entity_id", F.col("ng").alias(f"{x}g"), F.col("name_joined").alias(f"{x}n"))
    both = side(2, "a").join(side(3, "b"), "entity_id")
    return diagnostics.group_duplicates(both.select("entity_id", S.jaccard(F.col("ag"), F.col("bg")).alias("similarity"), (F.col("an") == F.col("bn")).alias("equal")))


def _owned(rows: DataFrame) -> DataFrame:
    """Parsed records that an entity owns."""
    return V.parsed(rows.join(A.links(rows).select(F.col("record_id").alias("id")), "id", "left_semi"))


@query
def within_source_agreement(rows):
    """Agreement of addresses of records that one entity has from one source."""
    owned = groups.parsed_for_groups(_owned(rows)).join(rows.select("id", "source"), "id").join(A.links(rows).withColumnRenamed("record_id", "id"), "id")
    a, b = (owned.select("entity_id", "source", F.col("id").alias(f"{x}id"), F.col("ag").alias(f"{x}g")) for x in "ab")
    both = a.join(b, ["entity_id", "source"]).where("aid < bid")
    return diagnostics.within_sources(both.select("source", F.round(S.jaccard(F.col("ag"), F.col("bg")), 6).alias("similarity")))


# Sinks, checks and profiles -------------------------------------------------------------------


@query
def entity_complete_lists(rows):
    return R.complete_lists(A.entities(rows), decide.by_threshold(A.word_decisions(rows), THRESHOLD))


@query
def empty_baseline_lists(rows):
    return R.empty_lists(A.entities(rows))


@query
def candidate_lists(rows):
    return R.complete_lists(A.entities(rows), A.word_candidates(rows), "candidate_entity_ids")


@query
def matches_subset_candidates(rows):
    found = written(A.word_candidates(rows), "candidates")
    return R.outside(decide.by_threshold(A.decided(found), THRESHOLD), found.select("entity_id", "record_id")).agg(F.count("*").alias("outside"))


@query
def list_summary(rows):
    lists = R.complete_lists(A.entities(rows), A.links(rows))
    return diagnostics.list_summary(lists.join(A.entities(rows), "entity_id"))


@query
def discover_partitions(rows):
    return R.countries(rows)


@query
def source_profile(rows):
    return diagnostics.source_profile(rows)


@query
def distractors(rows):
    return diagnostics.distractors(rows, A.links(rows))


@query
def exclusivity_check(rows):
    return diagnostics.shared_records(A.links(rows)).agg(F.count("*").alias("shared"))


@query
def country_mix(rows):
    return diagnostics.country_agreement(rows, A.links(rows))


@query
def match_histogram(rows):
    return diagnostics.group_sizes(A.entities(rows), A.links(rows))


@tabled
def nearest_rank_percentiles(spark, sf_dir):
    return diagnostics.nearest_rank(A.table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@query
def separability(rows):
    each = pairs.signals(strings=False)
    p = pairs.with_folded(_pairs(rows), rows).withColumns(each)
    own = A.links(rows).select("record_id", "entity_id", F.lit(1).alias("own"))
    labelled = p.join(own, ["record_id", "entity_id"], "left").withColumn("label", F.coalesce("own", F.lit(0)))
    return diagnostics.separability(labelled, list(each))


@query
def text_variants(rows):
    """The three texts by which plain character n-gram retrieval is tried."""
    return V.text_variants(V.parsed(rows))


@query
def delivery_problems(rows):
    """Checks of the lists that would be delivered; without the entities of one country, which shows
    them as missing."""
    found = written(A.word_candidates(rows), "candidates")
    matches = R.complete_lists(A.entities(rows).where("country <> 'es'"), decide.by_threshold(A.decided(found), THRESHOLD))
    return R.problems(A.entities(rows), matches, R.complete_lists(A.entities(rows), found, "candidate_entity_ids"))


@query
def list_sizes(rows):
    """Entities and ids in lists, by country of the entity ('?' if unknown)."""
    lists = R.complete_lists(A.entities(rows), A.word_candidates(rows), "candidate_entity_ids").join(A.entities(rows), "entity_id", "left")
    return lists.groupBy(F.coalesce("country", F.lit("?")).alias("country")).agg(F.count("*").alias("entities"), F.sum(F.when(F.col("candidate_entity_ids") == "", 0).otherwise(F.size(F.split("candidate_entity_ids", ",")))).alias("ids"))


@query
def stream_shards(rows):
    """Rows by shard: every row in exactly one."""
    parts = [R.shard(rows, 4, i).select(F.lit(i).alias("shard"), "id") for i in range(4)]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


# Samples and splits ---------------------------------------------------------------------------


@query
def grouped_holdout(rows):
    return splits.holdout(rows.where("source = 1").select("id", "country"), by=splits.number)


@query
def holdout_mix(rows):
    return splits.split_mix(splits.holdout(rows.where("source = 1").select("id", "country"), by=splits.number))


@query
def loco_folds(rows):
    return splits.country_folds(rows.where("source = 1").select("id", "country")).groupBy("fold", "split").agg(F.count("*").alias("n"))


@query
def hash_sample(rows):
    return splits.sample(rows, 0.1, by=splits.number).select("id")


@query
def fixed_sample(rows):
    return splits.fixed_sample(rows, 100, by=splits.number).select("id")


@query
def half_split(rows):
    return splits.halves(A.entities(rows), by=splits.number).select("entity_id", "half")


@query
def dev_pool(rows):
    return splits.dev_pool(rows, A.links(rows), 50, by=splits.number).select("id", "source")


@query
def fast_eval_queries(rows):
    return splits.evaluation_queries(rows, A.links(rows), 0.05, by=splits.number).select("id")


@query
def labelled_pairs(rows):
    held = splits.holdout(rows.where("source = 1").select("id", "country"), by=splits.number).where("split = 'valid'").select(F.col("id").alias("entity_id"))
    found = pairs.labelled(A.word_candidates(rows), A.links(rows), held)
    return found.groupBy("label").agg(F.count("*").alias("n"))


@tabled
def events_top_value(spark, sf_dir):
    """Top 3 events of each user by value: the rank filter over plain rows."""
    best = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = A.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return e.withColumn("place", F.row_number().over(best)).where("place <= 3")


# Models -------------------------------------------------------------------------------------


def _labelled(rows: DataFrame) -> DataFrame:
    found = _features(rows)
    own = A.links(rows).select("record_id", "entity_id", F.lit(1).alias("own"))
    return found.join(own, ["record_id", "entity_id"], "left").withColumn("label", F.coalesce("own", F.lit(0))).drop("own")


@query
def gbdt_score(rows):
    """The first stage, trained on the pairs of one half of the entities and applied to the other."""
    data = written(splits.halves(_labelled(rows), by=splits.number), "labelled")
    model = models.train(data.where("half = 'A'"), pairs.FEATURES, models.STAGE_ONE)
    return models.score(data.where("half = 'B'"), model).select("record_id", "entity_id", "label", "probability")


@tabled
def linkage_job(spark, sf_dir):
    """The whole job: both stages trained, decisions rescored, lists delivered and checked, and the
    holdout report of both stages."""
    rows = A.records(spark, sf_dir)
    steps = Steps(spark, f"{shared_folder(spark)}/linkloom-{uuid.uuid4().hex}/job")
    report = written(job.train(steps, rows, A.links(rows), by=splits.number), "report")
    tables = {name: spark.read.parquet(steps.path(name)) for name in ("rescored", "candidates")}
    job.deliver(tables["rescored"], tables["candidates"], A.entities(rows), steps.path("lists"))
    return report


@query
def isotonic_calibration(rows):
    own = A.links(rows).select("record_id", "entity_id", F.lit(1).alias("own"))
    found = A.word_decisions(rows).join(own, ["record_id", "entity_id"], "left").withColumn("label", F.coalesce("own", F.lit(0)))
    return models.cross_calibrate(splits.halves(written(found, "decisions"), by=splits.number)).select("record_id", "entity_id", "probability", F.round("calibrated", 6).alias("calibrated"))


@query
def average_precision(rows):
    own = A.links(rows).select("record_id", "entity_id", F.lit(1).alias("own"))
    found = A.word_decisions(rows).join(own, ["record_id", "entity_id"], "left").withColumn("label", F.coalesce("own", F.lit(0)))
    return models.average_precision(found)
