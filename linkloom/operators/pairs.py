"""The 33 features of a candidate pair, and labelled training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions import text as T
from linkloom.sources.staging import spread

#: Names and order of the model's inputs.
FEATURES = (
    "name_jaccard name_token_set_ratio name_token_sort_ratio name_partial_ratio name_jaro_winkler name_trigram_jaccard name_idf_overlap name_rare_shared "
    "name_acronym_match name_len_ratio name_either_empty addr_jaccard addr_token_set_ratio addr_trigram_jaccard addr_idf_overlap addr_rare_shared addr_len_ratio "
    "num_jaccard num_shared num_conflict num_either_missing addr_either_empty addr_both_empty rank_composite rank_ngram rank_best score_composite score_ngram "
    "score_best is_reverse_best score_margin_to_next n_candidates_for_record candidate_is_s3"
).split()

_CARRIED = ("name", "address", "core", "addr", "numbers", "name_joined", "addr_joined", "source")


def side_by_side(pairs: DataFrame, parsed: DataFrame, right: str = "entity_id", left: str = "record_id") -> DataFrame:
    """Pairs with the parsed columns of both records, prefixed l_ and r_."""
    own = parsed.withColumns({"name_grams": T.char_ngrams(F.col("name_joined")), "addr_grams": T.char_ngrams(F.col("addr_joined"))})
    carried = (*_CARRIED, "name_grams", "addr_grams")
    a = own.select(F.col("id").alias(left), *(F.col(c).alias(f"l_{c}") for c in carried))
    b = own.select(F.col("id").alias(right), *(F.col(c).alias(f"r_{c}") for c in carried))
    return spread(pairs, left).join(a, left).join(b, right)


def set_features() -> dict[str, Column]:
    """Those that need arrays and lengths only."""
    l_, r_ = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    blank = lambda c: F.trim(c) == ""
    first = S.acronym(l_("core"))
    both_numbers = (F.size(l_("numbers")) > 0) & (F.size(r_("numbers")) > 0)
    flag = lambda c: c.cast("double")
    return {
        "name_jaccard": S.jaccard(l_("core"), r_("core")),
        "name_trigram_jaccard": S.jaccard(l_("name_grams"), r_("name_grams")),
        "name_acronym_match": flag((first != "") & (first == S.acronym(r_("core")))),
        "name_len_ratio": S.size_ratio(F.length(l_("name_joined")), F.length(r_("name_joined"))),
        "name_either_empty": flag(blank(l_("name")) | blank(r_("name"))),
        "addr_jaccard": S.jaccard(l_("addr"), r_("addr")),
        "addr_trigram_jaccard": S.jaccard(l_("addr_grams"), r_("addr_grams")),
        "addr_len_ratio": S.size_ratio(F.length(l_("addr_joined")), F.length(r_("addr_joined"))),
        "num_jaccard": S.jaccard(l_("numbers"), r_("numbers")),
        "num_shared": F.size(F.array_intersect(l_("numbers"), r_("numbers"))).cast("double"),
        "num_conflict": flag(both_numbers & ~F.arrays_overlap(l_("numbers"), r_("numbers"))),
        "num_either_missing": flag(~both_numbers),
        "addr_either_empty": flag(blank(l_("address")) | blank(r_("address"))),
        "addr_both_empty": flag(blank(l_("address")) & blank(r_("address"))),
    }


def signals(strings: bool = True) -> dict[str, Column]:
    """The seven signals by which owned pairs are told from hard negatives, null where undefined; of
    pairs with `folded` columns (see `with_folded`).  Without `strings`, six of them."""
    l_, r_ = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    blank = lambda c: F.trim(c) == ""
    each = {
        "name_jaccard": S.jaccard_or_null(l_("folded_core"), r_("folded_core")),
        "name_jaccard_romanized": S.jaccard_or_null(l_("core"), r_("core")),
        "addr_jaccard": S.jaccard_or_null(l_("folded_addr"), r_("folded_addr")),
        "addr_jaccard_romanized": S.jaccard_or_null(l_("addr"), r_("addr")),
        "addr_numeric_jaccard": S.jaccard_or_null(l_("numbers"), r_("numbers")),
        "addr_empty_either": (blank(l_("address")) | blank(r_("address"))).cast("double"),
    }
    if strings:
        sorted_set = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), " ")
        each["name_token_set_ratio"] = S.token_set_ratio(sorted_set(l_("core")), sorted_set(r_("core")))
    return each


def with_folded(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Adds l_ and r_ folded_core and folded_addr: tokens without romanisation."""
    own = records.select("id", T.name_core(T.name_tokens(T.fold(T.clean_name(F.col("name"))))).alias("folded_core"), T.address_tokens(T.fold(T.strip_junk(F.col("address")))).alias("folded_addr"))
    side = lambda i, x: own.select(F.col("id").alias(i), *(F.col(c).alias(f"{x}_{c}") for c in ("folded_core", "folded_addr")))
    return pairs.join(side("record_id", "l"), "record_id").join(side("entity_id", "r"), "entity_id")


def string_features() -> dict[str, Column]:
    """Those that compare strings, in Arrow batches."""
    name, addr = (F.col("l_name_joined"), F.col("r_name_joined")), (F.col("l_addr_joined"), F.col("r_addr_joined"))
    return {
        "name_token_set_ratio": S.token_set_ratio(*name),
        "name_token_sort_ratio": S.token_sort_ratio(*name),
        "name_partial_ratio": S.partial_ratio(*name),
        "name_jaro_winkler": S.jaro_winkler_similarity(*name),
        "addr_token_set_ratio": S.token_set_ratio(*addr),
    }


def context_features() -> dict[str, Column]:
    """Those that retrieval gives."""
    given = {c: F.col(c).cast("double") for c in ("rank_composite", "rank_ngram", "rank_best", "score_composite", "score_ngram", "score_best", "score_margin_to_next", "n_candidates_for_record")}
    return given | {"is_reverse_best": (F.col("rank_best") == 0).cast("double"), "candidate_is_s3": (F.col("l_source") == 3).cast("double")}


def idf_overlap(pairs: DataFrame, postings: DataFrame, idf: DataFrame, prefix: str, name: str) -> DataFrame:
    """(record_id, entity_id, {name}_idf_overlap, {name}_rare_shared): weight of shared over all
    tokens with this prefix, and the largest shared weight.  Sums come from two joins on tokens,
    not from maps carried on each pair."""
    tag = prefix + ":"
    best = idf.where(F.col("token").startswith(tag)).groupBy("country", "token").agg(F.max("idf").alias("idf"))
    own = postings.where(F.col("token").startswith(tag)).select("country", "id", "token").distinct().join(best, ["country", "token"])
    total = own.groupBy("id").agg(F.sum("idf").alias("total"))
    both = pairs.select("country", "record_id", "entity_id")
    a = own.select("country", F.col("id").alias("record_id"), "token", "idf")
    b = own.select("country", F.col("id").alias("entity_id"), "token")
    shared = both.join(a, ["country", "record_id"]).join(b, ["country", "entity_id", "token"]).groupBy("record_id", "entity_id").agg(F.sum("idf").alias("shared"), F.max("idf").alias("rare"))
    found = both.join(shared, ["record_id", "entity_id"], "left")
    found = found.join(total.select(F.col("id").alias("record_id"), F.col("total").alias("ta")), "record_id", "left").join(total.select(F.col("id").alias("entity_id"), F.col("total").alias("tb")), "entity_id", "left")
    some = F.coalesce("shared", F.lit(0.0))
    whole = F.coalesce("ta", F.lit(0.0)) + F.coalesce("tb", F.lit(0.0)) - some
    return found.select("record_id", "entity_id", F.when(whole > 0, some / whole).otherwise(F.lit(0.0)).alias(f"{name}_idf_overlap"), F.coalesce("rare", F.lit(0.0)).alias(f"{name}_rare_shared"))


def pair_features(candidates: DataFrame, parsed: DataFrame, postings: DataFrame, vocab: DataFrame, zero_idf: bool = False) -> DataFrame:
    """country, record_id, entity_id and the 33 features, in order, of candidates with context.
    `zero_idf` gives the four IDF features as 0, as models trained without them expect."""
    wide = side_by_side(candidates, parsed)
    each = set_features() | string_features() | context_features()
    if zero_idf:
        each |= {f"{n}_{f}": F.lit(0.0) for n in ("name", "addr") for f in ("idf_overlap", "rare_shared")}
        return wide.withColumns(each).select("country", "record_id", "entity_id", *FEATURES)
    found = wide.withColumns(each).select("country", "record_id", "entity_id", *each)
    for prefix, name in (("n", "name"), ("a", "addr")):
        found = found.join(idf_overlap(candidates, postings, vocab, prefix, name), ["record_id", "entity_id"])
    return found.select("country", "record_id", "entity_id", *FEATURES)


def labelled(pairs: DataFrame, owners: DataFrame, valid_entities: DataFrame, unowned_share: float = 0.18, seed: int = 42) -> DataFrame:
    """Adds label (1: the owner) and is_valid: by the owner's side of the split; records without
    an owner by hash, in the same share."""
    own = owners.select("record_id", F.col("entity_id").alias("owner"))
    held = valid_entities.select(F.col("entity_id").alias("owner"), F.lit(True).alias("_valid")).distinct()
    found = pairs.join(own, "record_id", "left").join(held, "owner", "left")
    by_hash = F.pmod(F.xxhash64("record_id", F.lit(seed)), F.lit(1_000_000)) < int(unowned_share * 1_000_000)
    valid = F.when(F.col("owner").isNull(), by_hash).otherwise(F.coalesce("_valid", F.lit(False)))
    label = F.coalesce(F.col("owner") == F.col("entity_id"), F.lit(False))
    return found.withColumns({"label": label.cast("byte"), "is_valid": valid.cast("byte")}).drop("owner", "_valid")
