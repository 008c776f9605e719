"""Token views: arrays of prefixed tokens by which records are retrieved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text as T

DEFAULT_VIEWS = ("composite", "ngram")


def parsed(records: DataFrame) -> DataFrame:
    """Adds the record-level columns that views and features share: core and addr (token
    arrays, romanised), numbers, places, and the joined strings.  Each Python-backed column is
    computed once here; the rest are built-in expressions over them."""
    cleaned = records.withColumns({"_name": T.romanise(T.clean_name(F.col("name"))), "_addr": T.romanise(T.strip_junk(F.col("address")))})
    folded = cleaned.withColumns({"_name": F.lower("_name"), "_addr": F.lower("_addr")})
    tokens = folded.withColumns({"core": T.name_core(T.name_tokens(F.col("_name"))), "addr": T.address_tokens(F.col("_addr"))})
    place = F.array_distinct(F.flatten(F.transform(T.locality(F.col("_addr")), lambda p: T.address_tokens(p))))
    named = tokens.withColumns({"numbers": T.numeric_keys(F.col("addr")), "places": place, "name_joined": F.array_join("core", " "), "addr_joined": F.array_join("addr", " ")})
    return named.drop("_name", "_addr")


def _tag(prefix: str, array: str) -> Column:
    return F.transform(F.array_distinct(F.col(array)), lambda t: F.concat(F.lit(prefix + ":"), t))


def _address() -> Column:
    return F.array_union(_tag("a", "addr"), _tag("d", "numbers"))


def _name() -> Column:
    return _tag("n", "core")


def _grams(prefix: str, joined: str) -> Column:
    return F.transform(T.char_ngrams(F.col(joined)), lambda g: F.concat(F.lit(prefix + ":"), g))


def _combined() -> Column:
    return F.array_union(_address(), _name())


def _composite() -> Column:
    digits, places = F.slice(F.array_sort("numbers"), 1, 4), F.slice(F.array_sort("places"), 1, 6)
    cross = F.flatten(F.transform(digits, lambda d: F.transform(places, lambda p: F.concat(F.lit("c:"), d, F.lit("|"), p))))
    return F.array_union(_combined(), cross)


VIEWS = {
    "address": _address,
    "name": _name,
    "ngram": lambda: _grams("g", "name_joined"),
    "addr_ngram": lambda: _grams("h", "addr_joined"),
    "combined": _combined,
    "composite": _composite,
    "full": lambda: F.array_union(_composite(), _grams("g", "name_joined")),
}


def postings(records: DataFrame, views: tuple[str, ...] = DEFAULT_VIEWS) -> DataFrame:
    """(country, view, id, token) of parsed records, every token of a view once."""
    each = F.array(*(F.struct(F.lit(v).alias("view"), VIEWS[v]().alias("tokens")) for v in views))
    shown = records.select("country", "id", F.explode(each).alias("v")).select("country", "id", "v.view", F.explode("v.tokens").alias("token"))
    return shown.select("country", "view", "id", "token")


def text_variants(records: DataFrame) -> DataFrame:
    """(id, variant, text) of parsed records: name, address, and both."""
    texts = {"name only": F.col("name_joined"), "address only": F.col("addr_joined"), "name+address": F.concat_ws(" ", "name_joined", "addr_joined")}
    each = F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("text")) for k, v in texts.items()))
    return records.select("id", F.explode(each).alias("v")).select("id", "v.*")


def exact_keys(records: DataFrame) -> DataFrame:
    """(id, country, key, value): deterministic keys of parsed records, null where empty."""
    words = F.array_join(F.array_sort(F.filter("addr", lambda t: ~t.rlike(r"\d"))), " ")
    numbers, addr, core = (F.array_join(F.array_sort(c), " ") for c in ("numbers", "addr", "core"))
    last = F.coalesce(F.try_element_at(F.array_sort("addr"), F.lit(-1)), F.lit(""))
    keys = {
        "addr_set": addr,
        "addr_words": words,
        "numbers": numbers,
        "name_core": core,
        "name_numbers": F.when((core != "") & (numbers != ""), F.concat(core, F.lit("|"), numbers)),
        "numbers_locality": F.when(numbers != "", F.concat(numbers, F.lit("|"), last)),
    }
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.nullif(v, F.lit("")).alias("value")) for k, v in keys.items()))
    return records.select("id", "country", F.explode(each).alias("k")).select("id", "country", "k.*")
