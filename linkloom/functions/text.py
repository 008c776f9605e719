"""Normalisation and tokenisation of names and addresses as column expressions.

Everything is a built-in expression except `fold` and `romanise`, which need Unicode data that
Spark has no function for; they send only rows with characters outside ASCII through an
Arrow-batched function.  Blank and null text give empty arrays or strings.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Decoration, markers and word lists that define the token space.
JUNK_AFFIX = r"""^[\s\-–—<>#*~^|/\\.,;:!+=_'"()\[\]{}]+|[\s\-–—<>#*~^|/\\;:!+=_'"]+$"""
TRADE_NAME = r"(?i)\b(?:d\s*/?\s*b\s*/?\s*a|doing\s+business\s+as|trading\s+as|t\s*/\s*a|formerly|aka|a\s*/\s*k\s*/\s*a)\b"
MESSRS = r"(?i)^\s*m\s*/\s*s\.?\s+"
DOMAIN = r"(?i)^([a-z0-9][a-z0-9\-]*)\.(?:com|net|org|co|in|io|biz|info|fr|us|co\.in|co\.uk)$"
ORDINAL = r"(?i)\b(\d+)(?:st|nd|rd|th)\b"
TOKEN = r"[\p{L}\p{N}]+"
LEGAL_NOISE = "private limited ltd pvt inc incorporated corporation corp company co llc llp lp plc opc sarl sasu eurl sas sa sci snc the and of".split()
STREET_WORDS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "dr": "drive", "blvd": "boulevard", "bd": "boulevard",
    "ln": "lane", "ct": "court", "cir": "circle", "pl": "place", "sq": "square", "ter": "terrace", "hwy": "highway", "pkwy": "parkway",
    "trl": "trail", "apt": "apartment", "ste": "suite", "bldg": "building", "flr": "floor", "fl": "floor", "rm": "room", "dept": "department",
    "pob": "po", "no": "number", "nos": "number", "hno": "number", "dno": "number", "khno": "number", "plotno": "number", "doorno": "number",
    "sn": "survey", "opp": "opposite", "nr": "near", "bldng": "building", "mkt": "market",
}
DIRECTIONS = {"n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}

#: Latin letters without a decomposition.
_LATIN = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "ı": "i"})


def _folded(text: str) -> str:
    kept = (c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text)) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", "".join(kept)).lower()


def _letter(c: str) -> str:
    """Latin spelling of a letter or vowel sign from its Unicode name."""
    name = unicodedata.name(c, "")
    m = re.search(r"(LETTER|VOWEL SIGN|SYLLABLE|IDEOGRAPH-)\s*(?:SMALL |CAPITAL |FINAL )?([A-Z]+)", name)
    if not m:
        digit = unicodedata.decimal(c, None)
        return str(digit) if digit is not None else "" if unicodedata.category(c)[0] == "M" else " "
    return m[2].lower()


def _romanised(text: str) -> str:
    """ASCII text: accents dropped, other letters spelled by name.  An inherent vowel goes before
    a vowel sign or a mark that silences it."""
    out: list[str] = []
    for c in unicodedata.normalize("NFKC", text).translate(_LATIN):
        if c < "\x80":
            out.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if x < "\x80")
        if plain:
            out.append(plain)
            continue
        kind = unicodedata.category(c)
        sign = "VOWEL SIGN" in unicodedata.name(c, "") or unicodedata.combining(c) == 9
        if sign and out and len(out[-1]) > 1 and out[-1].endswith("a"):
            out[-1] = out[-1][:-1]
        out.append(_letter(c) if kind[0] in "LMN" else " " if kind[0] in "PSZ" else "")
    return "".join(out)


def _beyond_ascii(text: str) -> str | None:
    return None if unicodedata.normalize("NFKC", text).isascii() else "y"


@cache
def _arrow(one):
    """An Arrow-batched function of one string; made on first use, as workers import this module."""

    def many(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return F.pandas_udf(many, "string")


def _not_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def non_latin(text: Column) -> Column:
    """Whether any character lies outside ASCII after compatibility folding, so that full-width
    ASCII does not count.  Null for null."""
    return F.when(_not_ascii(text), _arrow(_beyond_ascii)(F.when(_not_ascii(text), text)).isNotNull()).otherwise(F.when(text.isNotNull(), F.lit(False)))


def fold(text: Column) -> Column:
    """Compatibility form, without combining marks, in lower case."""
    return F.coalesce(_arrow(_folded)(F.when(_not_ascii(text), text)), F.lower(text))


def romanise(text: Column) -> Column:
    """ASCII spelling of text in any script; ASCII text unchanged."""
    return F.coalesce(_arrow(_romanised)(F.when(_not_ascii(text), text)), text)


def strip_junk(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), JUNK_AFFIX, "")


def trade_name(text: Column) -> Column:
    """What follows the last trade-name marker, unless blank."""
    tail = F.trim(F.element_at(F.split(text, TRADE_NAME), -1))
    return F.when(text.rlike(TRADE_NAME) & (tail != ""), tail).otherwise(text)


def strip_ordinals(text: Column) -> Column:
    return F.regexp_replace(text, ORDINAL, "$1")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def canon_number(text: Column) -> Column:
    """Without leading zeros in any run of digits."""
    return F.regexp_replace(text, r"(?<!\d)0+(?=\d)", "")


def clean_name(raw: Column) -> Column:
    """Name without decoration, prefix and shell company; not yet folded."""
    return trade_name(F.regexp_replace(strip_junk(raw), MESSRS, ""))


def name_tokens(folded: Column) -> Column:
    """Tokens of a cleaned and folded name; a bare domain counts as its label."""
    label = F.regexp_extract(F.trim(folded), DOMAIN, 1)
    return tokens(strip_ordinals(F.when(label != "", label).otherwise(folded)))


def name_core(token_array: Column) -> Column:
    """Without legal forms and stop words."""
    return F.filter(token_array, lambda t: ~t.isin(LEGAL_NOISE))


def _spelled(token: Column) -> Column:
    words = DIRECTIONS | STREET_WORDS
    pairs = reduce(lambda a, b: a + b, ([F.lit(k), F.lit(v)] for k, v in words.items()))
    return F.coalesce(F.element_at(F.create_map(*pairs), token), token)


def address_tokens(folded: Column) -> Column:
    """Tokens of a cleaned and folded address: numbers canonical, street words spelled out."""
    return F.transform(tokens(strip_ordinals(folded)), lambda t: _spelled(canon_number(t)))


def numeric_keys(token_array: Column) -> Column:
    return F.array_distinct(F.filter(token_array, lambda t: t.rlike(r"\d")))


def char_ngrams(text: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Distinct character n-grams of the text without white space, in time linear in its length:
    the text is split into characters once, and every gram is put together from n of them."""
    none = F.array().cast("array<string>")

    def grams(chars: Column, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: F.concat(*(F.get(chars, i + j) for j in range(n))))
        return F.when(F.size(chars) >= n, cut).otherwise(none)

    def all_sizes(chars: Column) -> Column:
        return F.array_distinct(F.concat(*(grams(chars, n) for n in sizes)))

    # A lambda binds the characters, so that they are split once for all sizes.
    return F.get(F.transform(F.array(F.split(F.regexp_replace(text, r"\s+", ""), "")), all_sizes), F.lit(0))


def locality(address: Column, parts: int = 3) -> Column:
    """The last non-blank parts of a comma-separated address."""
    some = F.filter(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p) != "")
    return F.slice(some, F.greatest(F.size(some) - parts + 1, F.lit(1)), parts)
