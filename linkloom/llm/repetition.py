"""Quality rules by repetition coverage.

Rolling hashes of several word n-gram lengths, computed in numpy over whole texts,
mark every character inside an n-gram or a line that occurs more than once in the
same text.  A text is kept if it passes the base rules and no share of covered
characters exceeds its limit.

Rows are judged one by one inside their own partition: no shuffle, no driver state,
any lost task is simply run again.  Null or empty text has no words and fails the
base rules; repeated rows and repeated ids each get their own result; further
columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import _bytes as B

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_SALT = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class Limits:
    """Largest allowed share of word characters inside repeated n-grams (by n) and lines."""

    ngram: dict[int, float] = field(default_factory=lambda: {5: 0.20, 7: 0.18, 10: 0.16})
    line_chars: float = 0.25
    min_words: int = 10
    repeat_percent: int = 20


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_cover double, {}"


def measure(texts: B.Texts, limits: Limits) -> dict[str, np.ndarray]:
    """All figures of one slice of texts."""
    buf = texts.buf
    words = B.split(texts)
    owner = words.text_of()
    codes = B.byte_codes(buf)
    solid = np.ones(len(buf), bool)
    solid[B._SPACE[buf]] = False
    char = solid & ((buf & 0xC0) != 0x80)
    chars_before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(char, out=chars_before[1:])
    n_words = np.diff(words.first)
    word_chars = chars_before[texts.offs[1:]] - chars_before[texts.offs[:-1]]
    h = B.span_hashes(codes, words.starts, words.ends)
    chars = chars_before[words.ends] - chars_before[words.starts]
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": B.per_text(_IS_SYMBOL[buf], texts.offs)}

    # Lines: between text edges and newlines, only those with a word.
    breaks = np.flatnonzero(buf == 0x0A)
    starts = np.union1d(texts.offs[:-1], breaks + 1)
    starts = starts[starts < len(buf)]
    ends = np.minimum(np.append(starts[1:], len(buf)), np.append(breaks, len(buf))[np.searchsorted(breaks, starts)])
    line_chars = chars_before[ends] - chars_before[starts]
    some = line_chars > 0
    starts, ends, line_chars = starts[some], ends[some], line_chars[some]
    line_text = np.searchsorted(texts.offs, starts, "right") - 1
    many, later = B.repeated(B.span_hashes(codes, starts, ends) + line_text.astype(np.uint64) * _SALT)
    first = np.searchsorted(line_text, np.arange(len(n_words) + 1))
    out["n_dup_lines"] = B.per_text(later, first)
    size = np.maximum(word_chars, 1)
    out["line_cover"] = B.per_text(many * line_chars, first) / size

    salt = owner.astype(np.uint64) * _SALT
    repeat = np.zeros(len(h), bool)
    over = out["line_cover"] > limits.line_chars
    for n in sorted({WINDOW, *limits.ngram}):
        g, at = B.shingle_hashes(h, owner, n)
        many, _ = B.repeated(g + salt[at])
        inside = B.covered(at[many], n, len(h))
        if n == WINDOW:
            repeat = inside
        share = B.per_text(inside * chars, words.first) / size
        out[f"cover_{n}"] = share
        if n in limits.ngram:
            over |= share > limits.ngram[n]
    out["n_repeat_words"] = B.per_text(repeat, words.first)
    out["base_failed"] = (n_words < limits.min_words) | (100 * out["n_repeat_words"] > limits.repeat_percent * n_words)
    out["kept"] = ~out["base_failed"] & ~over
    return out


def repetition_coverage(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the base figures, each coverage share and the verdict."""
    lengths = sorted({WINDOW, *limits.ngram})
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    figures = SCHEMA.format(", ".join(f"cover_{n} double" for n in lengths))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {figures}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for texts in B.slices(batch.column(1)):
                found = measure(texts, limits)
                names = [x.split()[0] for x in figures.split(", ")]
                yield pa.RecordBatch.from_arrays([ids[texts.lo : texts.hi], *(pa.array(found[k]) for k in names)], ["doc_id", *names])

    return source.mapInArrow(run, schema)


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_coverage(spark.read.parquet(f"{sf_dir}/documents.parquet"))
