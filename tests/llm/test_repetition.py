import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from linkloom.llm import _bytes as B
from linkloom.llm.repetition import Limits, measure, repetition_coverage


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeat = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat)


KEYS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t\r\x0b\x0c|é世\x1f"), max_size=60), max_size=8), st.integers(1, 80))
def test_base_figures_match_brute_force(texts, limit):
    got = [[] for _ in KEYS]
    for s in B.slices(pa.array(texts, pa.string()), limit):
        found = measure(s, Limits())
        for values, k in zip(got, KEYS):
            values += [int(x) for x in found[k]]
    assert [tuple(r) for r in zip(*got)] == [brute(t) for t in texts]


def test_rows_nulls_long_texts_and_clashing_columns(spark):
    clean = " ".join(f"word{i}" for i in range(200))
    rows = [(1, None, 9), (1, "", 9), (None, clean, None), (2, clean, 1), (2, clean, 1), (3, "a b c d e f " * 50_000, 1), (4, "| x " * 50, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((r.doc_id or 0, r.n_words, r.kept) for r in repetition_coverage(docs).collect())
    assert got == [(0, 200, True), (1, 0, False), (1, 0, False), (2, 200, True), (2, 200, True), (3, 300_000, False), (4, 100, False)]
    assert repetition_coverage(docs.limit(0)).count() == 0


def test_repeated_lines_are_covered(spark):
    line = "the very same closing line of many words appears again here now"
    text = "\n".join([line] * 5 + [" ".join(f"w{i}" for i in range(60))])
    (row,) = repetition_coverage(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_dup_lines == 4 and not row.kept
    assert row.line_cover == pytest.approx(row.cover_5)
