import base64

import numpy as np
import pytest
import tiktoken

from linkloom.llm.tokens import PATTERN, VOCABULARY, allocate, attribute_tokens, op1_token_counts

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
ENC = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute(text, rule="first"):
    """Token counts by line, one token at a time."""
    raw, line_of, line = text.encode(), [], 0
    for b in raw:
        line_of.append(line)
        line += b == 10
    n = (line_of[-1] if raw else 0) + 1
    counts, at = [0] * n, 0
    for size in map(len, ENC.decode_tokens_bytes(ENC.encode_ordinary(text))):
        own = line_of[at : at + size]
        counts[own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)] += 1
        at += size
    return counts


@pytest.mark.parametrize("rule", ["first", "last", "largest"])
def test_counts_match_brute_force(spark, rule):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: "a\n\n\nb \n  c", -2: "", -3: "é世界\n\n界"}
    more = spark.createDataFrame([(i, t) for i, t in texts.items() if i < 0], "doc_id long, text string")
    got = {}
    for r in attribute_tokens(docs.select("doc_id", "text").union(more), rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.n_tokens, r.char_start, r.char_end, r.doc_tokens))
    for i, text in texts.items():
        rows = sorted(got[i])
        assert [r[1] for r in rows] == brute(text, rule)
        assert "".join(text[a:b] for _, _, a, b, _ in rows) == text
        assert {r[4] for r in rows} == {len(ENC.encode_ordinary(text))}


def test_fields_nulls_and_repeats(spark):
    rows = [(1, "user", "hello there"), (1, "user", "hello there"), (2, None, None), (None, "x", "a" * 300_000), (3, "", "one\ntwo")]
    df = spark.createDataFrame(rows, "doc_id long, role string, text string").selectExpr("*", "1 as n_tokens", "2 as section")
    got = attribute_tokens(df, fields=("role", "text"), lines=False).collect()
    assert len(got) == 10
    assert sorted((r.field, r.n_tokens) for r in got if r.doc_id == 1) == [(0, 2), (0, 2), (1, 2), (1, 2)]
    assert [r.n_tokens for r in got if r.doc_id == 2] == [1, 0]
    assert [(r.char_start, r.char_end) for r in got if r.doc_id == 3] == [(0, 1), (1, 8)]
    assert attribute_tokens(df.limit(0)).count() == 0
    assert op1_token_counts(spark, "/root/testdata/sf0.001").where("n_tokens < 0 or char_end < char_start").count() == 0


def test_allocation_over_many_sections():
    to, cross = allocate(np.array([0, 4]), np.array([4, 9]), np.array([0, 3, 5, 6]), "largest")
    assert to.tolist() == [0, 3] and cross.tolist() == [True, True]
