"""Queries read whole texts, wherever in a document a word or number stands."""

import math
import re
from collections import Counter

import pytest

from linkloom.functions import views as V
from linkloom.plans import adapter as A
from linkloom.plans.queries import QUERIES

FILLER = "the of and to in is that for " * 40  # over a thousand characters
TEXTS = {
    0: FILLER + "zebra quartz",
    1: FILLER + "zebra quartz",
    2: FILLER + "\nthird line\nmaple 4711, Harbour Town",
    3: FILLER + "\nsecond\nmaple 4711, Harbour Town",
    4: FILLER.upper() + "ZEBRA QUARTZ",
    6: "Short",
    7: "",
    8: None,
    9: FILLER + "violet",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en") for i, t in TEXTS.items()], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    return at


def name(i):
    return f"S{i % 3 + 1}-{i}"


def test_roles_cover_the_text(spark, folder):
    rows = A.records(spark, folder)
    for r in rows.collect():
        if r.text is not None:
            assert r.name + ("\n" if "\n" in r.text else "") + r.address == r.text
    assert {(r.record_id, r.entity_id) for r in A.links(rows).collect()} == {(name(1), name(0)), (name(4), name(0))}
    tokens = {(r.id, r.token) for r in V.postings(V.parsed(rows), ("address",)).collect()}
    assert {(name(2), "d:4711"), (name(3), "d:4711"), (name(2), "a:harbour")} <= tokens


def test_flagship_matches_brute_force(spark, folder):
    words = {name(i): set(re.findall(r"\w+", (t or "").lower())) for i, t in TEXTS.items()}
    index = {k: w for k, w in words.items() if k.startswith("S1") and w}
    df = Counter(x for w in index.values() for x in w)
    idf = {x: math.log(1 + len(index) / n) for x, n in df.items() if n <= max(1, 0.5 * len(index))}
    size = lambda w: math.sqrt(sum(idf.get(x, 0) ** 2 for x in w))
    want = {}
    for q in words:
        if q.startswith("S1"):
            continue
        found = [(round(sum(idf[x] ** 2 for x in w & words[q] if x in idf) / size(w) / size(words[q]), 6), e) for e, w in index.items() if any(x in idf for x in w & words[q])]
        for n, (score, e) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:5]):
            want[q, e] = (score, n)
    got = {(r.record_id, r.entity_id): (r.score, r.rank) for r in QUERIES["flagship_cosine_topk"](spark, folder).collect()}
    assert got == want and (name(1), name(0)) in want and (name(2), name(3)) in want


@pytest.mark.parametrize("query, column", [("tokenize_names", "tokens"), ("abbrev_address", "tokens"), ("fold_accents", "folded"), ("romanised_names", "latin")])
def test_text_queries_reach_the_end(spark, folder, query, column):
    got = {r.id: r[column] for r in QUERIES[query](spark, folder).collect()}
    assert got[name(1)].endswith("zebra quartz") and "maple 4711" in got[name(2)]


def test_hard_negatives_keep_words_of_many_entities(spark, tmp_path):
    """120 entities hold the word that makes the pair hardest."""
    texts = [(3 * i, f"common word{i} rare{i // 2}") for i in range(120)] + [(1, "common word7 other")]
    spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.record_id, r.entity_id, r.shared) for r in QUERIES["hard_negatives"](spark, str(tmp_path)).orderBy("shared", ascending=False).collect()]
    assert got == [("S2-1", "S1-21", 2), ("S2-1", "S1-0", 1)]


def test_flagship_searches_by_words_of_all_entities(spark, tmp_path):
    """No word is too common to find a partner by, and common words count in scores and norms."""
    texts = {3 * i: f"same words everywhere {'half ' * (i % 2)}own{i}" for i in range(80)} | {1: "same", 4: "half words own7", 2: "Everywhere, HALF, other"}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {name(i): set(re.findall(r"\w+", t.lower())) for i, t in texts.items()}
    index = {k: w for k, w in words.items() if k.startswith("S1")}
    idf = {x: math.log(1 + len(index) / n) for x, n in Counter(x for w in index.values() for x in w).items()}
    size = lambda w: math.sqrt(sum(idf.get(x, 0) ** 2 for x in w))
    want = set()
    for q in (name(1), name(2), name(4)):
        found = sorted((-round(sum(idf[x] ** 2 for x in w & words[q]) / size(w) / size(words[q]), 6), e) for e, w in index.items() if w & words[q])
        want |= {(q, e, -s, n) for n, (s, e) in enumerate(found[:5])}
    assert {(r.record_id, r.entity_id, r.score, r.rank) for r in QUERIES["flagship_cosine_topk"](spark, str(tmp_path)).collect()} == want and len(want) == 15
