import hashlib
import re

from linkloom.llm.decontaminate import Settings, find_windows, op10_prefix_decontamination

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        for s in range(max(len(v) - 9, 1)) if v else ():
            win = v[s : s + 10]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found |= {str(item_id)} - {"None"}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again and again"), (1, "the quick brown fox jumps over the lazy dog again and again and again"), (2, "Écho ÉCHO deux"), (10, "one"), (11, "two words"), (3, None), (4, "..."), (None, "nameless item with exactly ten words in it right here")]
DOCS = [
    (1, "x THE quick, brown fox jumps over the lazy dog again and again and again and again y"),
    (1, "x THE quick, brown fox jumps over the lazy dog again and again and again and again y"),
    (2, "Écho ÉcHO deux écho"),
    (3, None),
    (4, ""),
    (5, "One ONE two. words"),
    (None, "nameless item with exactly ten words in it right here"),
    (6, "quick brown fox jumps over the lazy dog again and"),
    (7, "filler text " * 60_000 + ITEMS[0][1]),
    (8, "İstanbul ÀÉ \x00 two\x7fwords"),
]


def test_edges_match_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as words", "2 as token", "3 as item_id")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as seen")
    want = sorted(((i, *brute(t, ITEMS)) for i, t in DOCS if i != 7), key=str)
    for how in (Settings(), Settings(block_windows=2)):
        rows = find_windows(docs, items, how).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows if r.doc_id != 7), key=str)
        assert got == want
        assert [(r.n_words, r.n_hit) for r in rows if r.doc_id == 7] == [(120_014, 14)]
    assert find_windows(docs.limit(0), items).count() == 0
    assert find_windows(docs, items.limit(0)).where("contaminated").count() == 0


def test_whole_table_matches_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    wins = {tuple(words(t)[s : s + 10]) for _, t in items for s in range(max(len(words(t)) - 9, 1))}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op10_prefix_decontamination(spark, SF).collect()}
    hot = 0
    for i, text in docs:
        w = words(text)
        if any(tuple(w[j : j + 10]) in wins for j in range(len(w))):
            hot += 1
            assert got[i] == brute(text, items)
        else:
            assert not got[i][4]
    assert hot > 5 and len(got) == len(docs)
