import random

from pyspark.sql import functions as F
from test_decontaminate import words

from linkloom.llm.licenses import NOTICES, Settings, _bands, notices, op2_license_scan, scan_licenses, templates_in

SF = "/root/testdata/sf0.01"


def places(w, k):
    found = {}
    for i in range(len(w) - k + 1):
        found.setdefault(tuple(w[i : i + k]), i)
    return found


def brute(rows, templates, percent=80):
    """(doc_id, template_id, inside, place), by comparing every text with every template."""
    known = {}
    for name, t in templates.items():
        t = words(t)
        if t:
            k = min(3, len(t))
            known[name] = (k, set(places(t, k)))
    out = set()
    for i, text in rows:
        by_size = {k: places(words(text or ""), k) for k in {k for k, _ in known.values()}}
        for name, (k, s) in known.items():
            hit = s & by_size[k].keys()
            if 100 * len(hit) >= percent * len(s):
                out.add((i, name, round(len(hit) / len(s), 9), min(by_size[k][g] for g in hit)))
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.doc_id, r.template_id, round(r.containment, 9), r.place) for r in found.collect()), key=str)


def test_whole_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, NOTICES)
    assert rows_of(op2_license_scan(spark, SF)) == want and len(want) >= 10


def test_edges(spark):
    long = NOTICES["MIT-text"]
    rows = [(1, None), (2, ""), (3, "rights reserved"), (4, "ALL RIGHTS\nReserved!"), (4, "ALL RIGHTS\nReserved!"), (None, "x " * 7 + NOTICES["MIT"]), (5, "filler words here " * 50_000 + long), (6, long.replace("person", "fellow") + " tail"), (7, long.replace("person", "fellow").replace("charge", "cost").replace("software", "program"))]
    rows += [(8, NOTICES["MIT-whole"]), (9, "some text. " + NOTICES["BSD-3-Clause"] + " more text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as band", "2 as words", "3 as template_id", "4 as text_hash")
    want = brute(rows, NOTICES)
    assert {(4, "reserved"), (None, "MIT"), (5, "MIT-text"), (6, "MIT-text"), (8, "MIT-whole"), (9, "BSD-3-Clause"), (9, "BSD-2-Clause")} <= {x[:2] for x in want} and not {1, 2, 3, 7} & {x[0] for x in want}
    for how in (Settings(), Settings(block_marks=20_000)):
        assert rows_of(scan_licenses(docs, notices(spark), how)) == want
    assert scan_licenses(docs.limit(0), notices(spark)).count() == 0
    assert scan_licenses(docs, notices(spark).limit(0)).count() == 0


def test_short_and_odd_templates(spark):
    rows = [(1, "under gplv3 now"), (2, "public domain work"), (3, "domain public"), (4, "x y z"), (5, "the public  DOMAIN"), (6, "gplv")]
    templates = {"one": "GPLv3", "two": "public domain", "three": "x y z", "none": "...", "": "y z"}
    given = spark.createDataFrame([*templates.items(), (None, "public"), ("two", "another text of this name")], "template_id string, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(scan_licenses(docs, given)) == brute(rows, templates)


def test_whole_license_of_thousands_of_words(spark, tmp_path):
    """A template of 5,600 words, whole, shortened, edited and cut in half inside longer texts."""
    rng = random.Random(11)
    word = lambda: "w%d" % rng.randrange(3000)
    template = [word() for _ in range(5600)]
    (tmp_path / "LONG-1.0").write_text(" ".join(template))
    edited = [word() if rng.random() < 0.04 else x for x in template]
    rows = [(1, [word() for _ in range(900)] + template), (2, template[:4800]), (3, edited + [word() for _ in range(50)]), (4, template[:2800]), (5, [word() for _ in range(9000)])]
    rows = [(i, " ".join(w)) for i, w in rows]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates_in(spark, str(tmp_path)))
    assert rows_of(found) == brute(rows, {"LONG-1.0": " ".join(template)}) and found.count() == 3


def test_bands_miss_a_lone_shingle_as_rarely_as_stated(spark):
    """Windows of three random shingles and one more: over all shingles, (3 / 4) ** 40 = 0.001 % are missed."""
    how = Settings()
    lone = F.xxhash64(F.lit("all"), F.lit("rights"), F.lit("reserved"))
    windows = spark.range(60_000).select("id", *(F.xxhash64("id", F.lit(j)).alias(f"s{j}") for j in range(3)), lone.alias("s3"))
    of_piece = _bands(spark.range(1).select(lone.alias("s0")), 1, how).select("band", F.col("value").alias("mark"))
    hit = _bands(windows, 4, how).join(F.broadcast(of_piece), "band").where("value = mark").select("id").distinct().count()
    assert 60_000 - hit <= 6, 60_000 - hit
