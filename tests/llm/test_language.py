import random

import pyarrow as pa
from pyspark.sql import functions as F

from linkloom.llm import _bytes as B
from linkloom.llm.language import GAP, Parser, Settings, held_out, learn, op3_cross_parsing_language, predict_language

SF = "/root/testdata/sf0.01"


def greedy(text, sample):
    """Phrases of a greedy longest-match parse, by substring search."""
    i = n = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_parse_equals_substring_search():
    rng = random.Random(5)
    samples = {k: "".join(rng.choice(a) for _ in range(400)) for k, a in (("x", "abc d"), ("y", "bcde f"))}
    parser = Parser(samples, Settings(stretch=40))
    code = dict(zip(parser.languages, parser.codes))
    coded = {k: bytes(code[k][parser.signs(v)]) for k, v in samples.items()}
    texts = ["".join(rng.choice("abcdefgz 1") for _ in range(rng.randrange(1, 200))) for _ in range(50)]
    names, score = parser.predict(next(B.slices(pa.array(texts))))
    for text, name, s in zip(texts, names, score):
        own = {k: bytes(code[k][parser.signs(text)]) for k in samples}
        if not any(c != GAP for c in own["x"]):
            assert name == "und" and s == 0
            continue
        cost = [sum(greedy(own[k][i : i + 40], coded[k]) for i in range(0, len(own[k]), 40)) * c for k, c in zip(parser.languages, parser.cost)]
        assert cost[parser.languages.index(name)] == min(cost)
        assert 0 <= s <= 1


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    found = op3_cross_parsing_language(spark, SF).join(truth, "doc_id").where("held_out and n_chars > 60")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.98


def test_edge_rows(spark):
    rows = [(i, "le chat noir dort sur la table " * 9, "fr") for i in range(9)] + [(i, "the black dog sleeps under a tree " * 9, "en") for i in range(9, 18)]
    rows += [(20, None, "en"), (21, "", None), (22, "123 !!", "en"), (None, "the dog", "en"), (23, "chat " * 100_000, None), (23, "chat " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = [(r.doc_id, r.lang_pred, 0 <= r.score <= 1) for r in predict_language(docs, learn(docs)).where("doc_id is null or doc_id >= 20").collect()]
    assert sorted(got, key=str) == sorted([(20, "und", True), (21, "und", True), (22, "und", True), (None, "en", True), (23, "fr", True), (23, "fr", True)], key=str)
    assert predict_language(docs.limit(0), learn(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in predict_language(docs, {}).collect()} == {"und"}


def test_language_of_long_texts_only_is_learned(spark):
    from linkloom.llm import language

    rows = [(i, "the house and the garden are green " * 20, "en") for i in range(40)] + [(100 + i, "1 2 3 " * 4000 + "das haus und der garten sind grün " * 200, "de") for i in range(40)]
    samples = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(samples) == {"de", "en"} and samples["de"].startswith("das haus")
    docs = spark.createDataFrame([(1, "der garten und das haus"), (2, "the garden and the house")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict_language(docs, samples).collect()} == {1: "de", 2: "en"}


def test_scripts_of_many_signs_do_not_take_codes_from_others():
    rng = random.Random(6)
    signs = {"zh": range(0x4E00, 0x5300), "ja": range(0x6000, 0x6500), "am": range(0x1200, 0x1300), "ko": range(0xAC00, 0xB000)}
    lexicon = {k: ["".join(chr(rng.choice(v)) for _ in range(2)) for _ in range(400)] for k, v in signs.items()}
    lexicon["en"] = ["".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(60)]
    lexicon["sv"] = ["".join(rng.choice("abcdefghijkåäö") for _ in range(4)) for _ in range(60)]
    write = lambda k, n: " ".join(rng.choices(lexicon[k], k=n))
    parser = Parser({k: write(k, 2500) for k in lexicon}, Settings())
    assert all(len(t) <= 2 * 16_000 * parser.letters for t in parser.tables)
    want = [k for k in lexicon for _ in range(30)]
    names, score = parser.predict(next(B.slices(pa.array([write(k, 12) for k in want]))))
    assert sum(a == b for a, b in zip(names, want)) >= 0.98 * len(want)


def test_whole_table_matches_substring_search(spark):
    """Every text of the smallest table, parsed by searching for phrases in the samples."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = learn(docs)
    parser, step = Parser(samples, Settings()), Settings().stretch
    coded = [bytes(c[parser.signs(t)]) for c, t in zip(parser.codes, samples.values())]
    got = {r.doc_id: r for r in op3_cross_parsing_language(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        points = parser.signs(r.text or "")
        cost = []
        for code, sample, each in zip(parser.codes, coded, parser.cost):
            own = bytes(code[points])
            cost.append(sum(greedy(own[i : i + step], sample) for i in range(0, len(own), step)) * each)
        if got[r.doc_id].lang_pred == "und":
            assert not points.any()
        else:
            assert cost[parser.languages.index(got[r.doc_id].lang_pred)] == min(cost)
