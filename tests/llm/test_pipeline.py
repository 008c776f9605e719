import re

import corpus_pipeline as P
from test_decontaminate import words
from test_jaccard import brute as groups
from test_pii import brute as base_spans

from linkloom.llm import language, pii
from linkloom.llm._stage import staged

SF = "/root/testdata/sf0.01"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}

    one = staged(P.identify_language(spark, docs, SF), "t1")
    found = {r.doc_id: r for r in one.collect()}
    samples = language.learn(docs)
    predicted = {r.doc_id: r for r in language.predict_language(docs, samples).collect()}
    assert set(found) == {i for i, r in predicted.items() if r.lang_pred != "und" and r.score >= P.least_score(len(samples))}
    assert len(found) > 0.97 * len(start)
    assert sum(found[i].lang == start[i].lang for i in found) > 0.98 * len(found)

    two = staged(P.drop_near_duplicates(spark, one, SF), "t2")
    kept = {r.doc_id for r in two.select("doc_id").collect()}
    assert kept == {i for i, _, component in groups([(i, r.text) for i, r in found.items()]) if i == component}

    three = staged(P.drop_contaminated(spark, two, SF), "t3")
    windows = {tuple(words(r.text)[s : s + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for s in range(max(len(words(r.text)) - 9, 1))}
    clean = set()
    for i in kept:
        w = words(found[i].text)
        if not any(tuple(w[j : j + 10]) in windows for j in range(len(w))):
            clean.add(i)
    assert {r.doc_id for r in three.select("doc_id").collect()} == clean and len(clean) < len(kept)

    four = {r.doc_id: r for r in P.redact_personal_data(spark, three, SF).collect()}
    assert set(four) == clean
    model = pii.fit(three)
    hits = 0
    for i, r in four.items():
        assert r.n_chars == len(r.text) and not base_spans(re.sub(r"<\w+>", "\x00", r.text))
        spans = [s for s in pii.spans(found[i].text) if model.accepts(s)]
        hits += bool(spans)
        assert (r.text == found[i].text) == (not spans)
    assert hits > 5

    five = P.mix_sources(spark, three, SF)
    assert five.columns == [*P.COLUMNS, "tokens", "posterior", "rate"]
    assert {r.doc_id for r in five.select("doc_id").collect()} <= clean


def test_run(spark):
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "pii", "mixing"]
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(batch, 77 << 20)
    assert P.run(spark, "/root/testdata/sf0.001").where("rate > 0").count() > 100
    assert spark.conf.get(batch) == str(77 << 20)
    spark.conf.unset(batch)
    assert [round(P.least_score(n), 3) for n in (0, 1, 2, 4, 100)] == [1, 1, 0.6, 0.4, 0.208]


def test_rows_are_judged_by_their_own_text(spark):
    """Null and shared ids, repeats, ties, long texts, clashing extra columns and empty tables."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    lines = lambda word: " ".join(f"the {word} of line {i} is here" for i in range(40))
    a, b, c = lines("river"), lines("bridge"), lines("garden")
    near = a + " and"
    long = " ".join(f"long{i} text{i % 977}" for i in range(60_000))
    rows = [(1, a), (1, a), (1, b), (5, near), (None, near), (None, c), (None, c), (2, None), (2, ""), (3, ""), (4, f"{lines('hill')} {item}"), (4, lines("castle")), (None, f"{lines('tower')} {item}"), (6, long), (7, long + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as component", "2 as text_hash", "3 as _id", "4 as tokens")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    two = P.drop_near_duplicates(spark, docs, SF)
    assert two.columns == list(P.COLUMNS)
    want = [(1, a), (1, b), (None, c), (2, None), (2, ""), (3, ""), (4, f"{lines('hill')} {item}"), (4, lines("castle")), (None, f"{lines('tower')} {item}"), (6, long)]
    assert pairs(two) == sorted(want, key=str)
    three = P.drop_contaminated(spark, docs, SF)
    assert pairs(three) == sorted([r for r in rows if not (r[1] or "").endswith(item)], key=str)
    four = P.redact_personal_data(spark, docs, SF)
    assert four.columns == list(P.COLUMNS) and len(pairs(four)) == len(rows)
    five = P.mix_sources(spark, docs, SF)
    assert five.columns == [*P.COLUMNS, "tokens", "posterior", "rate"]
    one = P.identify_language(spark, docs, SF)
    assert {r.lang for r in one.collect()} == {"en"} and one.columns == list(P.COLUMNS)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
