import math
import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import decide, metrics, models, retrieval, splits
from linkloom.plans import adapter as A
from linkloom.plans import job
from linkloom.sources import records as R
from linkloom.sources.config import Config
from linkloom.sources.staging import Steps, is_complete, partitions, shared_folder, written

DECISION = "country string, record_id string, entity_id string, probability double, margin double"


@pytest.fixture(scope="module")
def firms(spark):
    """120 entities with noisy copies, and records of nobody."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioubdfgklmnprst") for _ in range(6)) for _ in range(160)]
    rows, links = [], []
    for i in range(120):
        name, address = rng.sample(words, 3), [str(rng.randrange(1, 300)), *rng.sample(words, 3)]
        country = "IN" if i % 3 else "US"
        rows.append((f"S1-{i}", 1, country, " ".join(name) + " Ltd", " ".join(address)))
        for j in range(rng.randrange(0, 4)):
            source = rng.choice([2, 3])
            noisy = [w if rng.random() < 0.8 else rng.choice(words) for w in name]
            rows.append((f"S{source}-{i}-{j}", source, country, " ".join(noisy), " ".join(address[: rng.randrange(1, 5)])))
            links.append((f"S{source}-{i}-{j}", f"S1-{i}"))
    for i in range(60):
        rows.append((f"S2-x{i}", 2, "IN", " ".join(rng.sample(words, 3)), " ".join(rng.sample(words, 3))))
    records = spark.createDataFrame(rows, "id string, source int, country string, name string, address string")
    return records, spark.createDataFrame(links, "record_id string, entity_id string")


def test_job_trains_scores_delivers_and_resumes(spark, firms, tmp_path):
    records, links = firms
    small = models.Boosting(trees=5, depth=3, least_rows=1)
    plan = job.Plan(cap=0.3, one=small, two=small, first_threshold=0.5)
    steps = Steps(spark, str(tmp_path / "train"))
    report = {(r.stage, r.half): r for r in job.train(steps, records, links, plan).collect()}
    assert {k[0] for k in report} == {1, 2} and sum(r.entities for (s, _), r in report.items() if s == 1) == 21
    assert all(0.3 < r.macro_f <= 1 for r in report.values()) and len({r.accepted for r in report.values()}) == 1
    ran = list(steps.ran)
    assert ran[0] == "parsed" and ran[-1] == "rescored"
    again = Steps(spark, str(tmp_path / "train"))
    assert {(r.stage, r.half): r for r in job.train(again, records, links, plan).collect()} == report and not again.ran
    # A step without its marker is run again, and only that.
    (tmp_path / "train" / "rescored" / "_SUCCESS").unlink()
    third = Steps(spark, str(tmp_path / "train"))
    job.train(third, records, links, plan)
    assert third.ran == ["rescored"]
    scoring = Steps(spark, str(tmp_path / "score"))
    both = job.score(scoring, records, steps.path("first_model"), steps.path("second_model"), plan)
    assert both.columns == ["country", "record_id", "entity_id", "first", "margin", "second"]
    entities = A.entities(records)
    candidates = spark.read.parquet(scoring.path("candidates"))
    matches, pool = job.deliver(both, candidates, entities, str(tmp_path / "out"), plan)
    assert matches.count() == pool.count() == 120 and matches.where("matched_entity_ids <> ''").count() > 30
    scoped = job.Plan(**{**plan.__dict__, "second_countries": ("US",)})
    want = both.where(F.when(F.col("country") == "US", F.col("second") >= 0.5).otherwise(F.col("first") >= 0.5))
    assert job.assigned(both, scoped).count() == want.count()
    with pytest.raises(ValueError, match="not a candidate"):
        job.deliver(both, candidates.limit(0), entities, str(tmp_path / "bad"), plan)


def test_problems_of_lists(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    lists = lambda rows: spark.createDataFrame(rows, "entity_id string, ids string")
    got = {r.problem: r.n for r in R.problems(entities, lists([("a", "x,y"), ("a", "x"), ("c", "x")]), lists([("a", "x"), ("b", "")])).collect()}
    assert got == {"matches: entity missing": 1, "matches: unknown entity": 1, "matches: entity repeated": 1, "matches: record shared": 1, "matches: not a candidate": 2}
    good = lists([("a", "x"), ("b", "")])
    assert R.problems(entities, good, good).count() == 0


def test_files_of_a_job(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", "IN"), ("b", "US")], "id string, country string")
    R.write_splits(rows.withColumn("split", F.when(F.col("id") == "a", "valid").otherwise("train")), str(tmp_path / "splits"))
    assert [r.id for r in R.read_splits(spark, str(tmp_path / "splits"), "valid").collect()] == ["a"]
    pairs_ = spark.createDataFrame([("IN", "r", "e", 0.5)], "country string, record_id string, entity_id string, score double")
    R.write_candidates(pairs_, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("country = 'IN'").count() == 1
    R.write_lists(spark.createDataFrame([("a", "x,y"), ("b", "")], "entity_id string, matched_entity_ids string"), str(tmp_path / "l"))
    assert {(r.entity_id, r.matched_entity_ids) for r in R.read_lists(spark, str(tmp_path / "l")).collect()} == {("a", "x,y"), ("b", "")}
    runs = spark.createDataFrame([("v", 1, 10, 5, 10, 10), ("v", 5, 10, 9, 50, 10)], "view string, k int, links int, found int, pairs int, queries int")
    text = R.retrieval_report(runs)
    assert "## Recall by k" in text and "0.5000" in text and "5.0000" in text
    assert R.profile_report({"Rows": rows}).startswith("## Rows\n\n| id | country |")
    monkeypatch.setenv("LINKLOOM_DATA", "/somewhere")
    assert Config().source("train", 2) == "/somewhere/train/train_source2.tsv" and Config(work="w").step("test") == "w/test"
    assert R.shard(spark.range(100).withColumnRenamed("id", "n").withColumn("id", F.col("n").cast("string")), 4, 1, limit=3).count() == 3
    assert partitions(1 << 40, 64) == 8192 and partitions(1, 64) == 128
    assert is_complete(spark, str(tmp_path / "c")) and not is_complete(spark, str(tmp_path / "none"))
    assert written(rows, "t").count() == 2 and shared_folder(spark)


def test_index_is_kept(spark, tmp_path):
    index = spark.createDataFrame([("1", "v", f"e{i}", t) for i in range(4) for t in ("all", f"own{i}", f"half{i % 2}")], "country string, view string, id string, token string")
    retrieval.write_index(index, str(tmp_path / "i"), 0.5)
    vocab, postings = retrieval.read_index(spark, str(tmp_path / "i"))
    queries = index.where("token <> 'all'").withColumn("id", F.concat(F.lit("r"), "id"))
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    assert rows(retrieval.top_k(retrieval.scores(retrieval.weighted(queries, vocab), postings), 2)) == rows(retrieval.retrieve(queries, index, 2, 0.5))
    pruned = retrieval.pruned_scores(retrieval.weighted(queries, vocab), postings, 0.2)
    assert rows(pruned) == rows(retrieval.scores(retrieval.weighted(queries, vocab), postings, 0.2))


def test_pruning_is_exact(spark):
    rng = random.Random(9)
    rows = lambda p, n: spark.createDataFrame([("x", "v", f"{p}{i}", f"t{min(int(rng.expovariate(0.05)), 90)}") for i in range(n) for _ in range(12)], "country string, view string, id string, token string").distinct()
    index, queries = written(rows("e", 80), "e"), written(rows("r", 80), "r")
    vocab = retrieval.vocabulary(index, 1.0)
    q, e = retrieval.weighted(queries, vocab), retrieval.weighted(index, vocab)
    for floor in (0.1, 0.5):
        want = {(r.record_id, r.entity_id): r.score for r in retrieval.scores(q, e, floor).collect()}
        assert {(r.record_id, r.entity_id): r.score for r in retrieval.pruned_scores(q, e, floor).collect()} == want and want


def test_golden_text(spark):
    """Inputs and results by the documented patterns, written by hand."""
    names = {"Acme \\": "Acme", "-- Holloway Peak Inc": "Holloway Peak Inc", "<< Team Ecole": "Team Ecole", "M/s Galaxy Tech": "Galaxy Tech", "Shell Co d/b/a Real Name": "Real Name", "Acme Inc.": "Acme Inc.", "x;": "x", "(Paren)": "Paren)", "A aka ": "A aka"}
    got = {r.raw: r.name for r in spark.createDataFrame([(n,) for n in names], "raw string").select("raw", T.clean_name(F.col("raw")).alias("name")).collect()}
    assert {k: v.strip() for k, v in got.items()} == names
    tokens = {"galaxytech.com": ["galaxytech"], "22nd street cafe": ["22", "street", "cafe"], "a_b c": ["a", "b", "c"]}
    got = {r.raw: r.t for r in spark.createDataFrame([(n,) for n in tokens], "raw string").select("raw", T.name_tokens(F.lower("raw")).alias("t")).collect()}
    assert got == tokens
    address = {"Plot No.F-003, 1St Rd": ["plot", "number", "f", "3", "1", "road"], "12 n main st": ["12", "north", "main", "street"], "f003 000": ["f3", "0"]}
    got = {r.raw: r.t for r in spark.createDataFrame([(n,) for n in address], "raw string").select("raw", T.address_tokens(F.lower("raw")).alias("t")).collect()}
    assert got == address
    flags = {"plain": False, "ｆｕｌｌ width": False, "é": True, "": False, "ગુ": True, None: None}
    got = {r.raw: r.f for r in spark.createDataFrame([(n,) for n in flags], "raw string").select("raw", T.non_latin(F.col("raw")).alias("f")).collect()}
    assert got == flags
    grams = {"a bcd": {"abc", "bcd", "abcd"}, "ab": set(), "": set(), "é😀xy": {"é😀x", "😀xy", "é😀xy"}}
    got = {r.raw: set(r.g) for r in spark.createDataFrame([(n,) for n in grams], "raw string").select("raw", T.char_ngrams(F.col("raw")).alias("g")).collect()}
    assert got == grams


def test_empty_sums_and_odd_ids(spark):
    none = spark.createDataFrame([("x", "r1", "e1", 0.0, 0.0), ("x", "r2", "e1", 0.0, 0.0)], DECISION)
    assert decide.expected_prefix(none, 0.0).count() == 0
    scored = spark.createDataFrame([(0.5, 0), (0.2, 0)], "probability double, label int")
    assert models.average_precision(scored).first()[0] == 0.0
    links = spark.createDataFrame([], "record_id string, entity_id string")
    assert {(r.accepted, r.correct, r.recall) for r in metrics.record_rates(none, links, [0.0]).collect()} == {(2, 0, 0.0)}
    odd = spark.createDataFrame([(i, "IN") for i in ("a-x", "b", "", "c-9", "ünï")], "id string, country string")
    for by in (splits.hashed, splits.number):
        assert splits.holdout(odd, 0.4, by).where("split = 'valid'").count() == 2
        assert splits.halves(odd, "id", by).count() == 5 and splits.fixed_sample(odd, 2, by=by).count() == 2
    assert splits.holdout(odd, 1.0).where("split = 'valid'").count() == 5 and splits.holdout(odd, 0.0).where("split = 'valid'").count() == 0
    far = spark.createDataFrame([(f"{i}-S1-{j:09d}",) for i in range(40) for j in (7,)], "id string")
    assert 0 < splits.sample(far, 0.5).count() < 40


def test_average_precision_matches_loop(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(300)]
    positives, total, seen, hits = sum(y for _, y in rows), 0.0, 0, 0
    for p in sorted({p for p, _ in rows}, reverse=True):
        own = [y for q, y in rows if q == p]
        seen, hits = seen + len(own), hits + sum(own)
        total += hits / seen * sum(own) / positives
    got = models.average_precision(spark.createDataFrame(rows, "probability double, label int")).first()[0]
    assert math.isclose(got, total, abs_tol=1e-6)
