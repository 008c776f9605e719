import math
import random

import pytest
from pyspark.sql import functions as F

from linkloom.functions import views as V
from linkloom.operators import decide, diagnostics, groups, metrics, models, pairs, retrieval, splits
from linkloom.plans import adapter as A
from linkloom.sources import records as R
from linkloom.streaming.score import score_stream

DECISION = "country string, record_id string, entity_id string, probability double, margin double"


def f_half(predicted, truth):
    p, t = set(predicted), set(truth)
    if not p and not t:
        return 1.0
    hits = len(p & t)
    return 1.25 * (hits / len(p)) * (hits / len(t)) / (0.25 * hits / len(p) + hits / len(t)) if hits else 0.0


def scored(spark, predicted, truth):
    links = spark.createDataFrame([(r, e) for e, rs in truth.items() for r in rs], "record_id string, entity_id string")
    assigned = spark.createDataFrame([(r, e) for e, rs in predicted.items() for r in rs], "record_id string, entity_id string")
    ents = spark.createDataFrame([(e,) for e in truth], "entity_id string")
    return metrics.entity_counts(assigned, links, ents)


def test_f_beta_vectors(spark):
    truth = {"worked": ["S2-00047", "S3-00812"], "empty": [], "false": [], "missed": ["y"], "exact": ["a"], "disjoint": ["b"], "precise": ["c", "d"], "loose": ["e"], "twice": ["g"]}
    predicted = {"worked": ["S2-00047", "S2-00193", "S3-00812"], "false": ["x"], "exact": ["a"], "disjoint": ["q"], "precise": ["c"], "loose": ["e", "f"], "twice": ["g", "g"]}
    got = {r.entity_id: r.f for r in metrics.entity_scores(scored(spark, predicted, truth)).collect()}
    want = {"worked": 0.714286, "empty": 1.0, "false": 0.0, "missed": 0.0, "exact": 1.0, "disjoint": 0.0, "precise": 0.833333, "loose": 0.555556, "twice": 1.0}
    assert got == pytest.approx(want, abs=1e-6)
    report = metrics.report(scored(spark, predicted, truth)).first()
    assert report.macro_f == pytest.approx(sum(want.values()) / 9, abs=1e-5) and (report.n_singletons, report.n_matched) == (2, 7)


def test_expected_prefix_matches_loop(spark):
    rng = random.Random(1)
    rows = [("x", f"r{i}", f"e{rng.randrange(12)}", round(rng.random(), 3) if i % 9 else 1.0, 0.0) for i in range(80)]
    got = {r.record_id for r in decide.expected_prefix(spark.createDataFrame(rows, DECISION), 0.1, 1.2).collect()}
    want = set()
    for e in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == e and r[3] >= 0.1), key=lambda r: (-r[3], r[1]))
        p = [r[3] for r in own]
        score = []
        for m in range(1, len(p) + 1):
            s = sum(p[:m])
            a, b = s / m, s / (sum(p) * 1.2)
            score.append(round(1.25 * a * b / (0.25 * a + b), 6))
        if p and round(math.prod(1 - x for x in p), 6) < max(score):
            want |= {r[1] for r in own[: score.index(max(score)) + 1]}
    assert got == want


def test_decisions_and_rules(spark):
    pairs_ = spark.createDataFrame([("x", "r1", "e2", 0.9), ("x", "r1", "e1", 0.9), ("x", "r2", "e1", 0.4)], "country string, record_id string, entity_id string, probability double")
    got = {r.record_id: (r.entity_id, r.probability, r.margin) for r in decide.decisions(pairs_).collect()}
    assert got == {"r1": ("e1", 0.9, 0.0), "r2": ("e1", 0.4, 0.4)}
    found = decide.decisions(pairs_)
    assert {r.record_id for r in decide.by_threshold(found, 0.3, 0.2).collect()} == {"r2"}
    assert {r.record_id for r in decide.by_place(found, 0.5, 0.3).collect()} == {"r1", "r2"}
    assert decide.gated(found, 0.95).count() == 0
    assert [r.record_ids for r in decide.inverted(found).collect()] == [["r1", "r2"]]
    assert decide.decisions(pairs_, 0.5).count() == 1 and decide.decisions(pairs_.limit(0)).count() == 0


def test_retrieval_edges(spark):
    index = spark.createDataFrame([("x", "v", "e1", t) for t in "abc"] + [("x", "v", "e2", t) for t in "ab"] + [("y", "v", "e3", "a")], "country string, view string, id string, token string")
    queries = spark.createDataFrame([("x", "v", "r1", "c"), ("x", "v", "r1", "zz"), ("x", "v", "r2", "zz"), ("y", "v", "r3", "a")], index.schema)
    vocab = retrieval.vocabulary(index, 0.5)
    assert {(r.country, r.token) for r in vocab.collect()} == {("x", "c"), ("y", "a")}
    got = retrieval.retrieve(queries, index, 5, 1.0).collect()
    assert {(r.record_id, r.entity_id) for r in got} == {("r1", "e1"), ("r3", "e3")}
    assert next(r.score for r in got if r.record_id == "r3") == 1.0
    assert retrieval.retrieve(queries, index, 5, 1.0, floor=1.0).count() == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "s1.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t\tIN\nS1-2\t"Quoted" Ltd\t5 Rd\tUS\nshort\trow\n')
    rows = R.read_records(spark, str(tmp_path / "s1.tsv"), 1)
    assert {(r.id, r.name, r.address, r.country) for r in rows.collect()} == {("S1-1", "NA", "", "IN"), ("S1-2", '"Quoted" Ltd', "5 Rd", "US")}
    assert R.read_records(spark, str(tmp_path / "s1.tsv"), 1, pad_short=True).count() == 3
    assert R.read_records(spark, str(tmp_path / "s1.tsv"), 1, country="US").count() == 1
    R.land(rows, str(tmp_path / "landed"))
    assert spark.read.parquet(str(tmp_path / "landed")).where("country = 'IN'").count() == 1
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched\nS1-1\tS2-1,S3-4\nS1-2\t\n")
    truth = R.read_truth(spark, str(tmp_path / "truth.tsv"))
    assert {r.entity_id: r.matched for r in truth.collect()} == {"S1-1": ["S2-1", "S3-4"], "S1-2": []}
    assert R.links(truth).count() == 2
    (tmp_path / "bad.tsv").write_text("id\tx\n")
    with pytest.raises(ValueError):
        R.read_truth(spark, str(tmp_path / "bad.tsv"))
    lists = R.complete_lists(truth, R.links(truth))
    R.write_lists(lists, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True)
    assert {(r.source1_entity_id, r.matched_entity_ids or "") for r in back.collect()} == {("S1-1", "S2-1,S3-4"), ("S1-2", "")}
    assert [r.x for r in R.id_lists(spark.createDataFrame([(["b", "a", "b"],)], "x array<string>"), "x").collect()] == ["b,a"]
    pairs_ = spark.createDataFrame([(0.5, 1, "r")], "f double, label int, record_id string")
    R.write_pairs(pairs_, str(tmp_path / "pairs"))
    assert dict(R.read_pairs(spark, str(tmp_path / "pairs")).dtypes) == {"f": "float", "label": "tinyint", "record_id": "string"}
    found = spark.createDataFrame([("IN", "r", "e", 0.5, 0.5)], DECISION)
    R.write_decisions(found, str(tmp_path / "d"))
    assert R.read_decisions(spark, str(tmp_path / "d"), "IN").count() == 1 and R.read_decisions(spark, str(tmp_path / "d"), "US").count() == 0
    for _ in range(2):
        R.append_runs(spark.createDataFrame([(1, 0.5)], "k int, recall double"), str(tmp_path / "runs"))
    assert R.read_runs(spark, str(tmp_path / "runs")).count() == 2
    assert R.markdown(spark.createDataFrame([(1, 0.5)], "k int, recall double")).endswith("| 1 | 0.5000 |")
    assert R.empty_lists(truth).where("matched_entity_ids <> ''").count() == 0
    assert R.outside(R.links(truth), R.links(truth)).count() == 0
    assert R.read_sources(spark, {1: str(tmp_path / "s1.tsv"), 2: str(tmp_path / "s1.tsv")}).groupBy("source").count().count() == 2


def test_features_are_complete_and_finite(spark):
    rows = spark.createDataFrame([("S1-1", 1, "IN", "Dhule Roadlines Limited", "Plot No.F-3, Midc Avadhan, Dhule"), ("S2-1", 2, "IN", "Dhule Roadlines Ltd", "Plot No.f-003, Midc Avadhan, Dhule"), ("S3-1", 3, "IN", "Dhule Road Lines", ""), ("S1-2", 1, "IN", "Other Works", "1 Main St")], "id string, source int, country string, name string, address string")
    parsed = V.parsed(rows)
    candidates = A.view_candidates(parsed, cap=1.0)
    found = pairs.pair_features(candidates, parsed, V.postings(parsed), retrieval.vocabulary(V.postings(parsed.where("source = 1")), 1.0))
    got = found.collect()
    assert len(pairs.FEATURES) == 33 and found.columns[3:] == pairs.FEATURES
    assert got and all(math.isfinite(r[f]) for r in got for f in pairs.FEATURES)
    best = next(r for r in got if (r.record_id, r.entity_id) == ("S2-1", "S1-1"))
    assert best.name_jaccard == 1.0 and best.num_conflict == 0.0 and best.name_idf_overlap > 0.9
    zero = pairs.pair_features(candidates, parsed, V.postings(parsed), V.postings(parsed), zero_idf=True)
    assert zero.where("name_idf_overlap <> 0").count() == 0
    decided = spark.createDataFrame([("IN", "S2-1", "S1-1", 0.9, 0.5), ("IN", "S3-1", "S1-1", 0.6, 0.2)], DECISION).join(rows.select(F.col("id").alias("record_id"), "source"), "record_id")
    group = groups.group_features(decided, parsed)
    assert len(groups.FEATURES) == 24 and group.columns[3:] == groups.FEATURES
    two = {r.record_id: r for r in group.collect()}
    assert two["S2-1"].prob_rank_in_group == 0 and two["S3-1"].n_siblings == 1 and two["S2-1"].sib_name_max == two["S3-1"].sib_name_max > 0.5
    small = {r.record_id: r.sib_name_max for r in groups.sibling_features(decided, groups.parsed_for_groups(parsed), largest=1).collect()}
    assert small["S2-1"] > 0 and small["S3-1"] > 0


def test_splits(spark):
    rows = spark.createDataFrame([(f"S1-{i}", "IN" if i % 3 else "US") for i in range(300)], "id string, country string")
    held = splits.holdout(rows)
    assert {(r.country, r.split): r.n for r in splits.split_mix(held).collect()} == {("IN", "valid"): 36, ("IN", "train"): 164, ("US", "valid"): 18, ("US", "train"): 82}
    assert sorted(held.where("split = 'valid'").collect()) == sorted(splits.holdout(rows.repartition(5)).where("split = 'valid'").collect())
    assert splits.country_folds(rows).count() == 600
    assert 10 < splits.sample(rows, 0.1).count() < 60
    assert 100 < splits.halves(rows, "id").where("half = 'A'").count() < 200


def test_models_and_calibration(spark, tmp_path):
    rng = random.Random(3)
    rows = [(float(rng.random()), float(rng.random())) for _ in range(600)]
    data = spark.createDataFrame([(x, y, int(x + 0.2 * y > 0.6), "A" if i % 2 else "B") for i, (x, y) in enumerate(rows)], "x double, y double, label int, half string")
    model = models.train(data, ["x", "y"], models.Boosting(trees=8, depth=3))
    models.save(model, str(tmp_path / "m"))
    found = models.score(data, models.load(str(tmp_path / "m")))
    assert models.area_under_precision_recall(found) > 0.97
    assert models.importances(model, ["x", "y"])[0][0] == "x"
    assert models.average_precision(found).first()[0] > 0.97
    calibrated = models.cross_calibrate(found).orderBy("probability").collect()
    for half in "AB":
        own = [r.calibrated for r in calibrated if r.half == half]
        assert own == sorted(own) and 0 <= own[0] and own[-1] <= 1


def test_nearest_rank_matches_loop(spark):
    rng = random.Random(2)
    values = [round(rng.random(), 2) for _ in range(53)]
    got = diagnostics.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v", []).first()
    ordered = sorted(values)
    assert [got[f"p{p}"] for p in (5, 25, 50, 75, 95)] == [ordered[round(p / 100 * 52)] for p in (5, 25, 50, 75, 95)]


def test_labels_and_halves(spark):
    found = spark.createDataFrame([("r1", "e1"), ("r1", "e2"), ("r2", "e1"), ("r3", "e1")], "record_id string, entity_id string")
    owners = spark.createDataFrame([("r1", "e1"), ("r2", "e9")], "record_id string, entity_id string")
    got = {(r.record_id, r.entity_id): (r.label, r.is_valid) for r in pairs.labelled(found, owners, spark.createDataFrame([("e1",)], "entity_id string")).collect()}
    assert got[("r1", "e1")] == (1, 1) and got[("r1", "e2")] == (0, 1) and got[("r2", "e1")] == (0, 0) and got[("r3", "e1")][0] == 0
    before = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "half string, macro_f double")
    after = spark.createDataFrame([("A", 0.6), ("B", 0.5)], "half string, macro_f double")
    assert metrics.both_halves_improve(before, after).first()[0] is False
    assert metrics.leaderboard(spark.createDataFrame([(0.1, 0.0, 0.5), (0.2, 0.0, 0.7)], "threshold double, margin double, macro_f double"), 1).first().threshold == 0.2


def test_stream_scores_like_a_batch(spark, tmp_path):
    rows = A.records(spark, "/root/testdata/sf0.001")
    index = V.postings(V.parsed(rows.where("source = 1")))
    vocab = retrieval.vocabulary(index, 0.2)
    new = rows.where("source > 1")
    new.write.parquet(str(tmp_path / "in"))
    kept = []
    query = score_stream(spark.readStream.schema(new.schema).parquet(str(tmp_path / "in")), retrieval.weighted(index, vocab), vocab, lambda df, n: kept.extend(df.collect()), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    batch = retrieval.union_of_views(retrieval.retrieve(V.postings(V.parsed(new)), index, 5, 0.2)).withColumn("probability", F.col("score_best"))
    assert sorted(kept) == sorted(decide.decisions(batch).collect()) and kept
