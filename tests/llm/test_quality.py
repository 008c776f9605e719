import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkloom.llm import _bytes as B
from linkloom.llm.quality import Ranker, Settings, blocks, features, fit_pairs, held_out, known_labels, learn, op6_pairwise_quality, score

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = op6_pairwise_quality(spark, SF).join(labels, "doc_id").where("held_out")
    right, n = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 500 and right > 0.97
    low, high = [found.where(F.col("quality") == q).agg(F.avg("score")).first()[0] for q in (0, 1)]
    assert low < 0.4 and high > 0.8


def test_ranking_separates_and_cuts_at_the_share():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.2, (400, 5)).astype(np.float32)
    y = np.arange(400) % 4 != 0
    x[y, 2] += 1
    ranker = fit_pairs(x, y.astype(int), Settings())
    s = ranker.score(x)
    assert ((s >= 0.7) == y).mean() > 0.97
    assert abs((s < 0.7).sum() - 100) <= 1


def test_features_do_not_depend_on_slices():
    texts = ["some words\nand lines, 12 %%", "", "é" * 40, "a b c a b c a b c", "x"]
    whole = np.concatenate([features(s, Settings()) for s in B.slices(pa.array(texts))])
    parts = np.concatenate([features(s, Settings()) for s in B.slices(pa.array(texts), 4)])
    assert np.allclose(whole, parts) and not np.isnan(whole).any()


def test_edges(spark):
    rng = random.Random(1)
    words = ["plain", "words", "make", "good", "text", "here", "always"]
    rows = [(i, " ".join(rng.choices(words, k=40)) if i % 2 else "$$ !! %% " * 20, "x") for i in range(60)]
    rows += [(100, None, "x"), (100, "", "x"), (None, "words", None), (101, "good text " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as quality")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 1), (0, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = score(docs, learn(docs, labels)).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.predicted for r in got if r.doc_id is not None and 0 < r.doc_id < 60 and r.doc_id % 2} == {1}
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id < 60 and not r.doc_id % 2} == {0}
    assert [r.predicted for r in got if r.doc_id == 101] == [1]
    assert {r.score for r in score(docs, learn(docs, labels.limit(0))).collect()} == {0.5}
    assert score(docs.limit(0), None).count() == 0
    assert docs.select(held_out()).count() == 64


def test_whole_table_matches_brute_force(spark):
    """The ranker from plain loops over the labelled texts, and the score of every row."""
    sf, how = "/root/testdata/sf0.001", Settings()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    row = lambda text: features(next(B.slices(pa.array([text]))), how)[0]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = [(r.doc_id, r.quality) for r in labels if not held(r.doc_id) and r.quality is not None and r.doc_id in texts]
    hashes = {bytes(r.x): r.h for r in spark.createDataFrame([(row(texts[i]).tobytes(),) for i, _ in known], "x binary").select("x", F.xxhash64("x").alias("h")).collect()}
    data = sorted(((hashes[row(texts[i]).tobytes()], row(texts[i]).tobytes(), q) for i, q in known))
    x, y = [np.frombuffer(b, np.float32).astype(float) for _, b, _ in data], [q for _, _, q in data]
    good, bad = [i for i, q in enumerate(y) if q == 1], [i for i, q in enumerate(y) if q == 0]
    rivals = np.random.default_rng(7).integers(0, len(bad), len(good) * how.pairs)
    pairs = [(good[k // how.pairs], bad[r]) for k, r in enumerate(rivals)]
    w = v = np.zeros(how.features)
    for _ in range(how.rounds * 4):
        ahead, slope = w + 0.9 * v, np.zeros(how.features)
        for a, b in pairs:
            d = x[a] - x[b]
            slope += d / (1 + math.exp(d @ ahead)) / len(pairs)
        v = 0.9 * v + 4.0 * (slope - how.ridge * ahead)
        w = w + v
    raw = sorted(float(r @ w) for r in x)
    cut = (raw[len(bad) - 1] + raw[min(len(bad), len(raw) - 1)]) / 2
    found = op6_pairwise_quality(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        want = 1 / (1 + math.exp(-(float(row(texts[r.doc_id]).astype(float) @ w) - cut + math.log(0.7 / 0.3))))
        assert abs(r.score - want) < 1e-6 and r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.7)


def test_a_score_at_the_threshold_counts_as_good():
    ranker = Ranker(np.array([1.0]), 0.5, 0.7)
    assert abs(ranker.score(np.array([[0.5]]))[0] - 0.7) < 1e-12


def test_all_labelled_rows_are_learned(spark):
    """Beyond the first 4,000 of each class, which were all that was learned from: the weights and the cut are those
    of the pairs of every row, against a plain descent over the same blocks."""
    rng = random.Random(5)
    how = Settings(gathered=200, block=300, hashed=16)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "x", "$$", "1"], [5, 5, 5, 1 + 4 * (i % 3 == 0), 1 + 3 * (i % 3 == 0), 2], k=rng.randrange(3, 30)))) for i in range(1500)]
    docs = spark.createDataFrame([*rows, (7, "one more row of an id"), (5000, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(1500)], "doc_id long, quality int")
    table = blocks(docs, known_labels(labels), 500, 1500, how).collect()
    parts = [(r.block, np.frombuffer(r.x, np.float32).reshape(-1, how.features).astype(float), np.frombuffer(r.y, np.uint8)) for r in table]
    assert len(parts) == 5 and sum(len(y) for _, _, y in parts) == 1501 and sum(int(y.sum()) for _, _, y in parts) == 1001
    ranker = learn(docs, labels, how)
    diffs = []
    for b, x, y in parts:
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        diffs.append(x[np.repeat(good, how.pairs)] - x[bad[np.random.default_rng([7, b]).integers(0, len(bad), len(good) * how.pairs)]])
    diff = np.concatenate(diffs)
    w = v = np.zeros(how.features)
    for _ in range(1500):
        ahead = w + 0.9 * v
        v = 0.9 * v + 4.0 * (diff.T @ (1 / (1 + np.exp(diff @ ahead))) / len(diff) - how.ridge * ahead)
        w = w + v
    assert np.abs(ranker.weights - w).max() < 1e-5
    raw = np.sort(np.concatenate([x for _, x, _ in parts]) @ w)
    assert abs(ranker.cut - (raw[499] + raw[500]) / 2) < 1e-5
