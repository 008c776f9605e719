import math
import re

import numpy as np
from pyspark.sql import functions as F

from linkloom.llm.mixing import TARGETS, Classifier, Settings, classify, fit_rates, label_domains, mix, op9_soft_membership_mixing, rate, train

SF = "/root/testdata/sf0.01"


def test_whole_table_reaches_targets(spark):
    found = op9_soft_membership_mixing(spark, SF).collect()
    assert len(found) == 1000
    total = sum(r.tokens for r in found)
    got = [sum(r.tokens * r.rate * r.posterior[k] for r in found) / total for k in range(3)]
    assert np.allclose(got, [TARGETS[d] for d in sorted(TARGETS)], atol=2e-3)
    assert all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in found)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in found[:200]:
        assert r.tokens == len([w for w in re.split(" +", re.sub(r"[.,;:!?\"'()\n\t\r]", " ", docs[r.doc_id])) if w])


def test_posteriors_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = train(docs, label_domains(spark.read.parquet(f"{SF}/labels.parquet")), ("clean", "junk", "toxic"))
    assert 10 < len(model.gains) <= 128
    for r in classify(docs, model).limit(40).collect():
        text = r.text
        features = set(re.split(" +", re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"[.,;:!?\"'()\n\t\r]", " ", text))))
        for name, pattern in (("symbols", r"[#*$%&<>|!]"), ("capitals", "[A-Z]")):
            share = len(re.findall(pattern, text)) / max(len(text), 1)
            features.add(f"<{name} {sum(share > b for b in (0.0, 0.002, 0.02, 0.06, 0.12, 0.3))}>")
        logs = [b + sum(g[k] for f, g in model.gains.items() if f in features) for k, b in enumerate(model.base)]
        odds = [math.exp(x - max(logs)) for x in logs]
        assert np.allclose(r.posterior, [o / sum(odds) for o in odds], atol=1e-9)


def test_gradient_equals_numpy_and_projects(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = rng.integers(1, 500, 200)
    df = spark.createDataFrame([(int(t), [float(v) for v in x]) for t, x in zip(tokens, p)], "tokens long, posterior array<double>")
    targets = {"a": 0.98, "b": 0.01, "c": 0.01}
    steps = fit_rates(df, targets, ("a", "b", "c"), Settings(rounds=60))
    got = np.array([r[0] for r in df.select(rate(steps)).collect()])
    r, share = np.ones(200), tokens @ p / tokens.sum()
    for _ in steps:
        r = np.maximum(0, r - p @ (((tokens * r) @ p / tokens.sum() - [0.98, 0.01, 0.01]) / share))
    assert np.allclose(np.sort(got), np.sort(r), atol=1e-6)
    miss = [np.abs((tokens * x) @ p / tokens.sum() - [0.98, 0.01, 0.01]).max() for x in (np.ones(200), r)]
    assert (got == 0).any() and miss[1] < miss[0] / 5


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "good words"), (3, "good words"), (None, "bad | words"), (4, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tokens", "2 as rate", "3 as _words", "4 as posterior", "5 as domain")
    labels = spark.createDataFrame([(3, "clean"), (3, "toxic"), (4, None), (None, "junk"), (2, "junk")], "doc_id long, domain string")
    for known in (labels, labels.limit(0)):
        got = mix(docs, known).collect()
        assert sorted((r.doc_id or 0, r.tokens) for r in got) == [(0, 3), (1, 0), (2, 0), (3, 2), (3, 2), (4, 100_000)]
        assert all(r.rate >= 0 and len(r.posterior) == 3 for r in got)
    assert mix(docs.limit(0), labels).count() == 0
    assert classify(docs.select("doc_id", "text"), Classifier(("x",), (0.0,), {})).where(F.get("posterior", F.lit(0)) != 1).count() == 0


def test_targets_out_of_reach_are_told(spark, caplog):
    docs = spark.createDataFrame([(10, [1.0, 0.0])], "tokens long, posterior array<double>")
    steps = fit_rates(docs, {"a": 0.5, "b": 0.5}, ("a", "b"), Settings(rounds=5))
    assert len(steps) == 5 and "after 5 rounds" in caplog.text
    caplog.clear()
    fit_rates(docs, {"a": 1.0, "b": 0.0}, ("a", "b"), Settings(rounds=5))
    assert not caplog.text
