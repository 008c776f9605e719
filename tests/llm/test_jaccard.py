import random
import re

import numpy as np
import pytest

from linkloom.llm.jaccard import CountForest, Join, fine_point, jaccard_components, may_link, needed, op7_count_tree_join

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """(doc_id, n, component) by comparing all pairs of different sets."""
    sets = {}
    for i, text in rows:
        sets.setdefault(frozenset(shingles(text)), []).append(i)
    keys = [k for k in sets if k]
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] is not k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 100 * len(a & b) >= 80 * len(a | b):
                parent[root(a)] = root(b)
    least = {}
    for k in keys:
        own = [i for i in sets[k] if i is not None]
        least[id(root(k))] = min([*own, *([least[id(root(k))]] if id(root(k)) in least else [])])
    out = []
    for i, text in rows:
        k = frozenset(shingles(text))
        key = next((x for x in keys if x == k), None)
        out.append((i, len(k), least[id(root(key))] if key is not None else i))
    return sorted(out, key=str)


def test_whole_table_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op7_count_tree_join(spark, SF).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("how", [Join(), Join(leaf=4, block=16, groups=32)])
def test_near_copies_chains_and_hot_passages(spark, how):
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(4000)
    base = [word() for _ in range(120)]
    rows = []

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = word()
        return words

    for _ in range(60):  # copies of one text, about as often over as under the threshold
        rows.append(edited(base, rng.randrange(1, 5)))
    step = [word() for _ in range(80)]
    for _ in range(12):  # a chain
        rows.append(step)
        step = edited(step, 1)
    passage = [word() for _ in range(30)]
    for _ in range(40):  # a shared passage in otherwise different texts
        rows.append(passage + [word() for _ in range(rng.randrange(2, 60))])
    rows += [["a", "b"], ["a", "b"], ["A", "b"], ["c"], base, base]
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, None), (901, ""), (902, " \n"), (7, "repeated id"), (7, "repeated id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as n", "3 as component_id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, how).collect()), key=str)
    assert got == brute(docs)


def test_trees_lose_nothing_and_prune():
    rng = np.random.default_rng(1)
    how = Join(leaf=4, groups=32)
    points = rng.poisson(3, (300, 32)).astype(np.uint16)
    points[100:] = points[:200] + rng.integers(0, 2, (200, 32)).astype(np.uint16)
    sizes = points.sum(1).astype(np.int64)
    group = np.sort(rng.integers(0, 6, 300))
    group[0] = 0
    group = np.unique(group, return_inverse=True)[1]
    forest = CountForest(group, points, sizes, how)
    got = {(int(q), int(p)): int(b) for part in forest.query(group, points, sizes, step=7) for q, p, b in zip(*part)}
    want = {}
    for i in range(300):
        bound = np.minimum(points, points[i]).sum(1)
        for j in np.flatnonzero((bound >= needed(sizes, sizes[i], 80)) & (group == group[i])).tolist():
            want[i, j] = int(bound[j])
    assert got == want and len(forest.levels) > 3 and forest.passed < forest.tested


def test_full_coordinates_bound_nothing():
    points = np.full((2, 16), 65535, np.uint16)
    sizes = np.array([5_000_000, 4_900_000])
    forest = CountForest(np.zeros(2, int), points, sizes, Join(groups=16))
    assert sum(len(q) for q, _, _ in forest.query(np.zeros(2, int), points, sizes)) == 4


def test_fine_points_lose_no_link_and_prune():
    rng, how, pruned = np.random.default_rng(2), Join(groups=16), 0
    for _ in range(400):
        both, left, right = (rng.integers(0, 2**63, rng.integers(0, k)).astype(np.uint64) for k in (900, 160, 160))
        x, y = np.append(both, left), np.append(both, right)
        u, v = fine_point(x, how), fine_point(y, how)
        if u is None or v is None:
            assert min(len(x), len(y)) <= 2 * how.groups
            continue
        links = 100 * len(both) >= 80 * (len(x) + len(y) - len(both))
        assert may_link(len(x), len(y), u, v, how) or not links
        pruned += not may_link(len(x), len(y), u, v, how)
    assert pruned > 50


def test_full_fine_coordinates_bound_nothing():
    how = Join(groups=16)
    same = np.arange(400, dtype=np.uint64) * np.uint64(2**32)  # all in one group
    assert may_link(400, 400, fine_point(same, how), fine_point(np.arange(400, dtype=np.uint64), how), how)


def test_small_trees_are_trees():
    forest = CountForest(np.array([0, 1, 1]), np.ones((3, 16), np.uint16), np.full(3, 16), Join(groups=16))
    assert len(forest.levels) == 2 and len(forest.levels[1][0]) == 2


def test_very_long_text(spark):
    rng = random.Random(8)
    words = ["w%d" % rng.randrange(10**6) for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50_000])), (3, " ".join(words[30_000:])), (4, "short")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and got[1][0] == 59_996


def test_salted_tokens_change_nothing(spark):
    """Every repeated shingle counts as hot."""
    rng = random.Random(4)
    base = ["w%d" % rng.randrange(5000) for _ in range(60)]
    rows = [(i, " ".join([*base[: i % 4], "x%d" % i, *base[i % 4 + 1 :]])) for i in range(120)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Join(hot=2, block=16)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
