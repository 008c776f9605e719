import random

import pyarrow as pa
from pyspark.sql import functions as F

from linkloom.operators import cells, retrieval
from linkloom.plans import adapter as A
from linkloom.plans.queries import QUERIES

POSTING = "country string, view string, id string, token string"


def sides(spark, seed=3):
    """Postings with frequent tokens, an id in two rows (its tokens count twice) and copies that tie."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]

    def some(prefix, n):
        rows = []
        for i in range(n):
            tokens = rng.sample(words, rng.randrange(1, 12)) if i % 7 else words[:5]
            rows += [("xy"[i % 5 == 0], "v", f"{prefix}{i}", t) for t in [*tokens, *["unknown", "w1"][: i % 3]]]
        return spark.createDataFrame([*rows, (None, "v", f"{prefix}0", "w1"), ("z" + prefix, "v", f"{prefix}z", "w1")], POSTING)

    return some("r", 90), some("e", 700)


def rows(df):
    return sorted(tuple(r) for r in df.select("country", "view", "record_id", "entity_id", "score", "rank").collect())


def test_cells_equal_the_plain_join(spark):
    queries, index = sides(spark)
    for cap, floor, k in ((1.0, 0.0, 3), (0.15, 0.0, 5), (1.0, 0.45, 2)):
        vocab = retrieval.vocabulary(index, cap)
        want = rows(retrieval.top_k(retrieval.scores(retrieval.weighted(queries, vocab), retrieval.weighted(index, vocab), floor), k))
        q, e = retrieval.sets(queries), retrieval.sets(index)
        halves = [e.withColumn("tokens", F.array_join(F.filter(F.split("tokens", "\0"), lambda t, i: i % 2 == n), "\0")) for n in (0, 1)]
        twice = halves[0].union(halves[1].where("tokens <> ''"))  # an id's tokens in several rows
        for x, y in ((1 << 16, 1 << 15), (50, 20), (300, 1 << 15)):
            assert rows(retrieval.retrieve_sets(q, e, k, cap, floor, x, y)) == want and want
        assert rows(retrieval.retrieve_sets(q, twice, k, cap, floor, 50, 20)) == want


def test_nothing_known(spark):
    queries, index = sides(spark)
    assert retrieval.retrieve(queries.limit(0), index).count() == 0
    assert retrieval.retrieve(queries, index.limit(0)).count() == 0
    assert retrieval.retrieve(queries.withColumn("token", F.lit("none")), index).count() == 0


def moved(spark, df):
    """Rows written to shuffles by running `df`."""
    before = {(s.stageId(), s.attemptId()) for s in all_stages(spark)}
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(s.shuffleWriteRecords() for s in all_stages(spark) if (s.stageId(), s.attemptId()) not in before)


def all_stages(spark):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()
    found = store.stageList(none, False, False, getattr(store, "stageList$default$4")(), none)
    return [found.apply(i) for i in range(found.size())]


def test_pairs_are_not_moved(spark):
    """800 records and 400 entities that all share four words make 320,000 pairs."""
    made = spark.range(1200).selectExpr("id as doc_id", "concat('same four words here ', id % 400) as text", "'en' as lang")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/cells"
    made.withColumn("source", F.lit("s")).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert moved(spark, A.word_candidates(A.records(spark, path), cap=1.0)) < 12_000
    plain = sides(spark)
    assert moved(spark, retrieval.retrieve(*plain, 5, 1.0)) < 2 * (plain[0].count() + plain[1].count())


def test_links_do_not_move_texts(spark):
    """Whole texts decide, but only their digests are dealt out."""
    rows = spark.range(60).selectExpr("concat('S', id % 3 + 1, '-', id) as id", "int(id % 3 + 1) as source", "'en' as country", "concat(if(id % 2 = 0, 'Text ', 'tEXT '), id div 6, ' ', array_join(transform(sequence(1, 80), i -> sha2(concat(id div 6, '-', i), 256)), ' ')) as text")
    found = A.links(rows)
    assert found.count() == 40 and found.join(rows.withColumnRenamed("id", "record_id"), "record_id").where("element_at(split(lower(text), ' '), 2) <> string(int(substring(entity_id, 4)) div 6)").count() == 0
    before = {(x.stageId(), x.attemptId()) for x in all_stages(spark)}
    found.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(x.shuffleWriteBytes() for x in all_stages(spark) if (x.stageId(), x.attemptId()) not in before) < 20_000


def test_decisions_and_lists_read_the_same_candidates(spark, monkeypatch):
    """The search, by far the longest step, runs once."""
    calls, search = [], A.retrieval.retrieve_sets
    monkeypatch.setattr(A.retrieval, "retrieve_sets", lambda *a, **k: calls.append(1) or search(*a, **k))
    QUERIES["delivery_problems"](spark, "/root/testdata/sf0.001")
    QUERIES["matches_subset_candidates"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 2


def test_sets_move_in_packs(spark):
    """Whole sets are dealt to several cells each, compressed together: in under 2 bytes a word and copy."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(4, 11))) for _ in range(3000)]
    made = [("x", "v", f"{s}{i}", "\0".join(set(rng.choices(words, range(3000, 0, -1), k=150)))) for s, n in (("r", 1200), ("e", 800)) for i in range(n)]
    sets = spark.createDataFrame(made, "country string, view string, id string, tokens string").coalesce(2)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/packs"
    sets.write.mode("overwrite").parquet(path)
    queries, index = (spark.read.parquet(path).where(f"id like '{s}%'") for s in "re")
    copies = sum(len(t.split("\0")) * 2 for *_, t in made)  # two blocks of entities, two of records
    before = {(x.stageId(), x.attemptId()) for x in all_stages(spark)}
    retrieval.retrieve_sets(queries, index, 1, 1.0, 0.0, 400, 600).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(x.shuffleWriteBytes() for x in all_stages(spark) if (x.stageId(), x.attemptId()) not in before) < 2 * copies


def test_packs_keep_rows():
    """Null ids, empty and null sets, repeated tokens and rows of one pack in several batches."""
    names = [x.split()[0] for x in cells.COLUMNS.split(", ")]
    sets = [("a", "x\0y\0x"), (None, "é\0y"), ("b", ""), ("a", None), ("", "z")]
    rows = [dict(zip(names, ("en", "v", cells.RECORDS, i % 2, 1, 2, None, *s, None))) for i, s in enumerate(sets)]
    schema = pa.schema(list(zip(names, [pa.string(), pa.string(), *[pa.int32()] * 4, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())])))
    found, ids = [], []
    for p in cells.pack(pa.RecordBatch.from_pylist(rows[i : i + 2], schema) for i in (0, 2, 4)):
        for row in p.to_pylist():
            sections = cells._sections(row["pack"])
            if row["kind"] == cells.IDS:
                ids += cells._array(sections).to_pylist()
                continue
            words, codes, ends = cells._unset(sections[3:])
            for i, a, b in zip(cells._array(sections[:3]).to_pylist(), ends, ends[1:]):
                found.append((row["block"], i, *sorted(words[c].as_py() for c in codes[a:b].tolist())))
    assert sorted(found, key=str) == sorted([(0, "a", "x", "x", "y"), (1, None, "y", "é"), (0, "b", ""), (1, "a", ""), (0, "", "z")], key=str)
    assert sorted(ids, key=str) == sorted([s[0] for s in sets], key=str)


def test_rows_of_one_record(spark):
    """A record's tokens may come in several rows, from several tasks."""
    queries, index = sides(spark)
    q, e = retrieval.sets(queries), retrieval.sets(index)
    halves = [q.withColumn("tokens", F.array_join(F.filter(F.split("tokens", "\0"), lambda t, i: i % 2 == n), "\0")) for n in (0, 1)]
    assert rows(retrieval.retrieve_sets(halves[0].union(halves[1]), e, 3, 1.0, 0.0, 300, 40)) == rows(retrieval.retrieve_sets(q, e, 3, 1.0, 0.0))


def test_common_words_are_searched_by(spark):
    """Words of most entities, held as bits, give the sums of the plain join, ties and repeats included; some are in more rows than there are entities."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(90)]

    def some(prefix, n):
        made = [(i, rng.choices(words, [1 / (j + 1) for j in range(90)], k=rng.randrange(1, 40))) for i in range(n)]
        made += [(n + i, made[i % 3][1]) for i in range(n // 10)]  # copies, which tie
        return spark.createDataFrame([("en", "v", f"{prefix}{i}", t) for i, tokens in made for t in [*tokens, "w0"]], POSTING)

    queries, index = some("r", 120), some("e", 2600)
    vocab = retrieval.vocabulary(index, 1e9)
    assert vocab.where("df > 2860").count()
    want = rows(retrieval.top_k(retrieval.scores(retrieval.weighted(queries, vocab), retrieval.weighted(index, vocab)), 5))
    q, e = retrieval.sets(queries), retrieval.sets(index)
    for x, y in ((1 << 16, 1 << 15), (1500, 50)):
        assert rows(retrieval.retrieve_sets(q, e, 5, None, 0.0, x, y)) == want and len(want) == 5 * 132
