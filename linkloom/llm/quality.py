"""Quality classifier by Bradley-Terry pairwise ranking.

Document scores are learned from preference pairs (a text labelled 1 is preferred to one
labelled 0) by logistic loss on feature differences.  The decision threshold is a quantile
of the learned scores: the share of texts labelled 0.  Scores are mapped to 0..1 so that
this quantile lies at `Settings.threshold`.

Features come from whole texts: shares of character classes and of their transitions,
word lengths, line shapes, repetition, and hashed word frequencies.  Neither labels nor
lang, source or id enter them.  The fit uses every labelled row and `Settings.pairs` pairs of
each preferred text.  Up to `Settings.gathered` rows are fitted at once; more are dealt into
blocks by hash of the id, pairs are made inside a block, and weights and cut are those of all
blocks.  All documents are scored, row by row inside their partition.

Null and empty texts have all-zero features and get a score like any other.  Null labels are
not learned; several labels of one id count by their mean, and a tie is not learned.
Repeated rows each get a row.  Without labels of both classes every score is 0.5.  An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import _bytes as B
from linkloom.llm._stage import keep_batches_small, staged
from linkloom.sources.staging import spread

_CLASSES = 9
_CLASS = np.full(256, 8, np.uint8)  # 8: bytes of characters outside ASCII
_CLASS[:128] = 7
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x0A] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[list(b".,;:'\"?-()")] = 5
_CLASS[list(b"#*$%&|<>@!+=^~_{}[]\\/")] = 6


@dataclass(frozen=True)
class Settings:
    gathered: int = 8_000
    block: int = 4_096
    pairs: int = 8
    hashed: int = 512
    threshold: float = 0.7
    ridge: float = 2e-3
    rounds: int = 60

    @property
    def features(self) -> int:
        return 8 + _CLASSES + _CLASSES * _CLASSES + self.hashed


def features(texts: B.Texts, how: Settings) -> np.ndarray:
    """A row of features for each text of a slice."""
    n, buf = texts.hi - texts.lo, texts.buf
    out = np.zeros((n, how.features), np.float32)
    size = np.diff(texts.offs)
    owner = np.repeat(np.arange(n), size)
    kind = _CLASS[buf]
    one = np.bincount(owner * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, -1)
    two = np.zeros((n, _CLASSES * _CLASSES))
    if len(buf) > 1:
        same = owner[1:] == owner[:-1]
        pair = kind[:-1].astype(np.int64) * _CLASSES + kind[1:]
        two = np.bincount((owner[1:] * _CLASSES**2 + pair)[same], minlength=n * _CLASSES**2).reshape(n, -1)
    words = B.split(texts)
    count = np.diff(words.first)
    word_text = words.text_of()
    h = B.span_hashes(B.byte_codes(B.lower_ascii(buf)), words.starts, words.ends)
    g, at = B.shingle_hashes(h, word_text, 3)
    many, _ = B.repeated(g + word_text[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    repeat = B.per_text(B.covered(at[many], 3, len(h)), words.first)
    _, later = B.repeated(h + word_text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    distinct = count - B.per_text(later, words.first)
    length = words.ends - words.starts
    some, chars = np.maximum(count, 1), np.maximum(size, 1)
    out[:, 0] = repeat / some
    out[:, 1] = distinct / some
    out[:, 2] = B.per_text(length, words.first) / some / 10
    out[:, 3] = B.per_text(length == 1, words.first) / some
    out[:, 4] = B.per_text(length > 12, words.first) / some
    out[:, 5] = np.log1p(count) / 10
    out[:, 6] = one[:, 1] / some
    out[:, 7] = count < 10
    out[:, 8 : 8 + _CLASSES] = np.sqrt(one / chars[:, None])
    out[:, 8 + _CLASSES : 8 + _CLASSES + _CLASSES**2] = np.sqrt(two / chars[:, None])
    cell = (h >> np.uint64(40)).astype(np.int64) % how.hashed
    bag = np.bincount(word_text * how.hashed + cell, minlength=n * how.hashed).reshape(n, -1)
    out[:, 8 + _CLASSES + _CLASSES**2 :] = np.sqrt(bag / some[:, None])
    return out


@dataclass(frozen=True)
class Ranker:
    """score = sigmoid(logit(threshold) + w . x - cut); `cut` is the quantile's raw score."""

    weights: np.ndarray
    cut: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = x @ self.weights - self.cut + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, how: Settings, seed: int = 7) -> Ranker | None:
    """Bradley-Terry: each preferred text against `pairs` others, accelerated gradient
    steps on the logistic loss of feature differences."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    diff = x[np.repeat(good, how.pairs)] - x[bad[rng.integers(0, len(bad), len(good) * how.pairs)]]
    w, v, rate = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 4.0
    for _ in range(how.rounds * 4):  # accelerated gradient descent; features are at most 1
        ahead = w + 0.9 * v
        q = 1 / (1 + np.exp(np.clip(diff @ ahead, -500, 500)))
        v = 0.9 * v + rate * (diff.T @ q / len(diff) - how.ridge * ahead)
        w = w + v
    raw = x @ w
    # The quantile of the share labelled 0, in the middle of its gap.
    k = len(bad)
    ordered = np.sort(raw)
    cut = float((ordered[k - 1] + ordered[min(k, len(ordered) - 1)]) / 2)
    return Ranker(w, cut, how.threshold)


def pair_slope(x: np.ndarray, y: np.ndarray, w: np.ndarray, how: Settings, seed: list[int]) -> tuple[float, float, np.ndarray]:
    """(pairs, loss, slope) of a block's pairs, those of `fit_pairs`, without a row for each pair."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return 0.0, 0.0, np.zeros(len(w))
    x = x.astype(np.float64)
    raw, first = x @ w, np.repeat(good, how.pairs)
    second = bad[np.random.default_rng(seed).integers(0, len(bad), len(first))]
    lead = np.clip(raw[first] - raw[second], -500, 500)
    q = 1 / (1 + np.exp(lead))
    return float(len(first)), float(np.logaddexp(0, -lead).sum()), x.T @ (np.bincount(second, q, len(x)) - np.bincount(first, q, len(x)))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): one label for each id."""
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q <> 0.5").select("doc_id", (F.col("q") > 0.5).cast("int").alias("quality"))


def _vectors(docs: DataFrame, how: Settings, keep: str) -> DataFrame:
    """(keep, x) of every row of docs(keep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in B.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[texts.lo : texts.hi], pa.array([r.tobytes() for r in features(texts, how)], pa.binary())], [keep, "x"])

    return docs.select(keep, "text").mapInArrow(run, f"{keep} {dict(docs.dtypes)[keep]}, x binary")


def learn(docs: DataFrame, labels: DataFrame, how: Settings = Settings()) -> Ranker | None:
    """The ranker of all labelled rows: fitted at once where they are few, else by blocks."""
    known = known_labels(labels)
    count = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not count.get(0) or not count.get(1):
        return None
    if sum(count.values()) <= how.gathered:
        rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
        few = _vectors(rows.select("quality", "text"), how, "quality").orderBy(F.xxhash64("x"), "x", "quality").limit(how.gathered + 1).toArrow()
        if not few.num_rows:
            return None
        if few.num_rows <= how.gathered:  # more, if ids are repeated
            return fit_pairs(_matrix(b"".join(few.column("x").to_pylist()), how), few.column("quality").to_numpy(), how)
    return fit_blocks(blocks(docs, known, min(count.values()), sum(count.values()), how), how)


def _matrix(x: bytes, how: Settings) -> np.ndarray:
    return np.frombuffer(x, np.float32).reshape(-1, how.features)


def blocks(docs: DataFrame, known: DataFrame, fewer: int, total: int, how: Settings) -> DataFrame:
    """(block, x, y): every labelled row in one block by the hash of its id, a block in a row.  Blocks have about
    `Settings.block` rows, and 32 of the rarer class."""
    keep_batches_small(docs.sparkSession)
    n = max(1, min(-(-total // how.block), fewer // 32))
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(6)), F.lit(n)).alias("block")
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("id"), "text")
    found = _vectors(named, how, "id").withColumnRenamed("id", "doc_id").select(block, "doc_id", F.lit(None).cast("int").alias("quality"), "x")
    marks = known.select(F.col("doc_id").cast("string").alias("doc_id"), "quality").select(block, "doc_id", "quality", F.lit(None).cast("binary").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A label comes before the rows of its id.
        at, label, held, marks = None, (None, None), [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([bytes(marks)], pa.binary())], ["block", "x", "y"])

        for batch in batches:
            for own, name, quality, x in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "quality", "x"))):
                if own != at:
                    if held:
                        yield out()
                    at, held, marks = own, [], []
                if x is None:
                    label = (name, quality)
                elif label[0] == name:
                    held.append(x)
                    marks.append(label[1])
        if held:
            yield out()

    dealt = spread(found.unionByName(marks), "block").sortWithinPartitions("block", "doc_id", F.col("quality").asc_nulls_last(), "x")
    return staged(dealt.mapInArrow(run, "block long, x binary, y binary"), "quality")


def fit_blocks(table: DataFrame, how: Settings, tight: float = 1e-8) -> Ranker | None:
    """The least loss over the pairs of all blocks, by L-BFGS on its exact slope, one pass over the blocks a step.
    One block gives the first weights and the curvature, which only decide the number of steps."""

    def each(work, schema: str) -> pa.Table:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = ((b, _matrix(x, how), np.frombuffer(y, np.uint8)) for batch in batches for b, x, y in zip(*(c.to_pylist() for c in batch.columns)))
            yield from work(parts)

        return table.mapInArrow(run, schema).toArrow()

    def slope(w: np.ndarray) -> tuple[float, np.ndarray]:
        def work(parts):
            n, loss, g = 0.0, 0.0, np.zeros(how.features)
            for b, x, y in parts:
                a, c, d = pair_slope(x, y, w, how, [7, b])
                n, loss, g = n + a, loss + c, g + d
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([g.tobytes()], pa.binary())], ["n", "loss", "g"])

        found = each(work, "n double, loss double, g binary")
        n = sum(found.column("n").to_pylist())
        g = sum((np.frombuffer(x) for x in found.column("g").to_pylist()), np.zeros(how.features))
        return sum(found.column("loss").to_pylist()) / max(n, 1) + how.ridge / 2 * float(w @ w), g / max(n, 1) + how.ridge * w

    some = table.orderBy("block").limit(1).toArrow()
    if not some.num_rows:
        return None
    x, y = _matrix(some.column("x")[0].as_py(), how)[: how.gathered], np.frombuffer(some.column("y")[0].as_py(), np.uint8)[: how.gathered]
    start = fit_pairs(x, y, how)
    w = start.weights if start else np.zeros(how.features)
    curve = np.eye(how.features) * how.ridge
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if start:
        d = x[np.repeat(good, how.pairs)].astype(np.float64) - x[bad[np.random.default_rng(7).integers(0, len(bad), len(good) * how.pairs)]]
        q = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        curve += (d * (q * (1 - q))[:, None]).T @ d / len(d)
    back = np.linalg.inv(curve)
    loss, g = slope(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(how.rounds):
        if np.abs(g).max() <= tight:
            break
        p, used = g.copy(), []
        for s, t in reversed(past):
            a = (s @ p) / (s @ t)
            used.append(a)
            p -= a * t
        p = back @ p
        for (s, t), a in zip(past, reversed(used)):
            p += s * (a - (t @ p) / (s @ t))
        step = 1.0
        while True:
            ahead = w - step * p
            next_loss, next_g = slope(ahead)
            if next_loss <= loss - 1e-4 * step * (p @ g) + 1e-13 or step < 1e-6:
                break
            step /= 2
        if (ahead - w) @ (next_g - g) > 0:
            past = [*past, (ahead - w, next_g - g)][-10:]
        w, loss, g = ahead, next_loss, next_g

    # The quantile of the share labelled 0, in the middle of its gap: a histogram, then the values of its bins.
    def ends(parts):
        for _, x, y in parts:
            raw = x @ w
            yield pa.RecordBatch.from_arrays([pa.array([raw.min()]), pa.array([raw.max()]), pa.array([len(y)]), pa.array([int((y == 0).sum())])], ["lo", "hi", "n", "bad"])

    found = each(ends, "lo double, hi double, n long, bad long").to_pydict()
    lo, hi, n, k = min(found["lo"]), max(found["hi"]), sum(found["n"]), sum(found["bad"])
    if not 0 < k < n:
        return None
    bins = 4096

    def place(raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - lo) / max(hi - lo, 1e-300) * bins, 0, bins - 1).astype(np.int64)

    def counts(parts):
        total = np.zeros(bins, np.int64)
        for _, x, _ in parts:
            total += np.bincount(place(x @ w), minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["c"])

    below = np.cumsum(sum(np.frombuffer(c, np.int64) for c in each(counts, "c binary").column("c").to_pylist()))
    a, b = (int(np.searchsorted(below, r, "right")) for r in (k - 1, k))

    def inside(parts):
        for _, x, _ in parts:
            raw = x @ w
            at = place(raw)
            value, times = np.unique(raw[(at >= a) & (at <= b)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(times)], ["v", "c"])

    held = each(inside, "v double, c long")
    order = np.argsort(held.column("v").to_numpy())
    value, upto = held.column("v").to_numpy()[order], np.cumsum(held.column("c").to_numpy()[order]) + (below[a - 1] if a else 0)
    first, second = (value[np.searchsorted(upto, r, "right")] for r in (k - 1, k))
    return Ranker(w, float((first + second) / 2), how.threshold)


def score(docs: DataFrame, ranker: Ranker | None, how: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Adds score and predicted to the columns `keep` of every row."""
    source = docs.select(F.col(text_col).alias("_text"), *keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in B.slices(batch.column(0)):
                s = ranker.score(features(texts, how)) if ranker else np.full(texts.hi - texts.lo, 0.5)
                rest = [batch.column(i + 1)[texts.lo : texts.hi] for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(s)], [*keep, "score"])

    return source.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= how.threshold).cast("int"))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def op6_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranker = learn(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), ranker).select("doc_id", held_out().alias("held_out"), "score", "predicted")
