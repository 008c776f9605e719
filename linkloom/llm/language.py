"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built.  A text is parsed
greedily into the longest phrases that occur in a language's sample; the language
that needs the fewest phrases, normalised by phrase cost and length, wins.

The sample is bounded (`Settings.train_chars` characters a language, from
texts in hash order of the id, long ones last and cut).  Every language has an alphabet of its
own: the commonest letters of its sample get a code each, the rarer ones (of a script of
thousands of signs, say) share the last `Settings.shared` codes by code point, and letters that
the sample lacks always begin a new phrase.  So a script of one language takes no code from
another's, and the step tables stay bounded.  Everything else covers whole texts.  Prediction is
row by row inside each partition.  Parsing runs in numpy over many stretches of
text at once; a stretch is `Settings.stretch` characters, so a text of any length
is parsed completely in bounded steps.

Null text, or text without a letter, gives `und` with score 0.  Null labels are not
learned.  Repeated rows each get a result; an empty table gives an empty result;
without any labelled text every prediction is `und`.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm import _bytes as B

UND = "und"
GAP = 0  # code of whatever is not a letter
ABSENT = 1  # code of a letter that the sample lacks


@dataclass(frozen=True)
class Settings:
    train_chars: int = 16_000
    train_texts: int = 64
    longest_train_text: int = 4_000
    alphabet: int = 94  # codes of letters, the shared ones included
    shared: int = 32
    stretch: int = 256
    slice_bytes: int = 2 << 20
    sharpness: float = 24.0


def training_sample(labelled: DataFrame, settings: Settings) -> DataFrame:
    """At most `train_texts` texts a language, by hash of the id; text, lang.  Texts longer than
    `longest_train_text` come after all others, cut to `train_chars` from their first letter.

    Ranks are taken over ids alone and cut in every task before the shuffle, so a
    language that holds most rows sends a bounded number of rows.
    """
    usable = F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    order = Window.partitionBy("lang").orderBy((F.length("text") > settings.longest_train_text).cast("int"), (F.length("text") < 200).cast("int"), F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text")
    lettered = F.when(F.length("text") <= settings.longest_train_text, F.col("text")).otherwise(F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, settings.train_chars))
    return labelled.where(usable).select("doc_id", "text", "lang").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= settings.train_texts).select("lang", "_rank", lettered.alias("text"))


def read_sample(sample: DataFrame, settings: Settings) -> dict[str, str]:
    """language -> sample text; bounded by languages x train_chars."""
    texts: dict[str, list[str]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r.lang, r._rank)):
        own = texts.setdefault(row.lang, [])
        if sum(map(len, own)) < settings.train_chars:
            own.append(row.text)
    return {lang: "\n".join(own) for lang, own in sorted(texts.items())}


def automaton(codes: list[int], letters: int) -> np.ndarray:
    """Suffix automaton as a flat step table of `letters` entries a state.

    Entry: twice the offset of the next state, plus 1 where no transition exists; the
    next state is then the one that a new phrase starting with that letter reaches.
    """
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    dead = len(follow)  # after a letter that the sample lacks: every letter starts a new phrase
    fresh = np.array([follow[0].get(c, dead) for c in range(letters)], np.int64)
    table = np.tile(2 * letters * fresh + 1, (dead + 1, 1))
    for state, ways in enumerate(follow):
        for c, to in ways.items():
            table[state, c] = 2 * letters * to
    return table.astype(np.int32).ravel()


class Parser:
    """Predicts from sample texts; built once in every Python worker."""

    def __init__(self, samples: dict[str, str], settings: Settings):
        self.settings = settings
        self.languages = list(samples)
        self.letters = settings.alphabet + 2
        self.letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.codes, self.tables, self.cost = [], [], []
        for text in samples.values():
            code = self.alphabet(text)
            own = code[self.signs(text)]
            self.codes.append(code)
            self.tables.append(automaton(own.tolist(), self.letters))
            self.cost.append(np.log2(max(len(own), 2)))

    def alphabet(self, text: str) -> np.ndarray:
        """The code of every code point in the language of a sample."""
        how, code = self.settings, np.where(self.letter, ABSENT, GAP).astype(np.uint8)
        seen = Counter(c for c in text.lower() if c.isalpha())
        ranked = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        single = how.alphabet if len(ranked) <= how.alphabet else how.alphabet - how.shared
        for k, c in enumerate(ranked):
            value = 2 + (k if k < single else single + ord(c) % how.shared)
            for x in {c, c.upper()}:
                if len(x) == 1:
                    code[ord(x)] = value
        return code

    def signs(self, text: str) -> np.ndarray:
        """Code points, each run of what is no letter as one 0."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(self.letter[points], points, 0)
        return points[np.append(True, (points[1:] != 0) | (points[:-1] != 0))] if len(points) else points

    def predict(self, texts: B.Texts) -> tuple[list[str], np.ndarray]:
        n = texts.hi - texts.lo
        raw = texts.buf.tobytes()
        parts = [self.signs(raw[a:b].decode("utf-8", "replace")) for a, b in zip(texts.offs[:-1].tolist(), texts.offs[1:].tolist())]
        sizes = np.fromiter(map(len, parts), np.int64, n)
        seq = np.concatenate(parts) if n else np.zeros(0, np.uint32)
        at = np.concatenate([[0], np.cumsum(sizes)])
        lettered = B.per_text(seq != 0, at) > 0
        score = np.zeros(n)
        if not self.languages:
            return [UND] * n, score
        # Cut each text into stretches, longest first, and step through all of them at once.
        step = self.settings.stretch
        lanes = -(-sizes // step)
        owner = np.repeat(np.arange(n), lanes)
        begin = at[owner] + step * (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        left = np.minimum(step, at[owner + 1] - begin)
        order = np.argsort(-left, kind="stable")
        owner, begin, left = owner[order], begin[order], left[order]
        active = np.searchsorted(-left, -np.arange(step), "left")  # lanes longer than t
        costs = np.empty((len(self.languages), n))
        states = [np.full(len(owner), len(table) - self.letters, np.int32) for table in self.tables]  # the dead state
        phrases = [np.zeros(len(owner), np.int32) for _ in self.languages]
        coded = [code[seq] for code in self.codes]
        for t in range(step):
            k = int(active[t])
            if not k:
                break
            place = begin[:k] + t
            for codes, table, state, count in zip(coded, self.tables, states, phrases):
                to = table[state[:k] + codes[place]]
                count[:k] += to & 1
                state[:k] = to >> 1
        for i, count in enumerate(phrases):
            costs[i] = np.bincount(owner, count, n) * self.cost[i] / np.maximum(sizes, 1)
        best = costs.argmin(0)
        weight = np.exp(-self.settings.sharpness * (costs - costs.min(0)))
        score = np.where(lettered, 1 / weight.sum(0), 0.0)
        return [self.languages[b] if ok else UND for b, ok in zip(best.tolist(), lettered.tolist())], score


_parsers: dict = {}


def predict_language(docs: DataFrame, samples: dict[str, str], settings: Settings = Settings(), text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred and score to the columns `keep` of every row."""
    source = docs.select(*keep, *({text_col} - {*keep}))
    at = source.columns.index(text_col)
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((settings, tuple(samples.items())))
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(samples, settings)
        parser = _parsers[key]
        for batch in batches:
            for texts in B.slices(batch.column(at), settings.slice_bytes):
                names, score = parser.predict(texts)
                rest = [batch.column(i)[texts.lo : texts.hi] for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def learn(docs: DataFrame, settings: Settings = Settings()) -> dict[str, str]:
    return read_sample(training_sample(docs.where(~held_out()), settings), settings)


def op3_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict_language(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
