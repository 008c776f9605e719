"""Personal data by weak supervision.

Regex, gazetteer and context labelers vote on candidate spans.  Expectation-maximisation
over the counts of vote patterns estimates each labeler's reliability for each kind, and a
logistic span classifier is trained on the resulting soft labels.  Spans of the four base
kinds (e-mail, IP address, card, phone; see `base_spans`) always stay; the classifier adds
others: phones without a plus sign, numbers shaped like cards after a cue word, secrets and names.

Two passes over whole texts: one counts patterns of all documents (a bounded number, as a
pattern is a kind, votes and two size classes), one applies the model row by row.  Nothing
else is shuffled, and the driver sees pattern counts only.

Null text counts as empty.  Repeated rows each get a row.  Extra columns are ignored (or
kept unchanged by `redact`).  Without candidates there is no classifier, and base spans
alone are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "name")
_RANK = {k: i for i, k in enumerate(KINDS)}
_BASE = KINDS[:4]


def _ranges(chars: Iterable[str]) -> str:
    """Characters in ascending order as the inside of a character class."""
    runs: list[list[int]] = []
    for i in map(ord, chars):
        if runs and i == runs[-1][1] + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_GROUPED = re.compile(r"[0-9][0-9 ().-]{7,28}[0-9]")
_ASSIGN = re.compile(r"""[=:][ \t]{0,2}["']?""")
_VALUE = re.compile(r"[A-Za-z0-9_/+=.-]{12,}")
#: Capital and small letters of all alphabets that have both, as ranges of code points.
_CAPITAL, _SMALL = (_ranges(c for c in map(chr, range(0x20, 0x10000)) if test(c)) for test in (str.isupper, str.islower))
_WORD = f"[{_CAPITAL}][{_SMALL}]{{1,20}}"
_NAME = re.compile(f"(?<![{_CAPITAL}{_SMALL}]){_WORD}(?= ({_WORD}))")
_TITLE = re.compile(r"(?:\b(?:mr|mrs|ms|dr|prof|sir|madame|herr|frau|señor|señora|sr|sra)\.? |\b(?:name is|i am|contact|signed|regards|author)\W{1,3})$", re.I)
#: Cue words of each kind, looked for in the 32 characters before a candidate.
_CUES = {
    "email": re.compile(r"e-?mail|contact|write|mailto|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|addr", re.I),
    "card": re.compile(r"card|visa|master|amex|karte|carte|tarjeta|credit|payment", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|anruf|appel|llam", re.I),
    "secret": re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|auth\w*|bearer)\W*$", re.I),
    "name": _TITLE,
}
#: Gazetteers (short public lists); `spans`, `fit`, `detect` and `redact` take other given names.
_SUFFIXES = frozenset("com org net edu gov mil int info biz io co de fr es uk us eu it nl ch at be ca au jp cn in br ru".split())
GIVEN = frozenset("""james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen
daniel matthew anthony mark paul steven andrew george emily emma olivia sophia anna laura julia maria carmen ana jose juan carlos luis javier antonio manuel pedro miguel
pierre jean michel philippe nicolas marie nathalie isabelle catherine sophie camille hans peter klaus wolfgang jürgen stefan andreas thomas sabine monika petra claudia""".split())


class Span(NamedTuple):
    start: int
    kind: str
    end: int
    base: bool
    pattern: str  # kind|votes|length class|digit class


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d += d * (i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """Leftmost non-overlapping matches of each base kind that pass its check."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, "email", m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        a = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            b = a + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((a, "ip", b))
            a = b + 1
    for m in _CARD.finditer(text):
        if len(m[0]) <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], _RANK[s[1]]))


def _pattern(text: str, a: int, kind: str, b: int, given: frozenset[str]) -> str:
    """The labelers' votes: shape, validity, gazetteer, context, boundary; + 0 -."""
    s = text[a:b]
    d = _digits(s)
    before, left, right = text[max(0, a - 32) : a], text[a - 1 : a], text[b : b + 1]
    shape = valid = gazette = 0
    if kind == "email":
        shape, valid = 1, 1 if not re.search(r"\.\.|^\.|-\.|\.-", s) else -1
        gazette = 1 if s.rsplit(".", 1)[-1].lower() in _SUFFIXES else -1
    elif kind == "ip":
        octets = s.split(".")
        shape, valid = 1, 1 if all(o == (o.lstrip("0") or "0") for o in octets) else -1
        gazette = -1 if octets[0] in ("0",) or right == "." else 0
    elif kind == "card":
        shape = 1 if re.fullmatch(r"[0-9]{12,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", s) else -1
        valid = 1 if luhn(d) else -1
        gazette = 1 if d[0] in "3456" else -1
    elif kind == "phone":
        shape = 1 if s[0] == "+" or re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", s) else -1
        valid = 1 if 9 <= len(d) <= 15 else -1
        gazette = 1 if s[0] == "+" and d[0] != "0" else 0
    elif kind == "secret":
        mixed = len(set(s)) >= 8 and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
        shape, valid = 1 if mixed else -1, 1 if len(s) >= 20 and mixed else -1
        gazette = 1 if re.fullmatch(r"[0-9a-fA-F]{32,64}", s) else 0
    else:
        shape, valid = 1, 0
        gazette = 1 if s.split(" ")[0].lower() in given else -1
    cue = 1 if _CUES[kind].search(before) else -1 if kind in ("secret", "name") else 0
    edge = -1 if left.isalnum() and kind != "email" or right.isalnum() else 1
    votes = "".join("-0+"[v + 1] for v in (shape, valid, gazette, cue, edge))
    size = min(3, len(s) // 12)
    return f"{kind}|{votes}|{size}|{min(3, 4 * len(d) // max(len(s), 1))}"


def spans(text: str, given: frozenset[str] = GIVEN) -> list[Span]:
    """Base spans, then further candidates that overlap no base span; both by start."""
    base = base_spans(text)
    found = [Span(a, k, b, True, _pattern(text, a, k, b, given)) for a, k, b in base]
    more: list[tuple[int, str, int]] = []
    for m in _GROUPED.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and (c := _CARD.match(text, m.start())) and c.end() == m.end():
            if _CUES["card"].search(text[max(0, m.start() - 32) : m.start()]):  # its checksum has failed
                more.append((m.start(), "card", m.end()))
    cards, i = list(more), 0
    for m in _LOCAL_PHONE.finditer(text):
        while i < len(cards) and cards[i][2] <= m.start():
            i += 1
        if i == len(cards) or m.end() <= cards[i][0]:
            more.append((m.start(), "phone", m.end()))
    for m in _ASSIGN.finditer(text):
        if v := _VALUE.match(text, m.end()):
            more.append((v.start(), "secret", v.end()))
    for m in _NAME.finditer(text):
        if m[0].lower() in given or _TITLE.search(text[max(0, m.start() - 32) : m.start()]):
            more.append((m.start(), "name", m.end(1)))
    if more:
        taken, i = sorted((a, b) for a, _, b in base), 0
        for a, k, b in sorted(more):
            while i < len(taken) and taken[i][1] <= a and (i + 1 == len(taken) or taken[i + 1][0] <= a):
                i += 1
            if not any(x < b and a < y for x, y in taken[max(0, i - 3) : i + 4]):
                found.append(Span(a, k, b, False, _pattern(text, a, k, b, given)))
    return found


@dataclass(frozen=True)
class Model:
    """Pattern -> probability, and the labelers' estimated reliabilities by kind."""

    probability: dict[str, float]
    reliability: dict[str, list[float]]
    threshold: float = 0.9

    def accepts(self, s: Span) -> bool:
        return s.base or self.probability.get(s.pattern, 0.0) >= self.threshold


def _features(pattern: str) -> np.ndarray:
    kind, votes, size, share = pattern.split("|")
    v = [{"-": -1.0, "0": 0.0, "+": 1.0}[c] for c in votes]
    one = [float(k == kind) for k in KINDS]
    return np.array([1.0, *one, *v, *(float(size == str(i)) for i in range(4)), *(float(share == str(i)) for i in range(4))])


def fit_counts(counts: dict[str, int], rounds: int = 40, threshold: float = 0.9) -> Model:
    """Dawid-Skene EM by kind over pattern counts, then the logistic classifier."""
    patterns = sorted(counts)
    if not patterns:
        return Model({}, {}, threshold)
    soft, reliability = np.zeros(len(patterns)), {}
    for kind in KINDS:
        own = [i for i, p in enumerate(patterns) if p.startswith(kind + "|")]
        if not own:
            continue
        votes = np.array([["-0+".index(c) for c in patterns[i].split("|")[1]] for i in own])
        n = np.array([counts[patterns[i]] for i in own], float)
        y = 1 / (1 + np.exp(-1.5 * ((votes - 1).sum(1) - 1.5)))  # start: the votes' majority
        for _ in range(rounds):
            prior = ((n * y).sum() + 1) / (n.sum() + 2)
            log = np.tile(np.log([[prior], [1 - prior]]), len(own))
            accuracy = []
            for j in range(votes.shape[1]):
                table = np.array([[(n * w * (votes[:, j] == v)).sum() for v in range(3)] for w in (y, 1 - y)])
                # Smoothed towards labelers that are right more often than wrong.
                table = table + 0.02 * n.sum() * np.array([[0.1, 0.3, 0.6], [0.6, 0.3, 0.1]]) + 0.1
                table /= table.sum(1, keepdims=True)
                accuracy.append(float(prior * table[0, 2] + (1 - prior) * table[1, 0]))
                log += np.log(table[:, votes[:, j]])
            y = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
        soft[own] = y
        reliability[kind] = accuracy
    x, n = np.stack([_features(p) for p in patterns]), np.array([counts[p] for p in patterns], float)
    n = np.sqrt(n)  # so that the commonest pattern does not decide alone
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps, ridge penalty
        q = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (n * (soft - q)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    q = 1 / (1 + np.exp(-x @ w))
    return Model(dict(zip(patterns, q.tolist())), reliability, threshold)


def _strings(column: pa.Array) -> list[str]:
    """Texts; invalid UTF-8 reads as replacement characters."""
    return ["" if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _steps(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that few texts are Python strings at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def fit(docs: DataFrame, text_col: str = "text", given: frozenset[str] = GIVEN) -> Model:
    """Counts the patterns of all candidates of all texts and fits the model to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in _steps(batch):
                for text in _strings(part.column(0)):
                    counts.update(s.pattern for s in spans(text, given))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return fit_counts({r.pattern: r.n for r in found.collect()})


def _joined(found: list) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(found, key=lambda s: (s.start, _RANK[s.kind], s.end)))


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", given: frozenset[str] = GIVEN) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of base spans; spans of all."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch):
                out: list[list] = [[] for _ in range(6)]
                for text in _strings(part.column(1)):
                    found = [s for s in spans(text, given) if model.accepts(s)]
                    base = [s for s in found if s.base]
                    row = [*(sum(s.kind == k for s in base) for k in _BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)]
                    for column, v in zip(out, row):
                        column.append(v)
                arrays = [*(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return source.mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model, text_col: str = "text", given: frozenset[str] = GIVEN) -> DataFrame:
    """The same rows and columns, each found span replaced by its kind in angle brackets.
    Overlapping spans are replaced together, by the first one's kind; null stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch):
                out: list[str | None] = []
                for text, there in zip(_strings(part.column(at)), part.column(at).is_valid().to_pylist()):
                    parts, done, reach = [], 0, 0
                    for s in sorted((s for s in spans(text, given) if model.accepts(s)), key=lambda s: (s.start, _RANK[s.kind])):
                        if s.start >= reach:
                            parts += [text[done : s.start], f"<{s.kind}>"]
                        done = reach = max(reach, s.end)
                    out.append("".join([*parts, text[done:]]) if there else None)
                yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return detect(docs, fit(docs))
