"""Token counts by offset-mapped attribution.

Every document is encoded once, as a whole; the byte lengths of its tokens give each
token's exact span.  The spans are interval-joined (a merge of two sorted lists) to
the document's fields or sections, and a token that crosses a boundary is allocated
by an explicit rule:

* ``first``   - to the section that holds its first byte (default);
* ``last``    - to the section that holds its last byte;
* ``largest`` - to the section that holds most of its bytes, the earlier one in a tie.

Sections tile the document: a separator or line end belongs to the section before it,
so counts of the sections always add up to the document's count.

Rows are handled one by one inside their partition; memory follows one slice of texts.
Null or empty text is one empty section without tokens; null fields count as empty;
repeated rows each give their sections; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import _bytes as B

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "largest")


class Encoder:
    """Byte-level BPE with the byte length of every token."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)
        self.encode = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def spans(self, texts: B.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all tokens in the slice's bytes, and the first token of each text."""
        raw, starts, count = texts.buf.tobytes(), [], np.zeros(texts.hi - texts.lo + 1, np.int64)
        for i, (a, b) in enumerate(zip(texts.offs[:-1].tolist(), texts.offs[1:].tolist())):
            if a < b:
                size = self.length[np.array(self.encode(raw[a:b].decode("utf-8", "replace")), np.int64)]
                at = np.cumsum(size) - size
                starts.append(a + np.minimum(at, b - a - 1))
                count[i + 1] = len(size)
        return (np.concatenate(starts) if starts else np.zeros(0, np.int64)), np.cumsum(count)


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans to the sections that begin at `sections`: each token's
    section, and whether it crosses a boundary."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    cross = first != last
    if rule == "first":
        return first, cross
    if rule == "last":
        return last, cross
    to = first.copy()
    for i in np.flatnonzero(cross):
        edge = np.clip(sections[first[i] : last[i] + 2], starts[i], ends[i])
        edge[0] = starts[i]
        share = np.diff(np.append(edge[: last[i] - first[i] + 1], ends[i]))
        to[i] = first[i] + int(share.argmax())
    return to, cross


_encoders: dict = {}


def attribute_tokens(docs: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = ("text",), separator: str = "\n", lines: bool = True, rule: str = "first", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per section of each document (its fields joined by `separator`, cut at line
    ends too if `lines`): field, section, char_start, char_end, n_tokens, n_crossing (tokens
    allocated here that reach into another section) and doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = f.read()  # a fixed file of about half a megabyte
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    whole = [x for c in text for x in (c, F.lit(separator))][:-1]
    source = docs.select(F.col(id_col).alias("doc_id"), F.concat(*whole).alias("text"), F.array(*(F.octet_length(c).cast("long") for c in text)).alias("sizes"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, field int, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
    gap, names = len(separator.encode()), [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((ranks, pattern))
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(ranks, pattern))
        for batch in batches:
            sizes = np.asarray(batch.column(2).flatten()).reshape(-1, len(fields))
            for texts in B.slices(batch.column(1)):
                n = texts.hi - texts.lo
                begins, at = encoder.spans(texts)
                token_text = np.repeat(np.arange(n), np.diff(at))
                ends = np.append(begins[1:], 0)
                ends[at[1:][np.diff(at) > 0] - 1] = texts.offs[1:][np.diff(at) > 0]
                # Sections are numbered over the slice; empty fields and texts own a section too.
                own = sizes[texts.lo : texts.hi]
                field_at = texts.offs[:-1, None] + np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(own[:, :-1] + gap, 1)], 1)
                starts = field_at.ravel()
                text_of, field_of = np.repeat(np.arange(n), len(fields)), np.tile(np.arange(len(fields)), n)
                if lines:
                    cut = np.flatnonzero(texts.buf == 0x0A) + 1
                    cut_text = np.searchsorted(texts.offs, cut - 1, "right") - 1
                    inner = (cut < texts.offs[cut_text + 1]) & ~np.isin(cut, starts)
                    cut, cut_text = cut[inner], cut_text[inner]
                    cut_field = (np.searchsorted(starts, cut, "right") - 1) % len(fields)
                    starts, text_of, field_of = np.append(starts, cut), np.append(text_of, cut_text), np.append(field_of, cut_field)
                    order = np.lexsort((field_of, starts, text_of))
                    starts, text_of, field_of = starts[order], text_of[order], field_of[order]
                # A token's text bounds its sections: shift each text by its number to keep empty ones apart.
                to, cross = allocate(begins + token_text, ends + token_text, starts + text_of, rule)
                chars = np.zeros(len(texts.buf) + 1, np.int64)
                np.cumsum((texts.buf & 0xC0) != 0x80, out=chars[1:])
                first = np.searchsorted(text_of, np.arange(n + 1))
                stop = np.append(starts[1:], len(texts.buf))
                stop[first[1:] - 1] = texts.offs[1:]
                base = chars[texts.offs[:-1]][text_of]
                m = len(starts)
                columns = (field_of.astype(np.int32), (np.arange(m) - first[text_of]).astype(np.int32), chars[starts] - base, chars[stop] - base, np.bincount(to, minlength=m), np.bincount(to[cross], minlength=m), np.diff(at)[text_of])
                ids = batch.column(0).take(pa.array(texts.lo + text_of))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns)], names)

    return source.mapInArrow(run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
