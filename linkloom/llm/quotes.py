"""Chat formatting by quotation linking.

Messages are parsed into their own text and quoted passages (runs of lines with the same
number of ``>`` marks).  Passages, and their longer lines, are normalised and hashed to 128
bits, and joined to earlier messages of the conversation whose whole text, paragraph or line
has the same hash.  The message quoted at the outermost level becomes the parent; a whole
passage counts before a line and a later message before an earlier one.  A message without
a found quotation replies to the message before it.  The result has each message without
quotes, its parent and its chat turn, and its place in the reply tree: the turn of the thread's
first message, the number of replies from there, and the turn at which its branch left the
order of turns.  Ordered by conversation, thread, branch and turn, a branch is read from its
first message to its last, and every parent comes before its replies.

The join asks, for a hash and a turn, for the latest original before that turn.  Questions
and originals are reduced to distinct (conversation, hash, turn) first and answered in
stretches of `Settings.stretch` turns, so neither a very long conversation nor a line that
all messages share makes pairs or lands in one task; no conversation is ever collected.  Reply
trees are climbed by doubling, in as many joins as the longest chain has binary digits; each
message asks for one ancestor, so a step has as many rows as there are turns.

Null text counts as empty.  Null conversation ids form one conversation.  Messages without a
turn have no place: they get no parent, thread or branch and are nobody's parent.  Repeated rows,
and messages that share a turn, each get a row and the same treatment; in the tree, a shared turn
stands once, under the earliest parent of its messages.  Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm._stage import staged

_MARKS = re.compile(r"(?:[ \t]{0,3}>)+[ \t]?")
_INTRO = re.compile(r"^(?:on|le|am|el)\b.{0,200}(?:wrote|écrit|schrieb|escribió)\s*:?\s*$", re.I)


@dataclass(frozen=True)
class Settings:
    line_words: int = 3  # shorter lines alone do not identify a message
    stretch: int = 256  # turns answered together


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The message's own text, and its quoted passages as (level, lines) in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m[0].count(">") if m else 0
        if level:
            if before != level:
                passages.append((level, []))
                if not before and own and _INTRO.match(own[-1].strip()):
                    own.pop()
            passages[-1][1].append(line[m.end() :])
        else:
            own.append(line)
        before = level
    return "\n".join(own).strip(), passages


def _units(own: str, passages: list[tuple[int, list[str]]], how: Settings) -> Iterator[tuple[int, int, bytes]]:
    """(level, rank, hash): level 0 for what others may quote; rank 0 for passages, 1 for lines."""
    found = {normal(own), *(normal(p) for p in re.split(r"\n[ \t]*\n", own)), *(n for n in map(normal, own.split("\n")) if n.count(" ") >= how.line_words - 1)}
    yield from ((0, 0, digest(t)) for t in sorted(found) if t)
    for level, lines in passages:
        whole = normal(" ".join(lines))
        if whole:
            yield level, 0, digest(whole)
        yield from ((level, 1, digest(n)) for n in dict.fromkeys(map(normal, lines)) if n.count(" ") >= how.line_words - 1)


def _latest_before(asked: DataFrame, originals: DataFrame, how: Settings) -> DataFrame:
    """asked(conv, hash, turn) with `parent`: the latest original(conv, hash, turn) before it."""
    both = asked.select("conv", "hash", "turn", F.lit(None).cast("long").alias("there")).union(originals.select("conv", "hash", "turn", F.col("turn").alias("there")))
    both = both.groupBy("conv", "hash", "turn").agg(F.max("there").alias("there"), F.count_if(F.col("there").isNull()).alias("asks")).withColumn("stretch", F.floor(F.col("turn") / how.stretch))
    ends = both.groupBy("conv", "hash", "stretch").agg(F.max("there").alias("end"))
    earlier = Window.partitionBy("conv", "hash").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.max("end").over(earlier)).drop("end")
    inside = Window.partitionBy("conv", "hash", "stretch").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.max("there").over(inside)).where("asks > 0").join(ends, ["conv", "hash", "stretch"])
    return found.select("conv", "hash", "turn", F.coalesce("near", "carried").alias("parent")).where("parent is not null")


def reply_tree(turns: DataFrame) -> DataFrame:
    """turns(conv, turn, up, before) with thread (the first turn above), depth (replies from there)
    and branch: the turn at or above this one that does not follow the turn before it.  Turns whose
    first turn is found are set aside; only the others climb on."""
    starts = F.when(F.col("up").isNull() | ~F.col("up").eqNullSafe(F.col("before")), F.col("turn"))
    depth = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")
    state = staged(turns.select("conv", "turn", "up", F.coalesce("up", "turn").alias("top"), depth.alias("depth"), starts.alias("branch")), "tree")
    done, climbing = [state.where("up is null")], state.where("up is not null")
    while not climbing.isEmpty():
        all_ = reduce(DataFrame.union, done, climbing)
        above = all_.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("branch").alias("branch2"))
        step = climbing.join(above, ["conv", "up"]).select("conv", "turn", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth"), F.coalesce("branch", "branch2").alias("branch"))
        state = staged(step, "tree")
        done.append(state.where("up is null"))
        climbing = state.where("up is not null")
    return reduce(DataFrame.union, done).select("conv", "turn", F.col("top").alias("thread"), "depth", "branch")


def link_quotations(messages: DataFrame, how: Settings = Settings()) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, parent_turn, by_quote, chat, thread,
    depth, branch."""
    source = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("conv", F.xxhash64("conv_id")).withColumn("message", F.xxhash64("conv_id", "turn", "role", "text"))
    schema = f"conv_id {source.schema['conv_id'].dataType.simpleString()}, turn long, role string, conv long, message long, own string, n_quotes int, units array<struct<level:int,rank:int,hash:binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("rank", pa.int32()), ("hash", pa.binary())]))
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                parsed = [parse("" if t is None else t.decode("utf-8", "replace")) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                units = [[{"level": a, "rank": b, "hash": h} for a, b, h in _units(own, passages, how)] for own, passages in parsed]
                arrays = [pa.array([p[0] for p in parsed], pa.string()), pa.array([len(p[1]) for p in parsed], pa.int32()), pa.array(units, kind)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role", "conv", "message")), *arrays], ["conv_id", "turn", "role", "conv", "message", "own", "n_quotes", "units"])

    parsed = staged(source.mapInArrow(run, schema), "messages")
    placed = parsed.where("turn is not null")
    units = placed.select("conv", "turn", "message", F.explode("units").alias("u")).select("conv", "turn", "message", "u.*")
    any_ = F.lit(b"").alias("hash")  # stands for a message itself, whatever its text
    itself = placed.select("conv", "turn", "message", F.lit(1 << 30).alias("level"), F.lit(2).alias("rank"), any_)
    asked = units.where("level > 0").union(itself)
    originals = units.where("level = 0").select("conv", "hash", "turn").union(placed.select("conv", any_, "turn"))
    answers = _latest_before(asked.select("conv", "hash", "turn"), originals, how)
    best = asked.join(answers, ["conv", "hash", "turn"]).groupBy("message").agg(F.min(F.struct("level", "rank", (-F.col("parent")).alias("back"))).alias("best"))
    found = parsed.join(best, "message", "left")
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.col("own"), F.lit("\n"))
    by_quote = F.coalesce(F.col("best.rank") < 2, F.lit(False))
    before = answers.where(F.col("hash") == F.lit(b"")).select("conv", "turn", F.col("parent").alias("before"))
    found = staged(found.select("conv_id", "turn", "role", F.col("own").alias("text"), "n_quotes", (-F.col("best.back")).alias("parent_turn"), by_quote.alias("by_quote"), chat.alias("chat"), "conv"), "linked")
    turns = found.where("turn is not null").groupBy("conv", "turn").agg(F.min("parent_turn").alias("up")).join(before, ["conv", "turn"], "left")
    return found.join(reply_tree(turns), ["conv", "turn"], "left").select("conv_id", "turn", "role", "text", "n_quotes", "parent_turn", "by_quote", "chat", "thread", "depth", "branch")


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Rows ordered by conversation, thread, branch and turn across range partitions: every branch
    in one piece, and parents before replies."""
    order = ("conv_id", "thread", "branch", "turn")
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_reply_order(link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
