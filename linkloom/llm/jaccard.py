"""N-gram Jaccard join with a count-vector R-tree.

Two documents link when the Jaccard similarity of their word-shingle sets is at least
`Join.percent` / 100.  The result is exact: classes of equal sets, and the connected
components of all links between classes.

1. One pass gives every row a 128-bit key of its shingle set (equal sets, one class) and adds
   the shingles to a count sketch, which orders shingles by rarity.
2. Routing: of n shingles, the n - ceil(p n) + m rarest hold m that are also among the
   rarest of any partner, where m = 1 + n / `Join.slack` for the smaller set.  Shingles that
   only one class has drop out at once; so do classes with fewer shared ones than their
   smallest possible partner needs, and what only they shared, in turn.  The class that shares
   most is a shingle's hub; all classes with a shingle of that hub form one group, so two that
   share any routed shingle meet in a group.
3. Each group is a set of points: shingles hashed into `Join.groups` groups, the group counts as
   coordinates.  A packed R-tree over them bounds the overlap of a query with a node by the
   summed minima of the query and the node's upper corner, and with a point by the summed
   minima of both.  In sets of many shingles a few coordinates say little, so pairs of such
   sets are bounded once more by count vectors of one to two shingles a coordinate.  Pairs that
   survive are verified on whole shingle sets.  Every pair comes out of a tree; groups of two
   have one as well.
4. Three rounds of queries keep the pairs, and so the shingle sets to move, few: first the hubs
   ask their trees, and each point is paired with its best hub; then each point asks for its
   best partner in every component it has no link to yet; then for all that is left.  Points
   that are already connected need no further proof.

Hot groups: a shingle whose sketch count is far above the mean is dealt to several tasks; a group
of more than `Join.block` points is cut into chunks with a tree each, in tasks of their own, and
only points that ask are sent to every chunk: the hub, then those not connected to it yet;
components are combined before they are shuffled.  The sketch and the
bit maps have at most 2 ** `map_bits_most` bits; a fuller one filters and orders less well, and
changes no result.

No pair of equal sets is ever made, no group is collected, and neither links nor keys go to
the driver; it sees the sketch and a bit map, both of bounded size.  Every intermediate table
is written to the shared folder, so a lost executor costs only its running tasks; tables that
nothing needs any more are deleted.

Null text and text without words have an empty set and link with nothing.  Fewer words than
a shingle form one shingle.  Repeated rows and ids each get a row.  Extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm import _bytes as B
from linkloom.llm._graph import components
from linkloom.llm._stage import discard, small_batches, staged

_MASK = (1 << 64) - 1
FULL = 65535  # a coordinate that says no more than `at least this`
FULL_FINE = 255  # the same in fine points


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80
    groups: int = 128  # coordinates of a point
    sketch_bits: int = 21
    met_bits: int = 24
    map_bits_most: int = 28
    slack: int = 50
    leaf: int = 8  # children of a node of the tree
    block: int = 512  # points of a tree
    hot: int = 50_000  # rows of a shingle in one task


def shingle_sets(texts: B.Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after another, and their offsets."""
    w = B.split(B.Texts(texts.lo, texts.hi, texts.buf, texts.offs))
    h = B.span_hashes(B.byte_codes(B.lower_ascii(texts.buf)), w.starts, w.ends)
    owner = w.text_of()
    g, at = B.shingle_hashes(h, owner, words)
    text_of = owner[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        extra = []
        for t in short:
            x = int(count[t])
            for v in h[w.first[t] : w.first[t + 1]].tolist():
                x = (x * 0xD6E8FEB86659FD93 + v + 1) & _MASK
            extra.append(x)
        g, text_of = np.append(g, B.mix(np.array(extra, np.uint64))), np.append(text_of, short)
        order = np.argsort(text_of, kind="stable")
        g, text_of = g[order], text_of[order]
    n = texts.hi - texts.lo
    first = np.searchsorted(text_of, np.arange(n + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text_of[1:] != text_of[:-1])
    return g[new], np.append(0, np.cumsum(new))[first]


def set_keys(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of two 64-bit words for each set; they sum different mixes of the same shingles."""
    n = np.diff(first).astype(np.uint64)
    out = np.empty((len(n), 2), np.uint64)
    for i, odd in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        pre = np.append(np.uint64(0), np.cumsum(B.mix(flat * np.uint64(odd) if i else flat), dtype=np.uint64))
        out[:, i] = B.mix(pre[first[1:]] - pre[first[:-1]] + n * np.uint64(odd))
    return out


def _binary(data: np.ndarray) -> pa.Array:
    """Rows of a 2-d array as binary values of one width."""
    data = np.ascontiguousarray(data)
    width = data.shape[1] * data.itemsize
    offs = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offs), pa.py_buffer(data)])


def _rows(column: pa.Array, kind, width: int) -> np.ndarray:
    """Binary values of one width as rows of a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, width), kind)
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    size = width * np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + n * size].view(kind).reshape(n, width)


def _scan(how: Join):
    """Rows (doc_id, text_hash, n, key, -, -) of (doc_id, text, text_hash), then the task's sketch as
    rows (-, -, -, -, block, counts)."""
    blocks, size = 64, (1 << how.sketch_bits) // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kind = np.zeros(blocks * size, np.uint32), pa.int64()
        met = np.zeros(1 << how.met_bits, bool)
        names = ["doc_id", "text_hash", "n", "key", "block", "counts"]
        for batch in batches:
            kind = batch.column(0).type
            for texts in B.slices(batch.column(1)):
                flat, first = shingle_sets(texts, how.words)
                # Only what this task has met before counts: shingles of one text are most of all
                # and would drown the others.
                cell = (flat >> np.uint64(64 - how.met_bits)).astype(np.int64)
                again = flat[met[cell]]
                met[cell] = True
                sketch += np.bincount((again >> np.uint64(64 - how.sketch_bits)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
                m = texts.hi - texts.lo
                yield pa.RecordBatch.from_arrays([batch.column(0)[texts.lo : texts.hi], batch.column(2)[texts.lo : texts.hi], pa.array(np.diff(first)), _binary(set_keys(flat, first)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if sketch.any():
            counts = np.minimum(sketch, 65535).astype(np.uint16).reshape(blocks, size)
            yield pa.RecordBatch.from_arrays([pa.nulls(blocks, kind), pa.nulls(blocks, pa.int64()), pa.nulls(blocks, pa.int64()), pa.nulls(blocks, pa.binary()), pa.array(np.arange(blocks), pa.int32()), _binary(counts)], names)

    return run


def _rarity(parts: DataFrame, how: Join) -> np.ndarray:
    """A byte of rarity class for every sketch cell; the driver gets 2 ** sketch_bits bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(counts.as_buffer(), np.uint16).astype(np.uint64)
                total[block] = total[block] + own if block in total else own
        for block, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(8 * np.log2(t + 1.0), 255).astype(np.uint8).tobytes()])], ["block", "counts"])

    found = parts.where("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary").collect()
    out = np.zeros((64, (1 << how.sketch_bits) // 64), np.uint8)
    for row in found:
        out[row.block] = np.frombuffer(row.counts, np.uint8)
    return out.ravel()


def _salts(rarity: np.ndarray, how: Join) -> np.ndarray:
    """For every sketch cell, over how many tasks (as a power of 2) a shingle's rows are dealt: one,
    unless its count is above `hot` and far above the mean, which collisions alone explain."""
    count = np.exp2(np.arange(256) / 8) - 1
    mean = count[rarity].mean() if len(rarity) else 0.0
    bits = np.ceil(np.log2(np.maximum(count / how.hot, 1))).astype(np.uint8)
    return np.where(count > 64 * mean, bits, 0).astype(np.uint8)[rarity]


def _prefixes(how: Join, rarity):
    """(token, salt, key, n) of the rarest shingles of each set, once per set and task; salt -1
    where a token goes to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cells, salts), seen = rarity.value, set()
        for batch in batches:
            for texts in B.slices(batch.column(0)):
                flat, first = shingle_sets(texts, how.words)
                keys, size = set_keys(flat, first), np.diff(first)
                cell = (flat >> np.uint64(64 - how.sketch_bits)).astype(np.int64)
                ordered = (cells[cell].astype(np.uint64) << np.uint64(56)) | (flat >> np.uint64(8))
                tokens, dealt, take, own = [], [], [], []
                for i, key in enumerate(map(bytes, keys)):
                    if size[i] and key not in seen:
                        seen.add(key)
                        n = int(size[i])
                        part = slice(first[i], first[i + 1])
                        best = np.argsort(ordered[part], kind="stable")[: n - -(-how.percent * n // 100) + 1 + n // how.slack]
                        tokens.append(ordered[part][best])
                        bits = salts[cell[part][best]].astype(np.uint64)
                        dealt.append(np.where(bits > 0, (keys[i, 0] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), -1))
                        take.append(len(best))
                        own.append(i)
                if own:
                    take = np.array(take)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(dealt).astype(np.int32)), _binary(np.repeat(keys[own], take, 0)), pa.array(np.repeat(size[own], take).astype(np.int32))], ["token", "salt", "key", "n"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, salt and key: each pair once, without tokens of a single key (but
    all of salted ones, whose other keys are elsewhere)."""
    held = None  # the last row, and whether it is known to be shared
    names = ["token", "key", "n"]
    for batch in batches:
        cols = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), _rows(batch.column(2), np.uint64, 2), np.asarray(batch.column(3))]
        known = False
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held[0], cols)]
            known = held[1]
        if not len(cols[0]):
            continue
        token = lambda a, b: (cols[0][a] == cols[0][b]) & (cols[1][a] == cols[1][b])  # noqa: B023, E731
        new = np.ones(len(cols[0]), bool)
        new[1:] = ~token(slice(1, None), slice(-1)) | (cols[2][1:] != cols[2][:-1]).any(1)
        cols = [c[new] for c in cols]
        same = token(slice(1, None), slice(-1))
        keep = cols[1] >= 0
        keep[0] |= known
        keep[1:] |= same
        keep[:-1] |= same
        held = ([c[-1:] for c in cols], bool(keep[-1]))
        keep[-1] = False
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][keep]), _binary(cols[2][keep]), pa.array(cols[3][keep])], names)
    if held is not None and held[1]:
        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), _binary(held[0][2]), pa.array(held[0][3])], names)


def _enough(shared: DataFrame, how: Join) -> DataFrame:
    """Rows of keys that share as many tokens as their smallest possible partner needs, with that
    number as `degree`.  A key has no more rows than its prefix."""
    least = F.expr(f"1 + ({how.percent} * n + 99) div 100 div {how.slack}")
    return shared.withColumn("degree", F.count("*").over(Window.partitionBy("key"))).where(F.col("degree") >= least)


def _met(shared: DataFrame) -> DataFrame:
    """Rows of tokens that still have two keys."""
    return shared.join(shared.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "token")


def _bit_map(keys: DataFrame, how: Join) -> np.ndarray:
    """A Bloom map of keys with one hash, of 16 to 32 bits a key up to 2 ** map_bits_most."""
    bits = min(how.map_bits_most, max(16, int(16 * keys.count()).bit_length()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((_rows(batch.column(0), np.uint64, 2)[:, 0] >> np.uint64(64 - bits)).astype(np.int64))], ["cell"])

    words = keys.select("key").mapInArrow(cells, "cell long").groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("bits"))
    out, found = np.zeros(1 << (bits - 6), np.int64), words.toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def fine_point(shingles: np.ndarray, how: Join) -> bytes | None:
    """Counts in `groups` * 2^k groups, k the least for two shingles a group on average at most;
    None where k is 0, as the point says the same."""
    groups = how.groups
    while 2 * groups < len(shingles):
        groups *= 2
    if groups == how.groups:
        return None
    return np.minimum(np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups), FULL_FINE).astype(np.uint8).tobytes()


def may_link(n: int, m: int, x: bytes, y: bytes, how: Join) -> bool:
    """Whether sets of n and m shingles may link by the summed minima of their fine points; the
    longer one is folded to the groups of the shorter one."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if u.max() == FULL_FINE or v.max() == FULL_FINE:
        return True
    groups = min(len(u), len(v))
    u, v = (w.reshape(-1, groups).sum(0, dtype=np.int64) for w in (u, v))
    return int(np.minimum(u, v).sum()) >= int(needed(n, m, how.percent))


def _finely(how: Join):
    """Pairs that may link by their fine points; who has none was bounded as well by its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            ok = np.ones(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                if x.is_valid and y.is_valid:
                    ok[i] = may_link(int(n[i]), int(m[i]), x.as_buffer(), y.as_buffer(), how)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    return run


def _points(how: Join, cells, whole: bool):
    """(key, n, point, fine point), or (key, shingles) if `whole`, of the sets whose key the bit
    map lets pass; once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = cells.value, set()
        shift = np.uint64(64 - (len(bits).bit_length() + 5))
        for batch in batches:
            for texts in B.slices(batch.column(0)):
                flat, first = shingle_sets(texts, how.words)
                keys = set_keys(flat, first)
                cell = keys[:, 0] >> shift
                passes = (bits[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1)
                own, size, out, fine = [], [], [], []
                for i in np.flatnonzero((passes > 0) & (np.diff(first) > 0)).tolist():
                    key = bytes(keys[i])
                    if key not in seen:
                        seen.add(key)
                        part = flat[first[i] : first[i + 1]]
                        point = part if whole else np.minimum(np.bincount((part % np.uint64(how.groups)).astype(np.int64), minlength=how.groups), FULL).astype(np.uint16)
                        own.append(i)
                        size.append(len(part))
                        out.append(point.tobytes())
                        fine.append(None if whole else fine_point(part, how))
                rest = [pa.array(out, pa.binary())] if whole else [pa.array(size, pa.int32()), pa.array(out, pa.binary()), pa.array(fine, pa.binary())]
                yield pa.RecordBatch.from_arrays([_binary(keys[own]), *rest], ["key", "shingles"] if whole else ["key", "n", "point", "fine"])

    return run


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of n and m elements that link."""
    return -(-(percent * (n + m)) // (100 + percent))


def _overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bound on the overlap of rows of count vectors: the summed minima of their coordinates."""
    least = np.minimum(x, y)
    bound = least.sum(1, dtype=np.int64)
    return bound + (least == FULL).any(1) * (1 << 40) if least.size and least.max() == FULL else bound


class CountForest:
    """Packed R-trees over count vectors, one for each group 0, 1, ..; `group` ascends.

    Points are packed by size, then by coarse counts, `leaf` to a node.  A node keeps the upper
    corner of its points and their least size; every tree has a root above its points."""

    def __init__(self, group: np.ndarray, points: np.ndarray, sizes: np.ndarray, how: Join):
        self.how, self.sizes = how, np.bincount(group)
        coarse = points.reshape(len(points), 8, -1).sum(2)
        self.order = np.lexsort((*coarse.T, sizes, group))
        upper, least, own = points[self.order], sizes[self.order], group
        self.levels, self.children = [(upper, least)], []
        while not self.children or len(own) > len(self.sizes):
            first = np.cumsum(np.bincount(own)) - np.bincount(own)
            cut = np.flatnonzero((np.arange(len(own)) - first[own]) % how.leaf == 0)
            self.children.append(np.append(cut, len(own)))
            upper, least, own = np.maximum.reduceat(upper, cut), np.minimum.reduceat(least, cut), own[cut]
            self.levels.append((upper, least))
        self.tested = self.passed = 0  # nodes

    def query(self, group: np.ndarray, points: np.ndarray, sizes: np.ndarray, step: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For queries with their groups: (query, point, bound) of all that may link, in parts."""
        cost = np.cumsum(self.sizes[group])
        for asked in np.split(np.arange(len(group)), np.flatnonzero(np.diff(cost // (1 << 20))) + 1):
            q, node = asked, group[asked]
            for i in range(len(self.levels) - 1, -1, -1):
                upper, least = self.levels[i]
                bound = np.empty(len(q), np.int64)
                for a in range(0, len(q), step):
                    bound[a : a + step] = _overlap(upper[node[a : a + step]], points[q[a : a + step]])
                ok = bound >= needed(least[node], sizes[q], self.how.percent)
                if i:
                    self.tested, self.passed = self.tested + len(ok), self.passed + int(ok.sum())
                    q, node = q[ok], node[ok]
                    begin, end = self.children[i - 1][node], self.children[i - 1][node + 1]
                    q = np.repeat(q, end - begin)
                    node = np.arange(len(q)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)
            yield q[ok], self.order[node[ok]], bound[ok]


def _by_group(emit, *group: str):
    """Calls emit(table, number of each row's group) for runs of whole groups of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            whole = whole if held is None else pa.concat_tables([held, whole])
            new = _starts(whole, group)
            end = int(new[-1])  # the last group may go on in the next batch
            if end:
                yield emit(whole.slice(0, end).combine_chunks())
            held = whole.slice(end)
        if held is not None and held.num_rows:
            yield emit(held.combine_chunks())

    return run


def _starts(table: pa.Table, group: tuple[str, ...]) -> np.ndarray:
    """First rows of the groups."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for x in (table.column(c).to_numpy() for c in group):
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _asked(table: pa.Table, how: Join) -> tuple[np.ndarray, np.ndarray, Iterator]:
    """Of rows sorted by (hub, chunk), those that ask query the tree of their chunk's other rows:
    nodes, sizes, and parts of (row that asks, row found, bound)."""
    node, sizes = table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.int64)
    points = _rows(table.column("point"), np.uint16, how.groups)
    first = _starts(table, ("hub", "chunk"))
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    held, asks = np.flatnonzero(~asks), np.flatnonzero(asks)
    there, group = np.unique(number[held], return_inverse=True)
    asks = asks[np.isin(number[asks], there)]

    def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if len(asks):
            forest = CountForest(group, points[held], sizes[held], how)
            for q, p, bound in forest.query(np.searchsorted(there, number[asks]), points[asks], sizes[asks]):
                yield asks[q], held[p], bound

    return node, sizes, found()


def _hub_pairs(how: Join):
    """(a, b, share): what each hub finds in the trees of its group, with the bound's share of both
    sizes."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        node, sizes, parts = _asked(table, how)
        none = np.zeros(0, np.int64)
        q, p, bound = (np.concatenate(c) for c in zip((none, none, none), *parts))
        return pa.RecordBatch.from_arrays([pa.array(node[q]), pa.array(node[p]), pa.array(bound / (sizes[q] + sizes[p]))], ["a", "b", "share"])

    return _by_group(emit, "hub", "chunk")


def _survivors(how: Join, best_only: bool):
    """Pairs (a, b) of different components that the trees let through; of each row that asks and
    other component in the chunk the best one if `best_only`."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        node, sizes, parts = _asked(table, how)
        component, out = table.column("component").to_numpy(), [np.zeros((0, 2), np.int64)]
        for q, p, bound in parts:
            some = component[q] != component[p]
            q, p, bound = q[some], p[some], bound[some]
            if best_only and len(q):
                order = np.lexsort((p, -bound / (sizes[q] + sizes[p]), component[p], q))
                q, p = q[order], p[order]
                first = np.append(True, (q[1:] != q[:-1]) | (component[p[1:]] != component[p[:-1]]))
                q, p = q[first], p[first]
            out.append(np.stack([node[q], node[p]], 1))
        both = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return _by_group(emit, "hub", "chunk")


def _verify(how: Join):
    """Pairs whose whole shingle sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                ok[i] = 100 * common >= how.percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_hash (xxhash64), n_shingles, class_key (equal sets),
    component (a name, null for empty sets) and component_id (its smallest doc_id).  All steps
    in Python are written here and now, with small Arrow batches; the result reads tables only."""
    with small_batches(docs.sparkSession):
        return _components(docs, how, id_col, text_col)


def _components(docs: DataFrame, how: Join, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    kind = source.schema["doc_id"].dataType.simpleString()
    scan = staged(source.mapInArrow(_scan(how), f"doc_id {kind}, text_hash long, n long, key binary, block int, counts binary"), "scan")
    rows = scan.where("block is null").select("doc_id", "text_hash", "n", "key")
    order = _rarity(scan, how)
    rarity = spark.sparkContext.broadcast((order, _salts(order, how)))
    text = source.select("text")
    tokens = text.mapInArrow(_prefixes(how, rarity), "token long, salt int, key binary, n int")
    met = staged(tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "key").mapInArrow(_shared, "token long, key binary, n int"), "shared")
    shared = staged(_met(_enough(met, how)).select("token", "key", "n"), "peeled")
    discard(met)
    rarity.unpersist()
    cells = spark.sparkContext.broadcast(_bit_map(shared.select("key").distinct(), how))
    points = text.mapInArrow(_points(how, cells, False), "key binary, n int, point binary, fine binary").dropDuplicates(["key"])
    # Each class is a node with a number, which is fixed once the table is written.
    points = staged(points.select(F.monotonically_increasing_id().alias("node"), "key", "n", "point", "fine"), "points")
    cells.unpersist()
    held = staged(_enough(shared.join(points.select("key", "node"), "key"), how).select("token", "node", "degree"), "held")
    hub = held.groupBy("token").agg(F.max(F.struct("degree", "node")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    routed = staged(held.join(hub, "token").select(F.col("hub.node").alias("hub"), "node").distinct(), "routed")
    discard(shared, held)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that link, as a table.  Only sets of nodes in pairs are made and moved."""
        asked = staged(pairs, "asked")
        long = points.where("fine is not null")
        a = long.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("fine").alias("x"))
        b = long.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("fine").alias("y"))
        pairs = asked.join(a, "a", "left").join(b, "b", "left").select("a", "b", "n", "m", "x", "y")
        pairs = staged(pairs.mapInArrow(_finely(how), "a long, b long"), "pairs")
        discard(asked)
        if pairs.isEmpty():
            return pairs
        wanted = staged(points.select("node", "key").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "wanted")
        there = spark.sparkContext.broadcast(_bit_map(wanted, how))
        own = text.mapInArrow(_points(how, there, True), "key binary, shingles binary").join(wanted, "key")
        own = staged(own.dropDuplicates(["node"]).select("node", "shingles"), "sets")
        a = own.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        b = own.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        links = staged(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_verify(how), "a long, b long"), "links")
        discard(own, wanted, pairs)
        there.unpersist()
        return links

    def dealt(members: DataFrame, asks, how_many) -> DataFrame:
        """Members of each group in chunks of about a block, and those that ask once more in every chunk."""
        chunk = F.pmod(F.xxhash64("node"), how_many).cast("int")
        own = F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("asks")))
        every = F.transform(F.sequence(F.lit(0), how_many - 1), lambda c: F.struct(c.alias("chunk"), F.lit(True).alias("asks")))
        rows = members.withColumn("at", F.explode(F.when(asks, F.concat(own, every)).otherwise(own))).select("hub", "at.*", *(c for c in members.columns if c in ("node", "component")))
        return rows.join(points.drop("key", "fine"), "node").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "node")

    blocks = lambda m: F.ceil(F.col(m) / how.block).cast("int")
    # Round 1: hubs ask.
    large = staged(routed.groupBy("hub").agg(F.count("*").alias("m")).where(F.col("m") > how.block).select("hub", blocks("m").alias("chunks")), "large")
    asked = dealt(routed.join(large, "hub", "left"), F.col("hub") == F.col("node"), F.coalesce("chunks", F.lit(1)))
    asked = asked.select("hub", "chunk", "asks", "node", "n", "point").mapInArrow(_hub_pairs(how), "a long, b long, share double").where("a <> b")
    best = asked.groupBy("b").agg(F.max(F.struct("share", "a")).alias("best")).select(F.least("b", "best.a").alias("a"), F.greatest("b", "best.a").alias("b")).distinct()
    links = verified(best)
    found = components(links)
    # Rounds 2 and 3: what the trees let through between components.  Who is connected to the hub
    # has no need to ask: the others ask for it.
    for best_only in (True, False):
        members = routed.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = members.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.when(F.col("hub") == F.col("node"), F.col("component"))).alias("common"), F.count("*").alias("m"))
        split = staged(split.where("lo <> hi").select("hub", "common", blocks("m").alias("chunks")), "split")
        if split.isEmpty():
            break
        cut = dealt(members.join(split, "hub"), F.col("component") != F.col("common"), F.col("chunks"))
        cut = cut.select("hub", "chunk", "asks", "node", "component", "n", "point").mapInArrow(_survivors(how, best_only), "a long, b long")
        more = verified(cut.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not more.isEmpty():
            links = links.union(more)
            found = components(links)
    label = staged(found.join(points.select("node", "key"), "node").select("key", "component"), "labels")
    discard(routed, points)
    joined = staged(rows.join(label, "key", "left"), "labelled")
    # Written before the join, so that a hot component is split there, or the minima broadcast.
    # A class without links is a component of its own, named by its key.
    group = [F.col("component"), F.when(F.col("component").isNull(), F.col("key")).alias("alone")]
    least = joined.where("n > 0").groupBy(*group).agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).where("m > 1")
    linked = staged(least.where("component is not null").select("component", "least"), "least")
    alone = staged(least.where("component is null").select(F.col("alone").alias("key"), F.col("least").alias("least_alone")), "least_alone")
    discard(scan)
    found = joined.join(linked, "component", "left").join(alone, "key", "left")
    some = F.col("n") > 0
    group = F.when(some, F.coalesce(F.col("component").cast("string"), F.hex("key")))
    return found.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(some, F.col("key")).alias("class_key"), group.alias("component"), F.when(some, F.coalesce(F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("least_alone")), "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_count_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
