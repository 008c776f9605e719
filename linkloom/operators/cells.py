"""Cosine top-k inside cells of records and entities, in numpy.

Token sets move in packs: a pack holds the sets that one task has for one block of a country and view, as a
dictionary of their tokens and, set by set, differences of sorted codes, compressed.  Nothing is left out.
A cell's packs come in this order: the vocabulary with document frequencies, a block of entities, the ids of a
block of records, and the records.  Entities become posting lists in memory, but for words that many of them have:
those are a bit each.  Records stream past, so a cell is bounded by its entities and the vocabulary.  Pairs exist only
as arrays of sums of some records at a time.  Common words are added up by matrix products in single precision, whose
error is bounded; all entities that may be among the k best by it are then summed in double precision.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEP = "\0"  # between the tokens of a set
PLACES = 6  # scores are rounded before they rank, so that summation order cannot matter
VOCABULARY, ENTITIES, IDS, RECORDS = range(4)  # kinds of packs
COLUMNS = "country string, view string, kind int, block int, xs int, ys int, n bigint, id string, tokens string, df array<bigint>"
PACKED = "country string, view string, kind int, block int, xs int, ys int, n bigint, pack binary"
FOUND = "country string, view string, record_id string, entity_id string, score double"
_KEY = ["country", "view", "x", "y"]
_OWN = ["country", "view", "kind", "block", "xs", "ys", "n"]
_PACK, _HELD, _CODES, _CHUNK = 1 << 23, 1 << 25, 1 << 21, 256
_COMMON, _FEW = 16, 64  # words of more than a 16th of the entities, and of more than 64, are bits; either way sums are the same
_SUMS, _DENSE = 1 << 24, 1 << 22  # sums held at once, and cells of a dense block of common words
_ZSTD = pa.Codec("zstd", compression_level=3)


# Packs --------------------------------------------------------------------------------------


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs (PACKED) of about _PACK bytes of tokens at most, from rows (COLUMNS) in any order."""
    held: dict[tuple, list[pa.RecordBatch]] = {}
    size: Counter = Counter()
    for batch in batches:
        for own, part in _parts(batch):
            held.setdefault(own, []).append(part)
            size[own] += len(part) + (pc.sum(pc.binary_length(part.column("tokens"))).as_py() or 0)
            if size[own] > _PACK:
                yield from _sent(own, held.pop(own))
                del size[own]
        while sum(size.values()) > _HELD:
            own = max(size, key=size.get)
            yield from _sent(own, held.pop(own))
            del size[own]
    for own, parts in held.items():
        yield from _sent(own, parts)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batch by pack, cut at about _PACK bytes of tokens."""
    if not batch.num_rows:
        return
    code = np.zeros(batch.num_rows, np.int64)
    for c in ("country", "view", "kind", "block"):
        each = batch.column(c).dictionary_encode(null_encoding="encode")
        code = code * len(each.dictionary) + each.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    batch, code = batch.take(pa.array(order)), code[order]
    bytes_ = np.cumsum(pc.fill_null(pc.binary_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(bytes_ // _PACK) != 0)) + 1).tolist(), len(code)]
    for lo, hi in zip(edges, edges[1:]):
        part = batch.slice(lo, hi - lo)
        yield tuple(part.column(c)[0].as_py() for c in _OWN), part


def _sent(own: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, whole = own[2], pa.Table.from_batches(parts).combine_chunks()
    ids, tokens = (pa.concat_arrays(whole.column(c).chunks) for c in ("id", "tokens"))
    sets = pc.split_pattern(pc.fill_null(tokens, ""), SEP)
    if kind == VOCABULARY:
        df = pc.list_flatten(pa.concat_arrays(whole.column("df").chunks)).to_numpy()
        words = pc.list_flatten(sets)
        order = pc.sort_indices(words)
        packs = [(kind, [*_strings(words.take(order)), _planes(df[order.to_numpy()], 8)])]
    else:
        packs = [(kind, [*_strings(ids), *_sets(sets)])] + [(IDS, _strings(ids))] * (kind == RECORDS)
    for kind, sections in packs:
        row = [*own[:2], kind, *own[3:], _pressed(sections)]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES)], [*_OWN, "pack"])


_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _sets(sets: pa.ListArray) -> list[bytes]:
    """Sections of token sets: their dictionary, frequent tokens first and alike ones together; their sizes; and
    of each set's sorted codes the first and the differences."""
    coded, sizes = pc.list_flatten(sets).dictionary_encode(), pc.list_value_length(sets).to_numpy()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    alphabetic = np.empty(len(words), np.int64)
    alphabetic[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    often = np.floor(np.log2(np.maximum(np.bincount(codes, minlength=len(words)), 1)))
    order = np.lexsort((alphabetic, -often))
    new = np.empty(len(words), np.int64)
    new[order] = np.arange(len(words))
    keys = np.sort((np.repeat(np.arange(len(sizes)), sizes) << 32) | new[codes]) & ((1 << 32) - 1)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps = np.diff(keys, prepend=0)
    steps[first] = keys[first]
    return [*_strings(words.take(pa.array(order))), _planes(sizes, 4), _planes(steps, 4)]


def _unset(sections: list[bytes]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(dictionary, codes, ends) of `_sets`."""
    sizes, steps = (_numbers(x, 4) for x in sections[3:])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total = np.cumsum(steps)
    before = np.concatenate([[0], total])[ends[:-1]]
    return _array(sections[:3]), total - np.repeat(before, sizes), ends


def _strings(x: pa.StringArray) -> list[bytes]:
    gone, x = pc.is_null(x).to_numpy(zero_copy_only=False), pc.fill_null(x, "")
    size = pc.binary_length(x).to_numpy(zero_copy_only=False)
    at = np.frombuffer(x.buffers()[1], np.int32)[x.offset] if len(x) else 0
    data = x.buffers()[2]
    return [_planes(size, 4), bytes(data[int(at) : int(at) + int(size.sum())]) if data else b"", gone.tobytes() if gone.any() else b""]


def _array(sections: list[bytes]) -> pa.StringArray:
    size = _numbers(sections[0], 4)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(sections[1]))
    return pc.if_else(pa.array(np.frombuffer(sections[2], bool)), pa.scalar(None, pa.string()), found) if sections[2] else found


def _planes(x: np.ndarray, width: int) -> bytes:
    """Whole numbers as their lowest bytes, then the next ones, and so on."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _numbers(x: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def _pressed(sections: list[bytes]) -> bytes:
    whole = np.array([len(sections), *map(len, sections)], "<i8").tobytes() + b"".join(sections)
    return len(whole).to_bytes(8, "little") + _ZSTD.compress(whole, asbytes=True)


def _sections(pressed: bytes) -> list[bytes]:
    whole = _ZSTD.decompress(pressed[8:], int.from_bytes(pressed[:8], "little"), asbytes=True)
    n = int.from_bytes(whole[:8], "little")
    ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(whole[8 : 8 * (n + 1)], "<i8"))])
    return [whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


# Search -------------------------------------------------------------------------------------


def search(batches: Iterator[pa.RecordBatch], k: int, floor: float) -> Iterator[pa.RecordBatch]:
    """The k best entities of each record and cell, from packs (country, view, x, y, kind, n, pack) sorted by cell and kind."""
    key, cell = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            own = tuple(batch.column(c)[i].as_py() for c in _KEY)
            if own != key:
                if cell is not None:
                    yield from cell.last()
                key, cell = own, _Cell(own[0], own[1], k, floor)
            yield from cell.take(batch.column("kind")[i].as_py(), batch.column("n")[i].as_py(), _sections(batch.column("pack")[i].as_py()))
    if cell is not None:
        yield from cell.last()


class _Cell:
    def __init__(self, country: str, view: str, k: int, floor: float):
        self.country, self.view, self.k, self.floor = country, view, k, floor
        self.words, self.df, self.n = [], [], 1
        self.vocab = self.final = None
        self.packs, self.n_codes = [], 0  # packs that wait, so that many are looked up in the vocabulary at once
        self.ids, self.keys, self.marks, self.entities = [], [], [], 0
        self.asked: list[tuple[str, np.ndarray]] = []  # records that wait for a matrix product
        self.rows: Counter = Counter()  # of each record id; records of several rows wait for the last one
        self.waiting: dict[str | None, list[np.ndarray]] = {}

    def take(self, kind: int, n: int, sections: list[bytes]) -> Iterator[pa.RecordBatch]:
        if kind == VOCABULARY:
            self.words.append(_array(sections[:3]))
            self.df.append(_numbers(sections[3], 8))
            self.n = n
        elif kind == IDS:
            self.rows.update(_array(sections).to_pylist())
        else:
            if kind == RECORDS and self.final is None:
                self._freeze()
            self.packs.append((_array(sections[:3]), *_unset(sections[3:])))
            self.n_codes += len(self.packs[-1][2])
            if self.n_codes >= _CODES:
                yield from self._emptied()

    def _emptied(self) -> Iterator[pa.RecordBatch]:
        """Looks the waiting packs' words up, and takes their sets in."""
        if self.vocab is None:
            self.vocab = pa.concat_arrays(self.words) if self.words else pa.array([], pa.string())
            df = np.concatenate(self.df) if self.df else np.zeros(0)
            self.idf = np.log(1 + self.n / df)
            self.common = np.flatnonzero(df > max(self.n / _COMMON, _FEW))
            self.column = np.full(len(df), -1)
            self.column[self.common] = np.arange(len(self.common))
            self.words, self.df = [], []
        packs, self.packs, self.n_codes = self.packs, [], 0
        if not packs:
            return
        found = pc.fill_null(pc.index_in(pa.concat_arrays([p[1] for p in packs]), value_set=self.vocab), -1).to_numpy()
        at = 0
        for ids, words, codes, ends in packs:
            own = found[at : at + len(words)][codes]
            at += len(words)
            if self.final is None:
                self._entities(ids, own, ends)
            else:
                yield from self._records(ids.to_pylist(), own, ends)

    def _entities(self, ids: pa.StringArray, codes: np.ndarray, ends: np.ndarray) -> None:
        known = codes >= 0
        codes, rows = codes[known].astype(np.int64), np.repeat(self.entities + np.arange(len(ids)), np.diff(ends))[known]
        column = self.column[codes]
        rare = column < 0
        self.keys.append((codes[rare] << 32) | rows[rare])
        self.marks.append((rows[~rare] << 32) | column[~rare])
        self.ids.append(ids)
        self.entities += len(ids)

    def _freeze(self) -> None:
        """Posting lists: `postings[starts[t]:starts[t + 1]]` are the entities of token t, numbered by id; rows of one id are one entity.
        Of a common token, `bits` has whether an entity holds it, and the list its further times."""
        for _ in self._emptied():
            pass
        keys, marks = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.keys, self.marks))
        coded = (pa.concat_arrays(self.ids) if self.ids else pa.array([], pa.string())).dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
        self.keys, self.marks, self.ids, self.entities, self.final = [], [], [], len(order), coded.dictionary.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        number = place[coded.indices.to_numpy()]
        low = keys & ((1 << 32) - 1)
        keys ^= low
        keys |= np.take(number, low, out=low, mode="clip")
        del low
        again = self._mark(marks, number)
        if len(again):
            keys = np.concatenate([keys, again])
        keys.sort()
        codes = (keys >> 32).astype(np.int32)
        keys &= (1 << 32) - 1
        self.postings = keys
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.idf)))])
        norm = np.sqrt(np.bincount(keys, self.idf[codes] ** 2, self.entities) + self.square)
        self.scale = np.divide(1.0, norm, out=np.zeros_like(norm), where=norm > 0)
        self.at_once = max(1, min(512, _SUMS // max(self.entities, 1)))

    def _mark(self, marks: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Takes (row, column) of common tokens in as bits; those that an entity has again are returned as (token, entity)."""
        marks = (number[marks >> 32] << 32) | (marks & ((1 << 32) - 1))
        marks.sort()
        first = np.diff(marks, prepend=-1) > 0
        again, marks = marks[~first], marks[first]
        n = len(self.common)
        self.bits, self.step = np.zeros((self.entities, (n + 7) // 8), np.uint8), max(64, _DENSE // max(n, 1))
        for lo in range(0, self.entities if n else 0, self.step):
            own = marks[slice(*np.searchsorted(marks, [lo << 32, (lo + self.step) << 32]))]
            dense = np.zeros((min(self.step, self.entities - lo), n), np.uint8)
            dense[(own >> 32) - lo, own & ((1 << 32) - 1)] = 1
            self.bits[lo : lo + self.step] = np.packbits(dense, axis=1)
        self.square = np.bincount(marks >> 32, self.idf[self.common[marks & ((1 << 32) - 1)]] ** 2, self.entities).astype(np.float64, copy=False)
        return (self.common[again & ((1 << 32) - 1)] << 32) | (again >> 32)

    def _records(self, ids: list[str], codes: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, name in enumerate(ids):
            own = codes[ends[i] : ends[i + 1]]
            own = own[own >= 0]
            if self.rows[name] > 1:
                self.waiting.setdefault(name, []).append(own)
                if len(self.waiting[name]) < self.rows[name]:
                    continue
                own = np.concatenate(self.waiting.pop(name))
            if len(own) and self.entities:
                self.asked.append((name, own))
                if len(self.asked) >= self.at_once:
                    yield from self._answered()

    def last(self) -> Iterator[pa.RecordBatch]:
        if self.final is not None:
            yield from self._emptied()
            yield from self._answered()

    def _answered(self) -> Iterator[pa.RecordBatch]:
        asked, self.asked = self.asked, []
        if not asked:
            return
        weights = []
        for _, codes in asked:
            weight = self.idf[codes]
            weights.append(weight * weight / np.sqrt(weight @ weight))
        n = len(self.common)
        if not n:
            yield from self._shown([x for (name, codes), w in zip(asked, weights) for x in self._best(name, codes, w)])
            return
        own = np.zeros((len(asked), n))  # weights of common tokens
        for i, ((_, codes), w) in enumerate(zip(asked, weights)):
            column = self.column[codes]
            own[i] = np.bincount(column[column >= 0], w[column >= 0], n)
        sums, single = np.empty((len(asked), self.entities), np.float32), own.astype(np.float32)
        for lo in range(0, self.entities, self.step):
            held = np.unpackbits(self.bits[lo : lo + self.step], axis=1, count=n).astype(np.float32)
            sums[:, lo : lo + self.step] = single @ held.T
        yield from self._shown([x for i, ((name, codes), w) in enumerate(zip(asked, weights)) for x in self._best(name, codes, w, own[i], sums[i])])

    def _best(self, name: str, codes: np.ndarray, weight: np.ndarray, own: np.ndarray | None = None, common: np.ndarray | None = None) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """(id, entities, scores) of a record, if it has any; `common` are its sums over the common tokens, of weights `own`, roughly."""
        first, each = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        first, each, weight = first[each > 0], each[each > 0], weight[each > 0]
        rare = np.zeros(self.entities)
        for lo in range(0, len(each), 512):  # bounds the memory of very long texts
            hi = lo + 512
            held = np.concatenate([self.postings[a : a + n] for a, n in zip(first[lo:hi].tolist(), each[lo:hi].tolist())])
            part = np.bincount(held, np.repeat(weight[lo:hi], each[lo:hi]), self.entities)
            rare = part if len(each) <= 512 else rare + part
        sums = rare * self.scale if common is None else (rare + common) * self.scale
        # The k-th best of the chunks' maxima is reached by k entities, so the k best are not below it but for the error of `common`.
        held = None if common is None else np.flatnonzero(own)
        error = 0.0 if common is None else (len(held) + 2) * 2.0**-23
        whole = self.entities // _CHUNK * _CHUNK
        most = sums[:whole].reshape(-1, _CHUNK).max(axis=1) if whole else sums[:0]
        least = np.partition(most, -self.k)[-self.k] * (1 - error) - 2 * 10**-PLACES if len(most) >= self.k else 0.0
        near = np.flatnonzero(sums >= least) if least > 0 else np.flatnonzero(sums)
        exact = sums[near] if common is None else (rare[near] + self._summed(near, held, own[held])) * self.scale[near]
        score = np.floor(exact * 10**PLACES + 0.5) / 10**PLACES
        if self.floor > 0:
            near, score = near[score > self.floor], score[score > self.floor]
        order = np.lexsort((near, -score))[: self.k]
        return [(name, near[order], score[order])] if len(order) else []

    def _summed(self, entities: np.ndarray, columns: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums of the weights of the columns that each entity has."""
        found = np.zeros(len(entities))
        for lo in range(0, len(entities), self.step):
            held = np.unpackbits(self.bits[entities[lo : lo + self.step]], axis=1, count=len(self.common))
            found[lo : lo + self.step] = held[:, columns] @ weight
        return found

    def _shown(self, done: list[tuple[str, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not done:
            return
        size = [len(x) for _, x, _ in done]
        names = pa.array([name for name, _, _ in done], pa.string()).take(pa.array(np.repeat(np.arange(len(done)), size)))
        held = self.final.take(pa.array(np.concatenate([x for _, x, _ in done])))
        score = pa.array(np.concatenate([s for _, _, s in done]))
        n = len(names)
        yield pa.RecordBatch.from_arrays([pa.array([self.country] * n, pa.string()), pa.array([self.view] * n, pa.string()), names, held, score], ["country", "view", "record_id", "entity_id", "score"])
