"""Agreement of a group's records by the n-grams and words of their texts, block by block, in numpy.

Different texts of two blocks are compared once, whatever the number of records that have them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from linkloom.functions import similarity as S

FOUND = "record_id string, n bigint, name_max double, name_sum double, addr_max double, addr_sum double, both_max double"
BLOCK, ROW = 1 << 21, 1 << 12  # characters of a block, and how many a record counts for besides its own
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def comparer(strings: bool, largest: int | None) -> Callable[[pa.Table], pa.Table]:
    """Of a cell's records (lo, hi, block, record_id, place, name, addr): for each record, over those of
    the other block (of the own block, the others), their number and the largest and summed similarities.
    Of two records one has a place up to `largest`, if given."""

    def compare(cell: pa.Table) -> pa.Table:
        lo, hi = cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py()
        block, place = cell.column("block").to_numpy(), cell.column("place").to_numpy()
        top = place <= (largest if largest is not None else place.max())
        number, each = {}, []
        for pair in zip(cell.column("name").to_pylist(), cell.column("addr").to_pylist()):
            each.append(number.setdefault(pair, len(number)))
        text, names, addrs = np.array(each), [p[0] for p in number], [p[1] for p in number]
        sides = [(block == lo, block == hi), (block == hi, block == lo)][: 1 + (lo != hi)]
        lows, highs = (np.unique(text[m]) for m in sides[0])
        sims = np.zeros((2, len(lows), len(highs)))
        sims[0], sims[1] = _jaccard(names, lows, highs), _jaccard(addrs, lows, highs)
        if strings:
            known: dict = {}
            for i, a in enumerate(lows):
                for j, b in enumerate(highs):
                    pair = (names[a], names[b])
                    if pair not in known:
                        known[pair] = S.token_set(*pair)
                    sims[0, i, j] = max(sims[0, i, j], known[pair])
        rows = [[] for _ in _NAMES]
        for own, others in sides:
            mine, theirs = (lows, highs) if own is sides[0][0] else (highs, lows)
            of = sims if own is sides[0][0] else sims.transpose(0, 2, 1)
            every, best = (np.bincount(np.searchsorted(theirs, text[others & m]), minlength=len(theirs)) for m in (True, top))
            done: dict = {}
            for r in np.flatnonzero(own):
                t, key = int(text[r]), (int(text[r]), bool(top[r]))
                if key not in done:
                    weight = (every if top[r] else best).copy()
                    if lo == hi and top[r]:
                        weight[np.searchsorted(theirs, t)] -= 1
                    some = weight > 0
                    name, addr = of[:, np.searchsorted(mine, t), :][:, some]
                    w = weight[some]
                    done[key] = (int(w.sum()), name.max(), float(name @ w), addr.max(), float(addr @ w), ((name + addr) / 2).max()) if len(w) else None
                if done[key]:
                    for c, x in zip(rows, (cell.column("record_id")[int(r)].as_py(), *done[key])):
                        c.append(x)
        types = [pa.string(), pa.int64(), *[pa.float64()] * 5]
        return pa.table([pa.array(c, t) for c, t in zip(rows, types)], names=_NAMES)

    return compare


def _jaccard(texts: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the distinct 3- and 4-grams of texts[left] and texts[right]; 0 where both have none."""
    different: dict[str, int] = {}
    at = np.array([different.setdefault(_SPACE.sub("", x), len(different)) for x in texts])
    left, right = at[left], at[right]
    codes, ends = _grams(list(different))
    size, found = np.diff(ends), np.zeros((len(left), len(right)))
    rights = np.unique(right)
    all_, starts = np.concatenate([codes[ends[b] : ends[b + 1]] for b in rights]), np.concatenate([[0], np.cumsum(size[rights])])
    mark = np.zeros(codes.max(initial=0) + 1, bool)
    for a in np.unique(left):
        own = codes[ends[a] : ends[a + 1]]
        mark[own] = True
        shared = np.concatenate([[0], np.cumsum(mark[all_])])[starts]
        mark[own] = False
        both = np.diff(shared)
        union = size[a] + size[rights] - both
        found[left == a] = np.divide(both, union, out=np.zeros(len(rights)), where=union > 0)[np.searchsorted(rights, right)]
    return found


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the distinct 3- and 4-grams of each text, numbered."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    if len(chars) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    two = np.unique((chars[:-1] << 21) | chars[1:], return_inverse=True)[1]
    three = np.unique((two[:-1] << 21) | chars[2:], return_inverse=True)[1]
    four = np.unique((three[:-1] << 21) | chars[3:], return_inverse=True)[1] + three.max() + 1 if len(chars) > 3 else np.zeros(0, np.int64)
    key = np.concatenate([(owner[:-2] << 32 | three)[owner[:-2] == owner[2:]], (owner[:-3] << 32 | four)[owner[:-3] == owner[3:]]])
    key = np.unique(key)
    return key & ((1 << 32) - 1), np.concatenate([[0], np.cumsum(np.bincount(key >> 32, minlength=len(texts)))])
