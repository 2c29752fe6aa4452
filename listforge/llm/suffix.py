"""Suffix-array dedup: remove bytes whose 50-byte string an earlier document has.

The longest previous factor of a position is the longest string starting there
that also starts at an earlier position. In suffix order it is the longer of
the common prefixes with the nearest entries on either side that come from an
earlier position (previous and next smaller values of position in suffix
order). Here positions count as their documents: the array says how long a
string each position shares with an earlier document, and where it reaches
``length`` the bytes go. Common prefixes are followed up to ``length`` bytes,
smaller values as long as the prefix reaches it; what is shorter removes
nothing.

Suffix arrays are built bucket by bucket over the segments that hold a
recurring anchor (see ``recurrence``), in pieces of bounded size that never
split an anchor's windows; windows of different anchors cannot be equal.

Edge cases: a null or empty text has no bytes and nothing to remove; texts
below ``length`` bytes stay whole; matches never cross documents; a null doc_id
counts as later than all others; rows that share a doc_id don't remove one
another's bytes. Empty tables give no rows. Other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from listforge.llm.recurrence import NULL_ID, Block, Plan, ragged, remove_recurring

LENGTH, GRAM = 50, 20
PIECE = 1 << 20


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts by their first ``length`` bytes, and the bytes that each shares with the one before, ``length`` at most.

    Eight bytes are compared at a time; only suffixes that are still tied go on.
    """
    padded = np.concatenate([data, np.zeros(length + 16, np.uint8)])
    words = np.ndarray((len(padded) - 8,), dtype=">u8", buffer=padded, strides=(1,))
    order, common = np.arange(len(starts)), np.full(len(starts), length, np.int32)
    common[:1] = 0
    tied, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for j in range(0, length, 8):
        key = words[starts[order[tied]] + j].astype(np.uint64)
        if length - j < 8:
            key &= np.uint64((2**64 - 1) ^ ((1 << 8 * (8 - length + j)) - 1))
        turn = np.lexsort((key, group)) if j else np.argsort(key, kind="stable")
        order[tied], key = order[tied[turn]], key[turn]
        differ = key[1:] ^ key[:-1]
        inside = group[1:] == group[:-1]  # of one group: turn leaves groups where they are
        parts = np.flatnonzero(inside & (differ != 0)) + 1
        common[tied[parts]] = j + 8 - np.searchsorted(_BYTES, differ[parts - 1], side="right")
        heads = np.ones(len(tied) + 1, bool)
        heads[1:-1] = ~inside | (differ != 0)
        group, still = np.cumsum(heads[:-1]), ~(heads[:-1] & heads[1:])
        tied, group = tied[still], group[still]
        if not len(tied):
            break
    return order, common


_BYTES = np.array([1 << 8 * i for i in range(8)], np.uint64)


def smaller(values: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each entry's previous smaller value and what it has in common with that, 0 where there is none.

    Every entry looks at the one before and, while that is not smaller, jumps
    to where that one points. Entries that have fallen below ``least`` stop.
    """
    at, shared = np.arange(len(values)) - 1, common.copy()
    going = np.flatnonzero((at >= 0) & (shared >= least))
    while len(going):
        going = going[values[at[going]] >= values[going]]
        over = at[going]
        shared[going] = np.minimum(shared[going], shared[over])
        at[going] = at[over]
        going = going[(at[going] >= 0) & (shared[going] >= least)]
    found = (at >= 0) & (values[at] < values)
    return at, np.where(found, shared, 0)


def previous_factors(values: np.ndarray, common: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For entries in suffix order: length of the longest factor that an entry of smaller value has too (exact from ``least`` on), and that value, or the own one."""
    before, left = smaller(values, common, least)
    after, right = smaller(values[::-1], np.append(common[1:], 0)[::-1].astype(common.dtype), least)
    after, right = len(values) - 1 - after[::-1], right[::-1]
    factor = np.maximum(left, right)
    after[after >= len(values)] = 0
    owner = np.where(factor == 0, values, np.where(left >= right, values[before], values[after]))
    return factor, owner


def resolve(texts: list[bytes], ids: np.ndarray, anchors: np.ndarray, length: int) -> list[np.ndarray]:
    """First document of each window of each segment."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    order = np.argsort(anchors, kind="stable")
    ends = np.flatnonzero(np.append(anchors[order][1:] != anchors[order][:-1], True)) + 1
    begin = 0
    held = 0
    last = 0
    for end in ends:
        held += sum(len(texts[i]) - length + 1 for i in order[last:end])
        last = end
        if held >= PIECE or end == len(order):
            _piece(texts, ids, order[begin:end], length, out)
            begin, held = end, 0
    return out


def _piece(texts: list[bytes], ids: np.ndarray, rows: np.ndarray, length: int, out: list[np.ndarray]) -> None:
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(texts[i], len(number)) for i in rows])
    least = np.full(len(number), NULL_ID)
    np.minimum.at(least, which, ids[rows])
    sizes = np.array([len(x) for x in number], np.int64)
    windows = sizes - length + 1
    starts, begins = ragged(np.concatenate([[0], np.cumsum(sizes)[:-1]]), windows)
    order, common = suffix_order(np.frombuffer(b"".join(number), np.uint8), starts, length)
    docs = np.repeat(least, windows)
    factor, owner = previous_factors(docs[order], common, length)
    first = docs.copy()
    first[order[factor >= length]] = owner[factor >= length]
    for i, w in zip(rows, which):
        out[i] = first[begins[w] : begins[w] + windows[w]]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _emit(b: Block, covered: np.ndarray) -> list[pa.Array]:
    sums = np.concatenate([[0], np.cumsum(covered)])
    heads = covered.copy()
    heads[1:] &= ~covered[:-1]
    begun = b.first[b.first < len(covered)]
    heads[begun] = covered[begun]
    spans = np.concatenate([[0], np.cumsum(heads)])
    kept = [b.raw[a:z][~covered[a:z]].tobytes() for a, z in zip(b.first, b.last)]
    ids = pa.array(b.ids, pa.int64(), mask=b.ids == NULL_ID)
    return [ids, pa.array(b.last - b.first), pa.array(sums[b.last] - sums[b.first]), pa.array(spans[b.last] - spans[b.first]), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) and their SHA-256 of every row of docs."""
    return remove_recurring(docs, Plan(length, gram, False, resolve), _emit, SCHEMA)
