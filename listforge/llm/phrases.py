"""Repeated-phrase removal with sharded Aho-Corasick automata.

Passages that may recur are found by their anchors (see ``recurrence``) and
dealt to shards. A shard *confirms* those phrases of ``length`` words that two
documents or more have, word for word; *compiles* them into one automaton per
piece, whose letters are the piece's words; and *streams* every passage that
any document sent through it, which gives each occurrence of each phrase with
the first document that has it. Every whole text of every document is cut into
passages, so what a shard sees is all of the corpus that can hold its phrases.
A document then drops the words inside phrases that an earlier document has.

Pieces hold a bounded number of windows and never split an anchor's windows.

Edge cases: a null or blank text has no words; texts below ``length`` words
stay whole; a null doc_id counts as later than all others; rows that share a
doc_id don't remove one another's words. Empty tables give no rows. Other
columns are not carried.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from listforge.llm.recurrence import NULL_ID, Block, Plan, remove_recurring

LENGTH, GRAM = 13, 5
PIECE = 1 << 17
#: Code points without surrogates and zero.
LETTERS = 0x10FFFF - 0x800


def letter(i: int) -> str:
    return chr(i + 1 if i + 1 < 0xD800 else i + 1 + 0x800)


def confirm(passages: list[str], ids: list[int], size: int) -> dict[str, int]:
    """First document of each phrase that has two or more."""
    first: dict[str, int] = {}
    shared: dict[str, int] = {}
    for text, doc in zip(passages, ids):
        for i in range(0, len(text) - size + 1):
            phrase = text[i : i + size]
            own = first.setdefault(phrase, doc)
            if own != doc:
                first[phrase] = shared[phrase] = min(own, doc)
    return shared


def compile_automaton(phrases: dict[str, int]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase, doc in phrases.items():
        automaton.add_word(phrase, doc)
    automaton.make_automaton()
    return automaton


def resolve(texts: list[bytes], ids: np.ndarray, anchors: np.ndarray, length: int) -> list[np.ndarray]:
    """First document of each window of each passage; its sender's own where no second document has it."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    order = np.argsort(anchors, kind="stable")
    ends = np.flatnonzero(np.append(anchors[order][1:] != anchors[order][:-1], True)) + 1
    begin = last = held = 0
    for end in ends:
        held += sum(texts[i].count(b" ") - length + 2 for i in order[last:end])
        last = end
        if held >= PIECE or end == len(order):
            _piece(texts, ids, order[begin:end], length, out)
            begin, held = end, 0
    return out


def _piece(texts: list[bytes], ids: np.ndarray, rows: np.ndarray, length: int, out: list[np.ndarray]) -> None:
    number: dict[bytes, int] = {}
    which = [number.setdefault(texts[i], len(number)) for i in rows]
    least = np.full(len(number), NULL_ID)
    np.minimum.at(least, np.array(which), ids[rows])
    passages = [x.split(b" ") for x in number]
    words: dict[bytes, int] = {}
    for w in chain.from_iterable(passages):
        words.setdefault(w, len(words))
    wide = 1 if len(words) < LETTERS else 2
    half = 1 << 20
    letters = {w: letter(i) if wide == 1 else letter(i // half) + letter(i % half) for w, i in words.items()}
    spelled = ["".join(map(letters.__getitem__, p)) for p in passages]
    if wide == 1:
        shared = confirm(spelled, least.tolist(), length)
    else:
        shared = confirm_wide(spelled, least.tolist(), length * wide)
    firsts = [np.full(len(p) - length + 1, doc) for p, doc in zip(passages, least)]
    if shared:
        automaton = compile_automaton(shared)
        for text, first in zip(spelled, firsts):
            for end, doc in automaton.iter(text):
                at = end + 1 - length * wide
                if at % wide == 0:
                    first[at // wide] = doc
    for i, w in zip(rows, which):
        out[i] = firsts[w]


def confirm_wide(passages: list[str], ids: list[int], size: int) -> dict[str, int]:
    """As confirm, for words of two letters."""
    first: dict[str, int] = {}
    shared: dict[str, int] = {}
    for text, doc in zip(passages, ids):
        for i in range(0, len(text) - size + 1, 2):
            own = first.setdefault(text[i : i + size], doc)
            if own != doc:
                first[text[i : i + size]] = shared[text[i : i + size]] = min(own, doc)
    return shared


SCHEMA = "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string"


def _emit(b: Block, covered: np.ndarray) -> list[pa.Array]:
    sums = np.concatenate([[0], np.cumsum(covered)])
    kept = []
    for a, z, x, y in zip(b.first, b.last, b.text_at, b.text_at[1:]):
        words = b.raw[x:y].tobytes().split()
        if sums[z] > sums[a]:
            words = [words[i] for i in np.flatnonzero(~covered[a:z])]
        kept.append(b" ".join(words))
    ids = pa.array(b.ids, pa.int64(), mask=b.ids == NULL_ID)
    return [ids, pa.array(b.last - b.first), pa.array(sums[b.last] - sums[b.first]), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]


def remove_phrases(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) and its SHA-256 of every row of docs."""
    return remove_recurring(docs, Plan(length, gram, True, resolve), _emit, SCHEMA)
