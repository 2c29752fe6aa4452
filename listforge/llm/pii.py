"""PII surrogates: keyed, type-consistent, distinct and coreferent replacements.

A detected entity is read as a shape (its punctuation and, for every letter or
digit, an alphabet) and a number within that shape. A keyed permutation of the
shape's numbers gives the surrogate: digits stay digits, letters of any script
keep case and script (accented letters are exchanged among themselves), octets stay octets, valid card numbers stay valid, given names known
by gender map to names of that gender. The permutation f = P^-1(P(x) + 1), P a
Feistel cipher, runs through all numbers in one cycle. So no entity stays as
it is, equal entities get equal surrogates in every document, different ones
different surrogates, and forbidden numbers are stepped over without breaking
either. Case and a phone number's punctuation are not part of the number, so
other spellings of an entity get the same surrogate in their own spelling.

``collisions`` checks this over all documents: it groups the distinct entities
by surrogate. ``replace`` refuses to return when a surrogate stands for two.

Edge cases: a null text stays null; texts without entities are unchanged, and
whole long texts are searched. Repeated rows get the same surrogates. Lengths
in characters are unchanged. All columns are carried. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from ipaddress import IPv6Address
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from listforge.llm._common import durable, small_batches, trimmed
from listforge.llm.recurrence import pack_batch, unpack

KEY = b"public test key: set your own"
ROUNDS = 6

#: Given names by gender: what is in a list maps within the list.
FEMALE = ("Mary", "Anna", "Laura", "Emma", "Julia", "Maria", "Sophie", "Claire", "Marie", "Elena", "Lucia", "Carmen", "Ingrid", "Heike", "Petra", "Susan", "Linda", "Karen", "Alice", "Nadia")
MALE = ("John", "Peter", "Paul", "James", "Robert", "Michael", "David", "Thomas", "Hans", "Klaus", "Jean", "Pierre", "Luis", "Carlos", "Jose", "Juan", "Frank", "Mark", "Simon", "Victor")
#: The alphabets, in upper case, of ASCII digits and of Latin, Cyrillic and Greek letters; those of all other letters and digits follow from their classes in Unicode.
ALPHABETS = tuple("".join(map(chr, range(ord(a), ord(z) + 1))) for a, z in ("09", "AZ", "АЯ", "ΑΡ", "ΣΩ"))
_FIXED = frozenset("".join(ALPHABETS))

_TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sra|Sr|Don|Doña)\b\.?[  ]"
_NAME = r"[^\W\d_]+(?:-[^\W\d_]+)?"
_GIVEN = rf"(?:{'|'.join(FEMALE + MALE)})"
#: Groups of the pattern that are another kind's second form.
KINDS = {"given_name": "name", "solid_phone": "phone"}
PATTERN = re.compile(
    rf"""
    (?P<email>(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)
  | (?P<access_key>\bAKIA[0-9A-Z]{{16}}\b)
  | (?:\b(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s*[=:]\s*["']?)(?P<secret>[^\s"',;]{{8,}})
  | (?P<iban>\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{3,7}}(?:[ ]?[A-Z0-9]{{1,3}})?\b)
  | (?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f]{{0,4}}:[0-9A-Fa-f]{{0,4}}:)[0-9A-Fa-f:]{{1,38}}(?:[0-9A-Fa-f]|::)(?!\w|:[\w:]|\.\d))
  | (?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\d]|\.\d))
  | (?P<card>(?<![\d.-])\d(?:[ -]?\d){{12,18}}(?![\d-]))
  | (?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))
  | (?P<solid_phone>(?<![\w.+])\+[1-9]\d{{6,14}}(?!\w|[.,-]\d)|(?<![\w.,+-])(?:1?[2-9]\d\d[2-9]\d{{6}}|0\d{{9,10}})(?!\w|[.,-]\d))
  | (?P<phone>(?<![\w.])(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)[ .-]?)?\d{{2,4}}[ .-]\d{{2,4}}(?:[ .-]\d{{2,4}}){{0,3}}(?![\w]))
  | (?P<given_name>(?<![\w'-]){_GIVEN}[ ](?=[A-ZÀ-Þ]){_NAME})
  | (?:\b{_TITLES})(?P<name>(?-i:[^\W\d_a-zà-ÿ]){_NAME}(?:[ ](?=[A-ZÀ-Þ]){_NAME})?)
    """,
    re.VERBOSE,
)
_WORTH = re.compile(rf"[@\d]|\b{_TITLES}|AKIA|::|[0-9A-Fa-f]:[0-9A-Fa-f]|\b{_GIVEN}[ ]|(?i:password|passwd|pwd|secret|token|api[_-]?key)")


class Permutation:
    """Keyed one-cycle permutations of 0 to m - 1, one for each label."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, label: bytes, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|" % (i, x) + label, key=self.key, digest_size=32).digest(), "little")

    def _p(self, label: bytes, m: int, x: int, back: bool) -> int:
        a = isqrt(m - 1) + 1
        b = -(-m // a)
        while True:
            left, right = divmod(x, b)
            for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                step = self._f(label, i, right if i % 2 else left)
                step = -step if back else step
                if i % 2:
                    left = (left + step) % a
                else:
                    right = (right + step) % b
            x = left * b + right
            if x < m:  # cycle walking keeps it a permutation of the smaller range
                return x

    def next(self, label: bytes, m: int, x: int) -> int:
        return 0 if m < 2 else self._p(label, m, (self._p(label, m, x, False) + 1) % m, True)


def _class(c: str) -> tuple | None:
    """What c may be exchanged within: category and script of the letter or digit, its part of Unicode, and whether it has another case; None for other characters."""
    if unicodedata.category(c)[0] not in "LN" or c in _FIXED or c.upper() in _FIXED and c.upper().lower() == c:
        return None
    up, low = c.upper(), c.lower()
    cased = len(up) == len(low) == 1 and up != low and up.lower() == low and low.upper() == up and c in (up, low)
    of = up if cased else c
    return unicodedata.category(of), unicodedata.name(of, "?").split(" ")[0], ord(of) >> 12, cased


def _members(cls: tuple, codes: range) -> str:
    return "".join(c for c in map(chr, codes) if _class(c) == cls and not (cls[3] and c.upper() != c))


@cache
def _lone(cased: bool) -> str:
    """The letters and digits that are alone in their class."""
    found: dict[tuple, list[str]] = {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        cls = _class(c)
        if cls and cls[3] == cased and not (cased and c.upper() != c):
            found.setdefault(cls, []).append(c)
    return "".join(own[0] for own in found.values() if len(own) == 1)


@cache
def _alphabet(cls: tuple) -> str:
    """The characters of a class, upper case where there is case; classes of one character make up one alphabet."""
    own = _members(cls, range(cls[2] << 12, (cls[2] + 1) << 12))
    return own if len(own) > 1 else _lone(cls[3])


@cache
def _place(c: str) -> tuple[str, bool, int]:
    """c's alphabet, whether c is its lower case, and its place; what is no letter or digit is an alphabet of its own."""
    for letters in ALPHABETS:
        for lower in (False, True):
            at = (letters.lower() if lower else letters).find(c)
            if at >= 0:
                return letters, lower, at
    cls = _class(c)
    if not cls:
        return c, False, 0
    letters, lower = _alphabet(cls), cls[3] and c.upper() != c
    return letters, lower, letters.index(c.upper() if lower else c)


def spell(text: str) -> list[tuple[str, bool, int]]:
    """Each character as (alphabet, lower case, place)."""
    return [_place(c) for c in text]


def fold(text: str) -> str:
    """text without case, as far as case is no part of its number."""
    return text.lower() if text.isascii() else "".join(letters[at].lower() if lower or letters[at].lower().upper() == letters[at] and len(letters[at].lower()) == 1 else letters[at] for letters, lower, at in spell(text))


def permute_text(p: Permutation, kind: str, text: str, allowed: Callable[[str], bool] = lambda s: True) -> str:
    """text with every letter and digit moved within its alphabet; case is no part of the number."""
    chars = spell(text)
    label = (kind + "|" + "".join(letters[0] for letters, _, _ in chars)).encode()
    m, x = 1, 0
    for letters, _, at in chars:
        m, x = m * len(letters), x * len(letters) + at
    if m < 2:
        return text
    while True:
        x = p.next(label, m, x)
        y, out = x, []
        for letters, lower, _ in reversed(chars):
            y, at = divmod(y, len(letters))
            out.append(letters[at].lower() if lower else letters[at])
        got = "".join(reversed(out))
        if allowed(got):
            return got


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(p: Permutation, kind: str, text: str, skip: int, allowed: Callable[[str], bool] = lambda s: True) -> str:
    """Digits after the first skip permuted as one number, everything else left in place."""
    digits = [c for c in text if c.isdigit()]
    head, tail = digits[:skip], "".join(digits[skip:])
    new = iter(head + list(permute_text(p, kind, tail, lambda s: allowed("".join(head) + s))))
    return "".join(next(new) if c.isdigit() else c for c in text)


def surrogate(p: Permutation, kind: str, text: str) -> str:
    if kind == "ip":
        size = {1: (10, 0), 2: (90, 10), 3: (156, 100)}
        parts = text.split(".")
        m, x = 1, 0
        for o in parts:
            n, low = size[len(o)]
            m, x = m * n, x * n + int(o) - low
        x = p.next(("ip|" + "".join(str(len(o)) for o in parts)).encode(), m, x)
        out = []
        for o in reversed(parts):
            n, low = size[len(o)]
            x, at = divmod(x, n)
            out.append(str(at + low))
        return ".".join(reversed(out))
    if kind == "ipv6":
        old = [c for c in text if c != ":"]
        x = p.next(("ipv6|" + re.sub("[^:]", "x", text)).encode(), 16 ** len(old), int("".join(old), 16))
        new = f"{x:0{len(old)}x}"
        new = iter(new.upper() if any(c.isupper() for c in old) else new)
        return "".join(c if c == ":" else next(new) for c in text)
    if kind == "card":
        valid = luhn("".join(c for c in text if c.isdigit()))
        return _digits(p, f"card{valid}", text, 1, lambda s: luhn(s) == valid)
    if kind == "phone":
        digits = sum(c.isdigit() for c in text)
        return _digits(p, "phone", text, max(digits - 10, 0))
    if kind == "access_key":
        return text[:4] + permute_text(p, kind, text[4:])
    if kind == "iban":
        return text[:2] + permute_text(p, kind, text[2:])
    if kind == "email":
        local, _, host = text.partition("@")
        *labels, top = host.split(".")
        return permute_text(p, kind, local + "@" + ".".join(labels)) + "." + top
    if kind == "name":
        return " ".join(_name(p, w) for w in text.split(" "))
    if kind == "secret":
        if _HEX.fullmatch(text):
            m = 16 ** len(text)
            return f"{p.next(b'hex|%d' % len(text), m, int(text, 16)):0{len(text)}x}"
        return permute_text(p, kind, text, lambda s: not _HEX.fullmatch(s))
    return permute_text(p, kind, text)


_HEX = re.compile(r"[0-9a-f]{8,}")
_LISTS = {w: (i, names) for names in (FEMALE, MALE) for i, w in enumerate(names)}


def _name(p: Permutation, word: str) -> str:
    if word in _LISTS:
        i, names = _LISTS[word]
        return names[p.next(b"list|" + names[0].encode(), len(names), i)]
    return permute_text(p, "name", word, lambda s: s not in _LISTS)


def _is_ipv6(text: str) -> bool:
    try:
        return any(c != ":" for c in text) and IPv6Address(text) is not None
    except ValueError:
        return False


def entities(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of each entity, left to right."""
    if _WORTH.search(text):
        for m in PATTERN.finditer(text):
            group = m.lastgroup
            kind, (begin, end) = KINDS.get(group, group), m.span(group)
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in text[begin:end]) <= 15:
                continue
            if kind == "ipv6" and not _is_ipv6(text[begin:end]):
                continue
            # Without a letter or digit (password: ********) there is nothing private, and nothing to exchange.
            own = text[begin:end].rpartition(".")[0] if kind == "email" else text[begin:end]
            if kind not in ("email", "secret") or any(len(_place(c)[0]) > 1 for c in own):
                yield kind, begin, end


def replaced(p: Permutation, text: str, pairs: set[tuple[str, str, str]] | None = None) -> tuple[str, int]:
    """The text with surrogates, and how many; (kind, entity, surrogate), both in canonical spelling, go into pairs, if given."""
    out, done, n = [], 0, 0
    for kind, begin, end in entities(text):
        entity = text[begin:end]
        new = surrogate(p, kind, entity)
        if pairs is not None:
            pairs.add((kind, canonical(kind, entity), canonical(kind, new)))
        out += [text[done:begin], new]
        done, n = end, n + 1
    return ("".join([*out, text[done:]]), n) if n else (text, 0)


def mapping(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, entity (canonical spelling), surrogate of every distinct entity. This table undoes the replacement: it is secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        for batch in batches:
            found: set[tuple[str, str, str]] = set()
            for text in batch.column(0).to_pylist():
                replaced(p, text or "", found)
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, ["kind", "entity", "surrogate"])

    return docs.select("text").mapInArrow(run, "kind string, entity string, surrogate string").distinct()


def canonical(kind: str, text: str) -> str:
    if kind in ("phone", "card"):
        return "".join(c for c in text if c.isdigit())
    return text if kind in ("name", "secret", "access_key") else fold(text)


def collisions(pairs: DataFrame) -> DataFrame:
    """kind, surrogate that stand for two entities, or entities that stay or have two surrogates."""
    twice = pairs.groupBy("kind", "surrogate").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).filter("a <> b").select("kind", "surrogate")
    split = pairs.groupBy("kind", "entity").agg(F.min("surrogate").alias("surrogate"), F.max("surrogate").alias("b")).filter("surrogate <> b or surrogate = entity").select("kind", "surrogate")
    return twice.union(split)


def replace(docs: DataFrame, key: bytes = KEY, counted: bool = False) -> DataFrame:
    """docs with surrogates in ``text``; counted: and n_replaced, in the place of any column of that name.

    Texts are searched once: rows leave the search packed, with the pairs of
    entity and surrogate that it made, and are unpacked once those are checked.
    """
    docs = docs.drop("n_replaced") if counted else docs
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, *[StructField("n_replaced", LongType())] * counted])
    names = schema.names
    pair = pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "entity", "surrogate")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        for batch in batches:
            if not batch.num_rows:
                continue
            found: set[tuple[str, str, str]] = set()
            rows = [(None, 0) if t is None else replaced(p, t, found) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in rows], batch.schema.field(at).type)
            if counted:
                columns.append(pa.array([n for _, n in rows], pa.int64()))
            made = [dict(zip(("kind", "entity", "surrogate"), x)) for x in sorted(found)]
            payload = pack_batch(pa.RecordBatch.from_arrays(columns, names))
            yield pa.RecordBatch.from_arrays([pa.array([payload], pa.binary()), pa.array([made], pair)], ["payload", "pairs"])

    def rows_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                yield from unpack(payload.as_buffer()).to_batches()

    small_batches(docs.sparkSession)
    held = durable(docs.mapInArrow(trimmed(search), "payload binary, pairs array<struct<kind: string, entity: string, surrogate: string>>"))
    bad = collisions(durable(held.select(F.inline("pairs")).distinct())).take(3)
    if bad:
        raise ValueError(f"surrogates collide: {[(r['kind'], r['surrogate']) for r in bad]}")
    return held.select("payload").mapInArrow(trimmed(rows_again), schema)
