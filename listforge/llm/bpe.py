"""Byte-level BPE: Spark higher-order functions fold merges over distinct words.

Documents are cut into pre-tokens and packed into blocks: the block's distinct
words, and its documents as numbers into them. Words meet in buckets by hash,
where they are made distinct, and each is encoded by one expression: a fold
over an array of token numbers that starts from the word's bytes and joins, at
each step, the neighbours of lowest rank, looked up in a literal rank map. Ids
go back to the blocks, packed; documents are then put together, and decoded by
concatenating their ids' byte strings.

What moves is each block's vocabulary and, once, the blocks. A block's words
are packed in order of (bucket, word), so that packets need no word numbers:
a packet's ids come back in the order in which its words were sent. Blocks meet
within regions of about ``REGION`` blocks, so a word is encoded once a region
and a bucket's size is bounded whatever the input.

Words above ``LONG`` bytes, where a fold would take quadratic time, are encoded
by the same merges in a heap; tokens that merges do not lead to are looked up.

Edge cases: a null or empty text has no tokens. Texts of any length are read
whole; a block holds at least one document. Repeated rows, equal ids and null
ids are encoded row by row. Empty tables give no rows. Other columns are not
carried.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.llm._common import dealt, give_back, input_bytes, small_batches, trimmed
from listforge.llm.recurrence import BUCKET_BYTES, pack_table, ragged, unpack

#: Characters of text in a block, above which it is closed.
BLOCK_CHARS = 16 << 20
#: Blocks that meet one another, and the buckets their words meet in.
REGION, BUCKETS = 512, 64
LONG = 128
#: Words of a row that the fold works on.
CHUNK_WORDS = 1024
#: Longer texts are cut into words one at a time.
LONG_TEXT = 1 << 20
#: Words whose ids are put together at a time.
PART_WORDS = 1 << 18
#: Token numbers have so many bits at most; a pair of them and its rank share a long.
MOST_BITS = 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankMap:
    """Pairs of token numbers to the rank of their join, as literals in a plan.

    Two arrays hold a hash table without collisions: a pair's group displaces
    its slot. ``start`` has the number of each single byte, ``two`` the rank of
    each pair of bytes.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bits = (max(ranks.values(), default=0) + 1).bit_length()
        self.none = (1 << self.bits) - 1  # above all ranks: no such pair
        if self.bits > MOST_BITS:
            raise ValueError(f"a rank above {(1 << MOST_BITS) - 2}")
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        # Nearly full: the literal is in every plan and its descriptions.
        self.groups, self.slots = max(1, len(pairs) // 3) | 1, max(len(pairs) + 1, len(pairs) * 11 // 10) | 1
        while not self._place(pairs):
            self.groups, self.slots = self.groups + 2, self.slots + 2
        self.start = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.two = [ranks.get(bytes([a, b]), self.none) for a in range(256) for b in range(256)]
        self.unreached = frozenset(t for t, r in ranks.items() if len(t) > 1 and encode_long(t, ranks) != [r])

    def _place(self, pairs: dict[tuple[int, int], int]) -> bool:
        groups = defaultdict(list)
        for (a, b), rank in pairs.items():
            key = (a << self.bits) + b
            groups[key % self.groups].append((key, rank))
        self.entries, self.moves = [-1] * self.slots, [0] * self.groups
        free, rng = np.ones(self.slots, bool), np.random.default_rng(5)
        for g, own in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            at = np.array([key % self.slots for key, _ in own])
            if len(set(at.tolist())) < len(at):
                return False  # two pairs that no move parts
            for _ in range(10_000):
                move = int(rng.integers(self.slots))
                to = (at + move) % self.slots
                if free[to].all():
                    break
            else:
                return False
            free[to], self.moves[g] = False, move
            for i, (key, rank) in zip(to.tolist(), own):
                self.entries[i] = (key << self.bits) + rank
        return True

    def literal(self) -> Column:
        """struct(entries, moves, start, two): Catalyst folds it to one literal."""
        held = json.dumps({"entries": self.entries, "moves": self.moves, "start": self.start, "two": self.two}, separators=(",", ":"))
        return F.from_json(F.lit(held), "entries array<bigint>, moves array<int>, start array<int>, two array<int>")

    def rank(self, a: Column, b: Column, entries: Column, moves: Column) -> Column:
        """Rank of two neighbours' join, ``none`` if it has none."""
        key = F.shiftleft(a.cast("long"), self.bits) + b
        slot = ((key % self.slots + F.get(moves, (key % self.groups).cast("int"))) % self.slots).cast("int")
        return let(F.get(entries, slot), lambda e: F.when(F.shiftright(e, self.bits) == key, e.bitwiseAND((1 << self.bits) - 1).cast("int")).otherwise(self.none))

    def ids(self, words: Column) -> Column:
        """Ids of each of the words, which are arrays of their bytes' values."""
        def of(entries: Column, moves: Column, start: Column, two: Column) -> Column:
            return F.transform(words, lambda word: encoded(word, lambda a, b: self.rank(a, b, entries, moves), start, two, self.none))

        return let(self.literal(), lambda t: let(t["entries"], lambda e: let(t["moves"], lambda m: let(t["start"], lambda s: let(t["two"], lambda two: of(e, m, s, two))))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def encoded(word: Column, rank: Callable[[Column, Column], Column], start: Column, two: Column, no_rank: int) -> Column:
    """Ids of one word: merges of lowest rank first, as a fold.

    The state is (p, r): pieces, and the rank of each piece's join with the
    next. A step joins the leftmost pair of lowest rank and looks up the two
    pairs that this makes; without a pair to join it changes nothing. ``start``
    has each byte's number, ``two`` each pair of bytes' rank; a pair without a rank has no_rank.
    """
    none, n = F.slice(F.array(F.lit(0)), 1, 0), F.size(word)

    def step(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def joined(best: Column) -> Column:  # the rank of a join is its number
            def at(i: Column) -> Column:  # place of the pair, from 1
                pieces = F.filter(F.transform(p, lambda x, j: F.when(j == i - 1, best).otherwise(x)), lambda _, j: j != i)
                left, right = rank(F.get(p, i - 2), best), rank(best, F.get(p, i + 1))
                ranks = F.transform(F.filter(r, lambda _, j: j != i - 1), lambda x, j: F.when(j == i - 2, left).when(j == i - 1, right).otherwise(x))
                return F.struct(pieces.alias("p"), ranks.alias("r"))

            return F.when(best < no_rank, let(F.array_position(r, best).cast("int"), at)).otherwise(F.struct(p.alias("p"), none.alias("r")))

        return F.when(F.size(r) > 0, let(F.array_min(r), joined)).otherwise(state)

    pairs = F.transform(F.slice(word, F.lit(2), n), lambda b, i: F.get(two, F.get(word, i).cast("int") * 256 + b))
    begin = F.struct(F.transform(word, lambda b: F.get(start, b)).alias("p"), pairs.alias("r"))
    return F.aggregate(F.sequence(F.lit(1), n), begin, step, lambda state: state["p"])


def encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap, for words of any length."""
    ends, back, forth = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    alive = [True] * len(word)

    def offer(i: int) -> None:
        if i >= 0 and forth[i] < len(word):
            rank = ranks.get(word[i : ends[forth[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[forth[i]]))

    heap: list[tuple[int, int, int]] = []
    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = forth[i] if alive[i] else len(word)
        if j >= len(word) or ends[j] != end:
            continue  # one of the pair has been joined since
        alive[j], ends[i], forth[i] = False, end, forth[j]
        if forth[j] < len(word):
            back[forth[j]] = i
        offer(i)
        offer(back[i])
    return [ranks[word[i : ends[i]]] for i in range(len(word)) if alive[i]]


def one_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    return [ranks[word]] if word in ranks else encode_long(word, ranks)


def _planes(x: np.ndarray) -> bytes:
    """Integers as four planes of bytes, which pack better apart."""
    return b"".join(((x >> s) & 255).astype(np.uint8).tobytes() for s in (0, 8, 16, 24))


def _unplaned(buffer) -> np.ndarray:
    out = np.empty((len(buffer) // 4, 4), np.uint8)
    for s, plane in enumerate(np.frombuffer(buffer, np.uint8).reshape(4, -1)):
        out[:, s] = plane
    return out.view("<i4").ravel()


def by_count(often: np.ndarray) -> np.ndarray:
    """Places of a block's words, in the order of packing, from the most frequent on: word number k is at the k-th of them."""
    return np.argsort(-often, kind="stable")


def numbered() -> defaultdict[str, int]:
    """Each new key gets the next number."""
    return defaultdict(itertools.count().__next__)


def _packed_words(words: pa.Array) -> bytes:
    """Sorted words, each without the start that it shares with the one before."""
    raw, kept, shared, before = words.to_pylist(), [], [], b""
    for w in raw:
        n = 0
        for x, y in zip(before[:255], w):
            if x != y:
                break
            n += 1
        shared.append(n)
        kept.append(w[n:])
        before = w
    lengths = np.fromiter(map(len, kept), np.uint32, len(kept))
    t = pa.table({"shared": [bytes(shared)], "n": [_planes(lengths)], "rest": [b"".join(kept)]}, schema=pa.schema([(c, pa.large_binary()) for c in ("shared", "n", "rest")]))
    return pack_table(t)


def _unpacked_words(payload) -> list[bytes]:
    t = unpack(payload)
    shared, lengths, rest = t.column("shared")[0].as_py(), _unplaned(t.column("n")[0].as_buffer()).tolist(), t.column("rest")[0].as_py()
    out, before, at = [], b"", 0
    for s, n in zip(shared, lengths):
        before = before[:s] + rest[at : at + n]
        out.append(before)
        at += n
    return out


def blocks_of(docs: DataFrame, pattern: str, n_parts: int) -> DataFrame:
    """block, words (distinct, by bucket), payload (doc_ids, numbers into words), dealt by block and checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, base, made = regex.compile(pattern), TaskContext.get().partitionId() * 1_000_003, 0

        def cut(text: str) -> np.ndarray:
            words = cutter.findall(text) if len(text) < LONG_TEXT else (m[0] for m in cutter.finditer(text))
            return np.fromiter(map(seen.__getitem__, words), np.int32)

        def close() -> pa.RecordBatch:
            flat = np.concatenate(numbers)
            words = [w.encode() for w in seen]
            bucket = np.array([zlib.crc32(w) % BUCKETS for w in words], np.int32)
            t = pa.table({"bucket": pa.array(bucket), "word": pa.array(words, pa.binary())})
            order = pc.sort_indices(t, [("bucket", "ascending"), ("word", "ascending")])
            t, often = t.take(order), np.bincount(flat, minlength=len(seen))[order.to_numpy()]
            small = np.empty(len(seen), np.int32)  # frequent words get small numbers
            small[order.to_numpy()[by_count(often)]] = np.arange(len(seen), dtype=np.int32)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))])
            packed = pa.table({"words": [_packed_words(t.column("word").slice(cuts[i], cuts[i + 1] - cuts[i])) if cuts[i] < cuts[i + 1] else None for i in range(BUCKETS)]}, schema=pa.schema([("words", pa.binary())]))
            own = pa.table({"ids": [pack_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(x) for x in numbers], pa.int64())}))], "flat": [_planes(small[flat])], "often": [_planes(often)]}, schema=pa.schema([(c, pa.large_binary()) for c in ("ids", "flat", "often")]))
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([pack_table(packed)], pa.binary()), pa.array([pack_table(own)], pa.binary())], ["block", "words", "payload"])

        seen = numbered()
        ids, numbers, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc)
                numbers.append(cut(text))
                held += len(text)
                if held >= BLOCK_CHARS or len(seen) >= 1 << 21:
                    yield close()
                    seen, ids, numbers, held, made = numbered(), [], [], 0, made + 1
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return dealt(rows.mapInArrow(trimmed(run), "block long, words binary, payload binary"), n_parts, "block")


def met_words(blocks: DataFrame, parts: int, regions: int, unreached: frozenset[bytes]) -> DataFrame:
    """words (distinct, some CHUNK_WORDS of them, as bytes), long (those that the fold leaves), refs: packed (block, places in words) of where they stand."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = unpack(packed.as_buffer()).column("words").combine_chunks()
                own = np.flatnonzero(parts.is_valid().to_numpy(zero_copy_only=False)).astype(np.int32)
                key = (block % regions) * BUCKETS + own
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(own), pa.array(np.full(len(own), block)), parts.take(pa.array(own)).cast(pa.binary())], ["key", "bucket", "block", "packed"])

    def meet(t: pa.Table) -> pa.Table:
        blocks_, parts = t.column("block").to_numpy(), [pa.array(_unpacked_words(x.as_buffer()), pa.binary()) for x in t.column("packed")]
        sizes = [len(x) for x in parts]
        every = pa.concat_arrays(parts).dictionary_encode()
        order = pc.sort_indices(every.dictionary).to_numpy()
        words = every.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        place = np.split(rank[every.indices.to_numpy()], np.cumsum(sizes)[:-1])
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
        apart = np.diff(offsets) > LONG
        if unreached:
            apart |= pc.is_in(words, pa.array(sorted(unreached), pa.binary())).to_numpy(zero_copy_only=False)
        raw = pa.array(np.frombuffer(words.buffers()[2], np.uint8, int(offsets[-1])).astype(np.int16))
        rows = []
        for a in range(0, len(words), CHUNK_WORDS):
            z = min(a + CHUNK_WORDS, len(words))
            refs, own_blocks, at = [], [], []
            for block, own in zip(blocks_, place):
                i, j = np.searchsorted(own, (a, z))
                if i < j:
                    refs.append((own[i:j] - a).astype(np.uint16))
                    own_blocks.append(block)
                    at.append(i)
            held = pack_table(pa.table({"block": pa.array(own_blocks, pa.int64()), "at": pa.array(at, pa.int32()), "places": pa.array(refs, pa.list_(pa.uint16()))}))
            bytes_, ends, long = raw.slice(offsets[a], offsets[z] - offsets[a]), offsets[a : z + 1] - offsets[a], []
            if apart[a:z].any():  # such a word's first byte keeps its place
                long = [(int(k), words[a + int(k)].as_py().hex()) for k in np.flatnonzero(apart[a:z])]
                n = np.where(apart[a:z], 1, np.diff(ends))
                index, _ = ragged(ends[:-1].astype(np.int64), n)
                bytes_, ends = bytes_.take(pa.array(index)), np.concatenate([[0], np.cumsum(n)])
            rows.append((held, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), bytes_), json.dumps(long)))
        held, lists, long = zip(*rows)
        each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.concat_arrays(lists))
        bucket = t.column("bucket")[0].as_py()
        out = pa.table({"bucket": pa.array([bucket] * len(rows), pa.int32()), "refs": pa.array(held, pa.binary()), "words": each, "long": pa.array(long, pa.string())})
        give_back()
        return out

    sent = blocks.select("block", "words").mapInArrow(trimmed(deal), "key long, bucket int, block long, packed binary")
    # Packets are small next to the work in them: as many tasks as blocks have, which AQE does not draw together.
    return sent.repartition(parts, "key").groupBy("key").applyInArrow(meet, "bucket int, refs binary, words array<array<smallint>>, long string")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, packed) of every row of docs; decoded: and text, as decode() gives it.

    Decoding where the ids are put together saves a second Python worker a task, and the memory that it takes.
    """
    small_batches(docs.sparkSession)
    # The rank map is a literal of megabytes: plans are not to be printed with all of it.
    conf, name = docs.sparkSession.conf, "spark.sql.maxPlanStringLength"
    conf.set(name, str(min(int(conf.get(name).rstrip("b")), 1 << 18)))
    held = input_bytes(docs)
    parts = max(8, -(-held // BUCKET_BYTES))
    blocks = blocks_of(docs, pattern, parts)
    rank_map = RankMap(ranks)
    met = met_words(blocks, parts, max(1, held // (REGION * BLOCK_CHARS)), rank_map.unreached)
    coded = met.select("bucket", "refs", "long", rank_map.ids(F.col("words")).alias("ids"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, held, long, lists in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                lists = lists.values
                if long != "[]":
                    whole = {k: one_word(bytes.fromhex(w), ranks) for k, w in json.loads(long)}
                    lists = pa.array([whole.get(k, x) for k, x in enumerate(lists.to_pylist())], pa.list_(pa.int32()))
                length, flat = pc.list_value_length(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
                start = np.concatenate([[0], np.cumsum(length)])[:-1]
                t = unpack(held.as_buffer())
                places = [x.values.to_numpy() for x in t.column("places")]
                packed = []
                for own in places:
                    n = length[own]
                    index, _ = ragged(start[own], n)
                    packed.append(pack_table(pa.table({"n": [n.astype(np.uint32).tobytes()], "ids": [_planes(flat[index])]})))
                yield pa.RecordBatch.from_arrays([t.column("block").combine_chunks(), pa.array([bucket] * len(t), pa.int32()), t.column("at").combine_chunks(), pa.array(packed, pa.binary())], ["block", "bucket", "at", "packed"])

    # Checkpointed: the fold is the dearest step, and the literal stays out of all later plans.
    coded = dealt(coded.mapInArrow(trimmed(back), "block long, bucket int, at int, packed binary"), parts, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "at", "packed"))).alias("coded"))

    by_rank = pieces_of(ranks) if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(by_rank, pa.binary())
        for batch in batches:
            for payload, packed in zip(batch.column(0), batch.column(1)):
                own = unpack(payload.as_buffer())
                docs_ = unpack(own.column("ids")[0].as_buffer())
                numbers, order = _unplaned(own.column("flat")[0].as_buffer()), by_count(_unplaned(own.column("often")[0].as_buffer()))
                parts_ = [unpack(x["packed"].as_buffer()) for x in (packed.values if packed.is_valid else [])]
                ids = np.concatenate([np.zeros(0, np.int32), *(_unplaned(p.column("ids")[0].as_buffer()) for p in parts_)]).astype("<u4")
                n = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(p.column("n")[0].as_buffer(), np.uint32) for p in parts_)]).astype(np.int64)
                lengths, starts = n[order], np.concatenate([[0], np.cumsum(n)])[order]
                doc_ids, ends = docs_.column("doc_id").combine_chunks(), np.cumsum(docs_.column("n").to_numpy())
                # Some documents at a time, of some PART_WORDS words, or one longer.
                a, begin = 0, 0
                while a < len(ends):
                    z = max(a + 1, int(np.searchsorted(ends, begin + PART_WORDS)))
                    part = numbers[begin : ends[z - 1]]
                    index, _ = ragged(starts[part], lengths[part])
                    words_at = np.concatenate([[0], np.cumsum(lengths[part])])
                    bounds = words_at[np.concatenate([[0], ends[a:z] - begin])]
                    data = ids[index]
                    out = pa.array([data[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())
                    texts = [pa.array([joined(x, pieces) for x in out], pa.binary())] if decoded else []
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(a, z - a), out, *texts], ["doc_id", "ids", *["text"] * decoded])
                    a, begin = z, int(ends[z - 1])

    give_back()  # the driver's memory too
    return blocks.join(coded, "block", "left").select("payload", "coded").mapInArrow(trimmed(run), "doc_id long, ids binary" + ", text binary" * decoded)


def pieces_of(ranks: dict[bytes, int]) -> list[bytes]:
    """Byte string of each id."""
    by_rank = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        by_rank[rank] = piece
    return by_rank


def joined(ids: pa.Scalar, pieces: pa.Array) -> bytes:
    """The packed ids' byte strings, concatenated."""
    numbers, out = np.frombuffer(ids.as_buffer(), "<u4"), []
    for i in range(0, len(numbers), 1 << 20):
        taken = pieces.take(pa.array(numbers[i : i + (1 << 20)]))  # one buffer: the pieces side by side
        out.append(taken.buffers()[2].to_pybytes() if taken.buffers()[2] else b"")
    return b"".join(out)


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, ids and text (binary): the ids' byte strings, concatenated."""
    small_batches(coded.sparkSession)
    by_rank = pieces_of(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(by_rank, pa.binary())
        for batch in batches:
            texts = [joined(ids, pieces) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, ids binary, text binary")
