"""Finding what recurs across documents, in bounded memory and little traffic.

A text is a row of units (bytes or words). Every window of L units contains
one *anchor*: its k-unit gram of least hash, leftmost on ties. Equal windows
have equal anchors at equal places, so a window can only recur where its
anchor does. The steps:

1. ``pack``: documents become compressed blocks of a few MB, dealt by block id
   and checkpointed; later joins on the block move only the other side.
2. ``copies``: of documents with equal texts only the first is looked at
   further; this takes large groups of exact copies out of all that follows.
3. ``recurring``: each block's distinct anchors go, packed, to buckets by hash,
   which send each block back those that a second document has too.
4. ``segments``: maximal runs of windows around a recurring anchor, once per
   block and content, go to the anchor's bucket. There a resolver finds, for
   each window, the first document that has it; this comes back to the block.
5. ``apply_matches``: a block marks the windows whose first document is earlier
   than its own.

No step emits pairs, and an anchor of very many documents costs its bucket one
entry per block and distinct context. Blocks, buckets and pieces have sizes
set by parameters; only their number follows the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm._common import dealt, durable, give_back, input_bytes, small_batches, trimmed

BLOCK_BYTES = 4 << 20
#: Documents in a block at most; a place in a block takes PLACE_BITS bits.
PLACE_BITS = 13
BUCKET_BYTES = 8 << 20
CHUNK = 1 << 20
#: A null doc_id counts as later than all others.
NULL_ID = np.iinfo(np.int64).max

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 to n - 1, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, CHUNK + 4096)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values."""
    up, down = powers(len(values))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up)])
    return mix64((sums[k:] - sums[:-k]) * down[: len(values) - k + 1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all ranges one after the other, and where each range begins in that row."""
    begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    return np.arange(begins[-1]) - np.repeat(begins[:-1] - starts, lengths), begins[:-1]


@dataclass
class Block:
    """Texts side by side: units and, for each unit, its bytes [at, to) in raw; documents' first and last units."""

    ids: np.ndarray
    raw: np.ndarray
    values: np.ndarray
    at: np.ndarray | None
    to: np.ndarray | None
    first: np.ndarray
    last: np.ndarray
    text_at: np.ndarray


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack_table(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpack(payload) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def open_block(payload, words: bool) -> Block:
    t = unpack(payload).combine_chunks()
    ids = t.column("doc_id").combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    texts = t.column("text").combine_chunks().cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    text_at = offsets - offsets[0]
    if not words:
        return Block(ids, raw, _TABLE[raw], None, None, text_at[:-1], text_at[1:], text_at)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    head = ~blank
    head[1:] &= blank[:-1]
    cut = text_at[:-1]
    cut = cut[cut < len(raw)]
    head[cut] |= ~blank[cut]  # a text's first word begins anew even right after the last one's end
    at = np.flatnonzero(head)
    tail = ~blank
    tail[:-1] &= blank[1:] | head[1:]
    to = np.flatnonzero(tail) + 1
    values = word_hashes(raw, at, to)
    return Block(ids, raw, values, at, to, np.searchsorted(at, text_at[:-1]), np.searchsorted(at, text_at[1:]), text_at)


def word_hashes(raw: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    step = 1 << 17
    for i in range(0, len(at), step):
        a, z = at[i : i + step], to[i : i + step]
        index, begins = ragged(a, z - a)
        up, _ = powers(int((z - a).max()) + 1)
        rel = index - np.repeat(a, z - a)
        out[i : i + step] = mix64(np.add.reduceat(_TABLE[raw[index]] * up[rel], begins) + (z - a).astype(np.uint64))
    return out


def anchored_runs(block: Block, skip: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one anchor: first window, end window (exclusive), anchor's place, anchor's hash. skip: documents left out."""
    n = len(block.values)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    if n < length:
        return none
    bad = np.zeros(n + 1, np.int64)
    np.add.at(bad, np.where(skip, block.first, np.maximum(block.first, block.last - length + 1)), 1)
    np.add.at(bad, block.last, -1)
    valid = np.cumsum(bad)[: n - length + 1] == 0
    w, found = length - k + 1, []
    low = np.uint64((1 << 24) - 1)
    for c in range(0, n - length + 1, CHUNK):
        ok = valid[c : c + CHUNK]
        if not ok.any():
            continue
        grams = gram_hashes(block.values[c : c + CHUNK + length - 1], k)
        key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        m = len(grams)
        padded = np.full(-(-m // w) * w, np.uint64(2**64 - 1))
        padded[:m] = key
        rows = padded.reshape(-1, w)
        fore = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: m - w + 1], fore[w - 1 : m])
        place = (least & low).astype(np.int64)
        edge = np.ones(len(place) + 1, bool)
        edge[1:-1] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])
        bounds = np.flatnonzero(edge)
        begin, end = bounds[:-1], bounds[1:]
        use = ok[begin]
        begin, end = begin[use], end[use]
        at = place[begin]
        found.append((begin + c, end + c, at + c, grams[at]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else none


def doc_of(block: Block, unit: np.ndarray) -> np.ndarray:
    """Document of each unit; empty documents hold none."""
    return np.searchsorted(block.last, unit, side="right")


@dataclass(frozen=True)
class Plan:
    """What recurs: windows of ``length`` units, anchored by grams of ``k``; words or bytes; how a bucket resolves its segments."""

    length: int
    k: int
    words: bool
    resolve: Callable[[list[bytes], np.ndarray, np.ndarray, int], list[np.ndarray]]


def pack(docs: DataFrame, n_blocks: int, whole: bool = False) -> DataFrame:
    """block long, payload binary; partitioned by block, checkpointed. whole: payloads hold all columns of docs as a struct ``rest``, text and doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            sizes = np.array([0 if t is None else t for t in pa.compute.binary_length(batch.column(1)).to_pylist()], np.int64)
            begin, held = 0, 0
            for i, size in enumerate([*sizes, BLOCK_BYTES]):
                if begin < i and (held + size > BLOCK_BYTES or i - begin >> PLACE_BITS or i == len(sizes)):
                    yield pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([pack_batch(batch.slice(begin, i - begin))], pa.binary())], ["block", "payload"])
                    begin, held, made = i, 0, made + 1
                held += size

    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.struct(*others).alias("rest")] * bool(others))
    return dealt(rows.mapInArrow(trimmed(run), "block long, payload binary"), n_blocks, "block")


def copies(blocks: DataFrame) -> DataFrame:
    """block, copies: places of documents whose very text a smaller doc_id has."""

    def texts(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = unpack(payload.as_buffer())
                ids = t.column(0).fill_null(NULL_ID).to_pylist()
                hashes = [hashlib.blake2b(b"" if x is None else x.as_buffer(), digest_size=16).digest() for x in (v if v.is_valid else None for v in t.column(1).cast(pa.large_binary()))]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(ids, pa.int64()), pa.array([block] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32())], ["hash", "id", "block", "place"])

    rows = durable(blocks.mapInArrow(trimmed(texts), "hash binary, id long, block long, place int"))
    groups = rows.groupBy("hash").agg(F.min("id").alias("head"), F.max("id").alias("other")).filter("other > head")
    # The groups' side repeats over salts, so one text's copies are joined in many tasks.
    salts = 16
    groups = groups.select("hash", "head", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("block", "place"), F.lit(salts)).cast("int"))
    later = rows.join(groups, ["hash", "salt"]).filter("id > head")
    return durable(later.groupBy("block").agg(F.collect_list("place").alias("copies")))


def _skip(places, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    if places is not None and len(places):
        out[np.asarray(places)] = True
    return out


def recurring(blocks: DataFrame, dup: DataFrame, plan: Plan, n_buckets: int) -> DataFrame:
    """block, hashes: list of packed sorted arrays of the block's anchors that a second document has."""

    def anchors(batches):
        for batch in batches:
            for block, payload, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                b = open_block(payload.as_buffer(), plan.words)
                begin, _, _, hashes = anchored_runs(b, _skip(places, len(b.ids)), plan.length, plan.k)
                if not len(hashes):
                    continue
                doc = doc_of(b, begin)
                order = np.argsort(hashes, kind="stable")
                hashes, doc = hashes[order], doc[order]
                heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                many = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
                hashes = hashes[heads]
                bucket = (hashes >> np.uint64(32)) % np.uint64(n_buckets)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
                rows = [(i, by[cuts[i] : cuts[i + 1]]) for i in range(n_buckets) if cuts[i] < cuts[i + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([hashes[x].tobytes() for _, x in rows], pa.binary()), pa.array([np.packbits(many[x]).tobytes() for _, x in rows], pa.binary())], ["bucket", "block", "hashes", "many"])

    def meet(t: pa.Table) -> pa.Table:
        owns = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]
        many = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(o)) for x, o in zip(t.column("many"), owns)]).astype(bool)
        every = np.concatenate(owns)
        order = np.argsort(every, kind="stable")
        same = np.concatenate([[True], every[order][1:] != every[order][:-1]])
        group = np.cumsum(same) - 1
        hot = np.bincount(group) > 1
        hot |= np.bincount(group, weights=many[order]) > 0
        keep = np.zeros(len(every), bool)
        keep[order] = hot[group]
        cuts = np.cumsum([0, *map(len, owns)])
        kept = [o[keep[a:z]] for o, a, z in zip(owns, cuts, cuts[1:])]
        rows = [i for i, x in enumerate(kept) if len(x)]
        give_back()
        return pa.table({"block": t.column("block").take(pa.array(rows, pa.int64())), "hashes": pa.array([kept[i].tobytes() for i in rows], pa.binary())})

    rows = blocks.join(dup, "block", "left").select("block", "payload", "copies").mapInArrow(trimmed(anchors), "bucket int, block long, hashes binary, many binary")
    met = rows.groupBy("bucket").applyInArrow(meet, "block long, hashes binary")
    return durable(met.groupBy("block").agg(F.collect_list("hashes").alias("hashes")))


def segments_of(b: Block, skip: np.ndarray, hashes: list, plan: Plan) -> tuple[np.ndarray, ...]:
    """Distinct segments around recurring anchors, in an order that only the block decides.

    Returns run begin, run end, anchor hash and segment number of every run,
    then each segment's first run and smallest doc_id.
    """
    begin, end, place, anchor = anchored_runs(b, skip, plan.length, plan.k)
    if len(begin):
        wanted = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in hashes]))
        at = np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)
        use = wanted[at] == anchor
        begin, end, place, anchor = begin[use], end[use], place[use], anchor[use]
    if not len(begin):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(0, np.uint64), zero, zero, zero
    content = np.zeros(len(begin), np.uint64)
    for i in range(0, len(begin), 1 << 14):
        s, n = begin[i : i + (1 << 14)], end[i : i + (1 << 14)] - begin[i : i + (1 << 14)] + plan.length - 1
        index, begins = ragged(s, n)
        up, _ = powers(int(n.max()) + 1)
        content[i : i + (1 << 14)] = np.add.reduceat(b.values[index] * up[index - np.repeat(s, n)], begins)
    content = mix64(content + (end - begin).astype(np.uint64) * np.uint64(0x51ED270B) + (place - begin).astype(np.uint64) * np.uint64(0x2545F491))
    _, first, number = np.unique(content, return_index=True, return_inverse=True)
    ids = b.ids[doc_of(b, begin)]
    least = np.full(len(first), NULL_ID)
    np.minimum.at(least, number, ids)
    return begin, end, anchor, number, first, least


def segment_bytes(b: Block, begin: int, end: int, plan: Plan) -> bytes:
    if not plan.words:
        return b.raw[begin : end + plan.length - 1].tobytes()
    return b" ".join(b.raw[b.at[begin] : b.to[end + plan.length - 2]].tobytes().split())


def matches(blocks: DataFrame, dup: DataFrame, found: DataFrame, plan: Plan, n_buckets: int) -> DataFrame:
    """block, firsts: packed (segment number, first document of each of its windows)."""

    def cut(batches):
        for batch in batches:
            for block, payload, places, hashes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                b = open_block(payload.as_buffer(), plan.words)
                begin, end, anchor, _, first, least = segments_of(b, _skip(places, len(b.ids)), hashes, plan)
                if not len(first):
                    continue
                anchor = anchor[first]
                bucket = (anchor >> np.uint64(32)) % np.uint64(n_buckets)
                by = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
                for i in range(n_buckets):
                    own = by[cuts[i] : cuts[i + 1]]
                    if len(own):
                        t = pa.table({"segment": pa.array(own.astype(np.int32)), "anchor": pa.array(anchor[own]), "id": pa.array(least[own]), "bytes": pa.array([segment_bytes(b, int(begin[first[s]]), int(end[first[s]]), plan) for s in own], pa.binary())})
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block], pa.int64()), pa.array([pack_table(t)], pa.binary())], ["bucket", "block", "packed"])

    def meet(t: pa.Table) -> pa.Table:
        blocks_ = t.column("block").to_pylist()
        parts = [unpack(x.as_buffer()) for x in t.column("packed")]
        sizes = np.cumsum([0, *map(len, parts)])
        every = pa.concat_tables(parts)
        ids, anchor = every.column("id").to_numpy(), every.column("anchor").to_numpy()
        texts = every.column("bytes").to_pylist()
        firsts = plan.resolve(texts, ids, anchor, plan.length)
        out = []
        for p, a in zip(parts, sizes):
            own = firsts[a : a + len(p)]
            out.append(pack_table(pa.table({"segment": p.column("segment"), "n": pa.array([len(x) for x in own], pa.int32()), "same": pa.array([int(x[0]) if len(x) and (x == x[0]).all() else None for x in own], pa.int64()), "first": pa.array([None if len(x) and (x == x[0]).all() else x.tobytes() for x in own], pa.binary())})))
        give_back()
        return pa.table({"block": pa.array(blocks_, pa.int64()), "firsts": pa.array(out, pa.binary())})

    rows = blocks.join(dup, "block", "left").join(found, "block").select("block", "payload", "copies", "hashes").mapInArrow(trimmed(cut), "bucket int, block long, packed binary")
    met = rows.groupBy("bucket").applyInArrow(meet, "block long, firsts binary")
    return durable(met.groupBy("block").agg(F.collect_list("firsts").alias("firsts")))


def covered_units(b: Block, skip: np.ndarray, hashes: list | None, firsts: list | None, plan: Plan) -> np.ndarray:
    """Whether each unit lies in a window that an earlier document has."""
    n = len(b.values)
    flag = np.zeros(n + 1, np.int32)
    if hashes and firsts:
        begin, end, _, number, first, _ = segments_of(b, skip, hashes, plan)
        windows = (end - begin)[first]
        starts = np.concatenate([[0], np.cumsum(windows)])
        table = np.full(starts[-1], NULL_ID)
        for payload in firsts:
            t = unpack(payload)
            for s, same, own in zip(t.column("segment").to_pylist(), t.column("same").to_pylist(), t.column("first").to_pylist()):
                table[starts[s] : starts[s + 1]] = same if own is None else np.frombuffer(own, np.int64)
        ids = b.ids[doc_of(b, begin)]
        index, _ = ragged(begin, end - begin)
        source, _ = ragged(starts[number], end - begin)
        flag[index[table[source] < np.repeat(ids, end - begin)]] = 1
    for d in np.flatnonzero(skip):
        if b.last[d] - b.first[d] >= plan.length:
            flag[b.first[d] : b.last[d] - plan.length + 1] = 1
    sums = np.concatenate([[0], np.cumsum(flag[:n])])
    return sums[1:] - sums[np.maximum(np.arange(1, n + 1) - plan.length, 0)] > 0


def remove_recurring(docs: DataFrame, plan: Plan, emit: Callable[[Block, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """One row per row of docs, as ``emit`` makes it from a block and its covered units."""
    n = max(8, -(-input_bytes(docs) // BUCKET_BYTES))
    blocks = pack(docs, n)
    dup = copies(blocks)
    found = recurring(blocks, dup, plan, n)
    met = matches(blocks, dup, found, plan, n)

    def finish(batches):
        for batch in batches:
            for payload, places, hashes, firsts in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                b = open_block(payload.as_buffer(), plan.words)
                yield pa.RecordBatch.from_arrays(emit(b, covered_units(b, _skip(places, len(b.ids)), hashes, firsts, plan)), [c.split()[0] for c in schema.split(", ")])

    return blocks.join(dup, "block", "left").join(found, "block", "left").join(met, "block", "left").select("payload", "copies", "hashes", "firsts").mapInArrow(trimmed(finish), schema)
