"""Near-duplicate groups by b-bit MinHash.

Documents with equal shingle sets form a class, and only its first row goes
on. 128 minima are folded into 32 band keys; of the minima themselves only the
low 4 bits are kept, packed into eight longs. Candidates come from rows that
share a band key; their similarity is estimated from the packed bits by bit
counts, corrected for chance collisions, and pairs far enough below the
threshold are left. Every other pair whose rows are not in one group yet is
confirmed on the full sets.

No bucket is ever expanded into pairs. First each row meets its buckets'
smallest rows. Once those links have been followed, the rows outside the
largest group of a bucket are held against the bucket's other groups by packed
bits. Groups with likely pairs form families, and each row of a family goes,
with its set, once to the place where its family meets; a family above
``TILE_BYTES`` meets in pairs of tiles. There its outside rows are compared
with all rows of other groups: any two rows of different groups that share a
bucket meet this way, so of the links only those are lost that banding or the
estimate cannot see (a pair at similarity 0.8 shares no bucket with
probability 5e-8, and is estimated too low with probability 3e-9).

Groups are found by joins alone: each round gives a label the smallest label
across a link, and halves chains of labels, until nothing changes.

Edge cases: texts with fewer words than a shingle are their whole sequence as
one shingle; null or blank texts have an empty set and are linked with
nothing. Rows that share a doc_id are linked if their sets are alike. A null
doc_id counts as later than all others and is its own component_id only where
no other is reachable. Very long texts are hashed in slices. Empty tables give
no rows. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listforge.llm import _common
from listforge.llm._common import give_back, input_bytes, trimmed
from listforge.llm.recurrence import BUCKET_BYTES, NULL_ID, PLACE_BITS, mix64, open_block, pack, pack_table, unpack, word_hashes

MINIMA, BANDS, BITS = 128, 32, 4
#: How far below the threshold an estimate may be: a pair at 0.8 falls below that with probability 3e-9 (binomial tail), less often than it shares no band.
SLACK = 0.24
#: Members of its largest group that a split bucket's other rows meet first.
RELAYS = 8
#: Bytes of sets that meet at one place (a row counts as ROW_BYTES at least), and members of a bucket that its outside rows are held against in one task.
TILE_BYTES, ROW_BYTES, PART_ROWS = 8 << 20, 2048, 1024

#: Most partitions of the tables between rounds: as many as the input has blocks of work.
_parts: ContextVar[int] = ContextVar("parts")


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint without more partitions, and so files, than the input warrants: there are dozens, mostly small."""
    return _common.durable(df.coalesce(_parts.get()))


_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, np.uint32(2**32 - 1))
    for i in range(0, len(x), 4096):
        h = _A * x[None, i : i + 4096] + _B
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def shingle_sets(payload, size: int, places: list[int] | None = None):
    """doc_ids and, for each document (at places), its sorted distinct shingle hashes."""
    if places is not None:
        payload = pack_table(unpack(payload).select(["doc_id", "text"]).take(pa.array(places, pa.int64())))
    b = open_block(payload, True)
    raw = _LOWER[b.raw]
    values = word_hashes(raw, b.at, b.to)
    n = len(values)
    grams = np.zeros(n, np.uint64)
    for j in range(size):
        grams[: max(n - j, 0)] = mix64(grams[: max(n - j, 0)] * np.uint64(0x9E3779B97F4A7C15) + values[j:] + np.uint64(j + 1))
    sets = []
    for a, z in zip(b.first, b.last):
        if z - a >= size:
            sets.append(np.unique(grams[a : z - size + 1]))
        elif z > a:
            whole = np.uint64(int.from_bytes(hashlib.blake2b(values[a:z].tobytes(), digest_size=8).digest(), "little"))
            sets.append(np.array([whole], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return b.ids, sets


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits, corrected for the 1 in 16 that agree by chance."""
    differs = lambda x, y: F.bit_count(_lanes(x.bitwiseXOR(y)))
    unlike = sum((differs(a[i], b[i]) for i in range(MINIMA * BITS // 64)), F.lit(0))
    chance = 1 / (1 << BITS)
    return ((1 - unlike / MINIMA) - chance) / (1 - chance)


def likely(percent: int) -> Column:
    """Of sketches x and y: sets whose sizes differ too much cannot be alike, whatever the estimate."""
    sizes_fit = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    return sizes_fit & (estimate(F.col("x.bits"), F.col("y.bits")) >= percent / 100 - SLACK)


def _lanes(x: Column) -> Column:
    two = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return two.bitwiseOR(F.shiftrightunsigned(two, 2)).bitwiseAND(F.lit(0x1111111111111111))


def features(blocks: DataFrame, size: int) -> DataFrame:
    """row, doc_id, n_shingles, set_hash (null for empty sets), bands, bits."""

    def run(batches):
        weights = (np.uint64(1) << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)))[None, :]
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, sets = shingle_sets(payload.as_buffer(), size)
                hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                table = np.stack([minima(s) for s in sets])
                per = MINIMA // BANDS
                bands = np.zeros((len(sets), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for j in range(per):
                    bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + table[:, j::per])
                bits = ((table & np.uint32(15)).astype(np.uint64).reshape(len(sets), -1, 16) * weights).sum(axis=2, dtype=np.uint64)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel().view(np.int64)))
                rows = (block << PLACE_BITS) + np.arange(len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), lists(bands), lists(bits)], ["row", "doc_id", "n_shingles", "set_hash", "bands", "bits"])

    return durable(blocks.mapInArrow(trimmed(run), "row long, doc_id long, n_shingles long, set_hash binary, bands array<long>, bits array<long>"))


def sets_of(rows: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """row, shingles (packed set) of distinct rows."""

    def run(batches):
        for batch in batches:
            for block, payload, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                _, found = shingle_sets(payload.as_buffer(), size, places)
                yield pa.RecordBatch.from_arrays([pa.array([(block << PLACE_BITS) + p for p in places], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["row", "shingles"])

    wanted = rows.groupBy(_block("row").alias("block")).agg(F.collect_list(_place("row")).alias("places"))
    return blocks.join(wanted, "block").select("block", "payload", "places").mapInArrow(trimmed(run), "row long, shingles binary")


def _block(c: str) -> Column:
    return F.shiftright(c, PLACE_BITS)


def _place(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs a, b whose full sets are alike. b's set goes once to each block that holds some of its a."""

    def meet(block: pa.Table, sent: pa.Table) -> pa.Table:
        found_a, found_b = [], []
        if len(block) and len(sent):
            base = block.column("block")[0].as_py() << PLACE_BITS
            lists = sent.column("places").to_pylist()
            places = sorted(set().union(*lists))
            own = dict(zip(places, shingle_sets(block.column("payload")[0].as_buffer(), size, places)[1]))
            for b, packed, wanted in zip(sent.column("b").to_pylist(), sent.column("shingles"), lists):
                y = np.frombuffer(packed.as_buffer(), np.uint64)
                good = [p for p in wanted if alike(own[p], y, percent)]
                found_a += [base + p for p in good]
                found_b += [b] * len(good)
        give_back()
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    sets = sets_of(pairs.select(F.col("b").alias("row")).distinct(), blocks, size)
    sent = pairs.groupBy("b", _block("a").alias("block")).agg(F.collect_list(_place("a")).alias("places"))
    sent = sent.join(sets.select(F.col("row").alias("b"), "shingles"), "b").select("block", "b", "places", "shingles")
    return durable(blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(meet, "a long, b long"))


def unlike_minima(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the minima, packed along the last axis, differ."""
    x = x ^ y
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1)


def promising(unlike: np.ndarray, percent: int) -> np.ndarray:
    """As likely(), on counts of unlike minima."""
    return (1 - unlike / MINIMA - 1 / 16) / (1 - 1 / 16) >= percent / 100 - SLACK


def matrix(bits: pa.ChunkedArray) -> np.ndarray:
    return bits.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(bits), -1)


def families(inside: DataFrame, percent: int) -> DataFrame:
    """node, label: groups joined by likely pairs in split buckets, and the family of each. inside: see split_buckets.

    A bucket's members are dealt into parts; its outside rows go to each part.
    """

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("part", "ascending")])
        key, part, label, n, outer, own = (t.column(c).to_numpy() for c in ("key", "part", "label", "n", "outer", "own"))
        bits = matrix(t.column("bits"))
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]), True])
        names, at = np.unique(label, return_inverse=True)
        root = np.arange(len(names))  # groups with a likely pair so far have one root: what leaves is no more than a link for each group
        for a, z in zip(cuts, cuts[1:]):
            x, y = a + np.flatnonzero(outer[a:z]), a + np.flatnonzero(own[a:z])
            for i in range(0, len(x), 64):
                some = x[i : i + 64, None]
                left, right = np.nonzero((root[at[some]] != root[at[y]]) & (100 * np.minimum(n[some], n[y]) >= percent * np.maximum(n[some], n[y])))
                left, right = x[i + left], y[right]
                hope = promising(unlike_minima(bits[left], bits[right]), percent)
                for pair in np.unique(at[left[hope]] * len(names) + at[right[hope]]).tolist():
                    u, v = root[pair // len(names)], root[pair % len(names)]
                    if u != v:
                        root[root == max(u, v)] = min(u, v)
        linked = np.flatnonzero(root != np.arange(len(names)))
        give_back()
        return pa.table({"u": pa.array(names[root[linked]], pa.int64()), "v": pa.array(names[linked], pa.int64())})

    parts = inside.groupBy("key").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    sent = inside.join(parts, "key").withColumns({"outer": F.col("label") != F.col("top"), "at": F.pmod(F.xxhash64("row"), "parts").cast("int")})
    every = F.when(F.col("outer"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("at"))
    sent = sent.select("key", F.explode(every).alias("part"), "at", "label", "outer", F.col("sketch.n").alias("n"), F.col("sketch.bits").alias("bits"))
    # Many buckets a task: most are small.
    bins = F.lit(-(-inside.count() // (8 * PART_ROWS)))
    sent = sent.withColumns({"own": F.col("part") == F.col("at"), "bin": F.pmod(F.xxhash64("key", "part"), bins)})
    return components(durable(sent.groupBy("bin").applyInArrow(meet, "u long, v long").distinct()))


def meetings(inside: DataFrame, percent: int) -> DataFrame:
    """family, tile, tiles, row, label, outer, sketch: once each row of a family. Small families share a number below 0."""
    rows = inside.groupBy("row").agg(F.first("label").alias("label"), F.max(F.col("label") != F.col("top")).alias("outer"), F.first("sketch").alias("sketch"))
    rows = durable(rows.join(families(inside, percent).select(F.col("node").alias("label"), F.col("label").alias("family")), "label"))
    weights = rows.groupBy("family").agg(F.sum(F.greatest(F.col("sketch.n") * 8, F.lit(ROW_BYTES))).alias("weight")).withColumn("tiles", F.ceil(F.col("weight") / TILE_BYTES).cast("int"))
    small = weights.filter("tiles = 1").agg(F.sum("weight")).first()[0] or 0
    bins = F.lit(-(-small // TILE_BYTES) or 1)
    place = F.when(F.col("tiles") > 1, F.col("family")).otherwise(-1 - F.pmod(F.xxhash64("family"), bins))
    return rows.join(weights, "family").select(place.alias("family"), F.pmod(F.xxhash64("row"), "tiles").cast("int").alias("tile"), "tiles", "row", "label", "outer", "sketch")


def links_outside(inside: DataFrame, blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """Links a, b of rows outside their split bucket's largest group with rows of other groups of their family."""

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        row, label, n, tile, outer = (t.column(c).to_numpy() for c in ("row", "label", "n", "tile", "outer"))
        bits = matrix(t.column("bits"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        apart = t.column("low")[0].as_py() != t.column("high")[0].as_py()
        joined: dict[int, int] = {}

        def group(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        found_a, found_b = [], []
        for a in np.flatnonzero(outer).tolist():
            could = (label != label[a]) & (100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a]))
            could[:a] &= ~outer[:a]  # two outside rows are compared once
            if apart:
                could &= tile != tile[a]
            near = np.flatnonzero(could)
            unlike = unlike_minima(bits[near], bits[a])
            hope = promising(unlike, percent)
            for b in near[hope][np.argsort(unlike[hope], kind="stable")].tolist():
                # One link between two groups is enough.
                u, v = group(int(label[a])), group(int(label[b]))
                if u != v and alike(sets[a], sets[b], percent):
                    joined[u] = v
                    found_a.append(row[a])
                    found_b.append(row[b])
        give_back()
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    placed = durable(meetings(inside, percent))
    sets = sets_of(placed.select("row"), blocks, size)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    sent = placed.join(sets, "row").select("family", "tile", other, "row", "label", "outer", F.col("sketch.n").alias("n"), F.col("sketch.bits").alias("bits"), "shingles")
    sent = sent.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other")
    return durable(sent.groupBy("family", "low", "high").applyInArrow(meet, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached. edges: u, v; checkpointed."""
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).union(edges.select("v", "u"))
    label = durable(nodes.groupBy("node").agg(F.least(F.min("to"), F.first("node")).alias("label")))
    while True:
        of = lambda c, to: label.select(F.col("node").alias(c), F.col("label").alias(to))
        # Each label takes the smallest label across an edge, or its own label; then twice that, so chains halve.
        ends = edges.join(of("u", "lu"), "u").join(of("v", "lv"), "v").filter("lu <> lv").select(F.greatest("lu", "lv").alias("node"), F.least("lu", "lv").alias("to"))
        hooks = ends.union(label.filter("label < node")).groupBy("node").agg(F.min("to").alias("to"))
        twice = hooks.join(hooks.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select(F.col("node").alias("label"), F.coalesce("next", "to").alias("to"))
        label = durable(label.join(twice, "label", "left").select("node", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved")))
        if label.filter("moved").isEmpty():
            return label.select("node", "label")
        label = label.select("node", "label")


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (row, label) after links (a, b) between rows."""
    side = lambda c, to: groups.select(F.col("row").alias(c), F.col("label").alias(to))
    edges = durable(links.join(side("a", "u"), "a").join(side("b", "v"), "b").filter("u <> v").select("u", "v").distinct())
    if edges.isEmpty():
        return groups
    roots = components(edges)
    return durable(groups.join(roots.withColumnRenamed("label", "root"), groups["label"] == roots["node"], "left").select("row", F.coalesce("root", "label").alias("label")))


def settled(groups: DataFrame, pairs: DataFrame, blocks: DataFrame, size: int, percent: int, turns: tuple[int | None, ...]) -> DataFrame:
    """groups after pairs (a, b, score) between different groups have been tried: each row's likeliest in turns of that many; None: all that are left."""
    side = lambda c, to: groups.select(F.col("row").alias(c), F.col("label").alias(to))
    for most in turns:
        open_ = pairs.join(side("a", "la"), "a").join(side("b", "lb"), "b").filter("la <> lb").select("a", "b", "score")
        if most is not None:
            best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
            open_ = durable(open_.withColumn("turn", F.row_number().over(best)))
            pairs, now = open_.filter(F.col("turn") > most), open_.filter(F.col("turn") <= most)
        else:
            now = durable(open_)
        if now.isEmpty():
            break
        groups = merged(groups, confirmed(now.select("a", "b"), blocks, size, percent))
    return groups


def split_buckets(members: DataFrame, groups: DataFrame, reps: DataFrame) -> DataFrame:
    """key, row, sketch, label, top: members of buckets of several groups; top is the bucket's largest."""
    labelled = members.select("key", "row").join(groups, "row")
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "label")).alias("top")).filter("parts > 1").select("key", F.col("top.label").alias("top"))
    return durable(labelled.join(split, "key").join(reps.select("row", "sketch"), "row"))


def grouped(docs: DataFrame, size: int, percent: int, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The packed blocks, features of their rows, and for each set_hash its root (one for each group) and least doc_id."""
    n = max(8, -(-input_bytes(docs) // BUCKET_BYTES))
    _parts.set(n)
    blocks = pack(docs, n, whole)
    rows = features(blocks, size)
    heads = rows.filter("set_hash is not null").groupBy("set_hash").agg(F.min("row").alias("head"), F.min("doc_id").alias("least"))
    heads = durable(heads)
    reps = durable(rows.join(heads.select(F.col("head").alias("row")), "row", "left_semi").select("row", "bands", F.struct("bits", F.col("n_shingles").alias("n")).alias("sketch")))
    banded = reps.select("row", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("row").alias("first"), F.max("row").alias("last")).filter("first < last").select("key", "first")
    members = durable(banded.join(shared, "key").select("key", "row", "first"))
    groups = durable(members.select("row", F.col("row").alias("label")).distinct())
    star = members.filter("row > first").select(F.col("row").alias("a"), F.col("first").alias("b")).distinct()
    sketch = lambda c, to: reps.select(F.col("row").alias(c), F.col("sketch").alias(to))
    star = star.join(sketch("a", "x"), "a").join(sketch("b", "y"), "b").filter(likely(percent))
    star = star.select("a", "b", estimate(F.col("x.bits"), F.col("y.bits")).alias("score"))
    groups = settled(groups, durable(star), blocks, size, percent, (1, None))
    # Buckets that are still split: first against some of the largest group, which links most, then against all.
    inside = split_buckets(members, groups, reps)
    if not inside.isEmpty():
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", "row"), "row"))
        some = inside.filter("label = top").withColumn("turn", turn).filter(F.col("turn") <= RELAYS)
        x = inside.filter("label <> top").select("key", F.col("row").alias("a"), F.col("sketch").alias("x"))
        y = some.select(F.col("key").alias("key_b"), F.col("row").alias("b"), F.col("sketch").alias("y"))
        relayed = x.join(y, (F.col("key") == F.col("key_b")) & likely(percent)).groupBy("a", "b").agg(F.first(estimate(F.col("x.bits"), F.col("y.bits"))).alias("score"))
        groups = settled(groups, durable(relayed), blocks, size, percent, (4,))
        inside = split_buckets(members, groups, reps)
        groups = merged(groups, links_outside(inside, blocks, size, percent))
    root = heads.join(groups, heads["head"] == groups["row"], "left").select("set_hash", F.coalesce("label", "head").alias("root"), "least")
    return blocks, rows, root


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, of every row of docs."""
    _, rows, root = grouped(docs, size, percent)
    by_root = root.groupBy("root").agg(F.min("least").alias("component_id"))
    by_hash = root.join(by_root, "root").select("set_hash", "component_id")
    out = rows.select("row", "doc_id", "n_shingles", "set_hash").join(by_hash, "set_hash", "left")
    real = lambda c: F.when(c != F.lit(int(NULL_ID)), c)
    component = F.coalesce("component_id", "doc_id")
    return out.select(real(F.col("doc_id")).alias("doc_id"), "n_shingles", real(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each group, that of its smallest doc_id, and all rows of empty sets; columns unchanged.

    Rows are told apart by their place in the packed blocks, and leave from
    there, so null and shared doc_ids lose nothing.
    """
    blocks, rows, root = grouped(docs, size, percent, whole=True)
    first = rows.filter("set_hash is not null").groupBy("set_hash").agg(F.min(F.struct("doc_id", "row")).alias("own"))
    chosen = root.join(first, "set_hash").groupBy("root").agg(F.min("own").alias("own")).select(F.col("own.row").alias("row"))
    chosen = chosen.union(rows.filter("set_hash is null").select("row"))
    wanted = durable(chosen.groupBy(_block("row").alias("block")).agg(F.collect_list(_place("row")).alias("places")))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = ["doc_id", "text", *["rest"] * bool(others)]

    def run(batches):
        for batch in batches:
            for payload, places in zip(batch.column(0), batch.column(1).to_pylist()):
                t = unpack(payload.as_buffer()).take(pa.array(sorted(places), pa.int64())).combine_chunks()
                yield from t.select(names).to_batches()

    rest = [f"rest struct<{', '.join(f'`{c}`: {docs.schema[c].dataType.simpleString()}' for c in others)}>"] * bool(others)
    out = blocks.join(wanted, "block").select("payload", "places").mapInArrow(trimmed(run), ", ".join(["doc_id long", "text string", *rest]))
    own = lambda c: F.col(c).cast(docs.schema[c].dataType) if c in ("doc_id", "text") else F.col("rest")[c]
    return out.select(*[own(c).alias(c) for c in docs.columns])
