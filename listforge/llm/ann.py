"""Approximate nearest neighbours by cosine: NN-descent graph, greedy search.

Equal vectors are one node. Nodes are dealt by hash into tiles of some
``TILE`` nodes; a tile holds its nodes' vectors, as half floats, and their
neighbour lists. The graph starts from groups of nodes on one side of a few
random planes, and from random groups, which keep it in one piece. An
iteration joins each node with its neighbours and a sample of the nodes that
have it as theirs, and compares them with one another: two neighbours of a
node are likely neighbours. Only pairs of which one is new in its list are
compared, and only those go on that a node's list has room for or whose
similarity beats its worst. Each node keeps its best ``K``. The descent ends
when hardly an edge changes.

A query, itself a node, starts from itself. Every round takes the best open
nodes of its best ``WIDTH``, sends the neighbours of these, in either
direction, to their tiles as ids beside the query's vector, and takes back
those that beat its worst, until none of the best is open. The best found are
scored in double precision on the original vectors.

A vector held by many rows is one node with its six smallest ids, taken by a
window that prunes before the shuffle. A popular node's reverse edges are a
sample of ``REVERSE``. Nothing grows with the input but the number of nodes,
and so of tiles.

Edge cases: vectors that are null, zero, or hold null or non-finite components
take no part, as queries or candidates. Vectors of different lengths are
compared as if the shorter ones went on with zeros. Components of any size are
scaled before they are squared. Rows that repeat an id and vector count once;
of an id with several vectors, the query is the first by hash. Equal scores go
by smaller vec_id. Fewer candidates than asked for are all returned. Empty
tables give no rows; columns other than vec_id and embedding may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listforge.llm._common import dealt, durable, small_batches, trimmed
from listforge.llm.recurrence import mix64, ragged

K, REVERSE, LEAF, PLANES, TREES, TILE = 24, 24, 128, 5, 4, 1024
#: Best partners that each member of a local join keeps, and the share of new edges below which the descent ends.
PARTNERS, SETTLED = 16, 0.02
#: Nodes that a search keeps, those it opens in a round, and those that are scored in the end; queries in a group.
WIDTH, EXPAND, SCORED, GROUP = 256, 64, 40, 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles without zeros at the end) of every row that takes part."""
    x = F.col("embedding")
    ok = vectors.filter(x.isNotNull() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    ok = ok.filter(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0))
    last = F.array_max(F.transform("embedding", lambda c, i: F.when(c != 0, i + 1).otherwise(0)))
    return ok.select("vec_id", F.slice("embedding", F.lit(1), last).alias("embedding"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, of length dim, over their largest component: squares neither vanish nor overflow, and multiples of a vector become equal."""
    out, n = np.zeros((len(lists), dim)), np.diff(lists.offsets.to_numpy())
    rows, (cols, _) = np.repeat(np.arange(len(lists)), n), ragged(np.zeros(len(lists), np.int64), n)
    out[rows, cols] = lists.flatten().to_numpy(zero_copy_only=False)
    return out / np.abs(out).max(axis=1, initial=0, keepdims=True)


def halves(buffers, dim: int) -> np.ndarray:
    """Vectors of a column of packed half floats."""
    buffers = buffers.combine_chunks() if isinstance(buffers, pa.ChunkedArray) else buffers
    if not len(buffers):
        return np.zeros((0, dim), np.float32)
    offsets = np.frombuffer(buffers.buffers()[1], np.int32, len(buffers) + 1, buffers.offset * 4)
    return np.frombuffer(buffers.buffers()[2], np.float16, len(buffers) * dim, offsets[0]).reshape(-1, dim).astype(np.float32)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of bytes."""
    wide = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * wide), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def tile_of(ids: np.ndarray, tiles: int) -> np.ndarray:
    return ids.astype(np.int64) % tiles  # a node's number is a hash


def best_pairs(sims: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``most`` highest allowed entries."""
    sims = np.where(allowed, sims, -3)
    n = min(most, sims.shape[1])
    top = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n else np.zeros((len(sims), 0), np.int64)
    rows, cols = np.repeat(np.arange(len(sims)), n), top.ravel()
    use = sims[rows, cols] > -3
    return rows[use], cols[use]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal keys."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return heads, np.append(heads[1:], len(keys))


NODE = "tile long, u long, half binary, v array<long>, s array<float>, fresh array<boolean>"
PAIR = "tile long, u long, v long, s float"


class Graph:
    """The steps of NN-descent over nodes (as NODE) in ``tiles`` tiles."""

    def __init__(self, dim: int, tiles: int, parts: int) -> None:
        self.dim, self.tiles, self.parts = dim, tiles, parts

    def pairs(self, u: list, v: list, s: list) -> pa.Table:
        u, v, s = (np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in ((u, np.int64), (v, np.int64), (s, np.float32)))
        return pa.table({"tile": tile_of(u, self.tiles), "u": u, "v": v, "s": s})

    def start(self, nodes: DataFrame, n: int) -> DataFrame:
        """First pairs: exact neighbours within groups of about LEAF nodes, the last groups at random."""
        planes = np.random.default_rng(3).standard_normal((TREES, PLANES, self.dim))
        planes[-1] = 0
        if n <= 4 * LEAF:
            planes[:] = 0
        parts = [1 if n <= 4 * LEAF else max(1, -(-n // (LEAF << (PLANES if t < TREES - 1 else 0)))) for t in range(TREES)]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), halves(batch.column(1), self.dim)
                for t in range(TREES if n > 4 * LEAF else 1):
                    side = ((x @ planes[t].T > 0) << np.arange(PLANES)).sum(axis=1)
                    at = (mix64(ids.view(np.uint64) + np.uint64(t + 1)) % np.uint64(parts[t])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array((t << 40) + (side.astype(np.int64) * parts[t] + at)), batch.column(0), batch.column(1)], ["leaf", "id", "half"])

        def meet(t: pa.Table) -> pa.Table:
            t = t.sort_by("id")
            ids, x, out = t.column("id").to_numpy(), halves(t.column("half"), self.dim), []
            for i in range(0, len(ids), 4 * LEAF):
                own, y = ids[i : i + 4 * LEAF], x[i : i + 4 * LEAF]
                sims = y @ y.T
                rows, cols = best_pairs(sims, ~np.eye(len(own), dtype=bool), K // 2)
                out.append((own[rows], own[cols], sims[rows, cols]))
            return self.pairs(*zip(*out))

        return nodes.select(F.col("u").alias("id"), "half").mapInArrow(trimmed(deal), "leaf long, id long, half binary").groupBy("leaf").applyInArrow(meet, PAIR)

    def merge(self, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
        """nodes whose lists have taken up the pairs that are among their best K; those are fresh."""

        def run(own: pa.Table, new: pa.Table) -> pa.Table:
            own = own.sort_by("u").combine_chunks()
            ids, lists = own.column("u").to_numpy(), own.column("v").combine_chunks()
            u = np.concatenate([np.repeat(ids, np.diff(lists.offsets.to_numpy())), new.column("u").to_numpy()])
            v = np.concatenate([lists.flatten().to_numpy(), new.column("v").to_numpy()])
            s = np.concatenate([own.column("s").combine_chunks().flatten().to_numpy(), new.column("s").to_numpy()])
            fresh = np.arange(len(u)) >= len(lists.flatten())
            order = np.lexsort((fresh, v, u))
            order = order[np.concatenate([[True], (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])])] if len(u) else order
            order = order[np.lexsort((v[order], -s[order], u[order]))]
            begin, end = runs(u[order])
            order = order[np.arange(len(order)) - np.repeat(begin, end - begin) < K]
            offsets = pa.array(np.append(np.searchsorted(u[order], ids), len(order)).astype(np.int32))
            held = {"tile": own.column("tile"), "u": own.column("u"), "half": own.column("half")}
            return pa.table(held | {c: pa.ListArray.from_arrays(offsets, pa.array(x[order])) for c, x in (("v", v), ("s", s), ("fresh", fresh))})

        merged = nodes.groupBy("tile").cogroup(pairs.groupBy("tile")).applyInArrow(run, NODE)
        return durable(merged)

    def edges(self, nodes: DataFrame) -> DataFrame:
        """tile (of c), c, m, fresh, back: every edge in both directions; back says that c is m's neighbour, not m c's."""
        e = nodes.select("u", F.explode(F.arrays_zip("v", "fresh")).alias("e")).select("u", "e.v", "e.fresh")
        ends = [F.struct(F.col(c).alias("c"), F.col(m).alias("m"), "fresh", F.lit(back).alias("back")) for c, m, back in (("u", "v", False), ("v", "u", True))]
        return e.select(F.explode(F.array(*ends)).alias("e")).select(F.pmod("e.c", F.lit(self.tiles)).alias("tile"), "e.*")

    def near(self, t: pa.Table, reverse: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c, m, fresh of a tile's edges: all forward ones and a sample of the backward ones, once each, by c."""
        c, m, fresh, back = (t.column(x).to_numpy() for x in ("c", "m", "fresh", "back"))
        lot = mix64(c.view(np.uint64) * np.uint64(31) + m.view(np.uint64))
        order = np.lexsort((lot, ~fresh, back, c))
        begin, end = runs(c[order] * 2 + back[order])
        order = order[(np.arange(len(order)) - np.repeat(begin, end - begin) < reverse) | ~back[order]]
        order = order[np.lexsort((~fresh[order], m[order], c[order]))]
        c, m, fresh = c[order], m[order], fresh[order]
        first = np.concatenate([[True], (c[1:] != c[:-1]) | (m[1:] != m[:-1])]) if len(c) else np.zeros(0, bool)
        return c[first], m[first], fresh[first]

    def descend(self, nodes: DataFrame) -> DataFrame:
        """One iteration: neighbours of a node meet one another."""

        def ask(t: pa.Table) -> pa.Table:
            c, m, fresh = self.near(t, REVERSE)
            begin, end = runs(c)
            any_fresh = np.logical_or.reduceat(fresh, begin) if len(c) else fresh
            use, own = np.repeat(any_fresh, end - begin), c[begin][any_fresh]
            c, m, fresh = (np.concatenate(x) for x in ((c[use], own), (m[use], own), (fresh[use], np.zeros(len(own), bool))))  # a node is its own member: it meets those that have it
            return pa.table({"tile": tile_of(m, self.tiles), "c": c, "m": m, "fresh": fresh})

        def send(own: pa.Table, asked: pa.Table) -> pa.Table:
            own = own.sort_by("u").combine_chunks()
            c, m = asked.column("c").to_numpy(), asked.column("m").to_numpy()
            at, s = np.searchsorted(own.column("u").to_numpy(), m), own.column("s").combine_chunks()
            n = np.diff(s.offsets.to_numpy())
            worst = np.full(len(own), -2, np.float32)
            worst[n == K] = s.flatten().to_numpy()[np.cumsum(n)[n == K] - 1]
            x = halves(own.column("half"), self.dim).astype(np.float16)
            return pa.table({"tile": tile_of(c, self.tiles), "c": c, "m": m, "fresh": asked.column("fresh"), "worst": worst[at], "half": packed(x[at])})

        def meet(t: pa.Table) -> pa.Table:
            t = t.sort_by([("c", "ascending"), ("m", "ascending")]).combine_chunks()
            c, m, fresh, worst = (t.column(x).to_numpy() for x in ("c", "m", "fresh", "worst"))
            x, out = halves(t.column("half"), self.dim), [(m[:0], m[:0], worst[:0])]
            for a, z in zip(*runs(c)):
                sims, new = x[a:z] @ x[a:z].T, fresh[a:z]
                rows, cols = best_pairs(sims, (new[:, None] | new) & (sims > worst[a:z, None]) & ~np.eye(z - a, dtype=bool), PARTNERS)
                out.append((m[a:z][rows], m[a:z][cols], sims[rows, cols]))
            u, v, s = (np.concatenate(y) for y in zip(*out))
            order = np.lexsort((v, u))
            first = np.concatenate([[True], (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])]) if len(u) else np.zeros(0, bool)
            return self.pairs(*([y[order[first]]] for y in (u, v, s)))

        asked = self.edges(nodes).groupBy("tile").applyInArrow(ask, "tile long, c long, m long, fresh boolean")
        sent = nodes.groupBy("tile").cogroup(asked.groupBy("tile")).applyInArrow(send, "tile long, c long, m long, fresh boolean, worst float, half binary")
        return self.merge(nodes, sent.groupBy("tile").applyInArrow(meet, PAIR))

    def build(self, nodes: DataFrame, n: int) -> DataFrame:
        nodes = self.merge(nodes, self.start(nodes, n))
        while True:  # ends: a round only replaces edges by better ones
            nodes = self.descend(nodes)
            moved = nodes.agg(F.sum(F.size(F.filter("fresh", lambda f: f))).alias("fresh"), F.sum(F.size("fresh")).alias("all")).first()
            if (moved["fresh"] or 0) <= SETTLED * (moved["all"] or 0):
                return nodes

    def links(self, nodes: DataFrame) -> DataFrame:
        """c, ms: each node's neighbours in either direction."""

        def run(t: pa.Table) -> pa.Table:
            c, m, _ = self.near(t, 2 * REVERSE)
            begin, _ = runs(c)
            return pa.table({"c": c[begin], "ms": pa.ListArray.from_arrays(pa.array(np.append(begin, len(c)).astype(np.int32)), pa.array(m))})

        return dealt(self.edges(nodes).groupBy("tile").applyInArrow(run, "c long, ms array<long>"), self.parts, "c")

    def search(self, nodes: DataFrame, asked: DataFrame) -> DataFrame:
        """q, node: the best SCORED nodes found for each q. asked: q, node (q's own), half. Queries travel in groups of some GROUP."""
        links, dim, tiles = self.links(nodes), self.dim, self.tiles
        groups = max(1, -(-asked.count() // GROUP))
        state = "qb long, q long, half binary, node array<long>, s array<float>, open array<boolean>"
        found = "qb long, q long, node array<long>, s array<float>"

        def request(own: pa.Table, steps: pa.Table) -> pa.Table:
            at = {q: i for i, q in enumerate(own.column("q").to_pylist())}
            steps = steps.sort_by("q").combine_chunks()
            qs, lists = steps.column("q").to_numpy(), steps.column("ms").combine_chunks()
            ids, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            out = []
            for a, z in zip(*runs(qs)):
                i = at[int(qs[a])]
                known, s = own.column("node")[i].values.to_numpy(), own.column("s")[i].values.to_numpy()
                new = np.setdiff1d(ids[cuts[a] : cuts[z]], known)
                new = new[np.argsort(tile_of(new, tiles), kind="stable")]
                tile, half, worst = tile_of(new, tiles), own.column("half")[i].as_py(), float(s[-1]) if len(s) == WIDTH else -2.0
                out += [(tile[b], own.column("qb")[i].as_py(), int(qs[a]), half, worst, new[b:e].tobytes()) for b, e in zip(*runs(tile))]
            kinds = {"tile": pa.int64(), "qb": pa.int64(), "q": pa.int64(), "half": pa.binary(), "worst": pa.float32(), "ids": pa.binary()}
            return pa.table({c: pa.array([x[i] for x in out], k) for i, (c, k) in enumerate(kinds.items())})

        def score(own: pa.Table, wanted: pa.Table) -> pa.Table:
            own = own.sort_by("u").combine_chunks()
            u, x, y = own.column("u").to_numpy(), halves(own.column("half"), dim), halves(wanted.column("half"), dim)
            out = []
            for k, (qb, q, worst, held) in enumerate(zip(*(wanted.column(c).to_pylist() for c in ("qb", "q", "worst")), wanted.column("ids"))):
                ask = np.frombuffer(held.as_buffer(), np.int64)
                sims = x[np.searchsorted(u, ask)] @ y[k]
                if (sims > worst).any():
                    out.append((qb, q, ask[sims > worst], sims[sims > worst]))
            kinds = {"qb": pa.int64(), "q": pa.int64(), "node": pa.list_(pa.int64()), "s": pa.list_(pa.float32())}
            return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(kinds.items())})

        def take(own: pa.Table, new: pa.Table) -> pa.Table:
            new = new.sort_by("q").combine_chunks()
            qs, nodes_, sims = new.column("q").to_numpy(), new.column("node").combine_chunks(), new.column("s").combine_chunks()
            cuts, ids, sims = np.concatenate([[0], np.cumsum(np.diff(nodes_.offsets.to_numpy()))]), nodes_.flatten().to_numpy(), sims.flatten().to_numpy()
            at = {int(qs[a]): (cuts[a], cuts[z]) for a, z in zip(*runs(qs))}
            out = []
            for q, node, s, open_ in zip(own.column("q").to_pylist(), own.column("node"), own.column("s"), own.column("open")):
                node, s, open_ = node.values.to_numpy(), s.values.to_numpy(), open_.values.to_numpy(zero_copy_only=False).copy()
                open_[np.flatnonzero(open_)[:EXPAND]] = False  # these have been opened
                a, z = at.get(q, (0, 0))
                node, s, open_ = np.concatenate([node, ids[a:z]]), np.concatenate([s, sims[a:z]]), np.concatenate([open_, np.ones(z - a, bool)])
                order = np.lexsort((node, -s))[:WIDTH]
                out.append((node[order], s[order].astype(np.float32), open_[order]))
            lists = {c: pa.array([x[i] for x in out], pa.list_(k)) for i, (c, k) in enumerate((("node", pa.int64()), ("s", pa.float32()), ("open", pa.bool_())))}
            return pa.table({c: own.column(c) for c in ("qb", "q", "half")} | lists)

        own = asked.select(F.pmod(F.xxhash64("q"), F.lit(groups)).alias("qb"), "q", "half", F.array("node").alias("node"), F.array(F.lit(2.0).cast("float")).alias("s"), F.array(F.lit(True)).alias("open"))
        own = durable(own)
        opened = F.slice(F.filter("node", lambda _, i: F.get("open", i)), 1, EXPAND)
        while not own.filter(F.exists("open", lambda x: x)).isEmpty():  # ends: a node is opened once, and a search's worst only rises
            steps = own.select(F.col("qb").alias("qb"), F.col("q").alias("q"), F.explode(opened).alias("c")).join(links, "c").select("qb", "q", "ms")
            wanted = own.groupBy("qb").cogroup(steps.groupBy("qb")).applyInArrow(request, "tile long, qb long, q long, half binary, worst float, ids binary")
            near = nodes.groupBy("tile").cogroup(wanted.groupBy("tile")).applyInArrow(score, found)
            own = durable(own.groupBy("qb").cogroup(near.groupBy("qb")).applyInArrow(take, state))
        return own.select("q", F.explode(F.slice("node", 1, SCORED)).alias("node"))


def nearest(vectors: DataFrame, is_query: Column, top: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``top`` nearest found."""
    spark = vectors.sparkSession
    small_batches(spark)
    ok, queries = (usable(x).withColumn("key", _key()) for x in (vectors, vectors.filter(is_query)))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = ok.dropDuplicates(["vec_id", "key"]).withColumn("turn", turn).filter(F.col("turn") <= top + 1)
    nodes = durable(few.groupBy("key").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")))
    # One id may have several vectors, which are nodes of their own: a node's number is its place, not its id.
    nodes = durable(nodes.withColumn("id", F.xxhash64("key")))
    size = nodes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.count_distinct("id").alias("ids")).first()
    if size["n"] != size["ids"]:
        raise ValueError("two vectors share a 64-bit hash")
    n, dim = size["n"], size["dim"] or 1
    tiles = max(1, -(-n // TILE))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (16 * TILE)))

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float16) if len(x) else x.astype(np.float16)
            ids = batch.column(0).to_numpy()
            empty = [pa.ListArray.from_arrays(pa.array(np.zeros(len(ids) + 1, np.int32)), pa.array([], t)) for t in (pa.int64(), pa.float32(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(tile_of(ids, tiles)), batch.column(0), packed(x), *empty], ["tile", "u", "half", "v", "s", "fresh"])

    graph = Graph(dim, tiles, parts)
    placed = durable(nodes.select("id", "embedding").mapInArrow(trimmed(halve), NODE))
    built = graph.build(placed, n)
    asked = queries.groupBy("vec_id").agg(F.min(F.struct("key", "embedding")).alias("x")).select(F.col("vec_id").alias("q"), F.xxhash64("x.key").alias("node"), F.col("x.embedding").alias("embedding"))
    asked = durable(asked.join(built.select(F.col("u").alias("node"), "half"), "node"))
    found = graph.search(built, asked.select("q", "node", "half"))
    rows = found.join(asked.select("q", F.col("embedding").alias("a")), "q").join(nodes.select(F.col("id").alias("node"), "ids", F.col("embedding").alias("b")), "node")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = matrix(batch.column(2), dim), matrix(batch.column(3), dim)
            s = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip(s, -1, 1))], ["q", "ids", "s"])

    scored = rows.select("q", "ids", "a", "b").mapInArrow(trimmed(score), "q long, ids array<long>, s double")
    # An id with several vectors counts by its nearest.
    each = scored.select("q", "s", F.explode("ids").alias("vec_id")).filter("vec_id <> q").groupBy("q", "vec_id").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= top).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.col("s").alias("score"))


def _key() -> Column:
    return F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: F.hex(x.cast("string")))), 256)
