"""Near copies among vectors: navigable small-world graphs of shards, each queried by all vectors.

Equal vectors become one with a number of copies. The others are dealt into shards, and each shard gets a hierarchical
navigable small-world graph. For each two shards, one task searches the graph of either with the vectors of the other
(a shard with itself too): greedily down the layers, by a beam on the lowest, then along all links within the angle asked for; a vector that fills
its beam with such neighbours is compared with all of the shard. The task audits its recall on some of its vectors against all of the shard, and searches again with wider beams until the audit
passes; a beam as wide as the shard is exact. Cosines are then verified in double precision.

Found pairs don't leave the task: in each block of vectors both directions are put together as bits, added up by vector, and
folded into a forest of at most a link a vector. So a group of near copies costs rows in proportion to its vectors, not to
its pairs. Sums and forests are combined by Spark, and components are the forests' by `components`.

All tables between the steps are written to the shared folder. A shard has at most `most` vectors, which bounds a task's memory:
two shards, two graphs and what was found in one direction, as places or at most a bit for each pair of the two; what a block
of queries needs besides has a bound of its own. A graph travels in rows of PIECE vectors. Every vector meets every shard, as the method says: for n vectors that is
n * n / most searches, each of logarithmic cost.

Defined cases: a vector that is null, zero, empty or holds null or non-finite components links with nothing, and vectors of
different lengths don't link; rows with one id, or with a null id, are vectors of their own; a component's id is the smallest id
in it that is not null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_sized, ship, written
from .components import components

M = 16  # links a vector, twice as many on the lowest layer
BEAM = 64  # candidates when a graph is made
MOST_TASKS = 2016  # for pairs of shards
FEWEST_SHARDS = 4  # so that a few tasks can run at once
MOST_ROWS = 32_768  # of a shard
BLOCK = 512  # vectors that are searched for together
AUDITED = 512
PIECE = 1024  # vectors of a graph's row in tables
BATCH_BYTES = 4 << 20  # of graphs' rows, on their way into a task
PART = 32  # queries whose pairs, or products with all of a shard, are numbers at once
WIDE = BLOCK * 256  # places in the beams that are searched together
VERIFIED = 1 << 14  # pairs
_SLACK = 1e-4  # single precision finds candidates


@dataclass
class Graph:
    """A shard's vectors, of length 1, and links of each layer: (nodes, their links, -1 for none); the first layer has all nodes."""

    x: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    @property
    def top(self) -> int:
        return int(self.layers[-1][0][0])


def _first(ids: np.ndarray) -> np.ndarray:
    """In each row, which entries are the first of their value."""
    order = np.argsort(ids, axis=1, kind="stable")
    ranked = np.take_along_axis(ids, order, 1)
    new = np.ones(ids.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    out = np.empty(ids.shape, bool)
    np.put_along_axis(out, order, new, 1)
    return out


def _similar(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Dot products of each query with its own ids; -1 is as far as can be."""
    return np.where(ids >= 0, np.matmul(x[ids], q[:, :, None])[:, :, 0], -np.inf)


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int, seen: np.ndarray, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ids and similarities of the `width` best nodes that a search from `start` (query, k) meets, best first, -1 for none. `links`
    has a row for each node of x. `seen` (query, node) gets what was met. All queries take their steps together."""
    n = len(q)
    rows = np.arange(n)
    start = np.where(_first(start), start, -1)
    ids = np.full((n, max(width, start.shape[1])), -1, np.int64)
    ids[:, : start.shape[1]] = start
    at, k = np.nonzero(start >= 0)
    seen[at, start[at, k]] = True
    sims = _similar(x, q, ids)
    done = ids < 0
    active = rows
    while len(active):
        open_sims = np.where(done[active], -np.inf, sims[active])
        best = np.argpartition(-open_sims, min(step, open_sims.shape[1]) - 1, axis=1)[:, :step]
        there = np.isfinite(np.take_along_axis(open_sims, best, 1))
        some = there.any(1)
        active, best, there = active[some], best[some], there[some]
        if not len(active):
            break
        nodes = np.where(there, ids[active[:, None], best], -1)
        np.put_along_axis(mark := done[active], best, True, 1)
        done[active] = mark
        near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
        near = np.where(_first(near) & ~seen[active[:, None], near], near, -1)
        at, k = np.nonzero(near >= 0)
        seen[active[at], near[at, k]] = True
        all_ids = np.concatenate([ids[active], near], 1)
        all_sims = np.concatenate([sims[active], _similar(x, q[active], near)], 1)
        all_done = np.concatenate([done[active], near < 0], 1)
        keep = np.argpartition(-all_sims, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
        ids[active], sims[active], done[active] = (np.take_along_axis(v, keep, 1) for v in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1)[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first) up to m: those that are nearer to the row's own vector than to any chosen before, then
    the best of the others."""
    n, c = ids.shape
    v = x[ids]
    between = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((n, c), bool)
    for k in range(c):
        chosen[:, k] = (ids[:, k] >= 0) & (np.where(chosen, between[:, k], -np.inf).max(1) < sims[:, k]) & (chosen.sum(1) < m)
    order = np.argsort(np.where(chosen, 0, 1) + np.where(ids >= 0, 0, 2), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, order, 1)
    return out if c >= m else np.concatenate([out, np.full((n, m - c), -1)], 1)


def _linked(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Sets the nodes' links, and the reverse ones: what has more than it may choose anew."""
    m = links.shape[1]
    links[nodes] = chosen
    at, k = np.nonzero(chosen >= 0)
    to, source = chosen[at, k], nodes[at]
    order = np.lexsort((-np.einsum("ij,ij->i", x[to], x[source]), to))
    to, source = to[order], source[order]
    first = np.searchsorted(to, to, "left")
    rank = np.arange(len(to)) - first
    to, source, rank = to[rank < m], source[rank < m], rank[rank < m]
    own = np.unique(to)
    new = np.full((len(own), m), -1, np.int64)
    new[np.searchsorted(own, to), rank] = source
    for s in range(0, len(own), BLOCK):
        some = own[s : s + BLOCK]
        ids = np.concatenate([links[some], new[s : s + BLOCK]], 1)
        ids = np.where(_first(ids), ids, -1)
        sims = _similar(x, x[some], ids)
        order = np.argsort(-sims, axis=1, kind="stable")
        links[some] = _diverse(x, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), m)


def build(x: np.ndarray, seed: int = 0) -> Graph:
    """A graph of vectors of length 1, in single precision. Nodes come in blocks, no larger than what is there; a block's nodes see
    those before them, and one another."""
    n = len(x)
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(int), 12)
    order = np.argsort(-level, kind="stable")  # the highest first, so that a layer's nodes are a prefix
    x, level = np.ascontiguousarray(x[order]), level[order]
    tables = [np.full((int((level >= k).sum()), M if k else 2 * M), -1, np.int64) for k in range(level[0] + 1)] if n else []
    done = 1
    while done < n:
        nodes = np.arange(done, min(n, 2 * done, done + BLOCK))
        q = x[nodes]
        start = np.zeros((len(nodes), 1), np.int64)
        inner = np.where(np.tri(len(nodes), k=-1, dtype=bool), q @ q.T, -np.inf)  # with the block's nodes before each
        near = np.argsort(-inner, axis=1)[:, :M]
        near = np.where(np.isfinite(np.take_along_axis(inner, near, 1)), nodes[near], -1)
        for k in range(len(tables) - 1, -1, -1):
            there = min(done, len(tables[k]))
            on = nodes < len(tables[k])
            ids, _ = _beam(x[:there], tables[k][:there], q, start, BEAM if on.any() else 1, np.zeros((len(q), there), bool))
            start = ids[:, : max(1, min(8, ids.shape[1]))]
            start = np.where(start[:, :1] >= 0, np.where(start >= 0, start, start[:, :1]), 0)
            if on.any():
                both = np.concatenate([ids[on], np.where(near[on] < len(tables[k]), near[on], -1)], 1)
                sims = _similar(x, q[on], both)
                best = np.argsort(-sims, axis=1, kind="stable")
                _linked(x, tables[k], nodes[on], _diverse(x, np.take_along_axis(both, best, 1), np.take_along_axis(sims, best, 1), tables[k].shape[1]))
        done = int(nodes[-1]) + 1
    return Graph(x, [(order[: len(t)], t) for t in tables])


def _close(q: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """(query, vector) of products of at least `least`, from all of them."""
    out = np.empty((len(q), len(x)), bool)
    for s in range(0, len(q), PART):
        np.greater_equal(q[s : s + PART] @ x.T, least, out=out[s : s + PART])
    return out


def search(graph: Graph, q: np.ndarray, least: float, width: int) -> np.ndarray:
    """(query, node) of single-precision cosines of at least `least`: the beam's, and all that links within `least` lead to; all
    there are, if they fill the beam."""
    n, most = len(graph.x), max(1, WIDE // width)
    if len(q) > most:
        return np.concatenate([search(graph, q[s : s + most], least, width) for s in range(0, len(q), most)])
    start = np.zeros((len(q), 1), np.int64)
    for _, links in graph.layers[:0:-1]:
        ids, _ = _beam(graph.x[: len(links)], links, q, start, 4, np.zeros((len(q), len(links)), bool))
        start = np.where(ids >= 0, ids, ids[:, :1])
    seen, hit = np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)
    links = graph.layers[0][1]
    ids, sims = _beam(graph.x, links, q, start, width, seen)
    at, k = np.nonzero(sims >= least)
    front = at, ids[at, k]
    hit[front] = True
    dense = (sims >= least).all(1)  # as many as the beam holds: it is made as wide as the graph, which is all products
    all_of = np.flatnonzero(dense)
    hit[all_of] = _close(q[all_of], graph.x, least)
    front = tuple(f[~dense[at]] for f in front)
    while len(front[0]):  # what was in the beam has been expanded already, but for what fell out of it
        found_at, found = [], []
        for s in range(0, len(front[0]), 1 << 14):
            rows, near = np.repeat(front[0][s : s + (1 << 14)], links.shape[1]), links[front[1][s : s + (1 << 14)]].ravel()
            some = np.flatnonzero((near >= 0) & ~hit[rows, near])
            code = np.unique(rows[some] * n + near[some])
            rows, near = code // n, code % n
            close = np.einsum("ij,ij->i", graph.x[near], q[rows]) >= least
            hit[rows[close], near[close]] = True
            found_at.append(rows[close])
            found.append(near[close])
        front = np.concatenate(found_at), np.concatenate(found)
    return hit


def _verified(hit: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """hit, without pairs whose cosine in double precision is below `least`."""
    for p in range(0, len(hit), PART):
        rows, nodes = np.nonzero(hit[p : p + PART])
        rows += p
        for s in range(0, len(rows), VERIFIED):
            r, k = rows[s : s + VERIFIED], nodes[s : s + VERIFIED]
            low = np.einsum("ij,ij->i", a[r], b[k]) < least
            hit[r[low], k[low]] = False
    return hit


def _blocks(n: int) -> list[slice]:
    return [slice(s, min(s + BLOCK, n)) for s in range(0, n, BLOCK)]


def _kept(hit: np.ndarray) -> np.ndarray:
    """A tile's bits: the places of those that are set, or all bits packed, whichever is less."""
    return np.flatnonzero(hit).astype(np.int32) if 32 * np.count_nonzero(hit) < hit.size else np.packbits(hit)


def _add(hit: np.ndarray, kept: np.ndarray) -> None:
    """Sets the bits of a tile that `_kept` made."""
    if kept.dtype == np.uint8:
        hit |= np.unpackbits(kept, count=hit.size).reshape(hit.shape).astype(bool)
    elif len(kept):
        hit[np.divmod(kept, hit.shape[1])] = True


def _found(graph: Graph, own: np.ndarray, q: np.ndarray, least: float, recall: float, seed: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of q and the bits (query, vector of the graph's shard) of the pairs found. own: the shard's vectors in double precision,
    as the graph has them."""
    single = q.astype(np.float32)
    some = np.sort(np.random.default_rng(seed).permutation(len(q))[:AUDITED])
    truth = _close(q[some], own, least)
    width = BEAM // 4
    while width < len(own):
        hit = search(graph, single[some], least - _SLACK, width)
        if (hit & truth).sum() >= recall * truth.sum():
            break
        width *= 2
    for block in _blocks(len(q)):
        hit = search(graph, single[block], least - _SLACK, width) if width < len(own) else _close(q[block], own, least - _SLACK)
        yield block, _verified(hit, q[block], own, least)


class _Forest:
    """Union of nodes; the root is the smallest node."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, k: np.ndarray) -> np.ndarray:
        while (self.up[k] != self.up[self.up[k]]).any():
            self.up[k] = self.up[self.up[k]]
        return self.up[k]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root(a), self.root(b)
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _pair(left: tuple, right: tuple | None, least: float, recall: float) -> pd.DataFrame:
    """Rows (node, links, root) of the vectors of two shards (node, copies, vectors, graph) that have a link; of one with itself if there
    is no right. Links count copies."""
    (a_id, a_n, a, a_graph), (b_id, b_n, b, b_graph) = left, right or left
    over = _blocks(len(a))
    # with itself the other direction is the transposed one
    back = [(block, [_kept(hit[:, o]) for o in over]) for block, hit in _found(a_graph, a, b, least, recall, 1 if right else 2)]
    links = [np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)]
    forest = _Forest(len(a) + (len(b) if right else 0))
    shift = len(a) if right else 0
    for k, (block, hit) in enumerate(_found(b_graph, b, a, least, recall, 2) if right else ((o, np.zeros((o.stop - o.start, len(a)), bool)) for o in over)):
        for other, tiles in back:
            _add(hit[:, other].T, tiles[k])
        if not right:
            for o, kept in zip(over, back[k][1], strict=True):
                _add(hit[:, o], kept)
            hit[np.arange(len(hit)), np.arange(block.start, block.stop)] = False
        for s in range(0, len(hit), PART):
            rows, nodes = np.nonzero(hit[s : s + PART])
            rows += block.start + s
            np.add.at(links[0], rows, b_n[nodes])
            if right:
                np.add.at(links[1], nodes, a_n[rows])
            forest.join(rows, nodes + shift)
    ids = np.concatenate([a_id, b_id]) if right else a_id
    n = np.concatenate(links) if right else links[0]
    root = ids[forest.root(np.arange(len(ids)))]
    return pd.DataFrame({"node": ids, "links": n, "root": root})[n > 0]


def _shards(units: DataFrame, most: int) -> DataFrame:
    """units with `shard`: those of one length are dealt evenly, by node, into FEWEST_SHARDS shards or more of `most` rows at most, about."""
    sizes = units.groupBy("length").count().collect()  # a row a length
    plan, first = [], 0
    for r in sorted(sizes):
        k = max(FEWEST_SHARDS, -(-r["count"] // (most - most // 8)))
        plan.append((r["length"], first, k))
        first += k
    lengths = units.sparkSession.createDataFrame(plan, "length int, first int, shards int")
    return units.join(F.broadcast(lengths), "length").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))


@contextlib.contextmanager
def _batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs inside sends Arrow batches of so many bytes at most; they are buffers outside the heap, some for each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_GRAPH = "shard int, first int, shards int, part int, nodes binary, copies binary, vectors binary, width int, ground binary, counts array<int>, links array<binary>"


def _graphs(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's graph in rows of PIECE vectors with their links on the lowest layer; the first row has the other layers."""
    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]  # first, so that no square is too large or small
    x /= np.sqrt(np.cumsum(x * x, axis=1)[:, -1:])
    order = np.argsort(pdf["node"].to_numpy())
    x = x[order]
    graph = build(x.astype(np.float32), int(pdf["shard"].iloc[0]))
    of = graph.layers[0][0]  # the graph's order
    nodes, copies = (pdf[c].to_numpy()[order][of].astype(np.int64) for c in ("node", "copies"))
    x, ground, upper = x[of], graph.layers[0][1].astype(np.int32), graph.layers[1:]
    head = [int(pdf[c].iloc[0]) for c in ("shard", "first", "shards")]
    rows = []
    for k, s in enumerate(range(0, len(x), PIECE)):
        nodes_, copies_, x_, ground_ = (v[s : s + PIECE].tobytes() for v in (nodes, copies, x, ground))
        rows.append((*head, k, nodes_, copies_, x_, x.shape[1], ground_, [] if k else [len(t) for _, t in upper], [] if k else [t.astype(np.int32).tobytes() for _, t in upper]))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _GRAPH.split(", ")])


def _read(rows: list[dict]) -> tuple:
    """A shard from its graph's rows, in order: its nodes, their copies, vectors and graph."""
    nodes, copies = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("nodes", "copies"))
    x = np.concatenate([np.frombuffer(r["vectors"], np.float64) for r in rows]).reshape(len(nodes), -1)
    ground = np.concatenate([np.frombuffer(r["ground"], np.int32) for r in rows]).reshape(len(nodes), -1)
    upper = [(np.arange(n), np.frombuffer(t, np.int32).reshape(n, -1)) for n, t in zip(rows[0]["counts"], rows[0]["links"], strict=True)]
    return nodes, copies, x, Graph(x.astype(np.float32), [(np.arange(len(nodes)), ground), *upper])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The one or two shards of each pair, from rows sorted by pair, shard and part."""
    pair, sides, rows = None, [], []
    for batch in batches:
        for k in range(batch.num_rows):
            r = {c: batch.column(c)[k] for c in batch.schema.names}
            r = {c: (v.as_buffer() if isinstance(v, pa.BinaryScalar) else v.as_py()) for c, v in r.items()}
            now = tuple(r["pair"].values())
            if rows and (now != pair or r["shard"] != rows[0]["shard"]):
                sides.append(_read(rows))
                rows = []
                if now != pair:
                    yield sides
                    sides = []
            pair = now
            rows.append(r)
        if rows:  # else they hold on to the batch
            rows = [{c: bytes(v) if isinstance(v, pa.Buffer) else v for c, v in r.items()} for r in rows]
    if rows:
        yield [*sides, _read(rows)]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, recall: float = 0.99, most: int = MOST_ROWS) -> DataFrame:
    """(id, n_links, component, kept) of each row: how many others have a cosine of `least` or more, and the smallest id that links lead to."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("v")
    rows = written(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("row", F.monotonically_increasing_id()))
    top = F.array_max(F.transform(v, F.abs))
    sound = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & (F.coalesce(top, F.lit(0.0)) > 0)
    good = rows.where(sound)
    units = good.groupBy("v").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    units = written(units.select("node", "copies", F.size("v").alias("length"), "v"))
    dealt = _shards(units, most)
    n_shards = max(1, dealt.agg(F.max(F.col("first") + F.col("shards"))).first()[0] or 1)
    graphs = written(dealt.repartitionByRange(n_shards, "shard").groupBy("shard").applyInPandas(_graphs, _GRAPH))
    # every two shards of one length, and each with itself: a pair has the rows of one shard or two
    other = F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)
    met = graphs.withColumn("other", F.explode(other)).withColumn("pair", F.struct(F.least("shard", "other").alias("a"), F.greatest("shard", "other").alias("b")))
    tasks = met.repartitionByRange(min(n_shards * (n_shards + 1) // 2, MOST_TASKS), "pair").sortWithinPartitions("pair", "shard", "part")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sides in _sides(batches):
            yield pa.RecordBatch.from_pandas(_pair(sides[0], sides[1] if len(sides) > 1 else None, least, recall), preserve_index=False)

    with _batches_of(spark, BATCH_BYTES):
        found = written(tasks.mapInArrow(both, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = units.join(links, "node", "left").join(classes.withColumnRenamed("component", "class"), "node", "left")
    known = written(known.select(v, "copies", F.coalesce("class", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked = join_sized(good, known, ["v"], "copies", good.count()).select("id", "class", "n_links")
    linked = written(linked)
    least_ids = written(linked.groupBy("class").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("members")))
    named = join_sized(linked, least_ids, ["class"], "members", linked.count()).select("id", "n_links", "component")
    alone = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return named.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
