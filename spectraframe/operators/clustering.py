"""Clustering and reduction (C1 to C6). K-means makes all its starts at once, PCA is Spark ML's; Ward's linkage merges all mutually nearest clusters at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .evaluate import met
from .tables import discard, written

#: Beyond this number of samples the jobs leave the hierarchical clustering out.
MOST_WARD = 10_000
#: So many clusters are merged in one place, by a matrix of all pairs: 32 MB.
FEW_CLUSTERS = 2_000
#: After the first round, so many clusters go on in one task, round by round: 16 MB at 64 numbers each.
TASK_CLUSTERS = 32_768
#: Most clusters of a block in the search for the nearest ones: 16 MB at 64 numbers each.
WARD_BLOCK = 32_768
#: Clusters of two blocks whose distances are numbers at once: 2 MB.
WARD_TILE = 256, 2048
#: Pairs whose distances are worked out from differences at once.
WARD_PAIRS = 1 << 14


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start (first axis of centres) and row, the nearest centre, the first of equals, and the squared distance."""
    starts, k, d = centres.shape
    d2 = (x * x).sum(1)[None, :, None] - 2 * (x @ centres.reshape(-1, d).T).reshape(len(x), starts, k).transpose(1, 0, 2) + (centres * centres).sum(2)[:, None, :]
    near = d2.argmin(2)
    diff = x[None] - np.take_along_axis(centres, near[:, :, None], 1)
    return near, np.einsum("sij,sij->si", diff, diff)


def _rows(px: pa.Array) -> np.ndarray:
    """A matrix of arrays of one length, without a Python object a number."""
    return px.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(px), -1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return _rows(batch.column("px"))


def _scan(rows: DataFrame, centres: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """One pass for all starts, which can have different numbers of centres: each one's rows a centre, their sums, and the cost. A task sends a
    row a start: a number a centre and coordinate; there is no shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(c)) for c in centres]
        sums = [np.zeros(c.shape) for c in centres]
        cost = np.zeros(len(centres))
        for batch in batches:
            x = _matrix(batch)
            for s, c in enumerate(centres):
                near, d2 = _nearest(x, c[None])
                member = (near[0][None] == np.arange(len(c))[:, None]).astype(float)
                n[s] += member.sum(1)
                sums[s] += member @ x
                cost[s] += d2.sum()
        found = [np.concatenate([[cost[s]], n[s], sums[s].ravel()]).tolist() for s in range(len(centres))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["s", "v"])

    out = [np.zeros(1 + len(c) + c.size) for c in centres]
    for r in rows.select("px").mapInArrow(partial, "s int, v array<double>").collect():  # a row a start and task
        out[r["s"]] += r["v"]
    return [o[1 : 1 + len(c)] for o, c in zip(out, centres, strict=True)], [o[1 + len(c) :].reshape(c.shape) for o, c in zip(out, centres, strict=True)], np.array([o[0] for o in out])


def _chosen(rows: DataFrame, centres: list[np.ndarray], cost: np.ndarray, step: int, seed: int, rate: float) -> list[np.ndarray]:
    """For each start, rows taken with a chance of `rate` times their share of the cost: about `rate` of them."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            u = (batch.column("u").to_numpy().astype(np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(len(centres), dtype=np.uint64)[:, None] + np.uint64(1 + 1000 * step)) * np.uint64(0xBF58476D1CE4E5B9))
            u ^= u >> np.uint64(31)
            u *= np.uint64(0x94D049BB133111EB)
            chance = (u >> np.uint64(11)) / 2.0**53
            out = [(s, x[i].tolist()) for s, c in enumerate(centres) for i in np.flatnonzero(chance[s] * cost[s] < rate * _nearest(x, c[None])[1][0])]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([v for _, v in out], pa.list_(pa.float64()))], ["s", "px"])

    keyed = rows.select("px", F.xxhash64("id", F.lit(seed)).alias("u"))
    found = sorted(map(tuple, keyed.mapInArrow(take, "s long, px array<double>").collect()))  # some `rate` rows a start
    return [np.array([*c, *(v for s, v in found if s == k)]) for k, c in enumerate(centres)]


def _spread(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of a few weighted points, each likely as it is far from those before; then some steps over these points alone."""
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < k:
        d2 = weights * _nearest(points, np.array(chosen)[None])[1][0]
        chosen.append(points[rng.choice(len(points), p=d2 / d2.sum())] if d2.sum() > 0 else points[len(chosen) % len(points)])
    centres = np.array(chosen)
    for _ in range(10):
        near = _nearest(points, centres[None])[0][0]
        for j in range(k):
            if (own := weights * (near == j)).sum() > 0:
                centres[j] = own @ points / own.sum()
    return centres


def lloyd(rows: DataFrame, centres: list[np.ndarray], steps: int = 100, tolerance: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Lloyd's steps of all starts over (id, px), one scan a step for all of them that still move: each start goes on until none of its centres
    moves by more than the tolerance. The centres, each start's cost, and the number of scans. A centre without rows stays where it is."""
    centres, cost, scans, going = list(centres), np.zeros(len(centres)), 0, list(range(len(centres)))
    while going:
        n, sums, found = _scan(rows, [centres[s] for s in going])
        scans += 1
        cost[going] = found
        moved = [np.where(m[:, None] > 0, v / np.maximum(m, 1)[:, None], centres[s]) for m, v, s in zip(n, sums, going, strict=True)]
        still = [] if scans > steps else [(s, c) for s, c in zip(going, moved, strict=True) if np.abs(c - centres[s]).max() > tolerance]
        for s, c in still:
            centres[s] = c
        going = [s for s, _ in still]
    return centres, cost, scans


def kmeans(vectors: DataFrame, k: int = 3, n_init: int = 10, seed: int = 42, rounds: int = 2) -> tuple[DataFrame, list[list[float]], float]:
    """(id, px, .., cluster), the centres and the inertia of the best of n_init starts. All starts share each scan: those that choose
    them (k-means||, some 2 k rows a start and round), and Lloyd's steps."""
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism  # each sends its sums to the driver, each scan
    rows = vectors.select("id", "px").coalesce(tasks).persist()
    try:
        first = rows.agg(*[F.min_by("px", F.struct(F.xxhash64("id", F.lit(seed + s)), "id")).alias(f"c{s}") for s in range(n_init)]).first()
        if first[0] is None:
            return vectors.withColumn("cluster", F.lit(None).cast("int")), [], 0.0
        centres = [np.array([c], float) for c in first]
        for step in range(rounds):
            cost = _scan(rows, centres)[2]
            centres = _chosen(rows, centres, cost, step, seed, 2.0 * k)
        weights = _scan(rows, centres)[0]
        centres = [_spread(c, w, k, np.random.default_rng([seed, s])) for s, (c, w) in enumerate(zip(centres, weights, strict=True))]
        centres, cost, _ = lloyd(rows, centres)
        best = int(np.argmin(cost))
        return with_clusters(vectors, centres[best]), centres[best].tolist(), float(cost[best])
    finally:
        rows.unpersist()


def with_clusters(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors and `cluster`, the nearest centre's number, the first of equals."""

    def distance(c: np.ndarray) -> Column:
        return F.aggregate(F.zip_with("px", F.array(*map(F.lit, c.tolist())), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, d: a + d)

    return vectors.withColumn("cluster", F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]))["k"])


def ward_linkage(x: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Merges (a, b, distance, size) by the recurrence of Lance and Williams, nearest pair first; x can be the centroids of clusters of
    these sizes."""
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(-1).astype(float) if n * n * x.shape[1] < 5e7 else np.array([((x - row) ** 2).sum(1) for row in x])
    size, name, live = np.ones(n) if sizes is None else sizes.astype(float), np.arange(n), np.ones(n, bool)
    if sizes is not None:
        d *= 2 * size[:, None] * size[None] / (size[:, None] + size[None])
    np.fill_diagonal(d, np.inf)
    out = np.zeros((max(0, n - 1), 4))
    near = d.argmin(1) if n else np.zeros(0, int)  # of each row, the first of equals
    best = d[np.arange(n), near]
    for step in range(n - 1):
        i = int(np.argmin(best))
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        a, b = sorted((name[i], name[j]))
        out[step] = a, b, np.sqrt(d[i, j]), size[i] + size[j]
        others = live.copy()
        others[[i, j]] = False
        t = size[i] + size[j] + size[others]
        d[i, others] = ((size[i] + size[others]) * d[i, others] + (size[j] + size[others]) * d[j, others] - size[others] * d[i, j]) / t
        d[others, i] = d[i, others]
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        name[i], live[j] = n + step, False
        lost = np.flatnonzero((near == i) | (near == j))
        lost = np.union1d(lost, [i, j])
        near[lost] = d[lost].argmin(1)
        best[lost] = d[lost, near[lost]]
        nearer = (d[:, i] < best) | ((d[:, i] == best) & (i < near))
        near[nearer], best[nearer] = i, d[nearer, i]
    return out


def cut(linkage: np.ndarray, n: int, k: int) -> np.ndarray:
    """The labels of k clusters, numbered by their first member."""
    parent = list(range(2 * n))

    def root(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    for step in range(n - k):
        a, b = linkage[step, :2].astype(int)
        parent[a] = parent[b] = n + step
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(i), len(seen)) for i in range(n)])


class _Side:
    """Clusters that look for their nearest one: (ids, sizes, centroids), and what each has found so far."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray):
        self.id, self.n, self.x = ids, n.astype(float), x
        self.d2 = np.full(len(self.id), np.inf)
        self.lo, self.hi = np.full((2, len(self.id)), np.iinfo(np.int64).max)

    def exact(self, other: _Side, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(r))
        for s in range(0, len(r), WARD_PAIRS):
            p, q = r[s : s + WARD_PAIRS], c[s : s + WARD_PAIRS]
            out[s : s + WARD_PAIRS] = 2 * self.n[p] * other.n[q] / (self.n[p] + other.n[q]) * ((self.x[p] - other.x[q]) ** 2).sum(1)
        return out

    def look(self, other: _Side, least: np.ndarray, row: int, column: int, unit: float) -> None:
        """Takes the nearest clusters of a tile, which begins at row and column and has bounds in single precision that no distance is below."""

        def limit(d2: np.ndarray) -> np.ndarray:
            return (d2 / unit * (1 + 1e-6)).astype(np.float32)

        low = least.min(1)
        some = np.flatnonzero((low <= limit(self.d2[row : row + len(least)])) & (low < np.inf))
        if not len(some):
            return
        bounds = least[some]
        k = bounds.argmin(1)
        first = np.minimum(self.exact(other, some + row, k + column), self.d2[some + row])
        close = (bounds <= limit(first)[:, None]) & (bounds < np.inf)
        close[np.arange(len(k)), k] = True
        r, c = np.nonzero(close)
        r, c = some[r] + row, c + column
        d2, lo, hi = self.exact(other, r, c), np.minimum(self.id[r], other.id[c]), np.maximum(self.id[r], other.id[c])
        order = np.lexsort((hi, lo, d2, r))
        order = order[np.unique(r[order], return_index=True)[1]]
        r, d2, lo, hi = (v[order] for v in (r, d2, lo, hi))
        better = (d2 < self.d2[r]) | ((d2 == self.d2[r]) & ((lo < self.lo[r]) | ((lo == self.lo[r]) & (hi < self.hi[r]))))
        r = r[better]
        self.d2[r], self.lo[r], self.hi[r] = d2[better], lo[better], hi[better]


def _meet(x: _Side, y: _Side, both: bool) -> None:
    """The nearest clusters of x among y, and with both those of y among x. Bounds come from products in single precision, less what their
    rounding can add; only pairs that they leave are worked out, from differences in double precision."""
    top = max(np.abs(x.x).max(initial=0), np.abs(y.x).max(initial=0)) or 1.0
    a, b = x.x / top, y.x / top
    less = 1 - 4 * (a.shape[1] + 8) * 2.0**-24
    one = np.ones
    left = np.concatenate([a, less * (a * a).sum(1)[:, None], one((len(a), 1))], 1).astype(np.float32)
    right = np.concatenate([-2 * b, one((len(b), 1)), less * (b * b).sum(1)[:, None]], 1).astype(np.float32)
    single = (x.n == 1).all() and (y.n == 1).all()
    n, m = (0.5 / x.n).astype(np.float32), (0.5 / y.n).astype(np.float32)
    place = np.argsort(y.id)
    own = place[np.minimum(np.searchsorted(y.id, x.id, sorter=place), len(place) - 1)]
    own = np.where(y.id[own] == x.id, own, -1)
    for i in range(0, len(a), WARD_TILE[0]):
        rows = slice(i, i + WARD_TILE[0])
        for j in range(0, len(b), WARD_TILE[1]):
            columns = slice(j, j + WARD_TILE[1])
            least = left[rows] @ right[columns].T
            if not single:
                least /= n[rows, None] + m[None, columns]
            k = np.flatnonzero((own[rows] >= j) & (own[rows] < j + WARD_TILE[1]))
            least[k, own[rows][k] - j] = np.inf
            x.look(y, least, i, j, top * top)
            if both:
                y.look(x, least.T, j, i, top * top)


def _nearest_clusters(some: DataFrame | None, clusters: DataFrame) -> DataFrame:
    """(id, nn, d2): the nearest other cluster of some (None: of all, each two blocks meet once) by Ward's squared distance
    2 n m / (n + m) |x - y|^2; of equally near pairs the first."""

    def near(x: pa.Table, y: pa.Table) -> pa.RecordBatch:
        sides = [_Side(t.column("id").to_numpy(), t.column("n").to_numpy(), _rows(t.column("px").combine_chunks())) for t in (x, y)]
        both = halves and set(sides[0].id[:1]).isdisjoint(sides[1].id)  # a block meets itself, or another
        if len(x) and len(y):
            _meet(*sides, both)
        found = [[v[s.d2 < np.inf] for v in (s.id, s.d2, s.lo, s.hi)] for s in (sides if both else sides[:1])]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["id", "d2", "lo", "hi"])

    def blocks(n: int) -> int:
        return max(1, min(8, n // 512), -(-n // WARD_BLOCK))

    halves = some is None
    some = clusters if halves else some
    n = clusters.count()
    rows = [blocks(n if halves else some.count()), blocks(n)]
    b, o = (F.pmod(F.xxhash64("id"), F.lit(r)).cast("int") for r in rows)
    left = some.select(F.lit(0).alias("g"), b.alias("b"), F.explode(F.sequence(b if halves else F.lit(0), F.lit(rows[1] - 1))).alias("o"), "id", "n", "px", F.lit(0).alias("inner"))
    right = clusters.select(F.lit(0).alias("g"), F.explode(F.sequence(F.lit(0), o if halves else F.lit(rows[0] - 1))).alias("b"), o.alias("o"), "id", "n", "px", F.lit(1).alias("inner"))
    best = met(left.unionByName(right), near, "id long, d2 double, lo long, hi long").groupBy("id").agg(F.min(F.struct("d2", "lo", "hi")).alias("p"))
    return best.select("id", F.when(F.col("p.lo") == F.col("id"), F.col("p.hi")).otherwise(F.col("p.lo")).alias("nn"), F.col("p.d2").alias("d2"))


_MERGES = "a long, b long, a_made int, b_made int, round int, h double, size long"


def _task_rounds(clusters: DataFrame, few: int, turn: int) -> DataFrame:
    """The rounds of `_ward_rounds` over a bounded number of clusters, in one task without a table a round: the merges, and the last few clusters
    as rows with px (a: id, a_made: made)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([*batches]).sort_by("id")
        ids, made, n, h, nn, d2 = (t.column(c).combine_chunks().fill_null(-1).to_numpy().copy() for c in ("id", "made", "n", "h", "nn", "d2"))
        x, lost, now, out = _rows(t.column("px").combine_chunks()), t.column("nn").is_null().to_numpy(), turn, []
        while len(ids) > few:
            new = np.flatnonzero(lost)
            side = _Side(ids[new], n[new], x[new])
            _meet(side, _Side(ids, n, x), False)
            nn[new], d2[new] = np.where(side.lo == side.id, side.hi, side.lo), side.d2
            to = np.searchsorted(ids, nn)
            i = np.flatnonzero((ids < nn) & (nn[to] == ids))
            j = to[i]
            size, top = n[i] + n[j], np.maximum(np.maximum(d2[i], h[i]), h[j])
            out.append((ids[i], ids[j], made[i], made[j], np.full(len(i), now), top, size))
            x[i] = (n[i, None] * x[i] + n[j, None] * x[j]) / size[:, None]
            n[i], h[i], made[i] = size, top, now
            gone = np.zeros(len(ids), bool)
            gone[i] = gone[j] = True
            lost = gone | gone[to]
            left = np.ones(len(ids), bool)
            left[j] = False
            ids, made, n, h, nn, d2, x, lost = (v[left] for v in (ids, made, n, h, nn, d2, x, lost))
            now += 1
        types = [f.type for f in schema]
        merges = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 7
        yield pa.RecordBatch.from_arrays([*(pa.array(c, type=k) for c, k in zip(merges, types, strict=False)), pa.nulls(len(merges[0]), types[-1])], schema=schema)
        last = [ids, np.full(len(ids), -1), made, np.full(len(ids), -1), np.full(len(ids), now), h, n, x.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(last, types, strict=True)], schema=schema)

    kind = _MERGES + ", px array<double>"
    schema = pa.schema([*((f.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[f.split()[1]]) for f in _MERGES.split(", ")), ("px", pa.list_(pa.float64()))])
    return written(clusters.select("id", "made", "n", "h", "nn", "d2", "px").repartition(1).mapInArrow(run, kind))


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with their place `at` in the order of the keys, from 0: a range sort, and a count a partition."""
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")))
    counts = sorted(map(tuple, placed.groupBy("part").count().collect()))  # a row a partition
    starts = [(p, sum(n for _, n in counts[:k])) for k, (p, _) in enumerate(counts)]
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long"))
    return placed.join(start, "part").withColumn("at", F.col("start") + F.col("k")).drop("part", "k", "start")


def _ward_rounds(vectors: DataFrame) -> DataFrame:
    """(a, b, a_made, b_made, round, h, size): all merges of Ward's linkage over (id, px), distributed; h is the squared distance. A cluster has
    the id of its first member, and `made` is the round that made it (0: a single row), so (a, a_made) and (b, b_made) name what is merged,
    and (a, round) what comes of it.

    Two clusters that are each other's nearest are merged sooner or later whatever else is, as no merge brings a cluster nearer to others
    (Ward's distance is reducible): each round merges all such pairs, and only clusters that are new, or have lost their nearest one, search
    again. Equal vectors are merged first. After the first round at least, a bounded number of clusters goes on in one task, and the last few
    are merged in one place."""
    same = Window.partitionBy("px").orderBy("id")
    copies = written(vectors.select(F.col("id").cast("long").alias("id"), "px", F.min("id").over(same).cast("long").alias("first"), F.row_number().over(same).alias("k")))
    last = copies.agg(F.max("k")).first()[0]
    merges = [copies.where("k > 1").select(F.col("first").alias("a"), F.col("id").alias("b"), (F.col("k") - 2).alias("a_made"), F.lit(0).alias("b_made"), (F.col("k") - 1).alias("round"), F.lit(0.0).alias("h"), F.col("k").cast("long").alias("size"))]
    most = copies.groupBy("first").agg(F.max("k").alias("n"))
    clusters = copies.where("k = 1").join(most, "first").select("id", "px", F.col("n").cast("long").alias("n"), (F.col("n") - 1).cast("int").alias("made"), F.lit(0.0).alias("h"), F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("d2"))
    clusters, turn, first = written(clusters), int(last), True
    left = clusters.count()
    while left > (FEW_CLUSTERS if first else max(FEW_CLUSTERS, TASK_CLUSTERS)):
        found = _nearest_clusters(None if first else clusters.where("nn IS NULL").select("id", "n", "px"), clusters.select("id", "n", "px"))
        first = False
        now = written(clusters.drop("nn", "d2").join(clusters.where("nn IS NOT NULL").select("id", "nn", "d2").unionByName(found), "id"))
        other = now.select(*[F.col(c).alias(f"{c}2") for c in ("id", "px", "n", "made", "h", "nn")])
        pairs = now.where("id < nn").join(other, (F.col("nn") == F.col("id2")) & (F.col("nn2") == F.col("id")))
        size = F.col("n") + F.col("n2")
        mean = F.zip_with("px", "px2", lambda x, y: (F.col("n") * x + F.col("n2") * y) / size)
        made = written(pairs.select(F.col("id").alias("a"), F.col("id2").alias("b"), F.col("made").alias("a_made"), F.col("made2").alias("b_made"), F.lit(turn).alias("round"), F.greatest("d2", "h", "h2").alias("h"), size.alias("size"), mean.alias("px")))
        merges.append(made.drop("px"))
        left -= made.count()
        gone = made.select(F.explode(F.array("a", "b")).alias("gone"))
        kept = now.join(gone, F.col("id") == F.col("gone"), "left_anti").join(gone, F.col("nn") == F.col("gone"), "left")
        kept = kept.select("id", "px", "n", "made", "h", F.when(F.col("gone").isNull(), F.col("nn")).alias("nn"), F.when(F.col("gone").isNull(), F.col("d2")).alias("d2"))
        new = made.select(F.col("a").alias("id"), "px", F.col("size").alias("n"), F.col("round").alias("made"), "h", F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("d2"))
        old, clusters = clusters, written(kept.unionByName(new))
        discard(old, now)
        turn += 1
    last = clusters.select(F.col("id").alias("a"), F.col("made").alias("a_made"), F.lit(turn).alias("round"), "h", F.col("n").alias("size"), "px")
    if left > FEW_CLUSTERS:
        done = _task_rounds(clusters, FEW_CLUSTERS, turn)
        merges.append(done.where("px IS NULL").drop("px"))
        last = done.where("px IS NOT NULL")
    rest = sorted(last.select(F.col("a").alias("id"), F.col("size").alias("n"), F.col("a_made").alias("made"), "h", "px", "round").collect())  # FEW_CLUSTERS at most
    turn = max([turn, *(r["round"] for r in rest)])
    names, done = [[r["id"], r["made"], r["h"]] for r in rest], []
    for a, b, d, n in ward_linkage(np.array([r["px"] for r in rest], float).reshape(len(rest), -1), np.array([r["n"] for r in rest])):
        (i, i_made, i_h), (j, j_made, j_h) = sorted((names[int(a)], names[int(b)]))
        h = max(float(d) ** 2, i_h, j_h)
        done.append((i, j, i_made, j_made, turn, h, int(n)))
        names.append([i, turn, h])
        turn += 1
    out = vectors.sparkSession.createDataFrame(done, _MERGES)
    for m in merges:
        out = out.unionByName(m)
    return out


def ward(vectors: DataFrame, k: int | None = 3) -> tuple[DataFrame | None, DataFrame]:
    """(id, cluster), or None without k, and the merges (step, a, b, distance, size). Few rows are merged in one place, more in rounds over
    all pairs of blocks of clusters."""
    rows = vectors.select("id", "px").orderBy("id").limit(FEW_CLUSTERS + 1).collect()  # a bounded number
    spark = vectors.sparkSession
    if len(rows) > FEW_CLUSTERS:
        leaves = _numbered(vectors.select("id"), "id")
        n = leaves.count()
        steps = written(_numbered(_ward_rounds(vectors), "h", "round", "a"))
        name = steps.select(F.col("a").alias("id"), F.col("round").alias("made"), (F.col("at") + n).alias("name")).unionByName(leaves.select("id", F.lit(0).alias("made"), F.col("at").alias("name")))
        left, right = (name.select(F.col("id").alias(c), F.col("made").alias(f"{c}_made"), F.col("name").alias(f"{c}_name")) for c in ("a", "b"))
        named = steps.join(left, ["a", "a_made"]).join(right, ["b", "b_made"])
        merges = named.select(F.col("at").cast("int").alias("step"), F.least("a_name", "b_name").cast("int").alias("a"), F.greatest("a_name", "b_name").cast("int").alias("b"), F.sqrt("h").alias("distance"), F.col("size").cast("int").alias("size"))
        if k is None:
            return None, merges
        roots = graph.components(steps.where(F.col("at") < n - k).select(F.lit(0).alias("group"), F.col("a").alias("u"), F.col("b").alias("v")))
        rooted = leaves.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        firsts = sorted(r[0] for r in rooted.select("root").distinct().collect())  # k rows
        numbers = F.broadcast(spark.createDataFrame([(r, c) for c, r in enumerate(firsts)], "root long, cluster int"))
        return rooted.join(numbers, "root").select("id", "cluster"), merges
    links = ward_linkage(np.array([r["px"] for r in rows], float))
    labels = cut(links, len(rows), min(k or 1, len(rows)))
    merges = [(s, int(a), int(b), float(d), int(n)) for s, (a, b, d, n) in enumerate(links)]
    named = spark.createDataFrame([(r["id"], int(c)) for r, c in zip(rows, labels, strict=True)], "id long, cluster int") if k else None
    return named, spark.createDataFrame(merges, "step int, a int, b int, distance double, size int")


def dendrogram(merges: DataFrame, leaves: int, most: int = 50) -> DataFrame:
    """The merges to draw: the last `most` if there are more leaves."""
    return merges.orderBy(F.desc("step")).limit(most if leaves > most else leaves)


def pca(vectors: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(id, pc) of vectors that are standardised already, and the share of variance of each component. A component's sign
    is that of its largest loading."""
    rows = vectors.withColumn("v", array_to_vector("px"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.argmax(np.abs(loadings[:, i])), i])) for i in range(k)]
    out = model.transform(rows).withColumn("p", vector_to_array("p"))
    return out.select("id", F.array(*[F.get("p", i) * signs[i] for i in range(k)]).alias("pc")), model.explainedVariance.toArray().tolist()
