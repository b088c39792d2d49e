"""Mixing sources to target weights, as a min-cost flow.

Documents that belong to the same set of sources are one pattern, whose size is the sum of theirs: the flow is over
patterns, not documents. Each pattern's capacity can be used `repeats` times, the k-th time at cost k - 1 for a token,
a convex cost, so nothing is repeated before what isn't. Patterns lead to their sources, sources to their quotas. The
flow says how many tokens of each pattern the mix takes; whole rounds take every document, the rest takes documents
in the order of a seeded hash until the pattern's tokens are there.

Only one row a pattern is gathered on the driver; more than MOST_PATTERNS is an error, not a cut. That order is not
sorted: sums by hash bucket find each pattern's last bucket, and only that bucket's few rows are sorted.

Defined cases: null text has size 0; null is a source (the last); an empty set of sources is never taken; documents of
size 0 take 0; rows that share a doc_id are taken alike; other columns stay as they are, but input columns named own_sources or
copies are replaced.
"""

from __future__ import annotations

import math
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import SPACE_CLASS, bounded, discard, ship, written

MOST_PATTERNS = 200_000
BUCKET_ROWS, MOST_BUCKET_BITS = 256, 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def quotas(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, repeats: int) -> dict[str | None, float]:
    """Each source's target: `share` of all sizes, by weight; none above `repeats` times its size, what is over being
    shared out anew among the rest."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, order
    while open_:
        total = sum(weight[s] for s in open_)
        goal = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if goal[s] > repeats * sizes[s]]
        if not full:
            return out | goal
        for s in full:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in set(full)]
    return out


def min_cost_flow(capacity: list[int], members: list[tuple[int, ...]], quota: list[int], repeats: int) -> list[dict[int, int]]:
    """Tokens that each pattern sends to each of its sources: as many as can be, at the least cost. A path costs what its
    pattern's repetition costs, and those are the same for all patterns, so a cheapest path is one of the lowest
    repetition that still has one: each repetition's capacity is added in turn, and shortest paths by arcs are
    filled phase by phase (blocking flows) until none is left."""
    n_p, n_s = len(capacity), len(quota)
    source, sink = n_p + n_s, n_p + n_s + 1
    to, cap, out = [], [], [[] for _ in range(n_p + n_s + 2)]

    def arc(a: int, b: int, c: int) -> None:
        for x, y, k in ((a, b, c), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)

    for p in range(n_p):
        arc(source, p, 0)
    first = len(to)
    for p in range(n_p):
        for s in members[p]:
            arc(p, n_p + s, repeats * capacity[p])
    last = len(to)
    for s in range(n_s):
        arc(n_p + s, sink, quota[s])

    def depths() -> list[int]:
        depth, queue = [-1] * len(out), deque([source])
        depth[source] = 0
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] and depth[to[e]] < 0:
                    depth[to[e]] = depth[x] + 1
                    queue.append(to[e])
        return depth

    for _ in range(repeats):
        for p in range(n_p):
            cap[2 * p] += capacity[p]
        while (depth := depths())[sink] >= 0:
            at, path, x = [0] * len(out), [], source
            while True:
                if x == sink:
                    amount = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= amount
                        cap[e ^ 1] += amount
                    path = path[: next(k for k, e in enumerate(path) if not cap[e])]
                    x = to[path[-1]] if path else source
                while at[x] < len(out[x]) and not (cap[out[x][at[x]]] and depth[to[out[x][at[x]]]] == depth[x] + 1):
                    at[x] += 1
                if at[x] < len(out[x]):
                    path.append(out[x][at[x]])
                    x = to[path[-1]]
                elif path:
                    x = to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break
    sent: list[dict[int, int]] = [{} for _ in range(n_p)]
    for e in range(first, last, 2):
        if cap[e ^ 1]:
            sent[to[e ^ 1]][to[e] - n_p] = cap[e ^ 1]
    return sent


def mix(docs: DataFrame, sources: Column, size: Column, order: list[Column], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17) -> tuple[DataFrame, list[dict]]:
    """docs with own_sources (array) and copies (0 to `repeats`), and each source's size and target. `sources`: an array of the
    document's sources. `order`: what names a document for the seeded order; rows of one name are taken alike."""
    spark = docs.sparkSession
    ship(spark)
    own = {"own_sources": F.array_sort(F.array_distinct(sources)), "own_hash": F.xxhash64(F.lit(seed), *order)}
    marked = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("own_row"), *[c.alias(n) for n, c in own.items()])
    rows = written(docs.select(*[c.alias(n) for n, c in own.items()], size.alias("own_size")))
    patterns = [r.asDict() for r in rows.groupBy("own_sources").agg(F.sum("own_size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()]
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} combinations of sources; name coarser sources")
    patterns.sort(key=lambda p: [(s is None, s or "") for s in p["own_sources"] or ()])
    sizes: dict[str | None, int] = {}
    for p in patterns:
        for s in p["own_sources"] or ():
            sizes[s] = sizes.get(s, 0) + p["size"]
    target = quotas(sizes, weights, share, repeats)
    number = {s: k for k, s in enumerate(target)}
    sent = min_cost_flow([p["size"] for p in patterns], [tuple(number[s] for s in p["own_sources"] or ()) for p in patterns], [round(target[s]) for s in target], repeats)
    bits = min(MOST_BUCKET_BITS, max(0, math.ceil(math.log2(max([1, *(p["n"] for p in patterns)]) / BUCKET_ROWS))))
    plan = []
    for p, out in zip(patterns, sent, strict=True):
        tokens = sum(out.values())
        whole = min(repeats, tokens // p["size"]) if p["size"] else 0
        plan.append((p["own_sources"], whole, tokens - whole * p["size"]))
    bucket = F.lit(0) if not bits else F.shiftrightunsigned("own_hash", 64 - bits).cast("int")

    def planned(df: DataFrame, table: DataFrame) -> DataFrame:
        """df with the columns of a row-a-pattern table (MOST_PATTERNS rows at most)."""
        return df.join(F.broadcast(table.withColumnRenamed("own_sources", "own_p")), F.col("own_sources").eqNullSafe(F.col("own_p")), "left").drop("own_p")

    plan_df = spark.createDataFrame(plan, f"own_sources {rows.schema['own_sources'].dataType.simpleString()}, own_whole int, own_more long")
    placed = planned(rows.withColumn("own_bucket", bucket), plan_df)
    sums = placed.groupBy("own_sources", "own_bucket", "own_more").agg(F.sum("own_size").alias("size"))
    sums = sums.withColumn("own_before", F.sum("size").over(Window.partitionBy("own_sources").orderBy("own_bucket")) - F.col("size"))
    last = sums.where("own_before < own_more AND own_before + size >= own_more").select("own_sources", F.col("own_bucket").alias("own_last"), "own_before")
    plan_df = written(planned(plan_df, last))
    # the last bucket's documents, one row a name: taken while they fit
    at_end = planned(rows.withColumn("own_bucket", bucket), plan_df).where("own_bucket = own_last").groupBy("own_sources", "own_hash", "own_more", "own_before").agg(F.sum("own_size").alias("own_size"))
    chosen = at_end.groupBy("own_sources").applyInArrow(_filled, StructType([*at_end.schema.fields, StructField("own_extra", IntegerType())])).where("own_extra = 1")
    chosen = bounded(written(chosen.select(F.col("own_sources").alias("own_p"), F.col("own_hash").alias("own_h"), "own_extra")))
    discard(spark, rows)
    every = planned(marked.withColumn("own_bucket", bucket), plan_df.drop("own_more", "own_before"))
    every = every.join(chosen, F.col("own_sources").eqNullSafe(F.col("own_p")) & (F.col("own_hash") == F.col("own_h")), "left")
    extra = F.when(F.col("own_bucket") < F.col("own_last"), 1).otherwise(F.coalesce("own_extra", F.lit(0)))
    every = every.withColumn("copies", F.coalesce(F.least(F.lit(repeats), F.col("own_whole") + extra), F.lit(0)))
    kept = [F.col("own_row")[c].alias(c) for c in docs.columns if c not in ("own_sources", "copies")]
    return every.select(*kept, "own_sources", "copies"), [{"source": s, "size": sizes[s], "target": t} for s, t in target.items()]


def _filled(bucket: pa.Table) -> pa.Table:
    """Of a pattern's last bucket, in the seeded order, the documents that still fit, and one more if that comes nearer."""
    bucket = bucket.sort_by([("own_hash", "ascending")])
    sizes, left = bucket.column("own_size").to_pylist(), 0
    if sizes:
        left = bucket.column("own_more")[0].as_py() - bucket.column("own_before")[0].as_py()
    extra = [0] * len(sizes)
    for k, size in enumerate(sizes):
        if size <= left:
            extra[k], left = 1, left - size
    over = min((size for k, size in enumerate(sizes) if not extra[k]), default=None)
    if over is not None and over - left < left:
        extra[next(k for k, size in enumerate(sizes) if not extra[k] and size == over)] = 1
    return bucket.append_column("own_extra", pa.array(extra, pa.int32()))


def mix_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The documents that the mix takes, one row for each time, with their own columns."""
    own = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    out, _ = mix(own, F.array(name[source_col]), n_words(F.col(name[text_col])), [F.col(name[id_col])])
    out = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(name[c]).alias(c) for c in docs.columns])
