"""Near duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

A document's set is its distinct `words`-word shingles, A-Z lower-cased. Documents with one set are one class, and
go on as one representative (the smallest doc_id). One hash of each shingle gives all `bands * rows` minima: its
upper bits choose the bin. An empty bin copies a full one, found by hashing (bin, attempt) until it is full, so
signatures of small sets keep the right collision rates. Representatives that share a band meet in a bucket.

A bucket's candidates are a star: its smallest document against each other one, so their number is linear in the
bucket. Sets whose sizes rule out the threshold are left out; the rest are confirmed on full sets. What stars can miss is
a link between two leaves in different components of what was found. So in each bucket whose leaves lie in several
components, all leaves outside the largest one are compared with all leaves, in blocks: their texts are sent, no pairs
are. Buckets of more than LARGE leaves are split first, exactly: sets that reach the threshold share one of their rarest
shingles, of as many as the threshold allows to differ and one, so only leaves with such a shingle in common meet. (What
unlike documents of one template have in common is frequent there, and never among their rarest.) With that each link
within a bucket joins its ends, with no cap on either. With 24 bands of 5 rows a pair at the threshold 0.8 shares no bucket
with probability 7e-5, one at 0.85 with 8e-7.

A set of fewer than threshold / (1 - threshold) shingles can only equal another; those skip the buckets.

Defined cases: null or empty text and text of spaces alone has no set and is linked with nothing; with fewer words
than a shingle the whole sequence is the one shingle; rows that share a doc_id are one document of the graph; a
null doc_id is linked with nothing, its component is null and it is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, buffers, discard, join_sized, mix, release, signed, small_batches, word_hashes, written
from .components import components

EMPTY = np.uint64(2**64 - 1)
LEAVES = 128  # of a star in one group of the confirming step
OUTER = 128  # leaves outside a bucket's largest component that are compared at once
INNER = 1024  # leaves of a bucket that they are compared with in one group
LARGE = 1024  # leaves of a bucket that meet without being split by their rarest shingles
CELLS = 1 << 20  # counters that order shingles
_COEFFICIENTS = np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    w, n = word_hashes(*buffers(column))
    if not w.size:
        return [np.zeros(0, np.uint64)] * len(n)
    ends = np.cumsum(n)
    m = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    stops = np.cumsum(m)
    doc = np.repeat(np.arange(len(n)), m)
    at = (ends - n)[doc] + np.arange(stops[-1]) - (stops - m)[doc]
    h = w[at] * _COEFFICIENTS[0]
    padded = np.concatenate([w, np.zeros(words, np.uint64)])
    for j in range(1, words):
        h += np.where(at + j < ends[doc], padded[at + j], np.uint64(0)) * _COEFFICIENTS[j % 64]
    h = mix(h + np.minimum(n, words)[doc].astype(np.uint64))
    return [np.unique(h[a - k : a]) for a, k in zip(stops.tolist(), m.tolist(), strict=True)]


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of `bins` minima for each non-empty set, densified."""
    size = np.array([len(s) for s in sets])
    v = mix(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D))
    cell = np.repeat(np.arange(len(sets)), size) * bins + ((v >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    sig = np.full(len(sets) * bins, EMPTY)
    np.minimum.at(sig, cell, v & np.uint64(0xFFFFFFFF))
    full = sig != EMPTY
    empty = np.flatnonzero(~full)
    own, row = (empty % bins).astype(np.uint64), empty - empty % bins
    attempt = 0
    while empty.size:
        source = row + (mix(own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = full[source]
        sig[empty[hit]] = sig[source[hit]]
        empty, own, row = empty[~hit], own[~hit], row[~hit]
        attempt += 1
    return sig.reshape(-1, bins)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)) * np.uint64(0xD1342543DE82EF95)
    by_band = sig.reshape(len(sig), bands, rows)
    for i in range(rows):
        h = mix(h ^ by_band[:, :, i])
    return h


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, least: int, bands: int, rows: int) -> DataFrame:
    """(id, n, set, bands): the set's size and 128-bit hash, and the bucket of each band (none below `least` shingles)."""
    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            n = np.array([len(s) for s in sets], np.int64)
            large = np.flatnonzero(n >= least)
            keys = band_keys(signatures([sets[k] for k in large], bands * rows), bands, rows) if large.size else np.zeros((0, bands), np.uint64)
            ends = np.concatenate([[0], np.cumsum(np.where(n >= least, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.ascontiguousarray(keys).ravel())))
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), digests, lists], ["id", "n", "set", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(sketch, "id long, n long, set binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the threshold, as (u, v). Each text is sent once to each group of
    LEAVES pairs that one a has."""
    stars = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / LEAVES).cast("int")))
    leaves = join_sized(pairs, stars, ["a"], "n", pairs.count()).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("leaf"), F.col("b").alias("id"))
    wanted = leaves.unionByName(stars.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("leaf"), F.col("a").alias("id")))
    rows = wanted.join(texts, "id").select("a", "part", "leaf", "id", "text").repartition("a", "part").sortWithinPartitions("a", "part", "leaf")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centres = None, []
        for batch in batches:
            found = []
            for a, part, leaf, b, s in zip(*(batch.column(k).to_pylist() for k in range(4)), shingle_sets(batch.column(4), words), strict=True):
                if (a, part) != now:
                    now, centres = (a, part), []
                if not leaf:
                    centres.append(s)
                    continue
                for c in centres:
                    both = len(np.intersect1d(c, s, assume_unique=True))
                    if 100 * both >= percent * (len(c) + len(s) - both) and both:
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])

    return rows.mapInArrow(compare, "u long, v long")


def leaf_links(leaves: DataFrame, found: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) between leaves (h, id, n) of a bucket that lie in several components (node, component): one at least for
    each two components that a link joins."""
    labelled = written(leaves.join(found, leaves["id"] == found["node"], "left").select("h", "id", F.coalesce("component", "id").alias("component")))
    open_ = open_buckets(labelled)
    small = block_links(open_.where(F.col("total") <= LARGE), texts, words, percent)
    large = written(open_.where(F.col("total") > LARGE).select("id", "component").distinct())
    if large.isEmpty():
        return small
    return small.unionByName(block_links(open_buckets(rarest(large, texts, words, percent)), texts, words, percent))


def rarest(leaves: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(h, id, component): each leaf (id, component) under those of its rarest shingles of which sets that reach the threshold
    share one. Any order of all shingles serves; this one is by a count of the leaves that have a shingle, or another of
    the same of CELLS cells, so what is gathered and broadcast is a number a cell. Shingles alone in a cell are left out."""
    spark = texts.sparkSession
    rows = written(leaves.join(texts, "id").select("id", "component", "text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0), words):
                np.add.at(total, _cell(s), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    found = rows.select("text").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    often = spark.sparkContext.broadcast(counts)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shared = [], []
            for k, s in enumerate(shingle_sets(batch.column(2), words)):
                n = often.value[_cell(s)]
                first = np.lexsort((s, n))[: len(s) - -(-len(s) * percent // 100) + 1]
                first = first[n[first] > 1]
                shared.append(s[first])
                at += [k] * len(first)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *shared]))), batch.column(0).take(rows), batch.column(1).take(rows)], ["h", "id", "component"])

    out = written(rows.mapInArrow(listed, "h long, id long, component long"))
    discard(spark, rows)
    return out


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def open_buckets(labelled: DataFrame) -> DataFrame:
    """Of (h, id, component), the rows of buckets in several components, with the bucket's size, the component that most of
    it is in, and the numbers of groups that its leaves are to meet in."""
    by_part = labelled.groupBy("h", "component").agg(F.count(F.lit(1)).alias("size"))
    by_bucket = by_part.groupBy("h").agg(F.sum("size").alias("total"), F.max(F.struct("size", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
    by_bucket = written(by_bucket.where("parts > 1").select("h", "total", F.col("top.component").alias("top"), F.ceil((F.col("total") - F.col("top.size")) / OUTER).cast("int").alias("groups"), F.ceil(F.col("total") / INNER).cast("int").alias("splits")))
    return written(join_sized(labelled, by_bucket, ["h"], "total", labelled.count()))


def block_links(open_: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) between leaves of open buckets. All leaves outside a bucket's largest component meet all its leaves, OUTER
    by INNER in a group: texts are sent to groups, and a group sends on one link for each outer leaf and component."""
    group, split = (F.pmod(F.xxhash64("id"), F.col(n)).cast("int") for n in ("groups", "splits"))
    every = {n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("groups", "splits")}
    outer = open_.where("component <> top").select("h", group.alias("group"), every["splits"].alias("split"), F.lit(0).alias("inner"), "id", "component")
    inner = open_.select("h", every["groups"].alias("group"), split.alias("split"), F.lit(1).alias("inner"), "id", "component")
    rows = outer.unionByName(inner).join(texts, "id").select("h", "group", "split", "inner", "id", "component", "text").repartition("h", "group", "split").sortWithinPartitions("h", "group", "split", "inner")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, linked = None, None, set()
        for batch in batches:
            h, group, split, inner, ids, part = (batch.column(k).to_numpy() for k in range(6))
            sets = shingle_sets(batch.column(6), words)
            cuts = np.flatnonzero((np.diff(h) != 0) | (np.diff(group) != 0) | (np.diff(split) != 0) | (np.diff(inner) != 0)) + 1
            found: list[tuple[int, int]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
                if a == b:
                    continue
                if (h[a], group[a], split[a]) != now:
                    now, block, linked = (h[a], group[a], split[a]), _Block(), set()
                if not inner[a]:
                    block.add(ids[a:b], part[a:b], sets[a:b])
                    continue
                for i, j in block.links(sets[a:b], percent):
                    u, v = block.ids[i], ids[a + j]
                    key = (u, part[a + j])
                    if block.parts[i] != part[a + j] and key not in linked:
                        linked.add(key)
                        found.append((int(u), int(v)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])

    return rows.mapInArrow(compare, "u long, v long")


class _Block:
    """The sets of a group's outer leaves, and which of them a batch of other sets reaches."""

    def __init__(self) -> None:
        self.ids, self.parts, self.sets, self.matrix = [], [], [], None

    def add(self, ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray]) -> None:
        self.ids += ids.tolist()
        self.parts += parts.tolist()
        self.sets += sets
        self.matrix = None

    def links(self, others: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
        if not self.sets:  # a group that no outer leaf fell to
            return
        if len(self.sets) == 1:  # most groups
            own = self.sets[0]
            for j, s in enumerate(others):
                if min(len(own), len(s)) * 100 >= percent * max(len(own), len(s)):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        yield 0, j
            return
        if self.matrix is None:
            self.size = np.array([len(s) for s in self.sets])
            all_ = np.concatenate(self.sets)
            self.known, column = np.unique(all_, return_inverse=True)
            self.column, self.row = column, np.repeat(np.arange(len(self.sets)), self.size)
            self.matrix = True
        for lo in range(0, len(others), 128):
            some = others[lo : lo + 128]
            size = np.array([len(s) for s in some])
            values = np.concatenate(some)
            at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
            hit = self.known[at] == values
            row, column = np.repeat(np.arange(len(some)), size)[hit], at[hit]
            both = np.zeros((len(some), len(self.sets)), np.float32)
            for k in range(0, len(self.known), 8192):  # dense tiles of the sets' shingles
                x, y = np.zeros((len(some), 8192), np.float32), np.zeros((len(self.sets), 8192), np.float32)
                own = (self.column >= k) & (self.column < k + 8192)
                y[self.row[own], self.column[own] - k] = 1
                own = (column >= k) & (column < k + 8192)
                x[row[own], column[own] - k] = 1
                both += x @ y.T
            linked = 100 * both >= percent * (size[:, None] + self.size[None, :] - both)
            for j, i in np.argwhere(linked).tolist():
                yield i, lo + j


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = 24, band_rows: int = 5) -> DataFrame:
    """(id, n, component) of each row: the size of its set, and the smallest id that links reach."""
    spark = docs.sparkSession
    least = -(-percent // (100 - percent))
    each = written(sketches(docs, id_col, text_col, words, least, bands, band_rows))
    classes = written(each.where("n > 0 AND id IS NOT NULL").groupBy("set").agg(F.min("id").alias("rep"), F.min_by(F.struct("n", "bands"), "id").alias("s"), F.count(F.lit(1)).alias("copies")).select("set", "rep", "copies", "s.n", "s.bands"))

    placed = classes.select(F.explode("bands").alias("h"), F.col("rep").alias("id"), "n").distinct()
    buckets = written(placed.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("id", "n")).alias("c")).where("size > 1").select("h", "size", F.col("c.id").alias("c"), F.col("c.n").alias("cn")))
    fits = "least(n, cn) * 100 >= greatest(n, cn) * " + str(percent)
    n_placed = classes.agg(F.sum(F.size("bands"))).first()[0] or 0
    members = written(join_sized(placed, buckets, ["h"], "size", n_placed).drop("size"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = written(texts.join(bounded(written(members.select("id").distinct())), "id", "left_semi"))

    pairs = written(members.where(f"id <> c AND {fits}").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct())
    linked = written(confirmed(pairs, texts, words, percent))
    rows = each.where("n > 0 AND id IS NOT NULL").select("id", "n", "set")
    n_rows = rows.count()
    own = join_sized(rows, classes.select("set", "rep", "copies"), ["set"], "copies", n_rows).select("id", "rep")
    shared = own.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("top")).where("u < top").select("id", "u")
    edges = linked.unionByName(own.join(shared, "id").select("u", F.col("rep").alias("v")))
    found = written(components(edges))

    release(spark)
    missed = written(leaf_links(members.where("id <> c").select("h", "id", "n"), found, texts, words, percent))
    joined = written(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v").unionByName(missed)))
    named = classes.select("set", "rep", "copies").join(joined, F.col("rep") == joined["node"], "left").select("set", "copies", F.coalesce("component", "rep").alias("component"))
    named = written(named)
    discard(spark, classes, buckets, members, texts, pairs, linked, found, missed, joined)
    release(spark)
    alone = each.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    return alone.unionByName(join_sized(rows, named, ["set"], "copies", n_rows).select("id", "n", "component"))


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each group, the one with the smallest id."""
    lost = written(near_classes(docs, id_col, text_col, words, percent).where("id <> component").select(F.col("id").alias("lost")).distinct())
    return docs.join(bounded(lost), F.col(id_col).cast("long") == lost["lost"], "left_anti")
