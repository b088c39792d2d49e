"""Lines that many documents share, by levelled sorted runs of line hashes.

State is a set of runs: tables bucketed and sorted by the 128-bit hash of a line's key, each with the key's
number of documents and largest doc_id. A new batch is aggregated, merge-anti-joined with the runs to find the
keys that are new, and added as a run of level 0. When a level has `fanout` runs they are merged into one of the
next level, so n batches leave O(fanout * log n) runs and each row is rewritten O(log n) times. Batches and runs
share the bucketing, so a merge join reads the runs without shuffling them.

A run has as many buckets as its rows ask for (BUCKET_ROWS each). The runs' manifest can be saved and opened again, in another
application too, so that a later batch of documents meets what earlier ones held.

Keys in `min_docs` documents or more are few: up to MOST_BROADCAST of them, counted, are broadcast and each text's lines are
looked up where the text is, so no text is shuffled. Beyond that they are joined with the lines, hot ones by broadcast, so
no task gets a hot key, and the lists of what to drop are joined with the documents.

Defined cases: null or empty text is one empty line; the empty key is too short to be dropped; a line twice in a
document counts once; rows that share a doc_id are one document for the count; a null doc_id is less than any other
(its lines go when the key is frequent); other columns stay as they are, but input columns named n_lines or
n_dropped are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import LOWER_TABLE, MOST_BROADCAST, SPACES, discard, join_sized, shared_folder, small_batches, written

_STRIP = SPACES.decode()
RUN = "h1 long, h2 long, n_docs long, max_id long"
MANIFEST = "kind string, level int, name string, path string, buckets int, fanout int"
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 100_000


def line_key(line: str, min_chars: int) -> bytes | None:
    """The hash of a line's key, if it has so many code points."""
    key = line.strip(_STRIP)
    return xxhash.xxh3_128_digest(key.encode().translate(LOWER_TABLE)) if len(key) >= min_chars else None


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id) of each distinct long key of each row."""
    small_batches(docs.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = {h for line in (text or "").split("\n") if (h := line_key(line, min_chars))}
                found += own
                rows += [k] * len(own)
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(pa.array(rows, pa.int64()))], ["h1", "h2", "id"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(keys, "h1 long, h2 long, id long")


class LineRuns:
    """The runs of one corpus, in two ladders: `keys` has each key once, with the counts of the batch that brought it
    (its runs are disjoint); `counts` has what later batches add to keys that were known."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None, rows: int = 0):
        """rows: of keys to be expected, where the number of buckets is not given."""
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS)))
        self.paths: dict[str, str] = {}
        self.keys: list[list[str]] = []
        self.counts: list[list[str]] = []

    def save(self, folder: str) -> None:
        """Writes which runs there are and where."""
        rows = [(kind, level, name, self.paths[name], self.buckets, self.fanout) for kind, ladder in (("keys", self.keys), ("counts", self.counts)) for level, names in enumerate(ladder) for name in names]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The runs of a saved manifest; their tables are named anew where this application doesn't know them."""
        rows = spark.read.schema(MANIFEST).parquet(folder).collect()  # O(fanout * log n) runs
        out = cls(spark, rows[0].fanout if rows else 3, rows[0].buckets if rows else None)
        for r in sorted(rows, key=lambda r: (r.kind, r.level, r.name)):
            if not spark.catalog.tableExists(r.name):
                spark.sql(f"CREATE TABLE {r.name} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {out.buckets} BUCKETS LOCATION '{r.path}'")
            ladder = getattr(out, r.kind)
            ladder += [[] for _ in range(r.level + 1 - len(ladder))]
            ladder[r.level].append(r.name)
            out.paths[r.name] = r.path
        return out

    def tables(self, ladder: list[list[str]]) -> list[DataFrame]:
        return [self.spark.table(name) for level in ladder for name in level]

    def _write(self, run: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_folder(self.spark)
        self.paths[name] = path
        run.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The keys of a batch that no run holds: a merge-anti-join with each run."""
        for run in self.tables(self.keys):
            batch = batch.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of (h1, h2, id); returns the run of its new keys."""
        own = batch.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("max_id"))
        if not self.keys:
            new = self._write(own)
        else:
            own = self.spark.table(self._write(own))
            new = self._write(self.fresh(own))
            self._push(self.counts, self._write(own.join(self.spark.table(new).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")))
        self._push(self.keys, new)
        return self.spark.table(new)

    def _push(self, ladder: list[list[str]], run: str, level: int = 0) -> None:
        """A run goes to its level; a full level is merged into one run of the next. The merged runs' files stay for
        readers that have begun."""
        ladder += [[] for _ in range(level + 1 - len(ladder))]
        ladder[level].append(run)
        if len(ladder[level]) >= self.fanout:
            merged = self._write(self._merged(ladder[level]))
            ladder[level] = []
            self._push(ladder, merged, level + 1)

    def forget(self, merged_only: bool = False) -> None:
        """Drops all runs, or those that have been merged into others."""
        live = {name for ladder in (self.keys, self.counts) for level in ladder for name in level} if merged_only else set()
        for name, path in self.paths.items():
            if name not in live:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                discard(self.spark, path)
        self.paths = {name: path for name, path in self.paths.items() if name in live}
        if not merged_only:
            self.keys, self.counts = [], []

    def total(self) -> DataFrame:
        """All runs merged: the number of documents and the largest id of each key."""
        names = [name for ladder in (self.keys, self.counts) for level in ladder for name in level]
        return self._merged(names) if names else self.spark.createDataFrame([], RUN)

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs' rows by key, summed. They are read by path: Spark 4.1 takes a union of bucketed tables for
        bucketed itself, and would sum each run by itself."""
        rows = self.spark.read.schema(RUN).parquet(*(self.paths[name] for name in names))
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"))


def repeated_lines(keys: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, drop) of the rows with lines to drop; drop holds their keys' hashes, 16 bytes each."""
    found = join_sized(keys, frequent, ["h1", "h2"], "n_docs", keys.count())
    found = found.where(F.coalesce(F.col("id") < F.col("max_id"), F.col("max_id").isNotNull())).select("id", "h1", "h2")
    return found.distinct().groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))


def drop_lines(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """docs with the dropped lines gone, and n_lines, n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    own = f"drop_{uuid.uuid4().hex}"
    joined = docs.join(dropped.select(F.col("id").alias(f"{own}_id"), F.col("drop").alias(own)), F.col(id_col).cast("long").eqNullSafe(F.col(f"{own}_id")), "left").drop(f"{own}_id")
    place = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(place), batch.column(len(batch.columns) - 1)
            n_lines = pc.add(pc.fill_null(pc.count_substring(texts, "\n"), 0).cast(pa.int64()), 1)
            n_dropped = np.zeros(len(texts), np.int64)
            out = texts
            if some := np.flatnonzero(drops.is_valid()).tolist():
                kept = texts.to_pylist()
                for k in some:
                    d = drops[k].values
                    gone = set(np.stack([d.field(0).to_numpy(), d.field(1).to_numpy()], 1).astype(np.int64).view("V16").ravel().tolist())
                    lines = (kept[k] or "").split("\n")
                    stay = [x for x in lines if line_key(x, min_chars) not in gone]
                    kept[k], n_dropped[k] = "\n".join(stay), len(lines) - len(stay)
                out = pa.array(kept, texts.type)
            columns = [out if k == place else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, n_lines, pa.array(n_dropped)], [*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, StructType([*docs.schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType()))


def drop_known(docs: DataFrame, frequent: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """As `drop_lines`, for frequent keys (h1, h2, max_id) that are few: each text's lines are looked up in a broadcast table."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    rows = frequent.select("h1", "h2", "max_id").orderBy("h1", "h2").toArrow()
    none = rows.column("max_id").is_null().to_numpy(zero_copy_only=False)
    keys = [rows.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "max_id")]
    same = int(np.unique(keys[0], return_counts=True)[1].max(initial=1))  # keys that share h1: one, unless it collides
    known = spark.sparkContext.broadcast((*keys, none, same))
    own = f"id_{uuid.uuid4().hex}"
    named = docs.withColumn(own, F.col(id_col).cast("long"))
    place = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h1, h2, last, none, same = known.value
        for batch in batches:
            texts, ids = batch.column(place).to_pylist(), batch.column(len(batch.columns) - 1)
            lines = [(text or "").split("\n") for text in texts]
            found = [(k, j, h) for k, own in enumerate(lines) for j, line in enumerate(own) if (h := line_key(line, min_chars))]
            gone = np.zeros(len(found), bool)
            if found and len(h1):
                h = np.frombuffer(b"".join(x[2] for x in found), np.int64).reshape(-1, 2)
                doc = np.array([x[0] for x in found])
                i, null = ids.fill_null(0).to_numpy(zero_copy_only=False)[doc], ids.is_null().to_numpy(zero_copy_only=False)[doc]
                first = np.searchsorted(h1, h[:, 0])
                for k in range(same):
                    at = np.minimum(first + k, len(h1) - 1)
                    hit = (h1[at] == h[:, 0]) & (h2[at] == h[:, 1])
                    gone |= hit & ~none[at] & (null | (i < last[at]))
            n_dropped, drop = np.zeros(len(texts), np.int64), {}
            for (k, j, _), g in zip(found, gone.tolist(), strict=True):
                if g:
                    drop.setdefault(k, set()).add(j)
            for k, js in drop.items():
                texts[k], n_dropped[k] = "\n".join([x for j, x in enumerate(lines[k]) if j not in js]), len(js)
            out = pa.array(texts, batch.column(place).type) if drop else batch.column(place)
            columns = [out if k == place else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in lines], pa.int64()), pa.array(n_dropped)], [*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return named.mapInArrow(cut, StructType([*docs.schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType()))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, runs: LineRuns | None = None) -> DataFrame:
    """docs, with each key of `min_docs` documents left only in the one with the largest id; and n_lines, n_dropped. The
    documents come in as so many batches; with `runs` given, after those that these already hold, and the runs stay."""
    keys = written(line_keys(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")))
    held = runs or LineRuns(docs.sparkSession, fanout, rows=keys.count())
    for k in range(batches):
        held.add(keys.where(F.col("batch") == k).drop("batch"))
    frequent = written(held.total().where(F.col("n_docs") >= min_docs))
    few = frequent.count() <= MOST_BROADCAST
    if not few:
        dropped = written(repeated_lines(keys.drop("batch"), frequent))
    held.forget(merged_only=runs is not None)
    discard(docs.sparkSession, keys)
    return drop_known(docs, frequent, id_col, text_col, min_chars) if few else drop_lines(docs, dropped, id_col, text_col, min_chars)
