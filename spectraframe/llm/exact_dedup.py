"""Exact duplicates by content-defined chunk recipes.

Each text (A-Z lower-cased) is cut where a rolling hash of its last 16 bytes has `bits` zero bits, so equal
passages give equal chunks wherever they stand. Chunks are deduplicated once: of each distinct chunk a task
sends one copy, and chunks that share a hash but not their bytes are told apart by an ordinal. A chunk's
verified identifier is (hash, ordinal). A document is then its ordered list of identifiers, 16 bytes for a
chunk; two texts are equal exactly when their lists are, and only the lists are shuffled, grouped and compared.

Defined cases: null text is empty; an empty text has the empty list, so all empty texts are equal; of equal
texts the row with the largest doc_id stays; rows that share a doc_id share its fate; a null doc_id is less
than any other, and stays only where its group has no other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_TABLE, buffers, join_sized, small_batches, written

WINDOW = 16
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, bits: int = 10, least: int = 256, most: int = 8192) -> list[int]:
    """Ends of the chunks of one text: where the hash of the last WINDOW bytes has its upper `bits` clear, at least
    `least` and at most `most` bytes apart."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = _GEAR[data]
    step = 1
    while step < WINDOW:  # h of 2k bytes from two of k
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    found = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, at = [], 0
    for e in found.tolist():
        while e - at > most:
            at += most
            ends.append(at)
        if e - at >= least:
            ends.append(e)
            at = e
    while n - at > most:
        at += most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _chunks(text: bytes, n: int) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    for e in cut_points(np.frombuffer(text, np.uint8)):
        piece = text[at:e]
        at = e
        yield xxhash.xxh3_128_digest(piece)[:n], piece


def _lowered(column: pa.Array) -> list[bytes]:
    at, raw = buffers(column)
    whole = raw.tobytes().translate(LOWER_TABLE)
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def distinct_chunks(texts: DataFrame, hash_bytes: int) -> DataFrame:
    """(h, chunk) of each distinct chunk of the only column."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {piece: h for text in _lowered(batch.column(0)) for h, piece in _chunks(text, hash_bytes)}
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.binary()), pa.array(list(seen), pa.binary())], ["h", "chunk"])

    return texts.mapInArrow(cut, "h binary, chunk binary").groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """(id, sha256, recipe) of each row; the recipe is the ordered list of verified chunk identifiers."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    #: Hashes that several chunks share, and those chunks' ordinals: none, unless a hash collides.
    shared = written(distinct_chunks(rows.select("text"), hash_bytes).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _lowered(batch.column(1))
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            lists = [b"".join(h for h, _ in _chunks(t, hash_bytes)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(lists, pa.binary())], ["id", "sha256", "recipe"])

    kind = rows.schema["id"].dataType.simpleString()
    if shared.isEmpty():
        return rows.mapInArrow(listed, f"id {kind}, sha256 string, recipe binary")
    ordinals = distinct_chunks(rows.select("text"), hash_bytes).join(shared, "h", "left_semi").select("h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("ordinal"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), _lowered(batch.column(1)), strict=True):
                digest, row = hashlib.sha256(text).hexdigest(), xxhash.xxh3_128_digest(text)
                out += [(i, digest, row, k, h, piece) for k, (h, piece) in enumerate([*_chunks(text, hash_bytes)] or [(b"", b"")])]
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [batch.schema.field(0).type, pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "sha256", "row", "k", "h", "chunk"])

    each = rows.mapInArrow(spread, f"id {kind}, sha256 string, row binary, k int, h binary, chunk binary")
    each = each.join(ordinals, ["h", "chunk"], "left").withColumn("part", F.concat("h", F.to_binary(F.lpad(F.hex(F.coalesce("ordinal", F.lit(0))), 8, "0"), F.lit("hex"))))
    # rows with the same doc_id and text are the same here; their number is put back
    whole = each.groupBy("id", "sha256", "row", "k", "part").agg(F.count(F.lit(1)).alias("times"))
    whole = whole.groupBy("id", "sha256", "row").agg(F.max("times").alias("times"), F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"))
    whole = whole.withColumn("recipe", F.aggregate("parts", F.lit("").cast("binary"), lambda x, y: F.concat(x, y["part"])))
    return whole.select("id", "sha256", "recipe", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """Each row's id, keep_id, group_size, kept and text_sha256."""
    each = written(recipes(docs, id_col, text_col, hash_bytes))
    groups = written(each.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return join_sized(each, groups, ["recipe"], "group_size", each.count()).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha256").alias("text_sha256"))
