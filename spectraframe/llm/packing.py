"""Best-two-fit packing of token sequences, over lengths instead of documents.

Texts are tokenised once into pieces of at most `capacity` tokens, which are written with their ids. What packing needs
of them is the number of pieces of each length: `capacity` numbers. The plan is made from those: fill a sequence
greedily, the longest piece that fits first; then, while there is a gap, put two unpacked pieces in the place of the
smallest one if they fill more of it. A sequence's list of lengths is its pattern, and the next sequence has the same
one as long as the pieces last, so a pattern is made once with its number of copies and the plan has a few thousand
patterns for any number of documents. It is the plan that packing all pieces one by one gives, not one for each task.

Pieces find their place by their rank among those of their length. Ranks need no window over a length: pieces are
sorted by (length, id, piece) over all tasks, each task counts its own, and tasks' counts (one for each task, and one more
for each length) give the offsets.

Token ids are those of the tokenizers library. Texts of plain Latin characters go through tiktoken's faster
implementation of the same vocabulary, whose ids are the same; all others through tokenizers itself.

Defined cases: null or empty text is the end token alone; a text of more than `capacity` tokens is cut into pieces of
`capacity`, the first one shorter; rows that share a doc_id are packed as rows of their own; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import discard, small_batches, written

_OTHER = re.compile(r"[^\t\n\r -~\xa1-ſ]|<\|endoftext\|>")


@functools.cache
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def _plain(name: str):
    """The tokenizer's vocabulary in tiktoken."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name).replace(".json", ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, name: str = "byte_bpe_50k.json") -> np.ndarray:
    """The text's ids, without special tokens."""
    if _OTHER.search(text or ""):
        return np.array(_tokenizer(name).encode(text, add_special_tokens=False).ids, np.uint32)
    return _plain(name).encode_to_numpy(text or "", disallowed_special=()).astype(np.uint32, copy=False)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, piece, start, length, ids): ids are unsigned 32-bit, little-endian."""
    small_batches(docs.sparkSession, 500)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, ids = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = np.append(token_ids(text, tokenizer), np.uint32(end_id)).astype("<u4")
                ends = list(range(len(own) % capacity or capacity, len(own) + 1, capacity))
                for n, e in enumerate(ends):
                    s = ends[n - 1] if n else 0
                    row.append(k)
                    piece.append(n)
                    start.append(s)
                    length.append(e - s)
                    ids.append(own[s:e].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids binary")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) and the number of sequences of each, from the number of pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    lengths = np.flatnonzero(left).tolist()
    while lengths:
        used, gap = Counter(), capacity
        k = len(lengths)
        while k := bisect_right(lengths, gap, 0, k):
            length = lengths[k - 1]
            n = int(min(gap // length, left[length]))
            used[length] += n
            gap -= n * length
            k -= 1
        while gap:
            small = min(used)
            room = gap + small
            free = left[: room + 1].copy()
            for length, n in used.items():
                if length <= room:
                    free[length] -= n
            free[0] = 0
            there = np.where(free > 0, np.arange(room + 1), 0)
            below = np.maximum.accumulate(there)  # the longest free piece of at most so much
            x = np.flatnonzero(free[:room] > 0)
            y = below[np.minimum(room - x, np.where(free[x] > 1, x, x - 1))]
            both = np.where(y > 0, x + y, 0)
            if not both.size or both.max() <= small:
                break
            best = int(np.flatnonzero(both == both.max())[-1])
            used[small] -= 1
            used += Counter([int(x[best]), int(y[best])])  # drops what is used up
            gap = room - int(both[best])
        times = min(int(left[length]) // n for length, n in used.items())
        plan.append((sorted(used.elements(), reverse=True), times))
        for length, n in used.items():
            left[length] -= n * times
        lengths = [length for length in lengths if left[length]]
    return plan


def _segments(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For (length, rank): sorted starts length << 44 | rank, and each segment's first sequence, pieces in a sequence, and
    where their offsets begin in the last array."""
    start, first, each, at, offsets = [], [], [], [], []
    taken: Counter = Counter()
    sequence = 0
    for lengths, times in plan:
        place, own = 0, {}
        for length in lengths:
            own.setdefault(length, []).append(place)
            place += length
        for length, places in own.items():
            start.append(length << 44 | taken[length])
            first.append(sequence)
            each.append(len(places))
            at.append(len(offsets))
            offsets += places
            taken[length] += times * len(places)
        sequence += times
    order = np.argsort(np.array(start, np.int64), kind="stable")
    return (*(np.array(x, np.int64)[order] for x in (start, first, each, at)), np.array(offsets, np.int64))


def place(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """rows (id, piece, length and whatever else) with sequence_id and offset."""
    names = rows.columns
    at = names.index("length")
    spread = rows.repartitionByRange("length", "id", "piece").sortWithinPartitions("length", "id", "piece")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, n = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            rank = np.zeros(len(batch.column(0)), np.int64)
            lengths = batch.column(at).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1, [len(lengths)]]) if len(lengths) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                n = n if lengths[a] == now else 0
                now = lengths[a]
                rank[a:b] = np.arange(n, n + b - a)
                n += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(rank)], [*names, "part", "rank"])

    ranked = written(spread.mapInArrow(count, StructType([*rows.schema.fields]).add("part", IntegerType()).add("rank", LongType())))
    found = sorted(map(tuple, ranked.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect()))  # a row a task, and a row a length
    counts: Counter = Counter()
    offset = {}
    for length, part, n in found:
        offset[length << 32 | part] = counts[length]
        counts[length] += n
    keys, before = np.array(list(offset), np.int64), np.array(list(offset.values()), np.int64)
    segments = _segments(best_two_fit(counts, capacity))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, first, each, where, offsets = segments
        for batch in batches:
            length, part, rank = (batch.column(k).to_numpy().astype(np.int64) for k in (at, len(names), len(names) + 1))
            rank = rank + before[np.searchsorted(keys, length << 32 | part)] if len(length) else rank
            k = np.searchsorted(start, length << 44 | rank, "right") - 1
            inside = rank - (start[k] & (1 << 44) - 1)
            sequence, slot = first[k] + inside // each[k], inside % each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), pa.array(offsets[where[k] + slot])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(put, StructType([*rows.schema.fields]).add("sequence_id", LongType()).add("offset", LongType()))


def _written_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    return written(pieces(docs, id_col, text_col, capacity).withColumn("ids_crc32", F.crc32("ids")))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The written pieces with their token ids, and each piece's place: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    cut = _written_pieces(docs, id_col, text_col, capacity)
    return cut, place(cut.drop("ids"), capacity)


def pack_with_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """Each piece's place and its token ids: (id, piece, start, length, ids, ids_crc32, sequence_id, offset)."""
    cut = _written_pieces(docs, id_col, text_col, capacity)
    placed = place(cut, capacity)  # from a table of its own, with the ids
    discard(docs.sparkSession, cut)
    return placed
