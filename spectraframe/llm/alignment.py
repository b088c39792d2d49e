"""Alignment of two tokenizers' cuts of the same texts, a whole Arrow batch at a time.

The texts of a batch stand one after another in one buffer of bytes, each with a space before it. The tokens of A, and those
of B, are laid end to end over that buffer, so that one running sum over all of them gives every token's end; ends are
counted at each byte (a bincount for A, one for B), and the buffer is cut where both are there. What belongs to a
document is recovered by differences of running sums at the documents' offsets. No document is a loop of its own but for
the two tokenizers' calls and the digest.

An id pair's count is the number of links in all texts. Tasks give each document's distinct pairs with their numbers, Spark
adds these up by pair, and the sums go back to the documents' pairs: by broadcast while pairs are few (counted), else by a join in
which hot pairs stay where they are.

Token bytes are A's entries byte-level decoded, and B's pieces with U+2581 as a space and <0xHH> as that byte. Special tokens'
strings inside texts are plain text. Defined cases: a text that is null, empty, or whose tokens' bytes (A's or B's) are
not the space and the text has no tokens, so zeros and no groups; rows that share a doc_id, and equal rows, are texts of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, buffers, join_sized, small_batches, written
from .packing import _OTHER, _plain

#: Bits of a pair's code for the id of B.
B_BITS = 32
MOST_BYTES = 4 << 20
_DIGITS = 10  # of an id at most, and one place for the separator


@dataclass(frozen=True)
class Vocabulary:
    """The bytes of all tokens in one buffer, and where each id's begin."""

    data: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64))

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.start[ids + 1] - self.start[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, end to end."""
        n = self.lengths(ids)
        ends = np.cumsum(n)
        return self.data[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _byte_of() -> dict[str, int]:
    """Byte-level entries write each byte as a character: printable Latin-1 as itself, the others from U+0100 on, in order."""
    as_is = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = [b for b in range(256) if b not in as_is]
    return {chr(b): b for b in as_is} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def _a(name: str):
    """A's tokenizer, which takes special strings as plain text, and its vocabulary."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        special = {t["id"]: t["content"] for t in json.load(f).get("added_tokens", [])}
    byte_of = _byte_of()
    tokens = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for token, i in tokenizer.get_vocab().items():
        tokens[i] = special[i].encode() if i in special else bytes(byte_of[c] for c in token)
    return tokenizer, Vocabulary.of(tokens)


@functools.cache
def _b(name: str):
    """B's processor and its vocabulary."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    tokens = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    return sp, Vocabulary.of(tokens)


def _encoded(texts: list[str], a: str, b: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    tokenizer, processor = _a(a)[0], _b(b)[0]
    ids_a = [np.array(tokenizer.encode(" " + t, add_special_tokens=False).ids, np.int64) if _OTHER.search(t) else _plain(a).encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]
    return ids_a, [np.array(x, np.int64) for x in processor.encode(texts, num_threads=1)]


def _whole(vocabulary: Vocabulary, flat: np.ndarray, counts: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which documents' tokens, joined, are the document's bytes data[at[k]:at[k + 1]]."""
    size = np.diff(np.concatenate([[0], np.cumsum(vocabulary.lengths(flat))])[np.concatenate([[0], np.cumsum(counts)])])
    same = size == np.diff(at)
    keep = np.repeat(same, counts)
    there = np.repeat(same, np.diff(at))
    wrong = vocabulary.joined(flat[keep]) != data[there]
    sums = np.concatenate([[0], np.cumsum(wrong)])[np.concatenate([[0], np.cumsum(np.where(same, np.diff(at), 0))])]
    return same & (np.diff(sums) == 0)


def _spelled(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of `a1,a2|b1;a3|b2,b3;`, and where each group's begin. Every group has tokens of both."""
    na, nb = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
    total = len(a) + len(b)
    ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[np.arange(len(a)) + (ends_b - nb)[group_a]] = a
    ids[np.arange(len(b)) + ends_a[group_b]] = b
    mark[ends_a + ends_b - nb - 1] = ord("|")
    mark[ends_a + ends_b - 1] = ord(";")
    width = np.searchsorted(10 ** np.arange(1, _DIGITS), ids, "right") + 1
    ends = np.cumsum(width + 1)
    out = np.empty(ends[-1] if total else 0, np.uint8)
    out[ends - 1] = mark
    for k in range(int(width.max()) if total else 0):
        some = width > k
        out[ends[some] - 2 - k] = ord("0") + ids[some] // 10**k % 10
    return out, np.concatenate([[0], ends])[np.concatenate([[0], ends_a + ends_b])]


def align(texts: list[str], a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> dict[str, list]:
    """For non-empty texts: n_a, n_b, n_groups, groups (bytes of the spelling), pairs (codes of the distinct linked id pairs) and times."""
    raw = [b" " + t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    ids, flat, counts, good = _encoded(texts, a, b), [], [], np.ones(len(texts), bool)
    for side, vocabulary in zip(ids, (_a(a)[1], _b(b)[1]), strict=True):
        flat.append(np.concatenate([*side, np.zeros(0, np.int64)]))
        counts.append(np.array([len(x) for x in side], np.int64))
        good &= _whole(vocabulary, flat[-1], counts[-1], data, at)
    sizes = np.where(good, np.diff(at), 0)
    base = np.concatenate([[0], np.cumsum(sizes)])  # of the documents that have tokens, in the buffer without the others
    ends = []
    for k, vocabulary in enumerate((_a(a)[1], _b(b)[1])):
        flat[k] = flat[k][np.repeat(good, counts[k])]
        counts[k] = np.where(good, counts[k], 0)
        ends.append(np.cumsum(vocabulary.lengths(flat[k])))
    n_a, n_b = (np.bincount(e, minlength=base[-1] + 1) for e in ends)
    cut = (n_a > 0) & (n_b > 0)
    groups_before = np.concatenate([[0], np.cumsum(cut)])  # cuts at bytes before this one
    first = groups_before[base + 1]
    n_groups = np.diff(first)
    spelled, where = _spelled(*flat, *(groups_before[e] for e in ends), int(first[-1]))
    # tokens of A and of B that end together: all pairs of them
    together = np.flatnonzero(cut)
    last = [np.searchsorted(e, together, "right") for e in ends]
    n_links = n_a[together] * n_b[together]
    nth = np.arange(n_links.sum()) - np.repeat(np.cumsum(n_links) - n_links, n_links)
    width = np.repeat(n_b[together], n_links)
    link_a = flat[0][np.repeat(last[0] - n_a[together], n_links) + nth // np.maximum(width, 1)]
    link_b = flat[1][np.repeat(last[1] - n_b[together], n_links) + nth % np.maximum(width, 1)]
    doc = np.repeat(np.searchsorted(base, together, "left") - 1, n_links)
    # distinct pairs of each document
    code = link_a << B_BITS | link_b
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(code) != 0)])) if len(code) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([new, [len(code)]]))
    pairs_at = np.searchsorted(doc[new], np.arange(len(texts) + 1))
    out = {"n_a": counts[0], "n_b": counts[1], "n_groups": n_groups, "n_links": np.bincount(doc, minlength=len(texts))}
    spans = where[first - first[0]]
    return out | {"groups": [spelled[s : max(s, e - 1)].tobytes() for s, e in zip(spans[:-1], spans[1:], strict=True)], "pairs": code[new], "times": times, "pairs_at": pairs_at}


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some MOST_BYTES of text, which bound the arrays over bytes; a longer text is a part of its own."""
    sizes = np.diff(buffers(batch.column(1))[0])
    part = (np.cumsum(sizes) - sizes) // MOST_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(s, e - s)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", spell: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row, pairs being codes id of A * 2^32 + id of B; with `spell`
    also the groups themselves, as text."""
    small_batches(docs.sparkSession, 500)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>" + ", groups string" * spell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            texts = batch.column(1).to_pylist()
            some = [k for k, t in enumerate(texts) if t]
            found = align([texts[k] for k in some], a, b)
            n = np.zeros((4, len(texts)), np.int64)
            n[:, some] = [found[c] for c in ("n_a", "n_b", "n_groups", "n_links")]
            groups, at = [b""] * len(texts), np.zeros(len(texts) + 1, np.int32)
            at[np.array(some, np.int64) + 1] = np.diff(found["pairs_at"])
            for k, x in zip(some, found["groups"], strict=True):
                groups[k] = x
            offsets = pa.array(np.cumsum(at), pa.int32())
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in groups]
            columns = [batch.column(0), *map(pa.array, n), pa.array(digests), pa.ListArray.from_arrays(offsets, pa.array(found["pairs"])), pa.ListArray.from_arrays(offsets, pa.array(found["times"].astype(np.int32)))]
            names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array([x.decode() for x in groups])] if spell else [])], names + ["groups"] * spell)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, n_rows, best) over rows with pairs and times: links that hold the pair, and whether no other pair of its B id has more."""
    each = rows.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counts = each.groupBy("pair").agg(F.sum("times").alias("count"), F.count(F.lit(1)).alias("n_rows")).withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1))
    counts = written(counts)  # a row a pair of ids
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row an id of B
    return written(counts.join(F.broadcast(most), "b").select("pair", "count", "n_rows", (F.col("count") == F.col("most")).alias("best")))


def alignment_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """Each row's alignment with n_best (links whose pair is the most frequent of its B id) and count_sum (their pairs' counts)."""
    table = written(aligned(docs, id_col, text_col, a, b).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(table)
    each = table.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    known = bounded(counts)
    both = each.join(known, "pair") if known is not counts else join_sized(each, counts, ["pair"], "n_rows", table.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0])
    sums = both.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = table.drop("pairs", "times").join(sums, "row", "left")
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
