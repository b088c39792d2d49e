"""Language-model scores by a probabilistic suffix tree over words.

Tokens are words, A-Z lower-cased, then one end; a start precedes them as a context only. The root's distribution is
(c + 1) / (N + V + 1) from counts of all training tokens. A context is the last tokens, of any number. Its explicit next
symbols are those seen after it at least LEAST times; they have (count - 0.75) / context count, and what is left goes
to all other symbols as its longest shorter context has them (Katz), so each distribution sums to one. A context is
retained if its distribution diverges: the log-likelihood it gains over its suffix, in nats, is at least half the
logarithm of its count for each explicit symbol. A token is scored by the longest retained context before it.

The tree grows a level (a word more of context) with each pass, until nothing is left to extend or `depth` is reached (by
default there is no such end). Extended are contexts that diverge, and those that don't but whose suffix does: one level
without news is bridged, two in a row end a branch. Contexts that diverge are retained in the end, and all their suffixes
with them. From level DEEP on passes read windows: the tokens whose contexts still grow, with the tokens before them that
the next levels can need, as few texts' tokens go that deep.

Neither LEAST nor the depth depends on the corpus. Sequences of words are counted in tasks, dealt to places by a hash (packed: a row for
a task and place, with numbers in a list of its words), and those that occur LEAST times go on to the place of their context's last word.
There all is that a longer context needs of its suffixes, so a level is grown from the one before it without joins of rows, and what
is retained is found in one step. A place is for PLACE_TOKENS training tokens. Levels are written tables. Documents go to blocks
of about BLOCK_CHARS characters, and a block gets the values of its own distinct keys (hashes of words, contexts, and contexts
with a symbol), which are looked up place by place. Blocks take turns (TURNS, however many they are), as what they ask for and get is more than
all that is learned: a turn's scores are written, and what it shuffled goes, before the next one begins. A bitmap of bounded size (FILTER_BITS) is gathered and broadcast; it spares
most keys that no table has, and what it lets through in vain, the lookups drop.

Defined cases: null or empty text is the end token alone; the training part is any row filter; an empty training part
gives N = V = 0 and base probability 1; rows that share a doc_id are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, discard, mix, release, signed, small_batches, word_hashes, written

END, START = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0x57A4757A4757A471)
BREAK = np.uint64(0xB4EAB4EAB4EAB4EB)  # in windows, before tokens whose left neighbours are left out
ROOT, STEP = np.uint64(0x5EED5EED5EED5EED), np.uint64(0xD1342543DE82EF95)
LEAST = 3
SLICE = 100  # texts whose tokens are gone through at once, so that what is made of them stays in a cache
FILTER_BITS = 27, 29  # at least and at most
BLOCK_CHARS = 24_000_000
DISCOUNT = 0.75
HELD = 8_000_000  # numbers (distinct keys, and what goes with them) that a task sums up before it sends them on
PLACE_TOKENS = 1_000_000  # training tokens for each of the places that sequences are dealt to
DEEP = 4  # the level from which on passes read windows
WINDOW_TOKENS = 1 << 16  # of a row of windows
TURNS, TURN_BLOCKS = 4, 8  # blocks are scored in so many turns at most, of so many blocks at least


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of 64-bit keys that are hashes: their upper bits are sorted with the places below them, which is some times as fast; where
    keys of equal upper bits come out of order, those are sorted by themselves."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    whole = keys.view(np.uint64) ^ np.uint64(1 << 63 if keys.dtype.kind == "i" else 0)
    both = whole & ~low | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    whole = whole[order]
    wrong = np.flatnonzero(whole[1:] < whole[:-1])
    if len(wrong) > 1000:
        return np.argsort(keys, kind="stable")
    for at in np.unique(both[wrong] & ~low).tolist():
        lo, hi = np.searchsorted(both, np.array([at, at | int(low)], np.uint64)) + np.array([0, 1])
        own = np.sort(order[lo:hi])
        order[lo:hi] = own[np.argsort(keys[own], kind="stable")]
    return order


class _Sums:
    """Counts of 64-bit keys with the words that a key stands for, summed up within a task."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *words: np.ndarray) -> None:
        if words:
            order = _order(keys)
            keys = keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
            k, n, at = keys[first], np.diff(first, append=len(keys)), order[first]
        else:
            k, n = np.unique(keys, return_counts=True)
        self.parts.append([k, n, *(w[at] for w in words)])
        self.size += len(k) * (2 + len(words))

    def full(self) -> bool:
        """Whether it is time to send: the distinct keys are many."""
        if self.size > HELD:
            self.parts = [self.summed()]
            self.size = len(self.parts[0][0]) * len(self.parts[0])
        return self.size > HELD // 4 * 3

    def summed(self) -> list[np.ndarray]:
        """[keys, counts, *words]"""
        keys, n, *words = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        return _summed(keys, n, words)

    def take(self) -> list[np.ndarray]:
        out = self.summed() if self.parts else []
        self.__init__()
        return out


def _summed(keys: np.ndarray, n: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    order = _order(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return [keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0], *(w[order[first]] for w in words)]


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of numbers, the first byte of all of them first."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.reshape(-1)


def _numbers(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _sent(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys, as the gaps between them, and their values."""
    gaps = np.diff(keys.view(np.uint64), prepend=np.zeros(1, np.uint64))
    return pa.compress(np.concatenate([_planes(x) for x in (gaps, *values)]).tobytes(), codec="zstd", asbytes=True)


def _received(blob: bytes, rows: int, values: int = 0) -> tuple[np.ndarray, ...]:
    """The keys, sorted as they were, and so many columns of values (64-bit floats)."""
    raw = np.frombuffer(pa.decompress(blob, 8 * rows * (1 + values), codec="zstd"), np.uint8) if rows else np.zeros(0, np.uint8)
    gaps, *own = (_numbers(raw[8 * rows * k : 8 * rows * (k + 1)], np.float64 if k else np.uint64) for k in range(1 + values))
    return signed(np.cumsum(gaps, dtype=np.uint64)), *own


def _packed(place: np.ndarray, columns: list[np.ndarray], n: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """A row (place, rows, kinds, blob) for each place: words of each column as numbers in a list of the blob's distinct words, counts and
    other 64-bit columns."""
    order = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order], prepend=-1))
    rows: list[tuple[int, int, int, bytes]] = []
    for lo, hi in zip(cuts, [*cuts, len(order)][1:], strict=True):
        own = order[lo:hi]
        own = own[_order(columns[0][own])]
        words = np.concatenate([c[own] for c in columns])
        by_word = _order(words)
        words = words[by_word]
        new = np.diff(words, prepend=~words[:1]) != 0
        kinds, at = words[new], np.empty(len(words), np.uint32)
        at[by_word] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        parts = [kinds.view(np.uint8), *(_planes(x) for x in at.reshape(len(columns), -1)), _planes(n[own]), *(x[own].view(np.uint8) for x in more)]
        rows.append((int(place[own[0]]), len(own), len(kinds), pa.compress(np.concatenate(parts).tobytes(), codec="zstd", asbytes=True)))
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["place", "rows", "kinds", "blob"])


PACKED = "place int, rows int, kinds int, blob binary"


def _unpacked(table: pa.Table, columns: int, more: int = 0) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """(columns, n, others) of all rows."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(columns)] + [[np.zeros(0, np.int64)] for _ in range(1 + more)]
    for _, rows, kinds, blob in zip(*(table.column(c).to_pylist() for c in ("place", "rows", "kinds", "blob")), strict=True):
        raw = np.frombuffer(pa.decompress(blob, 8 * kinds + (4 * columns + 8 + 8 * more) * rows, codec="zstd"), np.uint8)
        words, raw = raw[: 8 * kinds].view(np.uint64), raw[8 * kinds :]
        for k in range(columns):
            out[k].append(words[_numbers(raw[4 * rows * k : 4 * rows * (k + 1)], np.uint32)])
        raw = raw[4 * rows * columns :]
        out[columns].append(_numbers(raw[: 8 * rows], np.int64))
        for k in range(more):
            out[columns + 1 + k].append(raw[8 * rows * (k + 1) : 8 * rows * (k + 2)].view(np.int64))
    whole = [np.concatenate(x) for x in out]
    return whole[:columns], whole[columns], whole[columns + 1 :]


def _place_of(keys: np.ndarray, places: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(40)).astype(np.int64) % places


def _place_column(key: str, places: int) -> Column:
    return (F.shiftrightunsigned(key, 40) % places).cast("int")


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for lo in range(0, len(batch), SLICE):
        yield _tokens(batch.column(0).slice(lo, SLICE))[0]


def _windows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for row in batch.column(0):
        yield np.frombuffer(row.as_buffer(), np.uint64)


Read = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def _counted(texts: DataFrame) -> DataFrame:
    """(k, n): how often each token occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            t, _ = _tokens(batch.column(0))
            sums.add(signed(t[t != START]))
            if sums.full():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums.take()], ["k", "n"])
        if sums.parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums.take()], ["k", "n"])

    return texts.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def _sequences(texts: DataFrame, level: int, known: Broadcast, read: Read, places: int) -> DataFrame:
    """The sequences (the words of a context of `level` words, last one first, and the token) that occur LEAST times, packed, by the
    place of the context's last word (of the token, for the first level). A BREAK instead of a token: the context itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for t in read(batch):
                sums.add(*(_extensions(t, level, known.value) if level > 1 else _pairs(t, known.value)))
                if sums.full():
                    yield sent(*sums.take())
        if sums.parts:
            yield sent(*sums.take())

    def sent(keys: np.ndarray, n: np.ndarray, *words: np.ndarray) -> pa.RecordBatch:
        return _packed(_place_of(keys, places), list(words), n)

    def merge(table: pa.Table) -> pa.Table:
        words, n, _ = _unpacked(table, level + 1)
        key, *_ = _hashes(words)
        _, n, *words = _summed(key, n, words)
        ok = n >= LEAST
        words, n = [w[ok] for w in words], n[ok]
        return pa.Table.from_batches([_packed(_place_of(words[0 if level > 1 else -1], places), words, n)])

    return texts.mapInArrow(count, PACKED).groupBy("place").applyInArrow(merge, PACKED)


def _hashes(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, context, context without its first word, key without it) of sequences: the key is the context's where the token is a BREAK."""
    *left, token = words
    g, e = np.full(len(token), ROOT), token
    for w in left:
        suffix, up = g, e
        g, e = mix(g * STEP + w), mix(e * STEP + w)
    own = token == BREAK
    return np.where(own, g, e), g, suffix, np.where(own, suffix, up)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, with a start before and an end after each text; and the numbers of words."""
    w, n = word_hashes(*buffers(column))
    out = np.full(len(w) + 2 * len(n), START)
    ends = np.cumsum(n + 2)
    out[ends - 1] = END
    out[np.arange(len(w)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = w
    return out, n


class _Lookup:
    """Where 64-bit keys are in an array of distinct ones, -1 for those that aren't: a hash table with linear probing, all keys of a call at
    a time. A binary search would miss the cache at each step."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = max(4, int(len(known) * 2).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32 if bits < 31 else np.int64)
        left, slot = np.arange(len(known)), self._first(known)
        while left.size:
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            out = self.slots[slot] != left
            left, slot = left[out], slot[out] + 1 & self.last

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys, np.int64)
        if not len(self.known):
            return np.full(len(keys), -1, np.int64)
        slot, at, found = self._first(keys), None, None
        while at is None or at.size:
            here = self.slots[slot]  # -1, the last key's place, never matches: a key that is known comes before an empty slot
            hit = self.known[here] == (keys if at is None else keys[at])
            more = np.flatnonzero(~hit & (here >= 0))
            if at is None:
                found, at = np.where(hit, here, -1).astype(np.int64, copy=False), more
            else:
                found[at[hit]] = here[hit]
                at = at[more]
            slot = slot[more] + 1 & self.last
        return found


def _place(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is among the sorted known ones; -1 if it isn't. For few keys or keys in order."""
    if not len(known):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def _bitmap(n: int) -> np.ndarray:
    """An empty bitmap for what is learned from n tokens."""
    return np.zeros(1 << min(max(FILTER_BITS[0], n.bit_length() + 1), FILTER_BITS[1]) - 3, np.uint8)


def _shift(bits: np.ndarray) -> int:
    return 62 - len(bits).bit_length()


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bitmap has a key's bit."""
    shift = _shift(bits)
    of = (keys >> np.uint64(shift)).astype(np.uint8) & np.uint8(7)
    return (bits.take((keys >> np.uint64(shift + 3)).view(np.int64)) >> of & np.uint8(1)).view(bool)


def _marked(keys: DataFrame, bits: np.ndarray) -> np.ndarray:
    """The bitmap with the bits of keys `k` too."""
    at = keys.select(F.shiftrightunsigned("k", _shift(bits)).alias("at"))
    found = at.groupBy(F.shiftright("at", 15).alias("page")).agg(F.expr("bitmap_construct_agg(at & 32767)").alias("bits")).toArrow()
    out = bits.reshape(-1, 4096).copy()
    for page, own in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        out[page] |= np.frombuffer(own, np.uint8)
    return out.reshape(-1)


class _Climb:
    """The contexts of all tokens of some texts, a word longer with each step: at (places of the tokens), g (hashes of their
    contexts) and e (of contexts with the token)."""

    def __init__(self, t: np.ndarray):
        starts, breaks = t == START, t == BREAK
        place = np.arange(len(t))
        self.t, self.at = t, np.flatnonzero(~(starts | breaks))
        self.room = (place - np.maximum.accumulate(np.where(starts, place, np.where(breaks, place + 1, 0))))[self.at]
        self.g, self.e, self.level = np.full(len(self.at), ROOT), t[self.at], 0

    def keep(self, ok: np.ndarray) -> None:
        self.at, self.room, self.g, self.e = self.at[ok], self.room[ok], self.g[ok], self.e[ok]

    def step(self) -> np.ndarray:
        """Which of the tokens kept so far have a longer context; they are kept."""
        self.level += 1
        ok = self.room >= self.level
        self.keep(ok)
        left = self.t[self.at - self.level]
        self.g, self.e = mix(self.g * STEP + left), mix(self.e * STEP + left)
        return ok


def _climbed(t: np.ndarray, level: int, bits: np.ndarray) -> tuple[_Climb, np.ndarray]:
    """The tokens with a context of `level` words that may be extended, and whether that may have the token; level 1 or more."""
    climb, frequent = _Climb(t), _has(bits, t)
    ok = (frequent | (t == START))[climb.at - 1]
    climb.keep(ok)
    explicit = frequent[climb.at]
    rare = np.zeros(len(t), bool)  # tokens that are too rare after the words before them
    while climb.level < level:
        explicit = explicit[climb.step()]
        ok = ~rare[climb.at - 1]
        rare[climb.at[~ok]] = True
        climb.keep(ok)
        explicit = explicit[ok]
        ok = _has(bits, climb.g)
        explicit &= _has(bits, climb.e)
        if climb.level == 1:  # where all contexts are kept that have any explicit symbol
            rare[:] = True
            rare[climb.at] = ~explicit
        else:
            rare[climb.at[~explicit]] = True
        climb.keep(ok)
        explicit = explicit[ok]
    if level:
        ok = ~rare[climb.at - 1]
        climb.keep(ok)
        explicit = explicit[ok]
    return climb, explicit


def _pairs(t: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, token before, token) of each token that is frequent, after one that is."""
    at = np.flatnonzero(t != START)
    token, left = t[at], t[at - 1]
    ok = _has(bits, token) & (_has(bits, left) | (left == START))
    token, left = token[ok], left[ok]
    return mix(token * STEP + left), left, token


def _extensions(t: np.ndarray, level: int, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each token with a context of `level` words (2 at least) that may occur LEAST times and whose suffix may be extended:
    (key, words of the context, last one first, token), for the context itself with a BREAK, and for the context with the token if the suffix
    may have it."""
    climb, explicit = _climbed(t, level - 1, bits)
    explicit = explicit[climb.step()]
    at = np.concatenate([climb.at, climb.at[explicit]])
    token = np.concatenate([np.full(len(climb.at), BREAK), t[climb.at[explicit]]])
    return np.concatenate([climb.g, climb.e[explicit]]), *(t[at - k] for k in range(1, level + 1)), token


def _cut(t: np.ndarray, level: int, bits: np.ndarray, margin: int) -> np.ndarray:
    """The tokens with a context of `level` words that may be extended, each with `margin` tokens before it, as far as its text
    goes; a BREAK where tokens are left out."""
    climb, _ = _climbed(t, level, bits)
    change = np.bincount(climb.at - np.minimum(climb.room, margin), minlength=len(t) + 1) - np.bincount(climb.at + 1, minlength=len(t) + 1)
    kept = np.cumsum(change)[:-1] > 0
    at = np.flatnonzero(kept)
    out = t[at]
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    first = first[(out[first] != START) & (out[first] != BREAK)]
    return np.insert(out, first, BREAK)


def _scores(t: np.ndarray, p: np.ndarray, find: Callable[[np.ndarray], np.ndarray], values: np.ndarray) -> np.ndarray:
    """The probability of each token: p is the root's; find gives a key's place among values, -1 if no level has it."""
    p, climb = p.copy(), _Climb(t)
    explicit = np.ones(len(climb.at), bool)  # in all shorter contexts, else in none that is longer
    while climb.at.size:
        explicit = explicit[climb.step()]
        context = find(signed(climb.g))
        ok = context >= 0
        climb.keep(ok)
        context, explicit = context[ok], explicit[ok]
        if climb.at.size:
            value = values[context] * p[climb.at]
            e = np.flatnonzero(explicit)
            own = find(signed(climb.e[e]))
            explicit[e] = own >= 0
            value[e[own >= 0]] = values[own[own >= 0]]
            p[climb.at] = value
    return p


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted. np.unique would hash them, which is many times as slow."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))]


class _Distinct:
    """Distinct keys from many arrays, merged when they have doubled."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.size, self.most = 0, HELD // 4

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(keys)
        self.size += len(keys)
        if self.size > self.most:
            self.parts = [self.whole()]
            self.size = len(self.parts[0])
            self.most = max(HELD // 4, 2 * self.size)

    def whole(self) -> np.ndarray:
        return _distinct(np.concatenate([np.zeros(0, np.int64), *self.parts]))


class Tree:
    """What is learned: numbers of tokens and of distinct ones, their written counts (k, n), a written table (k, v) for each
    level, the bitmap of all these keys, and the tables as they are written. Properties and `probabilities` gather the tables, so they are for small ones."""

    def __init__(self, n: int, v: int, counts: DataFrame, levels: list[DataFrame], bits: np.ndarray, tables: list[DataFrame]):
        self.n, self.v, self.counts, self.levels, self.bits, self.tables = n, v, counts, levels, bits, tables

    def table(self) -> DataFrame:
        """(k, v): counts of tokens; a context's weight of what it leaves over; an explicit symbol's probability."""
        out = self.counts.select("k", F.col("n").cast("double").alias("v"))
        for level in self.levels:
            out = out.unionByName(level)
        return out

    @functools.cached_property
    def gathered(self) -> tuple[_Lookup, np.ndarray]:
        rows = sorted({k: v for level in self.levels for k, v in level.collect()}.items())
        return _Lookup(np.array([k for k, _ in rows], np.int64)), np.array([v for _, v in rows], float)

    @functools.cached_property
    def tokens(self) -> np.ndarray:
        """Sorted signed hashes of the frequent tokens, end and start among them."""
        frequent = [r.k for r in self.counts.where(F.col("n") >= LEAST).collect()]
        return np.unique(np.array([*frequent, *signed(np.array([END, START]))], np.int64))

    @property
    def start(self) -> int:
        return int(_place(self.tokens, signed(np.array([START])))[0])

    @property
    def end(self) -> int:
        return int(_place(self.tokens, signed(np.array([END])))[0])

    @property
    def retained1(self) -> np.ndarray:
        """Which of the tokens are retained as contexts."""
        return self.gathered[0](signed(mix(np.array([ROOT]) * STEP + self.tokens.view(np.uint64)))) >= 0

    def probabilities(self, s: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Of each token of a text, start first, given those before it. s: places among `tokens`, -1 for others; root: the root's
        probabilities."""
        return _scores(np.where(s >= 0, self.tokens[s].view(np.uint64), np.uint64(0)), root, *self.gathered)


def _stored(place: int, **columns: np.ndarray) -> pa.Table:
    """A row (place, many, blob) with columns of any lengths, by name; many: the first one's length."""
    rows = [(name, x.dtype.str, x.tobytes()) for name, x in columns.items()]
    made = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["name", "kind", "bytes"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, made.schema) as out:
        out.write_batch(made)
    return pa.table({"place": pa.array([place], pa.int32()), "many": pa.array([len(next(iter(columns.values())))], pa.int32()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


STORED = "place int, many int, blob binary"


def _restored(blob: bytes) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(raw, kind) for name, kind, raw in zip(*pa.ipc.open_stream(blob).read_all().to_pydict().values(), strict=True)}


def _rests(c: np.ndarray, many: int, p: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each of so many contexts leaves over, now and with its suffix, from its explicit symbols' (context, p, was)."""
    return np.maximum(1 - np.bincount(c, p, many), 1e-9), np.maximum(1 - np.bincount(c, was, many), 1e-9)


def _grown(words: list[np.ndarray], n: np.ndarray, was: np.ndarray, above: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts (g, suffix, size, diverges) that can be extended, and their explicit symbols (k, up, c: the context's place, n, was, p).
    above: whether the context's suffix diverges; was: the symbol's probability given that suffix, nan if it isn't explicit there. p is
    the symbol's probability in the context if it diverges, else in its suffix. k_dead: symbols of other contexts."""
    key, g, suffix, up = _hashes(words)
    own = np.flatnonzero(words[-1] == BREAK)
    own = own[_order(signed(g[own]))]
    e = np.flatnonzero((words[-1] != BREAK) & ~np.isnan(was))
    c = _place(signed(g[own]), signed(g[e]))
    e, c = e[c >= 0], c[c >= 0]
    size, many = n[own], np.bincount(c, minlength=len(own))
    p = (n[e] - DISCOUNT) / size[c]
    rest, rest_was = _rests(c, len(own), p, was[e])
    gain = np.bincount(c, n[e] * np.log(p / was[e]), len(own)) + size * rest * np.log(rest / rest_was)
    diverges = (many > 0) & (gain >= 0.5 * many * np.log(np.maximum(size, 2)))
    live = diverges | (np.bincount(c, above[e], len(own)) > 0)
    there = live[c]
    place = np.cumsum(live) - 1
    kept, own = e[there], own[live]
    return {
        "g": signed(g[own]), "suffix": signed(suffix[own]), "size": size[live], "diverges": diverges[live],
        "k": signed(key[kept]), "up": signed(up[kept]), "c": place[c[there]].astype(np.int32), "n": n[kept], "was": was[kept],
        "p": np.where(diverges[c], p, was[e])[there], "k_dead": signed(key[e[~there]]),
    }


def _retained(grown: list[dict[str, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, v) of each level, of contexts that end with the same words: weights of the retained contexts, and their explicit symbols'
    probabilities."""
    kept: list[np.ndarray] = []
    longer = np.zeros(0, np.int64)
    for x in reversed(grown):
        kept.insert(0, x["diverges"] | np.isin(x["g"], longer))
        longer = x["suffix"][kept[0]]
    keys, values = np.zeros(0, np.int64), np.zeros(0)
    for level, (x, own) in enumerate(zip(grown, kept, strict=True)):
        e = np.flatnonzero(own[x["c"]])
        was = x["was"][e]
        if level:
            at = _place(keys, x["up"][e])
            e, at = e[at >= 0], at[at >= 0]
            was = values[at] if len(at) else np.zeros(0)
        c, p = x["c"][e], (x["n"][e] - DISCOUNT) / x["size"][x["c"][e]]
        rest, rest_was = _rests(c, len(own), p, was)
        there = np.flatnonzero(np.bincount(c, minlength=len(own)))
        order = _order(x["k"][e])
        keys, values = x["k"][e][order], p[order]
        yield np.concatenate([keys, x["g"][there]]), np.concatenate([values, (rest / rest_was)[there]])


def _first_level(pairs: DataFrame, counts: DataFrame, total: int, places: int) -> DataFrame:
    """The pairs, packed with each token's probability at the root, and the contexts of one word, by the place of the word: one occurs as
    a context as often as it occurs, and a start as often as an end."""

    def named(pairs: pa.Table, counts: pa.Table) -> pa.Table:
        (left, token), n, _ = _unpacked(pairs, 2)
        k, many = (np.ascontiguousarray(counts.column(c).to_numpy()) for c in ("k", "n"))
        order = _order(k)
        k, many = k[order], many[order]
        own = many >= LEAST
        word = k[own].view(np.uint64)
        word = np.where(word == END, START, word)
        at = _place(k, signed(token))
        left, token, n, at = left[at >= 0], token[at >= 0], n[at >= 0], at[at >= 0]
        was = np.concatenate([(many[at] + 1) / total if len(at) else np.zeros(0), np.zeros(len(word))])
        left = np.concatenate([left, word])
        return pa.Table.from_batches([_packed(_place_of(left, places), [left, np.concatenate([token, np.full(len(word), BREAK)])], np.concatenate([n, many[own]]), was.view(np.int64))])

    counts = counts.select(_place_column("k", places).alias("place"), "k", "n")
    return pairs.groupBy("place").cogroup(counts.groupBy("place")).applyInArrow(named, PACKED)


def _level(sequences: DataFrame, level: int, shorter: DataFrame | None) -> DataFrame:
    """What is grown at each place (_grown, stored), from packed sequences and what was grown a level before."""

    def first(own: pa.Table) -> pa.Table:
        words, n, (was,) = _unpacked(own, 2, 1)
        return _stored(own.column("place")[0].as_py(), **_grown(words, n, was.view(float), np.ones(len(n), bool)))

    def next_one(own: pa.Table, shorter: pa.Table) -> pa.Table:
        if not len(own) or not len(shorter):
            return own.select(["place", "rows", "blob"]).slice(0, 0).rename_columns(["place", "many", "blob"])
        words, n, _ = _unpacked(own, level + 1)
        before = _restored(shorter.column("blob")[0].as_py())
        order = _order(before["k"])
        at = _place(before["k"][order], signed(_hashes(words)[3]))
        found = at >= 0
        at = order[at[found]] if len(order) else at[found]
        was, above = np.full(len(n), np.nan), np.zeros(len(n), bool)
        was[found], above[found] = before["p"][at], before["diverges"][before["c"][at]]
        return _stored(own.column("place")[0].as_py(), **_grown(words, n, was, above))

    if shorter is None:
        return sequences.groupBy("place").applyInArrow(first, STORED)
    return sequences.groupBy("place").cogroup(shorter.groupBy("place")).applyInArrow(next_one, STORED)


def _keys(stored: DataFrame, *names: str) -> DataFrame:
    """(k) of all of these columns."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = _restored(blob)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for c in names]))], ["k"])

    return stored.select("blob").mapInArrow(keys, "k long")


def _levels(grown: list[DataFrame]) -> DataFrame:
    """(level, k, v) of what is retained."""

    def retain(own: pa.Table) -> pa.Table:
        found = dict(zip(own.column("level").to_pylist(), own.column("blob").to_pylist(), strict=True))
        out = [(np.full(len(k), level, np.int32), k, v) for level, (k, v) in enumerate(_retained([_restored(found[level]) for level in sorted(found)]), 1)]
        return pa.table(dict(zip(["level", "k", "v"], (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    every = functools.reduce(DataFrame.unionByName, (x.withColumn("level", F.lit(level)) for level, x in enumerate(grown)))
    return every.groupBy("place").applyInArrow(retain, "level int, k long, v double")


def train(texts: DataFrame, depth: int | None = None) -> tuple[Tree, DataFrame]:
    """The tree, of contexts of up to `depth` words if that is given, and the written counts (k, n) of all tokens of the only
    column."""
    spark = texts.sparkSession
    small_batches(spark)
    counts = written(_counted(texts))
    release(spark)
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    places = max(1, math.ceil(n / PLACE_TOKENS))
    bits = _marked(counts.where(F.col("n") >= LEAST).select("k"), _bitmap(n))
    grown, now, read, reach, cut_at = [], texts, _texts, 0, 0
    while depth is None or len(grown) < depth:
        known, level = spark.sparkContext.broadcast(bits), len(grown) + 1
        if level >= DEEP and (level > reach or 2 * level >= 3 * cut_at):
            whole = level > reach  # else windows that reach far enough are cut again, where fewer contexts grow
            reach, cut_at = 4 * level if whole else reach, level
            cut = _cutter(level - 1, known, reach, _texts if whole else read)
            before, now, read = now, written((texts if whole else now).mapInArrow(cut, "t binary")), _windows
            if before is not texts:
                discard(spark, before)
        found = _sequences(now, level, known, read, places)
        if level == 1:
            found = _first_level(found, counts, n + v + 1, places)
        found = written(_level(found, level, grown[-1] if grown else None))
        release(spark)
        known.destroy()
        if found.where("many > 0").isEmpty():
            discard(spark, found)
            break
        grown.append(found)
        bits = _marked(_keys(found, "k", "g", "k_dead"), bits)
        release(spark)
    levels: list[DataFrame] = []
    tables = [counts]
    bits = np.zeros_like(bits)
    if grown:
        table = written(_levels(grown))
        tables.append(table)
        bits = _marked(table.select("k"), bits)
        levels = [table.where(F.col("level") == k + 1).select("k", "v") for k in range(table.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0])]
    discard(spark, *grown, *([now] if now is not texts else []))
    release(spark)
    return Tree(n, v, counts, levels, bits, tables), counts


def _cutter(level: int, known: Broadcast, margin: int, read: Read) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for t in read(batch):
                held.append(_cut(t, level, known.value, margin))
            rows = [r for t in held for r in _rows_of(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["t"])

    return cut


def _rows_of(t: np.ndarray) -> Iterator[bytes]:
    """Windows as rows of about WINDOW_TOKENS, cut where one begins."""
    begins = np.flatnonzero((t == START) | (t == BREAK))
    lo = 0
    while lo < len(t):
        later = np.searchsorted(begins, lo + WINDOW_TOKENS)
        hi = int(begins[later]) if later < len(begins) else len(t)
        yield t[lo:hi].tobytes()
        lo = hi


def scored(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", depth: int | None = None) -> DataFrame:
    """(id, learns, n_tokens, n_known, train_tokens, base_score, score) of each row; the model is made from those that learn,
    of contexts of any length or of up to `depth` words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), learns.alias("learns"), F.col(text_col).alias("text"))
    tree, _ = train(rows.where("learns").select("text"), depth)
    n_train, kinds, most, bits = tree.n, tree.v, len(tree.levels), spark.sparkContext.broadcast(tree.bits)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    # by the text too, so that rows without an id spread
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.col("text")), F.lit(blocks)).cast("int"))

    places = max(1, math.ceil(n_train / PLACE_TOKENS))
    table = written(_dealt(tree.table(), places))
    discard(spark, *tree.tables)
    table.isEmpty()  # the session holds what its last job has shuffled, until there is another one
    release(spark)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct tokens of each block of the task, and the other keys that the tree may have, by place."""
        seen: dict[int, _Distinct] = {}
        for batch in batches:
            block = batch.column(3).to_numpy()
            for b in np.unique(block).tolist():
                own = seen.setdefault(b, _Distinct())
                for t in _texts(pa.RecordBatch.from_arrays([batch.column(2).filter(pa.array(block == b))], ["text"])):
                    climb, found = _Climb(t), [t]
                    explicit = np.ones(len(climb.at), bool)
                    while climb.at.size and climb.level < most:
                        explicit = explicit[climb.step()]
                        ok = _has(bits.value, climb.g)
                        climb.keep(ok)
                        explicit = explicit[ok]
                        explicit[explicit] = _has(bits.value, climb.e[explicit])
                        found += [climb.g, climb.e[explicit]]
                    own.add(_distinct(signed(np.concatenate(found))))
        for b, found in seen.items():
            own = found.whole()
            place = _place_of(own, places)
            own = own[np.argsort(place, kind="stable")]
            at, many = np.unique(place, return_counts=True)
            parts = [_sent(x) for x in np.split(own, np.cumsum(many)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b, np.int32)), pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(parts, pa.binary())], ["block", "place", "rows", "blob"])

    def find(wanted: pa.Table, table: pa.Table) -> pa.Table:
        """Keys that are known and their values, for each block that wants some at a place."""
        own = list(zip(table.column("blob").to_pylist(), table.column("rows").to_pylist(), strict=True))
        k, v = _received(*own[0], 1) if own else (np.zeros(0, np.int64), np.zeros(0))
        out = []
        for blob, many in zip(wanted.column("blob").to_pylist(), wanted.column("rows").to_pylist(), strict=True):
            (keys,) = _received(blob, many)
            at = _place(k, keys)
            found = at >= 0
            out.append((int(found.sum()), _sent(keys[found], v[at[found]] if len(v) else np.zeros(0))))
        return pa.table({"block": wanted.column("block"), "rows": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})

    kind = rows.schema["id"].dataType.simpleString()

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        got = [_received(blob, many, 1) for many, blob in zip(own.column("rows").to_pylist(), own.column("blob").to_pylist(), strict=True)]
        n = np.concatenate([np.zeros(0), *(x[1] for x in got)])
        known, out = _Lookup(np.concatenate([np.zeros(0, np.int64), *(x[0] for x in got)])), []
        del got
        for batch in texts.select(["text"]).combine_chunks().to_batches(max_chunksize=SLICE):
            t, words = _tokens(batch.column(0))
            at = known(signed(t))
            c = np.where(at >= 0, n[at] if len(n) else 0, 0)
            base = (c + 1) / (n_train + kinds + 1)
            p = _scores(t, base, known, n)
            real = t != START
            doc = np.repeat(np.arange(len(words)), words + 2)[real]
            out.append([words + 1, *(np.bincount(doc, x[real], len(words)) for x in (c > 0, np.log10(base), np.log10(p)))])
        whole = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        columns = [texts.column("id"), texts.column("learns"), *(pa.array(x.astype(np.int64)) for x in whole[:2]), pa.array(np.full(len(whole[0]), n_train, np.int64)), *(pa.array(x.astype(float)) for x in whole[2:])]
        return pa.Table.from_arrays(columns, ["id", "learns", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"id {kind}, learns boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scores(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(blocks, "block")
        wanted = rows.mapInArrow(words_of, "block int, place int, rows int, blob binary")  # of the same columns as below, so the texts are shuffled once
        known = wanted.groupBy("place").cogroup(table.groupBy("place")).applyInArrow(find, "block int, rows int, blob binary")
        return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema)

    turns = max(1, min(TURNS, blocks // TURN_BLOCKS))
    if turns == 1:
        return scores(rows)
    done = []
    for turn in range(turns):
        done.append(written(scores(rows.where(F.col("block") % turns == turn))))
        done[-1].isEmpty()  # as above
        release(spark)
    discard(spark, table)
    bits.destroy()
    return functools.reduce(DataFrame.unionByName, done)


def _dealt(table: DataFrame, places: int) -> DataFrame:
    """(k, v) as a row (place, rows, blob) for each place that keys are dealt to."""

    def pack(own: pa.Table) -> pa.Table:
        k, v = (np.ascontiguousarray(own.column(c).to_numpy()) for c in ("k", "v"))
        order = _order(k)
        return pa.table({"place": own.column("place").slice(0, 1), "rows": pa.array([len(k)], pa.int32()), "blob": pa.array([_sent(k[order], v[order])], pa.binary())})

    return table.select(_place_column("k", places).alias("place"), "k", "v").groupBy("place").applyInArrow(pack, "place int, rows int, blob binary")
