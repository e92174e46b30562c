"""Byte-level BPE on padded numpy matrices.

The distinct pre-tokens of a batch are encoded together. They are put into buckets by length; each bucket
is a matrix with one pre-token a row. In every round each row merges its leftmost pair of lowest rank. The
rank of a pair comes from an open-addressing hash table of all pairs that join to a token. Positions
that a merge empties are skipped by neighbour links and squeezed out when half of a matrix is empty; rows
with no pair left leave the matrix.

Rows longer than ``LONG`` bytes (text without any break) use a heap over the same table, whose cost is
n log n in their length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import spread

#: Fixed value: the pre-token pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
LONG = 2048
_MULT = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class PairTable:
    """Hash table from a pair of token ids to the id of the joined token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values()) + 1
        keys, vals = [], []
        for tok, r in ranks.items():
            for i in range(1, len(tok)):
                a, b = ranks.get(tok[:i]), ranks.get(tok[i:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    vals.append(r)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.vals = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        k, v = np.array(keys, np.int64), np.array(vals, np.int32)
        slot = self._slot(k)
        while len(k):  # place all whose slot is free, move the rest one on
            free = self.keys[slot] < 0
            first = np.zeros(len(k), bool)
            _, at = np.unique(slot, return_index=True)
            first[at] = True
            put = free & first
            self.keys[slot[put]], self.vals[slot[put]] = k[put], v[put]
            k, v, slot = k[~put], v[~put], (slot[~put] + 1) & self.mask

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * _MULT) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs, NONE where a pair doesn't join; a negative id joins with nothing."""
        k = a.astype(np.int64) * self.base + b
        k = np.where((a < 0) | (b < 0), np.int64(-2), k)
        slot = self._slot(k)
        found = self.keys[slot]
        out = np.where(found == k, self.vals[slot], NONE)
        todo = np.flatnonzero((found != k) & (found >= 0) & (k >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == k[todo]
            out[todo[hit]] = self.vals[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = PairTable(ranks)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole = ranks

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and the number of ids of each."""
        n = len(words)
        counts = np.zeros(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # word numbers, matrix of ids padded with -1
        lens = np.fromiter(map(len, words), np.int64, n)
        wide = np.where(lens <= 8, lens, np.where(lens <= 64, (lens + 3) // 4 * 4, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64)))
        for w in np.unique(wide[(lens > 0) & (lens <= LONG)]):
            at = np.flatnonzero((wide == w) & (lens > 0) & (lens <= LONG))
            step = max(1, (1 << 22) // int(w))
            for i in range(0, len(at), step):
                parts.append(self._bucket(words, at[i : i + step], lens, int(w)))
        for i in np.flatnonzero(lens > LONG):
            ids = self._long(words[i])
            parts.append((np.array([i]), ids[None, :]))
        for at, m in parts:
            counts[at] = (m >= 0).sum(1)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if n else np.zeros(0, np.int64)
        flat = np.empty(int(counts.sum()), np.int32)
        for at, m in parts:
            keep = m >= 0
            rows, cols = np.nonzero(keep)
            flat[starts[at][rows] + (np.cumsum(keep, 1) - 1)[rows, cols]] = m[rows, cols]
        return flat, counts

    def _bucket(self, words, at, lens, width):
        joined = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in at), np.uint8).reshape(len(at), width)
        ids = self.byte[joined]
        ids[np.arange(width) >= lens[at][:, None]] = -1
        out = np.full((len(at), width), -1, np.int32)
        rows, live = np.arange(len(at)), width
        m = ids
        if width > 1:
            rank = np.full(m.shape, NONE, np.int32)
            rank[:, :-1] = self.pairs.get(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(at), -1)
            nxt = np.broadcast_to(np.arange(1, live + 1, dtype=np.int32), m.shape).copy()
            prv = nxt - 2
            merged = 0
            while len(rows):
                j = rank.argmin(1)
                r = np.arange(len(rows))
                best = rank[r, j]
                on = best < NONE
                if not on.all():
                    done = ~on
                    out[rows[done], :live] = m[done]
                    rows, m, rank, nxt, prv, j, best = rows[on], m[on], rank[on], nxt[on], prv[on], j[on], best[on]
                    r = np.arange(len(rows))
                    if not len(rows):
                        break
                gone = nxt[r, j]
                after = nxt[r, gone]
                m[r, j] = best
                m[r, gone] = -1
                rank[r, gone] = NONE
                nxt[r, j] = after
                has = after < live
                prv[r[has], after[has]] = j[has]
                right = np.where(has, m[r, np.minimum(after, live - 1)], -1)
                before = prv[r, j]
                left = np.where(before >= 0, m[r, np.maximum(before, 0)], -1)
                new = self.pairs.get(np.concatenate([best, left]), np.concatenate([right, best]))
                rank[r, j] = new[: len(r)]
                hb = before >= 0
                rank[r[hb], before[hb]] = new[len(r) :][hb]
                merged += 1
                if live >= 16 and merged * 2 >= live:  # every row has lost at least that many positions
                    keep = m >= 0
                    most = int(keep.sum(1).max())
                    order = np.argsort(~keep, axis=1, kind="stable")[:, :most]
                    m = np.take_along_axis(m, order, 1)
                    rank = np.take_along_axis(rank, order, 1)
                    rank[m < 0] = NONE
                    live, merged = most, 0
                    nxt = np.broadcast_to(np.arange(1, live + 1, dtype=np.int32), m.shape).copy()
                    prv = nxt - 2
                    pad = m < 0
                    n_live = (~pad).sum(1)
                    nxt[np.arange(len(m)), np.maximum(n_live - 1, 0)] = live
        else:
            out[:, :live] = m
        return at, out

    def _long(self, word: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(word, np.uint8)]
        rank = self.pairs.get(ids[:-1], ids[1:])
        while len(rank):
            best = rank.min()
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # overlapping pairs: of each run every other one
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            if len(at) > 1 and self._early(ids, at, best):
                at = at[:1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = best
            moved = (np.cumsum(keep) - 1)[at]
            ids, rank = ids[keep], rank[keep[1:]]  # the rank of a pair stays with its right member
            near = np.unique(np.concatenate([moved - 1, moved]))
            near = near[(near >= 0) & (near < len(ids) - 1)]
            rank[near] = self.pairs.get(ids[near], ids[near + 1])
        return ids

    def _early(self, ids: np.ndarray, at: np.ndarray, best: int) -> bool:
        """Whether merging the pairs at these places from left to right makes a pair of rank ``best`` or lower on the way."""
        left, right = at - 1, at + 2
        before = np.where(left >= 0, ids[np.maximum(left, 0)], -1)
        before[1:][at[1:] - at[:-1] == 2] = best  # the pair before has been merged by then
        after = np.where(right < len(ids), ids[np.minimum(right, len(ids) - 1)], -1)
        made = np.full(len(at), best, np.int32)
        return bool((self.pairs.get(before, made) <= best).any() or (self.pairs.get(made, after) <= best).any())


class _Words(dict):
    def __missing__(self, k):
        self[k] = i = len(self)
        return i


class Encoder:
    """Encodes texts; keeps the ids of the pre-tokens it has met, at most ``keep`` of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, keep: int = 400_000):
        self.bpe, self.find, self.keep = Bpe(ranks), regex.compile(pattern).findall, keep
        self._reset()

    def _reset(self) -> None:
        self.words = _Words()
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens of all texts, one after the other, and how many each text has."""
        if len(self.words) > self.keep:
            self._reset()
        known, get, nums, per = len(self.words), self.words.__getitem__, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                w = self.find(t)
                per[i] = len(w)
                nums.append(np.fromiter(map(get, w), np.int64, len(w)))
        if len(self.words) > known:
            import itertools

            new = [w.encode("utf-8", "surrogatepass") for w in itertools.islice(self.words, known, None)]
            flat, count = self.bpe.encode_words(new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])
        return (np.concatenate(nums) if nums else np.empty(0, np.int64)), per

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each (one more than texts)."""
        nums, per = self._numbers(texts)
        lens = self.count[nums]
        ends = np.cumsum(lens)
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(per)]])
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[nums] - (ends - lens), lens)
        return self.flat[take], offsets

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        nums, per = self._numbers(texts)
        ends = np.concatenate([[0], np.cumsum(self.count[nums])])[np.concatenate([[0], np.cumsum(per)])]
        return np.diff(ends)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _shipped(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and broadcast: workers need no copy of their own. A vocabulary has a fixed size."""
    with open(path, "rb") as f:
        data = f.read()
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))


def encoder(shipped, pattern: str = PATTERN) -> Encoder:
    """The worker's encoder for a vocabulary; made once a Python worker."""
    name, data = shipped.value
    if (name, pattern) not in _ENCODERS:
        _ENCODERS[name, pattern] = Encoder(parse_ranks(data), pattern)
    return _ENCODERS[name, pattern]


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together, one row at least."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, s in enumerate(size.tolist()):
        if i > lo and (total + s > most or i - lo >= 8192):
            yield lo, i
            lo, total = i, 0
        total += s
    if len(size) > lo:
        yield lo, len(size)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``key`` and ``ids`` (array of int): the token ids of every row's text, without special tokens.

    Null and empty texts give an empty list. Text that looks like a special token is ordinary text. One row
    goes out for each row in; null keys are kept. Other columns are not read.
    """
    src = df.select(F.col(key), F.col(text).cast("string").alias("__t"))
    schema = f"`{key}` {src.schema[key].dataType.simpleString()}, ids array<int>"

    shipped = _shipped(df, ranks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                ids, off = enc.encode(b.column(1)[lo:hi].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], lists], names=[key, "ids"])

    return spread(src).mapInArrow(run, schema)


def count_column(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``key`` and ``n_tokens`` (long): the number of token ids of every row's text; 0 for null and empty."""
    src = df.select(F.col(key), F.col(text).cast("string").alias("__t"))
    schema = f"`{key}` {src.schema[key].dataType.simpleString()}, n_tokens long"

    shipped = _shipped(df, ranks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shipped)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                n = enc.lengths(b.column(1)[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return spread(src).mapInArrow(run, schema)


def decode_column(df: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``key`` and ``text``: the texts that the ids stand for. Null gives null, an empty list an empty text; ids without a token are an error."""
    src = df.select(F.col(key), F.col(ids).cast("array<int>").alias("__i"))
    schema = f"`{key}` {src.schema[key].dataType.simpleString()}, text string"
    shipped = _shipped(df, ranks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {r: t for t, r in encoder(shipped).bpe.whole.items()}
        for b in batches:
            texts = [None if x is None else b"".join(map(token.__getitem__, x)).decode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return src.mapInArrow(run, schema)
