"""Most similar vectors by multiprobe p-stable hashing.

A table of the index has ``m`` functions floor((a.x + b) / w) with normal a; the vectors have unit length, so
cosine and Euclidean distance order alike. Every vector visits, besides its own bucket, the perturbed
buckets of the table that are most likely to hold a near vector, in order of the squared distance of its
projections to the bucket's borders. What meets in a bucket is compared by 128-bit sign sketches, and
the candidates of all tables are merged and reranked by exact cosine.

Two searches are built on it:

* :func:`near_pairs`: for every row its ``k`` most similar rows among those of cosine ``min_cos`` or more;
* :func:`nearest`: for a set of query rows their ``k`` most similar rows of any cosine.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize

WIDTH = 1.6  # of a hash cell, for unit vectors
BITS = 1.25  # of selectivity that a function of this width has, measured on isotropic unit vectors
BLOCK = 30_000  # rows of a hot bucket that one task holds of either side


def usable(df: DataFrame, key: str, vector: str = "vector", at: str = "upserted_at", dim: int = 64) -> DataFrame:
    """``id``, ``nid`` (long), ``vec`` (binary, float32 of unit length) of the usable vectors, written to the shared folder.

    Of several rows with a key the one with the latest ``at`` counts (a null time is the earliest; among equal
    times the greatest vector). Null keys, and vectors that are null, not of ``dim`` elements, all zero or that
    hold null, NaN or infinity, give no row.
    """
    src = df.select(F.col(key).cast("string").alias("id"), F.col(at).alias("at"), F.col(vector).cast("array<float>").alias("v")).where("id is not null")
    last = src.groupBy("id").agg(F.max(F.struct("at", "v")).alias("s")).select("id", "s.v").where(f"size(v) = {dim}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1)
            flat = v.flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            with np.errstate(all="ignore"):
                x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
                x /= np.sqrt((x * x).sum(1, keepdims=True))
            ok = np.isfinite(x).all(1)
            raw = np.ascontiguousarray(x[ok].astype("<f4"))
            vec = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(np.arange(0, (len(raw) + 1) * dim * 4, dim * 4, dtype=np.int32)[: len(raw) + 1].tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), vec], names=["id", "vec"])

    out = last.mapInArrow(run, "id string, vec binary").withColumn("nid", F.monotonically_increasing_id())
    return materialize(out.select("nid", "id", "vec"), "vectors")


def _floats(col, dim: int) -> np.ndarray:
    if isinstance(col, pa.Array):
        col = col.to_pylist()
    return np.frombuffer(b"".join(col), "<f4").reshape(-1, dim)


class Family:
    """The hash functions of one table and the order in which a vector visits perturbed buckets."""

    def __init__(self, table: int, m: int, dim: int, probes: int, seed: int):
        g = np.random.default_rng([seed, table, m, dim])
        self.a, self.b = g.normal(size=(dim, m)).astype(np.float32), (g.random(m) * WIDTH).astype(np.float32)
        self.mix = g.integers(1, 2**63 - 1, size=m, dtype=np.int64) | 1
        self.salt, self.m, self.probes = np.int64(g.integers(2**62)), m, probes
        self.templates = self._templates()

    def _templates(self) -> list[tuple[int, ...]]:
        """Sets of ranks among the sorted border distances, cheapest first by their expected sum."""
        m, n = self.m, 2 * self.m
        e = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) if j < m else 1 - (n - j) / (m + 1) + (n - j) * (n - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(n)]
        sets = (s for k in range(5) for s in itertools.combinations(range(min(n, 10)), k))
        return sorted(sets, key=lambda s: (sum(e[i] for i in s), s))[: 4 * self.probes]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, probes) bucket keys; the first is the vector's own."""
        p = (x @ self.a + self.b) / np.float32(WIDTH)
        h = np.floor(p)
        f = p - h
        cell = h.astype(np.int64)
        with np.errstate(over="ignore"):
            own = (cell * self.mix).sum(1) + self.salt
            cost = np.concatenate([f**2, (1 - f) ** 2], 1)
            order = np.argsort(cost, 1, kind="stable")[:, :10]
            c, fn = np.take_along_axis(cost, order, 1), order % self.m
            delta = np.where(order < self.m, -1, 1) * self.mix[fn]
            n = len(x)
            score = np.full((n, len(self.templates)), np.inf, np.float32)
            move = np.zeros((n, len(self.templates)), np.int64)
            for i, s in enumerate(self.templates):
                twice = np.zeros(n, bool)  # a set that moves one function both ways is none
                for u, v in itertools.combinations(s, 2):
                    twice |= fn[:, u] == fn[:, v]
                score[:, i] = np.where(twice, np.inf, sum((c[:, j] for j in s), np.zeros(n, np.float32)))
                for j in s:
                    move[:, i] += delta[:, j]
            best = np.argsort(score, 1, kind="stable")[:, : self.probes]
            keys = own[:, None] + np.take_along_axis(move, best, 1)
        # a template that is invalid for a row repeats the row's own bucket, which grouping removes
        return np.where(np.isinf(np.take_along_axis(score, best, 1)), own[:, None], keys)


@lru_cache(16)
def _family(table: int, m: int, dim: int, probes: int, seed: int) -> Family:
    return Family(table, m, dim, probes, seed)


@lru_cache(4)
def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, 99, dim]).normal(size=(dim, 128)).astype(np.float32)


def _sketch(x: np.ndarray, seed: int) -> np.ndarray:
    return np.packbits(x @ _planes(x.shape[1], seed) > 0, axis=1).view("<i8")


def functions_for(n: int, bucket: int = 250) -> int:
    """Functions a table needs so that about ``bucket`` of ``n`` spread-out vectors share a bucket."""
    return int(min(24, max(2, round(math.log2(max(n, 2) / bucket) / BITS)))) if n > bucket else 2


def _limits(min_cos: float) -> tuple[int, int]:
    """Most differing bits, of 64 and of 128, that a pair of this cosine has but for one in some thousands."""
    p = math.acos(max(-1.0, min(1.0, min_cos))) / math.pi
    return tuple(math.ceil(n * p + 3.5 * math.sqrt(n * p * (1 - p))) for n in (64, 128))


def _meet(nid: np.ndarray, s: np.ndarray, limits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket whose sketches differ in few enough bits."""
    s = s.view(np.uint64)
    left, right, n = [], [], len(nid)
    step = max(16, (1 << 19) // max(n, 1))
    for i in range(0, n, step):
        d = np.bitwise_count(s[i : i + step, 0, None] ^ s[None, i:, 0])
        r, c = np.nonzero(d <= limits[0])
        up = c > r
        r, c = r[up] + i, c[up] + i
        ok = np.bitwise_count(s[r] ^ s[c]).sum(1) <= limits[1]
        left.append(nid[r[ok]])
        right.append(nid[c[ok]])
    a, b = np.concatenate(left or [nid[:0]]), np.concatenate(right or [nid[:0]])
    return np.minimum(a, b), np.maximum(a, b)


def _top(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its k best of y with at least this cosine, itself excluded."""
    a, b = [], []
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ y.T
        s[nx[i : i + 512, None] == ny[None, :]] = -2
        kk = min(k, s.shape[1])
        c = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
        r = np.repeat(np.arange(len(s)), kk)
        c = c.ravel()
        ok = s[r, c] >= least
        a.append(nx[i + r[ok]])
        b.append(ny[c[ok]])
    return np.concatenate(a or [nx[:0]]), np.concatenate(b or [nx[:0]])


def near_pairs(base: DataFrame, k: int = 5, min_cos: float = 0.92, dim: int = 64, tables: int = 3, probes: int = 6, bucket: int = 250, hot: int = 60_000, copies: int = 128, seed: int = 7) -> DataFrame:
    """``id_a``, ``id_b``, ``cos``, ``rank``: for every row of :func:`usable` its ``k`` nearest of cosine ``min_cos`` or more.

    Equal cosines are ranked by id. Of more than ``copies`` rows with exactly equal vectors one stands for
    all in the index; the first of them by id, which are all that can rank among k, are paired with each of
    the others and with every row that meets the one. A bucket of more than ``hot``
    rows is cut into blocks, every two of which are compared exactly by a task of their own, which keeps
    the k best of each row. An empty table gives no rows.
    """
    spark = base.sparkSession
    n = base.count()
    m = functions_for(n, bucket)

    # exact copies in large groups
    copies = max(copies, k)  # each has k others then, which no row outside of the group can outrank
    hashed = base.select("nid", "id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    big = materialize(hashed.groupBy("h1", "h2").agg(F.min("nid").alias("rep"), F.count("*").alias("c")).where(F.col("c") > copies), "copies")
    few = big.count()
    work = base
    extra = None
    if few:
        side = F.broadcast(big) if few <= 100_000 else big
        tagged = hashed.join(side, ["h1", "h2"])
        stand_ins = tagged.where("nid <> rep").select("nid")
        work = materialize(base.join(stand_ins, "nid", "left_anti"), "distinct-vectors")
        # k + 1 first by id, as one of them is left out for itself; the limit comes before the shuffle
        first = tagged.withColumn("i", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("i") <= k + 1)
        hubs = materialize(first.groupBy("h1", "h2", "rep").agg(F.collect_list("nid").alias("hubs")), "hubs")
        near = F.broadcast(hubs) if few <= 100_000 else hubs
        extra = tagged.join(near.drop("rep"), ["h1", "h2"]).select("nid", F.explode("hubs").alias("other")).where("nid <> other")
        extra = extra.select(F.least("nid", "other").alias("a"), F.greatest("nid", "other").alias("b"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _floats(b.column(0), dim)
                keys = [np.unique(_family(t, m, dim, probes, seed).buckets(x), return_counts=True) for t in range(tables)]
                for u, c in keys:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], names=["bucket", "c"])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nid, x = b.column(0).to_numpy(), _floats(b.column(1), dim)
            sk = _sketch(x, seed)
            for t in range(tables):
                keys = _family(t, m, dim, probes, seed).buckets(x)
                r = np.repeat(np.arange(len(x)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nid[r]), pa.array(sk[r, 0]), pa.array(sk[r, 1])], names=["bucket", "nid", "s0", "s1"])

    limits = _limits(min_cos)

    def blocks(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The k best of each row of two blocks of a hot bucket (of one, if the cell holds one), by exact cosine."""
        nid, first = np.unique(t.column(2).to_numpy(), return_index=True)
        take = pa.array(first)
        x, part = _floats(t.column(4).combine_chunks().take(take), dim), t.column(3).to_numpy()[first]
        u = part == part.min()
        got = [_top(x[u], x[u if u.all() else ~u], nid[u], nid[u if u.all() else ~u], k, min_cos - 1e-5)]
        if not u.all():
            got.append(_top(x[~u], x[u], nid[~u], nid[u], k, min_cos - 1e-5))
        a, b = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        return np.minimum(a, b), np.maximum(a, b)

    def sketches(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        nid, first = np.unique(t.column(2).to_numpy(), return_index=True)
        return _meet(nid, np.stack([t.column(3).to_numpy()[first], t.column(4).to_numpy()[first]], 1), limits)

    sent = work.select("nid", "vec").mapInArrow(emit, "bucket long, nid long, s0 long, s1 long")
    large = None
    if n > hot:  # no bucket of a smaller table can be hot
        many = work.select("vec").mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).where(F.col("c") > hot)
        many = materialize(many.select("bucket", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")), "hot-buckets")
        if not many.isEmpty():
            # every two blocks of a hot bucket meet in a cell; the sides of these joins are left to Spark's own size checks
            parts = sent.select("bucket", "nid").join(many, "bucket").distinct().withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
            parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            cell = (F.least("part", "other") * F.col("parts") + F.greatest("part", "other")).alias("cell")
            large = parts.select("bucket", cell, "nid", F.col("part").cast("long").alias("part")).join(work.select("nid", "vec"), "nid").select("bucket", "cell", "nid", "part", "vec")
            sent = sent.join(many.select("bucket"), "bucket", "left_anti")
    sent = sent.select("bucket", F.lit(-1).alias("cell"), "nid", "s0", "s1")
    pairs = sent.repartition("bucket").sortWithinPartitions("bucket", "cell").mapInArrow(_runs(sketches), "a long, b long")
    if large is not None:
        pairs = pairs.unionByName(large.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(_runs(blocks), "a long, b long"))
    if extra is not None:
        met = materialize(pairs.distinct(), "met")
        ways = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
        outside = ways.join(near.select(F.col("rep").alias("b"), "hubs"), "b").select("a", F.explode("hubs").alias("b"))
        outside = outside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = met.unionByName(extra).unionByName(outside)
    pairs = materialize(pairs.distinct(), "candidates")
    return _ranked(base, pairs, k, min_cos, dim)


def _runs(compare):
    """Compares each run of rows with one bucket and cell, the first two columns; the rows come sorted by these."""

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            bucket, cell = (t.column(i).to_numpy() for i in range(2))
            edge = np.concatenate([[0], np.flatnonzero((np.diff(bucket) != 0) | (np.diff(cell) != 0)) + 1, [t.num_rows]])
            out = [compare(t.slice(i, j - i)) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()) if j - i > 1]
            a, b = (np.concatenate([o[n] for o in out]) if out else np.empty(0, np.int64) for n in (0, 1))
            both = np.unique(np.stack([a, b], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last run may go on in the next batch
            if held:
                last = held[-1]
                if last.column(0)[-1].as_py() != key[0] or last.column(1)[-1].as_py() != cell[0]:
                    yield flush(pa.Table.from_batches(held))
                    held = []
            if cut:
                yield flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))

    return groups


#: Words of 64 bits in the filter of needed rows; its size is fixed (512 KB), a larger need only lets more rows pass.
FILTER_WORDS = 1 << 16


def _needed(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``base`` whose nid may be in ``ids``: a filter of fixed size, so the vectors of others aren't shuffled."""
    spots = [F.pmod(F.xxhash64(F.lit(i), "nid"), F.lit(FILTER_WORDS * 64)) for i in range(2)]
    bits = ids.select(F.explode(F.array(*spots)).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
    got = bits.toPandas()  # at most FILTER_WORDS rows
    words = np.zeros(FILTER_WORDS, np.int64)
    words[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    data = base.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = data.value
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for c in ("p0", "p1"):
                s = b.column(b.schema.get_field_index(c)).to_numpy()
                ok &= (w[s >> 6] >> (s & 63)) & 1 == 1
            yield b.select(["nid", "id", "vec"]).filter(pa.array(ok))

    return base.select("nid", "id", "vec", *(s.alias(f"p{i}") for i, s in enumerate(spots))).mapInArrow(run, "nid long, id string, vec binary")


def _ranked(base: DataFrame, pairs: DataFrame, k: int, min_cos: float, dim: int) -> DataFrame:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("nid"))
    some = _needed(base, ids)
    a = some.select(F.col("nid").alias("a"), F.col("id").alias("id_a"), F.col("vec").alias("va"))
    b = some.select(F.col("nid").alias("b"), F.col("id").alias("id_b"), F.col("vec").alias("vb"))
    both = pairs.join(a, "a").join(b, "b").select("id_a", "id_b", "va", "vb")

    def cosine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if r.num_rows:
                x, y = (_floats(r.column(i), dim).astype(np.float64) for i in (2, 3))
                c = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(c)], names=["id_a", "id_b", "cos"]).filter(pa.array(c >= min_cos))

    scored = both.mapInArrow(cosine, "id_a string, id_b string, cos double")
    ways = scored.select(F.explode(F.array(F.struct("id_a", "id_b", "cos"), F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "cos"))).alias("s")).select("s.*")
    rank = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("cos"), "id_b"))
    return ways.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, dim: int = 64, target: float = 0.97, reach: float = 1.05, rows: int = 4000, most: int = 20_000, seed: int = 11) -> DataFrame:
    """``id_a``, ``id_b``, ``cos``, ``rank``: the ``k`` nearest rows of ``base`` for every row of ``queries``, of any cosine.

    Both come from :func:`usable` (queries: some of its rows). One table of coarse cells, about ``rows`` vectors each,
    holds every row once. A query visits the occupied cells in order of the estimated chance that a neighbour
    at distance ``reach`` lies there, until the chances add up to ``target``; each cell returns its k best by
    exact cosine. Equal cosines are ranked by id. With fewer than k other rows, all of them come out.
    """
    spark = base.sparkSession
    n = base.count()
    m = min(10, max(1, round(math.log2(max(2, n / rows)) / BITS)))
    fam = _family(900, m, dim, 1, seed)

    def cells(x: np.ndarray) -> np.ndarray:
        return np.floor((x @ fam.a + fam.b) / np.float32(WIDTH)).astype(np.int64)

    def occupied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, c = np.unique(cells(_floats(b.column(0), dim)), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.tolist(), pa.list_(pa.int64())), pa.array(c.astype(np.int64))], names=["cell", "c"])

    # cells are few: m is at most 10 and follows from the rows a cell should hold
    counts = base.select("vec").mapInArrow(occupied, "cell array<long>, c long").groupBy("cell").agg(F.sum("c").alias("c")).collect()
    counts = sorted((tuple(r.cell), r.c) for r in counts)
    known = np.array([c for c, _ in counts], np.int64).reshape(-1, m)
    parts = np.array([-(-c // most) for _, c in counts], np.int64)  # a cell of many rows is dealt to several tasks
    look = {c: i for i, (c, _) in enumerate(counts)}

    def logchance(x: np.ndarray) -> np.ndarray:
        p = x @ fam.a + fam.b
        lo, hi = int(known.min()), int(known.max())
        edges = np.arange(lo, hi + 2) * WIDTH
        erf = np.vectorize(math.erf, otypes=[float])
        cdf = 0.5 * (1 + erf((edges[None, None, :] - p[:, :, None]) / (reach * math.sqrt(2))))
        chance = np.log(np.maximum(np.diff(cdf, axis=2), 1e-12))  # (rows, m, value)
        return sum(chance[:, i, known[:, i] - lo] for i in range(m))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _floats(b.column(2), dim)
                c = np.array([look[t] for t in map(tuple, cells(x).tolist())], np.int32)
                part = (b.column(0).to_numpy() * 2654435761 >> 7) % parts[c]
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(part.astype(np.int32)), b.column(0), b.column(1), b.column(2)], names=["cell", "part", "nid", "id", "vec"])

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(4, min(256, (1 << 22) // max(1, len(known))))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                lc = logchance(_floats(part.column(2), dim))
                order = np.argsort(-lc, 1, kind="stable")
                ch = np.exp(np.take_along_axis(lc, order, 1))
                ch /= np.maximum(ch.sum(1, keepdims=True), 1e-300)
                go = np.cumsum(ch, 1) - ch < target
                r, j = np.nonzero(go)
                c = order[r, j]
                each = parts[c]
                nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)  # a query goes to all parts of a cell
                take = pa.array(np.repeat(r, each))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, each).astype(np.int32)), pa.array(nth.astype(np.int32)), *(part.column(i).take(take) for i in range(3))], names=["cell", "part", "nid", "id", "vec"])

    schema = "cell int, part int, nid long, id string, vec binary"
    idx = base.select("nid", "id", "vec").mapInArrow(index, schema)
    ask = queries.select("nid", "id", "vec").mapInArrow(visit, schema)

    def best(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(g):
            return pd.DataFrame({"id_a": pd.Series([], dtype=object), "id_b": pd.Series([], dtype=object), "cos": pd.Series([], dtype=float)})
        x, y = _floats(g["vec"].tolist(), dim), _floats(f["vec"].tolist(), dim)
        nx, ny = g["nid"].to_numpy(), f["nid"].to_numpy()
        a, b = _top(x, y, nx, ny, k, -1.5)
        ra, rb = pd.Index(nx).get_indexer(a), pd.Index(ny).get_indexer(b)
        c = (x[ra].astype(np.float64) * y[rb]).sum(1)
        return pd.DataFrame({"id_a": g["id"].to_numpy()[ra], "id_b": f["id"].to_numpy()[rb], "cos": c})

    got = idx.groupBy("cell", "part").cogroup(ask.groupBy("cell", "part")).applyInPandas(best, "id_a string, id_b string, cos double")
    rank = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("cos"), "id_b"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k)


def found(tables: dict[str, tuple[DataFrame, str]], k: int = 5, min_cos: float = 0.92) -> DataFrame:
    """``tbl``, ``key_a``, ``key_b`` (key_a < key_b): pairs of a table with cosine ``min_cos`` or more, one among the ``k`` nearest of the other."""
    out = None
    for name, (df, key) in tables.items():
        p = near_pairs(usable(df, key), k, min_cos)
        p = p.select(F.lit(name).alias("tbl"), F.least("id_a", "id_b").alias("key_a"), F.greatest("id_a", "id_b").alias("key_b"))
        out = p if out is None else out.unionByName(p)
    return out.distinct()
