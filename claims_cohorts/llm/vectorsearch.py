"""Nearest vectors by largest inner product with multi-index hashing (op13).

1. Rows of equal vectors form a class, which keeps the ``NEAREST + 1`` smallest ids: no other row of
   the class can be among the nearest of any query. Copies are so searched once.
2. ``ROTATIONS`` rotations are learned on at most ``SAMPLE`` classes (those of least hash) so that the
   signs of the rotated directions lose little (alternating signs and an orthogonal
   Procrustes fit, from different starts). The signs of all rotations are a vector's code.
3. Codes are split into substrings of ``SUB_BITS`` bits. A shard (rows of similar norm, about
   16 * sqrt(classes) of them) indexes each substring: its values and the rows in each.
4. A query has a radius for each shard, from the codes of the sample: within the radius are the rows whose
   inner product, estimated by norm and Hamming distance, reaches what about
   ``candidates`` rows of the table reach. By the pigeonhole principle a code within radius R is, in one of
   m substrings, within the allowance of that substring, where the allowances plus one add up to
   R + 1. The index is probed by these allowances, so every code within the radius is met.
5. Full codes are compared, and what lies within the radius is reranked by inner products of the
   original vectors in doubles. The best of each shard are merged by query.
6. A query that met fewer than ``candidates`` / 2 rows searches again with all bits as its radius, which is
   an exact search. So tables of few rows are always searched exactly.

Queries go to every shard whose norms can reach their estimate; shards stay where they are, and
a task holds one shard and a few queries at a time. Recall is measured in the tests.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
an id. Shorter vectors count as ending in zeros. Rows of equal id are rows of their own: a
query leaves out just itself. Ties go to the smaller id. Other columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .embeddings import valid

NEAREST, EVERY = 20, 20
#: Classes that the rotations are learned on and radii are estimated from.
SAMPLE = 16_384
ROTATIONS, ITERATIONS, SUB_BITS = 4, 20, 32
#: Least and largest number of classes in a shard.
SHARD = (1024, 1 << 17)
#: Norms of a shard differ by a factor of 2 ** (1 / NORM_STEPS) at most, those of the last one by any.
NORM_STEPS, NORM_BANDS = 4, 32
#: Pairs of a query and a row that are looked at together.
PAIRS = 2_000_000
#: Numbers that are multiplied together.
NUMBERS = 1 << 22
SEED = 20240713

_HITS = "query long, met long, hits array<struct<worse:double,id:long,class:long>>"


def candidates(classes: int) -> int:
    """Rows that a query's radius is meant to hold."""
    return max(400, math.ceil(4 * math.sqrt(classes)))


def learned_rotations(x: np.ndarray) -> np.ndarray:
    """(ROTATIONS, dim, dim) rotations that bring unit vectors ``x`` near the corners of the cube."""
    out = []
    for k in range(ROTATIONS):
        rotation = np.linalg.qr(np.random.default_rng([SEED, k]).standard_normal((x.shape[1], x.shape[1])))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.where(x @ rotation > 0, 1.0, -1.0).T @ x)
            rotation = (u @ v).T
        out.append(rotation)
    return np.stack(out)


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Codes of the directions of vectors: (rows, words) of uint64, unused bits zero."""
    bits = np.concatenate([_unit(x) @ r > 0 for r in rotations], axis=1)
    spare = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, spare))), axis=1).view(np.uint64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def substrings(code: np.ndarray) -> np.ndarray:
    """(rows, substrings) of codes."""
    return code.view(f"u{SUB_BITS // 8}")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes, row by row."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], np.int32)
    for k in range(a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def allowances(radius: int, m: int) -> np.ndarray:
    """Largest distance in each of m substrings; adding one to each gives radius + 1 in all."""
    return np.array([(radius + 1 + k) // m - 1 for k in range(m)], np.int32)


class Shard:
    """Rows with their codes, and for each substring its values and the value of each row."""

    def __init__(self, ids: list[list[int]], classes: np.ndarray, vectors: np.ndarray, rotations: np.ndarray):
        self.ids, self.classes, self.vectors = ids, classes, vectors
        self.least = np.fromiter((x[0] for x in ids), np.int64, len(ids))
        self.codes = codes(vectors, rotations)
        self.index = [np.unique(c, return_inverse=True) for c in substrings(self.codes).T]

    def probe(self, query: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of all codes within the radius of each query."""
        parts = substrings(query)
        m = parts.shape[1]
        allowed = np.array([allowances(r, m) for r in radii.tolist()], np.int32).reshape(-1, m)
        met = np.zeros((len(query), len(self.codes)), bool)
        for j, (values, bucket) in enumerate(self.index):
            hit = np.bitwise_count(parts[:, j, None] ^ values[None, :]) <= allowed[:, j, None]
            met |= hit[:, bucket]
        q, r = np.nonzero(met)
        near = distances(query[q], self.codes[r]) <= radii[q]
        return q[near], r[near]

    def nearest(self, query: np.ndarray, code: np.ndarray, radii: np.ndarray, k: int) -> list[tuple[int, list]]:
        """For each query, how many rows its radius holds, and the k best (-score, id, class)."""
        q, r = self.probe(code, radii)
        step = max(1, NUMBERS // query.shape[1])
        parts = [np.einsum("ij,ij->i", query[q[a : a + step]], self.vectors[r[a : a + step]]) for a in range(0, len(q), step)]
        score = np.concatenate([*parts, np.zeros(0)])
        order = np.lexsort((self.least[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        met = np.bincount(q, minlength=len(query))
        out = []
        for n, end in zip(met.tolist(), np.cumsum(met).tolist()):
            best = []
            # classes after the k-th hold no row of the k best, as each class has at least one
            for s, row in zip(score[end - n : end][:k].tolist(), r[end - n : end][:k].tolist()):
                best += [(-s, i, int(self.classes[row])) for i in self.ids[row]]
            out.append((n, sorted(best)[:k]))
        return out


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """class, x, ids (the k smallest), norm of each distinct vector, a staged table."""
    order = Window.partitionBy("x").orderBy("id")
    least = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    top = F.array_max(F.transform("x", F.abs))
    norm = top * F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v / top) * (v / top)))
    return common.staged(least.select(F.monotonically_increasing_id().alias("class"), "x", "ids", norm.alias("norm")))


def _padded(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def _reaching(asked: DataFrame, sample: tuple, share: float) -> DataFrame:
    """class, x and reach of each query: the estimated inner product that ``share`` of the sample reach."""
    fixed = asked.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations, others, norms = fixed.value
        bits = rotations.shape[0] * rotations.shape[1]
        at = min(max(math.ceil(share * len(norms)), 1), len(norms)) - 1
        for b in batches:
            own = codes(_padded(b.column(1), rotations.shape[1]), rotations)
            reach = [-np.partition(-norms * np.cos(np.pi * distances(c, others) / bits), at)[at] for c in own]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reach, pa.float64())], names=["class", "x", "reach"])

    return common.staged(asked.select("class", "x").mapInArrow(run, "class long, x array<double>, reach double"))


def _search(shards: DataFrame, asked: DataFrame, rotations: np.ndarray, largest: float, k: int, n_shards: int, exact: bool) -> DataFrame:
    """query, met and hits of every query (class, x, reach) and shard, a staged table."""
    fixed = shards.sparkSession.sparkContext.broadcast(rotations)
    dim, bits = rotations.shape[1], rotations.shape[0] * rotations.shape[1]
    no_ids, no_band = F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("int").alias("band")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(1).alias("kind"), "class", "x", "reach", no_ids, no_band)
    both = shards.select("shard", F.lit(0).alias("kind"), "class", "x", F.lit(0.0).alias("reach"), "ids", "band").unionByName(every)

    def radii(reach: np.ndarray, high: float) -> np.ndarray:
        """Largest distance at which a row of norm ``high`` is estimated to reach."""
        if exact:
            return np.full(len(reach), bits, np.int32)
        turn = np.arccos(np.clip(reach / high, -1, 1)) / np.pi * bits
        return np.where(reach > high * (1 + 1e-9), -1, np.floor(turn + 1e-6)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, number, high = [], None, None, 0.0
        for b in batches:
            numbers, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi in _runs(numbers, kinds):
                part = b.slice(lo, hi - lo)
                if numbers[lo] != number:
                    held, shard, number = [], None, numbers[lo]
                if kinds[lo] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if shard is None:
                    rows = pa.Table.from_batches(held)
                    shard = Shard(rows.column("ids").to_pylist(), rows.column("class").to_numpy(), _padded(rows.column("x"), dim), fixed.value)
                    high = largest * 2 ** (-held[0].column("band")[0].as_py() / NORM_STEPS)
                step = max(1, PAIRS // len(shard.codes))
                for at in range(0, part.num_rows, step):
                    some = part.slice(at, step)
                    query = _padded(some.column("x"), dim)
                    found = shard.nearest(query, codes(query, fixed.value), radii(some.column("reach").to_numpy(), high), k)
                    yield _sent(some.column("class"), found)

    return common.staged(both.repartitionById(n_shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, _HITS))


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of rows that are equal in all columns."""
    n = len(columns[0])
    cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if n else []
    return list(zip([0, *cut], [*cut, n])) if n else []


def _sent(queries: pa.Array, found: list[tuple[int, list]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("worse", pa.float64()), ("id", pa.int64()), ("class", pa.int64())]))
    hits = [[{"worse": w, "id": i, "class": c} for w, i, c in best] for _, best in found]
    return pa.RecordBatch.from_arrays([queries, pa.array([n for n, _ in found], pa.int64()), pa.array(hits, kind)], names=["query", "met", "hits"])


def nearest(rows: DataFrame, k: int = NEAREST, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` rows of largest inner product found for each row
    whose id is divisible by ``every``."""
    spark = rows.sparkSession
    common.ship(spark)
    x = F.col(f"`{vector_col}`").cast("array<double>")
    some = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & valid(F.col("x")))
    classes = _classes(some, k + 1)
    n, dim, largest = classes.agg(F.count("*"), F.max(F.size("x")), F.max("norm")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = classes.orderBy(F.xxhash64("x"), "class").limit(SAMPLE).select("x", "norm").toArrow()
    sample = _padded(picked.column("x"), dim)
    rotations = learned_rotations(_unit(sample))

    size = min(max(int(16 * math.sqrt(n)), SHARD[0]), SHARD[1])
    band = F.least(F.floor(F.log2(F.lit(largest) / F.col("norm")) * NORM_STEPS), F.lit(NORM_BANDS)).cast("int")
    banded = classes.withColumn("band", band)
    counts = {r["band"]: r["n"] for r in banded.groupBy("band").agg(F.count("*").alias("n")).collect()}
    pieces, first, begins = {}, 0, {}
    for b in sorted(counts):
        pieces[b], begins[b] = math.ceil(counts[b] / size), first
        first += pieces[b]
    of = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])[F.col("band")]
    shards = common.staged(banded.withColumn("shard", (of(begins) + F.pmod(F.xxhash64("x"), of(pieces))).cast("int")))

    queries = some.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "x")
    queries = common.staged(queries.join(classes.select("class", "x"), "x").select("query_id", "class"))
    asked = classes.join(queries.select("class").distinct(), "class", "left_semi")
    want = candidates(n)
    asked = _reaching(asked, (rotations, codes(sample, rotations), picked.column("norm").to_numpy()), want / n)
    merged = []
    for exact in (want >= n, True):
        hits = _search(shards, asked, rotations, largest, k + 1, first, exact)
        best = F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k + 1)
        best = common.staged(hits.groupBy("query").agg(F.sum("met").alias("met"), best.alias("hits")))
        enough = F.lit(exact) | (F.col("met") >= want // 2)
        merged.append(best.where(enough))
        asked = asked.join(best.where(enough).select("query"), F.col("class") == F.col("query"), "left_anti")
        if exact or asked.isEmpty():
            break
    found = merged[0] if len(merged) == 1 else merged[0].unionByName(merged[1])
    out = queries.join(found, queries["class"] == found["query"])
    own = F.array_position(F.transform("hits", lambda h: (h["id"] == F.col("query_id")) & (h["class"] == F.col("class"))), True)
    others = F.filter("hits", lambda h, i: i + 1 != F.col("own"))
    out = out.withColumn("own", own).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.worse")).alias("score"))
