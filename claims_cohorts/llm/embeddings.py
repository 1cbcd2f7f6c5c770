"""Near-duplicate vectors by spherical-cap filters (op8).

A filter is a direction; a vector is in it when their inner product exceeds a threshold. The
directions form product codes, ``tables`` of them: after a random rotation, a direction is a pair of code
words, one per half of the coordinates, so ``words ** 2`` directions need only ``2 * words`` inner
products, and list decoding finds all directions a vector exceeds from the two score lists. The
codes of a label grow with it (``LOAD`` directions a vector or up to twice as many), which keeps
buckets of unlike vectors at a constant size; a vector is in about ``FILTERS`` directions of each
code, at least its ``LEAST`` best. The larger a code, the more often it misses a pair, so their
number is derived from ``missed``, the measured chance that one code misses two vectors at
cosine 0.93: all codes of a label together miss them with a chance below ``MISSES``.

Vectors join on (label, filter). Buckets of more than ``BLOCK`` rows are dealt into blocks, and
each pair of blocks is a task of its own. A pair is counted only in the first filter it shares, so
links are counted exactly and only counts and a spanning forest leave a task, never all pairs.
Equal vectors of a label are one class with a multiplicity and travel once.

Only vectors of equal, non-null labels and equal length are compared. Null and zero vectors and those
with null or non-finite components link with nothing. Rows with equal ids are judged each by
its own vector. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

COSINE = 0.93
#: TABLES is the least number of codes.
TABLES, FILTERS, LEAST, LOAD = 5, 8, 6, 8
MISSES = 1e-4
#: Random pairs that a code is tried on.
TRIALS = 2000
BLOCK = 256
SEED = 20240611
#: Pairs that are multiplied at a time, and bucket rows handled together.
PAIRS, ROWS = 100_000, 20_000

_codes: dict[tuple[int, int, int], tuple] = {}


def code(dim: int, words: int, table: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rotation, the two halves' code words, and the threshold on the sum of their scores."""
    if (dim, words, table) not in _codes:
        rng = np.random.default_rng([SEED, dim, words, table])
        rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        half = max(1, dim // 2)
        halves = [rng.standard_normal((words, d)) for d in (half, max(1, dim - half))]
        halves = [h / np.linalg.norm(h, axis=1, keepdims=True) for h in halves]
        tail = min(0.5, FILTERS / words**2)
        _codes[dim, words, table] = (rotation, *halves, -NormalDist().inv_cdf(tail) * math.sqrt(2 / dim))
    return _codes[dim, words, table]


def decode(x: np.ndarray, words: int, table: int = 0) -> list[np.ndarray]:
    """Sorted numbers of the directions that each unit vector (row of ``x``) exceeds."""
    rotation, first, second, least = code(x.shape[1], words, table)
    y = x @ rotation
    a, b = y[:, : first.shape[1]] @ first.T, y[:, -second.shape[1] :] @ second.T
    out = []
    for p, q in zip(a, b):
        i, j = np.flatnonzero(p >= least - q.max()), np.flatnonzero(q >= least - p.max())
        r, c = np.nonzero(p[i][:, None] + q[j][None, :] >= least)
        found = i[r] * words + j[c]
        if len(found) < LEAST:  # the best sums lie among the best of both halves
            i, j = np.argsort(-p, kind="stable")[:LEAST], np.argsort(-q, kind="stable")[:LEAST]
            best = np.argsort(-(p[i][:, None] + q[j][None, :]), axis=None, kind="stable")[:LEAST]
            found = np.union1d(found, i[best // len(j)] * words + j[best % len(j)])
        out.append(np.sort(found) + table * words**2)
    return out


@functools.cache
def missed(dim: int, words: int) -> float:
    """Chance that two vectors at cosine ``COSINE`` share no direction of one code: the share
    of ``TRIALS`` random pairs, plus two standard errors."""
    if dim < 2:  # vectors at that cosine are equal
        return 0.0
    rng = np.random.default_rng([SEED, dim, words])
    x, z = rng.standard_normal((2, TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = COSINE * x + math.sqrt(1 - COSINE**2) * z
    share = np.mean([not np.isin(p, q).any() for p, q in zip(decode(x, words), decode(y, words))])
    return float(share + 2 * math.sqrt(max(share * (1 - share), 1 / TRIALS) / TRIALS))


def tables(dim: int, words: int) -> int:
    """Number of codes that miss a pair at cosine ``COSINE`` with a chance below ``MISSES``."""
    one = missed(dim, words)
    return max(TABLES, math.floor(math.log(MISSES) / math.log(one)) + 1) if one else TABLES


def valid(embedding) -> object:
    """True for a vector that has a direction."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a batch column of equally long vectors, scaled to length one in doubles."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps tiny and huge vectors in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(classes: DataFrame, n_tables: dict[tuple[int, int], int]) -> DataFrame:
    def find(batches):
        for b in batches:
            kinds = np.array([b.column("dim").to_pylist(), b.column("words").to_pylist()])
            for d, words in np.unique(kinds, axis=1).T.tolist():
                some = b.filter(pa.array((kinds[0] == d) & (kinds[1] == words)))
                for k in range(0, some.num_rows, 1000):
                    part = some.slice(k, 1000)
                    x = _unit(part.column("v"))
                    lists = [np.concatenate(of) for of in zip(*(decode(x, words, table) for table in range(n_tables[d, words])))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "lab", "n", "v")), pa.array(lists, pa.list_(pa.int64()))], names=["id", "lab", "n", "v", "filters"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.mapInArrow(find, f"id long, lab long, n long, v {kind}, filters array<long>")


def _pairs(first: np.ndarray, last: np.ndarray):
    """Index pairs (i, partner) for each row i and its partners first[i] .. last[i] - 1."""
    n = np.maximum(last - first, 0)
    ends = np.cumsum(n)
    row = 0
    while row < len(n):
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        k = n[row:stop]
        i = np.repeat(np.arange(row, stop), k)
        at = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        yield i, first[i] + at
        row = stop


def _met_before(i, j, group, start, end, padded, own) -> np.ndarray:
    """Whether the rows i and j of a group share a filter before the group's own."""
    again = np.zeros(len(i), bool)
    sizes = end[start] - start
    large = sizes[group[i]] >= 64
    for g in np.unique(group[i[large]]):  # all pairs of a large group by one product
        s, e = start[g], end[start[g]]
        lists = padded[s:e]
        row, col = np.nonzero((lists >= 0) & (lists < own[s]))
        names, name = np.unique(lists[row, col], return_inverse=True)
        member = np.zeros((e - s, len(names)), np.float32)
        member[row, name] = 1
        met = member @ member.T > 0
        at = np.flatnonzero(large & (group[i] == g))
        again[at] = met[i[at] - s, j[at] - s]
    small = np.flatnonzero(~large)
    for k in range(0, len(small), 4096):
        at = small[k : k + 4096]
        p, q = padded[i[at]], padded[j[at]]
        again[at] = ((p[:, :, None] == q[:, None, :]) & ((p >= 0) & (p < own[i[at]][:, None]))[:, :, None]).any(axis=(1, 2))
    return again


def _linked(t: pa.Table) -> pa.RecordBatch | None:
    """Links within whole groups (key, b1, b2): rows (id, links, root)."""
    t = t.combine_chunks()
    key, b1, b2, block, ids, lab, mult = (t.column(c).to_numpy() for c in ("key", "b1", "b2", "block", "id", "lab", "n"))
    own = t.column("filter").to_numpy()
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])])
    group = np.cumsum(np.isin(np.arange(len(key)), new)) - 1
    end = np.r_[new[1:], len(key)][group]
    right = np.bincount(group, weights=(block != b1)).astype(np.int64)[group]
    at = np.arange(len(key))
    first = np.where(b1 == b2, at + 1, end - right)
    last = np.where((b1 != b2) & (block != b1), 0, end)
    lists = t.column("filters").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max())
    padded = np.full((len(key), width), -1, np.int64)
    padded[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    v = t.column("v").combine_chunks()
    if isinstance(v, pa.ChunkedArray):
        v = v.chunk(0)
    dims = np.diff(v.offsets.to_numpy())
    x = np.zeros((len(key), int(dims.max())))
    x[np.arange(x.shape[1])[None, :] < dims[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links, root, seen = np.zeros(len(key), np.int64), ids.copy(), []
    for i, j in _pairs(first, last):
        ok = lab[i] == lab[j]
        i, j = i[ok], j[ok]
        hit = np.einsum("ij,ij->i", x[i], x[j]) >= COSINE
        i, j = i[hit], j[hit]
        again = _met_before(i, j, group, new, end, padded, own)
        np.add.at(links, i[~again], mult[j[~again]])
        np.add.at(links, j[~again], mult[i[~again]])
        seen.append((i, j))
    if not seen or not sum(len(i) for i, _ in seen):
        return None
    i, j = (np.concatenate([s[k] for s in seen]) for k in (0, 1))
    while True:  # least id along the links of these rows
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (before == root).all():
            break
    some = np.flatnonzero((links > 0) | (root != ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], names=["id", "links", "root"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, n_links, component_id and kept, one row per vector."""
    spark = vectors.sparkSession
    common.ship(spark)
    v, label = F.col(f"`{vector_col}`"), F.col(f"`{label_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(valid(v) & label.isNotNull(), v).alias("v"), label.alias("label"))
    usable = rows.where("v is not null")
    classes = usable.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = classes.select("id", "n", "v", "label", F.xxhash64("label", F.size("v")).alias("lab"), F.size("v").alias("dim"))
    classes = common.staged(classes)
    # words ** 2 is LOAD directions a vector of the label, rounded up to a power of two
    words = F.greatest(F.lit(16), F.ceil(F.pow(F.lit(2.0), F.ceil(F.log2(LOAD * F.count("*"))) / 2)).cast("int"))
    labels = common.staged(classes.groupBy("lab").agg(words.alias("words"), F.first("dim").alias("dim")))
    n_tables = {(d, w): tables(d, w) for d, w in labels.select("dim", "words").distinct().collect()}  # few sizes a dimension
    filtered = common.staged(_filters(classes.join(labels.select("lab", "words"), "lab"), n_tables))
    dealt = filtered.select("id", "lab", F.explode("filters").alias("filter"))
    dealt = dealt.select("id", "filter", F.xxhash64("lab", "filter").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    sized = dealt.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n_rows") / BLOCK).cast("int"))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    tasks = sized.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tasks = tasks.select("id", "key", "filter", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    tasks = tasks.join(filtered, "id").select("key", "b1", "b2", "block", "id", "lab", "n", "filter", "v", "filters")
    groups = tasks.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2", "block")

    def link(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= ROWS:
                t = pa.Table.from_batches(held)
                last = [t.column(c).to_numpy() for c in ("key", "b1", "b2")]
                same = np.logical_and.reduce([c == c[-1] for c in last])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut and (out := _linked(t.slice(0, cut))) is not None:
                    yield out
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if rows and (out := _linked(pa.Table.from_batches(held))) is not None:
            yield out

    found = common.staged(groups.mapInArrow(link, "id long, links long, root long"))
    roots = components.stars(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(links, "id", "left").join(roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left")
    known = known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = rows.join(known, ["label", "v"], "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
