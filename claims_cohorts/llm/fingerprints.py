"""Document fingerprints by prefix polynomial hashes (op5).

A text's prefix array holds, for every position, the polynomial hash of the code points
before it, modulo the prime 2**61 - 1. The hash of any span then takes two look-ups, so spans
compare in constant time and the longest common extension of two positions takes a binary search.

The fingerprint of a text reads ``<code points>:<hash of the whole>:<sketch>``. The sketch
holds the smallest ``SKETCH`` distinct hashes of all its spans of ``SPAN`` code points (of
the whole text, if shorter), 48 bits each in hexadecimal. Equal texts have equal
fingerprints. ``likeness`` estimates from two fingerprints alone the share of spans that
two texts have in common (Jaccard, by the smallest hashes of the union): 1 for equal texts.

The edited text of the query needs the following document. Documents are cut into id ranges at sampled
ids, ``MOST_RANGES`` at most, found by binary search; each task sorts its range, and the range's first document travels a second time, to the
range before, so every text moves once and at most one per range twice. No order over all
rows is formed in one task.

Null text counts as empty (0 code points, hash 0, empty sketch; two empty texts have likeness
1, an empty and another 0). Rows with equal ids keep a fixed order by text. Rows without an
id come last. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PRIME = (1 << 61) - 1
#: The polynomial's base (fixed, so that fingerprints of different runs compare).
BASE = 0x1F3D5B79A2C4E687 % PRIME
SPAN, SKETCH = 32, 64
#: Rows that one id range should hold.
RANGE_ROWS = 4_000
#: Most ranges: beyond, ranges grow, which tasks sort and read as streams.
MOST_RANGES = 10_000

_M = np.uint64(PRIME)
_LOW = np.uint64((1 << 32) - 1)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 for arrays of residues, by 32-bit halves."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    al, ah, bl, bh = a & _LOW, a >> np.uint64(32), b & _LOW, b >> np.uint64(32)
    mid = al * bh + ah * bl  # below 2**62, as the upper halves have 29 bits
    low = al * bl
    # 2**64 = 8 and 2**61 = 1 modulo the prime
    r = (ah * bh << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32))
    r = (r & _M) + (r >> np.uint64(61)) + (low & _M) + (low >> np.uint64(61))
    r = (r & _M) + (r >> np.uint64(61))
    return r - _M * (r >= _M)


class Prefixes:
    """Prefix hashes of a text: ``span(i, j)`` is the hash of text[i:j]."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.powers = _powers(self.n + 1)
        self.hash = np.zeros(self.n + 1, np.uint64)
        # h[i] = sum of code[j] * BASE**j for j < i: spans compare after scaling to equal shifts
        terms = mulmod(codes, self.powers[: self.n])
        self.hash[1:] = _cumulative(terms)

    def span(self, i, j):
        """Hashes of the spans [i, j) (arrays or numbers), independent of their place."""
        i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
        d = self.hash[j] + (_M - self.hash[i])
        d = d - _M * (d >= _M)
        return mulmod(d, _inverse_powers(self.n + 1)[i])

    def one(self, i: int, j: int) -> int:
        """The hash of one span [i, j)."""
        return (int(self.hash[j]) - int(self.hash[i])) * int(_inverse_powers(self.n + 1)[i]) % PRIME

    def equal(self, i: int, other: "Prefixes", k: int, length: int) -> bool:
        return self.one(i, i + length) == other.one(k, k + length)

    def common(self, i: int, other: "Prefixes", k: int) -> int:
        """Length of the longest common extension of position i here and k in ``other``."""
        low, high = 0, min(self.n - i, other.n - k)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, k, mid) else (low, mid - 1)
        return low


def _cumulative(terms: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime, of the lower 31 and the upper 30 bits apart."""
    low, high = terms & np.uint64((1 << 31) - 1), terms >> np.uint64(31)
    low, high = np.cumsum(low), np.cumsum(high)  # below 2**64 for texts under 2**33 code points
    out = mulmod(high % _M, np.uint64(1 << 31)) + low % _M
    return np.where(out >= _M, out - _M, out)


_tables: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    """Powers of ``base``, doubled as texts need them."""
    have = _tables[name]
    while len(have) < n:
        have = np.concatenate([have, mulmod(have, np.uint64(pow(base, len(have), PRIME)))])
        _tables[name] = have
    return have


def _powers(n: int) -> np.ndarray:
    return _grown("up", BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _grown("down", pow(BASE, -1, PRIME), n)


_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Scatter residues over 48 bits, so that small values are a fair sample."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[1]
    return (h ^ (h >> np.uint64(33))) >> np.uint64(16)


def _smallest(values: np.ndarray) -> np.ndarray:
    """The SKETCH smallest distinct values, sorted."""
    keep = 4 * SKETCH
    while True:
        some = values if len(values) <= keep else np.partition(values, keep)[:keep]
        out = np.unique(some)
        if len(out) >= SKETCH or len(some) == len(values):
            return out[:SKETCH]
        keep *= 8


def fingerprint(text: str) -> str:
    p = Prefixes(text)
    return _written(p.n, int(p.hash[-1]), _span_hashes(p))


def _span_hashes(p: Prefixes) -> np.ndarray:
    if not p.n:
        return np.zeros(0, np.uint64)
    width = min(SPAN, p.n)
    at = np.arange(p.n - width + 1)
    return _mixed(p.span(at, at + width))


def _written(n: int, whole: int, hashes: np.ndarray) -> str:
    return f"{n}:{whole:016x}:" + "".join(f"{v:012x}" for v in _smallest(hashes).tolist())


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans of the texts of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = a.rsplit(":", 1)[1], b.rsplit(":", 1)[1]
    s, t = ({h[i : i + 12] for i in range(0, len(h), 12)} for h in (x, y))
    union = sorted(s | t)
    if not s or not t:
        return 0.0
    full = max(len(s), len(t)) >= SKETCH
    first = union[:SKETCH] if full else union
    return sum(h in s and h in t for h in first) / len(first)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


def with_following(docs: DataFrame, fn, out_schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``fn(ids, texts, following)``, where each row's following text is that of the
    next row by descending id (the first row's after the last). ``fn`` yields Arrow batches."""
    spark = docs.sparkSession
    common.ship(spark)
    some = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    ids = some.select("i")
    rows = ids.count()
    n = min(max(1, math.ceil(rows / RANGE_ROWS)), MOST_RANGES)
    cuts = sorted(set(ids.where("i is not null").approxQuantile("i", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    # part 0 holds the largest ids; rows without an id come last
    bounds = spark.sparkContext.broadcast(np.array(cuts, np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def part_of(i: pd.Series) -> pd.Series:  # sees the ids only, the texts stay where they are
        return pd.Series((len(bounds.value) - np.searchsorted(bounds.value, i.to_numpy(), side="right")).astype(np.int32))

    part = F.when(F.col("i").isNull(), F.lit(len(cuts))).otherwise(part_of(F.coalesce("i", F.lit(0))))
    dealt = some.withColumn("part", part)
    tops = dealt.groupBy("part").agg(F.max("i").alias("top"), F.count("*").alias("n")).orderBy("part").collect()  # one row a range
    before = {r["part"]: tops[k - 1]["part"] for k, r in enumerate(tops)}
    if not tops:
        return spark.createDataFrame([], out_schema)
    guide = F.broadcast(spark.createDataFrame([(r["part"], r["top"], before[r["part"]]) for r in tops], "part int, top long, before int"))
    marked = dealt.join(guide, "part")
    # candidates for a range's first row: those with its largest id (ties go by text)
    first = F.col("i").eqNullSafe(F.col("top"))
    copies = F.when(first, F.array(F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct("part", F.lit(False).alias("guest")))
    )
    sent = marked.select("i", "t", F.explode(copies).alias("c")).select("i", "t", "c.part", "c.guest")
    ordered = sent.repartition(len(tops), "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("i"), "t")

    def walk(batches):
        held, seen_guest = None, None  # the row that waits for its following text

        def rows():
            for b in batches:
                for k in range(0, b.num_rows, 200):
                    s = b.slice(k, 200)
                    yield from zip(*(s.column(c).to_pylist() for c in range(4)))

        out = []
        for i, t, p, guest in rows():
            if guest:
                if seen_guest != p and held is not None:  # the first of the guests follows the range's last row
                    out.append((held[0], held[1], t))
                    held = None
                seen_guest = p
                continue
            if held is not None:
                out.append((held[0], held[1], t))
            held = (i, t)
            if len(out) >= 200:
                yield from fn(out)
                out = []
        if out:
            yield from fn(out)

    return ordered.mapInArrow(walk, out_schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start long"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses.

    common_start is the longest common extension of the two texts' starts.
    """

    def fn(rows):
        cols: list[list] = [[] for _ in range(8)]
        known: dict[str, tuple[str, Prefixes]] = {}  # a following text is the next row's own

        def print_of(text):
            if text not in known:
                p = Prefixes(text)
                known[text] = (_written(p.n, int(p.hash[-1]), _span_hashes(p)), p)
            return known[text]

        for i, text, following in rows:
            own, p = print_of(text)
            new = edited(text, following)
            new_print, q = print_of(new)
            if new != text and new != following:
                known.pop(new, None)
            next_print = print_of(following)[0]
            if text != following:
                known.pop(text, None)
            sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            for c, v in zip(cols, (i, len(text), sha, own, new_print, likeness(own, new_print), likeness(own, next_print), p.common(0, q, 0))):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in EDITED.split(", ")])

    return with_following(docs, fn, EDITED, id_col, text_col)
