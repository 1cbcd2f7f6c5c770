"""Bulk-synchronous best-fit packing of tokenized documents into fixed-length sequences (op10).

Documents become pieces of at most ``capacity`` tokens where they are read; only (document,
piece, length, checksum) rows travel, and in the rounds below only (number, length). Pieces of
more than half the capacity open a sequence each, as no two of them fit together. Then, until
no piece waits:

1. Waiting pieces and gaps (the room left in open sequences) are range-sorted together by size,
   largest first, a gap before a piece of its size. Ties go by hash, so that a size that
   most pieces share spreads over several ranges.
2. Each range is swept by itself: a piece goes into its successor, the smallest gap that holds
   it, and what is left of the gap returns to the sweep if it still belongs to the range.
3. What a range has left over meets the other ranges: pieces that found no gap are given, by
   rank, to the smallest gaps left in ranges of larger sizes. Gaps go by groups of about equal
   size, and each takes as many pieces as the smallest gap of its group holds of the
   largest of these pieces, so two pieces never ask for the same place. Only counts of ranges
   (``RANGE_ROWS`` rows each) and groups reach the driver.
4. The largest pieces that no gap in the table holds open new sequences: those of which equally many
   (k) fit into one, or for k of ``MANY`` or more, those of at least ``TIER`` of the largest length, k
   at a time in order of size.
5. Gaps are updated, those smaller than any waiting piece dropped, and the next round begins. Each round
   places all pieces of one tier at least, so there are some 30 at most, however many pieces.

Sequences are numbered by the piece that opens them. Null text counts as empty and yields the end id
alone. Repeated rows are packed as often as they stand there; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY, END_ID = 1024, 2
#: Rows of a range that one task sweeps.
RANGE_ROWS = 20_000
#: Pieces a sequence from which tiers go by length, and the least share of the longest in a tier.
MANY, TIER = 8, 0.8

PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; a cut document's first piece takes what full pieces leave."""
    common.ship(docs.sparkSession)
    tail = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        enc = tokens.encoder(path)
        for b in tokens.small_batches(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                raw = np.array(enc.whole(text or ""), dtype="<u4").tobytes() + tail
                n = len(raw) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
                    at.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(raw[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    some = common.own_columns(docs, id_col, text_col)
    return some.mapInArrow(cut, f"`{id_col}` {some.schema[id_col].dataType.simpleString()}, {PIECES}")


class _Sweep:
    """Best fit over the gaps of one range: sequences by gap size."""

    def __init__(self):
        self.gaps: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, size: int, sequence: int) -> None:
        if size not in self.gaps:
            bisect.insort(self.sizes, size)
        self.gaps.setdefault(size, []).append(sequence)

    def take(self, length: int) -> tuple[int, int] | None:
        """The smallest gap that holds ``length``: (size, sequence)."""
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        sequence = self.gaps[size].pop()
        if not self.gaps[size]:
            del self.gaps[size]
            del self.sizes[at]
        return size, sequence


def sweep(pieces: list[tuple[int, int]], gaps: list[tuple[int, int]]) -> tuple[list, list, list, list]:
    """Sequential best fit of a range's pieces (length, number), in descending order of length, into its gaps
    (size, sequence): placed (number, sequence, gap before), pieces left (length, number), gaps
    left (size, sequence) in ascending order, and remainders smaller than every piece."""
    if not pieces:
        return [], [], sorted(gaps), []
    least, open_gaps = pieces[-1][0], _Sweep()
    placed, left, small = [], [], []
    for size, sequence in gaps:
        open_gaps.add(size, sequence)
    for length, number in pieces:
        found = open_gaps.take(length)
        if found is None:
            left.append((length, number))
            continue
        size, sequence = found
        placed.append((number, sequence, size))
        if size - length >= least:
            open_gaps.add(size - length, sequence)
        elif size > length:
            small.append((size - length, sequence))
    unused = [(size, x) for size in open_gaps.sizes for x in sorted(open_gaps.gaps[size])]
    return placed, left, unused, small


#: What a row of a round is.
PLACED, WAITING, GAP, REMAINDER = 0, 1, 2, 3
#: More than the groups of gap sizes, four to each doubling.
GROUPS = 256
_ROUND = "kind int, part long, rank long, id long, size long, sequence long, offset long"
_KINDS = [pa.int32(), *[pa.int64()] * 6]


def _swept(rows: DataFrame, n_rows: int, capacity: int) -> DataFrame:
    """Steps 1 and 2 for rows (kind, id, size): a staged table of placed pieces (sequence and
    offset) and of what is left, numbered within its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, pieces, gaps = TaskContext.get().partitionId(), [], []
        for b in batches:
            for kind, i, size in zip(*(c.to_pylist() for c in b.columns)):
                (pieces if kind == WAITING else gaps).append((size, i))
        placed, left, unused, small = sweep(pieces, gaps)
        out = [(PLACED, part, 0, i, 0, sequence, capacity - gap) for i, sequence, gap in placed]
        for kind, some in ((WAITING, left), (REMAINDER, small)):
            out += [(kind, part, rank, i, size, 0, 0) for rank, (size, i) in enumerate(some)]
        for group, some in itertools.groupby(unused, lambda x: int(4 * math.log2(x[0]))):
            out += [(GAP, part * GROUPS + group, rank, i, size, 0, 0) for rank, (size, i) in enumerate(some)]
        columns = zip(*out) if out else [[] for _ in _KINDS]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=[c.split()[0] for c in _ROUND.split(", ")])

    ranges = max(1, math.ceil(n_rows / RANGE_ROWS))
    order = (F.desc("size"), F.desc("kind"), F.xxhash64("id"))  # gaps (2) before pieces (1) of their size
    sorted_rows = rows.select("kind", "id", "size").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return common.staged(sorted_rows.mapInArrow(run, _ROUND))


def offers(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Step 3 for ranges (part, pieces left, longest) and groups of gaps (part * GROUPS + group, gaps left,
    smallest): rows (part, rank, end, group, gap rank, k) that give the pieces of ranks rank to
    end - 1 to gaps from that rank on, k to each."""
    out, stack = [], []  # groups with gaps that nothing used yet, the smallest on top: [group, next rank, gaps, smallest]
    events = sorted([(part, 0, 0, n, size) for part, n, size in pieces] + [(g // GROUPS, 1, -g, n, size) for g, n, size in gaps])
    for part, is_gap, group, n, size in events:
        if is_gap:
            stack.append([-group, 0, n, size])
            continue
        rank = 0
        while rank < n and stack:
            top = stack[-1]
            k = top[3] // size
            used = min(-(-(n - rank) // k), top[2] - top[1])
            end = min(n, rank + used * k)
            out.append((part, rank, end, top[0], top[1], k))
            rank, top[1] = end, top[1] + used
            if top[1] == top[2]:
                stack.pop()
    return out


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return F.broadcast(spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})))


def tier(longest: int, capacity: int) -> tuple[int, int]:
    """How many of the longest pieces fill a sequence, and above what length they do."""
    k = capacity // longest
    return k, capacity // (k + 1) if k < MANY else int(TIER * longest)


def _round(rows: DataFrame, n_rows: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Placed pieces and the rows of the next round, from staged rows (kind, id, size)."""
    spark = rows.sparkSession
    swept = _swept(rows, n_rows, capacity)
    counts = swept.where(F.col("kind").isin(WAITING, GAP)).groupBy("kind", "part").agg(F.count("*").alias("n"), F.max("size").alias("most"), F.min("size").alias("least"))
    counts = sorted(tuple(r) for r in counts.collect())  # a row for each range and group of gaps
    pieces = [(part, n, most) for kind, part, n, most, _ in counts if kind == WAITING]
    given = offers(pieces, [(part, n, least) for kind, part, n, _, least in counts if kind == GAP])
    left = {part: end for part, _, end, *_ in given}  # the offers of a range are in order
    taken = {group: first + -(-(end - rank) // k) for _, rank, end, group, first, k in given}
    base, before = [], 0  # number of a range's first piece without any gap among all of these
    for part, n, _ in pieces:
        base.append((part, left.get(part, 0), before))
        before += n - left.get(part, 0)
    waiting = swept.where(F.col("kind") == WAITING).select("part", "rank", F.col("id").alias("no"), F.col("size").alias("length"))
    gaps = swept.where(F.col("kind") == GAP).select(F.col("part").alias("of"), F.col("rank").alias("nth"), F.col("id").alias("sequence"), "size")

    # pieces that are given a gap of another range
    found = None
    if given:
        offered = _table(spark, given, "part long, first long, end long, of long, base long, k long")
        some = waiting.join(offered, "part").where("rank >= first and rank < end")
        some = some.select("no", "length", "part", "rank", "of", (F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("k"))).alias("nth"))
        some = some.join(gaps, ["of", "nth"])
        found = some.select("no", "length", "part", "rank", "sequence", (capacity - F.col("size")).alias("at"))
    # pieces that open sequences
    ends = _table(spark, base, "part long, first long, before long")
    rest = waiting.join(ends, "part").where("rank >= first").withColumn("nth", F.col("before") + F.col("rank") - F.col("first"))
    keep = None
    if before:
        longest = rest.where("nth = 0").first()["length"]
        k, above = tier(longest, capacity)
        run = F.floor(F.col("nth") / k)
        opened = rest.where(F.col("length") > above).withColumn("run", run)
        opened = opened.withColumn("sequence", F.first("no").over(Window.partitionBy("run").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)))
        opened = opened.select("no", "length", "part", "rank", "sequence", F.lit(0).cast("long").alias("at"))
        found = opened if found is None else found.unionByName(opened)
        keep = rest.where(F.col("length") <= above).select(F.lit(WAITING).alias("kind"), F.col("no").alias("id"), F.col("length").alias("size"))
    placed = swept.where(F.col("kind") == PLACED).select(F.col("id").alias("no"), "sequence", "offset")
    later = swept.where(F.col("kind") == REMAINDER).select(F.lit(GAP).alias("kind"), "id", "size")
    unused = gaps.join(_table(spark, sorted(taken.items()), "of long, taken long"), "of", "left").where("taken is null or nth >= taken")
    later = later.unionByName(unused.select(F.lit(GAP).alias("kind"), F.col("sequence").alias("id"), "size"))
    if found is not None:
        order = Window.partitionBy("sequence").orderBy("part", "rank")
        to = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
        last = F.lead("no").over(order).isNull()
        found = common.staged(found.select("no", "sequence", (F.col("at") + to - F.col("length")).alias("offset"), F.when(last, capacity - F.col("at") - to).alias("gap")))
        placed = placed.unionByName(found.select("no", "sequence", "offset"))
        later = later.unionByName(found.where("gap > 0").select(F.lit(GAP).alias("kind"), F.col("sequence").alias("id"), F.col("gap").alias("size")))
    if keep is not None:
        later = later.unionByName(keep)
    return placed, later


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with long ``length`` between 1 and ``capacity``) plus sequence_id and offset."""
    common.ship(parts.sparkSession)
    numbered = common.staged(parts.withColumn("__no", F.monotonically_increasing_id()))
    length, half = F.col("length").cast("long"), capacity // 2
    large = numbered.where(length > half)
    placed = [large.select(F.col("__no").alias("no"), F.col("__no").alias("sequence"), F.lit(0).cast("long").alias("offset"))]
    gaps = large.where(length < capacity).select(F.lit(GAP).alias("kind"), F.col("__no").alias("id"), (capacity - length).alias("size"))
    rows = gaps.unionByName(numbered.where(length <= half).select(F.lit(WAITING).alias("kind"), F.col("__no").alias("id"), length.alias("size")))
    while True:
        rows = common.staged(rows)
        least, n = rows.agg(F.min(F.when(F.col("kind") == WAITING, F.col("size"))), F.count("*")).first()
        if least is None:
            break
        done, later = _round(rows.where(F.col("size") >= least), n, capacity)
        placed.append(done)
        common.unstage(rows)  # the sweep is a table of its own
        rows = later
    every = placed[0]
    for x in placed[1:]:
        every = every.unionByName(x)
    every = every.select(F.col("no").alias("__no"), F.col("sequence").alias("__sequence"), F.col("offset").alias("__offset"))
    out = numbered.join(every, "__no")
    return out.select(*[F.col(f"`{c}`") for c in parts.columns], F.col("__sequence").alias("sequence_id"), F.col("__offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence_id and gapless offset in it."""
    return pack(pieces(docs, path, capacity, end_id, id_col, text_col), capacity)
