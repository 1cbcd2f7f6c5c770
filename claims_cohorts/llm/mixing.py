"""Mixing sources to target weights by temperature (op3).

Each source's share of all tokens is raised to an exponent between 0 (uniform) and 1 (as is) and
normalised. The exponent is the smallest that keeps the most repeated source at
``max_repeats`` passes (relative to one pass of the least repeated) and, if asked, the least that
brings the entropy of the weights down to ``target_entropy``; bisection finds it, as both fall
with the exponent. The token budget is the least that shows every document once.

A source's budget is spent in passes over its documents. Each pass is a fresh permutation, by a hash of
seed, pass and id; the last one stops where the budget ends. A document's place in
its source's stream, as a share of the budget, gives its block, so every block of about
``block_tokens`` holds the sources at their weights; within a block copies are ordered by hash.
Running token sums are formed in two levels (hash ranges of a source, then rows of one range), so no
source is gathered in one task, whatever its size.

Null sources form a source of their own; null text has no tokens; rows without an id share
their hash and are ordered by row. Rows with equal ids are mixed row by row. Sources without tokens keep weight 0 and
one pass. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

MAX_REPEATS, BLOCK_TOKENS, SEED = 2.0, 1_000_000, 29
#: Rows that one hash range of a source should hold.
RANGE_ROWS = 5_000
#: Exponents tried in one job; jobs until the exponent is known to GRID ** -JOBS.
GRID, JOBS = 32, 5


def token_lengths(docs: DataFrame, path: str, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and n_tokens."""
    common.ship(docs.sparkSession)
    some = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))

    def count(batches):
        enc = tokens.encoder(path)
        for b in tokens.small_batches(batches):
            n = [len(enc.whole(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return some.mapInArrow(count, T.StructType([*some.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]))


def exponent(shares: DataFrame, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None) -> float:
    """Bisected exponent for ``shares`` (share > 0 per source), GRID candidates in each job."""

    def ok(row, k):  # both fall with the exponent
        return row[f"r{k}"] <= max_repeats and (target_entropy is None or row[f"h{k}"] <= target_entropy)

    lo, hi = 0.0, 1.0
    for _ in range(JOBS):
        tried = [lo + (hi - lo) * k / GRID for k in range(GRID + 1)]
        x = F.col("share")
        aggs = []
        for k, a in enumerate(tried):
            s, sl = F.sum(F.pow(x, F.lit(a))), F.sum(F.pow(x, F.lit(a)) * F.log(x))
            aggs += [F.log(s).alias(f"z{k}"), (F.log(s) - a * sl / s).alias(f"h{k}"), F.pow(F.max(x) / F.min(x), F.lit(1 - a)).alias(f"r{k}")]
        row = shares.agg(*aggs).first()
        first = next((k for k in range(GRID + 1) if ok(row, k)), GRID)
        if first == 0:
            return tried[0]
        lo, hi = tried[first - 1], tried[first]
    return hi


def plan(sized: DataFrame, source_col: str, max_repeats: float, target_entropy: float | None) -> DataFrame:
    """One row per source: __s, total, n_rows, weight, budget (tokens), passes."""
    per = common.staged(sized.groupBy(F.col(f"`{source_col}`").alias("__s")).agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n_rows")))
    all_tokens = per.agg(F.sum("total")).first()[0] or 0
    if not all_tokens:
        return per.select("__s", "total", "n_rows", F.lit(0.0).alias("weight"), F.lit(0.0).alias("budget"), F.lit(1).alias("passes"))
    share = F.col("total") / F.lit(float(all_tokens))
    alpha = exponent(per.where("total > 0").select(share.alias("share")), max_repeats, target_entropy)
    scaled = F.when(F.col("total") > 0, F.pow(share, F.lit(alpha))).otherwise(0.0)
    norm, need = per.where("total > 0").agg(F.sum(scaled), F.max(F.col("total") / scaled)).first()
    budget = scaled * need  # at least the source's tokens, so every document is in once
    return per.select("__s", "total", "n_rows", (scaled / norm).alias("weight"), budget.alias("budget"), F.greatest(F.ceil(budget / F.greatest("total", F.lit(1)) - 1e-9), F.lit(1)).cast("int").alias("passes"))


def mix(
    sized: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    max_repeats: float = MAX_REPEATS,
    target_entropy: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per copy: id_col, source_col, n_tokens, weight, pass, block, place (the
    order within the block). ``sized`` has n_tokens."""
    rows = sized.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__s"), "n_tokens")
    rows = common.staged(rows.withColumn("__row", F.monotonically_increasing_id()))
    sources = common.staged(plan(rows.withColumnRenamed("__s", source_col), source_col, max_repeats, target_entropy))
    spend = sources.agg(F.sum(F.greatest("budget", "total"))).first()[0] or 0
    blocks = max(1, math.ceil(spend / block_tokens))
    small = sources.withColumnRenamed("__s", "s2")
    dealt = rows.join(small, rows["__s"].eqNullSafe(small["s2"])).drop("s2")
    copies = dealt.withColumn("pass", F.explode(F.expr("sequence(0, passes - 1)")))
    copies = copies.withColumn("u", F.xxhash64("__id", "pass", F.lit(SEED)))
    ranges = F.ceil(F.col("n_rows") / RANGE_ROWS)
    copies = copies.withColumn("range", F.floor((F.shiftrightunsigned("u", 1) / float(1 << 63)) * ranges))
    sums = copies.groupBy("__s", "pass", "range").agg(F.sum("n_tokens").alias("in_range"), F.first("total").alias("total"))
    upto = Window.partitionBy("__s", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__s").alias("s2"), F.col("pass").alias("p2"), F.col("range").alias("r2"), (F.coalesce(F.sum("in_range").over(upto), F.lit(0)) + F.col("pass") * F.col("total")).alias("base"))
    inner = Window.partitionBy("__s", "pass", "range").orderBy(F.shiftrightunsigned("u", 1), "__row").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    placed = placed.join(sums, placed["__s"].eqNullSafe(F.col("s2")) & (F.col("pass") == F.col("p2")) & (F.col("range") == F.col("r2")))
    start = F.col("base") + F.col("inner")
    chosen = placed.withColumn("start", start).where("pass = 0 or start < budget")
    block = F.least(F.floor(F.col("start") / F.greatest("budget", "total", F.lit(1)) * blocks), F.lit(blocks - 1))
    return chosen.select(
        F.col("__id").alias(id_col), F.col("__s").alias(source_col), "n_tokens", "weight", "pass", block.alias("block"), F.xxhash64("u", "__row", F.lit("place")).alias("place")
    )
