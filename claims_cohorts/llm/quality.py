"""Quality selection by importance resampling (op2).

Words and word pairs of a text are hashed into ``BUCKETS`` counters. Two generative models are
counted from them: the target (documents labelled of good quality and not toxic) and raw text (all
documents). A document's log weight is the sum, over its n-grams, of the log ratio of both models,
(target count + PRIOR) / (expected target count + PRIOR), so n-grams too rare to tell
say nothing. Sampling without replacement in proportion to the weights is a top-k of log weight plus
Gumbel noise drawn from the document's id.

Documents are dealt into two folds by id, and each is weighed by the models of the other fold, as its own
words would else count in its favour. By default k is the share of the target among the
labelled documents, of all documents. The k-th key is found by counting, not by a global sort.

Null, empty and wordless texts have log weight 0 and take part. Without labels of either
kind all ratios are 1 and k is all documents. Documents labelled twice are target if all
their labels say so. Rows with equal ids are weighed row by row and share their noise; ties go to the
smaller row number. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens

BUCKETS = 1 << 17
PRIOR = 20.0
SEED = 17
FOLDS = 2
#: Most target ids that are broadcast (16 MB); more of them meet the documents in a shuffle.
BROADCAST_IDS = 2_000_000

_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's lower-case words and word pairs."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    pairs = (w[:-1] * _PAIR) ^ (w[1:] >> np.uint64(1))
    return (np.concatenate([w, pairs * _PAIR]) >> np.uint64(64 - 17)).astype(np.int64)


def fold(id_col: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.lit(FOLDS)).cast("int")


def model_counts(labelled: DataFrame) -> DataFrame:
    """(fold, bucket, target, raw): n-gram counts of ``labelled`` (fold, is_target, t)."""

    def count(batches):
        sums = np.zeros((FOLDS, 2, BUCKETS), np.int64)
        for b in tokens.small_batches(batches):
            for f, good, t in zip(*(b.column(c).to_pylist() for c in range(3))):
                n = np.bincount(features(t), minlength=BUCKETS) if t and len(t) > BUCKETS else None
                if n is None:
                    at = features(t)
                    np.add.at(sums[f, 1], at, 1)
                    if good:
                        np.add.at(sums[f, 0], at, 1)
                else:
                    sums[f, 1] += n
                    if good:
                        sums[f, 0] += n
        for f in range(FOLDS):
            at = np.flatnonzero(sums[f, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f, np.int32)), pa.array(at), pa.array(sums[f, 0][at]), pa.array(sums[f, 1][at])], names=["fold", "bucket", "target", "raw"])

    parts = labelled.mapInArrow(count, "fold int, bucket long, target long, raw long")
    return parts.groupBy("fold", "bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """For documents of each fold the log ratio of each bucket, from the other folds.
    At most FOLDS * BUCKETS rows reach the driver."""
    rows = counts.toPandas()
    sums = np.zeros((2, FOLDS, BUCKETS))
    for k, c in enumerate(("target", "raw")):
        sums[k, rows["fold"], rows["bucket"]] = rows[c]
    others = sums.sum(axis=1, keepdims=True) - sums
    total = others.sum(axis=2, keepdims=True)
    share = np.divide(total[0], total[1], out=np.zeros_like(total[0]), where=total[1] > 0)
    return np.log((others[0] + PRIOR) / (others[1] * share + PRIOR)) * (share > 0)


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(id_col, log_weight, gumbel_key) of every row, and the target's share of the labelled."""
    spark = docs.sparkSession
    common.ship(spark)
    some = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    share = known.agg(F.avg(F.col("good").cast("double"))).first()[0]
    target = common.staged(known.where("good").select("doc_id"))
    if target.count() <= BROADCAST_IDS:
        target = F.broadcast(target)
    joined = some.join(target, some["i"] == target["doc_id"], "left").select(F.coalesce(fold(F.col("i")), F.lit(0)).alias("f"), F.col("doc_id").isNotNull().alias("g"), "t")
    sent = spark.sparkContext.broadcast(log_ratios(model_counts(joined)))  # FOLDS * BUCKETS doubles

    def score(batches):
        ratios = sent.value
        for b in tokens.small_batches(batches):
            w = [float(ratios[f][features(t)].sum()) for f, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.float64())], names=["i", "log_weight"])

    kind = some.schema["i"].dataType.simpleString()
    scored = some.select("i", F.coalesce(fold(F.col("i")), F.lit(0)).alias("f"), "t").mapInArrow(score, f"i {kind}, log_weight double")
    uniform = (F.pmod(F.xxhash64("i", F.lit(SEED), F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    return keyed.select(F.col("i").alias(id_col), "log_weight", "gumbel_key"), 1.0 if not share else share


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, log_weight, gumbel_key and kept (k rows are), k by ``fraction`` of all rows."""
    weighed, share = weigh(docs, labels, id_col, text_col)
    rows = common.staged(weighed.withColumn("__row", F.monotonically_increasing_id()))
    k = round((share if fraction is None else fraction) * rows.count())
    cut = common.cut_largest(rows, k, "gumbel_key", "__row")
    kept = F.lit(k > 0) if cut is None else (F.col("gumbel_key") > cut[0]) | ((F.col("gumbel_key") == cut[0]) & (F.col("__row") <= cut[1]))
    return rows.select(id_col, "log_weight", "gumbel_key", kept.alias("kept"))
