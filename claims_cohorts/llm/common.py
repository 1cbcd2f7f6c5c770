"""Helpers shared by the corpus operators: code shipping, staged tables, exact cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claims_cohorts.session import ensure_checkpoint_dir

#: Words are runs of anything but space and the five ASCII line and tab controls.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_claims_cohorts_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="claims-cohorts-code-"), "claims_cohorts.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith((".py", ".yaml")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("claims_cohorts", os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._claims_cohorts_shipped = True


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage like ``checkpoint()``, but computes the rows once and keeps them
    columnar; the folder is shared, so the rows survive lost executors.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table of ``staged`` that no later step reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text):
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the caller can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def cut_largest(df: DataFrame, k: int, value: str, tie: str, bins: int = 1024, few: int = 20_000) -> tuple[float, int] | None:
    """(v, t) such that exactly ``k`` rows have value > v, or value = v and tie <= t.

    Rows are counted in bins, and the bin that holds the k-th row is cut into bins again, so at
    most ``few`` rows or ``bins`` counts reach the driver. ``value`` holds finite doubles, ``tie``
    distinct integers. None if there are at most ``k`` rows (all are in) or k is 0.
    """
    rows = df.select(F.col(value).alias("x"), F.col(tie).alias("t"))
    if k <= 0 or rows.count() <= k:
        return None

    def narrow(rows, column, left, descending):
        """Interval of ``column`` with the left-th row, and how many rows remain before it there."""
        lo, hi = rows.agg(F.min(column), F.max(column)).first()
        n = rows.count()
        while n > few and lo < hi:
            width = (hi - lo) / bins
            at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
            found = rows.where(F.col(column).between(lo, hi)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
            for r in sorted(found.collect(), key=lambda r: r["b"], reverse=descending):
                if left <= r["n"]:
                    break
                left -= r["n"]
            if r["n"] == n and (r["lo"], r["hi"]) == (lo, hi):
                break
            lo, hi, n = r["lo"], r["hi"], r["n"]
        return lo, hi, left, n

    lo, hi, left, n = narrow(rows, "x", k, True)
    if n <= few:
        some = sorted(((-r["x"], r["t"]) for r in rows.where(F.col("x").between(lo, hi)).collect()))
        return -some[left - 1][0], some[left - 1][1]
    same = rows.where(F.col("x") == hi)
    lo, hi_t, left, n = narrow(same, "t", left, False)
    ties = sorted(r["t"] for r in same.where(F.col("t").between(lo, hi_t)).collect())
    return hi, ties[left - 1]
