"""icd_match / procedure_match against SQL LIKE semantics rendered as regexes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from claims_cohorts.functions.codes import icd_match, procedure_match

ALPHABET = "AKZ0124.*"


def like(value, pattern):
    rx = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in pattern)
    return value is not None and re.fullmatch(rx, value, flags=re.S) is not None


def icd_expected(code, codes):
    out = False
    for c in codes:
        if "*" in c or "." in c:
            p = c.replace("*", "%")
            out |= like(code, p) or ("." in p and like(code, p.replace(".", "")))
        else:
            out |= code == c
    return out


def proc_expected(code, codes):
    return any(like(code, c.replace("*", "%")) if ("*" in c or "." in c) else code == c for c in codes)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_pattern_predicates_random(spark, seed):
    rng = random.Random(seed)
    values = list({"".join(rng.choice("AKZ0124.") for _ in range(rng.randint(1, 5))) for _ in range(300)}) + [None]
    lists = [[ "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))] for _ in range(25)]
    df = spark.createDataFrame([(v,) for v in values], "icd_code string").withColumn("proc_code", F.col("icd_code"))
    cols = [icd_match(l, "icd_code").alias(f"i{k}") for k, l in enumerate(lists)]
    cols += [procedure_match(l, "proc_code").alias(f"p{k}") for k, l in enumerate(lists)]
    for row in df.select("icd_code", *cols).collect():
        v = row["icd_code"]
        for k, l in enumerate(lists):
            assert bool(row[f"i{k}"]) == (v is not None and icd_expected(v, l)), (v, l)
            assert bool(row[f"p{k}"]) == (v is not None and proc_expected(v, l)), (v, l)
