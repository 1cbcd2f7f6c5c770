"""Claims tables derived from the TPC-H-style test tables.

One claim per order, one diagnosis / procedure / drug row per line item, members and
eligibility from customers. The mapping is a pure projection of whole tables (no joins,
no row left out), so every derived table grows with its source. It holds the cases that
real claims have: claims without a date or a member, members with claims but no member
row (claims of some orders belong to a shifted member), duplicate member rows, several
enrolment rows per member, some without a start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claims_cohorts.sources.tables import ClaimsTables

# FIXED VALUES — diagnosis codebook keyed by l_partkey % 100 (keys 0..47); other keys
# get 'Z00.00'. Dotted and undotted spellings are mixed on purpose.
DIAGNOSIS_CODEBOOK = [
    "K58.0", "K580", "K58.1", "K58.2", "K58.9", "K50.90", "K51.0",
    "K90.0", "R10", "R10.9", "R14", "R19.7", "I10", "I11.9",
    "I119", "I12.0", "I15.0", "I20.0", "I21.4", "I25.10", "I257",
    "E78.0", "E78.1", "E785", "E78.6", "E08.9", "E10.9", "E11.9",
    "E119", "R73.03", "R73.9", "O24.41", "O24.0", "O99.81", "O00.1",
    "E88.81", "E88810", "E66.9", "E66.3", "Z68.22", "Z68.27",
    "Z68.35", "E28.2", "E25.0", "E24.9", "C50.9", "B20", "Z00.00",
]
DEFAULT_CODE = "Z00.00"
# FIXED VALUES — as-of date for the rolling date range (latest order date).
AS_OF = "2001-08-01"


#: Added to a customer's key for claims of members without a member row.
MEMBER_SHIFT = 10_000_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def claims_entries(orders: DataFrame) -> DataFrame:
    # FIXED VALUES — every 97th order has no member, every 13th customer's claims belong to
    # a member without a member row, every 11th order has no date.
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    shifted = F.when(customer % 13 == 0, customer + MEMBER_SHIFT).otherwise(customer)
    claim_member = F.when(key % 97 != 5, shifted.cast("string"))
    return orders.select(
        F.col("o_orderkey").alias("claim_entry_id"),
        claim_member.alias("member_id_hash"),
        F.when(key % 11 != 3, F.col("o_orderdate").cast("date")).alias("date_of_service"),
        F.when(F.col("o_orderkey") % 4 == 3, F.lit("pharma")).otherwise(F.lit("medical")).alias("claim_type"),
    )


def claims_diagnoses(lineitem: DataFrame) -> DataFrame:
    # A literal array lookup instead of a join with the 48-row codebook.
    book = F.array(*[F.lit(c) for c in DIAGNOSIS_CODEBOOK])
    key = (F.col("l_partkey") % 100).cast("int")
    return lineitem.select(
        F.col("l_orderkey").alias("claim_entry_id"),
        F.coalesce(F.try_element_at(book, key + 1), F.lit(DEFAULT_CODE)).alias("icd_code"),
    )


def claims_procedures(lineitem: DataFrame) -> DataFrame:
    k = (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 30
    code = (
        F.when(k == 0, F.lit("33510"))
        .when(k == 1, F.lit("92960"))
        .when(k == 2, F.lit("0000000"))
        .otherwise(F.lit("99213"))
    )
    return lineitem.select(F.col("l_orderkey").alias("claim_entry_id"), code.alias("proc_code"))


def claims_drugs(lineitem: DataFrame) -> DataFrame:
    k = (F.col("l_partkey") + F.col("l_linenumber")) % 20
    name = (
        F.when(k == 0, F.lit("LISINOPRIL"))
        .when(k == 1, F.lit("ATORVASTATIN CALCIUM"))
        .when(k == 2, F.lit(""))
        .when(k == 3, F.lit(None).cast("string"))
        .when(k == 4, F.lit("ATORVASTATIN CALCIUM 20MG"))
        .otherwise(F.lit("ACETAMINOPHEN"))
    )
    return lineitem.select(F.col("l_orderkey").alias("claim_entry_id"), name.alias("product_service_name"))


def members(customer: DataFrame) -> DataFrame:
    # FIXED VALUES — every 29th customer has a second row under another name.
    key, name = F.col("c_custkey"), F.col("c_name")
    names = F.when(key % 29 == 0, F.array(name, F.concat(name, F.lit(" (2)")))).otherwise(F.array(name))
    return customer.select(
        key.cast("string").alias("member_id_hash"),
        F.explode(names).alias("member_name"),
        F.col("c_mktsegment").alias("member_segment"),
    )


def eligibility(customer: DataFrame) -> DataFrame:
    # FIXED VALUES — every 7th customer has a second, later span, every 17th one without start.
    key = F.col("c_custkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (key % 900).cast("int"))
    end = F.when(key % 3 != 0, F.date_add(F.lit("1999-01-01").cast("date"), (key % 1000).cast("int")))
    none = F.lit(None).cast("date")
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    extra = F.filter(
        F.array(
            F.when(key % 7 == 0, span(F.date_add(start, 400), none)),
            F.when(key % 17 == 0, span(none, end)),
        ),
        lambda x: x.isNotNull(),
    )
    spans = customer.select(key.cast("string").alias("member_id_hash"), F.explode(F.concat(F.array(span(start, end)), extra)).alias("span"))
    return spans.select("member_id_hash", F.col("span.s").alias("date_of_enrollment"), F.col("span.e").alias("termination_date"))


def coverage(entries: DataFrame) -> DataFrame:
    """Many short enrollment spans per member, overlapping, nested, adjacent or apart: one for each
    claim entry, of a length by its id; some are open-ended, end before they begin, or lack
    a start or a member."""
    # FIXED VALUES — lengths of 100 to 499 days; every 311th is open, every 173rd reversed.
    key, start = F.col("claim_entry_id"), F.col("date_of_service")
    length = F.when(key % 173 == 0, F.lit(-1)).otherwise((key % 400 + 100).cast("int"))
    end = F.when(key % 311 != 0, F.date_add(start, length))
    return entries.select("member_id_hash", start.alias("date_of_enrollment"), end.alias("termination_date"))


def testdata_tables(spark: SparkSession, sf_dir: str) -> ClaimsTables:
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    customer = _read(spark, sf_dir, "customer")
    return ClaimsTables(
        entries=claims_entries(orders),
        diagnoses=claims_diagnoses(lineitem),
        procedures=claims_procedures(lineitem),
        drugs=claims_drugs(lineitem),
        members=members(customer),
        eligibility=eligibility(customer),
    )
