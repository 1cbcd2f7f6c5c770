"""Corpus pipeline: documents -> language ID -> near-dedup -> secret scan -> mixing -> packing.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, whatever they are
besides doc_id, text, lang, source and n_chars; the last returns packed pieces.

* language_id drops documents without a recognisable language: without a letter (und), or without
  a hit in any learned language. If none was learned, all documents with a letter pass.
* near_dedup keeps one row of each group of similar texts, the one of least id. Each row is
  judged by its own text, also where ids repeat; rows without an id come last in their group.
* secret_scan replaces every secret by a mask and brings n_chars up to date.
* mixing repeats documents of sources below their target weight, as additional rows; no
  document is dropped. Rows are mixed by number, also where ids repeat or are null. Each file that
  is written from the result holds a random share of every block, in the order of the blocks
  and of the places in them.
* packing returns one row per piece with its sequence and offset.

Null texts are dropped by the first stage, and stay null, empty or unmasked in the others.
Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claims_cohorts.llm import common, langid, minhash, mixing, packing, secrets, tokens

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    if not model.langs:
        return langid.with_letters(docs)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")
    return langid.predict(whole, model, keep=("__row",)).where("lang_pred <> 'und' and score > 0").select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = minhash.numbered(docs, "__no")
    found = minhash.duplicate_rows(rows, "__no")
    kept = found.where("first is null or first.id = id").select(F.col("id").alias("__kept"))
    return rows.join(kept, rows["__no"] == kept["__kept"], "left_semi").drop("__no")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs, spans_col="__spans")
    out = found.withColumn("text", secrets.masked(F.col("text"), F.col("__spans")))
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, n).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = minhash.numbered(docs, "__no")
    copies = mixing.mix(mixing.token_lengths(rows, tokens.tokenizer_path(TOKENIZER), ("__no", "source")), id_col="__no")
    placed = rows.join(copies.select("__no", F.col("block").alias("__block"), F.col("place").alias("__place")), "__no")
    return placed.sortWithinPartitions("__block", "__place").select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokens.tokenizer_path(TOKENIZER))


#: (name, function) in order.
STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mixing", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL engine expresses the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each result written before the next reads it."""
    docs = common.read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
