"""Named queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .oracles import ORACLES as ORACLES


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.duplicate_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, read_table(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing, tokens

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(mixing.token_lengths(docs, tokens.tokenizer_path("byte_bpe_50k.json"), ("doc_id", "source")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import secrets

    found = secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    of_kind = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda x: x["rank"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in (*secrets.BASE, "random")],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("secret_spans")).alias("spans"),
    )


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprints

    return fingerprints.edited_fingerprints(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixdedup

    return suffixdedup.removed_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import langid

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))
    model = langid.train(docs.where(~out))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embeddings

    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import tokens

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokens.count_tokens(docs, tokens.tokenizer_path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing, tokens

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokens.tokenizer_path("byte_bpe_50k.json"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations

    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import convtrie

    return convtrie.rebuilt_trie(read_table(spark, sf_dir, "conversations"))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import vectorsearch

    return vectorsearch.nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_resampling": op2_quality_resampling,
    "op3_source_mixing": op3_source_mixing,
    "op4_secret_scan": op4_secret_scan,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_nearest_vectors": op13_nearest_vectors,
}
