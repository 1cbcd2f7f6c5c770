import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from texts, with extra columns whose names the operators use inside."""

    def make(texts, ids=None, langs=None, sources=None, clash=True):
        n = len(texts)
        ids = list(range(n)) if ids is None else ids
        rows = [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in zip(ids, texts, langs or ["en"] * n, sources or ["s"] * n)]
        df = spark.createDataFrame(rows, SCHEMA)
        if clash:
            for name in ("id", "t", "n", "key", "size", "sig", "block", "component_id", "n_tokens", "score", "spans"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "a b c d",
    "a b c d e",
    "A B C D E",
    "été 中文 😀 " * 30,
    "x" * 3000,
    "word " * 2000,
    "word " * 2000,
    "<|endoftext|> inside  <|endoftext|>",
    "   spaces \x85 of all   kinds \x1c",
]


@pytest.fixture(scope="session")
def odd_texts():
    return list(ODD_TEXTS)


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents table, as rows and as a DataFrame."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]
