import random
import sys

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import corpus_pipeline as cp  # noqa: E402
from claims_cohorts.llm import common, minhash, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, make_docs, odd_texts):
    near = " ".join(f"w{k}" for k in range(100))
    texts = odd_texts + [near, near + " end", "password=hunter2hunter2 and words", "plain words here"]
    docs = make_docs(texts, sources=["a"] * (len(texts) - 1) + ["b"], langs=["en"] * (len(texts) - 1) + [None])
    docs = docs.unionByName(docs.where("doc_id = 13"))
    n = len(odd_texts)
    for name, stage in cp.STAGES[:-1]:
        out = common.staged(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).collect() == []
        docs = out
        ids = sorted(r["doc_id"] for r in docs.collect())
        if name == "language_id":
            assert not {0, 1, 2} & set(ids) and n + 3 in ids
        if name == "near_dedup":
            assert len(ids) == len(set(ids)) and n in ids and n + 1 not in ids and 10 not in ids
        if name == "secret_scan":
            row = docs.where(f"doc_id = {n + 2}").first()
            assert row["text"] == "[SECRET] and words" and row["n_chars"] == len(row["text"])
        if name == "mixing":
            assert set(ids) == set(before) and ids.count(n + 3) == 2
        before = ids
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == set(before)


def test_language_id_drops_documents_in_no_language(spark, make_docs):
    texts = ["some plain words here"] * 3 + ["more words", "щщщ щщщ", "12 34", None]
    learned = cp.language_id(spark, make_docs(texts, langs=["en"] * 3 + [None] * 4), SF)
    assert sorted(r["doc_id"] for r in learned.collect()) == [0, 1, 2, 3]
    nothing = cp.language_id(spark, make_docs(texts, langs=[None] * 7), SF)
    assert sorted(r["doc_id"] for r in nothing.collect()) == [0, 1, 2, 3, 4]


def test_near_dedup_drops_only_rows_like_another(spark, make_docs):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(3, a + " end"), (5, a), (5, b), (None, c), (None, c), (None, d), (None, b), (7, d + " end")]
    out = cp.near_dedup(spark, make_docs([t for _, t in rows], ids=[i for i, _ in rows]), SF)
    want = [(3, a + " end"), (5, b), (None, c), (7, d + " end")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


def test_mixing_goes_by_row(spark, make_docs):
    texts = ["big source words " * 40] * 6 + ["small one", "small two", "small three"]
    ids = [10, 11, 12, 13, 14, None, 10, None, None]
    docs = make_docs(texts, ids=ids, sources=["big"] * 6 + ["small"] * 3)
    out = common.staged(cp.mixing_sources(spark, docs, SF))
    assert out.columns == docs.columns
    found = sorted((r["source"], r["text"], r["doc_id"]) for r in out.where("doc_id = 10").collect())
    assert [x[0] for x in found] == ["big", "small", "small"]
    small = [r["text"] for r in out.where("source = 'small'").collect()]
    assert sorted(small) == sorted(texts[6:] * 2) and out.where("source = 'big'").count() == 6


def _python_steps(plan):
    """The most Python operators that one stage of a plan chains."""
    most, above = 0, []  # (depth, Python operators of the stage so far)
    for line in plan.splitlines():
        name = line.lstrip(" :+-*(0123456789)")
        depth = len(line) - len(line.lstrip(" :+-"))
        while above and above[-1][0] >= depth:
            above.pop()
        n = above[-1][1] if above else 0
        n = 0 if "Exchange" in name.split()[0] else n + name.startswith(("MapInArrow", "FlatMapGroupsInArrow"))
        above.append((depth, n))
        most = max(most, n)
    return most


def test_a_task_has_one_python_process_at_most(spark, make_docs, monkeypatch):
    """Chained Python operators take a worker each, and the pool of an executor keeps all of them."""
    nested = "MapInArrow f\n+- *(2) Project\n   +- BroadcastHashJoin\n      :- BroadcastExchange\n      :  +- MapInArrow f\n      +- MapInArrow f\n"
    assert _python_steps(nested) == 2 and _python_steps(nested.replace("Project", "Exchange")) == 1
    plans, stage = [], common.staged

    def staged(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(common, "staged", staged)
    r = random.Random(4)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for _ in range(40):  # all in one bucket or another, and not all linked
        words = list(base)
        for k in r.sample(range(80), r.choice([1, 3, 4])):
            words[k] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = stage(make_docs(texts))
    kept = staged(cp.near_dedup(spark, docs, SF))
    staged(cp.language_id(spark, docs, SF))
    assert kept.count() < 40 and sum("MapInArrow" in p for p in plans) >= 8
    assert max(map(_python_steps, plans)) == 1
    assert not any("ExistingRDD" in p for p in plans)  # rows of Python objects


@pytest.fixture(scope="module")
def packed(spark):
    return cp.run(spark, SF).collect()


def test_run_keeps_one_of_each_group(spark, packed):
    docs = common.read_table(spark, SF, "documents")
    kept = {r["doc_id"] for r in minhash.duplicate_components(docs).where("kept").collect()}
    assert {r["doc_id"] for r in packed} == kept
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "best_fit_packing"]


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
