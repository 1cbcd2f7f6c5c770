import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from claims_cohorts.llm import common, components, minhash


def brute(rows):
    """Component of each id by comparing all pairs of sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n, seed=3, words=120):
    """Chains and stars of edited copies: some pairs link only through others."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    out, last = [" ".join(base)], base
    for k in range(n):
        start = list(r.choice([base, last]))
        for _ in range(r.choice([0, 1, 2, 4])):
            start[r.randrange(words)] = f"e{r.randrange(10**6)}"
        last = start
        out.append(" ".join(start))
    return out


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_components_match_all_pairs(make_docs, odd_texts):
    texts = odd_texts + near_copies(60) + near_copies(30, seed=8, words=40)
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    got = minhash.duplicate_components(make_docs(texts))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(got) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_links_that_no_hub_sees(make_docs, monkeypatch):
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)  # everything by the exhaustive round, in small blocks
    monkeypatch.setattr(minhash, "BLOCK", 8)
    texts = near_copies(50, seed=5)
    assert result(minhash.duplicate_components(make_docs(texts))) == brute(enumerate(texts))


def test_blocks_by_shingles(make_docs, monkeypatch):
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1000)  # some eight documents a block
    texts = near_copies(50, seed=6) + near_copies(20, seed=7, words=300)
    assert result(minhash.duplicate_components(make_docs(texts))) == brute(enumerate(texts))


def test_refuted_pairs_of_a_group_are_not_rows(make_docs, monkeypatch):
    """Edits of one text that are all a little too unlike each other: pairs grow with the square."""
    r, texts = random.Random(6), []
    for i in range(120):
        w = [f"w{k}" for k in range(400)]
        for k in r.sample(range(5, 395), 7):  # some 35 of 396 shingles are its own
            w[k] = f"e{i}-{k}"
        texts.append(" ".join(w))
    texts += [f"{t} end" for t in texts[:3]]
    counts, stage = [], common.staged

    def staged(df):
        out = stage(df)
        if df.columns == ["u", "v"]:
            counts.append(out.count())
        return out

    monkeypatch.setattr(common, "staged", staged)
    got = result(minhash.duplicate_components(make_docs(texts)))
    assert got == brute(enumerate(texts)) and len({c for _, c in got.values()}) > 20
    assert 3 <= max(counts) <= minhash.HUBS * len(texts)


def test_whole_smallest_table(corpus):
    df, rows = corpus
    assert result(minhash.duplicate_components(df)) == brute(rows)


def test_empty_table_and_repeated_rows(make_docs):
    assert minhash.duplicate_components(make_docs(["a"]).limit(0)).collect() == []
    got = minhash.duplicate_components(make_docs(["a b c d e f"] * 3, ids=[4, 4, None]))
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()), key=str) == [(4, 4, True)] * 2 + [(None, 4, False)]


def test_rows_without_id_are_returned(make_docs):
    got = minhash.duplicate_components(make_docs(["a b c d e f"] * 3 + ["x y z", None, ""], ids=[None] * 6)).collect()
    assert sorted((r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(0, None, True)] * 2 + [(1, None, True)] + [(2, None, False)] * 2 + [(2, None, True)]


def test_a_round_has_few_pairs_a_document(spark):
    """Copies that share all buckets, but for an own one each."""
    rows = [(k, i, i) for i in range(300) for k in [*range(32), 1000 + i]]
    pairs = minhash._star_pairs(spark.createDataFrame(rows, "key long, id long, comp long"), 0)
    assert pairs.count() <= 300 * minhash.HUBS


def test_rows_of_one_id_are_judged_by_their_own_text(make_docs):
    a = [f"w{k}" for k in range(100)]
    other = " ".join(f"v{k}" for k in range(60))
    got = minhash.duplicate_components(make_docs([" ".join(a + ["end"]), " ".join(a), other], ids=[3, 5, 5])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [(3, 97, 3, True), (5, 56, 5, True), (5, 96, 3, False)]


def test_signature_agreement_estimates_similarity():
    r = np.random.default_rng(0)
    errors = []
    for k in range(0, 400, 4):
        every = r.integers(0, 2**63, 1500).astype(np.uint64)
        a, b = np.unique(every[:1000]), np.unique(every[k : 1000 + k])
        s = minhash.signatures([a, b])
        errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


@pytest.mark.parametrize("n", [1, 2, 5, 100, 70_000])
def test_signature_matches_the_sequential_definition(n):
    """One shingle at a time, without early stopping."""
    rng = np.random.default_rng(n)
    e = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    got = minhash.signatures([e])[0]
    some = e if n <= 100 else e[:0]
    want = np.full(minhash.SLOTS, 2**32 - 1, np.uint64)
    for x in some:
        p = list(range(minhash.SLOTS))
        for j in range(minhash.SLOTS):
            h = int(minhash._scattered(np.array([x], np.uint64) + minhash._GOLDEN_STEPS[j])[0])
            k = j + (((h & 0xFFFFFFFF) * (minhash.SLOTS - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            want[p[j]] = min(int(want[p[j]]), (j << 22) + (h >> 42))
    if n <= 100:
        assert got.tolist() == want.tolist()
    assert got.max() < 128 << 22


def test_stars(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {x["u"]: x["v"] for x in components.stars(spark.createDataFrame(links, "u long, v long")).collect()}
    root = {x: x for l in links for x in l}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == {u: v for u, v in root.items() if u != v}
    assert components.stars(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rows_that_no_pair_asks_for_stay_out_of_the_join(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("s"), "id").alias("sig")).unionByName(spark.createDataFrame([(None, "none")], "id long, sig string"))
    ids = spark.createDataFrame([(7,), (7,), (19_999,), (50_000,)], "id long")
    got = {r["id"]: r["sig"] for r in minhash.only_wanted(rows, ids).collect()}
    assert {7, 19_999} <= got.keys() and None not in got and len(got) < 50
    assert all(sig == f"s{no}" for no, sig in got.items())
    assert minhash.only_wanted(rows, ids.limit(0)).count() == 0


def test_rows_alone_in_their_class_are_not_shuffled(spark):
    """Signatures have a byte a slot, and only rows that may be copies are joined."""
    assert len(minhash._short(np.arange(minhash.SLOTS, dtype=np.uint32)[None])[0]) == minhash.SLOTS
    key = F.when(F.col("id") == 9, 7).otherwise(F.col("id"))
    one = spark.range(20_000).select("id", key.alias("set_key"), F.when(F.col("id") == 11, 0).otherwise(5).alias("n_shingles"), F.lit("s").alias("sig"), F.array("id").alias("keys"))
    whole = one.where("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("rep"))
    reps = minhash._representatives(one, whole)
    assert sorted((r["id"], r["sig"], r["keys"]) for r in reps.collect()) == [(i, "s", [i]) for i in range(20_000) if i not in (9, 11)]
    union = reps._jdf.queryExecution().optimizedPlan()
    assert union.nodeName() == "Union"
    assert "Join" not in union.children().head().toString() and "Join" in union.children().last().toString()
