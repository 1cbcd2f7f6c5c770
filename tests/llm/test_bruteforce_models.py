"""Language ID, quality weights and source mixing against plain Python over the same rules."""

import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from claims_cohorts.llm import langid, mixing, quality


# --- language ID ---------------------------------------------------------------------------


def plain_grams(word):
    marked = f" {word} "
    return [marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1) if not (n == 1 and marked[i] == " ")]


def some_texts(seed, n=60):
    r = random.Random(seed)
    kinds = {"aa": ["blik", "dorf", "wagen", "ö", "straße"], "bb": ["rue", "été", "garçon", "dorf"], "cc": ["щит", "кот", "дом"]}
    rows = []
    for _ in range(n):
        lang = r.choice(list(kinds))
        words = kinds[lang] + r.sample(kinds[r.choice(list(kinds))], 2)
        rows.append((" ".join(r.choice(words) + r.choice(["", "", "s", "42", "½", ","]) for _ in range(r.randint(0, 25))).title(), lang if r.random() < 0.9 else None))
    return rows


def test_language_counts_and_winner(make_docs):
    rows = some_texts(1)
    docs = make_docs([t for t, _ in rows], langs=[x for _, x in rows])
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    counts = {}
    for t, lang in rows:
        if lang:
            counts.setdefault(lang, Counter()).update(g for w in letters(t) for g in plain_grams(w))
    total = {x: sum(c.values()) for x, c in counts.items()}
    kept = {x: {g for g, n in c.items() if n * langid.GRAMS >= total[x]} for x, c in counts.items()}
    model = langid.train(docs)
    assert model.langs == sorted(counts)
    for lang, share in zip(model.langs, model.share):
        assert share == pytest.approx(sum(counts[lang][g] for g in kept[lang]) / total[lang])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    for i, (t, _) in enumerate(rows):
        found = [g for w in letters(t) for g in plain_grams(w)]
        if not found:
            assert got[i] == ("und", 0.0)
            continue
        rates = {x: max(0.0, sum(g in kept[x] for g in found) / len(found) / s) for x, s in zip(model.langs, model.share)}
        order = sorted(rates, key=lambda x: (-rates[x], x))
        assert got[i][0] == order[0] or rates[order[0]] - rates[got[i][0]] < 1e-3
        assert got[i][1] == pytest.approx(rates[order[0]] / (rates[order[0]] + rates[order[1]]), abs=2e-3)


@pytest.mark.parametrize("text", ["½", "²", "Ⅷ", "①", "12 34", "_", "٣٤", "́", "!?"])
def test_numerals_are_no_letters(make_docs, text):
    assert not langid.words(text) and langid.words(f"a{text}b") in (["a", "b"],)


def test_words_are_runs_of_letters():
    text = "Ab½cd Ⅷx é́z 中文1日 ª² ʰ ⅸ"
    want = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    assert langid.words(text) == want


# --- quality -------------------------------------------------------------------------------


def buckets(text):
    mask = (1 << 64) - 1
    w = [xxhash.xxh3_64_intdigest(x) for x in (text or "").encode().lower().split()]
    pairs = [((a * 0x9E3779B97F4A7C15) & mask) ^ (b >> 1) for a, b in zip(w, w[1:])]
    return [x >> 47 for x in w + [(p * 0x9E3779B97F4A7C15) & mask for p in pairs]]


def test_log_weights_keys_and_top_k(spark, make_docs):
    r = random.Random(2)
    words = ["fine", "prose", "spam", "BUY", "now", "é", "the", "a"]
    texts = [" ".join(r.choice(words[: r.choice([4, 8])]) for _ in range(r.randint(0, 30))) for _ in range(80)] + [None]
    docs = make_docs(texts)
    labels = [(i, r.randint(0, 1), r.choice([0, 0, 1, None])) for i in range(0, 60)] + [(3, 1, 0), (None, 1, 0), (70, None, 0)]
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.resample(docs, df, fraction=0.3).collect()}

    good = {}
    for i, q, t in labels:
        if i is not None and q is not None:
            good[i] = good.get(i, True) and q == 1 and (t or 0) == 0
    fold = {x["doc_id"]: x["f"] for x in docs.select("doc_id", quality.fold(F.col("doc_id")).alias("f")).collect()}
    target, raw = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in enumerate(texts):
        raw[fold[i]].update(buckets(t))
        if good.get(i):
            target[fold[i]].update(buckets(t))
    keys = {}
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED), F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = {x["doc_id"]: -math.log(-math.log(x["u"])) for x in docs.select("doc_id", uniform.alias("u")).collect()}
    for i, t in enumerate(texts):
        other = 1 - fold[i]  # judged by what the other fold holds
        share = sum(target[other].values()) / sum(raw[other].values())
        weight = sum(math.log((target[other][b] + quality.PRIOR) / (raw[other][b] * share + quality.PRIOR)) for b in buckets(t))
        assert got[i]["log_weight"] == pytest.approx(weight, abs=1e-9)
        keys[i] = weight + noise[i]
        assert got[i]["gumbel_key"] == pytest.approx(keys[i], abs=1e-9)
    best = set(sorted(keys, key=lambda i: -keys[i])[: round(0.3 * len(texts))])
    assert {i for i, x in got.items() if x["kept"]} == best


# --- mixing --------------------------------------------------------------------------------


def test_passes_order_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 9)
    r = random.Random(4)
    sizes = {"big": 150, "mid": 40, "small": 12, None: 9}
    rows = [(k, s, r.randint(0, 90)) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    got = mixing.mix(df, block_tokens=900).collect()
    weight = {x["source"]: x["weight"] for x in got}
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    most = max(total[s] / weight[s] for s in total)
    budget = {s: weight[s] * most for s in total}
    blocks = max(1, math.ceil(sum(max(budget[s], total[s]) for s in total) / 900))
    u = {(x["doc_id"], p): x[f"u{p}"] for p in range(4) for x in df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(p), F.lit(mixing.SEED)), 1).alias(f"u{p}")).collect()}
    want = {}
    for s in total:
        for p in range(max(1, math.ceil(budget[s] / max(total[s], 1) - 1e-9))):
            start = p * total[s]
            for i, n in sorted(((i, n) for i, x, n in rows if x == s), key=lambda x: u[x[0], p]):
                if p == 0 or start < budget[s]:
                    want[i, p] = min(math.floor(start / max(budget[s], total[s], 1) * blocks), blocks - 1)
                start += n
    assert {(x["doc_id"], x["pass"]): x["block"] for x in got} == want
    assert len({(x["block"], x["place"]) for x in got}) == len(got)
