import hashlib
import random

import numpy as np

from claims_cohorts.llm import fingerprints as fp


def want(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fp.fingerprint(t), fp.fingerprint(e))
    return out


def got(df):
    return {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in fp.edited_fingerprints(df).collect()}


def test_edited_texts_across_ranges(make_docs, odd_texts, corpus, monkeypatch):
    assert got(make_docs(odd_texts)) == want(list(enumerate(odd_texts)))
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    df, rows = corpus
    assert got(df) == want(rows)


def test_one_row_two_rows_and_none(make_docs):
    assert got(make_docs(["abcdef"], ids=[5])) == want([(5, "abcdef")])
    assert got(make_docs(["abcdef", "xy"], ids=[5, 9])) == want([(5, "abcdef"), (9, "xy")])
    assert fp.edited_fingerprints(make_docs(["a"]).limit(0)).collect() == []


def test_equal_texts_and_repeated_ids(make_docs):
    rows = fp.edited_fingerprints(make_docs(["same text", "same text", None, "z"], ids=[3, 3, None, 8])).collect()
    assert len(rows) == 4
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 3}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_products_and_spans():
    r = random.Random(2)
    a = [r.randrange(fp.PRIME) for _ in range(2000)] + [fp.PRIME - 1, 0, 1]
    b = [r.randrange(fp.PRIME) for _ in range(2000)] + [fp.PRIME - 1, 5, fp.PRIME - 1]
    assert fp.mulmod(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % fp.PRIME for x, y in zip(a, b)]
    text = "".join(r.choice("abé😀") for _ in range(400))
    p = fp.Prefixes(text)
    for _ in range(300):
        i, k, n = r.randrange(390), r.randrange(390), r.randrange(1, 10)
        assert p.equal(i, p, k, n) == (text[i : i + n] == text[k : k + n])
        longest = next((m for m in range(400) if max(i, k) + m >= 400 or text[i + m] != text[k + m]))
        assert p.common(i, p, k) == longest
        assert int(p.span(i, i + n)) == p.one(i, i + n)


def test_likeness_follows_the_share_of_common_spans():
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    for share in (0.0, 0.3, 0.6, 0.9):
        errors = []
        for _ in range(20):
            head, x, y = text(int(2000 * share)), text(int(2000 * (1 - share))), text(int(2000 * (1 - share)))
            a, b = head + x, head + y
            sets = [{t[i : i + fp.SPAN] for i in range(len(t) - fp.SPAN + 1)} for t in (a, b)]
            errors.append(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        assert abs(sum(errors) / 20) < 0.06
    assert fp.likeness(fp.fingerprint("a"), fp.fingerprint("a")) == 1 and fp.likeness(fp.fingerprint(""), fp.fingerprint("a")) == 0
