"""Secret scan by fixed patterns and a randomness test battery (op4), all in SQL functions.

Base spans come from the three patterns of ``BASE`` (leftmost, non-overlapping per kind;
matches that are too short are dropped after matching). The battery then looks at every
token of ``CANDIDATE``. It infers the smallest alphabet that holds the token and computes

* chi-squared against a uniform alphabet, the runs test around the alphabet's middle and
  the lag-one serial correlation, joined by Fisher's method: a token must not look
  structured (joint p of at least ``STRUCTURED``);
* the probability that a token with the letter repetition of written language comes out
  as uniform as this one. It falls with length, so short tokens need to be more uniform.

Those probabilities are cut by Benjamini-Hochberg at rate ``FALSE_RATE`` in each length class
over all candidates of the corpus. For that, one aggregate counts them by class and by
logarithmic bin, and the cut is a bin's edge, so it errs to the strict side. The
second pass finds base and battery spans within each row: no joins, no groups.

Offsets are code points, ends exclusive. Null text counts as empty; repeated rows are scanned
row by row; other columns pass by untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern, group whose length counts, least length), in the order of the report (fixed values).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: The alphabets tried, smallest first.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum_lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "alnum_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-",
}
#: Lower bounds of the length classes in which false discoveries are controlled.
CLASSES = (20, 32, 48, 64, 128)
FALSE_RATE, STRUCTURED = 0.05, 0.001
#: Chance that two letters of written language are equal (fixed value).
REPEAT = 0.065
#: Bins per unit of -ln(p), and the largest bin.
BINS, LAST_BIN = 50, 2000
MASK = "[SECRET]"
#: Matches of a text whose places are summed up together.
CHUNK = 128


def _phi(z: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def _at_least(p: Column) -> Column:
    return F.greatest(p, F.lit(1e-17))


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` reads it."""
    return F.transform(F.array(value), then)[0]


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of all matches, empty if there is none.

    Starts are running sums over the gaps and matches. They are formed in chunks of ``CHUNK``
    matches, as an array that grows by one copies all it holds. Gaps, matches and their pairs are
    bound once, so the pattern runs over a text once for each, however many chunks there are.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    pairs = _let(parts, lambda x: F.arrays_zip(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])).alias("gap"), x["hits"].alias("hit")))

    def chunked(x):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, CHUNK))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    def chunk_step(acc, chunk):
        more = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("found")), step)
        return _let(more, lambda m: F.struct(m["at"].alias("at"), F.concat(acc["found"], F.array(m["found"])).alias("found")))

    lists = F.array().cast("array<array<struct<start:int,end:int,hit:string>>>")
    found = F.aggregate(_let(pairs, chunked), F.struct(F.lit(0).alias("at"), lists.alias("found")), chunk_step)["found"]
    return F.when(text.rlike(pattern), F.flatten(found)).otherwise(none)


def battery(token: Column) -> Column:
    """struct<n, p_structured, p_language> of a token; padding isn't part of it."""
    body = F.regexp_replace(token, "=+$", "")
    alphabet = F.lit(None).cast("string")
    for chars in reversed(ALPHABETS.values()):
        alphabet = F.when(F.translate(body, chars, "") == "", F.lit(chars)).otherwise(alphabet)
    return _from_codes(body, alphabet)


def _from_codes(body: Column, alphabet: Column) -> Column:
    """Each step adds fields that the next one reads, so that nothing is computed twice."""

    def sums(x):
        v, k = x["v"], x["k"]
        n = F.size(v)
        nxt = F.concat(F.slice(v, F.lit(2), n - 1), F.slice(v, 1, 1))
        above = F.transform(v, lambda a: F.when(a * 2 > k, 1.0).otherwise(0.0))
        zero = F.lit(0.0)
        add = lambda a, b: a + b
        counts = F.aggregate(F.transform(F.array_distinct(v), lambda c: F.size(F.filter(v, lambda y: y == c)).cast("double")), zero, lambda a, b: a + b * b)
        ups = F.aggregate(above, zero, add)
        changes = F.aggregate(F.zip_with(above, F.slice(above, F.lit(2), n - 1), lambda a, b: F.when(b.isNotNull() & (a != b), 1.0).otherwise(0.0)), zero, add)
        return F.struct(
            n.cast("double").alias("n"), k.cast("double").alias("k"), counts.alias("squares"), ups.alias("ups"), (changes + 1).alias("runs"),
            F.aggregate(v, zero, add).alias("s"), F.aggregate(v, zero, lambda a, b: a + b * b).alias("ss"),
            F.aggregate(F.zip_with(v, nxt, lambda a, b: a * b), zero, add).alias("sp"),
        )

    def tests(x):
        n, k, df = x["n"], x["k"], x["k"] - 1
        chi = x["squares"] * k / n - n
        cube = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        n1, n2 = x["ups"], n - x["ups"]
        mean = 2 * n1 * n2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(var > 0, (x["runs"] - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(9.0))
        spread = n * x["ss"] - x["s"] * x["s"]
        corr = F.when(spread > 0, (n * x["sp"] - x["s"] * x["s"]) / F.greatest(spread, F.lit(1e-9))).otherwise(F.lit(1.0))
        z_corr = (corr + 1 / (n - 1)) * F.sqrt(n)
        extra = F.greatest(REPEAT * k - 1, F.lit(0.5)) * n
        return F.struct(
            n.cast("int").alias("n"), _at_least(_phi(-cube)).alias("chi"), _at_least(2 * _phi(-F.abs(z_runs))).alias("runs"), _at_least(2 * _phi(-F.abs(z_corr))).alias("corr"),
            _at_least(_phi((chi - df - extra) / F.sqrt(2 * df + 4 * extra))).alias("p_language"),
        )

    def joined(x):
        half = -(F.log(x["chi"]) + F.log(x["runs"]) + F.log(x["corr"]))
        return F.struct(x["n"].alias("n"), (F.exp(-half) * (1 + half + half * half / 2)).alias("p_structured"), x["p_language"].alias("p_language"))

    codes = F.transform(F.split(body, ""), lambda c: F.when(c != "", F.position(c, alphabet)).otherwise(0).cast("double"))
    start = F.struct(F.filter(codes, lambda v: v > 0).alias("v"), F.length(alphabet).alias("k"))
    return _let(_let(_let(start, sums), tests), joined)


def _class(n: Column) -> Column:
    return sum(((n >= low).cast("int") for low in CLASSES[1:]), F.lit(0))


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log(_at_least(p)) * BINS), F.lit(LAST_BIN)).cast("int")


def candidates(text: Column) -> Column:
    """array<struct<start, end, n, p_structured, p_language>>; digits alone are no candidate."""
    found = F.filter(_spans(text, CANDIDATE), lambda x: x["hit"].rlike("[A-Za-z]"))

    def test(x):
        b = battery(x["hit"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), b.alias("b"))

    return F.transform(found, test)


def discovery_cuts(docs: DataFrame, text_col: str = "text", rate: float = FALSE_RATE) -> list[int]:
    """For each length class the least bin that is a discovery (LAST_BIN + 1: none is)."""
    text = F.col(f"`{text_col}`")
    one = docs.where(text.rlike(CANDIDATE)).select(F.explode(candidates(text)).alias("c"))
    counts = one.groupBy(_class(F.col("c.b.n")).alias("cls"), _bin(F.col("c.b.p_language")).alias("bin")).agg(F.count("*").alias("n"))
    by = {}
    for r in counts.collect():  # at most len(CLASSES) * (LAST_BIN + 1) rows
        by.setdefault(r["cls"], {})[r["bin"]] = r["n"]
    cuts = []
    for cls in range(len(CLASSES)):
        bins = by.get(cls, {})
        total, upto, cut = sum(bins.values()), 0, LAST_BIN + 1
        for b in sorted(bins, reverse=True):
            upto += bins[b]
            if math.exp(-b / BINS) <= rate * upto / total:
                cut = b
        cuts.append(cut)
    return cuts


def _base_spans(text: Column, kind: str, rank: int) -> Column:
    pattern, group, least = BASE[kind]

    def long_enough(x):
        return F.length(F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]) >= least

    def span(x):
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))

    return F.transform(F.filter(_spans(text, pattern), long_enough), span)


def all_spans(text: Column, cuts: list[int]) -> Column:
    """Sorted array<struct<start, rank, kind, end>> of base and battery spans. Most texts match no
    pattern; for them nothing but the patterns is evaluated."""
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    parts = [_base_spans(text, kind, rank) for rank, kind in enumerate(BASE)]
    limits = F.array(*[F.lit(c) for c in cuts])
    chosen = F.filter(candidates(text), lambda x: (x["b"]["p_structured"] >= STRUCTURED) & (_bin(x["b"]["p_language"]) >= F.get(limits, _class(x["b"]["n"]))))
    chosen = F.when(text.rlike(CANDIDATE), chosen)
    random = F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE)).alias("rank"), F.lit("random").alias("kind"), x["end"].alias("end")))
    parts.append(F.coalesce(random, none))
    matched = text.rlike(CANDIDATE)
    for pattern, _, _ in BASE.values():
        matched = matched | text.rlike(pattern)
    return F.when(matched, F.array_sort(F.concat(*parts))).otherwise(none)


def scan(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans") -> DataFrame:
    """``docs`` with ``spans_col``, the sorted spans of its whole text."""
    cuts = discovery_cuts(docs, text_col)
    return docs.withColumn(spans_col, all_spans(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), cuts))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span, overlapping ones together, replaced by ``MASK``."""

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        more = F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
