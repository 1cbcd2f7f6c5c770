"""Language identification by language-bitmask n-gram filters (op7).

Training counts the words of each language, breaks the distinct words into character n-grams
(of the word with a boundary mark at both ends) and keeps the n-grams that make up at least
``1 / GRAMS`` of a language's n-grams, so a language contributes at most ``GRAMS`` of them.
These enter one Bloom filter of ``SLOTS`` slots whose slots hold a bit per language: the AND
of an n-gram's slots is the set of all languages that have it. 64 languages share a slice.

Prediction sums, over the words of a whole text, the languages' hits; each language's count
is corrected for its filter's false positives and divided by the share of its own training
n-grams that the filter kept. The largest wins, ties go to the first name. The score is the winner's
share of the sum of the best two, 0 without any hit.

Null texts, and texts without a letter, are ``und``, as is all text if nothing was learned.
Rows without a language aren't learned from. Repeated rows are predicted row by row. Other
columns are ignored, clashing names included; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

SIZES = (1, 2, 3, 4)
GRAMS = 20_000
SLOTS, HASHES = 1 << 18, 3
#: Entries of a worker's counters before they are passed on, and of its word and n-gram caches.
COUNTER_ROWS, CACHE_ROWS = 200_000, 300_000
#: Words longer than this are counted and looked up in parts.
WORD_CHARS = 64
#: Width in bits of a language's field in a packed sum.
FIELD = 40

#: By code point, whether it is a letter.
_IS_LETTER = np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, the overlong ones in parts."""
    if not text:
        return []
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.where(_IS_LETTER[points], points, np.uint32(32)).astype("<u4").tobytes().decode("utf-32-le").split()
    if found and max(map(len, found)) > WORD_CHARS:
        found = [w[i : i + WORD_CHARS] for w in found for i in range(0, len(w), WORD_CHARS)]
    return found


def windows(word: str) -> list[str]:
    """What stands at each place of the marked word, up to the longest n-gram: the n-grams of a word are
    those that its windows begin with."""
    marked = f" {word} "
    return [marked[i : i + SIZES[-1]] for i in range(len(marked))]


def window_grams(window: str) -> list[str]:
    """The n-grams at the begin of a window, the boundary mark alone left out."""
    return [window[:n] for n in SIZES if n <= len(window) and (n > 1 or window[0] != " ")]


def grams(word: str) -> list[str]:
    return [g for w in windows(word) for g in window_grams(w)]


def slots(gram: str, n_slots: int = SLOTS) -> list[int]:
    h = xxhash.xxh3_128_intdigest(gram)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % n_slots for i in range(HASHES)]


def _flushed(counter: Counter, names: list[str]) -> pa.RecordBatch:
    keys = list(counter)
    cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([*cols, pa.array([counter[k] for k in keys], pa.int64())], names=[*names, "n"])


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` that have a language."""

    def count_words(batches):
        seen: dict[str, Counter] = {}
        for b in tokens.small_batches(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, seen.values())) > COUNTER_ROWS:
                yield _flushed(Counter({(lang, w): n for lang, c in seen.items() for w, n in c.items()}), ["lang", "word"])
                seen = {}
        yield _flushed(Counter({(lang, w): n for lang, c in seen.items() for w, n in c.items()}), ["lang", "word"])

    def gram_batch(seen):
        counter: Counter = Counter()
        for lang, some in seen.items():
            for w, n in some.items():
                for g in window_grams(w):
                    counter[lang, g] += n
        return _flushed(counter, ["lang", "gram"])

    def count_grams(batches):
        seen: dict[str, dict[str, int]] = {}
        for b in batches:
            for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                some = seen.setdefault(lang, {})
                for w in windows(word):
                    some[w] = some.get(w, 0) + n
            if sum(map(len, seen.values())) > COUNTER_ROWS:
                yield gram_batch(seen)
                seen = {}
        yield gram_batch(seen)

    some = docs.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l"))
    by_word = some.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return by_word.mapInArrow(count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """The learned filter: languages, slot masks (slots x slices), false-positive rates and
    the share of each language's own n-grams that the filter holds."""

    def __init__(self, langs: list[str], masks: np.ndarray, share: list[float]):
        self.langs, self.masks, self.share = langs, masks, share
        bits = [((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))]
        self.false_rate = [float(x) ** HASHES for x in bits]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n_slots: int = SLOTS) -> Model:
    """Learn from all rows of ``docs``; at most ``n_slots`` rows a slice reach the driver."""
    spark = docs.sparkSession
    common.ship(spark)
    counts = common.staged(gram_counts(docs, text_col, lang_col))
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros((n_slots, 1), np.uint64), [])
    # from Arrow: rows would pass through Python processes of another kind, with a daemon that stays on each executor
    info = spark.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "total": pa.array([totals[x] for x in langs], pa.int64()), "no": pa.array(range(len(langs)), pa.int64())}))
    kept = counts.join(F.broadcast(info), "lang").where(F.col("n") * GRAMS >= F.col("total"))

    def place(batches):
        for b in batches:
            at = [(s, no // 64, 1 << no % 64) for g, no in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in slots(g, n_slots)]
            masks = np.array([x[2] for x in at], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in at], pa.int32()), pa.array([x[1] for x in at], pa.int32()), pa.array(masks)], names=["slot", "slice", "mask"])

    filled = kept.select("gram", "no").mapInArrow(place, "slot int, slice int, mask long").groupBy("slot", "slice").agg(F.bit_or("mask").alias("mask"))
    masks = np.zeros((n_slots, (len(langs) + 63) // 64), np.uint64)
    rows = filled.toPandas()
    masks[rows["slot"], rows["slice"]] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    share = {r["lang"]: r["n"] / totals[r["lang"]] for r in kept.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return Model(langs, masks, [share.get(x, 1.0) for x in langs])


class Predictor:
    """Packed sums: bits 0..FIELD-1 count n-grams, each further field one language's hits."""

    def __init__(self, model: Model):
        self.m, self.of_word, self.of_window = model, {}, {}

    def gram(self, g: str) -> int:
        masks = np.bitwise_and.reduce(self.m.masks[slots(g, len(self.m.masks))], axis=0)
        hit = sum(int(x) << 64 * i for i, x in enumerate(masks))
        return 1 + sum(1 << FIELD * (i + 1) for i in range(len(self.m.langs)) if hit >> i & 1)

    def window(self, w: str) -> int:
        if len(self.of_window) > CACHE_ROWS:
            self.of_window.clear()
        self.of_window[w] = total = sum(map(self.gram, window_grams(w)))
        return total

    def word(self, w: str) -> int:
        found = windows(w)
        got = list(map(self.of_window.get, found))
        if None in got:
            got = [self.window(x) if v is None else v for x, v in zip(found, got)]
        if len(self.of_word) > CACHE_ROWS:
            self.of_word.clear()
        self.of_word[w] = total = sum(got)
        return total

    def text(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.m.langs:
            return "und", 0.0
        got = list(map(self.of_word.get, found))
        if None in got:
            got = [self.word(w) if v is None else v for w, v in zip(found, got)]
        total = sum(got)
        mask = (1 << FIELD) - 1
        n = total & mask
        rates = []
        for i, (f, share) in enumerate(zip(self.m.false_rate, self.m.share)):
            hits = total >> FIELD * (i + 1) & mask
            rates.append(max(0.0, (hits - n * f) / max(1e-9, 1 - f)) / n / share)
        best = max(range(len(rates)), key=lambda i: (rates[i], -i))
        rest = max([r for i, r in enumerate(rates) if i != best], default=0.0)
        return self.m.langs[best], rates[best] / (rates[best] + rest) if rates[best] > 0 else 0.0


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score of every row of ``docs``."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(model)  # SLOTS * 8 bytes for each 64 languages

    def label(batches):
        p = Predictor(sent.value)
        for b in tokens.small_batches(batches):
            got = [p.text(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    some = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([*some.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return some.mapInArrow(label, schema)


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""
    common.ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in tokens.small_batches(batches):
            yield b.filter(pa.array([any(map(str.isalpha, t or "")) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col):
    """The fold of documents that nothing is learned from."""
    return F.crc32(id_col.cast("string")) % 4 == 2
