"""Phrase collocations by Rabin-Karp fingerprints (op11).

Texts are lower-cased (A-Z), split at ``.,;:!?`` and line controls into pieces and those at spaces and
tabs into words. Counts are per language, over all contiguous occurrences inside a piece.

1. Prefix polynomials modulo 2**64, in numpy over a block of texts, give the hash of any word and, over the
   words' hashes, the fingerprint of any run of words, with a second polynomial as its check.
2. One pass over the texts for each phrase length. A task adds up its fingerprints; the shuffle adds them up
   further and keeps for each the least occurrence pointer (hash of the document, byte position) and the
   least and greatest check. A phrase can be frequent only if both its parts without the first or
   the last word are, so fingerprints whose parts miss the bitmap of frequent ones don't leave their
   task. The bitmap has ``FILTER_BITS`` bits whatever the corpus; if it fills up, it
   saves less and changes no result.
3. Frequent fingerprints are looked up in the text at their pointer, and fingerprint and check are
   computed again from the words found there. Only these phrases become strings. Fingerprints with
   unequal checks hold several phrases: these are counted again by their text.
4. Scores, cuts, absorption by longer phrases and the first ``TOP`` of each language are
   joins on strings, in exact decimals.

A null language counts as ``und``, a null text as empty; documents without words add nothing. Equal
rows count as often as they stand there. Ties in score and count go by the phrase's UTF-8 bytes.
Other columns are ignored, an empty table gives an empty result. Counts must stay below 1e16, and a
piece (not a text) must fit into a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

LONGEST, LEAST, TOP = 3, 10, 2000
#: A phrase goes if a longer one that holds it has this share of its count, in percent.
ABSORBED = 50
MILLION = 1_000_000
FILTER_BITS = 1 << 26
#: Fingerprints that a task adds up before it sends them on.
BLOCK = 1 << 19
#: Bytes of text that are hashed together, unless one text is longer.
TEXT_BYTES = 1 << 19
#: Bits of a fingerprint; tests use few, so that fingerprints collide.
BITS = 64

_BASE, _WORD_BASE, _CHECK_BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_FOUND = "fp long, ck long, n long, at long"


def _table(marked: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(marked)] = True
    return out


_PIECE = _table(b".,;:!?\n\x0b\x0c\r")
_SPACE = _table(b" \t") | _PIECE
_PIECE_END = re.compile(rb"[.,;:!?\n-\r]")
_WORD = rb"[^ \t.,;:!?\n-\r]+"
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, from 0 to n."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        steps = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps)
    return have


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, base: np.uint64, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], independent of their place, from prefix sums."""
    down = _power(np.uint64(pow(int(base), -1, 1 << 64)), len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[: len(values)], out=prefix[1:])
    return (prefix[end] - prefix[start]) * _power(base, len(values))[start]


class Words:
    """The words of a block of lower-cased texts: where they start and end, the first and last of
    each piece, and their hashes."""

    def __init__(self, texts: list[bytes]):
        text = b"\n".join(texts)
        raw = np.frombuffer(text, np.uint8)
        edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        cuts = np.cumsum(_PIECE[raw])
        self.piece = cuts[self.start] if len(self.start) else np.zeros(0, np.int64)
        codes = raw.astype(np.uint64) + np.uint64(1)
        self.word = _scattered(_spans(codes, _BASE, self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self.word_check = _scattered(_spans(codes, _CHECK_BASE, self.start, self.end))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_start = np.cumsum(lengths) - lengths
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1

    def phrases(self, n: int) -> np.ndarray:
        """Numbers of the first words of all runs of n words in a piece."""
        if n <= 1:
            return np.arange(len(self.start))
        return np.flatnonzero(self.piece[: 1 - n] == self.piece[n - 1 :]) if len(self.start) >= n else np.zeros(0, np.int64)

    def fingerprints(self, first: np.ndarray, n: int, seed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and check of the runs of n words from ``first`` on."""
        fp = _scattered(_spans(self.word, _WORD_BASE, first, first + n) + seed + np.uint64(n))
        ck = _scattered(_spans(self.word_check, _CHECK_BASE, first, first + n) ^ seed)
        return fp >> np.uint64(64 - bits), ck


def lowered(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _document(text: bytes, lang: str) -> int:
    """31 bits for a document; equal texts of a language are the same to a pointer."""
    return xxhash.xxh3_64_intdigest(text, seed=_seed(lang)) >> 33


class Block:
    """Texts that are hashed together: language, document number and place in the text of each."""

    def __init__(self):
        self.langs, self.texts, self.documents, self.offsets, self.size = [], [], [], [], 0

    def add(self, lang: str, text: bytes, document: int, offset: int) -> None:
        self.langs.append(lang)
        self.texts.append(text)
        self.documents.append(document)
        self.offsets.append(offset)
        self.size += len(text)

    def seeds(self) -> np.ndarray:
        return np.array([_seed(x) for x in self.langs], np.uint64)


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """The lower-cased texts of a batch, about ``TEXT_BYTES`` at a time; longer ones are cut at
    ends of pieces."""
    block = Block()
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        raw = lowered(text)
        document, at = _document(raw, lang), 0
        while at < len(raw):
            cut = _PIECE_END.search(raw, at + TEXT_BYTES) if len(raw) - at > TEXT_BYTES else None
            end = cut.end() if cut else len(raw)
            block.add(lang, raw[at:end], document, at)
            at = end
            if block.size >= TEXT_BYTES:
                yield block
                block = Block()
    if block.texts:
        yield block


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Rows of (fingerprint, check, count, pointer) added up by fingerprint and check."""
    fp, ck, n, at = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((at, ck, fp))
    fp, ck, n, at = fp[order], ck[order], n[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (ck[1:] != ck[:-1])])) if len(fp) else np.zeros(0, np.int64)
    return [fp[first], ck[first], np.add.reduceat(n, first) if len(first) else n, at[first]]


def counted(docs: DataFrame, n: int, frequent: Broadcast | None, bits: int) -> DataFrame:
    """fp, n, at, lo and hi (count, pointer, least and greatest check) of the phrases of n words whose
    parts may be frequent; with n = 0 the empty phrase, once a word."""

    def run(batches):
        parts, size = [], 0
        for b in tokens.small_batches(batches):
            for block in _blocks(b):
                parts.append(_rows(block, n, None if frequent is None else frequent.value, bits))
                size += len(parts[-1][0])
                if size >= BLOCK:
                    yield _sent(_summed(parts))
                    parts, size = [], 0
        if parts:
            yield _sent(_summed(parts))

    found = docs.mapInArrow(run, _FOUND)
    return found.groupBy("fp").agg(F.sum("n").alias("n"), F.min("at").alias("at"), F.min("ck").alias("lo"), F.max("ck").alias("hi"))


def _sent(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["fp", "ck", "n", "at"])


def _rows(block: Block, n: int, frequent: np.ndarray | None, bits: int) -> list[np.ndarray]:
    w, seeds = Words(block.texts), block.seeds()
    first = w.phrases(n)
    if frequent is not None:
        for skip in (0, 1):
            part, _ = w.fingerprints(first + skip, n - 1, seeds[w.text[first]], bits)
            at = part % np.uint64(64 * len(frequent))
            first = first[(frequent[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    text = w.text[first]
    fp, ck = w.fingerprints(first, n, seeds[text], bits)
    base = (np.array(block.documents, np.int64) << 32) + np.array(block.offsets, np.int64) - w.text_start
    return _summed([[fp, ck, np.ones(len(first), np.int64), base[text] + w.start[first]]])


def _bitmap(fps: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set for the fingerprints of ``fps``, collected by words of 64 bits."""
    at = F.col("fp").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(fp & 63 as int))")
    words = fps.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(bit).alias("m")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return out


def _pointed(docs: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """lang, phrase, size and n of the frequent fingerprints ``found`` (fp, ck, size, n, at)."""
    asked = found.groupBy(F.shiftright("at", 32).alias("document")).agg(F.collect_list(F.struct(F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("at"), "size", "fp", "ck", "n")).alias("asked"))
    asked = common.staged(asked)
    wanted = docs.sparkSession.sparkContext.broadcast(_bitmap(asked.select(F.col("document").alias("fp"))))

    def known(batches):
        for b in tokens.small_batches(batches):
            number = np.array([_document(lowered(t), x) for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
            at = number % (64 * len(wanted.value))
            some = pa.array((wanted.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)
            yield pa.RecordBatch.from_arrays([pa.array(number).filter(some), b.column(0).filter(some), b.column(1).filter(some)], names=["document", "lang", "text"])

    texts = docs.mapInArrow(known, "document long, lang string, text string")
    # copies of a text become one before the join
    texts = texts.groupBy("document", "lang", F.xxhash64("text").alias("copy")).agg(F.first("text").alias("text"))

    def look(batches):
        for b in tokens.small_batches(batches, 100):
            out = []
            for lang, text, rows in zip(*(c.to_pylist() for c in b.columns)):
                raw = lowered(text)
                for size in {r["size"] for r in rows}:
                    out += _found(raw, lang, size, [r for r in rows if r["size"] == size], bits)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _KINDS)] if out else [pa.array([], t) for t in _KINDS], names=["lang", "phrase", "size", "n"])

    return texts.join(asked, "document").select("lang", "text", "asked").mapInArrow(look, "lang string, phrase string, size int, n long").distinct()


_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int64()]


def _found(raw: bytes, lang: str, size: int, rows: list[dict], bits: int) -> list[tuple]:
    """The phrases at the places of ``rows`` that have their fingerprint and check."""
    run = re.compile(rb"[ \t]+".join([_WORD] * size))
    there = [(r, m[0]) for r in rows if (m := run.match(raw, r["at"]))]
    w = Words([x for _, x in there])
    first = np.searchsorted(w.text, np.arange(len(there)))
    fp, ck = w.fingerprints(first, size, np.full(len(there), _seed(lang), np.uint64), bits)
    got = zip(there, fp.view(np.int64).tolist(), ck.view(np.int64).tolist())
    same = [(r, x) for (r, x), f, c in got if (f, c) == (r["fp"], r["ck"])]
    return [(lang, b" ".join(x.split()).decode("utf-8", "surrogatepass"), size, r["n"]) for r, x in same]


def _by_text(docs: DataFrame, n: int, fps: list[int], bits: int) -> DataFrame:
    """lang, phrase, size and n of the phrases of n words with one of the fingerprints ``fps``,
    counted by their text."""
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(fps, np.int64)))

    def run(batches):
        for b in tokens.small_batches(batches):
            for block in _blocks(b):
                w, text = Words(block.texts), b"\n".join(block.texts)
                first = w.phrases(n)
                fp, _ = w.fingerprints(first, n, block.seeds()[w.text[first]], bits)
                first = first[np.isin(fp.view(np.int64), wanted.value)]
                phrases = [b" ".join(text[w.start[k] : w.end[k]] for k in range(i, i + n)).decode("utf-8", "surrogatepass") for i in first.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([block.langs[t] for t in w.text[first].tolist()], pa.string()), pa.array(phrases, pa.string())], names=["lang", "phrase"])

    return docs.mapInArrow(run, "lang string, phrase string").groupBy("lang", "phrase").agg(F.lit(n).alias("size"), F.count("*").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """lang, phrase, size (words) and n of all phrases of 0 to ``longest`` words that occur ``least``
    times or more, from ``docs`` (lang, text). The empty phrase occurs once a word."""
    common.ship(docs.sparkSession)
    spark, found, mixed, bitmap = docs.sparkSession, [], [], None
    for size in range(longest + 1):
        some = counted(docs, size, bitmap, bits).where((F.col("n") >= least) | F.lit(size == 0))
        some = common.staged(some.withColumn("size", F.lit(size)))
        if size >= 1:
            bitmap = spark.sparkContext.broadcast(_bitmap(some))
        both = [r["fp"] for r in some.where("lo <> hi").select("fp").collect()]  # none but for colliding hashes
        if both:
            mixed.append(_by_text(docs, size, both, bits).where(F.col("n") >= least))
        found.append(some.where("lo = hi").select("fp", F.col("lo").alias("ck"), "size", "n", "at"))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    out = _pointed(docs, every, bits)
    for x in mixed:
        out = out.unionByName(x)
    return common.staged(out)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of each language."""
    some = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    phrases = frequent_phrases(some, longest, least, bits)
    words = F.split("phrase", " ")
    long = phrases.where("size >= 2")
    cuts = long.select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("p"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("q"))
    parts = phrases.where(F.col("size").between(1, longest - 1))
    left = parts.select("lang", F.col("phrase").alias("p"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("q"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "p"]).join(right, ["lang", "q"])
    big = lambda c: f"cast({c} as decimal(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"({big('a')} * {big('a')} * {MILLION}) div ({big('l')} * {big('r')})").cast("long"))
    worst = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = phrases.where("size >= 3").select("lang", "size", words.alias("w"), F.col("n").alias("longer"))
    inside = inside.select("lang", "w", "longer", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    inside = inside.select("lang", "w", "longer", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("i"))
    inside = inside.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "longer")
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = worst.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < ABSORBED * F.col("a")))
    kept = common.staged(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    # a score and count that surely have ``top`` phrases at or above them, so that few rows are ranked
    share = F.greatest(F.lit(0.0), 1 - (F.lit(top) + 2 * F.ceil(F.count("*") / 10_000)) / F.count("*"))
    marked = kept.withColumn("mark", F.shiftleft("score", 40) + F.least(F.col("a"), F.lit((1 << 40) - 1)))
    bounds = marked.groupBy("lang").agg(F.percentile_approx("mark", F.array(*[F.lit(k / 256) for k in range(257)]), 10_000).alias("marks"), share.alias("share"))
    bounds = bounds.select("lang", F.expr("marks[cast(floor(share * 256) as int)]").alias("least"))
    near = marked.join(bounds, "lang").where(F.col("mark") >= F.col("least")).drop("least", "mark")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase").asc())
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = phrases.where("size = 0").select("lang", "n")
    out = ranked.join(total, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
