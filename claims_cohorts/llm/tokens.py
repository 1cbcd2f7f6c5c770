"""Token counts by a map-side two-tier lookup (op9), and the chunk encoder packing shares.

A text is cut only where every byte-level pre-tokenizer of this family also cuts: before
a space that a visible Latin character follows. Such a chunk's ids don't depend on its
surroundings, so they can be looked up. Tier one is a broadcast table of the corpus' most
frequent chunks (at most ``table_rows``), tier two a bounded cache in each worker that
encodes what it misses with the tokenizer itself. No chunk is shuffled; the first pass
sends each task's most frequent chunks only, which decides speed and never the counts.

Texts that hold the string of a special token are encoded whole, as the library would.
Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted row by row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Largest tier-one table, in chunks (about 2 MB); frequent chunks that one task reports.
TABLE_ROWS, TASK_ROWS = 40_000, 20_000
#: Chunks that a worker's cache holds before it starts anew, and the longest one it keeps.
CACHE_ROWS, CACHE_CHARS = 500_000, 32
#: A task's counter is thinned to its most frequent chunks beyond this many.
COUNTER_ROWS = 400_000

_SAFE = "!-~¡-ɏ"
_CUT = re.compile(f" (?=[{_SAFE}])")
_ODD = re.compile(f" (?![{_SAFE}])")
#: Letters whose classes different regex libraries may not agree on.
_FOREIGN = re.compile("[^\t\n\r -~¡-ɏ]")

#: The byte-level pre-tokenizer's split, with possessive runs (fixed values).
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_encoders: dict[str, "ChunkEncoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str) -> list[str]:
    """Pieces of ``text`` that encode independently; all but the first lack their leading space."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class ChunkEncoder:
    """Ids of chunks and texts, equal to those of the ``tokenizers`` file at ``path``.

    Where the file is byte-level BPE whose merges are in id order, ``tiktoken`` over the
    same vocabulary encodes Latin text several times faster; all else goes to ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        model = json.loads(self.tokenizer.to_str())
        byte_of = {c: b for b, c in _byte_letters().items()}
        kept = {t: i for t, i in model["model"]["vocab"].items() if i not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"].get("merges", [])]
        level = model["pre_tokenizer"] or {}
        plain = level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and not model["normalizer"]
        self.fast, self.width = None, None
        if plain and not model["model"].get("ignore_merges") and [kept.get(x + y) for x, y in merges] == list(range(256, 256 + len(merges))):
            import tiktoken
            ranks = {bytes(byte_of[c] for c in t): i for t, i in kept.items()}
            self.fast = tiktoken.Encoding("same vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(max(ranks.values()) + 1, np.int64)
            self.width[list(ranks.values())] = [len(t) for t in ranks]

    def whole(self, text: str) -> list[int]:
        if self.fast is None or _FOREIGN.search(text) or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def many(self, parts: list[str]) -> tuple[bytes, list[int]]:
        """Ids of all chunks as little-endian 32-bit words, and how many each has. All stand after a space and before a visible character, so
        joined they are cut where they meet; token widths in bytes tell their ids apart."""
        joined = "".join(parts)
        if self.fast is None or _FOREIGN.search(joined):
            each = [self.whole(p) for p in parts]
            return np.array([i for x in each for i in x], dtype="<u4").tobytes(), [len(x) for x in each]
        ids = np.array(self.fast.encode_ordinary(joined), dtype="<u4")
        if joined.isascii():
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        else:
            ends = np.cumsum([len(p.encode()) for p in parts])
        upto = np.searchsorted(np.cumsum(self.width[ids]), ends, side="left") + 1
        return ids.tobytes(), np.diff(upto, prepend=0).tolist()


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def encoder(path: str) -> ChunkEncoder:
    """One tokenizer per worker process."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class TwoTier:
    """chunk -> its number of ids, or their bytes: ``first`` is the fixed tier one, ``cache``
    the bounded tier two, and what both miss is encoded."""

    def __init__(self, path: str, lengths: bool, first: dict | None = None):
        self.enc, self.lengths, self.first, self.cache = encoder(path), lengths, first or {}, {}

    def whole(self, text: str):
        ids = self.enc.whole(text)
        return len(ids) if self.lengths else np.array(ids, dtype="<u4").tobytes()

    def of(self, text: str) -> list:
        """The values of a text's chunks, in order."""
        if not text:
            return []
        if any(s in text for s in self.enc.special):
            return [self.whole(text)]
        words = chunks(text)
        head = self.whole(words[0]) if words[0] else (0 if self.lengths else b"")
        if self.first:
            out = list(map(self.first.get, words))
            out[0] = head
            for i in [i for i, v in enumerate(out) if v is None]:
                out[i] = self.cache.get(words[i])
        else:
            out = list(map(self.cache.get, words))
            out[0] = head
        if None in out:
            self.learn(words, [i for i, v in enumerate(out) if v is None], out)
        return out

    def learn(self, words: list[str], left: list[int], out: list) -> None:
        if len(self.cache) > CACHE_ROWS:
            self.cache = {}
        raw, counts = self.enc.many([" " + words[i] for i in left])
        at = 0
        for i, n in zip(left, counts):
            out[i] = v = n if self.lengths else raw[at : at + 4 * n]
            at += 4 * n
            if len(words[i]) <= CACHE_CHARS:
                self.cache[words[i]] = v


def small_batches(batches, rows: int = 500):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def frequent_chunks(docs: DataFrame, text_col: str = "text", rows: int = TABLE_ROWS) -> DataFrame:
    """(chunk, n): the most frequent chunks, from each task's most frequent ones."""

    def count(batches):
        seen: Counter = Counter()
        for b in small_batches(batches):
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(chunks(t)[1:])
            if len(seen) > COUNTER_ROWS:
                seen = Counter(dict(seen.most_common(COUNTER_ROWS // 2)))
        top = [(c, n) for c, n in seen.most_common(TASK_ROWS) if n > 1 and len(c) <= CACHE_CHARS]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([c for c, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    found = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(count, "chunk string, n long")
    return found.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(rows)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, n_bytes and n_tokens (and the columns ``keep``) of every row of ``docs``."""
    spark = docs.sparkSession
    common.ship(spark)

    def lengths(batches):
        enc = encoder(path)
        for b in batches:
            n = enc.many([" " + c for c in b.column(0).to_pylist()])[1] if b.num_rows else []
            yield pa.RecordBatch.from_pydict({"chunk": b.column(0), "n": pa.array(n, pa.int32())})

    table = {r["chunk"]: r["n"] for r in frequent_chunks(docs, text_col).select("chunk").mapInArrow(lengths, "chunk string, n int").toLocalIterator()}
    hot = spark.sparkContext.broadcast(table)  # at most TABLE_ROWS chunks of CACHE_CHARS characters
    cols = [F.col(f"`{id_col}`").alias(id_col), *[F.col(f"`{c}`") for c in keep]]
    rows = docs.select(*cols, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))

    def count(batches):
        look = TwoTier(path, True, hot.value)
        for b in small_batches(batches):
            n = [sum(look.of(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(b.columns[:-1] + [pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    rows = rows.withColumn("n_bytes", F.octet_length("__text").cast("long")).select(*[c for c in rows.columns if c != "__text"], "n_bytes", "__text")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(count, schema)
