"""Prefix trie of conversations by truncation peeling (op12).

A conversation is a sequence of turns (role, text). Each distinct sequence of its first d turns is a
node of depth d. The trie is peeled from its greatest depth to the root:

1. Every conversation becomes a path: per turn the 128-bit digest of the sequence so far and the
   number of words of the turn. Texts don't travel, only digests do. Equal conversations are
   merged before anything else, so a conversation that a third of all ids hold is one row.
2. Peeling goes down in bands of depth (2**k, 2**(k+1)]: what survives of the deeper band meets the
   conversations that end in this one. At the greatest depth, rows of equal path are merged into
   their node (members, least member, children, leaves and savings add up), the last turn is
   stripped, and the result regroups with the conversations that end one turn earlier. So nodes
   are found and aggregated in the same pass, and the number of passes grows with the logarithm
   of the longest conversation.
3. Paths that share the prefix at the lower end of the band are peeled together in one task, if
   there are at most ``GROUP_ROWS`` of ``GROUP_BYTES`` together. Larger groups (many distinct
   conversations with a common start) are peeled level by level with a distributed aggregate,
   which combines map-side. Both ways give the same nodes.
4. Parents are joined by digest. The members that end at a node go by runs of ``RUN`` consecutive
   ids to one row each, and the rows of a node are hashed in order as a stream.

Null roles and texts count as empty. Turns are ordered by number, null first; turns of equal number by
the digest of role and text, so repeated rows are repeated turns. Rows without conv_id are left out,
as they can't be members. Other columns are ignored, an empty table gives no node, not even a root.
A conversation's digests (24 bytes a turn) must fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes per turn in a path: digest of the prefix, number of words.
DIGEST, STEP = 16, 24
#: Paths of a common prefix that are peeled in one task, and their bytes.
GROUP_ROWS, GROUP_BYTES = 256, 8 << 20
#: Width of a run of ids whose members travel as one row.
RUN = 4096
#: Every ``SHARE``-th conversation lends its first turns to those after it, fewer than ``HEADS``.
SHARE, HEADS = 20, 4
ROOT = bytes(DIGEST)

_ITEM = "path binary, n_convs long, conv_id long, n_children long, n_leaves long, saved long"
_NODE = "key binary, up binary, depth long, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long"


def turn_rows(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, pos (from 1), digest and words of every turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    some = convs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text")).where("id is not null")
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    small = some.select("id", "turn", F.unhex(F.substring(F.sha2(said, 256), 1, 2 * DIGEST)).alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = Window.partitionBy("id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return small.select("id", F.row_number().over(order).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """id and its turns, an array of (part, pos, digest, words) in order, of every conversation.

    The first h turns come from conversation id - id % SHARE, h = crc32(id) % HEADS, the others are
    its own. A lender has ``SHARE`` borrowers at most.
    """
    head = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    convs = turns.groupBy("id").agg(F.count("*").alias("n")).select("id", head.alias("h"), (F.col("id") - F.col("id") % SHARE).alias("lender"))
    lent = turns.where((F.col("id") % SHARE == 0) & (F.col("pos") < HEADS)).select(F.col("id").alias("lender"), "pos", "digest", "words")
    borrowed = convs.join(lent, "lender").where("pos <= h").select("id", F.lit(0).alias("part"), "pos", "digest", "words")
    own = turns.withColumn("h", head).where("pos > h").select("id", F.lit(1).alias("part"), "pos", "digest", "words")
    none = convs.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("part", "int"), ("pos", "int"), ("digest", "binary"), ("words", "long"))])
    turn = F.when(F.col("part").isNotNull(), F.struct("part", "pos", "digest", "words"))
    return borrowed.unionByName(own).unionByName(none).groupBy("id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """id and path of conversations (id, turns in order)."""
    common.ship(convs.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for turns in b.column(1).to_pylist():
                key, parts = ROOT, []
                for t in turns:
                    key = hashlib.sha256(key + t["digest"]).digest()[:DIGEST]
                    parts.append(key + t["words"].to_bytes(STEP - DIGEST, "big"))
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "path"])

    return convs.select("id", "turns").mapInArrow(fold, "id long, path binary")


def _key(path: Column) -> Column:
    return F.when(F.length(path) > 0, F.substring(path, F.length(path) - (STEP - 1), F.lit(DIGEST))).otherwise(F.lit(ROOT))


def _words(path: Column) -> Column:
    digits = F.conv(F.hex(F.substring(path, F.length(path) - (STEP - DIGEST - 1), F.lit(STEP - DIGEST))), 16, 10)
    return F.when(F.length(path) > 0, digits.cast("long")).otherwise(F.lit(0).cast("long"))


def _depth(path: Column) -> Column:
    return (F.length(path) / STEP).cast("long")


def one_level(items: DataFrame) -> DataFrame:
    """The nodes of ``items``, rows of equal depth: conversations that end there and children
    that were stripped to it."""
    merged = items.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.min("conv_id").alias("conv_id"))
    path = F.col("path")
    up = F.substring(path, F.lit(1), F.length(path) - STEP)
    return merged.select(
        _key(path).alias("key"), F.when(F.length(path) > 0, up).alias("up"), _depth(path).alias("depth"), "n_convs", "conv_id", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * _words(path)).alias("saved_tokens"),
    )


def peel(rows: list[tuple], low: int) -> list[tuple]:
    """Nodes above depth ``low`` of items (path, n_convs, conv_id, n_children, n_leaves, saved),
    with the stripped path for those that survive at ``low`` (else none, but the parent's key)."""
    at: dict[int, dict[bytes, list]] = {}
    for path, *figures in rows:
        _merge(at.setdefault(len(path) // STEP, {}), path, figures)
    out = []
    for depth in range(max(at), low, -1):
        for path, (n, least, children, leaves, saved) in at.pop(depth, {}).items():
            up, leaves = path[:-STEP], leaves if children else 1
            saved += (n - 1) * int.from_bytes(path[DIGEST - STEP :], "big")
            out.append((path[-STEP : DIGEST - STEP], up if depth == low + 1 else up[-STEP:], depth, n, least, children, leaves, saved))
            if depth > low + 1:
                _merge(at.setdefault(depth - 1, {}), up, [n, least, 1, leaves, saved])
    return out


def _merge(level: dict, path: bytes, figures: list) -> None:
    have = level.get(path)
    if have is None:
        level[path] = list(figures)
        return
    for k, x in enumerate(figures):
        have[k] = min(have[k], x) if k == 1 else have[k] + x


def _peeled(items: DataFrame, low: int) -> DataFrame:
    """Nodes above depth ``low``, all paths of a common prefix at ``low`` in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, rows, size = None, [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0][: low * STEP] != prefix and size > GROUP_BYTES:
                    yield _batch(peel(rows, low))
                    rows, size = [], 0
                prefix = row[0][: low * STEP]
                rows.append(row)
                size += len(row[0])
        if rows:
            yield _batch(peel(rows, low))

    dealt = items.repartition(F.substring("path", 1, low * STEP)) if low else items.coalesce(1)
    return dealt.sortWithinPartitions("path").mapInArrow(run, _NODE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=[c.split()[0] for c in _NODE.split(", ")])


def _survivors(nodes: DataFrame, depth: int) -> DataFrame:
    some = nodes.where(F.col("depth") == depth + 1)
    return some.select(F.col("up").alias("path"), "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", F.col("saved_tokens").alias("saved"))


def _band(items: DataFrame, low: int, high: int) -> list[DataFrame]:
    """Staged nodes with depths above ``low`` up to ``high``; the last have the survivors."""
    prefix = F.substring("path", 1, low * STEP)
    sizes = items.groupBy(prefix.alias("prefix")).agg(F.sum(F.length("path")).alias("size"), F.count("*").alias("n"))
    large = common.staged(sizes.where((F.col("n") > GROUP_ROWS) | (F.col("size") > GROUP_BYTES) & (F.col("n") > 1)).select("prefix"))
    if large.isEmpty():
        return [common.staged(_peeled(items, low))]
    wide = common.staged(items.join(large, prefix == large["prefix"], "left_semi"))
    out, live = [], None
    if low:  # else all have the one prefix
        out.append(common.staged(_peeled(items.join(large, prefix == large["prefix"], "left_anti"), low)))
    for depth in range(high, low, -1):
        ended = wide.where(_depth(F.col("path")) == depth)
        out.append(common.staged(one_level(ended if live is None else ended.unionByName(live))))
        live = _survivors(out[-1], depth - 1)
    common.unstage(wide)
    return out


def nodes(convs: DataFrame) -> DataFrame:
    """key, parent_key, depth and figures of every node of conversations (id, path), a staged table."""
    ended = convs.groupBy("path").agg(F.count("*").alias("n_convs"), F.min("id").alias("conv_id"))
    zero = F.lit(0).cast("long")
    ended = common.staged(ended.select("path", "n_convs", "conv_id", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved")))
    deepest = ended.agg(F.max(_depth(F.col("path")))).first()[0]
    if deepest is None:
        return _keyed(one_level(ended))
    found: list[DataFrame] = []
    live, high = None, deepest
    while high > 0:
        low = (1 << (high - 1).bit_length()) // 2 if high > 1 else 0
        items = ended.where(_depth(F.col("path")).between(low + 1, high))
        band = _band(items if live is None else items.unionByName(live), low, high)
        found += [_keyed(x) for x in band]
        lives = [_survivors(x, low) for x in band]
        live = lives[0]
        for x in lives[1:]:
            live = live.unionByName(x)
        high = low
    root = ended.where(F.length("path") == 0)
    found.append(_keyed(one_level(root if live is None else root.unionByName(live))))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return common.staged(out)


def _keyed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the parent's key in the place of the stripped path."""
    up = F.col("up")
    parent = F.when(F.col("depth") > 1, F.substring(up, F.length(up) - (STEP - 1), F.lit(DIGEST))).when(F.col("depth") == 1, F.lit(ROOT))
    return nodes.withColumn("up", parent).withColumnRenamed("up", "parent_key")


def ends(convs: DataFrame) -> DataFrame:
    """key and ends_sha256 of every node where conversations (id, path) end."""
    runs = convs.select(_key(F.col("path")).alias("key"), F.floor(F.col("id") / RUN).alias("run"), "id").groupBy("key", "run")
    runs = runs.agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string"))).alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            keys, hashes = [], []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    hashes.append(sha.hexdigest())
                key, sha = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256
    of every node of conversations (id, turns in order)."""
    convs = common.staged(paths(convs))
    all_nodes = nodes(convs)
    parents = all_nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = all_nodes.join(parents, "parent_key", "left").join(ends(convs), "key", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def rebuilt_trie(convs: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(rebuilt(common.staged(turn_rows(convs))))
