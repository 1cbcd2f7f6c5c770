"""Near-duplicate documents by SuperMinHash (op1).

1. Each text becomes its set of distinct ``WIDTH``-word shingles and a SuperMinHash signature:
   every shingle walks its own random permutation of the slots, at step j offering j plus a random
   fraction to the slot it reaches. A slot keeps the least offer, and once no slot of a text is
   above j, later steps can't win and are skipped. Most texts need two steps.
2. Every row gets a number in a staged table, and all steps go by that number. Texts with equal
   sets form a class; only the class's least number goes on.
3. ``BANDS`` bands of ``ROWS`` slots give buckets. In each of ``STAR_ROUNDS`` rounds every document is
   paired with ``HUBS`` hubs: for each, the documents have an order by hash, each bucket's first is
   its hub, and of its buckets' hubs that are of another component a document takes the one that it
   shares most buckets with, hence the most similar, if these are ``LEAST_SHARED`` or more (pairs at
   similarity 0.75 share 10 on average). So a round has at most that many pairs a document, however
   many buckets a group of copies shares.
   Pairs whose signatures agree in a share of slots of ``LEAST_AGREEMENT`` or more are confirmed on
   the full sets (100 * intersection >= 75 * union), and links merge components.
4. What is left in a bucket in different components is then paired exhaustively, again
   confirmed, and merged. So a bucket's pairs are all settled (linked, in one
   component anyway, or refuted), while a group of copies costs a star and not all its pairs.
   Most pairs are refuted by an exact bound: two texts of different components can't have
   more shingles in common than either has in common with other components at all.
   The buckets with the same document of least hash, their hub, are compared as one group,
   in blocks: by this bound, a finer signature and then the full sets, in the same task. Only
   links that connect two components become rows, at most one fewer than a task's components.

With 32 bands of 4 slots a pair of similarity 0.75 shares a bucket with probability 0.999995,
and a pair at 0.75 falls under the agreement filter with probability below 1e-4.

Words are runs of anything but space and ASCII line and tab controls, A-Z lower-cased. Texts
of fewer than ``WIDTH`` words have one shingle, the whole; null, empty and wordless texts none,
and link with nothing. Rows with equal ids are each judged by their own text. A component is
named by its least id. Rows without an id are judged like all others; their component is null if no
row of it has an id, and one of its rows is then kept. Other columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, components, tokens

WIDTH = 5
SLOTS, BANDS, ROWS = 128, 32, 4
PERCENT = 75
LEAST_AGREEMENT = 0.6
#: Slots of the finer signature that settles most exhaustive pairs, and their least agreement.
FINE_SLOTS, FINE_AGREEMENT = 512, 0.675
#: Rounds, and hubs that a document is paired with in each.
STAR_ROUNDS, HUBS = 2, 8
#: Buckets that a document must share with its hub; fewer leave the pair to the exhaustive stage.
LEAST_SHARED = 4
#: Size of the filter that keeps texts, signatures and keys nobody asked for out of a join.
FILTER_BYTES = 1 << 20
#: Members of a group of buckets that one task compares with as many others, and their shingles.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Shingles that walk their permutations together.
CHUNK = 1 << 16
_STEP_BITS = 22

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


_GOLDEN_STEPS = np.arange(1, max(SLOTS, FINE_SLOTS) + 1, dtype=np.uint64) * _GOLDEN


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = _scattered(np.arange(1, 1 + WIDTH, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(n, WIDTH)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += w[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(_scattered(total))


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set: step in the upper bits, fraction in the lower; a row per set."""
    sig = np.full(len(sets) * slots, np.uint32(0xFFFFFFFF), np.uint32)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    step = CHUNK * SLOTS // slots
    for lo in range(0, len(every), step):
        _walk(sig, every[lo : lo + step], owner[lo : lo + step], slots)
    return sig.reshape(len(sets), slots)


def _walk(sig: np.ndarray, element: np.ndarray, owner: np.ndarray, slots: int) -> None:
    order = None
    for j in range(slots):
        x = _scattered(element + _GOLDEN_STEPS[j])
        fraction = (x >> np.uint64(64 - _STEP_BITS)).astype(np.uint32)
        k = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot, first = k, k
        else:
            if order is None:  # the permutation so far: 0 and its partner swapped
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), 1))
                at = np.arange(len(element))
                order[at, first] = 0
                order[:, 0] = first
            at = np.arange(len(element))
            slot = order[at, k]
            order[at, k] = order[:, j]
            order[:, j] = slot
        np.minimum.at(sig, owner * slots + slot, np.uint32(j << _STEP_BITS) + fraction)
        rows = np.unique(owner)
        worst = sig.reshape(-1, slots)[rows].max(axis=1)
        if j + 1 == slots:
            return
        open_rows = rows[worst > np.uint32((j + 1) << _STEP_BITS)]
        if not len(open_rows):
            return
        if len(open_rows) < len(rows):
            stay = np.isin(owner, open_rows)
            element, owner = element[stay], owner[stay]
            if order is None:
                first = first[stay]
            else:
                order = order[stay]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit bucket keys."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _GOLDEN
    for r in range(ROWS):
        key = _scattered(key ^ s[:, :, r])
    return key


def _short(sig: np.ndarray) -> list[bytes]:
    """8 bits of each slot; unequal slots agree by chance once in 256, which only lets more pairs through."""
    return [x.tobytes() for x in (_scattered(sig.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)]


def profiles(docs: DataFrame, id_col: str, text_col: str, name_col: str) -> DataFrame:
    """id, name, n_shingles, set_key (hash of the set), sig (8 bits of each slot), keys (buckets)."""
    common.ship(docs.sparkSession)

    def profile(batches):
        for b in tokens.small_batches(batches, 200):
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            sig = signatures(sets)
            keys = band_keys(sig).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array(_short(sig), pa.binary()),
                    pa.array([k.tolist() if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64())),
                ],
                names=["id", "name", "n_shingles", "set_key", "sig", "keys"],
            )

    some = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{name_col}`").alias("name"))
    name = some.schema["name"].dataType.simpleString()
    return some.mapInArrow(profile, f"id long, name {name}, n_shingles long, set_key binary, sig binary, keys array<long>")


def agreeing(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``pairs``, both staged tables, whose signatures agree in enough slots."""
    wanted = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id")))
    # staged: with small pairs, the filter and the comparison would be one stage with two Python processes a task
    sigs = common.staged(only_wanted(profile.select("id", "sig"), wanted))
    both = pairs.join(sigs.toDF("u", "su"), "u").join(sigs.toDF("v", "sv"), "v").select("u", "v", "su", "sv")

    def keep(batches):
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, SLOTS) for k in (2, 3))
            ok = (a == c).sum(axis=1) >= LEAST_AGREEMENT * SLOTS
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["u", "v"])

    out = common.staged(both.mapInArrow(keep, "u long, v long"))
    common.unstage(sigs)
    return out


def _maybe_in(ids: DataFrame) -> np.ndarray:
    """A bit per hash of the documents ``ids``: FILTER_BYTES bytes, however many they are."""
    at = F.pmod(F.xxhash64("id"), F.lit(8 * FILTER_BYTES))
    found = ids.select((at / 8).cast("int").alias("b"), F.pow(F.lit(2), at % 8).cast("int").alias("m")).groupBy("b").agg(F.bit_or("m").alias("m")).toPandas()
    bits = np.zeros(FILTER_BYTES, np.uint8)
    bits[found["b"]] = found["m"]
    return bits


def only_wanted(rows: DataFrame, ids: DataFrame, then=None, schema=None) -> DataFrame:
    """The rows whose id is among ``ids``, and a few others: a filter of fixed size keeps most
    other rows out where they are read, so that none of them is shuffled. ``then`` as in ``_by_filter``."""
    return _by_filter(rows, rows.sparkSession.sparkContext.broadcast(_maybe_in(ids)), True, then, schema)


def _by_filter(rows: DataFrame, bits, inside: bool, then=None, schema=None) -> DataFrame:
    """The rows with an id that are in the broadcast filter ``bits``, or those that are not. ``then``
    makes their batches into those of ``schema`` in the same Python process: a second ``mapInArrow``
    would take a second process a task."""
    hashed = rows.where("id is not null").withColumn("__at", F.pmod(F.xxhash64("id"), F.lit(8 * FILTER_BYTES)))

    def keep(batches):
        for b in batches:
            at = b.column("__at").to_numpy()
            yield b.select(b.schema.names[:-1]).filter(pa.array((bits.value[at // 8] >> (at % 8) & 1).astype(bool) == inside))

    if then is None:
        return hashed.mapInArrow(keep, rows.schema)
    return hashed.mapInArrow(lambda batches: then(keep(batches)), schema)


def wanted_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, then=None, schema=None) -> DataFrame:
    """(id, text) of the documents ``ids`` and a few others, or what ``then`` makes of them."""
    return only_wanted(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), ids, then, schema)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have PERCENT of their union in common."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
    same = int((large[at] == small).sum()) if len(large) else 0
    return same > 0 and 100 * same >= PERCENT * (len(a) + len(b) - same)


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) of sufficiently similar full sets, as a staged table."""
    wanted = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()

    def to_set(batches):
        for b in tokens.small_batches(batches, 200):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    sets = common.staged(wanted_texts(docs, wanted, id_col, text_col, to_set, "id long, shingles binary"))
    both = pairs.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v").select("u", "v", "su", "sv")

    def keep(batches):
        for b in tokens.small_batches(batches, 500):
            ok = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], names=["u", "v"])

    out = common.staged(both.mapInArrow(keep, "u long, v long").distinct())
    common.unstage(sets)
    return out


def _labelled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """members (key, id) with comp, of buckets that hold two components or more."""
    if roots is None:
        labelled = members.withColumn("comp", F.col("id"))
    else:
        labelled = members.join(roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    return _mixed_buckets(labelled)


def _mixed_buckets(labelled: DataFrame) -> DataFrame:
    many = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return labelled.join(many, "key", "left_semi")


def _star_pairs(labelled: DataFrame, turn: int) -> DataFrame:
    """Each document with ``HUBS`` hubs of this turn: of its buckets' hubs that are of another component
    the one that it shares most buckets with."""
    orders = [F.xxhash64("id", F.lit(no)) for no in range(turn * HUBS, (turn + 1) * HUBS)]
    hubs = labelled.groupBy("key").agg(F.array(*[F.min_by(F.struct("id", "comp"), order) for order in orders]).alias("hubs"))
    met = labelled.join(hubs, "key").select("id", "comp", F.posexplode("hubs").alias("no", "hub")).where("comp <> hub.comp")
    often = met.groupBy("id", "no", F.col("hub.id").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SHARED)
    one = often.groupBy("id", "no").agg(F.max_by("h", F.struct("n", F.xxhash64("h", "no"))).alias("hub"))
    return one.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()


def _shared_sets(members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fine, n, shared, shingles) of those documents of ``members`` (id, comp) that can have a link
    to another component: a finer signature, the number of shingles, how many of them a document of
    another component has too, and the shingles."""

    def to_set(batches):
        for b in tokens.small_batches(batches, 100):
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            fine = _short(signatures(sets, FINE_SLOTS))
            shingles = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fine, pa.binary()), shingles, b.column(2)], names=["id", "fine", "shingles", "comp"])

    # the texts meet their components, not the sets: these are several times as long; by a shuffle, so that
    # the filter and the sets are two stages, with one Python process a task each
    texts = wanted_texts(docs, members.select("id"), id_col, text_col).join(members.hint("merge"), "id").select("id", "text", "comp")
    sets = common.staged(texts.mapInArrow(to_set, "id long, fine binary, shingles array<long>, comp long"))
    each = sets.select("id", "comp", F.explode("shingles").alias("x"))
    spread = each.groupBy("x").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("x")
    shared = each.join(spread, "x", "left_semi").groupBy("id").agg(F.count("*").alias("shared"))
    # of two similar texts, each has PERCENT of its shingles in the other
    # (the sets themselves are counted where they are read, and only those of the remaining documents are shuffled)
    counts = sets.select("id", "fine", F.size("shingles").alias("n")).join(shared, "id").where(100 * F.col("shared") >= PERCENT * F.col("n"))
    counts = common.staged(counts.select("id", "fine", "n", "shared"))
    out = common.staged(counts.join(only_wanted(sets.select("id", "shingles"), counts.select("id")), "id"))
    common.unstage(counts)
    common.unstage(sets)
    return out


def _rest_links(labelled: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links between components that settle all pairs of a bucket in different components, as a staged
    table: each link is confirmed on the full sets, and what they don't connect is refuted. Pairs are
    compared and confirmed by blocks and never become rows."""
    sets = _shared_sets(labelled.select("id", "comp").distinct(), docs, id_col, text_col)
    labelled = _mixed_buckets(labelled.join(sets.select("id", "n"), "id"))
    # buckets of one hub are one group: the many buckets that a group of copies shares have few hubs
    hubs = labelled.groupBy("key").agg(F.min_by("id", F.xxhash64("id")).alias("hub"))
    members = common.staged(labelled.join(hubs, "key").select("hub", "id", "comp", "n").distinct())
    blocks = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    sized = members.groupBy("hub").agg(F.ceil(blocks).cast("int").alias("blocks"))
    dealt = members.join(sized, "hub").withColumn("block", F.pmod(F.xxhash64("id", "hub"), F.col("blocks")).cast("int"))
    # a block meets every block of its group: as the one or as the other of a pair of blocks
    tasks = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tasks = tasks.select("hub", "id", "comp", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    rows = tasks.join(sets, "id").groupBy("hub", "b1", "b2")

    def compare(table: pa.Table) -> pa.Table:
        ids, root, block, n, shared = (table.column(c).to_numpy().copy() for c in ("id", "comp", "block", "n", "shared"))
        sig = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, FINE_SLOTS)
        lists = table.column("shingles").combine_chunks()
        every, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(n)
        one = block == table.column("b1")[0].as_py()
        two = block == table.column("b2")[0].as_py()
        us, vs = [], []
        for i in np.flatnonzero(one):
            other = np.flatnonzero(two & (root != root[i]) & ((ids > ids[i]) | ~one))
            # PERCENT of the union is PERCENT / (100 + PERCENT) of the sum of both sizes
            other = other[(100 + PERCENT) * np.minimum(shared[other], shared[i]) >= PERCENT * (n[other] + n[i])]
            other = other[(sig[other] == sig[i]).sum(axis=1) >= FINE_AGREEMENT * FINE_SLOTS]
            own = every[ends[i] - n[i] : ends[i]]
            for j in other:
                if root[j] != root[i] and _similar(own, every[ends[j] - n[j] : ends[j]]):
                    us.append(min(ids[i], ids[j]))
                    vs.append(max(ids[i], ids[j]))
                    root[root == root[j]] = root[i]  # the other pairs of both need no comparison
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    out = common.staged(rows.applyInArrow(compare, "u long, v long").distinct())
    common.unstage(members)
    common.unstage(sets)
    return out


def _representatives(one: DataFrame, whole: DataFrame) -> DataFrame:
    """id, sig and keys of each class's least number. Most rows are alone in their class: only those that
    the filter takes for copies are joined, so the others' signatures and keys are not shuffled."""
    reps = whole.select(F.col("rep").alias("id"))
    some = one.where("n_shingles > 0").select("id", "sig", "keys")
    copies = some.select("id").join(reps, "id", "left_anti")
    bits = one.sparkSession.sparkContext.broadcast(_maybe_in(copies))
    return _by_filter(some, bits, False).unionByName(_by_filter(some, bits, True).join(reps, "id", "left_semi"))


def duplicate_rows(rows: DataFrame, no_col: str, name_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, name, n_shingles and first, one row per row of ``rows``, a staged table whose rows have
    a unique number ``no_col``, given as id. first is the row (no_name, name, id) of the component
    that has the least name, rows without one last; null for texts without shingles."""
    one = common.staged(profiles(rows, no_col, text_col, name_col))
    named = F.struct(F.col("name").isNull().alias("no_name"), "name", "id")
    whole = one.where("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.min(named).alias("first"))
    whole = common.staged(whole)
    reps = common.staged(_representatives(one, whole))
    members = reps.select("id", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = common.staged(members.join(shared, "key", "left_semi"))
    roots = None
    for turn in range(STAR_ROUNDS + 1):
        labelled = common.staged(_labelled(members, roots))
        if turn < STAR_ROUNDS:
            star = common.staged(_star_pairs(labelled, turn))
            pairs = agreeing(star, reps)
            common.unstage(star)
            found = confirmed(pairs, rows, no_col, text_col)
            common.unstage(pairs)
        else:
            found = _rest_links(labelled, rows, no_col, text_col)
        common.unstage(labelled)
        merged = components.stars(found if roots is None else roots.unionByName(found))
        common.unstage(found)
        if roots is not None:
            common.unstage(roots)
        roots = merged
    common.unstage(members)
    common.unstage(reps)
    label = whole.join(roots.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").select("set_key", "first", F.coalesce("root", "rep").alias("root"))
    least = label.groupBy("root").agg(F.min("first").alias("first"))
    label = label.select("set_key", "root").join(least, "root").select(F.col("set_key").alias("key"), "first")
    out = one.join(label, (one["set_key"] == label["key"]) & (one["n_shingles"] > 0), "left")
    return out.select("id", "name", "n_shingles", "first")


def numbered(docs: DataFrame, no_col: str) -> DataFrame:
    """``docs``, staged, with a unique number per row."""
    return common.staged(docs.withColumn(no_col, F.monotonically_increasing_id()))


def duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id and kept, one row per document."""
    some = docs.select(F.col(f"`{id_col}`").cast("long").alias("name"), F.col(f"`{text_col}`").alias("text"))
    rows = numbered(some, "no")
    out = duplicate_rows(rows, "no", "name", "text")
    common.unstage(rows)  # the result comes from the profiles and links
    least = F.coalesce("first.name", "name")
    alone = F.col("first").isNull() | (F.col("first.id") == F.col("id"))
    kept = F.when(F.col("name").isNull(), alone).otherwise(F.col("name") == least)
    return out.select(F.col("name").alias(id_col), "n_shingles", least.alias("component_id"), kept.alias("kept"))
