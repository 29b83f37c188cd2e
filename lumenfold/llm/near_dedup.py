"""Operator 8, near duplicates by an LSH forest.

A document's signature is 96 minimum hashes of its word shingles. Each tree sorts all
signatures by its own rotation of the 96 values: rows are range-partitioned and sorted, and
every signature is held against its neighbours in that order. Neighbours whose longest
common prefix reaches `base` values are candidates, and a run of them is a region. base and
the number of trees follow from the threshold (see shape()): at 0.8 they are 4 and 24, and
two documents of similarity 0.8 miss each other in all trees with odds of 3 in a million.
Links are confirmed on the full shingle sets.

No pair is written out. A region of at most REGION documents and REGION * UNIT shingles is
one task's work and gives a star of links per component found in it.

1. In the first FIRST trees every region is solved whole. Where a run is larger, the depth
   grows there until the runs of that depth fit (adaptive depth per region).
2. Links give components (distributed union-find). Only regions of all trees that still
   hold several components go on. Members whose signatures can't reach the threshold
   with a member of another component are put aside; the others are compared on full
   sets, each pair in the first tree that brings it together. What exceeds REGION goes
   block by block: those outside the region's largest component against all whose sets are
   of a like size.

A run of the first trees counts as solved in step 1 only if none of its rows went deeper and
it fits as a whole, whatever tasks it lay in; any other run is compared at base again in
step 2. So a greater depth, or a cut between tasks, loses no link.

Shingle sets are told apart by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, few, join_components, materialize, tidy

VALUES = 96
#: Values of a tree's rotation that are sorted by, the greatest depth.
DEPTH = 16
FIRST = 2
REGION = 1024
#: Shingles that count as one document more towards REGION: a task compares 4 million at most.
UNIT = 4096
#: Rows of one run that a task holds while it looks for its depth; a longer run is cut.
HELD = 65_536
#: Odds, as a share, of missing a pair at the threshold, in all trees; in the sifter.
MISS = 1e-5

_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 2**32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, VALUES, dtype=np.uint64).astype(np.uint32)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

FOREST = "key bigint, region bigint, g bigint, n bigint, t int"
SIGNED = "doc_id bigint, row_hash bigint, n_shingles bigint, name binary, sig binary"


def shape(percent: int) -> tuple[int, int, int]:
    """(base, trees, agree) for a threshold: the longest common prefix whose trees miss a
    pair at the threshold with odds below MISS; the values on which signatures of such a pair
    agree at least, six standard deviations below their mean (odds of fewer: 1 in 10^9)."""
    p = percent / 100
    base = max((b for b in range(1, 9) if (1 - p**b) ** (VALUES // b) <= MISS), default=1)
    return base, VALUES // base, max(base, int(VALUES * p - 6 * (VALUES * p * (1 - p)) ** 0.5))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


def shingle_hashes(text: bytes | None, width: int, known: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words are runs of bytes other than space and 9-13, A-Z lower-cased; fewer words
    than width are one shingle, none is the empty set.
    """
    words = text.lower().split() if text else []
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=7)] if words else [], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    s = h[:n] * _PLACE[0]
    for i in range(1, width):
        s += h[i : i + n] * _PLACE[i]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def _sign_all(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES minimum hashes of each (non-empty) set, a row each."""
    flat = np.concatenate(sets)
    low = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out, work = np.empty((VALUES, len(sets)), np.uint32), np.empty_like(low)
    for i in range(VALUES):
        np.multiply(low, _MUL[i], out=work)
        np.add(work, _ADD[i], out=work)
        out[i] = np.minimum.reduceat(work, starts)
    return np.ascontiguousarray(out.T)


def _signer(width: int):
    def run(batches):
        known = _WordHashes()
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            n, names, sigs, wait, at = [], [], [None] * len(batch), [], []

            def flush():
                for k, row in zip(at, _sign_all(wait) if wait else []):
                    sigs[k] = row.tobytes()
                wait.clear()
                at.clear()

            size = 0
            for k in range(len(batch)):
                s = shingle_hashes(texts[k].as_py(), width, known)
                n.append(len(s))
                names.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    wait.append(s)
                    at.append(k)
                    size += len(s)
                if size > 30_000:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "row_hash", "n_shingles", "name", "sig"])

    return run


def _setter(width: int):
    def run(batches):
        known = _WordHashes()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sets = [shingle_hashes(texts[k].as_py(), width, known).tobytes() for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["g", "shingles"])

    return run


def _groups(batches, key: str) -> Iterator[dict[str, list]]:
    """Runs of equal keys of sorted batches, as columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and keys[a] != last:
                yield pa.Table.from_batches(held).to_pydict()
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).to_pydict()


def _similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, as a symmetric table."""
    k = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(k), size)
    shared = count[col] > 1
    number = np.cumsum(count > 1) - 1
    col, row = number[col[shared]], row[shared]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((k, k), np.float32)
    wide = max(1, min(int(col[-1]) + 1, (8 << 20) // (4 * k))) if len(col) else 1
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        a, b = np.searchsorted(col, [lo, lo + wide])
        here = np.zeros((k, wide), np.float32)
        here[row[a:b], col[a:b] - lo] = 1
        both += here @ here.T  # counts, exact in float32 below 2^24
    both = both.astype(np.int64)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def _settle(linked: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(names: list[int], linked: np.ndarray) -> set[tuple[int, int]]:
    label = _settle(linked)
    return {(names[i], names[j]) for i, j in enumerate(label) if names[i] != names[j]}


def _solver(percent: int):
    """Regions with full sets -> links; name is what a link joins, side the block a row came with."""

    def run(batches):
        for group in _groups(batches, "region"):
            seen, rows = set(), []
            for i, g in enumerate(group["g"]):
                if g not in seen:
                    seen.add(g)
                    rows.append(i)
            names, sides = [group["name"][i] for i in rows], np.array([group["side"][i] for i in rows])
            if len(set(names)) < 2:
                continue
            linked = _similar([np.frombuffer(group["shingles"][i], np.uint64) for i in rows], percent)
            if (sides >= 0).all() and len(set(sides.tolist())) > 1:
                linked &= sides[:, None] != sides[None, :]
            label = np.array(names)
            linked |= label[:, None] == label[None, :]
            if stars := sorted(_stars(names, linked)):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([y for _, y in stars], pa.int64())], names=["a", "b"])

    return run


def _sifter(percent: int):
    """Regions with signatures -> the members that may link to another component there."""
    base, trees, agree = shape(percent)

    def run(batches):
        for group in _groups(batches, "region"):
            sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, VALUES)
            size, name, side, tree = np.array(group["n"]), np.array(group["name"]), np.array(group["side"]), group["t"][0]
            blocks = len(set(side.tolist())) > 1
            keep = np.zeros(len(sig), bool)
            for i in range(len(sig)):
                may = (name[i] != name[i + 1 :]) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :]))
                if blocks:
                    may &= side[i] != side[i + 1 :]
                j = i + 1 + np.flatnonzero(may)
                if len(j):
                    same = sig[i] == sig[j]
                    first = same[:, : base * trees].reshape(len(j), trees, base).all(axis=2).argmax(axis=1)
                    j = j[(same.sum(axis=1) >= agree) & (first == tree)]
                    keep[j] = True
                    keep[i] |= len(j) > 0
            if keep.any():
                at = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array([group["region"][0]] * len(at), pa.int64()), pa.array([group["g"][k] for k in at], pa.int64()), pa.array(name[at], pa.int64()), pa.array(side[at], pa.int32())], names=["region", "g", "name", "side"])

    return run


def _neighbours(base: int):
    """Sorted (t, prefix, g, n) -> FOREST: those with a neighbour that shares base values.

    key names the run at base, region that at the depth where the run fits: the key itself
    where that is base, else a name that no other task gives. A run that tasks share, or that
    is cut, is known by its key; its depths may differ, which step 2 makes good.
    """

    def regions(held: list[pa.RecordBatch], part: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        t, g, n = (table.column(c).to_numpy() for c in ("t", "g", "n"))
        rows = np.frombuffer(b"".join(table.column("prefix").to_pylist()), np.uint32).reshape(-1, DEPTH)
        same = (rows[1:] == rows[:-1]) & (t[1:] == t[:-1])[:, None]
        prefix = np.concatenate([[0], np.where(same.all(axis=1), DEPTH, same.argmin(axis=1)), [0]])
        # the first and the last row may have their neighbour in another task
        keep = np.maximum(prefix[:-1], prefix[1:]) >= base
        keep[[0, -1]] = True
        depth = np.zeros(len(rows), np.int64)
        for d in range(base, DEPTH + 1):
            run = np.cumsum(prefix[:-1] < d) - 1
            fits = (np.bincount(run) <= REGION) & (np.bincount(run, n) <= REGION * UNIT)
            depth[(depth == 0) & fits[run]] = d
        chunk = np.zeros(len(rows), np.int64)  # equal to the greatest depth: chunks of a bounded size
        full = depth == 0
        chunk[full] = 1 + np.cumsum(np.maximum(1, n[full] // UNIT)) // REGION
        depth[full] = DEPTH
        at = np.flatnonzero(keep)
        keys = [xxhash.xxh64_intdigest(rows[k, :base].tobytes(), seed=int(t[k])) - 2**63 for k in at]
        inner = [key if depth[k] == base else xxhash.xxh64_intdigest(b"%d/%d/%d/%d/" % (t[k], depth[k], chunk[k], part) + rows[k, : depth[k]].tobytes()) - 2**63 for k, key in zip(at, keys)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(inner, pa.int64()), pa.array(g[at], pa.int64()), pa.array(n[at], pa.int64()), pa.array(t[at], pa.int32())], names=["key", "region", "g", "n", "t"])

    def run(batches):
        held, size = [], 0
        parts = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            if not len(batch):
                continue
            # up to the last place where a run of base values ends, the rows are complete
            t, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut = next((k for k in range(len(t) - 1, 0, -1) if t[k] != t[k - 1] or values[k][: 4 * base] != values[k - 1][: 4 * base]), 0)
            if cut == 0 and size > HELD:
                yield regions(held, next(parts))
                held, size = [], 0
            if cut:
                yield regions([*held, batch.slice(0, cut)], next(parts))
                held, size = [], 0
            held.append(batch.slice(cut))
            size += len(batch) - cut
        if held:
            yield regions(held, next(parts))

    return run


def forest(reps: DataFrame, percent: int) -> DataFrame:
    """reps(g, n, sig) -> FOREST, a row for each tree in which a signature has a candidate neighbour."""
    base, trees, _ = shape(percent)
    leaf = F.expr(f"substring(concat(sig, sig), {4 * base} * t + 1, {4 * DEPTH})")
    rows = reps.select("g", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t")).select("t", leaf.alias("prefix"), "g", "n")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "t", "prefix", "g").sortWithinPartitions("t", "prefix", "g").mapInArrow(tidy(_neighbours(base)), FOREST)


def sign(docs: DataFrame, width: int) -> DataFrame:
    """docs(doc_id, row_hash, text) -> with n_shingles, name (128 bits of the shingle set) and signature."""
    return docs.select("doc_id", "row_hash", "text").mapInArrow(tidy(_signer(width)), SIGNED)


def _by_region(rows: DataFrame, run, schema: str) -> DataFrame:
    return rows.repartition("region").sortWithinPartitions("region", "g").mapInArrow(tidy(run), schema)


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, row: Column | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, row_hash, n_shingles, comp, component_id: a row per row.

    row_hash is a hash of doc_id and text, or the BIGINT row; comp names the component even
    where doc_ids repeat; component_id is the least doc_id in it. Documents without words
    (null, empty, white space) have n_shingles 0, comp null and component_id doc_id. Equal
    texts share a component; repeated rows too. Very long texts are read whole. A null doc_id
    is never least unless alone. Other columns of docs are ignored. Empty in, empty out.
    """
    source = docs.select("doc_id", (F.xxhash64("doc_id", "text") if row is None else row).alias("row_hash"), "text")
    signed = materialize(sign(source, width), "signed")
    reps = signed.where("name is not null").dropDuplicates(["name"]).select("name", "doc_id", "row_hash", F.col("n_shingles").alias("n"), "sig")
    reps = materialize(reps.withColumn("g", F.monotonically_increasing_id()), "reps")
    leaves = materialize(forest(reps.select("g", "n", "sig"), percent), "forest")
    crowd = F.greatest(F.count("*"), F.ceil(F.sum("n") / UNIT))
    counts = leaves.groupBy("key").agg(F.count("*").alias("rows"), crowd.alias("k"), F.max(F.col("region") != F.col("key")).alias("cut"))
    counts = counts.where("rows > 1").select("key", "k", ((F.col("k") <= REGION) & ~F.col("cut")).alias("whole"))
    members = materialize(leaves.join(counts, "key"), "members")

    # full sets of the members alone, from their texts
    again = materialize(members.select("g").distinct().join(reps.select("g", "doc_id", "row_hash"), "g"), "again")
    texts = source.join(few(again), (source["row_hash"] == again["row_hash"]) & source["doc_id"].eqNullSafe(again["doc_id"])).select("g", "text")
    sets = materialize(texts.dropDuplicates(["g"]).mapInArrow(tidy(_setter(width)), "g bigint, shingles binary"), "sets")

    # 1: whole regions of the first trees, deeper where crowded
    regions = members.where((F.col("t") < FIRST) & (F.col("whole") | (F.col("region") != F.col("key")))).select("region", "g")
    work = regions.join(sets, "g").select("region", "g", F.col("g").alias("name"), F.lit(-1).alias("side"), "shingles")
    links = materialize(_by_region(work, _solver(percent), "a bigint, b bigint"), "stars")
    found = join_components(None, links)

    # 2: regions that still hold several components
    named = members.join(found.select(F.col("node").alias("g"), F.col("comp").alias("name")), "g", "left").withColumn("name", F.coalesce("name", "g"))
    named = named.where((F.col("t") >= FIRST) | ~F.col("whole"))
    open_keys = named.groupBy("key").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo <> hi").select("key")
    named = materialize(named.join(open_keys, "key"), "open")
    rows = named.where(F.col("k") <= REGION).select(F.col("key").alias("region"), "t", "g", "n", "name", F.lit(-1).alias("side"))
    large = named.where(F.col("k") > REGION)
    if not large.isEmpty():
        rows = rows.union(_blocks(large, percent))
    sifted = _by_region(rows.join(reps.select("g", "sig"), "g"), _sifter(percent), "region bigint, g bigint, name bigint, side int")
    sifted = materialize(sifted, "sifted")
    more = materialize(_by_region(sifted.join(sets, "g"), _solver(percent), "a bigint, b bigint"), "stars")
    of = join_components(found, more)

    own = reps.select("name", "g").join(few(of.select(F.col("node").alias("g"), "comp")), "g", "left")
    own = materialize(own.select("name", F.coalesce("comp", "g").alias("comp")), "own")
    rows = materialize(signed.select("doc_id", "row_hash", "n_shingles", "name").join(few(own), "name", "left").drop("name"), "rows")
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "comp", "left").select("doc_id", "row_hash", "n_shingles", "comp", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    for used in (leaves, members, again, sets, links, found, named, sifted, more, of, own, reps, signed):
        discard(used)
    return out


def _blocks(large: DataFrame, percent: int) -> DataFrame:
    """Crowded regions in blocks of REGION: members outside the largest component meet all
    blocks of their size class and of the next ones, members of it only blocks of the others.

    Two sets of the least similarity differ in size by one class at most."""
    size = large.withColumn("size", F.floor(F.log(F.col("n")) / F.lit(max(math.log(100 / percent) * (1 + 1e-9), 1e-9))).cast("bigint"))
    per = size.groupBy("key", "name").agg(F.count("*").alias("c"))
    main = per.groupBy("key").agg(F.max_by("name", F.struct("c", "name")).alias("main"))
    rows = size.join(main, "key").withColumn("in_main", F.col("name") == F.col("main"))
    crowd = F.greatest(F.count("*"), F.ceil(F.sum("n") / UNIT))
    blocks = rows.groupBy("key", "size", "in_main").agg(F.ceil(crowd / REGION).cast("int").alias("blocks"))
    rows = rows.join(blocks, ["key", "size", "in_main"]).withColumn("side", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    # each row meets the blocks of its own class and of the next, from either side
    near = blocks.select("key", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)).alias("size"), F.col("size").alias("size2"), F.col("in_main").alias("in_main2"), F.col("blocks").alias("blocks2"))
    met = rows.join(near, ["key", "size"]).where("NOT (in_main AND in_main2)").withColumn("side2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    one, two = F.struct("size", "in_main", "side"), F.struct(*[F.col(f"{c}2").alias(c) for c in ("size", "in_main", "side")])
    return met.select(F.xxhash64("key", F.least(one, two), F.greatest(one, two)).alias("region"), "t", "g", "n", "name", F.when(one <= two, 0).otherwise(1).alias("side"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with one row of each component: that of the least
    doc_id (null last; of several rows with it, the least hash of all they hold). Rows
    without words all stay, repeated ones too. Extra columns of any type are carried along.
    Empty in, empty out.

    The rows are numbered once, so that texts are neither shuffled nor compared here.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    tie = F.xxhash64(F.to_json(F.struct(*plain.columns)))
    numbered = materialize(plain.withColumns({"row": F.monotonically_increasing_id(), "tie": tie}), "numbered")
    texts = numbered.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), "row")
    near = near_duplicates(texts, width, percent, F.col("row")).where("comp is not null")
    near = near.select("doc_id", F.col("row_hash").alias("row"), "comp").join(numbered.select("row", "tie"), "row")
    near = materialize(near.select("comp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "row").alias("place")), "places")
    best = near.groupBy("comp").agg(F.min("place").alias("best"), F.count("*").alias("rows")).where("rows > 1").select("comp", "best")
    gone = materialize(near.join(best, "comp").where("place <> best").select("place.row"), "gone")
    kept = numbered.join(few(gone), "row", "left_anti")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
