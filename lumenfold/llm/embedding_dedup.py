"""Operator 12, embedding near-duplicates by a subspace pigeonhole join.

Two unit vectors with cosine c are at squared distance 2 - 2c. Unit vectors are turned by a
fixed random rotation and split into blocks of at most BLOCK dimensions; a pair within the
whole squared distance is, in one block at least, within that block's share of it (its
dimensions by all dimensions). So every link is a candidate in some block.

Each block is range-joined by itself. Vectors are sorted along the block's first coordinate
and cut into tiles of at most TILE rows; two tiles meet where their intervals of that
coordinate are within reach. A task holds one pair of tiles, finds the candidates of the block
by its squared distances and verifies them at once by the cosine of the vectors as they are,
in double precision. A pair counts in the first block in which it is within the share, so the
union of all blocks has it once.

No pair leaves a task: it gives, for each vector, the number of its links and one edge to the
least vector of its component there. A tile is bounded, so a group that holds a third of all
vectors is many pairs of tiles; equal vectors are one vector with a weight. Distributed
union-find joins the edges.

Work. Where vectors spread evenly in all directions the first coordinate keeps few tiles
apart, and the pairs of tiles grow with the square of the vectors, as in any exact join of
this radius; structure in the data is what the intervals prune by.

Rules. Vectors that are null, zero, or hold null or non-finite components link with nothing;
so do vectors of different lengths. Rows with one vec_id are vectors each. component_id is the
least vec_id of the component, a null one only if it has no other. Empty in, empty out. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import connected_components, discard, few, materialize
from lumenfold.llm.runs import runs

BLOCK = 16
#: Rows of a tile at most, and numbers in it; longer vectors make shorter tiles, of 512 rows at least.
TILE, ENTRIES = 32_768, 1 << 21
#: Rows of one packed part of a tile.
PART = 512
#: Rows of each side that are compared at once.
STEP = 1024
#: Turned coordinates are rounded to multiples of this, so that all tasks have the same numbers.
GRAIN = 2.0**-20
#: Slack on squared distances of such coordinates: for candidates, in single precision, and for
#: the test in which block a pair counts.
LOOSE, SLACK = 6e-5, 2e-5

NAMED = "vec_id bigint, name binary, d int, raw binary"
COORDINATES = "cid bigint, weight bigint, d int, block int, first float, raw binary"
PARTS = "d int, block int, part int, seq int, lo float, hi float, n bigint, cid binary, weight binary, raw binary"
LINKS = "cid bigint, links bigint, least bigint"


@lru_cache(maxsize=8)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    return np.linalg.qr(np.random.default_rng(20240311 + d).standard_normal((d, d)))[0]


def blocks(d: int) -> list[tuple[int, int]]:
    """(start, end) of the blocks of d dimensions, as even as can be."""
    m = -(-d // BLOCK)
    cuts = [d * k // m for k in range(m + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _named(batches):
    """vec_id, vector of doubles -> NAMED; name and raw are null where a vector can't link."""
    for batch in batches:
        column = batch.column(1)
        ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype("<f8")
        valid, names, raws, ds = np.asarray(column.is_valid()), [], [], []
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            v = values[a:b] + 0.0  # one zero for both
            usable = valid[k] and np.isfinite(v).all() and v.any()
            raws.append(v.tobytes() if usable else None)
            names.append(xxhash.xxh128_digest(raws[-1]) if usable else None)
            ds.append(b - a if usable else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(ds, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "name", "d", "raw"])


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors with a greatest component of 1, so that no square overflows or vanishes."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def turned(x: np.ndarray) -> np.ndarray:
    """Unit vectors of x, turned; exact in single precision."""
    x = scaled(x)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return (np.rint(x @ rotation(x.shape[1]) / GRAIN) * GRAIN).astype("<f4")


def _turner(small: bool):
    """cid, weight, d, raw -> COORDINATES, a row for each block. small: raw as single precision, which holds it exactly."""

    def run(batches):
        for batch in batches:
            d = batch.column("d").to_numpy()
            for size in np.unique(d).tolist():
                at = np.flatnonzero(d == size)
                part = batch.take(pa.array(at))
                x = np.frombuffer(b"".join(part.column("raw").to_pylist()), "<f8").reshape(-1, size)
                place = turned(x)
                raw = pa.array([r.tobytes() for r in (x.astype("<f4") if small else x)], pa.binary())
                for b, (start, _) in enumerate(blocks(size)):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("cid"), part.column("weight"), part.column("d"), pa.array(np.full(len(at), b, np.int32)), pa.array(place[:, start]), raw],
                        names=["cid", "weight", "d", "block", "first", "raw"],
                    )

    return run


def _packer(batches):
    """COORDINATES sorted by d, block, first -> PARTS of at most PART rows."""
    part, seq = TaskContext.get().partitionId(), 0
    for run in runs(batches, ["d", "block"], PART):
        first = run.column("first").to_numpy()
        join = lambda c: b"".join(run.column(c).to_pylist())
        one = [run.column("d")[0].as_py(), run.column("block")[0].as_py(), part, seq, first[0], first[-1], len(first)]
        one += [run.column("cid").to_numpy().astype("<i8").tobytes(), run.column("weight").to_numpy().astype("<i8").tobytes(), join("raw")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float32(), pa.float32(), pa.int64(), *[pa.binary()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds)], names=[c.split()[0] for c in PARTS.split(", ")])
        seq += 1


class _Side:
    """One tile: what its parts hold."""

    def __init__(self, rows: list[dict], d: int, start: int, end: int):
        get = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)
        self.cid, self.weight = get("cid", "<i8"), get("weight", "<i8")
        n, raw = len(self.cid), b"".join(r["raw"] for r in rows)
        x = np.frombuffer(raw, "<f4" if len(raw) == 4 * n * d else "<f8").reshape(n, d).astype(np.float64)
        self.x = scaled(x)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.turned = turned(x)
        self.block = self.turned[:, start:end]
        self.half = 0.5 * (self.block.astype(np.float64) ** 2).sum(axis=1)


def _close(a: _Side, b: _Side, rows: slice, cols: slice, reach: float, same: bool):
    """Candidates (i, j) of two stretches: within the block's share by single precision."""
    one = np.float32(1)
    left = np.column_stack([a.block[rows], (0.5 * (reach + LOOSE) - a.half[rows]).astype(np.float32), np.full(rows.stop - rows.start, one)])
    right = np.column_stack([b.block[cols], np.full(cols.stop - cols.start, one), -b.half[cols].astype(np.float32)])
    score = left @ right.T  # half of (share less squared distance)
    near = np.flatnonzero(score.max(axis=0) >= 0)
    if not len(near):
        return near, near
    i, j = np.nonzero(score[:, near] >= 0)
    i, j = i + rows.start, near[j] + cols.start
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def _joiner(cosine: float):
    """Pairs of tiles -> LINKS."""
    whole = 2 - 2 * cosine

    def linked(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, d: int, block: int) -> np.ndarray:
        keep = np.einsum("ij,ij->i", a.x[i], b.x[j]) / (a.norm[i] * b.norm[j]) >= cosine
        at = np.flatnonzero(keep)
        gap = (a.turned[i[at]].astype(np.float64) - b.turned[j[at]].astype(np.float64)) ** 2
        within = np.column_stack([gap[:, s:e].sum(axis=1) <= whole * (e - s) / d + SLACK for s, e in blocks(d)])
        keep[at] = within.argmax(axis=1) == block
        return keep

    def run(batches):
        for group in runs(batches, ["d", "block", "i", "j"]):
            d, block, i_, j_ = (group.column(c)[0].as_py() for c in ("d", "block", "i", "j"))
            start, end = blocks(d)[block]
            side = np.array(group.column("side"))
            rows = group.select(["cid", "weight", "raw"]).to_pylist()
            a = _Side([r for r, s in zip(rows, side) if s == 0], d, start, end)
            b = a if i_ == j_ else _Side([r for r, s in zip(rows, side) if s == 1], d, start, end)
            del rows
            reach = whole * (end - start) / d
            links = [np.zeros(len(a.cid), np.int64), np.zeros(len(b.cid), np.int64)]
            links[1] = links[0] if a is b else links[1]
            at = _Forest(len(a.cid) if a is b else len(a.cid) + len(b.cid))
            other = 0 if a is b else len(a.cid)
            for r in range(0, len(a.cid), STEP):
                rows_ = slice(r, min(r + STEP, len(a.cid)))
                for c in range(r if a is b else 0, len(b.cid), STEP):
                    cols = slice(c, min(c + STEP, len(b.cid)))
                    i, j = _close(a, b, rows_, cols, reach, a is b)
                    for k in range(0, len(i), 1 << 16):
                        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                        keep = linked(a, b, p, q, d, block)
                        p, q = p[keep], q[keep]
                        np.add.at(links[0], p, b.weight[q])
                        np.add.at(links[1], q, a.weight[p])
                        at.join(p, q + other)
            cid = a.cid if a is b else np.concatenate([a.cid, b.cid])
            count = links[0] if a is b else np.concatenate(links)
            on = np.flatnonzero(count)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(cid[on]), pa.array(count[on]), pa.array(at.least(cid)[on])], names=["cid", "links", "least"])

    return run


class _Forest:
    """Union-find over the rows of one task; joins come as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        while len(p):
            a, b = self._find(p), self._find(q)
            open_ = a != b
            p, q, a, b = p[open_], q[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def _find(self, x: np.ndarray) -> np.ndarray:
        x = self.root[x]
        while (self.root[x] != x).any():
            self.root = self.root[self.root]
            x = self.root[x]
        return x

    def least(self, names: np.ndarray) -> np.ndarray:
        """The least name in each row's component."""
        top = self._find(np.arange(len(self.root)))
        best = np.full(len(self.root), np.iinfo(np.int64).max)
        np.minimum.at(best, top, names)
        return best[top]


def tiles_of(parts: DataFrame) -> DataFrame:
    """PARTS -> d, block, part, seq, tile: parts in order, cut where a tile is full."""
    rows = F.least(F.lit(TILE), F.greatest(F.lit(512), F.floor(F.lit(ENTRIES) / F.col("d"))))
    order = Window.partitionBy("d", "block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    return parts.select("d", "block", "part", "seq", "lo", "hi", F.floor(before / rows).cast("bigint").alias("tile"))


def tile_pairs(tiles: DataFrame, cosine: float) -> DataFrame:
    """(d, block, i, j), i <= j: tiles whose intervals are within reach of each other.

    The last partner of a tile is the last one that starts before its end plus the reach:
    starts and ends go through one ordered window, a row a tile each."""
    spans = tiles.groupBy("d", "block", "tile").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    count = F.ceil(F.col("d") / BLOCK)
    dims = F.floor(F.col("d") * (F.col("block") + 1) / count) - F.floor(F.col("d") * F.col("block") / count)
    reach = F.sqrt(F.lit(2 - 2 * cosine) * dims / F.col("d") + SLACK)
    starts = spans.select("d", "block", F.col("lo").cast("double").alias("at"), F.lit(0).alias("kind"), "tile")
    ends = spans.select("d", "block", (F.col("hi") + reach).alias("at"), F.lit(1).alias("kind"), "tile")
    upto = Window.partitionBy("d", "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = starts.union(ends).withColumn("last", F.max(F.when(F.col("kind") == 0, F.col("tile"))).over(upto)).where("kind = 1")
    return met.select("d", "block", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.greatest("tile", "last"))).alias("j"))


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vectors(vec_id, embedding array) -> vec_id, n_links, component_id, a row per row.

    n_links counts other rows with a vector of at least that cosine, equal vectors included."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    spark = vectors.sparkSession
    parts_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    named = materialize(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_named, NAMED), "named")
    classes = named.where("name is not null").groupBy("name").agg(F.count("*").alias("weight"), F.first("d").alias("d"), F.first("raw").alias("raw"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    placed = classes.select("cid", "weight", "d", "raw").mapInArrow(_turner(small), COORDINATES)
    dealt = placed.repartitionByRange(parts_, "d", "block", "first", "cid").sortWithinPartitions("d", "block", "first", "cid")
    parts = materialize(dealt.mapInArrow(_packer, PARTS), "parts")
    tiles = materialize(tiles_of(parts), "tiles")
    pairs = materialize(tile_pairs(tiles, cosine), "tile_pairs")
    left = pairs.select("d", "block", "i", "j", F.col("i").alias("tile"), F.lit(0).alias("side"))
    right = pairs.where("i <> j").select("d", "block", "i", "j", F.col("j").alias("tile"), F.lit(1).alias("side"))
    meets = tiles.select("d", "block", "part", "seq", "tile").join(left.union(right), ["d", "block", "tile"]).drop("tile")
    work = parts.select("d", "block", "part", "seq", "cid", "weight", "raw").join(few(meets), ["d", "block", "part", "seq"])
    work = work.select("d", "block", "i", "j", "side", "cid", "weight", "raw").repartition(max(1, pairs.count()), "d", "block", "i", "j").sortWithinPartitions("d", "block", "i", "j", "side")
    links = materialize(work.mapInArrow(_joiner(cosine), LINKS), "links")

    comps = materialize(connected_components(links.select(F.col("cid").alias("a"), F.col("least").alias("b"))), "comps")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    of = classes.select("name", "cid", "weight").join(counts, "cid", "left").join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left")
    of = materialize(of.select("name", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("comp", "cid").alias("comp")), "of")
    rows = materialize(named.select("vec_id", "name").join(few(of), "name", "left"), "rows")
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("least"))
    out = rows.join(few(least), "comp", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("comp").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    for used in (named, classes, parts, tiles, pairs, links, comps, of):
        discard(used)
    return out
