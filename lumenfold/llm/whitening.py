"""Operator 13, embedding whitening by Chan merging.

Entries are put on a grid of 1/64 first, so that sums are exact. The fit list holds each
distinct grid vector once. Every Arrow batch gives its count, local mean and centred scatter;
states are merged by Chan's pairwise formula, within a partition as they come and between
partitions in a treeReduce. The driver gets one state (d by d numbers) and does the
eigendecomposition. A second pass over the fit list merges the covariance of the whitened
vectors the same way and holds it against the identity.

Rules. A row whose vector is null, or holds a null or non-finite entry or one too large for
the grid (beyond 2^55), is dropped. Vectors of different lengths are fitted apart, each length with
its own components. A direction in which the fit list doesn't spread (eigenvalue below 1e-12
of the largest) has no component, so equal vectors, or a single one, give no rows. Empty
vectors give none. Repeated rows and null vec_ids give their rows each. Other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize

GRID, SHIFT = 64, 1_000_000
#: Entries beyond this have no place on the grid as a long.
LARGEST = 2.0**55
#: Least eigenvalue of a component, as a share of the largest.
FLAT = 1e-12
#: States that one step of the treeReduce merges, about.
FAN_IN = 32

WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass
class State:
    """Count, mean and centred scatter of some vectors, with their exact sums."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]


def state_of(rows: np.ndarray, sums: list[int]) -> State:
    mean = rows.mean(axis=0)
    away = rows - mean
    off = away.mean(axis=0)  # what rounding left of the mean
    return State(len(rows), mean + off, away.T @ away - len(rows) * np.outer(off, off), sums)


def merge(a: State, b: State) -> State:
    """Chan's formula: both scatters and that of the two means."""
    n = a.n + b.n
    apart = b.mean - a.mean
    mean = a.mean + apart * (b.n / n)
    scatter = a.scatter + b.scatter + np.outer(apart, apart) * (a.n / n * b.n)
    return State(n, mean, scatter, [x + y for x, y in zip(a.sums, b.sums)])


def merge_all(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    """States by length of the vectors."""
    return {d: merge(a[d], b[d]) if d in a and d in b else a.get(d) or b[d] for d in {*a, *b}}


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values as doubles, starts, lengths) of a list column; length -1: no vector for this operator."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    values = column.values.cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=True)
    # null, NaN and infinite entries, and those that have no place on the grid
    bad = ~(np.abs(flat) <= LARGEST)
    before = np.concatenate([[0], np.cumsum(bad)])
    length = np.diff(ends).astype(np.int64)
    length[(before[ends[1:]] > before[ends[:-1]]) | ~np.asarray(column.is_valid())] = -1
    return flat, ends[:-1].astype(np.int64), length


def _gridded(batches):
    """vec_id, vector -> vec_id, d, x (longs less SHIFT, packed); rows that are dropped are left out."""
    for batch in batches:
        flat, start, length = _vectors(batch.column(1))
        grid = np.floor(GRID * np.where(np.abs(flat) <= LARGEST, flat, 0)).astype("<i8")
        keep = np.flatnonzero(length >= 0)
        x = [grid[start[k] : start[k] + length[k]].tobytes() for k in keep]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(length[keep], pa.int32()), pa.array(x, pa.binary())], names=["vec_id", "d", "x"])


def _by_length(batch: pa.RecordBatch):
    """(d, places, grid vectors) of a batch with columns d and x, for each length in it."""
    d = batch.column("d").to_numpy()
    for size in np.unique(d[d > 0]).tolist():
        at = np.flatnonzero(d == size)
        rows = batch.column("x").take(pa.array(at)).to_pylist()
        yield size, at, np.frombuffer(b"".join(rows), "<i8").reshape(-1, size)


def _summed(x: np.ndarray) -> list[int]:
    """Exact sums by dimension; the two halves of the longs can't overflow."""
    return [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]


def _packed(found: dict[int, State]) -> pa.RecordBatch:
    rows = [(d, s.n, s.mean.tobytes(), s.scatter.tobytes(), [str(v) for v in s.sums]) for d, s in sorted(found.items())]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["d", "n", "mean", "scatter", "sums"])


PACKED = "d int, n bigint, mean binary, scatter binary, sums array<string>"


def _unpacked(row) -> dict[int, State]:
    d = row.d
    return {d: State(row.n, np.frombuffer(row.mean), np.frombuffer(row.scatter).reshape(-1, math.isqrt(len(row.scatter) // 8)), [int(v) for v in row.sums])}


def _states(turn):
    """One state a partition and length; turn(d, x) gives the vectors to be measured."""

    def run(batches):
        found: dict[int, State] = {}
        for batch in batches:
            for d, _, x in _by_length(batch):
                rows = turn(d, x)
                if rows is not None:
                    found = merge_all(found, {d: state_of(rows, _summed(x))})
        if found:
            yield _packed(found)

    return run


def reduce_states(fit: DataFrame, turn) -> dict[int, State]:
    """The state of all rows of fit(d, x), by length: partitions are merged pairwise in a tree."""
    states = fit.mapInArrow(_states(turn), PACKED).rdd
    parts = max(1, states.getNumPartitions())
    depth = max(2, math.ceil(math.log(parts, FAN_IN))) if parts > 1 else 2
    return states.map(_unpacked).treeAggregate({}, merge_all, merge_all, depth)


@dataclass
class Model:
    """What whitens vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 with x as it is (SHIFT cancels out); null where it is no long."""
        reach = max([0, *(abs(v) for v in self.sums)], default=0) + self.n * int(np.abs(x).max(initial=0))
        if reach * reach * x.shape[1] < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def decompose(state: State, components: int) -> Model:
    values, vectors = np.linalg.eigh(state.scatter / state.n)
    values, vectors = values[::-1], vectors[:, ::-1]
    total = float(np.trace(state.scatter / state.n))
    keep = min(components, int(((values > FLAT * max(values[0], 0.0)) & (values > 0)).sum()))
    exact = np.array([s / state.n for s in state.sums])
    return Model(state.n, state.sums, exact, np.ascontiguousarray(vectors[:, :keep]), values[:keep].copy(), values[:keep] / total if total > 0 else values[:keep])


def fit(x: DataFrame, components: int = 16) -> dict[int, Model]:
    """x(d, x) of distinct grid vectors, read twice -> the models by length."""
    found = reduce_states(x, lambda d, v: v.astype(np.float64))
    models = {d: m for d, s in found.items() if (m := decompose(s, components)).values.size}
    again = reduce_states(x, lambda d, v: models[d].whiten(v) if d in models else None)
    for d, m in models.items():
        m.identity_error = float(np.abs(again[d].scatter / again[d].n - np.eye(len(m.values))).max())
    return models


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vectors(vec_id, embedding array) -> WHITENED: a row for each vector and component.

    n is the size of the fit list, deviation the exact sum of (n * x - S)^2 over dimensions
    (null if it is no long), whitened the projection over the root of the eigenvalue,
    explained its share of the trace, identity_error the largest entry by which the
    covariance of the whitened fit list differs from the identity. See the module's rules.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).mapInArrow(_gridded, "vec_id bigint, d int, x binary")
    rows = materialize(rows, "grid")
    models = fit(materialize(rows.select("d", "x").distinct(), "fit"), components)
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for d, at, x in _by_length(batch):
                m = shared.value.get(d)
                if m is None:
                    continue
                k, ids = len(m.values), batch.column("vec_id").take(pa.array(at))
                repeat = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, m.n, np.int64)),
                        pa.array(m.deviation(x), pa.int64()).take(repeat), pa.array(m.whiten(x).ravel()), pa.array(np.tile(m.explained, len(at))), pa.array(np.full(len(at) * k, m.identity_error)),
                    ],
                    names=[c.split()[0] for c in WHITENED.split(", ")],
                )

    return rows.mapInArrow(run, WHITENED)
