"""Prefix scans over histories of any length, and folds whose steps can't be composed."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Values = dict[str, Column]


def prefix_scan(rows: DataFrame, keys: list[str], order: list[str], names: list[str], compose: Callable[[Values, Values], Values], block: str | None = None) -> DataFrame:
    """rows with names replaced by the composition of all rows of a key up to this one.

    compose(earlier, later) is associative. Doubling: after round k a row holds the last 2^k
    rows, by lag over one ordered window, so all rounds share a sort. order is unique
    within a key, or ties are composed in no fixed order.

    With block, a column that never falls along a key's order (a day, an hour), keys are split
    there: blocks are scanned by themselves, then their totals, so no task holds a key's
    whole history. A null block is a block, before all others.
    """
    if block is None:
        return _scan(rows, keys, order, names, compose)
    within = _scan(rows, [*keys, block], order, names, compose)
    last = F.row_number().over(Window.partitionBy(*keys, block).orderBy(*[F.col(o).desc() for o in order]))
    totals = within.withColumn("_last", last).where("_last = 1").select(*keys, block, *names)
    before = _scan(totals, keys, [block], names, compose)
    shift = Window.partitionBy(*keys).orderBy(block)
    before = before.select(*[F.col(k).alias(f"_{k}") for k in [*keys, block]], *[F.lag(n).over(shift).alias(f"_{n}") for n in names], F.lag(F.lit(True)).over(shift).alias("_has"))
    on = [within[k].eqNullSafe(before[f"_{k}"]) for k in [*keys, block]]
    out = within.join(before, _all(on))
    both = compose({n: F.col(f"_{n}") for n in names}, {n: F.col(n) for n in names})
    out = out.withColumns({f"_to_{n}": F.when(F.col("_has"), both[n]).otherwise(F.col(n)) for n in names})
    return out.select(*[F.col(f"_to_{c}").alias(c) if c in names else F.col(c) for c in rows.columns])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _scan(rows: DataFrame, keys: list[str], order: list[str], names: list[str], compose) -> DataFrame:
    longest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    w = Window.partitionBy(*keys).orderBy(*order)
    for k in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        earlier = rows.withColumns({f"_{n}": F.lag(n, 2**k).over(w) for n in names} | {"_has": F.lag(F.lit(True), 2**k).over(w)})
        both = compose({n: F.col(f"_{n}") for n in names}, {n: F.col(n) for n in names})
        earlier = earlier.withColumns({f"_to_{n}": F.when(F.col("_has"), both[n]).otherwise(F.col(n)) for n in names})
        rows = earlier.select(*[F.col(f"_to_{c}").alias(c) if c in names else F.col(c) for c in rows.columns])
    return rows


def clamped_shift(prefix: str, low: float = 0.0, high: float = 100.0):
    """O-63..O-65 as functions: x -> min(hi, max(lo, x + d)) in columns <prefix>_d, _lo, _hi.

    Such functions are closed under composition. Returns (names, compose, start, apply): start(d)
    gives the columns of one segment, apply(x) the value after the prefix."""
    d, lo, hi = (f"{prefix}_{c}" for c in ("d", "lo", "hi"))

    def clamp(x: Column, by: Values) -> Column:
        return F.least(by[hi], F.greatest(by[lo], x + by[d]))

    def compose(a: Values, b: Values) -> Values:
        return {d: a[d] + b[d], lo: clamp(a[lo], b), hi: clamp(a[hi], b)}

    def start(shift: Column) -> Values:
        return {d: shift, lo: F.lit(low), hi: F.lit(high)}

    return [d, lo, hi], compose, start, lambda x: clamp(x, {n: F.col(n) for n in (d, lo, hi)})


def fold(rows: DataFrame, keys: list[str], order: list[str], begin: Callable[[], object], step: Callable[[object, tuple], list[tuple]], schema: str) -> DataFrame:
    """step(state, row) for each row of a key in order, state from begin() -> the rows it gives.

    For rules whose steps can't be composed. A key's rows stream through one task; only the
    state is held. keys are not null."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != last:
                    last, state = key, begin()
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
