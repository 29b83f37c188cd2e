"""Helpers that the operators share: shared-folder tables, text folding, components."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.staging import new_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(text, UPPER, LOWER)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so a
    lost executor costs a file read, and values that depend on the order of
    execution (partition numbers, row numbers) are fixed for every later reader."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenfold_path = path
    return out


def tidy(run):
    """run(batches), after which the worker gives freed memory back: it is used again for tasks of later
    stages, and what the allocator keeps of this one would add to theirs."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def few(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df to be broadcast if it has at most so many rows; else as it is, for a shuffle.

    For tables of a few numbers a row that materialize() wrote, so that the count is cheap.
    """
    return F.broadcast(df) if df.count() <= rows else df


def discard(df: DataFrame | None) -> None:
    """Delete what materialize() wrote, once no later plan reads it."""
    path = getattr(df, "_lumenfold_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Union-find over links (a, b), both BIGINT -> one row (node, comp) for each linked node.

    Alternates large-star and small-star rounds: every node points its larger
    neighbours, then its smaller ones, at the least node it knows. Each round is a
    pre-aggregated minimum and an equi-join, written to the shared folder; it ends
    when a round changes nothing. comp is the least node of the component.
    """
    spark = edges.sparkSession
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(pairs, "links")
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        new = materialize(small, "links")
        seen = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = new
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled links form stars: every node points at the least node of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def join_components(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, comp) after links (a, b) more; found is what earlier links gave, or None.

    Only components that a link joins are worked on again.
    """
    if found is None:
        return materialize(connected_components(links), "comps")
    by = found.select("node", "comp")
    ends = links
    for end in ("a", "b"):
        named = by.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
        ends = ends.join(named, end, "left").withColumn(f"comp_{end}", F.coalesce(f"comp_{end}", end))
    joined = materialize(connected_components(ends.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))), "comps")
    moved = by.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = joined.join(by.select("node"), "node", "left_anti").select("node", "comp")
    out = materialize(moved.union(fresh), "comps")
    discard(joined)
    return out
