"""Operator 4, mixing sources to target weights by hash-threshold histograms, in SQL functions only.

Each document gets a fixed hash. Sizes are summed by source and hash bucket, the
bucket in which a source's budget ends is found, only that bucket is summed again over
finer buckets, and so on until one hash value is left; a plain filter on the hash then
takes the documents. Nothing is sorted by document and no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that each pass over the boundary bucket resolves; 48 in all.
LEVELS = (12, 12, 12, 12)
#: More sources than this are joined by key with salted documents, not broadcast.
BROADCAST_SOURCES = 50_000


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sources(source, source_size) -> with target: weights repeat along the sources by
    code point, null last; share of all sizes is dealt by weight, no target above cap
    times its source, the excess dealt again by weight. A few rows per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # the sources that fill up are those with the least most/weight; the level at which
    # the others stand is what is left over their weights
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("full", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("weight").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - before)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("full")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    rows = rows.withColumn("level", F.min(F.when(fits, F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def _by_source(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """Join documents with a small row set per source, null source included."""
    key = "struct(source IS NULL, coalesce(source, ''))"
    left = left.withColumn("_k", F.expr(key))
    right = right.withColumn("_k", F.expr(key)).drop("source")
    if few:
        return left.join(F.broadcast(right), "_k").drop("_k")
    salts = 64
    left = left.withColumn("_salt", F.pmod(F.col("h"), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["_k", "_salt"]).drop("_k", "_salt")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_of(doc_id: Column, text: Column) -> Column:
    """48 bits of the md5 of doc_id as text, "|" and the text; null counts as empty."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 12), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))


#: Copies of a row by its hash h and its source's plan.
COPIES = "if(source_size = 0, 0, base + if(h <= last, 1, 0))"


def mix(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """rows(..., source, size, h) with h a hash of 48 bits -> the same rows with
    source_size, target and copies (0, 1 or 2).

    A target at or above its source's size takes every document once and spends the
    rest on second copies; below it, on first copies. Copies go to the least hashes.
    The last document goes in where that comes nearer the target, so a source ends at
    most half a document from its target. Rows of one hash (repeated rows: one doc_id and
    text) go in or out together. Null and empty texts have size 0, very long ones count
    whole. A null source is a source. A source without words has target 0 and takes
    nothing. Reruns agree: the hash is md5 of doc_id and text. Empty in, empty out.
    """
    rows = materialize(rows, "sizes")
    plan, few = thresholds(rows, weights, share, cap)
    return _by_source(rows, plan, few).withColumn("copies", F.expr(COPIES)).drop("base", "last")


def thresholds(rows: DataFrame, weights, share: float, cap: float) -> tuple[DataFrame, bool]:
    """rows(source, size, h) -> a row per source (source_size, target, base, last), and
    whether those are few enough to broadcast."""
    rows = materialize(rows.select("source", "size", "h"), "sizes") if getattr(rows, "_lumenfold_path", None) is None else rows
    shift = sum(LEVELS) - LEVELS[0]
    hist = materialize(rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s")), "histogram")
    sources = hist.groupBy("source").agg(F.sum("s").alias("source_size"))
    goals = water_fill(sources, weights, share, cap)
    once = (F.col("target") >= F.col("source_size")) & (F.col("source_size") > 0)
    goals = goals.withColumn("base", F.when(once, 1).otherwise(0)).withColumn("goal", F.when(once, F.col("target") - F.col("source_size")).otherwise(F.col("target")))
    goals = materialize(goals, "goals")
    few = goals.count() <= BROADCAST_SOURCES

    at = goals.select("source", "goal", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    for i, bits in enumerate(LEVELS):
        shift = sum(LEVELS[i + 1 :])
        if i:
            inside = _by_source(rows.select("source", "size", "h"), at, few).where(F.shiftright("h", shift + bits) == F.col("prefix"))
            hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = _by_source(hist.withColumn("h", F.col("bucket")), at, few)
        sums = sums.withColumn("upto", F.col("before") + F.sum("s").over(run)).withColumn("below", F.col("upto") - F.col("s"))
        # the boundary: the last bucket that begins at or below the goal
        edge = sums.where("below <= goal").groupBy("source").agg(F.max(F.struct("bucket", "below", "goal", "upto")).alias("e"))
        at = materialize(edge.select("source", F.col("e.goal").alias("goal"), F.col("e.bucket").alias("prefix"), F.col("e.below").alias("before"), F.col("e.upto").alias("upto")), "edge")
        at = at if i == len(LEVELS) - 1 else at.drop("upto")
    takes_edge = F.abs(F.col("upto") - F.col("goal")) < F.abs(F.col("goal") - F.col("before"))
    at = at.select("source", F.when(takes_edge, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("last"))
    plan = goals.withColumn("h", F.lit(0).cast("bigint"))
    return _by_source(plan, at, few).drop("h", "goal"), few


def mix_rows(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs with each row as often as the mix takes it, all its columns and no others.

    The thresholds come from mix() over doc_id, source and size alone; the whole rows
    are then filtered and repeated where they are read, without a shuffle.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: F.col(f"c{names.index(c)}") for c in ("doc_id", "text", "source")}
    rows = plain.withColumns({"_source": at["source"], "_size": size_of(at["text"]), "_h": hash_of(at["doc_id"], at["text"])})
    plan, few = thresholds(rows.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_h").alias("h")), weights, share, cap)
    named = rows.withColumnsRenamed({"_source": "source", "_h": "h"}).drop("_size")
    out = _by_source(named, plan, few).withColumn("_n", F.explode(F.expr("array_repeat(0, " + COPIES + ")")))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
