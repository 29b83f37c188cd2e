"""Operator 7, sharding by jump consistent hashing, in SQL functions only.

The 64-bit generator of the published algorithm runs in DECIMAL(38,0) modulo 2^64,
so nothing overflows. Slots within a shard are numbered without gathering a shard:
rows are range-partitioned by key, counted by (range, shard), and each row adds its
rank in its own range to the rows of that shard in the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import few, materialize

#: Steps that are tried first. Over n shards the loop makes 1/1 + 1/2 + ... + 1/n jumps on
#: average (15 for a million). A key that needs more goes on with as many as there are shards.
JUMPS = 200


def jump_hash(key: str, shards: int) -> Column:
    """Shard 0..shards-1 of a BIGINT column, taken as an unsigned 64-bit key; null counts as 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    two64 = "18446744073709551616BD"
    start = f"pmod(cast(coalesce({key}, 0) as decimal(38,0)), {two64})"
    step = f"""pmod(cast(s.k * 2862933555777941757BD + 1BD as decimal(38,0)), {two64})"""
    jump = "cast(floor((x.s.j + 1) * (2147483648D / (cast(floor(x.k2 / 8589934592BD) as double) + 1D))) as bigint)"
    state = f"named_struct('k', cast({start} as decimal(38,0)), 'b', 0L, 'j', 0L)"

    def jumps(most: int, begin: str) -> str:
        return f"""aggregate(sequence(1, {most}), {begin}, (s, i) -> if(s.j >= {shards}L, s,
            transform(array(named_struct('s', s, 'k2', cast({step} as decimal(38,0)))),
              x -> named_struct('k', x.k2, 'b', x.s.j, 'j', {jump}))[0]))"""

    if shards <= JUMPS:
        return F.expr(f"cast({jumps(shards, state)}.b as int)")
    whole = f"transform(array({jumps(JUMPS, state)}), d -> if(d.j >= {shards}L, d, {jumps(shards, 'd')}))[0]"
    return F.expr(f"cast({whole}.b as int)")


def shard(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty (size 1, crc32
    0). Law "key": doc_id and the number of shards decide alone, and one more shard
    takes rows only into itself. Equal doc_ids share a shard; a null doc_id goes
    where key 0 goes. slot numbers a shard's rows from 0 without gaps in the order of
    doc_id, nulls first; repeated rows take consecutive slots. Very long texts count whole.
    Other columns are ignored, whatever their names. Empty in, empty out.
    """
    return _placed(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("seq")), shards, ranges).drop("seq")


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The rows of docs, all columns, with what shard() says of each behind them.

    A column of docs that has the name of an added one gets an underscore behind its own.
    The rows are numbered once, so that texts take no part in the numbering of slots."""
    names = docs.columns
    numbered = materialize(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("seq", F.monotonically_increasing_id()), "numbered")
    at = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    placed = materialize(_placed(numbered.select(at["doc_id"].alias("doc_id"), at["text"].alias("text"), "seq"), shards).drop("doc_id"), "placed")
    added = [c for c in placed.columns if c != "seq"]
    own = [F.col(f"c{i}").alias(c + "_" if c in added else c) for i, c in enumerate(names)]
    return numbered.join(few(placed), "seq").select(*own, *added)


def _placed(rows: DataFrame, shards: int, ranges: int | None = None) -> DataFrame:
    """rows(doc_id, text, seq) -> shard()'s columns and seq."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = rows.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), jump_hash("doc_id", shards).alias("shard"), jump_hash("doc_id", shards + 1).alias("grown_shard"), "seq")
    rows = materialize(rows, "keys")
    # (doc_id, seq) is unique: a key that holds a third of all rows still splits
    dealt = materialize(rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("seq")).withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "seq"))
    out = dealt.withColumn("rank", rank).join(offsets, ["part", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), "grown_shard", "seq")
