"""Operator 9, exact dedup by content sort.

Rows are range-partitioned by sampled splitters over (first bytes of the normalised
text, its hash, row identifier), sorted externally within each partition, and each
row's whole text is compared with its neighbour's. A group may cross any number of
partitions, so a group of copies that holds a third of all rows is dealt over as many
tasks as its rows fill. Splitter samples hold 32 characters a row, never whole texts.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import fold_ascii, materialize, tidy

RUNS = "doc_id bigint, part int, run bigint, head bigint, text_sha256 string"


def _mark_runs(batches):
    """Sorted rows in, one row out for each: the number of its run of equal texts.

    O(1) state: the previous row's text and the run's digest.
    """
    from pyspark import TaskContext

    part, run, last, head, sha = TaskContext.get().partitionId(), -1, None, None, None
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        runs, heads, shas = [], [], []
        # one text at a time is held beside the batch
        for i, text in zip(ids.to_pylist(), texts.cast(pa.binary())):
            text = text.as_py()
            if text != last:  # full comparison with the neighbour
                run, last, head, sha = run + 1, text, i, hashlib.sha256(text).hexdigest()
            runs.append(run)
            heads.append(head)
            shas.append(sha)
        n = len(runs)
        yield pa.RecordBatch.from_arrays([ids, pa.array([part] * n, pa.int32()), pa.array(runs, pa.int64()), pa.array(heads, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "part", "run", "head", "text_sha256"])


def exact_dedup(docs: DataFrame, keep: str = "largest", partitions: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" doc_id of equal texts stays. Texts are equal when
    identical after lower-casing A-Z; null counts as empty. Ties: repeated rows of one
    doc_id are separate members of their group, and all rows that bear keep_id are
    kept. A null doc_id never wins unless its whole group has none (keep_id is then
    null and kept true). Very long texts are compared whole. An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    rows = docs.select("doc_id", fold_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
    rows = rows.withColumns({"lead": F.substring("norm", 1, 32), "h": F.xxhash64("norm")})
    dealt = rows.repartitionByRange(n, F.col("lead"), F.col("h"), order)
    sorted_rows = dealt.sortWithinPartitions(F.col("lead"), F.col("h"), F.col("norm"), order)
    marked = materialize(sorted_rows.select("doc_id", "norm").mapInArrow(tidy(_mark_runs), RUNS), "runs")

    # one row a run: bounded by distinct texts; runs of one text in several partitions
    # have one digest and meet here as a few partial counts
    runs = marked.groupBy("part", "run", "head", "text_sha256").agg(F.count("*").alias("n"))
    best = (F.min if keep == "smallest" else F.max)("head")
    groups = runs.groupBy("text_sha256").agg(F.sum("n").alias("group_size"), best.alias("keep_id"))
    whole = runs.select("part", "run", "text_sha256").join(groups, "text_sha256").drop("text_sha256")
    out = marked.join(whole, ["part", "run"])
    return out.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")
