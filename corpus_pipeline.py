"""A training corpus from raw documents: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of docs. Rows keep every column they came with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, language_id, mixing, near_dedup, sharding
from lumenfold.llm.common import materialize, table

#: Not expressible: a trained model and MinHash decide; tests hold stages to brute force.
ORACLE_SQL = None

SHARDS = 8


#: The least share of the odds that a document's best language must have, and the languages
#: whose documents stay; None: all that the model learned.
MIN_SCORE, LANGUAGES = 0.5, None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null and empty texts, texts without a letter, texts
    whose best language has less than MIN_SCORE of the odds or isn't one of LANGUAGES.

    Where the model learned no language (no label), documents with a letter stay. Repeated
    rows are judged each, very long texts whole; all columns are carried. Empty in, empty out."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    names = docs.columns
    text = F.col(f"c{names.index('text')}")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("text", text)
    rows = language_id.judged(plain, model)
    sure = F.col("p.letters")
    if not model.isEmpty():
        sure = sure & (F.col("p.score") >= MIN_SCORE)
        if LANGUAGES is not None:
            sure = sure & F.col("p.lang_pred").isin(list(LANGUAGES))
    return rows.where(sure).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: five-word shingles, similarity 0.8 or more.

    Rows without words (null, empty) all stay, repeated ones too; see near_dedup.keep_one."""
    return near_dedup.keep_one(docs, width=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go.

    Rows without words stay; repeated rows are judged each. Empty in, empty out."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source weights take effect: a row stays 0, 1 or 2 times.

    A null source is a source; rows without words go, or stay as their hash says. Repeated
    rows (doc_id and text) share their fate. Empty in, empty out."""
    return mixing.mix_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with all its columns, its shard and its slot; repeated rows take slots each.

    See sharding.shard_rows. Empty in, empty out."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


