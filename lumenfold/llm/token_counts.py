"""Operator 10, exact token counts: a histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import materialize

#: A file of the installed public vocabularies, or the path of any other rank file.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Lengths a block of the two-level suffix sums holds.
BLOCK = 1024


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Loaded once a Python worker; the file's ranks with its published split pattern."""
    import public_tokenizers
    import tiktoken

    with open(path if "/" in path else public_tokenizers.path(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of every whole text; a null or empty text has 0 tokens.

    Very long texts are encoded whole. A row for each row, repeated ones and null doc_ids
    too; other columns are ignored. The vocabulary file must be there on every executor.
    """

    @F.pandas_udf("bigint")
    def length(texts: pd.Series) -> pd.Series:
        encode = _encoder(tokenizer).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return docs.select("doc_id", length("text").alias("n_tokens"))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """lengths(n_tokens) -> one row per distinct length, with its suffix sums:

    n_docs of this length; docs_ge, tokens_ge: documents at least this long and their
    tokens; docs_le: at most this long (quantiles); total_docs, total_tokens;
    truncated_tokens: all documents' tokens when each is cut at n_tokens.

    Rows are summed before any shuffle; suffix sums run within blocks of lengths and
    then over blocks, so no task meets more than a block of lengths or all blocks. The
    histogram is written before both read it, so that texts are encoded once. Null n_tokens
    count as 0, repeated rows each, equal lengths in one row; other columns are ignored.
    Empty in, empty out.
    """
    by_length = lengths.groupBy(F.coalesce("n_tokens", F.lit(0).cast("bigint")).alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    hist = materialize(by_length, "histogram").withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    upward = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.join(blocks, "block")
    rows = rows.withColumn("docs_ge", F.sum("n_docs").over(upward) + F.col("d_after")).withColumn("tokens_ge", F.sum(F.col("n_docs") * F.col("n_tokens")).over(upward) + F.col("t_after"))
    rows = rows.withColumn("docs_le", F.col("total_docs") - F.col("docs_ge") + F.col("n_docs"))
    cut = F.col("total_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")
    return rows.select("n_tokens", "n_docs", "docs_le", "docs_ge", "tokens_ge", "total_docs", "total_tokens", cut.alias("truncated_tokens"))


def truncated_total(hist: DataFrame, limits: list[int]) -> DataFrame:
    """length_histogram() -> max_tokens, truncated_tokens, docs_cut for each limit, repeated ones once.

    An empty histogram gives no rows; no length in it is null."""
    rows = hist.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)) for x in sorted(set(limits))])).alias("max_tokens"))
    cut = F.when(F.col("n_tokens") > F.col("max_tokens"), F.col("n_docs")).otherwise(0)
    return rows.groupBy("max_tokens").agg(F.sum(F.col("n_docs") * F.least("n_tokens", "max_tokens")).alias("truncated_tokens"), F.sum(cut).alias("docs_cut"))


def quantiles(hist: DataFrame, at: list[float]) -> DataFrame:
    """length_histogram() -> q, n_tokens: exact lengths at the given shares from 0 to 1, the least length that
    such a share of documents does not exceed. Repeated shares once; an empty histogram gives no rows."""
    rows = hist.select("n_tokens", "docs_le", "total_docs", F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("q"))
    return rows.where(F.col("docs_le") >= F.ceil(F.col("q") * F.col("total_docs"))).groupBy("q").agg(F.min("n_tokens").alias("n_tokens"))
