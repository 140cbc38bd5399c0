"""Token counts: an exact histogram of encoded lengths, and suffix sums over it for every context limit.

Documents are grouped by encoded length (byte-level BPE by default), which is all that is shuffled. The suffix sums run in
two steps, over blocks of lengths and within each block, so that no task sorts all lengths.

``histogram``: for each length n that occurs: docs, docs_at_least, tokens_at_least (of documents of n tokens or more),
tokens_truncated (tokens left if every document is cut at n) and share_at_most (documents of at most n tokens).

Defined results: null text has length 0; repeated rows count each; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .common import materialize

BLOCK = 1024


def histogram(docs: DataFrame, vocabulary: str = byte_bpe.VOCABULARY) -> DataFrame:
    counts = byte_bpe.lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("docs"))
    return suffix_sums(materialize(counts, "lengths"))


def suffix_sums(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / block))
    from_top = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t"))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(from_top), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(from_top), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_docs"),
        F.sum("t").over(Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    return (
        counts.join(blocks, "block")
        .withColumn("docs_at_least", F.sum("docs").over(inside) + F.col("docs_above"))
        .withColumn("tokens_at_least", F.sum(F.col("docs") * F.col("n_tokens")).over(inside) + F.col("tokens_above"))
        .select(
            "n_tokens", "docs", "docs_at_least", "tokens_at_least",
            (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_truncated"),
            ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("share_at_most"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens from it upwards, and tokens left after truncation at it.

    Each is read from the suffix sums at the least length not under the limit; limits past all lengths truncate nothing.
    """
    at = [F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("n_tokens") >= x, F.col("n_tokens"))) for x in limits]
    found = F.array(*(F.struct(F.lit(x).cast("long").alias("limit"), a.alias("at")) for x, a in zip(limits, at, strict=True)))
    rows = sums.agg(F.max("tokens_truncated").alias("all_tokens"), found.alias("found")).select("all_tokens", F.explode("found").alias("f"))
    docs, tokens = F.coalesce("f.at.docs_at_least", F.lit(0)), F.coalesce("f.at.tokens_at_least", F.lit(0))
    left = F.coalesce("all_tokens", F.lit(0)) - tokens + docs * F.col("f.limit")
    return rows.select("f.limit", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), left.alias("tokens_truncated"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share ``q`` of documents don't exceed."""
    return sums.where(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens"))
