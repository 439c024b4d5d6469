"""Token statistics and fixed-length encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default tokenizer: runs of letters, up to three digits, runs of other marks.
TOKEN_PATTERN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
SEQUENCE_LENGTHS, BATCH_SIZES = [512, 1024, 2048, 4096], [1, 2, 4, 8]
PERCENTILES = [10, 25, 50, 75, 90, 95, 99]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def text_or_content(text: Column, content: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(content, F.lit("")))


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.col(text) != "").select("*", F.size(tokens(F.col(text))).alias("n_tokens"), F.length(text).alias("n_text_chars"))


def corpus_stats(counts: DataFrame) -> DataFrame:
    """One row: documents, tokens, mean, median, least, most, population deviation, mean characters, characters per token."""
    n = F.col("n_tokens")
    return counts.agg(
        F.count("*").alias("num_documents"), F.sum(n).alias("total_tokens"), F.avg(n).alias("mean_tokens"), F.median(n).alias("median_tokens"),
        F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.stddev_pop(n).alias("std_tokens"), F.avg("n_text_chars").alias("mean_chars"),
        (F.sum("n_text_chars") / F.sum(n)).alias("chars_per_token"),
    )


def percentiles(counts: DataFrame, listed: list[int] = PERCENTILES) -> DataFrame:
    """(percentile, value), linear interpolation."""
    row = counts.agg(F.percentile("n_tokens", F.array(*[F.lit(p / 100) for p in listed])).alias("v"))
    return row.select(F.posexplode("v").alias("k", "value")).select(F.element_at(F.array(*map(F.lit, listed)), F.col("k") + 1).alias("percentile"), "value")


def batch_estimates(stats: DataFrame, lengths: list[int] = SEQUENCE_LENGTHS, batches: list[int] = BATCH_SIZES) -> DataFrame:
    """Sequences of each length and batches of each size that the corpus fills: a grid of literals."""
    grid = stats.select("total_tokens", F.explode(F.array(*map(F.lit, lengths))).alias("sequence_length"))
    grid = grid.withColumn("sequences", F.expr("total_tokens div sequence_length"))
    return grid.select("sequence_length", "sequences", F.explode(F.array(*map(F.lit, batches))).alias("batch_size")).withColumn("batches", F.expr("sequences div batch_size"))


def fixed_length(ids: Column, length: int, pad: int = 0) -> Column:
    """Truncated or padded to a length."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))
