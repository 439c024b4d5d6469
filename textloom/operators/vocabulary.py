"""Vocabulary mining: word counts, candidates that a base vocabulary splits, growth, manual additions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import Tables


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, frequency) over the corpus."""
    return df.select(F.explode(X.vocabulary_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("frequency"))


def base_pieces(words: DataFrame, vocab: DataFrame, longest: int = 16) -> DataFrame:
    """words with base_tokens: greedy longest match of ``word`` against the pieces of vocab (token); a character in no piece stands alone.

    Every part of a word of up to ``longest`` characters is looked up by a join on the piece, so the vocabulary may be of any size.
    """
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("at")).where("word <> ''")
    parts = starts.select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("at") + 1))).alias("size"))
    known = parts.join(vocab.select("token").distinct(), F.col("token") == F.substring("word", F.col("at"), F.col("size")), "left_semi")
    best = known.groupBy("word", "at").agg(F.max("size").alias("size"))
    found = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("sizes"))  # at most a word's characters

    def step(acc: Column, at: Column) -> Column:
        size = F.coalesce(F.try_element_at("sizes", at), F.lit(1))
        taken = F.struct((at + size).alias("next"), F.concat(acc["pieces"], F.array(F.substring("word", at, size))).alias("pieces"))
        return F.when(at == acc["next"], taken).otherwise(acc)

    zero = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("pieces"))
    pieces = F.when(F.col("word") != "", F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), zero, step, lambda acc: acc["pieces"]))
    return words.join(found, "word", "left").withColumn("base_tokens", F.coalesce(pieces, F.array().cast("array<string>"))).drop("sizes")


def candidates(counts: DataFrame, vocab: DataFrame, min_frequency: int = 200) -> DataFrame:
    """Frequent words outside the vocabulary (token) that it splits: word, frequency, split_count, base_tokens; most frequent first.

    The frequency filter and the anti join go before splitting: the result is the same and few words are split.
    """
    rare = counts.where(F.col("frequency") >= min_frequency).join(vocab, F.col("word") == F.col("token"), "left_anti")
    out = base_pieces(rare, vocab).withColumn("split_count", F.size("base_tokens")).where("split_count > 1")
    return out.select("word", "frequency", "split_count", "base_tokens").orderBy(F.desc("frequency"), "word")


def grown(vocab: DataFrame, words: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """vocab (token, id) and the words (word, frequency) that it lacks, with new ids behind the largest in order of frequency."""
    order = [F.desc("frequency"), F.col("word")]
    new = words.join(vocab, words.word == vocab.token, "left_anti")
    new = new.orderBy(*order).limit(max_tokens) if max_tokens is not None else new
    size = vocab.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("size"))  # one row
    ranked = Tables(vocab.sparkSession, "vocabulary").numbered(new, order, "k").join(F.broadcast(size), F.lit(True))
    return vocab.select("token", "id").unionByName(ranked.select(F.col("word").alias("token"), (F.col("size") + F.col("k")).alias("id")))


def manual_tokens(spark, vocab: DataFrame, listed: list[str]) -> DataFrame:
    """(token, present) of a short list of tokens."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(listed)], "place int, token string")
    return df.join(vocab.select("token").distinct().withColumn("present", F.lit(True)), "token", "left").withColumn("present", F.coalesce("present", F.lit(False)))
