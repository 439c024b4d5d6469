"""Embedding rows: means of sub-pieces, zero rows, norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, mean): element-wise means, one average per key and place."""
    flat = df.select(key, F.posexplode(vector).alias("place", "x"))
    by = flat.groupBy(key, "place").agg(F.avg("x").alias("x"))
    return by.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda e: e["x"]).alias("mean"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def gaussian(key: Column, place: Column, seed: int = 42) -> Column:
    """A standard normal number that depends on key, place and seed alone, and so not on the rows' layout (Box-Muller)."""
    uniform = lambda k: (F.shiftrightunsigned(F.xxhash64(key, place, F.lit(seed), F.lit(k)), 11) + 1) / F.lit(float(1 << 53))
    return F.sqrt(-2.0 * F.log(uniform(0))) * F.cos(2.0 * F.pi() * uniform(1))


def initialise(tokens: DataFrame, base: DataFrame, dim: int, seed: int = 42, fallback: str = "noise") -> DataFrame:
    """Input rows of new tokens: the mean of their pieces' rows; where there is none, a small Gaussian row or the mean of all base rows.

    tokens: (token, piece_ids), base: (id, embedding). Gives token, embedding, initialised (from pieces). fallback: noise or mean.
    """
    pieces = tokens.select("token", F.explode_outer("piece_ids").alias("id")).join(base, "id", "left").where(F.col("embedding").isNotNull())
    out = tokens.select("token").join(mean_vectors(pieces, "token", "embedding"), "token", "left")
    if fallback == "mean":
        whole = mean_vectors(base.withColumn("all", F.lit(1)), "all", "embedding").select(F.col("mean").alias("other"))
        out = out.join(F.broadcast(whole), F.lit(True), "left")  # one row
    else:
        out = out.withColumn("other", F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: gaussian(F.col("token"), i, seed) * 0.02))
    return out.select("token", F.coalesce("mean", "other").alias("embedding"), F.col("mean").isNotNull().alias("initialised"))


def zero_rows(tokens: DataFrame, dim: int) -> DataFrame:
    return tokens.select("token", F.array_repeat(F.lit(0.0), dim).alias("embedding"))


def verify(rows: DataFrame, vector: str = "embedding", least: float = 1e-6) -> DataFrame:
    return rows.withColumn("norm", norm(F.col(vector))).withColumn("is_zero", F.col("norm") < least)


def resized(base: DataFrame, ids: DataFrame) -> DataFrame:
    """base (id, embedding) with the mean of all its rows for ids that it lacks."""
    mean = mean_vectors(base.withColumn("all", F.lit(1)), "all", "embedding").select(F.col("mean").alias("embedding"))
    missing = ids.join(base, "id", "left_anti").crossJoin(F.broadcast(mean))  # the mean is one row
    return base.select("id", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(missing.select("id", "embedding"))


def init_report(input_rows: DataFrame, output_rows: DataFrame) -> DataFrame:
    """One row: new tokens, initialised, zeroed, and whether inputs are non-zero and outputs zero."""
    a = verify(input_rows).agg(F.count("*").alias("new_tokens"), F.sum(F.col("initialised").cast("int")).alias("initialised"), F.bool_and(~F.col("is_zero")).alias("inputs_ok"))
    b = verify(output_rows).agg(F.sum(F.col("is_zero").cast("int")).alias("zeroed"), F.bool_and("is_zero").alias("outputs_ok"))
    return a.crossJoin(F.broadcast(b)).withColumn("passed", F.col("inputs_ok") & F.col("outputs_ok"))  # one row each
