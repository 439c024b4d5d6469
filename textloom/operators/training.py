"""Split into training and validation rows, and monitors over a loss log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def split_rows(df: DataFrame, text: str = "text", ord_col: str = "ord", share: float = 0.9, seed: int = 42) -> DataFrame:
    """Adds split: the first int(n x share) rows in order of md5(ord-seed) train. Blank texts are left out first.

    The cut is the hash of the row at that place: found by ranges, not by one window over all rows.
    """
    rows = df.where(strip(F.col(text)) != "").withColumn("_h", F.md5(F.concat(F.col(ord_col).cast("string"), F.lit(f"-{seed}"))))
    # Rows are counted by the first four hex digits; only one such bucket needs an order of its own.
    buckets = rows.groupBy(F.substring("_h", 1, 4).alias("_b")).agg(F.count("*").alias("_n"))  # 65,536 rows at most
    before = F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")
    placed = buckets.withColumn("_before", before).withColumn("_cut", F.floor(F.sum("_n").over(Window.partitionBy()) * F.lit(share)))
    rows = rows.withColumn("_b", F.substring("_h", 1, 4)).join(F.broadcast(placed), "_b")
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", ord_col))
    place = F.col("_before") + within
    return rows.withColumn("split", F.when(place <= F.col("_cut"), "train").otherwise("validation")).drop("_h", "_b", "_n", "_before", "_cut")


def small_set(n: Column, least: int = 100) -> Column:
    return n < least


def loss_monitor(df: DataFrame, key: str, step: str, loss: str, spike: float = 10.0, factor: float = 3.0) -> DataFrame:
    """Adds initial and best loss so far, spike and explosion flags, per run (key)."""
    by = Window.partitionBy(key).orderBy(step)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("initial_loss", F.first(loss, ignorenulls=True).over(so_far)).withColumn("best_loss", F.min(loss).over(so_far))
    return df.withColumn("is_spike", F.col(loss) > spike).withColumn("is_explosion", F.col(loss) > factor * F.col("initial_loss"))


def early_stopping(df: DataFrame, key: str, step: str, loss: str, patience: int = 8, threshold: float = 0.01) -> DataFrame:
    """Adds improved, waited (rows without improvement in a row) and stop_step, the first step at which waited is the patience."""
    by = Window.partitionBy(key).orderBy(step)
    before = F.min(loss).over(by.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("improved", before.isNull() | (before - F.col(loss) > threshold))
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_run", F.sum(F.col("improved").cast("int")).over(so_far))
    df = df.withColumn("waited", F.sum((~F.col("improved")).cast("int")).over(Window.partitionBy(key, "_run").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.min(F.when(F.col("waited") >= patience, F.col(step))).over(Window.partitionBy(key))
    return df.withColumn("stop_step", stop).drop("_run")


def step_counts(rows: Column, batch: int, accumulation: int, epochs: int, max_steps: int | None = None) -> dict[str, Column]:
    per = F.expr(f"{batch} * {accumulation}")
    steps = F.floor(rows / per)
    return {"effective_batch": per, "steps_per_epoch": steps, "total_steps": F.lit(max_steps) if max_steps else steps * epochs}


def config_advice(learning_rate: float, epochs: int) -> list[str]:
    """Warnings about a training configuration."""
    out = [f"learning rate {learning_rate} is above 3e-4"] if learning_rate > 3e-4 else []
    return out + ([f"{epochs} epochs are above 7"] if epochs > 7 else [])
