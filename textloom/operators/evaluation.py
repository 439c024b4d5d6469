"""Evaluation of models by losses, and metrics of responses."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def loss_summary(df: DataFrame, model: str, loss: str, weight: str | None = None) -> DataFrame:
    """(model, n, avg_loss, perplexity): unweighted means; with weight also the weighted mean."""
    aggs = [F.count(loss).alias("n"), F.coalesce(F.avg(loss), F.lit(float("inf"))).alias("avg_loss")]
    if weight:
        aggs.append((F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)).alias("weighted_loss"))
    return df.groupBy(F.col(model).alias("model")).agg(*aggs).withColumn("perplexity", F.exp("avg_loss"))


def model_rows(models: DataFrame, summary: DataFrame) -> DataFrame:
    """Every listed model; those without losses have infinite loss and perplexity."""
    inf = F.lit(float("inf"))
    return models.join(summary, "model", "left").withColumn("exists", F.col("n").isNotNull()).withColumns({c: F.coalesce(c, inf) for c in ("avg_loss", "perplexity")})


def is_model_id(place: str) -> bool:
    """Whether a model's place is an id of a hub, rather than a folder that is there."""
    return "/" in place and not os.path.exists(place)


#: The models that a run compares, in order: untrained, with new tokens initialised, after training.
COMPARED = ("base", "initialized", "pretrained")


def comparison(summary: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """A row for each of the models that are compared: place, model, exists, n, avg_loss, perplexity, improvement over the first."""
    spark = summary.sparkSession
    listed = spark.createDataFrame(list(enumerate(compared)), "place int, model string")
    rows = model_rows(listed, summary)
    base = rows.where(F.col("place") == 0).select(F.col("avg_loss").alias("base_loss"))  # one row
    change = (F.col("base_loss") - F.col("avg_loss")) / F.nullif("base_loss", F.lit(0.0)) * 100
    finite = F.col("exists") & (F.col("base_loss") < float("inf"))
    return rows.join(F.broadcast(base), F.lit(True)).withColumn("improvement_pct", F.when(finite, change)).drop("base_loss")


def report_text(rows: list) -> str:
    """The comparison as text; rows: those of comparison(), a handful."""
    out = ["Model comparison", "=" * 16]
    for r in sorted(rows, key=lambda r: r["place"]):
        if not r["exists"]:
            out.append(f"{r['model']}: not evaluated")
            continue
        change = "" if r["place"] == 0 or r["improvement_pct"] is None else f", {r['improvement_pct']:+.2f} % against {min(rows, key=lambda x: x['place'])['model']}"
        out.append(f"{r['model']}: loss {r['avg_loss']:.4f}, perplexity {r['perplexity']:.2f}{change}")
    return "\n".join(out) + "\n"


def verdicts(summary: DataFrame, base: str) -> DataFrame:
    """Improvement in per cent over the base model, and its verdict."""
    b = summary.where(F.col("model") == base).select(F.col("avg_loss").alias("base_loss"))  # one row
    out = summary.where(F.col("model") != base).crossJoin(F.broadcast(b))
    out = out.withColumn("improvement_pct", (F.col("base_loss") - F.col("avg_loss")) / F.nullif("base_loss", F.lit(0.0)) * 100)
    p = F.col("improvement_pct")
    return out.withColumn("verdict", F.when(p > 0, "improved").when(p < -5, "degraded").otherwise("marginal")).withColumn("init_ok", F.abs("improvement_pct") < 5)


def loss_quartiles(df: DataFrame, model: str, loss: str) -> DataFrame:
    q = F.percentile(loss, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    named = ["low", "q1", "median", "q3", "high"]
    out = df.groupBy(F.col(model).alias("model")).agg(q.alias("q"))
    return out.select("model", *[F.col("q")[i].alias(n) for i, n in enumerate(named)])


def response_metrics(text: Column, seconds: Column) -> dict[str, Column]:
    n = F.size(words(text))
    return {"word_count": n, "generation_time": F.round(seconds, 3), "words_per_second": F.when(seconds > 0, F.round(n / seconds, 2)).otherwise(F.lit(0.0))}


def speed_up(a: Column, b: Column, name_a: str, name_b: str) -> dict[str, Column]:
    """Which of two speeds is the faster, and their ratio (null if the slower one is zero)."""
    return {"faster": F.when(a >= b, name_a).otherwise(name_b), "ratio": F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0))}


def response_table(df: DataFrame, prompt: str, model: str, value: str, models: list[str]) -> DataFrame:
    """One row per prompt and a column per enabled model (of several values the largest); blank prompts have no responses."""
    return df.where(F.trim(F.col(prompt)) != "").groupBy(prompt).pivot(model, models).agg(F.max(value))


def enabled_models(df: DataFrame, only: list[str] | None = None) -> DataFrame:
    out = df.where("enabled")
    return out.where(F.col("model").isin(only)) if only else out


def model_info(df: DataFrame) -> DataFrame:
    """A line about each model (model, path, enabled): its name, state and place."""
    state = F.when(F.col("enabled"), "enabled").otherwise("disabled")
    return df.select("model", "path", "enabled", F.format_string("%s (%s): %s", "model", state, "path").alias("info"))
