"""Incremental curation: extracted files as a stream; stateless preparation and scoring, exact duplicates by hash.

An extension: the batch pipeline has no stream. Near and semantic duplicates need the stored corpus and run per micro-batch in a
sink of the caller's (foreachBatch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..functions import quality as Q
from ..functions import text as X
from ..plans.curation import prepare
from ..schemas import EXTRACTED


def extracted_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    df = spark.readStream.schema(EXTRACTED).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return df.where(F.coalesce("extraction_success", F.lit(False)) & (F.size("pages") > 0))


def curated_stream(docs: DataFrame, cfg: CurationConfig | None = None, watermark: str = "1 day") -> DataFrame:
    """Documents that pass the first two stages, the first of each content hash within the watermark."""
    cfg = cfg or CurationConfig()
    prepared = prepare(docs.withColumn("images_detected", F.coalesce("images_detected", F.lit(0))), cfg).where("reason is null")
    scored = Q.with_scores(prepared, tables=F.coalesce(F.size("tables"), F.lit(0)), images=F.col("images_detected")).where(F.col("overall_score") >= cfg.min_quality_score)
    hashed = scored.withColumn("content_hash", F.sha2(X.comparison_key(F.col("content")), 256)).withColumn("seen_at", F.current_timestamp())
    kept = hashed.select("id", "file_path", "content", "overall_score", "quality_grade", "content_hash", "seen_at")
    return kept.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["content_hash"])
