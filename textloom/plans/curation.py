"""The curation pipeline: prepare, score, remove duplicates, domain, privacy, order; with its rejections, pairs and reports."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..functions import domain as D
from ..functions import quality as Q
from ..functions import text as X
from ..operators import dedup
from ..operators.markup import flat_table
from ..operators.reports import as_map
from ..storage import Tables


@dataclass
class Curation:
    """What a run gives: all of it lazily planned over written tables. Only who asks for the rows has them redacted and ranked."""

    left: DataFrame
    rejections: DataFrame
    pairs: DataFrame
    stages: DataFrame
    grades: DataFrame
    cfg: CurationConfig
    tables: Tables

    @property
    def enhanced(self) -> DataFrame:
        """The documents kept, with domain, boosted score and redacted text, each made only if it is asked for."""
        cfg = self.cfg
        df = self.left.withColumn("domain_category", D.category(F.col("content"))).withColumn("_r", D.relevance(F.col("word_count"), F.col("term_count")))
        df = df.withColumn("quality_score", D.boosted(F.col("overall_score"), F.col("_r"), cfg.domain_relevance_threshold, cfg.domain_boost))
        df = df.withColumn("domain_relevance_score", F.round("_r", 4)).drop("_r")
        redacted = D.redact(F.col("content")) if cfg.enable_pii_removal else F.col("content")
        return df.withColumn("text_redacted", redacted).withColumn("pii_removed", F.col("text_redacted") != F.col("content"))

    @cached_property
    def curated(self) -> DataFrame:
        return ranks(self.enhanced, self.tables).select(
            "ord", "id", F.col("text_redacted" if self.cfg.text_source == "redacted" else "original_content").alias("text"),
            F.col("original_content").alias("text_original"), "text_redacted", "pii_removed", "quality_score", "quality_grade", "domain_category",
            F.struct(
                X.basename(F.col("file_path")).alias("file"), F.col("total_pages").alias("pages"), (F.size("tables") > 0).alias("has_tables"), (F.col("images_detected") > 0).alias("has_images"), "word_count"
            ).alias("source_info"), "training_rank", "content_hash", "domain_relevance_score",
        )


def page_text(pages: Column) -> Column:
    """Texts of ten characters or more, by numeric page, joined by blank lines."""
    ordered = F.array_sort(F.transform(F.map_entries(pages), lambda e: F.struct(e["key"].try_cast("int").alias("k"), X.strip(F.coalesce(e["value"]["text"], F.lit(""))).alias("t"))))
    return F.array_join(F.filter(F.transform(ordered, lambda e: e["t"]), lambda t: F.length(t) >= 10), "\n\n")


def table_text(tables: Column) -> Column:
    """Each table with content under its number, counted over all tables."""
    one = F.transform(tables, lambda t, i: F.struct((i + 1).alias("k"), flat_table(t["data"]).alias("t")))
    full = F.filter(one, lambda t: t["t"].isNotNull() & (t["t"] != ""))
    return F.array_join(F.transform(full, lambda t: F.concat(F.lit("[TABLE_"), t["k"].cast("string"), F.lit("]\n"), t["t"])), "\n\n")


def prepare(docs: DataFrame, cfg: CurationConfig) -> DataFrame:
    """Clean content, its tokens, and reason: why the first stage rejects the document, or null."""
    df = docs.withColumn("original_content", page_text(F.col("pages"))).withColumn("_t", table_text(F.col("tables")))
    has = F.col("original_content") != ""
    df = df.withColumn("original_content", F.when(has & (F.col("_t") != ""), F.concat_ws("\n\n", "original_content", "_t")).otherwise(F.col("original_content"))).drop("_t")
    df = Q.with_tokens(df.withColumn("content", X.normalise_content(F.col("original_content"))))
    n = F.size("words")
    odd = F.filter(F.map_keys("pages"), lambda k: k.try_cast("int").isNull())  # such a row must not fail the others
    error = F.concat(F.lit("Processing error: "), F.substring(F.concat(F.lit("page key is no number: "), F.try_element_at(odd, F.lit(1))), 1, 50))
    reason = F.when(F.size(odd) > 0, error).when(~has, "No extractable content").otherwise(
        Q.gate_reason(n, Q.sentence_pieces(F.col("content")), Q.gibberish_matches(F.col("content"), F.col("tokens")), cfg.min_words_per_doc, cfg.min_sentences_per_doc)
    )
    return df.withColumn("reason", reason).withColumn("word_count", n).withColumn("id", F.substring(F.md5("content"), 1, 12))


def _rejected(df: DataFrame, stage: str, reason: Column, counted: bool = True) -> DataFrame:
    words = F.col("word_count") if counted else F.lit(0)
    return df.select("ord", X.basename(F.col("file_path")).alias("filename"), F.lit(stage).alias("stage"), reason.alias("reason"), words.cast("int").alias("word_count"))


def low_score(score: Column, least: float) -> Column:
    """The reason of the second stage. format_number rounds the binary value, as Python's format does; format_string rounds its shortest decimal."""
    return F.concat(F.lit("Low quality score: "), F.format_number(score, 3), F.lit(f" < {least}"))


def curate(docs: DataFrame, cfg: CurationConfig | None = None, until: str = "semantic") -> Curation:
    """docs: extracted documents with ord, the order that decides ties; until: the last level of duplicates (exact, fuzzy, semantic)."""
    cfg = cfg or CurationConfig()
    tables = Tables(docs.sparkSession, "curation")
    # Prepared and scored at once, so that neither the words of each text nor its pages are written.
    prepared = Q.with_scores(prepare(docs, cfg), tables=F.size("tables"), images=F.col("images_detected")).drop("words", "tokens", "lower_words", "pages")
    prepared = tables.save(prepared, "prepared")
    rejections = _rejected(prepared.where("reason is not null"), "Stage 1 - Preparation", F.col("reason")).withColumn("word_count", F.when(F.col("reason") == "No extractable content", 0).otherwise(F.col("word_count")))
    scored = prepared.where("reason is null").drop("reason")
    low = F.col("overall_score") < cfg.min_quality_score
    rejections = rejections.unionByName(_rejected(scored.where(low), "Stage 2 - Quality", low_score(F.col("overall_score"), cfg.min_quality_score)))
    good = scored.where(~low)
    name = X.basename(F.col("file_path"))
    first = good.join(tables.save(dedup.exact_duplicates(good, tables), "exact"), "ord")
    # Names and counts of all that follows, without the texts.
    exact = first.where(F.col("ord") != F.col("first_ord")).select("ord", "first_ord", "file_path", "word_count")
    keepers = good.select(F.col("ord").alias("first_ord"), name.alias("kept"))
    pairs = exact.join(keepers, "first_ord").select(F.lit("exact").alias("type"), name.alias("removed"), "kept", F.lit(1.0).alias("similarity"))
    rejections = rejections.unionByName(_rejected(exact, "Stage 3 - Exact Dedup", F.lit("Exact duplicate")))
    left = tables.save(first.where(F.col("ord") == F.col("first_ord")).withColumn("content_hash", F.substring("content_hash", 1, 12)).drop("first_ord"), "after-exact")
    counts = [("input", docs), ("prepared", prepared.where("reason is null")), ("quality", good), ("exact", left)]
    for level, removals in (("fuzzy", dedup.fuzzy_removals), ("semantic", dedup.semantic_removals)):
        if until == "exact" or level == "semantic" and not (cfg.semantic and until == level):
            continue
        gone = tables.save(removals(left, tables, getattr(cfg, f"{level}_dedup_threshold")), f"{level}-removals")
        names = left.select("ord", name.alias("name"))
        logged = gone.where("logged").join(names.toDF("removed", "removed_name"), "removed").join(names.toDF("kept", "kept_name"), "kept")
        pairs = pairs.unionByName(logged.select(F.lit(level).alias("type"), F.col("removed_name").alias("removed"), F.col("kept_name").alias("kept"), "similarity"))
        lost = gone.select(F.col("removed").alias("ord")).distinct()
        rejections = rejections.unionByName(_rejected(left.join(lost, "ord"), f"Stage 3 - {level.capitalize()} Dedup", F.lit(f"{level.capitalize()} duplicate")))
        left = tables.save(left.join(lost, "ord", "left_anti"), f"after-{level}")
        counts.append((level, left))
    stages = None
    for k, (stage, df) in enumerate(counts):
        row = df.agg(F.count("*").alias("documents")).select(F.lit(k).alias("k"), F.lit(stage).alias("stage"), "documents")
        stages = row if stages is None else stages.unionByName(row)
    grades = good.groupBy("quality_grade").agg(F.count("*").alias("documents"))
    return Curation(left, rejections, pairs, stages, grades, cfg, tables)


def ranks(df: DataFrame, tables: Tables, score: str = "quality_score", name: str = "ranks") -> DataFrame:
    """Adds training_rank, 1-based by score from the highest on, then by ord."""
    out = tables.numbered(df, [F.desc(score), F.col("ord")], f"_{name}")
    return out.withColumn("training_rank", (F.col(f"_{name}") + 1).cast("int")).drop(f"_{name}")


def retention(stages: DataFrame) -> DataFrame:
    """Documents after each stage and their share of the input."""
    first = stages.where("k = 0").select(F.greatest("documents", F.lit(1)).alias("input"))  # one row
    return stages.crossJoin(F.broadcast(first)).select("k", "stage", "documents", (F.col("documents") / F.col("input")).alias("retention"))


def metadata(c: Curation) -> DataFrame:
    """One row: total, mean quality, domains, grades, removed pairs by level."""
    total = c.enhanced.agg(F.count("*").alias("total_documents"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("average_quality"))
    domains = as_map(c.enhanced.groupBy("domain_category").agg(F.count("*").alias("n")), "domain_category", "n", "domain_distribution")
    grades = as_map(c.grades, "quality_grade", "documents", "quality_distribution")
    levels = as_map(c.pairs.groupBy("type").agg(F.count("*").alias("n")), "type", "n", "deduplication_stats")
    return total.crossJoin(domains).crossJoin(grades).crossJoin(levels).withColumn("curation_date", F.current_timestamp())  # one row each


#: How each figure of a curation report is made.
METHODS = {
    "preparation": "page texts and tables joined, NFKC, short lines dropped; gates on words, sentences and gibberish",
    "quality": "weighted mean of six text metrics, graded from A+ to D",
    "exact_dedup": "equal keys after case, punctuation and white space are dropped",
    "fuzzy_dedup": "Jaccard similarity of five-word shingles, greedy by score",
    "semantic_dedup": "cosine of term weights of two- and three-word terms, greedy by score",
    "privacy": "patterns of personal data replaced by their kind",
}


def statistics(c: Curation) -> DataFrame:
    """One row: documents at each stage, rejections by stage and by kind of reason, duplicate pairs by level."""
    kind = F.regexp_replace("reason", r"[0-9].*$|:.*$", "")
    stages = as_map(c.stages, "stage", "documents", "stages")
    by_stage = as_map(c.rejections.groupBy("stage").agg(F.count("*").alias("n")), "stage", "n", "rejections_by_stage")
    by_kind = as_map(c.rejections.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")), "kind", "n", "rejections_by_reason")
    pairs = as_map(c.pairs.groupBy("type").agg(F.count("*").alias("n")), "type", "n", "duplicate_pairs")
    one = F.lit(True)  # one row each
    return stages.join(by_stage, one).join(by_kind, one).join(pairs, one)


def report(c: Curation, seconds: dict[str, float] | None = None) -> DataFrame:
    """The curation report as one row: retention, by stage too; quality of what is kept; statistics; seconds by stage; methods."""
    kept = retention(c.stages)
    last = kept.agg(F.max_by("retention", "k").alias("retention_rate"), F.max_by("documents", "k").alias("final_documents"), F.min_by("documents", "k").alias("input_documents"))
    score = F.col("quality_score")
    quality = c.enhanced.agg(F.struct(
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean"), F.min(score).alias("least"), F.max(score).alias("largest"), F.stddev_pop(score).alias("deviation"),
        F.coalesce(F.sum(F.col("pii_removed").cast("int")), F.lit(0)).alias("documents_with_personal_data"),
    ).alias("quality_analysis"))
    literal = lambda d, kind: F.from_json(F.lit(json.dumps(d)), f"map<string, {kind}>")
    one = F.lit(True)  # one row each
    out = last.join(as_map(kept, "stage", "retention", "stage_retention"), one).join(quality, one).join(statistics(c), one)
    return out.select("*", literal(seconds or {}, "double").alias("seconds"), literal(METHODS, "string").alias("methodology"), F.current_timestamp().alias("created"))
