"""Registered queries, each over its whole tables; oracles.py has their DuckDB counterparts."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import patterns as P
from ..functions import quality as Q
from ..functions import text as X
from ..operators import dedup, embeddings, evaluation, markup, reports, tfidf, tokens, training, vocabulary
from ..sources import readers, writers
from .. import config
from ..config import VocabularyConfig
from ..storage import Tables, spread
from . import curation
from .oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their whole text as content."""
    return spread(_table(spark, d, "documents")).select("doc_id", F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("content"), "source")


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    df = curation.prepare(readers.documents_as_extracted(spread(_table(spark, d, "documents"))), curation.CurationConfig()).withColumn("doc_id", F.col("ord"))
    # Written, so that a filter on the reason isn't pushed below the columns it is made of, which would repeat them.
    return Tables(spark, "prepared").save(df.select("doc_id", "id", "word_count", "content", "original_content", "file_path", "reason"), "documents")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return Q.with_scores(Q.with_tokens(_raw(spark, d)))


@query
def doc_word_stats(spark, d):
    w = X.words(F.col("content"))
    return _raw(spark, d).select("doc_id", F.size(w).alias("n_words"), F.length("content").alias("n_chars"), F.size(F.array_distinct(F.transform(w, F.lower))).alias("n_distinct"))


@query
def doc_ids_md5(spark, d):
    return _raw(spark, d).select("doc_id", F.substring(F.md5("content"), 1, 12).alias("id"), F.substring(F.sha2("content", 256), 1, 12).alias("sha_id"))


@query
def normalize_lines(spark, d):
    return _raw(spark, d).select("doc_id", F.md5(X.normalise_content(F.col("content"))).alias("content_md5"))


@query
def comparison_key(spark, d):
    return _raw(spark, d).select("doc_id", F.md5(X.comparison_key(F.col("content"))).alias("key_md5"))


@query
def prepared_documents(spark, d):
    return _prepared(spark, d).select("doc_id", "id", "word_count", F.length("content").alias("char_count"), F.md5("original_content").alias("original_md5"))


@query
def sentence_gate(spark, d):
    return _raw(spark, d).select("doc_id", Q.sentence_pieces(F.col("content")).alias("pieces"), (Q.sentence_pieces(F.col("content")) >= 2).alias("passes"))


@query
def gibberish_gate(spark, d):
    df = Q.with_tokens(_raw(spark, d)).withColumn("n", Q.gibberish_matches(F.col("content"), F.col("tokens")))
    return df.select("doc_id", F.col("n").alias("matches"), (F.col("n") <= F.size("words") * F.lit(0.2)).alias("passes"))


@query
def stage1_gate_reasons(spark, d):
    return _prepared(spark, d).where("reason is not null").groupBy("reason").agg(F.count("*").alias("documents"))


def _metric(name):
    def f(spark, d):
        return _scored(spark, d).select("doc_id", name)

    f.__name__ = name
    return query(f)


for _name in ("lexical_diversity", "information_density", "technical_density", "structural_quality", "domain_relevance", "content_richness"):
    _metric(_name)


@query
def quality_score(spark, d):
    return _scored(spark, d).select("doc_id", "overall_score", "quality_grade")


@query
def quality_grades(spark, d):
    return _scored(spark, d).groupBy("quality_grade").agg(F.count("*").alias("documents"), F.round(F.avg("overall_score"), 4).alias("mean_score"))


@query
def quality_gate(spark, d):
    # Not a filter, which would be pushed below the scores and make them once more, without generated code.
    kept = F.when(F.col("overall_score") >= 0.25, F.col("overall_score"))
    return _scored(spark, d).agg(F.count(kept).alias("kept"), F.round(F.min(kept), 4).alias("least_score"))


def _extraction(spark, d):
    return Q.with_extraction_scores(_raw(spark, d), "content")


@query
def extraction_quality(spark, d):
    return _extraction(spark, d).select("doc_id", Q.rounded(F.col("overall_quality"), 4).alias("overall_quality"), "extraction_grade", "word_count", "sentence_count")


@query
def readability(spark, d):
    return _extraction(spark, d).select("doc_id", "readability")


@query
def structural_complexity(spark, d):
    return _extraction(spark, d).select("doc_id", "structural_complexity")


@query
def extraction_richness(spark, d):
    return _extraction(spark, d).select("doc_id", F.col("content_richness").alias("richness"))


@query
def extraction_run_stats(spark, d):
    q = F.col("overall_quality")
    r = lambda c: F.round(c, 4)
    return _extraction(spark, d).agg(
        F.count("*").alias("documents"), F.sum((F.col("word_count") > 0).cast("int")).alias("successes"), r(F.avg(q)).alias("avg_quality"), r(F.min(q)).alias("min_quality"),
        r(F.max(q)).alias("max_quality"), r(F.avg("lexical_diversity")).alias("avg_lexical"), r(F.avg("readability")).alias("avg_readability"),
    )


def _exact(spark, d):
    return dedup.exact_duplicates(_raw(spark, d), Tables(spark, "exact"))


@query
def exact_dedup(spark, d):
    return _exact(spark, d).where("ord = first_ord").select(F.col("ord").alias("doc_id"), F.substring("content_hash", 1, 12).alias("content_hash"))


@query
def exact_dup_pairs(spark, d):
    return _exact(spark, d).where("ord <> first_ord").select(F.lit("exact").alias("type"), F.col("ord").alias("removed"), F.col("first_ord").alias("kept"))


@query
def shingle_counts(spark, d):
    return dedup.shingle_table(_raw(spark, d)).select(F.col("ord").alias("doc_id"), F.col("n").alias("n_shingles"))


def _sets(spark, d):
    t = Tables(spark, "pairs")
    return t.save(dedup.shingle_table(_raw(spark, d)), "sets").where("n > 0"), t


def _pairs(spark, d, threshold):
    sets, t = _sets(spark, d)
    return dedup.fuzzy_pairs(sets, threshold, t)[0].select("i", "j", F.round("similarity", 6).alias("similarity"))


@query
def fuzzy_pairs(spark, d):
    """Pairs between the first documents of equal sets; fuzzy_members has the documents of each."""
    return _pairs(spark, d, 0.85)


@query
def fuzzy_pairs_half(spark, d):
    return _pairs(spark, d, 0.5)


@query
def fuzzy_members(spark, d):
    sets, t = _sets(spark, d)
    return dedup.equal_sets(sets, t).select(F.col("ord").alias("doc_id"), F.col("first_ord").alias("representative"))


def _keepers(spark, d, t):
    """Scored documents after exact duplicates are gone, as the similarity levels get them."""
    keep = dedup.exact_duplicates(_raw(spark, d), t).where("ord = first_ord").select("ord")
    return t.save(_scored(spark, d).where("size(words) > 4").select("ord", "content", "overall_score").join(keep, "ord", "left_semi"), "scored")


@query
def fuzzy_dedup(spark, d):
    t = Tables(spark, "fuzzy")
    return dedup.fuzzy_removals(_keepers(spark, d, t), t).select("i", "j", F.round("similarity", 6).alias("similarity"), "removed", "kept", "logged")


@query
def semantic_dedup(spark, d):
    t = Tables(spark, "semantic")
    return dedup.semantic_removals(_keepers(spark, d, t), t).select("i", "j", F.round("similarity", 6).alias("similarity"), "removed", "kept", "logged")


@query
def multi_level_dedup(spark, d):
    return _curated(spark, d).pairs.groupBy("type").agg(F.count("*").alias("removed"))


@query
def tfidf_top_terms(spark, d):
    df = _raw(spark, d)
    return tfidf.vocabulary(tfidf.ngrams(df), df.count(), max_features=50).select("term", "df", "cf")


@query
def semantic_pairs(spark, d):
    """Pairs between the first documents of equal texts; the term weights are those of all documents."""
    t = Tables(spark, "semantic-pairs")
    df = _raw(spark, d)
    first = df.groupBy(F.sha2("content", 256)).agg(F.min("ord").alias("ord")).select("ord")
    return tfidf.similar_vectors(tfidf.tfidf_weights(df, tables=t).join(first, "ord", "left_semi"), 0.80, t).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query
def domain_category(spark, d):
    return _raw(spark, d).groupBy(D.category(F.col("content")).alias("domain_category")).agg(F.count("*").alias("documents"))


@query
def domain_boost(spark, d):
    df = _scored(spark, d).withColumn("r", D.relevance(F.size("words"), F.col("term_count")))
    return df.select("doc_id", F.round("r", 4).alias("relevance"), F.round(D.boosted(F.col("overall_score"), F.col("r")), 6).alias("boosted_score"))


@query
def pii_redact(spark, d):
    df = _raw(spark, d).withColumn("r", D.redact(F.col("content")))
    return df.select("doc_id", F.md5("r").alias("redacted_md5"), (F.col("r") != F.col("content")).alias("pii_removed"))


@query
def pii_counts(spark, d):
    return _raw(spark, d).select(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in D.pii_counts(F.col("content")).items()] or [])


@query
def training_rank(spark, d):
    scored = _scored(spark, d).select("doc_id", "ord", "overall_score")
    return curation.ranks(scored, Tables(spark, "ranks"), "overall_score").select("doc_id", "training_rank")


@query
def curated_top_k(spark, d):
    return _scored(spark, d).orderBy(F.desc("overall_score"), "doc_id").limit(20).select("doc_id", "overall_score")


def _curated(spark, d, until="semantic"):
    return curation.curate(readers.documents_as_extracted(spread(_table(spark, d, "documents"))), until=until)


@query
def curated_dataset(spark, d):
    c = _curated(spark, d).curated
    return c.select(
        F.col("ord").alias("doc_id"), "id", "training_rank", F.md5("text").alias("text_md5"), "pii_removed", F.round("quality_score", 6).alias("quality_score"), "quality_grade",
        "domain_category", "source_info.word_count", "content_hash",
    )


@query
def stage_retention(spark, d):
    return curation.retention(_curated(spark, d).stages).select("stage", "documents", F.round("retention", 6).alias("retention"))


@query
def rejection_reasons(spark, d):
    return _curated(spark, d).rejections.groupBy("stage", "reason").agg(F.count("*").alias("documents"))


@query
def rejection_files(spark, d):
    """Rejections of the first stage, by file."""
    df = _prepared(spark, d).where("reason is not null")
    return df.select("doc_id", X.basename(F.col("file_path")).alias("filename"), "reason")


@query
def curation_metadata(spark, d):
    """The distributions of the metadata as rows, and the mean quality in ten-thousandths."""
    return _distributions(_curated(spark, d))


@query
def word_frequency(spark, d):
    return vocabulary.word_counts(_raw(spark, d), "content")


@query
def vocabulary_counters(spark, d):
    return word_frequency(spark, d).agg(F.sum("frequency").alias("total_words"), F.count("*").alias("unique_words"), F.sum((F.col("frequency") >= 200).cast("int")).alias("frequent_words"))


def _base_vocabulary(spark, d):
    """Words of the benchmark's items stand for a base vocabulary."""
    return vocabulary.word_counts(_table(spark, d, "benchmark")).select(F.col("word").alias("token"))


@query
def vocab_candidates(spark, d):
    return vocabulary.candidates(word_frequency(spark, d), _base_vocabulary(spark, d))


@query
def vocab_anti_join(spark, d):
    return word_frequency(spark, d).where("frequency >= 20").join(_base_vocabulary(spark, d), F.col("word") == F.col("token"), "left_anti")


@query
def vocab_semi_join(spark, d):
    return word_frequency(spark, d).where("frequency >= 20").join(_base_vocabulary(spark, d), F.col("word") == F.col("token"), "left_semi")


@query
def vocab_growth(spark, d):
    base = Tables(spark, "base").numbered(_base_vocabulary(spark, d), [F.col("token")], "id")
    return vocabulary.grown(base, word_frequency(spark, d).where("frequency >= 200"))


@query
def manual_tokens(spark, d):
    return vocabulary.manual_tokens(spark, word_frequency(spark, d).select(F.col("word").alias("token")), list(VocabularyConfig().manual_tokens)).select("token", "present")


def _counts(spark, d):
    return tokens.token_counts(_raw(spark, d), "content")


@query
def token_counts(spark, d):
    return _counts(spark, d).select("doc_id", "n_tokens")


@query
def token_stats(spark, d):
    s = tokens.corpus_stats(_counts(spark, d))
    return s.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


@query
def token_percentiles(spark, d):
    return tokens.percentiles(_counts(spark, d)).select("percentile", F.round("value", 4).alias("value"))


@query
def batch_estimates(spark, d):
    return tokens.batch_estimates(tokens.corpus_stats(_counts(spark, d)))


@query
def fixed_length_encode(spark, d):
    """Lengths of words as ids, to 64 places."""
    ids = F.transform(X.words(F.col("content")), F.length)
    return _raw(spark, d).select("doc_id", F.array_join(F.transform(tokens.fixed_length(ids, 64), lambda x: x.cast("string")), ",").alias("ids"))


@query
def training_tokens(spark, d):
    return _raw(spark, d).where(X.strip(F.col("content")) != "").agg(F.count("*").alias("rows"), (F.count("*") * 4096).alias("approximate_tokens"))


@query
def embedding_mean_by_group(spark, d):
    m = embeddings.mean_vectors(_table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("mean").alias("place", "x")).select("label", "place", F.round("x", 5).alias("mean"))


@query
def embedding_norm_check(spark, d):
    return embeddings.verify(_table(spark, d, "embeddings")).select("vec_id", F.round("norm", 5).alias("norm"), "is_zero")


@query
def embedding_zero_rows(spark, d):
    """Zero rows for the first label, the rows as they are for the others."""
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    z = embeddings.zero_rows(e.where("label = 0"), 64).unionByName(e.where("label <> 0").select("token", "embedding"))
    return embeddings.verify(z).agg(F.count("*").alias("rows"), F.sum(F.col("is_zero").cast("int")).alias("zero_rows"))


@query
def embedding_init_report(spark, d):
    e = _table(spark, d, "embeddings")
    base = e.select(F.col("vec_id").alias("id"), "embedding")
    new = e.groupBy(F.col("label").alias("token")).agg(F.array_sort(F.collect_list("vec_id")).alias("piece_ids"))
    return embeddings.init_report(embeddings.initialise(new, base, 64), embeddings.zero_rows(new, 64))


@query
def train_val_split(spark, d):
    return training.split_rows(_raw(spark, d), "content").select("doc_id", "split")


def _losses(spark, d):
    return _table(spark, d, "events").select("event_type", "event_id", "value")


@query
def loss_monitor(spark, d):
    return training.loss_monitor(_losses(spark, d), "event_type", "event_id", "value").select("event_id", "initial_loss", "best_loss", "is_spike", "is_explosion")


@query
def early_stopping(spark, d):
    return training.early_stopping(_losses(spark, d), "event_type", "event_id", "value").select("event_id", "improved", "waited", "stop_step")


@query
def model_loss_summary(spark, d):
    s = evaluation.loss_summary(_losses(spark, d).withColumn("loss", F.col("value") / 100), "event_type", "loss")
    return s.select("model", "n", F.round("avg_loss", 6).alias("avg_loss"), F.round("perplexity", 4).alias("perplexity"))


@query
def improvement_verdict(spark, d):
    v = evaluation.verdicts(evaluation.loss_summary(_losses(spark, d), "event_type", "value"), "view")
    return v.select("model", F.round("improvement_pct", 4).alias("improvement_pct"), "verdict", "init_ok")


@query
def loss_boxplot(spark, d):
    q = evaluation.loss_quartiles(_losses(spark, d), "event_type", "value")
    return q.select("model", *[F.round(c, 4).alias(c) for c in q.columns[1:]])


def _responses(spark, d):
    """Turns as responses; the fixture has no times, so a turn's number gives one."""
    return _table(spark, d, "conversations").withColumn("seconds", F.col("turn") * 0.37)


@query
def response_metrics(spark, d):
    return _responses(spark, d).select("conv_id", "turn", "role", *[v.alias(k) for k, v in evaluation.response_metrics(F.col("text"), F.col("seconds")).items()])


@query
def response_speed_up(spark, d):
    rates = _responses(spark, d).withColumn("r", evaluation.response_metrics(F.col("text"), F.col("seconds"))["words_per_second"])
    by = rates.groupBy("conv_id").agg(F.round(F.avg(F.when(F.col("role") == "user", F.col("r"))), 4).alias("a"), F.round(F.avg(F.when(F.col("role") == "assistant", F.col("r"))), 4).alias("b"))
    s = evaluation.speed_up(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)), "user", "assistant")
    return by.select("conv_id", s["faster"].alias("faster"), F.round(s["ratio"], 3).alias("ratio"))


@query
def response_table(spark, d):
    t = _responses(spark, d).select(F.col("conv_id").cast("string").alias("prompt"), "role", F.length("text").alias("n"))
    return evaluation.response_table(t, "prompt", "role", "n", ["assistant", "system", "user"])


@query
def html_text(spark, d):
    return _table(spark, d, "pages").select("page_id", F.md5(markup.html_text(F.col("html"))).alias("text_md5"))


@query
def html_tables(spark, d):
    return _table(spark, d, "pages").select("page_id", F.size(markup.html_tables(F.col("html"))).alias("tables"))


@query
def markdown_tables(spark, d):
    t = markup.markdown_tables(_raw(spark, d), "doc_id", "content")
    return t.select("doc_id", "table_no", F.md5("content").alias("content_md5"), "row_count")


@query
def latex_equations(spark, d):
    e = _raw(spark, d).select("doc_id", F.posexplode(markup.equations(F.col("content"))).alias("place", "e"))
    return e.select("doc_id", "place", "e.type", F.md5("e.latex").alias("latex_md5"))


@query
def text_pattern_tables(spark, d):
    t = _raw(spark, d).select("doc_id", markup.table_of_lines(F.split("content", "\n")).alias("t"))
    t = Tables(spark, "text-tables").save(t, "found").where(F.size("t") > 0)  # written, or the filter would find the tables once more
    return t.select("doc_id", F.size("t").alias("rows"), F.md5(markup.flat_table(F.col("t"))).alias("flat_md5"), markup.valid_table(F.col("t")).alias("valid"))


@query
def validation_sample(spark, d):
    return readers.sample(_raw(spark, d), "doc_id", "content", 100, longer_than=50).select("doc_id", F.length("content").alias("n_chars"))


@query
def json_roundtrip(spark, d):
    k = F.from_json("props", "k long")
    return _table(spark, d, "events").select("event_id", k["k"].alias("k"), F.to_json(k).alias("json"))


@query
def optional_predicates(spark, d):
    c = F.col("content")
    return _raw(spark, d).select("doc_id", c.rlike(P.LOW_INFORMATION).alias("low_information"))


@query
def optional_predicate_cases(spark, d):
    rows = [(1, "abababababab"), (2, "abcabcabcabcabc"), (3, "x" * 6), (4, "plain prose"), (5, "start " + "twenty characters xx" * 5), (6, "twenty characters xx" * 4), (7, "")]
    t = F.col("t")
    return _cases(spark, rows, "id long, t string").select("id", t.rlike(P.LOW_INFORMATION).alias("low_information"), t.rlike(P.REPETITIVE).alias("repetitive"))


@query
def document_stats(spark, d):
    df = readers.documents_as_extracted(_table(spark, d, "documents"))
    s = reports.document_stats(F.col("pages"), F.size("tables"), F.col("images_detected"))
    return df.select(F.col("ord").alias("doc_id"), s.alias("s")).select("doc_id", "s.*")


@query
def extraction_success(spark, d):
    df = readers.documents_as_extracted(_table(spark, d, "documents")).withColumn("extraction_success", X.strip(F.col("pages")["0"]["text"]) != "")
    return reports.extraction_success(df)


@query
def word_count_range(spark, d):
    return reports.word_count_range(_raw(spark, d).select(F.size(X.words(F.col("content"))).alias("word_count")))


@query
def pretrain_check(spark, d):
    """The vocabulary is the benchmark's words, the matrix has the embeddings' rows."""
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return reports.pretrain_check(e, _base_vocabulary(spark, d).count(), e.count())


@query
def doc_word_frequency(spark, d):
    """Lower-cased words of each document, counted."""
    # Texts are dealt by document, so that words are counted where they are made, and no table of words is shuffled.
    texts = _table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content")).repartition("doc_id")
    w = texts.select("doc_id", F.explode(X.words(F.lower("content"))).alias("word"))
    return w.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query
def early_retention(spark, d):
    """Retention up to exact duplicates."""
    r = curation.retention(_curated(spark, d, until="exact").stages).where("k <= 3")
    return r.select("stage", "documents", F.round("retention", 6).alias("retention"))


@query
def early_rejections(spark, d):
    """Rejections of the stages up to exact duplicates, by stage and reason."""
    r = _curated(spark, d, until="exact").rejections
    return r.groupBy("stage", "reason").agg(F.count("*").alias("documents"), F.sum("word_count").cast("long").alias("words"))


@query
def early_metadata(spark, d):
    """The same up to exact duplicates."""
    return _distributions(_curated(spark, d, until="exact"))


def _rows_of_maps(df, **columns):
    """(kind, name, n) of a one-row table's maps."""
    out = None
    for kind, c in columns.items():
        part = df.select(F.lit(kind).alias("kind"), F.explode(c).alias("name", "n"))
        out = part if out is None else out.unionByName(part)
    return out


def _distributions(c):
    m = Tables(c.left.sparkSession, "metadata").save(curation.metadata(c).drop("curation_date"), "row")
    mean = m.select(F.lit("quality").alias("kind"), F.lit("mean").alias("name"), F.round(F.col("average_quality") * 10_000).cast("long").alias("n"))
    return _rows_of_maps(m, domain="domain_distribution", grade="quality_distribution", pairs="deduplication_stats").unionByName(mean)


@query
def early_training_rows(spark, d):
    """Training rows up to exact duplicates, by rank, with their redacted texts."""
    c = _curated(spark, d, until="exact").curated
    return c.select(F.col("ord").alias("doc_id"), "training_rank", F.md5("text").alias("text_md5"), "pii_removed", "domain_category")


@query
def early_reason_files(spark, d):
    """Files of each reason of the first stage, in lists of a hundred or so, told by their number and a digest of the names."""
    r = _prepared(spark, d).where("reason is not null").select("reason", X.basename(F.col("file_path")).alias("filename"))
    files = reports.reason_files(r, 100).select("reason", F.explode("files").alias("f"))
    return files.groupBy("reason").agg(F.count("*").alias("files"), F.sum(F.col("f").cast("long")).alias("ids"))


@query
def curation_statistics(spark, d):
    s = Tables(spark, "statistics").save(curation.statistics(_curated(spark, d)), "row")
    return _rows_of_maps(s, stages="stages", rejections="rejections_by_stage", reasons="rejections_by_reason", pairs="duplicate_pairs")


@query
def curation_report(spark, d):
    r = curation.report(_curated(spark, d), {"all": 0.0})
    return r.select("input_documents", "final_documents", F.round("retention_rate", 6).alias("retention_rate"), F.round("quality_analysis.mean", 4).alias("mean_quality"), "quality_analysis.documents_with_personal_data")


@query
def extraction_statistics(spark, d):
    df = _extraction(spark, d).withColumn("extraction_success", F.col("word_count") > 0).withColumn("total_pages", F.lit(1))
    s = reports.extraction_statistics(df)
    tenths = [F.coalesce(F.try_element_at("quality_tenths", F.lit(i)), F.lit(0).cast("long")).alias(f"t{i}") for i in range(10)]
    return s.select("files", "successful", *[F.round(c, 4).alias(c) for c in ("mean_quality", "least_quality", "largest_quality")], *tenths)


@query
def model_comparison(spark, d):
    """Event types stand for models; one of them has no losses."""
    s = evaluation.loss_summary(_losses(spark, d), "event_type", "value")
    c = evaluation.comparison(s, ("view", "click", "none"))
    return c.select("place", "model", "exists", "n", F.round("avg_loss", 4).alias("avg_loss"), F.round("improvement_pct", 4).alias("improvement_pct"))


@query
def embedding_report(spark, d):
    e = _table(spark, d, "embeddings")
    new = e.groupBy(F.col("label").alias("token")).agg(F.array_sort(F.collect_list("vec_id")).alias("piece_ids"))
    rows = embeddings.initialise(new, e.select(F.col("vec_id").alias("id"), "embedding"), 64)
    r = reports.embedding_report(rows, embeddings.zero_rows(new, 64), 3)
    return r.select("new_tokens", "initialised", "zeroed", "passed", F.posexplode("samples").alias("place", "s")).select(
        "new_tokens", "initialised", "zeroed", "passed", "place", "s.token", F.round("s.norm", 4).alias("norm")
    )


@query
def manual_embedding_fallback(spark, d):
    """A token without pieces gets the mean of all base rows."""
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    new = spark.createDataFrame([("pieces", [0, 1]), ("none", [])], "token string, piece_ids array<long>")
    rows = embeddings.initialise(new, e, 64, fallback="mean")
    return rows.select("token", "initialised", F.posexplode("embedding").alias("place", "x")).select("token", "initialised", "place", F.round("x", 5).alias("x"))


def _cases(spark, rows, schema):
    """Hand-made rows, where no table of the fixture has the case."""
    return spark.createDataFrame(rows, schema)


@query
def markdown_table_cases(spark, d):
    text = "before\n| a | b |\n|---|---|\n| 1 | 2 |\nbetween\n  | c |  \n| 3 |"
    t = markup.markdown_tables(_cases(spark, [(1, text), (2, "no table | here"), (3, "| x |")], "doc_id long, content string"), "doc_id", "content")
    return t.select("doc_id", "table_no", "content", "row_count")


@query
def html_table_cases(spark, d):
    rows = [(1, "<p>x</p><TABLE border=1><tr><td>1</td></tr>\n</TABLE><table></table>"), (2, "<p>none</p>"), (3, "<table> not closed")]
    return _cases(spark, rows, "page_id long, html string").select("page_id", F.size(markup.html_tables(F.col("html"))).alias("tables"))


@query
def pii_cases(spark, d):
    rows = [(1, "call 555-123-4567 or 5551234567"), (2, "id 123-45-6789."), (3, "4111 1111 1111 1111"), (4, "10.0.0.1 a.b@c.org"), (5, "nothing 12-34")]
    return _cases(spark, rows, "id long, t string").select("id", D.redact(F.col("t")).alias("redacted"), (D.redact(F.col("t")) != F.col("t")).alias("pii_removed"))


@query
def near_image_cases(spark, d):
    image = "array<struct<width: int, height: int>>"
    rows = [(1, [(100, 50), (102, 53), (105, 50), (8, 90)]), (2, []), (3, [(11, 11), (300, 11), (15, 15)])]
    return _cases(spark, rows, f"id long, images {image}").select("id", F.to_json(markup.near_images(F.col("images"))).alias("images"))


@query
def page_summary_cases(spark, d):
    rows = [(1, [3, 1, 3]), (2, [1, 2, 3, 4, 5, 6]), (3, []), (4, [9, 8, 7, 6, 5])]
    return _cases(spark, rows, "id long, pages array<int>").select("id", markup.page_summary(F.col("pages")).alias("summary"))


@query
def unique_table_cases(spark, d):
    rows = [(1, 1, 2, 2, 0), (1, 1, 2, 2, 1), (1, 2, 2, 2, 2), (1, 1, 3, 2, 3), (2, 1, 2, 2, 4)]
    t = markup.unique_tables(_cases(spark, rows, "doc_id long, page int, rows int, cols int, place int"), "doc_id", "place")
    return t.select("doc_id", "page", "place")


@query
def added_table_cases(spark, d):
    """Tables that further parsers add: the first new one of each strategy on a page; the last parser's only for pages without any."""
    schema = "doc_id long, page int, strategy int, place int, rows int, cols int"
    known = _cases(spark, [(1, 1, 0, 0, 2, 2)], schema)
    found = _cases(spark, [(1, 1, 1, 0, 2, 2), (1, 1, 1, 1, 3, 2), (1, 1, 1, 2, 4, 2), (1, 1, 2, 0, 3, 2), (1, 1, 3, 0, 5, 5), (1, 2, 1, 0, 2, 2)], schema)
    last = _cases(spark, [(1, 1, 9, 0, 7, 7), (1, 3, 9, 0, 7, 7), (1, 4, 9, 0, 7, 7)], schema)
    pages = _cases(spark, [(1, 1, "x" * 60), (1, 3, "x" * 60), (1, 4, "x" * 50)], "doc_id long, page int, text string")
    new = reports.new_tables(found, known)
    return new.unionByName(reports.fallback_tables(last, known.unionByName(new), pages))


@query
def block_table_cases(spark, d):
    rows = [(1, 0, "a\tb\nc\td"), (1, 1, "one line\tonly"), (2, 0, "x | y\n1 | 2\n3 | 4"), (2, 1, "plain\nprose")]
    t = reports.block_tables(_cases(spark, rows, "doc_id long, block int, text string"), ["doc_id", "block"])
    return t.select("doc_id", "block", markup.flat_table(F.col("data")).alias("flat"), "rows", "cols", "confidence")


@query
def grid_box_cases(spark, d):
    grid = [(1, 0.0, float(y), 9.0, float(y) + 1) for y in (0, 5, 9)] + [(1, float(x), 0.0, float(x), 9.0) for x in (0, 4, 9)]
    rows = grid + [(2, 0.0, 0.0, 9.0, 0.0)] * 3
    g = reports.grid_box(_cases(spark, rows, "page_id long, x0 double, y0 double, x1 double, y1 double"), "page_id")
    return g.select("page_id", "rows", "cols", F.array_join(F.transform("bbox", lambda v: v.cast("int").cast("string")), ",").alias("bbox"))


@query
def unicode_cases(spark, d):
    rows = [(1, "\ufb01ne \uff11\uff12 line"), (2, "soft\u00adhyphen and\u200bspace"), (3, "plain  text   here")]
    return _cases(spark, rows, "id long, t string").select("id", X.normalise_content(F.col("t")).alias("normalised"))


@query
def element_cases(spark, d):
    schema = "filename string, place int, type string, text string, text_as_html string"
    rows = [("a", 1, "Title", "Head", None), ("a", 2, "Table", "1 2", "<table>1 2</table>"), ("a", 0, "Text", " ", None), ("b", 0, "Table", "only", "")]
    out = readers.elements_as_documents(_cases(spark, rows, schema))
    return out.select("filename", "text", F.array_join(F.transform("tables", lambda t: t["content"]), "; ").alias("tables"), "element_count")


@query
def page_key_cases(spark, d):
    """A row that cannot be processed is rejected with its error, and leaves the others alone."""
    words = "It is a sentence of several words about a table. " * 8
    rows = [(1, "a/x.json", {"0": (words,), "10": ("The last page.",), "2": ("The middle page.",)}, [], 0, 3), (2, "a/y.json", {"zero": (words,)}, [], 0, 1)]
    schema = "ord long, file_path string, pages map<string, struct<text: string>>, tables array<struct<data: array<array<string>>>>, images_detected int, total_pages int"
    p = curation.prepare(_cases(spark, rows, schema), curation.CurationConfig())
    return p.select("ord", "reason", F.instr("original_content", "middle") .alias("middle"), F.instr("original_content", "last").alias("last"))


def _files(spark, name, files):
    """A folder in the shared place with these small files, by name."""
    t = Tables(spark, name)
    for file, content in files.items():
        writers.text_file(spark, f"{t.root}/{file}", content)
    return t.root


@query
def document_file_cases(spark, d):
    """Files of all formats in one folder; a broken one is a failed record."""
    word = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + word.format("First") + word.format("Second part") + "</w:body></w:document>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    files = {"a.txt": "plain text\nof two lines", "b.html": "<html><head><title>no</title></head><body><p>A &amp; B</p><script>x</script></body></html>",
             "c.docx": buffer.getvalue(), "d.docx": b"broken", "e.pdf": b"one page", "f.pdf": b"\xff", "g.md": "not read"}
    df = readers.document_files(spark, _files(spark, "formats", files), _ascii)
    return df.select(X.basename(F.col("file_path")).alias("file"), "extraction_method", "extraction_success", F.col("error").isNotNull().alias("has_error"), F.try_element_at("pages", F.lit("0"))["text"].alias("text"))


def _ascii(data: bytes) -> str:
    """Stands for a PDF parser."""
    return data.decode("ascii")


@query
def extracted_json_cases(spark, d):
    page = {"text": "words", "word_count": 1}
    good = {"file_path": "a/good.pdf", "extraction_success": True, "pages": {"0": page}, "total_pages": 1}
    files = {"good.json": good, "failed.json": {**good, "extraction_success": False}, "empty.json": {**good, "pages": {}}, "unsaid.json": {"file_path": "x", "pages": {"0": page}}}
    folder = _files(spark, "extracted", {**{k: json.dumps(v, indent=2) for k, v in files.items()}, "broken.json": "{", "other.txt": json.dumps(good)})
    return readers.extracted_json(spark, folder).select("file_path", F.size("pages").alias("pages"), "total_pages")


@query
def json_lines_cases(spark, d):
    lines = ['{"text": "one"}', "", '{"content": "two"}', "not json", '{"text": "", "content": "three"}', '{"text": ""}', '{"other": 1}', '{"text": "last", "content": "x"}']
    folder = _files(spark, "lines", {"rows.jsonl": "\n".join(lines)})
    every = readers.json_lines(spark, folder).select(F.lit("all").alias("kind"), "text")
    return every.unionByName(readers.json_lines(spark, folder, limit=5).select(F.lit("first five").alias("kind"), "text"))


@query
def gzip_training_rows(spark, d):
    """Training lines are compressed unless that is turned off."""
    t, rows = _reread(spark, d, "gzip")
    writers.training_lines(rows, f"{t.root}/gz")
    writers.training_lines(rows, f"{t.root}/plain", compressed=False)
    name = lambda p: spark.read.format("binaryFile").load(f"{t.root}/{p}").where(F.col("length") > 0).select(F.lit(p).alias("kind"), F.col("path").endswith(".json.gz").alias("gz"))
    files = name("gz").unionByName(name("plain")).groupBy("kind").agg(F.bool_and("gz").alias("gz"))
    counts = spark.read.json(f"{t.root}/gz").select(F.lit("gz").alias("kind")).unionByName(spark.read.json(f"{t.root}/plain").select(F.lit("plain").alias("kind"))).groupBy("kind").agg(F.count("*").alias("rows"))
    return files.join(counts, "kind")


@query
def table_append_cases(spark, d):
    """Several pages in numeric order, and tables under their numbers over all tables."""
    grid, blank = [["a", None], ["1", "2"]], [[" ", None]]
    rows = [(1, "x/1.json", {"0": ("The first page.",), "2": ("The third page.",), "1": ("short",)}, [(grid,), (blank,), (grid,)], 0, 3)]
    schema = "ord long, file_path string, pages map<string, struct<text: string>>, tables array<struct<data: array<array<string>>>>, images_detected int, total_pages int"
    return curation.prepare(_cases(spark, rows, schema), curation.CurationConfig()).select("ord", "original_content")


@query
def shown_pair_cases(spark, d):
    """Pairs are shown if there are ten at most."""
    ten, eleven = spark.range(10).toDF("k"), spark.range(11).toDF("k")
    return reports.shown_pairs(ten).agg(F.count("*").alias("ten")).join(reports.shown_pairs(eleven).agg(F.count("*").alias("eleven")), F.lit(True))


@query
def embedding_resize(spark, d):
    """Rows that the vocabulary has beyond the matrix get the mean of all its rows."""
    e = _table(spark, d, "embeddings").where("vec_id < 100").select(F.col("vec_id").alias("id"), "embedding")
    rows = embeddings.resized(e, spark.range(102))
    return rows.select("id", F.posexplode("embedding").alias("place", "x")).select("id", "place", F.round("x", 5).alias("x"))


@query
def training_steps(spark, d):
    """Steps of a run over the training rows, whether they are few, and what is advised about two configurations."""
    n = _raw(spark, d).where(X.strip(F.col("content")) != "").agg(F.count("*").alias("n"))
    steps = training.step_counts(F.col("n"), 2, 8, 3)
    advice = [training.config_advice(2e-4, 3), training.config_advice(1e-3, 9)]
    return n.select("n", training.small_set(F.col("n")).alias("small"), *[v.cast("long").alias(k) for k, v in steps.items()], *[F.lit(len(a)).alias(f"warnings_{k}") for k, a in enumerate(advice)])


@query
def model_registry_cases(spark, d):
    rows = [("a", "org/a", True), ("b", "org/b", False), ("c", "org/c", True)]
    models = _cases(spark, rows, "model string, path string, enabled boolean")
    chosen = evaluation.enabled_models(models, ["a", "b"]).select("model", F.lit(True).alias("chosen"))
    return evaluation.model_info(models).join(chosen, "model", "left").select("model", "info", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query
def configuration_cases(spark, d):
    """A file's settings, those of its section before those at its top, over the defaults."""
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".yaml") as f:  # settings are read on the driver
        f.write("min_words_per_doc: 10\nmin_quality_score: 0.5\ncuration:\n  min_quality_score: 0.75\n  unknown: 1\n")
        f.flush()
        cfg = config.load(config.CurationConfig, f.name, "curation")
    return _cases(spark, [(cfg.min_words_per_doc, cfg.min_quality_score, cfg.min_sentences_per_doc)], "words int, quality double, sentences int")


def _reread(spark, d, what):
    """Training rows that the writers leave, read back."""
    t = Tables(spark, what)
    return t, t.numbered(_scored(spark, d).select("doc_id", F.col("content").alias("text"), "overall_score"), [F.desc("overall_score"), F.col("doc_id")], "rank").withColumn("training_rank", F.col("rank").cast("int") + 1)


@query
def training_lines_read_back(spark, d):
    t, rows = _reread(spark, d, "training-lines")
    writers.training_lines(rows, f"{t.root}/lines")
    back = readers.json_lines(spark, f"{t.root}/lines")
    return back.select(F.md5("text").alias("text_md5"), F.length("text").alias("n_chars")).groupBy("text_md5", "n_chars").agg(F.count("*").alias("rows"))


@query
def limited_lines_read_back(spark, d):
    """The first 100 lines of the benchmark as JSON lines, in order; blank ones count."""
    t = Tables(spark, "limited-lines")
    b = _table(spark, d, "benchmark").orderBy("item_id").select(F.when(F.col("item_id") % 7 == 0, "").otherwise(F.col("text")).alias("text"))
    b.coalesce(1).write.json(f"{t.root}/lines")
    return readers.json_lines(spark, f"{t.root}/lines", limit=30).select(F.md5("text").alias("text_md5"))


@query
def document_files_read_back(spark, d):
    t = Tables(spark, "document-files")
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    docs = _raw(spark, d).select(path.alias("file_path"), F.struct(F.col("content").alias("text")).alias("page"))
    written = t.save(writers.document_files(docs, f"{t.root}/files"), "written")
    files = readers.named_files(written.select(F.concat("stem", F.lit(".json")).alias("name")), f"{t.root}/files")
    back = files.select(F.from_json("body", "file_path string, page struct<text: string>").alias("d")).select("d.*")
    return back.select(X.basename(F.col("file_path")).alias("filename"), F.md5("page.text").alias("text_md5"))


@query
def dataset_read_back(spark, d):
    """Documents as a dataset with metadata, as split files, and both read again."""
    t = Tables(spark, "datasets")
    rows = t.save(training.split_rows(_raw(spark, d), "content").select("split", F.col("content").alias("text")), "rows")
    writers.split_files(rows, f"{t.root}/splits")
    data = readers.json_dataset(spark, train=f"{t.root}/splits/split=train", validation=f"{t.root}/splits/split=validation")
    return data.groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("n_chars"))


@query
def vocabulary_files_read_back(spark, d):
    t = Tables(spark, "vocabulary-files")
    writers.vocabulary(word_frequency(spark, d).where("frequency >= 200"), t.root)
    return spark.read.text(f"{t.root}/words").select(F.col("value").alias("word")).join(spark.read.schema("word string, frequency long").json(f"{t.root}/candidates"), "word")
