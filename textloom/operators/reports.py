"""Statistics of extracted documents and runs, pre-training checks, and upkeep of run folders."""

from __future__ import annotations

import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .embeddings import init_report, verify
from .markup import table_of_lines


def document_stats(pages: Column, n_tables: Column, n_images: Column) -> Column:
    """Totals of a document: words of all pages, tables, images, pages."""
    total = F.aggregate(F.map_values(pages), F.lit(0), lambda a, p: a + F.size(words(F.coalesce(p["text"], F.lit("")))))
    return F.struct(total.alias("total_words"), n_tables.alias("total_tables"), n_images.alias("total_images"), F.size(F.map_keys(pages)).alias("total_pages"))


def extraction_success(df: DataFrame, elements: str = "total_pages") -> DataFrame:
    """One row: files, successes, failures, elements, their mean, the success rate in per cent."""
    ok = F.coalesce("extraction_success", F.lit(False)).cast("int")
    n = F.count("*")
    return df.agg(
        n.alias("files"), F.coalesce(F.sum(ok), F.lit(0)).alias("successful"), (n - F.coalesce(F.sum(ok), F.lit(0))).alias("failed"), F.coalesce(F.sum(elements), F.lit(0)).alias("elements"),
        F.coalesce(F.avg(elements), F.lit(0.0)).alias("mean_elements"), (F.coalesce(F.sum(ok), F.lit(0)) * 100.0 / F.greatest(n, F.lit(1))).alias("success_rate"),
    )


def word_count_range(df: DataFrame, count: str = "word_count") -> DataFrame:
    """One row: least, most and total words."""
    return df.agg(F.min(count).alias("min"), F.max(count).alias("max"), F.sum(count).alias("total"))


def shown_pairs(pairs: DataFrame, most: int = 10) -> DataFrame:
    """The pairs to show: all of them if there are at most so many, else none."""
    some = pairs.limit(most + 1)
    few = some.agg((F.count("*") <= most).alias("few"))  # one row
    return some.join(F.broadcast(few), F.col("few")).drop("few")


def grid_box(lines: DataFrame, key: str, tolerance: float = 2.0) -> DataFrame:
    """The box of each grid that drawn lines (x0, y0, x1, y1) make: at least three each way; its one cell is a placeholder."""
    flat, upright = F.abs(F.col("y0") - F.col("y1")) < tolerance, F.abs(F.col("x0") - F.col("x1")) < tolerance
    by = lines.groupBy(key).agg(
        F.sum(flat.cast("int")).alias("h"), F.sum(upright.cast("int")).alias("v"), F.min(F.least("x0", "x1")).alias("x0"), F.min(F.least("y0", "y1")).alias("y0"),
        F.max(F.greatest("x0", "x1")).alias("x1"), F.max(F.greatest("y0", "y1")).alias("y1"),
    )
    cell = F.array(F.array(F.lit("Grid table detected")))
    return by.where("h >= 3 and v >= 3").select(key, cell.alias("data"), F.lit(1).alias("rows"), F.lit(1).alias("cols"), F.array("x0", "y0", "x1", "y1").alias("bbox"))


def new_tables(found: DataFrame, known: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Tables of a further parser that no known table of the same page, row and column count stands for.

    found: (doc, page, strategy, place, rows, cols, ...). Each strategy adds the first such table of a page; of tables of one
    shape that several strategies add, the one of the first strategy stays.
    """
    fresh = found.join(known.select(doc, "page", "rows", "cols").distinct(), [doc, "page", "rows", "cols"], "left_anti")
    first = lambda df, by, order: df.groupBy(*by).agg(F.min(F.struct(*order, *[c for c in found.columns if c not in (*by, *order)])).alias("t")).select(*by, "t.*")
    each = first(fresh, [doc, "page", "strategy"], ["place"])
    return first(each, [doc, "page", "rows", "cols"], ["strategy", "place"]).select(*found.columns)


def fallback_tables(found: DataFrame, known: DataFrame, pages: DataFrame, doc: str = "doc_id", longer_than: int = 50) -> DataFrame:
    """Tables of a last parser, for pages (doc, page, text) that have none yet and a text of more than so many characters."""
    long = pages.where(F.length("text") > longer_than).select(doc, "page")
    return found.join(long, [doc, "page"], "left_semi").join(known.select(doc, "page").distinct(), [doc, "page"], "left_anti")


def block_tables(blocks: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Tables that stand in text blocks (key, text): data, rows, cols, confidence medium; blocks of under two rows have none."""
    t = blocks.withColumn("data", table_of_lines(F.split(text, "\n"))).where(F.size("data") >= 2)
    cols = F.array_max(F.transform("data", F.size))
    return t.select(*key, "data", F.size("data").alias("rows"), cols.alias("cols"), F.lit("medium").alias("confidence"))


def reason_files(rejections: DataFrame, chunk: int = 1000) -> DataFrame:
    """(reason, part, files): the file names of each reason, sorted, in lists of at most about ``chunk``.

    Names are dealt to parts by their hash, by the reason's count, so no reason's names stand in one list, however many there are.
    """
    n = rejections.groupBy("reason").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    dealt = rejections.join(n, "reason").withColumn("part", F.pmod(F.xxhash64("filename"), F.col("parts")).cast("int"))
    return dealt.groupBy("reason", "part").agg(F.array_sort(F.collect_list("filename")).alias("files"))


def as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One row: a small table (a row per grade, stage, reason kind) as a map, sorted by key."""
    return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def extraction_statistics(df: DataFrame, quality: str = "overall_quality") -> DataFrame:
    """One row: extraction_success' totals, mean, least and largest quality, and how many documents each tenth of quality has."""
    ok, q = F.coalesce("extraction_success", F.lit(False)).cast("int"), F.col(quality)
    tenths = df.groupBy(F.least(F.floor(q * 10), F.lit(9)).cast("int").alias("tenth")).agg(
        F.count("*").alias("n"), F.sum(ok).alias("ok"), F.sum("total_pages").alias("elements"), F.count("total_pages").alias("counted"),
        F.sum(q).alias("quality"), F.count(q).alias("scored"), F.min(q).alias("least"), F.max(q).alias("largest"),
    )  # a row for each tenth; documents are scored once
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    listed = F.collect_list(F.when(F.col("tenth").isNotNull(), F.struct("tenth", "n")))
    return tenths.agg(
        total("n").alias("files"), total("ok").alias("successful"), (total("n") - total("ok")).alias("failed"), total("elements").alias("elements"),
        F.coalesce(F.try_divide(F.sum("elements"), F.sum("counted")), F.lit(0.0)).alias("mean_elements"), (total("ok") * 100.0 / F.greatest(total("n"), F.lit(1))).alias("success_rate"),
        F.try_divide(F.sum("quality"), F.sum("scored")).alias("mean_quality"), F.min("least").alias("least_quality"), F.max("largest").alias("largest_quality"),
        F.map_from_entries(F.array_sort(listed)).alias("quality_tenths"),
    )


def embedding_report(input_rows: DataFrame, output_rows: DataFrame, samples: int = 5) -> DataFrame:
    """One row: init_report's counts, and the norms of the first tokens as samples."""
    first = verify(input_rows).orderBy("token").limit(samples)
    shown = first.agg(F.array_sort(F.collect_list(F.struct("token", F.round("norm", 6).alias("norm"), "initialised"))).alias("samples"))
    return init_report(input_rows, output_rows).join(shown, F.lit(True))  # one row each


def pretrain_check(rows: DataFrame, tokenizer_size: int, matrix_rows: int, first: int = 3, least: float = 1e-6) -> DataFrame:
    """One row: the first new embedding rows (by id) are not zero, and the vocabulary has as many entries as the matrix rows."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    some = rows.orderBy("id").limit(first)
    return some.agg(F.coalesce(F.bool_and(norm >= least), F.lit(False)).alias("rows_ok"), F.lit(tokenizer_size == matrix_rows).alias("sizes_ok"))


def missing_files(folder: str, required: list[str]) -> list[str]:
    return [f for f in required if not (Path(folder) / f).exists()]


def clean_run(folder: str, outputs: list[str], backup: bool = True) -> str | None:
    """Removes a run's outputs from a driver-side folder, after a copy beside it; returns the copy's place."""
    root = Path(folder)
    there = [root / o for o in outputs if (root / o).exists()]
    place = None
    if backup and there:
        place = root / f"backup_{datetime.now():%Y%m%d_%H%M%S}"
        place.mkdir()
        for p in there:
            shutil.copytree(p, place / p.name) if p.is_dir() else shutil.copy2(p, place / p.name)
    for p in there:
        shutil.rmtree(p) if p.is_dir() else p.unlink()
    return str(place) if place else None


def folder_bytes(folder: str) -> int:
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())
