"""Readers: extracted JSON, JSON lines, text, HTML, DOCX and PDF folders, in one schema of extracted documents."""

from __future__ import annotations

import importlib.util
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.markup import html_text, near_images, valid_table
from ..operators.reports import document_stats
from ..schemas import EXTRACTED
from ..storage import spread


def available(*libraries: str) -> dict[str, bool]:
    """Which optional libraries can be imported."""
    return {x: importlib.util.find_spec(x) is not None for x in libraries}


def extracted_json(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose extraction succeeded and that have pages; broken files are skipped."""
    schema = f"{EXTRACTED}, _corrupt string"
    df = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(folder)
    return df.where(F.col("_corrupt").isNull() & F.coalesce("extraction_success", F.lit(False)) & (F.size("pages") > 0)).drop("_corrupt")


def json_lines(spark: SparkSession, path: str, field: Column | None = None, limit: int | None = None) -> DataFrame:
    """(text) of JSON lines: text, or content where that is empty; broken and empty lines are skipped.

    limit: only so many lines are read, in order of files and places in them, blank and broken ones among them.
    """
    schema = "text string, content string, _corrupt string"
    if limit is None:
        df = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
        first = lines.orderBy("f", "b", "m").limit(limit)
        df = first.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    both = F.coalesce(F.nullif("text", F.lit("")), F.nullif("content", F.lit("")))
    return df.where(F.col("_corrupt").isNull()).select((field if field is not None else both).alias("text")).where(F.col("text").isNotNull())


def named_files(names: DataFrame, folder: str, at_once: int = 256) -> DataFrame:
    """(name, body): these UTF-8 files of a shared folder (names: name), read by the executors.

    For folders of a file a document whose names are known: Spark's readers would list every file and send the list to the driver.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for b in batches:
            for k in range(0, len(b), at_once):
                some, bodies = b["name"].iloc[k : k + at_once], []
                for name in some:
                    with system.open_input_stream(f"{root}/{name}") as f:
                        bodies.append(f.read().decode("utf-8"))
                yield pd.DataFrame({"name": some.to_numpy(), "body": bodies})

    return spread(names.select("name")).mapInPandas(read, "name string, body string")


def json_dataset(spark: SparkSession, **splits: str) -> DataFrame:
    """(split, text) of JSON-lines files by split, as in json_dataset(spark, train=..., validation=...)."""
    parts = [json_lines(spark, path).select(F.lit(name).alias("split"), "text") for name, path in splits.items()]
    out = spark.createDataFrame([], "split string, text string")
    for p in parts:
        out = out.unionByName(p)
    return out


def elements_as_documents(elements: DataFrame) -> DataFrame:
    """(filename, text, tables, element_count) of a parser's elements (filename, place, type, text, text_as_html).

    Texts are joined by blank lines in order; a table's content is its HTML, or its text where it has none.
    """
    own = F.col("type") == "Table"
    content = F.coalesce(F.nullif("text_as_html", F.lit("")), "text")
    by = elements.groupBy("filename").agg(
        F.array_sort(F.collect_list(F.when(F.coalesce(F.trim("text"), F.lit("")) != "", F.struct("place", "text")))).alias("t"),  # at most a document's elements
        F.array_sort(F.collect_list(F.when(own, F.struct("place", content.alias("content"))))).alias("k"),
        F.count("*").cast("int").alias("element_count"),
    )
    tables = F.transform("k", lambda x: F.struct(x["content"].alias("content"), F.lit("table").alias("type")))
    return by.select("filename", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"), tables.alias("tables"), "element_count")


def sample(df: DataFrame, ord_col: str, text: str, limit: int, longer_than: int = 0) -> DataFrame:
    """The first rows by order, then those of them whose stripped text is longer."""
    return df.orderBy(ord_col).limit(limit).where(F.length(strip(F.coalesce(F.col(text), F.lit("")))) > longer_than)


def clean_page_text(c: Column) -> Column:
    """Without NUL and U+FFFD; stripped lines, blank ones dropped."""
    lines = F.transform(F.split(F.regexp_replace(c, "[\\x00\\uFFFD]", ""), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def as_extracted(df: DataFrame, path: Column, text: Column, method: str) -> DataFrame:
    """One page per document, in the schema of extracted documents."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    no = F.lit(0)
    page = F.struct(text.alias("text"), words.alias("word_count"), no.alias("table_count"), no.alias("image_count"), F.lit(False).alias("has_tables"), F.lit(False).alias("has_images"))
    one = df.select(
        path.alias("file_path"), F.lit(method).alias("extraction_method"), F.lit(True).alias("extraction_success"), F.lit(None).cast("string").alias("error"),
        F.create_map(F.lit("0"), page).alias("pages"), F.lit(0).alias("images_detected"), F.lit(1).alias("total_pages"),
    )
    empty = df.sparkSession.createDataFrame([], EXTRACTED)
    return empty.unionByName(one, allowMissingColumns=True)


def failed(df: DataFrame, path: Column, error: Column) -> DataFrame:
    """Records of documents that could not be read."""
    one = df.select(path.alias("file_path"), F.lit("failed").alias("extraction_method"), F.lit(False).alias("extraction_success"), error.alias("error"))
    return df.sparkSession.createDataFrame([], EXTRACTED).unionByName(one, allowMissingColumns=True)


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return as_extracted(df, F.col("_metadata.file_path"), F.col("value"), "text")


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    return as_extracted(df, F.col("_metadata.file_path"), html_text(F.col("value")), "html")


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file joined by blank lines."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def _parsed(parser):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows.append((path, parser(bytes(content)), None))
                except Exception as e:  # noqa: BLE001  a broken file is a record of its own
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return parse


def binary_files(spark: SparkSession, folder: str, pattern: str, parser, method: str) -> DataFrame:
    """Files through a parser (bytes to text) on the executors; failures stay, as failed records."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    df = df.mapInPandas(_parsed(parser), "path string, text string, error string")
    good = as_extracted(df.where("error is null"), F.col("path"), clean_page_text(F.col("text")), method)
    return good.unionByName(failed(df.where("error is not null"), F.col("path"), F.col("error")))


#: What a page parser gives for a file, as JSON: texts by page, tables and images with their pages (from 1 on).
PARSED = (
    "pages array<string>, tables array<struct<page: int, strategy: int, data: array<array<string>>, bbox: array<double>>>, "
    "images array<struct<page: int, xref: int, width: int, height: int, bbox: array<double>>>"
)


def _parsed_pages(parser, enrichers):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    found = parser(bytes(content))
                    more = [{**t, "strategy": k} for k, f in enumerate(enrichers, 1) for t in f(bytes(content), found)]
                    rows.append((path, json.dumps({**found, "tables": [{**t, "strategy": 0} for t in found.get("tables", [])] + more}), None))
                except Exception as e:  # noqa: BLE001  a broken file is a record of its own
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "found", "error"])

    return parse


def page_files(spark: SparkSession, folder: str, pattern: str, parser, enrichers: tuple = (), method: str = "pages") -> DataFrame:
    """Files through a page parser of the caller's, on the executors, as extracted documents with pages, tables and images.

    parser: bytes to a dict of PARSED's fields; enrichers: (bytes, that dict) to further tables, in order. Page texts are cleaned.
    Tables that are not valid go; an enricher adds the first valid table of a page whose shape no table of an earlier step has on
    that page. Images of 10 units or less, and near copies of an earlier one, go. A file that cannot be read, or that has no page,
    is a failed record.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    df = raw.mapInPandas(_parsed_pages(parser, tuple(enrichers)), "path string, found string, error string")
    df = df.select("path", "error", F.from_json("found", PARSED).alias("f"))
    none = F.coalesce("error", F.when(F.size(F.coalesce("f.pages", F.array().cast("array<string>"))) == 0, "no pages"))
    good, bad = df.where(none.isNull()), df.where(none.isNotNull())
    no_tables = F.array().cast("array<struct<page: int, strategy: int, data: array<array<string>>, bbox: array<double>>>")
    valid = F.filter(F.coalesce("f.tables", no_tables), lambda t: valid_table(t["data"]))
    width = lambda t: F.coalesce(F.array_max(F.transform(t["data"], F.size)), F.lit(0))
    same = lambda a, b: (a["page"] == b["page"]) & (F.size(a["data"]) == F.size(b["data"])) & (width(a) == width(b))

    def add(kept, t):
        taken = F.exists(kept, lambda k: same(k, t) | ((k["page"] == t["page"]) & (k["strategy"] == t["strategy"])))
        return F.when((t["strategy"] == 0) | ~taken, F.concat(kept, F.array(t))).otherwise(kept)

    tables = F.aggregate(F.array_sort(valid, lambda a, b: a["strategy"] - b["strategy"]), F.slice(valid, 1, 0), add)
    images = near_images(F.coalesce("f.images", F.array().cast("array<struct<page: int, xref: int, width: int, height: int, bbox: array<double>>>")))
    df = good.select("path", F.col("f.pages").alias("p"), tables.alias("t"), images.alias("i"))

    def page(text, no):
        clean = clean_page_text(F.coalesce(text, F.lit("")))
        k, n = (F.size(F.filter(c, lambda x: x["page"] == no + 1)) for c in ("t", "i"))
        words = F.size(F.filter(F.split(clean, r"\s+"), lambda x: x != ""))
        return F.struct(clean.alias("text"), words.alias("word_count"), k.alias("table_count"), n.alias("image_count"), (k > 0).alias("has_tables"), (n > 0).alias("has_images"))

    own = F.when(F.lit(True), F.lit(method))
    table = lambda t, k: F.struct(
        k.alias("table_id"), t["page"].alias("page"), F.when(t["strategy"] == 0, own).otherwise(F.concat(own, F.lit("_enricher_"), t["strategy"].cast("string"))).alias("method"),
        t["data"].alias("data"), F.lit(None).cast("string").alias("content"), F.size(t["data"]).alias("rows"), width(t).alias("cols"), t["bbox"].alias("bbox"),
        F.when(t["strategy"] == 0, "high").otherwise("medium").alias("confidence"),
    )
    image = lambda x, k: F.struct(
        k.alias("image_id"), x["page"].alias("page"), own.alias("method"), x["xref"].alias("xref"), x["width"].alias("width"), x["height"].alias("height"), x["bbox"].alias("bbox")
    )
    no = F.transform(F.col("p"), lambda _, k: k.cast("string"))
    one = df.select(
        F.col("path").alias("file_path"), own.alias("extraction_method"), F.lit(True).alias("extraction_success"), F.lit(None).cast("string").alias("error"),
        F.map_from_arrays(no, F.transform("p", page)).alias("pages"), F.transform("t", table).alias("tables"), F.transform("i", image).alias("images"),
        F.size("i").alias("images_detected"), F.size("p").alias("total_pages"),
    )
    one = one.withColumn("document_stats", document_stats(F.col("pages"), F.size("tables"), F.size("images")))
    return spark.createDataFrame([], EXTRACTED).unionByName(one, allowMissingColumns=True).unionByName(failed(bad, F.col("path"), none))


def docx_files(spark: SparkSession, folder: str) -> DataFrame:
    return binary_files(spark, folder, "*.docx", docx_text, "docx")


def pdf_files(spark: SparkSession, folder: str, parser=None, page_parser=None, enrichers: tuple = ()) -> DataFrame:
    """PDF files through a parser of the caller's, as no PDF library is among the requirements.

    parser: a file's bytes to its text; or page_parser and enrichers, as page_files takes them.
    """
    if page_parser is not None:
        return page_files(spark, folder, "*.pdf", page_parser, enrichers, "pdf")
    if parser is None:
        raise ValueError("pdf_files needs a parser: a function from a file's bytes to its text, or to its pages")
    return binary_files(spark, folder, "*.pdf", parser, "pdf")


def document_files(spark: SparkSession, folder: str, pdf_parser=None) -> DataFrame:
    """All formats of a folder: PDF, DOCX, HTML, text, in that order."""
    parts = ([pdf_files(spark, folder, pdf_parser)] if pdf_parser else []) + [f(spark, folder) for f in (docx_files, html_files, text_files)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def documents_as_extracted(df: DataFrame) -> DataFrame:
    """The documents table as extracted documents, one page each, ord and source kept."""
    text = F.coalesce("text", F.lit(""))
    page = F.create_map(F.lit("0"), F.struct(text.alias("text")))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    none = F.array().cast("array<struct<data: array<array<string>>>>")
    return df.select(F.col("doc_id").alias("ord"), path.alias("file_path"), page.alias("pages"), none.alias("tables"), F.lit(0).alias("images_detected"), F.lit(1).alias("total_pages"))


def stem(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1])
