"""Tables and equations in text, markdown and HTML; table validity and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def _cells(line: Column, separator: str, least: int) -> Column:
    parts = F.split(line, separator)
    return F.when(F.size(parts) >= least, F.filter(F.transform(parts, strip), lambda c: c != ""))


def table_of_lines(lines: Column) -> Column:
    """Rows of cells of a table that stands in text lines; empty if there is none.

    Separators in turn: tab, bar, two spaces (three parts), three spaces; the first that gives two cells counts. Rows within one
    cell of the mean width stay.
    """
    found = lambda c: F.when(F.size(c) >= 2, c)
    row = lambda x: F.coalesce(found(_cells(x, "\t", 2)), found(_cells(x, r"\|", 2)), found(_cells(x, "  ", 3)), found(_cells(x, "   ", 2)))
    rows = F.filter(F.transform(lines, row), lambda r: r.isNotNull())
    mean = F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(r)) / F.greatest(F.size(rows), F.lit(1))
    near = F.filter(rows, lambda r: F.abs(F.size(r) - mean) <= 1)
    none = F.array().cast("array<array<string>>")
    return F.when((F.size(lines) >= 2) & (F.size(rows) >= 2) & (F.size(near) >= 2), near).otherwise(none)


def valid_table(data: Column) -> Column:
    """Two rows, two columns, and 15 % of the first three rows' cells filled."""
    widths = F.transform(F.filter(data, lambda r: F.size(r) > 0), F.size)
    total = F.aggregate(F.slice(widths, 1, 3), F.lit(0), lambda a, x: a + x)
    filled = lambda c: c.isNotNull() & ~F.lower(strip(c)).isin("", "none", "null")
    n = F.aggregate(F.slice(data, 1, 3), F.lit(0), lambda a, r: a + F.size(F.filter(r, filled)))
    ok = (F.size(data) >= 2) & (F.coalesce(F.array_max(widths), F.lit(0)) >= 2) & (n / F.greatest(total, F.lit(1)) >= 0.15)
    return F.coalesce(data.isNotNull() & ok, F.lit(False))


def flat_table(data: Column) -> Column:
    """Cells joined by bars, rows by newlines; blank cells and rows go."""
    full = lambda c: c.isNotNull() & (strip(c) != "")
    rows = F.transform(data, lambda r: F.array_join(F.transform(F.filter(r, full), strip), " | "))
    return F.array_join(F.filter(rows, lambda r: r != ""), "\n")


def unique_tables(tables: DataFrame, doc: str, place: str) -> DataFrame:
    """The first table of each document, page, row and column count."""
    k = F.row_number().over(Window.partitionBy(doc, "page", "rows", "cols").orderBy(place))
    return tables.withColumn("_k", k).where("_k = 1").drop("_k")


def markdown_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, content, row_count): runs of lines that begin and end with a bar."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line")).withColumn("line", strip(F.col("line")))
    inside = lines.where(F.col("line").startswith("|") & F.col("line").endswith("|"))
    inside = inside.withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy(key).orderBy("no")))
    runs = inside.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l"))
    runs = runs.withColumn("table_no", F.row_number().over(Window.partitionBy(key).orderBy(F.col("l")[0]["no"])))
    return runs.select(key, "table_no", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"), (F.size("l") - 1).alias("row_count"))


def equations(text: Column) -> Column:
    """Inline equations, then display equations, as structs (type, latex)."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("type"), strip(x).alias("latex")))

    return F.concat(of("inline", r"\$([^$]+)\$"), of("display", r"\$\$([^$]+)\$\$"))


def html_tables(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<table.*?</table>"), F.lit(0))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, block ends become blank lines, tags go, entities are read."""
    t = html
    for tag in ("script", "style", "head"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|h[1-6]|li|ul|ol|table|tr|section|article|blockquote|pre|title)\s*>|<br\s*/?>", "\n\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for name, mark in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(mark))
    blocks = F.filter(F.transform(F.split(t, "\n\n"), lambda b: strip(F.regexp_replace(b, r"\s+", " "))), lambda b: b != "")
    return F.array_join(blocks, "\n\n")


def near_images(images: Column) -> Column:
    """Images in order, without those of 10 units or less and those within 5 units of an earlier one in width and height."""
    far = lambda kept, x: ~F.exists(kept, lambda k: (F.abs(k["width"] - x["width"]) < 5) & (F.abs(k["height"] - x["height"]) < 5))
    add = lambda kept, x: F.when((x["width"] > 10) & (x["height"] > 10) & far(kept, x), F.concat(kept, F.array(x))).otherwise(kept)
    return F.aggregate(images, F.slice(images, 1, 0), add)


def page_summary(pages: Column) -> Column:
    """Distinct pages: up to five listed, else first and last."""
    p = F.array_sort(F.array_distinct(pages))
    named = F.transform(p, lambda x: x.cast("string"))
    return F.when(F.size(p) <= 5, F.array_join(named, ",")).otherwise(F.concat(F.lit("P"), F.element_at(named, 1), F.lit("-"), F.element_at(named, -1)))
