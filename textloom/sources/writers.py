"""Writers: training rows, datasets with metadata, statistics, vocabularies, splits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def training_lines(curated: DataFrame, path: str, compressed: bool = True) -> None:
    """JSON lines {text} in rank order: files are ranges of ranks, so their names' order is the rows' order."""
    rows = curated.repartitionByRange("training_rank").sortWithinPartitions("training_rank").select("text")
    w = rows.write.mode("overwrite")
    (w.option("compression", "gzip") if compressed else w).json(path)


def dataset(curated: DataFrame, metadata: DataFrame, path: str) -> None:
    curated.write.mode("overwrite").parquet(f"{path}/documents")
    metadata.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def extracted_json(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def report(rows: DataFrame, path: str) -> None:
    """A table of few rows (statistics, reports) as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def vocabulary(candidates: DataFrame, path: str) -> None:
    """Ranked words as text and as JSON."""
    ordered = candidates.orderBy(F.desc("frequency"), "word")
    ordered.select("word").write.mode("overwrite").text(f"{path}/words")
    ordered.write.mode("overwrite").json(f"{path}/candidates")


def split_files(rows: DataFrame, path: str) -> None:
    """train and validation rows as JSON lines {text}."""
    rows.select("split", "text").write.mode("overwrite").partitionBy("split").json(path)


def json_file(row: DataFrame, path: str) -> None:
    """A report of one row as one indented JSON file, in any folder that Spark can write to."""
    (only,) = row.select(F.to_json(F.struct(*[F.col(c) for c in row.columns]), {"ignoreNullFields": "false"}).alias("j")).collect()
    _put(row.sparkSession, path, json.dumps(json.loads(only.j), indent=2, ensure_ascii=False))


def text_file(spark: SparkSession, path: str, text: str | bytes) -> None:
    _put(spark, path, text)


def _put(spark: SparkSession, path: str, text: str | bytes) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text if isinstance(text, bytes) else text.encode("utf-8")))
    finally:
        out.close()


def document_files(docs: DataFrame, folder: str, path: str = "file_path") -> DataFrame:
    """One indented <stem>.json for each document, written by the executors; gives (stem, bytes).

    Of documents with equal stems the last by path stays. Files are renamed when complete, so a task may run twice. folder: a
    place that the driver and the executors share.
    """
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    body = F.to_json(F.struct(*[F.col(c) for c in docs.columns]))
    rows = docs.groupBy(name.alias("stem")).agg(F.max_by(body, path).alias("body"))
    return rows.mapInPandas(_write_files(folder), "stem string, bytes long")


def _write_files(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for b in batches:
            sizes = []
            for stem, body in zip(b["stem"], b["body"]):
                data = json.dumps(json.loads(body), indent=2, ensure_ascii=False).encode("utf-8")
                attempt = f"{root}/.{stem}.{uuid.uuid4().hex}"
                with system.open_output_stream(attempt) as out:
                    out.write(data)
                system.move(attempt, f"{root}/{stem}.json")
                sizes.append(len(data))
            yield pd.DataFrame({"stem": b["stem"], "bytes": sizes})

    return write


def curation_files(c, path: str, seconds: dict[str, float] | None = None) -> None:
    """All that a curation run leaves: dataset with metadata, training lines, rejections, statistics, files by reason, pairs, report."""
    from ..operators.reports import reason_files
    from ..plans import curation

    dataset(c.curated, curation.metadata(c), f"{path}/dataset")
    training_lines(c.curated, f"{path}/training")
    c.rejections.write.mode("overwrite").json(f"{path}/rejections")
    reason_files(c.rejections).write.mode("overwrite").json(f"{path}/files_by_reason")
    c.pairs.write.mode("overwrite").json(f"{path}/duplicate_pairs")
    json_file(curation.statistics(c), f"{path}/statistics.json")
    json_file(curation.report(c, seconds), f"{path}/report.json")
