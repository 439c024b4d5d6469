"""Helpers shared by the training-data operators: inputs, scratch tables, row keys, word hashing."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and 0x09 to 0x0D, in any encoding position (ASCII only).
WHITESPACE = " \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in WHITESPACE]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are wide rows: fewer of them go to a Python worker at a time, unless the session says otherwise."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return _own_folder()
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


#: Shuffle files are cleared away after jobs of so many seconds.
RELEASE_S = 2


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.began, self.labels = spark, 0.0, []
        self.root = f"{shared_dir(spark).rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Writes df and gives it back as read from there; the finished job's shuffle files are released."""
        path, schema, self.began = f"{self.root}/{label}", df.schema, time.monotonic()
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        del df
        self.labels.append(label)
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, label: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep_only(self, *labels: str) -> None:
        """Drops all tables but these: those that what is handed on is still read from."""
        for label in self.labels:
            if label not in labels:
                self.drop(label)
        self.labels = [x for x in self.labels if x in labels]

    def release(self) -> None:
        """Spark deletes shuffle files once nothing refers to their plan; the driver's collectors are asked to notice.

        The first collection ends what refers to a finished plan, the second finds that its shuffles are free. Jobs of less than
        RELEASE_S seconds leave little and wait for the next.
        """
        if time.monotonic() - self.began < RELEASE_S:
            return
        gc.collect()
        for _ in range(2):
            self.spark._jvm.System.gc()
            time.sleep(0.15)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns that name a row wherever it is read: its id (null: the least long) and its text's hash.

    Rows with equal id and equal text are the same document and get the same decisions.
    """
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("k_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k_text"),
    ]


KEY = ["k_id", "k_text"]
KEY_DDL = "k_id long, k_text long"


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def input_bytes(docs: DataFrame) -> int:
    """The size that Spark's plan gives for docs: that of the files it reads, without reading them."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ascii_lower(data: bytes) -> bytes:
    """Lower-cases A to Z only."""
    return data.translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _MULTIPLIER, np.uint64))))


def powers(n: int) -> np.ndarray:
    return _powers(1 << max(8, int(n).bit_length()))[: n + 1]


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word of data and its 64-bit hash; words are runs of bytes other than WHITESPACE."""
    buf = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[buf]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = (buf[inside[1:-1].view(bool)].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[at]
    return starts, mix(np.add.reduceat(terms, first) ^ lengths.astype(np.uint64))


def hash_words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of many texts, and where each text's words end in them."""
    starts, hashes = hash_words(b"\n".join(texts))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return hashes, np.searchsorted(starts, np.cumsum(sizes))
