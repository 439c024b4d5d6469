"""Operator 2, media columns: progressive JPEG.

Scans are accumulated into coefficient arrays, inverse-transformed in numpy, chroma is upsampled, and full-resolution RGB
tensors are stored (raw bytes with height and width). ``bytes_to_media`` keeps any payload losslessly as the quantised
coefficients of a progressive file, one 8-bit unit a byte; ``decode_media`` reads files back.

Defined cases: a null text is an empty text (a payload of 192 spaces); a null or broken medium gives null features and its error
in ``error``; equal payloads give equal media; repeated rows and rows of a null id are each given back; whole texts are kept,
however long; an empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load_documents, text_or_empty
from .progressive_jpeg import decode, encode_bytes, payload_of, to_rgb

UNIT = 192
RGB = T.StructType().add("height", T.IntegerType()).add("width", T.IntegerType()).add("rgb", T.BinaryType()).add("error", T.StringType())


def pad_payload(data: bytes) -> bytes:
    """Spaces up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


@F.pandas_udf(T.BinaryType())
def bytes_to_media(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: encode_bytes(pad_payload(t.encode("utf-8", "surrogatepass"))))


@F.pandas_udf(RGB)
def decode_media(media: pd.Series) -> pd.DataFrame:
    """RGB tensors of a column of progressive files."""
    rows = []
    for m in media:
        try:
            rgb = to_rgb(decode(bytes(m)))
            rows.append((rgb.shape[0], rgb.shape[1], rgb.tobytes(), None))
        except Exception as e:  # noqa: BLE001  a broken file is a row's state
            rows.append((None, None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["height", "width", "rgb", "error"]).astype({"height": "Int32", "width": "Int32"})


def rgb_feature(rgb: np.ndarray) -> str:
    """Size, channel means and a 4 x 4 luma mosaic as hex digits."""
    h, w, _ = rgb.shape
    total = rgb.reshape(-1, 3).sum(0, dtype=np.int64)
    rows, cols = np.arange(5) * h // 4, np.arange(5) * w // 4
    green = np.add.reduceat(np.add.reduceat(rgb[..., 1], rows[:4], 0, np.int64), cols[:4], 1, np.int64)
    mean = green // (np.diff(rows)[:, None] * np.diff(cols)[None, :])
    return f"{h}x{w}:" + ",".join(f"{t / (h * w):.3f}" for t in total) + ":" + bytes(mean.astype(np.uint8).ravel()).hex()


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, n, media in zip(b["doc_id"], b["n_bytes"], b["media"]):
            media = bytes(media)
            frame = decode(media)
            payload = payload_of(frame)
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), rgb_feature(to_rgb(frame))))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


READ_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    stored = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), bytes_to_media("text").alias("media"))
    return stored.mapInPandas(_read_back, READ_DDL)
