"""Operator 1, SentencePiece encoding and decoding: a max-plus parallel scan over the piece lattice.

Texts up to ``giant`` characters are encoded where they are. Giant documents are split into chunks that are dealt over the
cluster: each chunk yields its boundary-state transfer matrix, a document's matrices are combined associatively, and each chunk
is backtraced independently from its own two edge states. ``piece_model`` says why the best path is the model's BPE encoding.

Defined cases: a null text has no ids and decodes to an empty text; rows of equal id and text share one result and are each
given back, a null id as null; an empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, KEY_DDL, Scratch, load_documents, row_key, text_or_empty
from .piece_model import best_states, model

GIANT_CHARS = 65_536
CHUNK_CHARS = 8_192
CODES_DDL = f"{KEY_DDL}, n_chars long, ids binary, score double"
#: A row per chunk: its text with a piece's length of text around it, and where the chunk begins in that.
CHUNKS_DDL = f"{KEY_DDL}, n_chars long, chunk int, at int, text string"


def _short(path: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            ids = [m.encode(t) for t in b["text"]]
            out = b[KEY].copy()
            out["n_chars"] = [len(t) for t in b["text"]]
            out["ids"], out["score"] = [x.tobytes() for x in ids], [float(m.scores[x].sum()) for x in ids]
            yield out

    return encode


def _split(path: str, chunk: int):
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            for k_id, k_text, text in zip(b["k_id"], b["k_text"], b["text"]):
                whole, rows = m.normalise(text), []
                for no, a in enumerate(range(0, len(whole), chunk)):
                    first = max(0, a - m.longest)
                    rows.append((k_id, k_text, len(text), no, a - first, whole[first : a + chunk + m.longest]))
                yield pd.DataFrame(rows, columns=[*KEY, "n_chars", "chunk", "at", "text"])

    return split


def _edges(text: str, at: int, chunk: int) -> tuple[int, int]:
    """The chunk's place in its row: the text goes on by a piece's length unless the document ends first."""
    return at, min(at + chunk, len(text))


def _transfer(path: str, chunk: int):
    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            mats = [m.transfer(t, *_edges(t, at, chunk)) for t, at in zip(b["text"], b["at"])]
            out = b[[*KEY, "chunk"]].copy()
            out["rows"], out["matrix"] = [x.shape[0] for x in mats], [x.astype("<f8").tobytes() for x in mats]
            yield out

    return transfer


def _combine(group: pd.DataFrame) -> pd.DataFrame:
    """One document's edge states; its matrices are a few bytes for each chunk of a text that was one row."""
    group = group.sort_values("chunk")
    mats = [np.frombuffer(x, "<f8").reshape(n, -1) for n, x in zip(group["rows"], group["matrix"])]
    out = group[[*KEY, "chunk"]].copy()
    out[["entry", "leave"]] = best_states(mats)
    return out


def _backtrace(path: str, chunk: int):
    def backtrace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            ids = [m.backtrace(t, *_edges(t, at, chunk), x, y) for t, at, x, y in zip(b["text"], b["at"], b["entry"], b["leave"])]
            out = b[[*KEY, "n_chars", "chunk"]].copy()
            out["ids"], out["score"] = [x.tobytes() for x in ids], [float(m.scores[x].sum()) for x in ids]
            yield out

    return backtrace


def _join(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("chunk")
    first = group.iloc[0]
    return pd.DataFrame([(first.k_id, first.k_text, first.n_chars, b"".join(group["ids"]), float(group["score"].sum()))], columns=[*KEY, "n_chars", "ids", "score"])


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT_CHARS, chunk: int = CHUNK_CHARS
) -> DataFrame:
    """A row per document: key, n_chars, ids (unsigned 32-bit little-endian), score (the sum of the pieces' scores)."""
    rows = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text"))
    short = rows.where(F.length("text") <= giant).mapInPandas(_short(path), CODES_DDL)
    scratch = Scratch(docs.sparkSession, "pieces")
    giants = rows.where(F.length("text") > giant).dropDuplicates(KEY)
    # The copies of a giant document are encoded once, and counted so that each is given back.
    counts = rows.where(F.length("text") > giant).groupBy(*KEY).agg(F.count("*").alias("copies"))
    chunks = scratch.save(giants.mapInPandas(_split(path, chunk), CHUNKS_DDL).repartition(*KEY, "chunk"), "chunks")
    matrices = chunks.mapInPandas(_transfer(path, chunk), f"{KEY_DDL}, chunk int, rows int, matrix binary")
    states = matrices.groupBy(*KEY).applyInPandas(_combine, f"{KEY_DDL}, chunk int, entry int, leave int")
    traced = chunks.join(states, [*KEY, "chunk"]).select(*KEY, "n_chars", "chunk", "at", "text", "entry", "leave")
    parts = traced.mapInPandas(_backtrace(path, chunk), f"{KEY_DDL}, n_chars long, chunk int, ids binary, score double")
    whole = parts.groupBy(*KEY).applyInPandas(_join, CODES_DDL)
    again = whole.join(counts, KEY).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return short.unionByName(again.select(*KEY, "n_chars", "ids", "score"))


def _decoder(path: str):
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            b["text"] = [m.decode(np.frombuffer(x, "<u4")) for x in b["ids"]]
            yield b

    return decode


def decode_documents(codes: DataFrame, path: str) -> DataFrame:
    """Adds the decoded text; byte pieces that form no UTF-8 become U+FFFD."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInPandas(_decoder(path), f"{ddl}, text string")


def _digest(path: str):
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for b in batches:
            out = pd.DataFrame({"doc_id": pd.array(b["k_id"], dtype="Int64"), "n_chars": b["n_chars"]})
            out.loc[b["k_id"].to_numpy() == -(2**63), "doc_id"] = pd.NA
            out["n_ids"], out["ids_crc32"] = [len(x) // 4 for x in b["ids"]], [zlib.crc32(x) for x in b["ids"]]
            out["score"] = b["score"].to_numpy()
            data = [m.decode(np.frombuffer(x, "<u4")).encode("utf-8", "surrogatepass") for x in b["ids"]]
            out["decoded_bytes"], out["decoded_crc32"] = [len(x) for x in data], [zlib.crc32(x) for x in data]
            yield out

    return digest


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its ids' number and checksum, their score, and size and checksum of the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    codes = encode_documents(load_documents(spark, sf_dir), path)
    ddl = "doc_id long, n_chars long, n_ids long, ids_crc32 long, score double, decoded_bytes long, decoded_crc32 long"
    return codes.mapInPandas(_digest(path), ddl)  # decodes as decode_documents does, in one Python process less
