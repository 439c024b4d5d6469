"""Operator 5, token-id output: length-delimited binary records with masked checksums, and an offset index per file.

Documents are dealt out by ranges of doc_id; each task writes one record file and one index file in the shared folder, under
a name of its own attempt that is renamed when complete, so a task that runs twice or dies leaves no half file behind. The
reader opens the record files, verifies each checksum, and numbers the ids over all files from the files' token counts (one
row per file, gathered by the driver).

Defined cases: a null text is an empty text (its record holds the end id only); rows of equal doc_id go by their text's hash,
and rows equal in both stand next to each other; a null doc_id sorts first; a very long text is one record, as any other; strings
of special tokens are ordinary text unless ``special_ids`` is set; an empty table writes no file; further columns are not read.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records
from .common import KEY, Scratch, input_bytes, load_documents, row_key, text_or_empty
from .tokens import encoder

FILE_BYTES = 128 << 20
FILES_DDL = "file_no long, path string, n_docs long, n_tokens long"
ROWS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long, file_no long, offset long"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, data: list[bytes]) -> None:
    """Writes under an attempt's name, then renames; a complete file of the same name is as good as this one."""
    attempt = f"{uri}.{uuid.uuid4().hex}.attempt"
    filesystem, path = _filesystem(attempt)
    with filesystem.open_output_stream(path) as out:
        for d in data:
            out.write(d)
    filesystem.move(path, _filesystem(uri)[1])


def _writer(folder: str, tokenizer: str, end_id: int, special_ids: bool):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        enc = encoder(tokenizer, special_ids)
        dtype = np.dtype("<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4")
        no = TaskContext.get().partitionId()
        uri = f"{folder}/part-{no:06d}.rec"
        attempt = f"{uri}.{uuid.uuid4().hex}.attempt"
        filesystem, path = _filesystem(attempt)
        filesystem.create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
        out, index, at, total = None, [], 0, 0
        for b in batches:
            ids = [np.append(x, np.uint32(end_id)) for x in enc.encode(b["text"].tolist())]
            framed = records.frame([x.astype(dtype).tobytes() for x in ids])
            out = out or filesystem.open_output_stream(path)
            out.write(b"".join(framed))
            sizes = np.array([len(f) for f in framed])
            entry = np.zeros(len(b), records.INDEX_ENTRY)
            entry["doc_id"], entry["n_tokens"] = b["k_id"].to_numpy(), [len(x) for x in ids]
            entry["offset"] = at + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            index.append(entry)
            at, total = at + int(sizes.sum()), total + int(entry["n_tokens"].sum())
        if out:
            out.close()
            head = records.INDEX_MAGIC + np.array([dtype.itemsize, sum(map(len, index))], "<i8").tobytes()
            _put(f"{folder}/part-{no:06d}.idx", [head, *(e.tobytes() for e in index)])
            filesystem.move(path, _filesystem(uri)[1])
            yield pd.DataFrame({"file_no": [no], "path": [uri], "n_docs": [sum(map(len, index))], "n_tokens": [total]})

    return write


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None,
    special_ids: bool = False,
) -> DataFrame:
    """Writes record and index files in ascending doc_id order; returns a row per file: file_no, path, n_docs, n_tokens.

    Files are as many as the session's shuffle partitions, and more where one would be made of over FILE_BYTES of input.
    """
    n = files or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // FILE_BYTES))
    rows = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY)
    return dealt.select("k_id", "text").mapInPandas(_writer(folder, tokenizer, end_id, special_ids), FILES_DDL)


def read_index(uri: str) -> tuple[int, np.ndarray]:
    """Bytes of an id, and the entries (doc_id, offset, n_tokens) of an index file."""
    filesystem, path = _filesystem(uri)
    data = filesystem.open_input_stream(path).read()
    if data[:8] != records.INDEX_MAGIC:
        raise records.CorruptRecord(f"{uri} is no index")
    width, n = np.frombuffer(data, "<i8", 2, 8)
    return int(width), np.frombuffer(data, records.INDEX_ENTRY, int(n), 24)


def read_record(rec_uri: str, offset: int, width: int) -> np.ndarray:
    """The ids of the record at an offset: a shuffled read."""
    filesystem, path = _filesystem(rec_uri)
    with filesystem.open_input_file(path) as f:
        f.seek(offset)
        length = int(np.frombuffer(f.read(8), "<u8")[0])
        f.seek(offset)
        (data,) = next(records.unframe(io.BytesIO(f.read(16 + length))))
    return np.frombuffer(data, f"<u{width}")


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for no, path, before in zip(b["file_no"], b["path"], b["tokens_before"]):
            width, index = read_index(path.removesuffix(".rec") + ".idx")
            filesystem, name = _filesystem(path)
            at, start = 0, int(before)
            with filesystem.open_input_stream(name) as stream:
                for parts in records.unframe(stream):
                    ids = [np.frombuffer(p, f"<u{width}").astype("<u4") for p in parts]
                    own, n = index[at : at + len(parts)], np.array([len(x) for x in ids], np.int64)
                    if not np.array_equal(own["n_tokens"], n):
                        raise records.CorruptRecord(f"{path} and its index differ")
                    starts = start + np.concatenate(([0], np.cumsum(n)[:-1]))
                    crc = [zlib.crc32(x.tobytes()) for x in ids]
                    doc_id = pd.array(own["doc_id"], dtype="Int64")
                    doc_id[own["doc_id"] == -(2**63)] = pd.NA
                    yield pd.DataFrame({"doc_id": doc_id, "start": starts, "n_tokens": n, "ids_crc32": crc, "file_no": no, "offset": own["offset"]})
                    at, start = at + len(parts), start + int(n.sum())


def read_records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """A row per document from the files themselves, numbered over all of them."""
    found = sorted(files.collect(), key=lambda r: r.file_no)  # a row per file
    before, rows = 0, []
    for r in found:
        rows.append((r.file_no, r.path, before))
        before += r.n_tokens
    listed = spark.createDataFrame(rows, "file_no long, path string, tokens_before long")
    return listed.repartition(max(1, len(rows))).mapInPandas(_reader, ROWS_DDL)


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "records")
    files = write_records(load_documents(spark, sf_dir), f"{scratch.root}/files", public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_records(spark, scratch.save(files, "listing")).select("doc_id", "start", "n_tokens", "ids_crc32", "file_no", "offset")
