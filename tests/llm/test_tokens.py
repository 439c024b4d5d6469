"""Operators 1, 5 and 7: exact ids, files, packing."""

import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from textloom.llm import packing, piece_model, records, sentencepiece_codec, token_output, tokens  # noqa: E402

PARTS = ["a", "b", "e", "'s", "'", "The", "ing", " ", "  ", "\n", "\t", "é", "漢", "Ａ", "😀", "ΑΣ", "1", "23", "=", "--", "    ", "ß", "\x85", "\xa0", "é", "İ", "<|endoftext|>", "　", " x", " y "]
ROWS = [(3, "Some text. More of it! And more?"), (1, None), (2, ""), (2, "same id " * 30), (None, "no id"), (7, "a b c"), (7, "a b c"), (9, "x" * 5000), (10, "word " * 30_000)]


def texts(n, seed=1, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def table(spark, path, rows=ROWS):
    spark.createDataFrame([(i, t, "de", 5) for i, t in rows], "doc_id long, text string, k_id string, size int").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("special_ids", [False, True])
def test_memo_encoder_is_the_library(name, special_ids):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    if not special_ids:
        t.encode_special_tokens = True
    some = texts(2000, parts=[*PARTS, "<|startoftext|>", "<|endoftext|>"]) + ["<|endoftext|>", "'secret", "'sell. x", "(word", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x"]
    assert [x.tolist() for x in tokens.MemoEncoder(public_tokenizers.path(name), special_ids).encode(some)] == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]


def pieces():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), piece_model.model(path)


def test_piece_lattice_is_the_library():
    sp, m = pieces()
    for t in texts(1500, 2, [*PARTS, "▁", "http://", "\x00", "th", "er"]):
        assert m.encode(t).tolist() == sp.encode(t)
        assert m.decode(m.encode(t)) == t.replace("▁", " ")


@pytest.mark.parametrize("chunk", [17, 20, 64])
def test_chunks_and_transfer_matrices(chunk):
    sp, m = pieces()
    for t in texts(60, 3, [p for p in PARTS if "\n" not in p] + ["the", "tion", "ab" * 9]):
        if t:
            assert m.scanned(m.normalise(t), chunk=chunk).tolist() == sp.encode(t)


def test_scan_is_the_sequential_product():
    rng = np.random.default_rng(0)
    mats = [rng.random((a, b)) for a, b in zip([1, 3, 2, 4, 2], [3, 2, 4, 2, 1])]
    one = mats[0]
    for k, (m, s) in enumerate(zip(mats[1:], piece_model.scan(mats)[1:])):
        one = piece_model.maxplus(one, m)
        assert np.allclose(one, s), k


def test_giant_documents_are_chunked_over_tasks(spark, tmp_path):
    sp, _ = pieces()
    df = spark.read.parquet(table(spark, tmp_path) + "/documents.parquet")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sorted((r.k_id, r.ids) for r in sentencepiece_codec.encode_documents(df, path, giant=20, chunk=64).collect())
    expected = sorted((-(2**63) if i is None else i, np.array(sp.encode(t or ""), "<u4").tobytes()) for i, t in ROWS)
    assert got == expected
    one = {r.doc_id: r for r in sentencepiece_codec.op1_sentencepiece(spark, str(tmp_path)).collect()}
    assert one[3].decoded_crc32 == zlib.crc32(ROWS[0][1].encode()) and None in one


def test_checksums_and_frames():
    assert records.crc32c_scalar(b"123456789") == 0xE3069283
    parts = [random.Random(n).randbytes(n) for n in (0, 1, 3, 4, 5, 255, 256, 257, 70_000)]
    assert records.crc32c_many(parts).tolist() == [records.crc32c_scalar(p) for p in parts]
    data = b"".join(records.frame(parts))
    assert sum(records.unframe(io.BytesIO(data)), []) == parts
    for broken in (data[:-1], data[:20] + b"\x55" + data[21:]):
        with pytest.raises(records.CorruptRecord):
            sum(records.unframe(io.BytesIO(broken)), [])


def expected_ids(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")) for i, x in ROWS]


def test_token_records(spark, tmp_path):
    got = token_output.op5_token_records(spark, table(spark, tmp_path)).collect()
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 7, 7, 9, 10]
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i or 0, zlib.crc32(x.tobytes())) for i, x in expected_ids("byte_bpe_50k.json", 2))


def test_shuffled_reads_by_the_index(spark, tmp_path):
    files = token_output.write_records(spark.read.parquet(table(spark, tmp_path) + "/documents.parquet"), f"file://{tmp_path}/out", public_tokenizers.path("byte_bpe_50k.json"), 2, files=2)
    found = {}
    for f in files.collect():
        width, index = token_output.read_index(f.path.replace(".rec", ".idx"))
        for e in index[::-1]:
            found.setdefault(int(e["doc_id"]), []).append(token_output.read_record(f.path, int(e["offset"]), width).tolist())
    assert found[3] == [dict(expected_ids("byte_bpe_50k.json", 2))[3].tolist()] and len(found[7]) == 2


def test_cuts_are_the_least_cost():
    rng = random.Random(4)
    for _ in range(200):
        places = np.cumsum([rng.randint(1, 6) for _ in range(rng.randint(1, 12))])
        penalty = np.array([rng.choice([0, 1, 3]) for _ in places])
        p, n = [0, *places.tolist()], len(places)
        best = [0] + [10**9] * n
        for i in range(1, n + 1):
            best[i] = min(best[j] + 8 - (p[i] - p[j]) + int(penalty[i - 1]) for j in range(i) if p[i] - p[j] <= 8)
        cuts = packing.best_cuts(places, penalty, 8)
        pen = dict(zip(places.tolist(), penalty.tolist()))
        assert sum(8 - (b - a) + pen[b] for a, b in zip([0, *cuts], cuts)) == best[n] and cuts[-1] == p[-1]


def test_padding_is_little(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(" ".join(rng.choice(["some", "words", "of", "it"]) for _ in range(rng.randint(4, 20))) + "." for _ in range(rng.randint(1, 60)))) for i in range(1500)]
    got = packing.op7_packing(spark, table(spark, tmp_path, rows)).groupBy("sequence_id").sum("length").collect()
    sizes = [r[1] for r in got]
    padded = [2048 - n for n in sizes if n & (n - 1)]
    assert sum(sizes) > 300_000 and sum(padded) < 0.015 * sum(sizes)


def test_packing(spark, tmp_path):
    got = packing.op7_packing(spark, table(spark, tmp_path)).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id, r.doc_tokens].append(r)
    for pieces_ in sequences.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at
            at += length
        assert at <= 2048
    for i, ids in expected_ids("word_bpe_49k.json", 1):
        rows = sorted(docs[i, len(ids)], key=lambda r: r.start)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
        assert sum(r.length for r in rows) == len(ids) * sum(1 for j, x in expected_ids("word_bpe_49k.json", 1) if (j, len(x)) == (i, len(ids)))


def test_empty_tables(spark, tmp_path):
    d = table(spark, tmp_path, [])
    assert sentencepiece_codec.op1_sentencepiece(spark, d).count() == token_output.op5_token_records(spark, d).count() == packing.op7_packing(spark, d).count() == 0
