"""Operators 2 and 4: round trips, a general decoder against hand-coded scans, licence texts."""

import numpy as np
import pytest

from textloom.llm import license_scan as L
from textloom.llm import media
from textloom.llm import progressive_jpeg as J


@pytest.mark.parametrize("n", [192, 384, 576, 192 * 41, 192 * 9000])
def test_payload_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    f = J.decode(J.encode_bytes(payload))
    assert J.payload_of(f) == payload
    if n < 10_000:
        assert J.to_rgb(f).shape == (f.height, f.width, 3)


def test_padding():
    assert media.pad_payload(b"") == b" " * 192 and len(media.pad_payload(b"x" * 193)) == 384 and media.pad_payload(b"y" * 192) == b"y" * 192


def _bits(text):
    bits = text.replace(" ", "")
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


def test_general_scans_bit_by_bit():
    """Grey, one block: DC of size 3, then an AC band with a run, a refinement with a new and a corrected coefficient."""
    seg = J._segment
    dc = bytes([0x00, 0, 2] + [0] * 14 + [0, 3])  # codes 00: size 0, 01: size 3
    ac = bytes([0x10, 0, 3] + [0] * 14 + [0x01, 0x11, 0x00])  # 00: run 0 size 1, 01: run 1 size 1, 10: end of block
    data = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([1] * 64)) + seg(0xC2, b"\x08\0\x08\0\x08\x01\x01\x11\0") + seg(0xC4, dc + ac)
    data += seg(0xDA, bytes([1, 1, 0, 0, 0, 1])) + _bits("01 101")  # DC 5 << 1
    data += seg(0xDA, bytes([1, 1, 0, 0, 0, 0x10])) + _bits("1")  # the lowest bit: 11
    data += seg(0xDA, bytes([1, 1, 0, 1, 5, 1])) + _bits("01 0 10")  # a zero, then -1 << 1 at 2
    data += seg(0xDA, bytes([1, 1, 0, 1, 5, 0x10])) + _bits("00 1 01 1 1 10")  # new +1 at 1; then one zero skipped past 2 (corrected)
    f = J.decode(data + b"\xff\xd9")
    assert f.components[0].coefs[0, 0, :6].tolist() == [11, 1, -3, 0, 1, 0]


def test_inverse_transform_is_the_definition():
    c = np.arange(64.0).reshape(8, 8)
    a = lambda u: np.sqrt(1 / 8) if u == 0 else 0.5
    cos = lambda x, u: np.cos((2 * x + 1) * u * np.pi / 16)
    expected = [[sum(a(u) * a(v) * c[v, u] * cos(x, u) * cos(y, v) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    assert np.allclose(c.ravel() @ J._cosines(), np.ravel(expected), atol=1e-2)


def test_chroma_is_upsampled_to_full_resolution():
    f = J.decode(J.encode_bytes(bytes(384)))
    assert f.components[0].coefs.shape[:2] == (2, 2) and f.components[1].coefs.shape[:2] == (1, 1) and J.to_rgb(f).shape == (16, 16, 3)


def test_media_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "doc_id long, text string")
    from pyspark.sql import functions as F

    m = df.select("doc_id", media.bytes_to_media(F.coalesce("text", F.lit(""))).alias("m"))
    got = {r.doc_id: r for r in m.select("doc_id", media.decode_media("m").alias("d")).select("doc_id", "d.*").collect()}
    assert got[1].rgb == got[3].rgb and got[2].height == 16 and len(got[1].rgb) == got[1].height * got[1].width * 3
    bad = spark.createDataFrame([(1, b"no"), (2, None)], "k int, m binary").select(media.decode_media("m").alias("d")).select("d.*").collect()
    assert all(r.height is None and r.error for r in bad)


@pytest.mark.parametrize("name", list(L.TEMPLATES))
def test_each_template_is_found(name):
    got = L.scan_block("Some words before. " + L.TEMPLATES[name] + " and after")
    assert got["license"] == name and got["exact"] and got["n_diff"] == 0


def test_wording_differences():
    got = L.scan_block(L.TEMPLATES["gpl-3.0"].replace("version 3", "version 2"))
    assert got["license"] == "gpl-2.0" and got["exact"]
    got = L.scan_block(L.TEMPLATES["mit-permission"].replace("free of charge", "free of any charge"))
    assert got["license"] == "mit-permission" and got["n_diff"] == 1 and got["differences"] == ["+any"]
    assert L.scan_block("the licence of prose, or a license plate")["license"] is None


def test_every_confirmed_licence_whatever_its_gain():
    prose = "We walked along the river without any warranties or conditions and met a few friends near the old mill. " * 5
    got = L.scan_block(prose + "All rights reserved. " + prose)
    assert (got["license"], got["exact"]) == ("all-rights-reserved", True)
    got = L.scan_block(" and ".join(L.TEMPLATES.values()))
    assert {x["license"] for x in got["licenses"]} == set(L.TEMPLATES) and all(x["exact"] for x in got["licenses"])
    assert [x["license"] for x in L.scan_block("All rights reserved. " * 2 + L.TEMPLATES["gpl-3.0"])["licenses"]].count("gpl-2.0") == 0


@pytest.mark.parametrize("name", list(L.TEMPLATES))
def test_wrapped_statements_in_comments(name):
    import textwrap

    for mark in ("# ", " * ", "// "):
        lines = textwrap.wrap(L.TEMPLATES[name], 24, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False, break_long_words=False)
        (_, n, block), = L.passages("\n".join(["import os"] * 200 + lines + ["x = 1"] * 200))
        assert n >= 1 and [(x["license"], x["exact"]) for x in L.scan_block(block)["licenses"]] == [(name, True)]
    assert len(L.passages("\n".join([L.TEMPLATES[name], *["w " * 50] * 20, L.TEMPLATES[name]]))) == 2


def test_alignment_is_the_least_edit_count():
    import random

    rng = random.Random(2)
    for _ in range(200):
        t, b = [rng.choice("abc") for _ in range(rng.randint(1, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        d = [0] * (len(b) + 1)
        for i in range(1, len(t) + 1):
            row = [i]
            for j in range(1, len(b) + 1):
                row.append(min(d[j - 1] + (t[i - 1] != b[j - 1]), d[j] + 1, row[j - 1] + 1))
            d = row
        n, start, end = L.wording_difference(t, b)
        assert n == min(d) and 0 <= start <= end <= len(b)


def test_scan_with_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "x\nReleased under the MIT License.\nAll rights reserved."), (None, "Licensed under CC BY-NC 4.0."), (5, "license " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_blocks, r.license) for r in L.op4_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (2, "mit"), None: (1, "cc-by-nc-4.0"), 5: (1, None)}


def plain_scan(text):
    """Licences of a text: every template against all of the text's words, by plain dynamic programming."""
    words = L.wording("\n".join(L._MARKS.sub("", x) for x in text.split("\n")))
    found = []
    for name, template in L.TEMPLATES.items():
        t = L.wording(template)
        row = [(0, j) for j in range(len(words) + 1)]  # least edits and where the part starts
        for i, x in enumerate(t, 1):
            new = [(i, 0)]
            for j, y in enumerate(words, 1):
                new.append(min((row[j - 1][0] + (x != y), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1]), key=lambda c: c[0]))
            row = new
        found += [(len(t) - n, n, name, a, b) for b, (n, a) in enumerate(row) if n <= L.MAX_DIFFERENCE * len(t)]
    taken, out = [False] * len(words), []
    for _, n, name, a, b in sorted(found, key=lambda x: (-x[0], *x[1:])):
        if not any(taken[a:b]):
            taken[a:b] = [True] * (b - a)
            out.append((name, n))
    return out


def test_scan_against_brute_force(spark, tmp_path):
    import random
    import textwrap

    rng = random.Random(3)
    short = [n for n, t in L.TEMPLATES.items() if len(t) < 400]
    rows = []
    for i in range(24):
        parts = []
        for _ in range(rng.randint(0, 3)):
            parts.append(" ".join(f"word{rng.randint(0, 99)}" for _ in range(rng.randint(0, 40))))
            words = L.TEMPLATES[rng.choice(short)].split(" ")
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(len(words))] = "changed"
            lines = textwrap.wrap(" ".join(words), 30, break_on_hyphens=False, break_long_words=False) if rng.random() < 0.5 else [" ".join(words)]
            parts += [rng.choice(["", "# ", "// "]) + x for x in lines]
        rows.append((rng.choice([i, i, 3]), "\n".join(parts)))
    rows += [(90, L.TEMPLATES["mit-text"].replace("merge, ", "")), (90, "plain"), (90, "plain")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for i, text in rows:
        parts = plain_scan(text)
        expected.append((i, len(parts), sorted({n for n, _ in parts}), min((d for _, d in parts), default=None), sum(d == 0 for _, d in parts)))
    got = [(r.doc_id, r.n_confirmed, list(r.licenses), r.least_diff, r.n_exact) for r in L.op4_license_scan(spark, str(tmp_path)).collect()]
    order = lambda x: (x[0], x[1], x[2])
    assert sorted(got, key=order) == sorted(expected, key=order) and sum(x[1] for x in got) > 20


def test_license_scan_of_an_empty_table_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, t string, license int").write.parquet(str(tmp_path / "documents.parquet"))
    assert L.op4_license_scan(spark, str(tmp_path)).count() == 0
    rows = [(7, "Released under the MIT License.", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, t string, license int").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert L.op4_license_scan(spark, str(tmp_path)).first().license == "mit"


def test_media_query_against_brute_force(spark, tmp_path):
    import hashlib
    import random
    import zlib

    rng = random.Random(4)
    texts = ["", None, "a", "x" * 192, "x" * 191, "é" * 96, "é" * 97, "line\n" * 4000, "same", "same", "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(500))]
    rows = [(None if i == 3 else i, t, "x", 5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes int").write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op2_media_columns(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        data = (texts[3 if r.doc_id is None else r.doc_id] or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = media.encode_bytes(payload)
        frame = media.decode(stored)
        assert bytes(media.payload_of(frame)) == payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.rgb_feature(media.to_rgb(frame))
        assert by.setdefault(payload, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert media.op2_media_columns(spark, str(tmp_path / "empty")).count() == 0
