"""Operator 4, license scans: conditional compression.

Candidate blocks (lines that hold a word of licensing, with the lines around them that a template could reach, without comment
marks; those that overlap are one) are compressed with Zstandard, once plainly and once with each template
as a raw dictionary. A template's gain is the size it saves. All templates are confirmed by exact wording differences: the least
number of words to insert, delete or replace to turn the template into a part of the block (a semi-global alignment), which must
not exceed ``max_difference`` of the template's words. Of confirmed parts that overlap, the one with the most of its template's
words counts; all that remain are given back, ordered by gain. A template of which the block lacks too many words is not aligned.

Defined cases: a null or empty text has no blocks and gives a row with none; a block without a confirmed template counts as
unknown; equal gains rank by template name; every whole block is used, however long the block or its text; each row is judged by
itself, so repeated rows, rows of one id and rows of a null id get what their own text holds; an empty table gives an empty
result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load_documents, text_or_empty

_MERCHANTABLE = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GPL_REST = (
    " or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
#: Public licence statements, notices and whole licences, as fixed values.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This work is dedicated to the public domain.",
    "bsd-2-clause-text": _BSD_CONDITIONS + _BSD_DISCLAIMER,
    "bsd-3-clause-text": _BSD_CONDITIONS
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. " + _BSD_DISCLAIMER,
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
    "by the Free Software Foundation; either version 2 of the License," + _GPL_REST,
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
    "by the Free Software Foundation, either version 3 of the License," + _GPL_REST,
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. " + _MERCHANTABLE + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _MERCHANTABLE + "IN NO EVENT SHALL "
        "THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
}
#: A line with one of these is a candidate; phrases may be wrapped, with comment marks between their words.
CANDIDATE = r"(?i)licen[cs]e|copyright|\(c\)\s|©|all rights reserved|spdx|public domain|creative commons|permission is|permission to use|redistribution".replace(
    " ", r"[\s*#/;%!>-]+"
)
_CANDIDATE = re.compile(CANDIDATE, re.ASCII)
_MARKS = re.compile(r"^\s*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|>+|!+|<!--)?\s*|\s*(?:\*+/|-->)\s*$")
MAX_DIFFERENCE = 0.12

BLOCKS_DDL = "doc_id long, block_no int, n_lines int, place int, license string, gain int, plain_size int, n_diff int, exact boolean, differences array<string>, ranking array<string>"
_WORD = re.compile(r"\w+|[^\w\s]")


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=4)
def _compressors(names: tuple[str, ...], level: int = 3) -> dict:
    import zstandard as zstd

    options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    out = {"": zstd.ZstdCompressor(**options)}
    for n in names:
        raw = zstd.ZstdCompressionDict(TEMPLATES[n].lower().encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        out[n] = zstd.ZstdCompressor(dict_data=raw, **options)
    return out


def gains(block: str, names: tuple[str, ...] = tuple(TEMPLATES)) -> tuple[int, list[tuple[int, str]]]:
    """The block's plain size, and (bytes saved, template) from the most on."""
    data, by = block.lower().encode(), _compressors(names)
    plain = len(by[""].compress(data))
    return plain, sorted(((plain - len(by[n].compress(data)), n) for n in names), key=lambda x: (-x[0], x[1]))


def _alignments(template: list[str], block: list[str]) -> Iterator[tuple[int, int, int]]:
    """For each end in the block: least edits that turn the whole template into words [start, end)."""
    m = len(template)
    ids = {w: i for i, w in enumerate(dict.fromkeys(template))}
    t = np.array([ids[w] for w in template])
    steps = np.arange(m + 1)
    row, came = steps.copy(), np.zeros(m + 1, np.int64)
    yield m, 0, 0
    for j, w in enumerate(block, 1):
        took = np.empty(m + 1, np.int64)
        new = np.empty(m + 1, np.int64)
        new[0], took[0] = 0, j
        diagonal, above = row[:-1] + (t != ids.get(w, -1)), row[1:] + 1
        new[1:] = np.minimum(diagonal, above)
        took[1:] = np.where(diagonal <= above, came[:-1], came[1:])
        low = np.minimum.accumulate(new - steps)
        source = np.maximum.accumulate(np.where(new - steps == low, steps, 0))
        row, came = low + steps, took[source]
        yield int(row[m]), int(came[m]), j


def wording_difference(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """Least edits that turn the whole template into words [start, end) of the block."""
    return min(_alignments(template, block), key=lambda x: x[0])


def differences(template: list[str], part: list[str]) -> list[str]:
    """The wording differences, word by word: -removed, +added."""
    from difflib import SequenceMatcher

    out = []
    for kind, a, b, c, d in SequenceMatcher(None, template, part, autojunk=False).get_opcodes():
        if kind != "equal":
            out += [f"-{w}" for w in template[a:b]] + [f"+{w}" for w in part[c:d]]
    return out


@lru_cache(maxsize=1)
def _wordings() -> dict[str, tuple[list[str], Counter]]:
    return {n: (w := wording(t), Counter(w)) for n, t in TEMPLATES.items()}


def confirmed_parts(words: list[str], max_difference: float = MAX_DIFFERENCE) -> list[tuple[str, int, int, int]]:
    """(template, edits, start, end) of all parts that templates confirm, none overlapping another; the most words first."""
    held, found = Counter(words), []
    for name, (template, counts) in _wordings().items():
        limit = max_difference * len(template)
        if sum(max(0, n - held[w]) for w, n in counts.items()) <= limit:
            found += [(len(template) - n, n, name, a, b) for n, a, b in _alignments(template, words) if n <= limit]
    taken, out = bytearray(len(words)), []
    for _, n, name, a, b in sorted(found, key=lambda x: (-x[0], *x[1:])):
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((name, n, a, b))
    return out


def scan_block(block: str, max_difference: float = MAX_DIFFERENCE) -> dict:
    """The block's confirmed licence of the largest gain; licenses: all of them in that order, as such dicts, one for each part."""
    plain, order = gains(block)
    words, gain = wording(block), {n: g for g, n in order}
    shared = {"plain_size": plain, "ranking": [f"{n}:{g}" for g, n in order]}
    licenses = [
        {"license": name, "gain": gain[name], "n_diff": n, "exact": n == 0, "differences": differences(_wordings()[name][0], words[a:b]), **shared}
        for name, n, a, b in sorted(confirmed_parts(words, max_difference), key=lambda x: (-gain[x[0]], *x))
    ]
    none = {"license": None, "gain": order[0][0], "n_diff": None, "exact": None, "differences": [], **shared}
    return {**(licenses[0] if licenses else none), "licenses": licenses}


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, dict] = {}
    for b in batches:
        rows = []
        for doc_id, no, n_lines, block in zip(b["doc_id"], b["block_no"], b["n_lines"], b["block"]):
            if block not in memo:
                if len(memo) > 20_000:
                    memo.clear()
                memo[block] = scan_block(block)
            for place, row in enumerate(memo[block]["licenses"] or [memo[block]]):
                rows.append({"doc_id": doc_id, "block_no": no, "n_lines": n_lines, "place": place, **row})
        out = pd.DataFrame(rows, columns=["doc_id", "block_no", "n_lines", "place", "license", "gain", "plain_size", "n_diff", "exact", "differences", "ranking"])
        yield out.astype({"doc_id": "Int64", "n_diff": "Int32", "exact": "boolean"})


def passages(text: str, max_difference: float = MAX_DIFFERENCE) -> list[tuple[int, int, str]]:
    """(first line, candidate lines, text) of each candidate block: as many words on both sides as the longest template can reach."""
    reach = int((1 + max_difference) * max(len(w) for w, _ in _wordings().values())) + 1
    lines = [_MARKS.sub("", x) for x in text.split("\n")]
    ends = list(accumulate(len(x) + 1 for x in lines))
    size = lru_cache(maxsize=None)(lambda i: len(wording(lines[i])))
    spans: list[list[int]] = []
    last = -1
    for m in _CANDIDATE.finditer("\n".join(lines)):
        at, to = bisect_right(ends, m.start()), bisect_right(ends, m.end() - 1)
        if at == last:
            continue
        last, first, n = at, at, 0
        while first and n < reach:
            first -= 1
            n += size(first)
        n = 0
        while to + 1 < len(lines) and n < reach:
            to += 1
            n += size(to)
        if spans and first <= spans[-1][1]:
            spans[-1][1:] = [max(to, spans[-1][1]), spans[-1][2] + 1]
        else:
            spans.append([first, to, 1])
    return [(a, n, "\n".join(lines[a : b + 1])) for a, b, n in spans]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, *p) for i, t in zip(b["doc_id"], b["t"]) for p in passages(t)]
        yield pd.DataFrame(rows, columns=["doc_id", "block_no", "n_lines", "block"]).astype({"doc_id": "Int64", "block_no": "int32", "n_lines": "int32"})


def candidate_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block_no, n_lines, block) of the texts that hold a word of licensing; those are found inside the JVM."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t")).where(F.col("t").rlike(CANDIDATE))
    return rows.mapInPandas(_blocks, "doc_id long, block_no int, n_lines int, block string")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per confirmed licence of a candidate block, or one without a licence."""
    return candidate_blocks(docs, id_col, text_col).mapInPandas(_scan, BLOCKS_DDL)


SUMMARY = ["n_blocks", "n_confirmed", "license", "gain", "least_diff", "n_exact", "licenses"]
SUMMARY_DDL = "doc_id long, n_blocks long, n_confirmed long, license string, gain int, least_diff int, n_exact long, licenses array<string>"


def summary(found: list[tuple[int, dict]]) -> tuple:
    """SUMMARY of a text's blocks, each with its candidate lines and scan_block's result: the licence of the largest gain, of equal ones the first."""
    parts = [x for _, b in found for x in b["licenses"]]
    best = max(parts, key=lambda x: x["gain"], default={"license": None, "gain": None})
    return (
        sum(n for n, _ in found), len(parts), best["license"], best["gain"], min((x["n_diff"] for x in parts), default=None),
        sum(x["exact"] for x in parts), sorted({x["license"] for x in parts}),
    )


def _summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, dict] = {}
    none = summary([])
    for b in batches:
        rows = []
        for doc_id, text in zip(b["doc_id"], b["t"]):
            found = []
            for _, n_lines, block in passages(text) if text else ():
                if block not in memo:
                    if len(memo) > 20_000:
                        memo.clear()
                    memo[block] = scan_block(block)
                found.append((n_lines, memo[block]))
            rows.append((doc_id, *(summary(found) if found else none)))
        yield pd.DataFrame(rows, columns=["doc_id", *SUMMARY]).astype({"doc_id": "Int64", "gain": "Int32", "least_diff": "Int32"})


def license_summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs; texts without a word of licensing go to Python as nulls."""
    t = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(t.rlike(CANDIDATE), t).alias("t"))
    return rows.mapInPandas(_summarise, SUMMARY_DDL)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its lines with a word of licensing (n_blocks), its confirmed parts, the first licence of the largest gain, and all of them."""
    return license_summaries(load_documents(spark, sf_dir))
