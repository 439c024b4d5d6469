"""Operator 3, language-model scoring: a weighted backoff automaton.

Smoothed n-grams become states with failure arcs: the state is the last word, if it was learnt; an arc of a kept bigram carries
its smoothed log-probability; any other word follows the state's failure arc (its backoff weight) to the root, whose arcs are
the smoothed single words. One left-to-right traversal of a text carries the state and adds up the weights.

With c(a b) >= ``min_count`` a bigram is kept, and p(b | a) = (c(a b) - discount) / c(a) + g(a) p(b); any other word has
g(a) p(b). g(a), the backoff weight, is what the kept arcs of a leave of 1, so the probabilities of a state add up to 1.

The corpus is counted by *blocks* of documents and by *ranges* of names, both of bounded size; words and bigrams are named by
hashes, of 64 bits in a block and 48 within a range. A block sends each range one row: the sorted names of the range that it holds, packed, with their counts in its
training texts. The range adds them up and answers each block in the same order, so a block gets just its part of a model that
may be larger than any one machine. Each kept bigram has one owner among the blocks; owners send what their bigrams take of the
states' mass to the ranges, which answer with the sums. A name adds one entry a block to its range, and there are at most
``MAX_BLOCKS`` blocks, so a very common name does not make a range much larger. The driver gets two totals.

A range has about a million names, so one in 2e8 shares its name with another, whatever the size of the corpus.

Defined cases: a null text is an empty text (its end only); a row's part is decided by its id, so rows of equal id are all held
out or all learnt from, each as a document of its own; a very long text is a block by itself; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ascii_lower, hash_words_of, load_documents, mix, row_key, text_or_empty, total_bytes

BLOCK_BYTES = 6 << 20
MAX_BLOCKS = 1 << 20
RANGE_BYTES = 8 << 20
ID_RANGES = 8_192
MIN_COUNT = 2
DISCOUNT = 0.75
FOLDS, HELD_OUT = 5, 1
#: The end of a text, as a word; it is also the state at a text's start.
END = mix(np.array([0xE0D], np.uint64))[0]
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(texts: list[str], limit: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, its end included, and where each text's tokens end."""
    found, sizes, group, size = [], [], [], 0

    def flush():
        hashes, ends = hash_words_of(group)
        counts = np.diff(ends, prepend=0)
        stops = ends + np.arange(1, len(group) + 1)
        out = np.full(len(hashes) + len(group), END, np.uint64)
        inside = np.ones(len(out), bool)
        inside[stops - 1] = False
        out[inside] = hashes
        found.append(out)
        sizes.append(counts + 1)

    for t in texts:
        group.append(ascii_lower(t.encode("utf-8", "surrogatepass")))
        size += len(group[-1])
        if size >= limit:
            flush()
            group, size = [], 0
    if group:
        flush()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


class Block:
    """The names of a block's texts: sorted distinct words and bigrams, each token's places among them, each bigram's state."""

    def __init__(self, texts: list[str]):
        tokens, self.ends = token_hashes(texts)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        # The state at a text's start is the end of a text, so that word is one of the block's in any case.
        self.words, self.word = np.unique(tokens, return_inverse=True)
        end = int(np.searchsorted(self.words, END))
        self.state = np.empty_like(self.word)
        self.state[1:] = self.word[:-1]
        self.state[self.starts] = end
        names = mix(self.words[self.state] * _PAIR + tokens)
        self.pairs, first, self.pair = np.unique(names, return_index=True, return_inverse=True)
        self.pair_state = self.state[first]


class Automaton:
    """A block's part of the model: counts of its words and bigrams (0: not kept), and each word's backoff weight g."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, backoff: np.ndarray, n_tokens: int, n_types: int, discount: float = DISCOUNT):
        self.words, self.pairs, self.backoff, self.discount = words, pairs, backoff, discount
        self.total = n_tokens + 0.5 * (n_types + 1)

    def traverse(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, the root's score (single words), the automaton's score."""
        root = (self.words + 0.5) / self.total
        at_root, state = root[block.word], block.state
        seen = self.pairs[block.pair]
        learnt = np.maximum(self.words[state], 1)
        weight = np.where(seen > 0, (seen - self.discount) / learnt, 0.0) + self.backoff[state] * at_root
        parts = (self.words[block.word] > 0).astype(np.int64), np.log10(at_root), np.log10(weight)
        return tuple(np.add.reduceat(x, block.starts) for x in parts)


def _blocks(rows: DataFrame, total: int, block_bytes: int) -> Column:
    """Ranges of ids of about equal numbers of rows, split further by the text's hash where there would be too many of them."""
    n = max(1, -(-total // max(block_bytes, total // MAX_BLOCKS)))
    ranges = min(n, ID_RANGES)
    places = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("k_id", places, 100 * ranges)).first()[0] if places else []
    edges, parts = np.array(cuts or [], np.int64), -(-n // ranges)

    @F.pandas_udf(T.IntegerType())
    def block(k_id: pd.Series, k_text: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k_id.to_numpy(), "left") * parts + k_text.to_numpy() % parts, dtype="int32")

    return block("k_id", "k_text")


NAME = 6  # bytes of a name within its range


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """Numbers of eight bytes as planes of their ``width`` lowest bytes, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, kind: str = "<u8", width: int = 8) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(kind).ravel()


def _joined(cells: pd.Series, kind: str = "<u8", width: int = 8) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_numbers(c, kind, width) for c in cells)])


def _cuts(names: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Where each of the 2^bits ranges begins and ends in sorted names."""
    edges = np.append(np.searchsorted(names, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)), len(names))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _within(names: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits below those that tell the range; sorted names stay sorted within a range."""
    return names << np.uint64(bits) >> np.uint64(16)


CELLS_DDL = "block int, range int, words binary, word_counts binary, pairs binary, pair_counts binary"


def _cells(part: pd.DataFrame, rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """A row per range that the block has names of."""
    out = pd.DataFrame(rows, columns=columns)
    out.insert(0, "block", np.int32(part["block"].iloc[0]))
    out.insert(1, "range", np.arange(len(rows), dtype=np.int32))
    return out[out[columns].map(len).any(axis=1)]


def _count(bits: int) -> Callable:
    def count(part: pd.DataFrame) -> pd.DataFrame:
        """The block's names by range, each with its count in the block's training texts."""
        block = Block(part["text"].tolist())
        learnt = np.repeat(part["learn"].to_numpy(), np.diff(block.ends, prepend=0))
        n_words = np.bincount(block.word, learnt, len(block.words)).astype("<u8")
        n_pairs = np.bincount(block.pair, learnt, len(block.pairs)).astype("<u8")
        words, pairs = _within(block.words, bits), _within(block.pairs, bits)
        rows = [
            (_planes(words[a:b], NAME), _planes(n_words[a:b], 4), _planes(pairs[c:d], NAME), _planes(n_pairs[c:d], 4))
            for (a, b), (c, d) in zip(_cuts(block.words, bits), _cuts(block.pairs, bits))
        ]
        return _cells(part, rows, ["words", "word_counts", "pairs", "pair_counts"])

    return count


REPLIES_DDL = "block int, range int, words binary, pairs binary, own binary, n_tokens long, n_types long"


def _totals(names: pd.Series, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names' sums; each entry's place among them; which entry is its name's first; where blocks' entries part."""
    distinct, first, at = np.unique(_joined(names, width=NAME), return_index=True, return_inverse=True)
    own = np.zeros(len(at), bool)
    own[first] = True
    return np.bincount(at, counts, len(distinct)), at, own, np.cumsum(names.str.len() // NAME)[:-1]


def _answer(min_count: int) -> Callable:
    def answer(cells: pd.DataFrame) -> pd.DataFrame:
        """For each block its entries' totals, in their order; bigrams that are not kept have 0. own: the kept ones the block owns."""
        total, at, _, word_ends = _totals(cells["words"], _joined(cells["word_counts"], width=4))
        words = total.astype("<i8")[at]
        pair_total, at, own, pair_ends = _totals(cells["pairs"], _joined(cells["pair_counts"], width=4))
        pairs = np.where(pair_total >= min_count, pair_total, 0).astype("<i8")[at]
        own &= pairs > 0
        first = np.arange(len(cells)) == 0  # the whole range's sums go along once
        return pd.DataFrame({
            "block": cells["block"], "range": cells["range"], "words": [_planes(x) for x in np.split(words, word_ends)],
            "pairs": [_planes(x) for x in np.split(pairs, pair_ends)], "own": [np.packbits(x).tobytes() for x in np.split(own, pair_ends)],
            "n_tokens": np.where(first, int(total.sum()), 0), "n_types": np.where(first, int((total > 0).sum()), 0),
        })

    return answer


def _own_part(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's totals of its words and its bigrams, and which bigrams it owns."""
    replies = replies.sort_values("range")
    own = [np.unpackbits(np.frombuffer(o, np.uint8), count=len(p) // 8) for o, p in zip(replies["own"], replies["pairs"])]
    return _joined(replies["words"], "<i8"), _joined(replies["pairs"], "<i8"), np.concatenate(own).astype(bool)


TAKEN_DDL = "block int, range int, words binary, taken binary"


def _take(bits: int, min_count: int, discount: float) -> Callable:
    def take(part: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """What the bigrams that the block owns take of their states' mass; a state met less than min_count times has no kept bigram."""
        block = Block(part["text"].tolist())
        words, pairs, own = _own_part(replies)
        taken = np.bincount(block.pair_state[own], pairs[own] - discount, len(words))
        asked = words >= min_count
        names, taken = block.words[asked], taken[asked]
        within = _within(names, bits)
        return _cells(part, [(_planes(within[a:b], NAME), _planes(taken[a:b])) for a, b in _cuts(names, bits)], ["words", "taken"])

    return take


def _sum_taken(cells: pd.DataFrame) -> pd.DataFrame:
    total, at, _, ends = _totals(cells["words"], _joined(cells["taken"], "<f8"))
    return pd.DataFrame({"block": cells["block"], "range": cells["range"], "taken": [_planes(x) for x in np.split(total[at], ends)]})


def _score(n_tokens: int, n_types: int, min_count: int, discount: float) -> Callable:
    def score(part: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"doc_id": pd.array(part["doc_id"], dtype="Int64"), "held_out": ~part["learn"]})
        block = Block(part["text"].tolist())
        words, pairs, _ = _own_part(replies[replies["taken"].isna()])
        backoff = np.ones(len(words))
        sums = _joined(replies[replies["taken"].notna()].sort_values("range")["taken"], "<f8")
        asked = words >= min_count
        backoff[asked] = 1 - sums / words[asked]
        known, base, own = Automaton(words, pairs, backoff, n_tokens, n_types, discount).traverse(block)
        return out.assign(n_tokens=np.diff(block.ends, prepend=0), n_known=known, train_tokens=n_tokens, base_score=base, score=own)

    return score


SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
    min_count: int = MIN_COUNT, discount: float = DISCOUNT, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Learns from documents outside the held-out fold and scores all."""
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT, F.lit(True))
    total = total_bytes(docs, text_col)
    rows = rows.select(_blocks(rows, total, block_bytes).alias("block"), "doc_id", learn.alias("learn"), "text")
    by_block = rows.groupBy("block")
    bits = max(0, total // range_bytes).bit_length()
    scratch = Scratch(docs.sparkSession, "lm")
    cells = rows.select("block", "learn", "text").groupBy("block").applyInPandas(_count(bits), CELLS_DDL)
    replies = scratch.save(cells.groupBy("range").applyInPandas(_answer(min_count), REPLIES_DDL), "replies")
    n_tokens, n_types = replies.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    taken = rows.select("block", "text").groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_take(bits, min_count, discount), TAKEN_DDL)
    sums = scratch.save(taken.groupBy("range").applyInPandas(_sum_taken, "block int, range int, taken binary"), "sums")
    columns = ["block", "range", "words", "pairs", "own"]
    answers = replies.select(*columns, F.lit(None).cast("binary").alias("taken")).unionByName(
        sums.select("block", "range", *[F.lit(None).cast("binary").alias(c) for c in columns[2:]], "taken")
    )
    return by_block.cogroup(answers.groupBy("block")).applyInPandas(_score(n_tokens, n_types, min_count, discount), SCORES_DDL)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(load_documents(spark, sf_dir))
