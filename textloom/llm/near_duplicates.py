"""Operator 8, near-duplicates: Order MinHash over occurrence-labelled word shingles, verified by banded alignment of words.

A text's k-mers are its five-word shingles, labelled by their occurrence in it. A sketch takes the least ``ell`` labelled
shingles under one random order and keeps them in text order, so equal sketches speak for similar *sequences*; ``rows`` sketches
make a band, and texts that share a band are candidates. A candidate pair is verified by a banded alignment of the two word
sequences: with m matched words its similarity is m / (n1 + n2 - m), and must be 0.8 or more. The band is as wide as an alignment
of that similarity can stray from the diagonal, so it holds all of them. Texts whose shingles alone align that well need no
second look; texts that have too few words in common, whatever their order, are out.

Equal texts are one node. In a bucket (the texts that share a band) a pivot, the text with the most company, is compared with the
others. Words that an alignment leaves unmatched are a metric: texts that are at most half as far from a pivot as links reach are
all linked to each other, so they are one clique, whose pairs are counted and not enumerated.

Sketches find cliques, and no link depends on them. All links between cliques (most are of one text) come from an exact join: a word
that an alignment leaves unmatched breaks two pairs of neighbouring words in its own text and one in the other, so texts of this
similarity share a third of their pairs, and some of their rarest ones (of one more than the similarity leaves open, one; of k more,
k + 1); and they differ in no more bits of parity than in words. Pairs of words meet by copying and seldom by chance, and those that
one clique alone has meet nothing and go before the join. A text is then measured against a clique's pivot, which by the metric links it to all of the clique, to none, or leaves
members open, and those are aligned one by one. There is no cap on buckets, words, cliques or rounds. ``n_links`` is the number of
all different texts of this similarity.

Defined cases: texts without words (null, empty) are each a class of its own; texts of under five words have one shingle, all
their words; a null doc_id sorts first and is given back as null; class ids are the least doc_id of a class (two classes share
one if unlike rows share an id); very long texts are aligned between shingles that they share, in parts of ``PART_WORDS``, and whole
where that does not show a link; an empty table gives an empty result; columns other than id and text are only
handed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEY, KEY_DDL, Scratch, hash_words_of, load_documents, mix, row_key, text_or_empty
from .components import ALONE, connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS, ELL = 16, 2, 2
BLOCK = 64
COUNTERS, CHUNK = 1 << 20, 1 << 12
SHORT = 512
SLACK = 50
#: Where more than FEW texts hold a run, its rows name so many of the runs before it.
EARLIER, FEW = 6, 8
#: Where more texts than these hold a run, its rows have their texts' bits, and only those near each other meet.
HELD = 64
PART_WORDS = 4096
SEED = 0x51E7
_STEP = np.uint64(0xD6E8FEB86659FD93)


def labelled_shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of a text's shingles, in order, each labelled by its occurrence and so distinct."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h * _STEP + words[i : i + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    if new.all():
        return h
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.where(occurrence == 0, h, mix(h + occurrence * _STEP))


@lru_cache(maxsize=4)
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches_of(shingles: np.ndarray, sketches: int = BANDS * ROWS, ell: int = ELL) -> np.ndarray:
    """A text's Order MinHash sketches."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    ell = min(ell, len(shingles))
    order = mix_order(shingles[None, :], _multipliers(sketches)[:, None])
    least = np.empty((sketches, ell), np.int64)
    for k in range(ell):  # a few times the least costs less than a partition
        least[:, k] = order.argmin(axis=1)
        order[np.arange(sketches), least[:, k]] = np.uint64(2**64 - 1)
    chosen = shingles[np.sort(least, axis=1)]  # in text order
    out = np.zeros(sketches, np.uint64)
    for k in range(ell):
        out = mix((out ^ chosen[:, k]) * _STEP)
    return out.view(np.int64)


def mix_order(shingles: np.ndarray, multiplier: np.ndarray) -> np.ndarray:
    """A random order of the labelled shingles."""
    x = shingles * multiplier
    return (x ^ (x >> np.uint64(29))) * multiplier


def _increasing(place: np.ndarray) -> np.ndarray:
    """Which entries make a longest increasing run."""
    if len(place) < 2 or (np.diff(place) > 0).all():
        return np.arange(len(place))
    tails: list[int] = []
    ends: list[int] = []
    before = []
    for k, p in enumerate(place.tolist()):
        i = bisect_left(tails, p)
        tails[i : i + 1], ends[i : i + 1] = [p], [k]
        before.append(ends[i - 1] if i else -1)
    out, k = [], ends[-1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return np.array(out[::-1])


def shared_shingles(a: np.ndarray, b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the shingles of their best alignment within the band; labelled shingles are distinct."""
    order = np.argsort(a)
    at = np.minimum(np.searchsorted(a[order], b), len(a) - 1)
    in_b = np.flatnonzero(a[order][at] == b)
    in_a = order[at][in_b]
    near = np.abs(in_a - in_b) <= band
    in_a, in_b = in_a[near], in_b[near]
    run = _increasing(in_a)
    return in_a[run], in_b[run]


def _bits(places: list[int], low: int) -> int:
    out = 0
    for i in places:
        out |= 1 << i - low
    return out


def banded_matches(a: list, b: list, band: int) -> int:
    """Matched items of the best alignment of a and b that keeps within the band around the diagonal.

    A column of the alignment is a number: bit i is 0 where item i of a adds a match. Bits that fall out of the band stay as they are.
    """
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(a) - start and end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b, matched = a[start : len(a) - end], b[start : len(b) - end], start + end
    if not a or not b:
        return matched
    at: dict = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    few = 0 if len(a) <= PART_WORDS else max(64, len(a) // 2000)
    places = {x: _bits(of, 0) for x, of in at.items() if len(of) > few}  # of a long text, only those of its frequent words
    width = min(len(a), 2 * band + 1)
    full, window, low = (1 << width) - 1, (1 << width) - 1, 0
    for j, x in enumerate(b):
        if j - band > low and low + width < len(a):  # the lowest item leaves, one more comes in
            matched += not window & 1
            window, low = window >> 1 | 1 << width - 1, low + 1
        hits = places[x] >> low if x in places else _bits(at[x][bisect_left(at[x], low) : bisect_left(at[x], low + width)], low) if x in at else 0
        if hits := window & hits:
            window = (window + hits | window - hits) & full
    return matched + width - window.bit_count()


def _parts(in_a: np.ndarray, in_b: np.ndarray, n_a: int, n_b: int) -> Iterator[tuple[int, int, int, int]]:
    """Ends of stretches of a and b, cut at shared shingles, of at most PART_WORDS words where such shingles allow it."""
    a = b = 0
    last = None
    for i, j in zip(in_a.tolist(), in_b.tolist()):
        if last and max(i - a, j - b) > PART_WORDS:
            yield a, last[0], b, last[1]
            a, b = last
        last = (i, j)
    if last and max(n_a - a, n_b - b) > PART_WORDS:
        yield a, last[0], b, last[1]
        a, b = last
    yield a, n_a, b, n_b


def _share(similarity: float) -> float:
    """Two sequences of n1 and n2 words have this similarity if they differ by this share of n1 + n2 words at most."""
    return (1 - similarity) / (1 + similarity)


def distance(a: np.ndarray, b: np.ndarray, limit: float, close: float = -1, k: int = WORDS) -> int | None:
    """Words of a and b (hashes) that their best alignment leaves unmatched; None above limit. Up to close, a number not below it will do."""
    n = len(a) + len(b)
    if abs(len(a) - len(b)) > limit + 1e-6:
        return None
    needed = (n - limit) / 2 - 1e-6
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    counts = [np.bincount(x, minlength=len(names)) for x in (at[: len(a)], at[len(a) :])]
    if np.minimum(*counts).sum() < needed:
        return None
    band = int(max(len(a), len(b)) - needed) + 1
    x, y = at[: len(a)].tolist(), at[len(a) :].tolist()
    if max(len(a), len(b)) > SHORT and close >= 0:  # what is aligned in parts is aligned
        in_a, in_b = shared_shingles(labelled_shingles(a, k), labelled_shingles(b, k), band)
        steps = np.minimum(np.minimum(np.diff(in_a), np.diff(in_b)), k)
        if len(in_a) and (d := n - 2 * (int(steps.sum()) + k)) <= close + 1e-6:
            return d
        if n > 2 * PART_WORDS:
            parts = [p for p in _parts(in_a, in_b, len(a), len(b)) if max(p[1] - p[0], p[3] - p[2]) <= 2 * PART_WORDS]
            matched = sum(banded_matches(x[a0:a1], y[b0:b1], band + abs(a0 - b0)) for a0, a1, b0, b1 in parts)
            if n - 2 * matched <= close + 1e-6:
                return n - 2 * matched
    matched = banded_matches(x, y, band)
    return n - 2 * matched if matched >= needed else None


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, k: int = WORDS) -> bool:
    """Whether the word sequences a and b (hashes) have this similarity."""
    limit = _share(similarity) * (len(a) + len(b))
    return bool(len(a) and len(b)) and distance(a, b, limit, limit, k) is not None


def _word_lists(texts: list[str]) -> list[np.ndarray]:
    out, group, size = [], [], 0
    for i, t in enumerate(texts):
        group.append(t.lower().encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= 1 << 17 or i == len(texts) - 1:
            hashes, ends = hash_words_of(group)
            out += np.split(hashes, ends[:-1])
            group, size = [], 0
    return out


def _count_runs(run: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, COUNTERS), np.int64)
        for b in batches:
            for part in np.array_split(b["text"].to_numpy(), -(-len(b) // 256)):
                if words := [w for w in _word_lists(part.tolist()) if len(w)]:
                    for total, of in zip(counts, ([labelled_shingles(w, 1) for w in words], [_runs(w, run) for w in words])):
                        total += np.bincount((np.concatenate(of) % np.uint64(COUNTERS)).view(np.int64), minlength=COUNTERS)
        chunks = counts.reshape(-1, CHUNK)
        yield pd.DataFrame([(i, c.tobytes()) for i, c in enumerate(chunks) if c.any()], columns=["chunk", "counts"])

    return count


def _add_counts(chunks: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in chunks["counts"])
    return pd.DataFrame({"chunk": [int(chunks["chunk"].iloc[0])], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def run_counts(rows: DataFrame, similarity: float) -> np.ndarray:
    """How many texts hold a labelled word, and a labelled run of words, by their hashes modulo COUNTERS. Only an order of runs is made of it."""
    chunks = rows.select("text").mapInPandas(_count_runs(_run(similarity)), "chunk int, counts binary").groupBy("chunk").applyInPandas(_add_counts, "chunk int, counts binary")
    counts = np.zeros((2, COUNTERS), np.int32)
    for r in chunks.toLocalIterator():
        counts.reshape(-1, CHUNK)[r.chunk] = np.frombuffer(r.counts, np.int32)
    return counts


def _sketch(counts, similarity: float):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = _word_lists(b["text"].tolist())
            out = b[[*KEY, "node"]].copy()
            out["n"], out["sketches"] = [len(w) for w in words], [sketches_of(labelled_shingles(w)) for w in words]
            labelled = [labelled_shingles(w, 1) for w in words]
            out["rare"] = [rarest_runs(w, counts.value, similarity) for w in words]
            out["bits"] = [parities(w) for w in labelled]
            yield out

    return sketch


def _in_common(similarity: float, run: int) -> float:
    """Texts of n1 and n2 words of this similarity share this part of n1 + n2 runs of so many words; a text has n, counting an end behind it."""
    return 0.5 - (run - 0.5) * _share(similarity)


def _run(similarity: float) -> int:
    """Two words, where the similarity leaves enough pairs of words in common."""
    return 2 if _in_common(similarity, 2) >= 0.2 else 1


def _runs(words: np.ndarray, run: int) -> np.ndarray:
    """A text's labelled runs of words, as many as it has words; the last ones reach over its end."""
    return labelled_shingles(np.append(words, np.zeros(run - 1, np.uint64)), run)


def rarest_runs(words: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a text's labelled runs, the rarest first, that more than one in SLACK of its words are shared with any text of this similarity.

    Runs that share a counter with others are not told apart by it: those that are not clearly above the mean, in powers of two, go by
    how often their words are. The order depends on a run alone, so words count as they do where they first occur.
    """
    if not (n := len(words)):
        return np.zeros(0, np.int64)
    run = _run(similarity)
    runs = _runs(words, run)
    often = counts[0, (mix(words) % np.uint64(COUNTERS)).view(np.int64)].astype(float)
    if run > 1:
        often = often * np.append(often[1:], 2.0**31)
    held = counts[1, (runs % np.uint64(COUNTERS)).view(np.int64)] / (2 * counts[1].mean() + 1)
    order = np.lexsort((runs, often, np.floor(np.log2(np.maximum(held, 1)))))
    return runs[order[: int(n - _in_common(similarity, run) * (1 + similarity) * n + 1e-6) + 1 + n // SLACK]].view(np.int64)


def parities(labelled: np.ndarray) -> np.ndarray:
    """Bits, a power of two that grows with the text; two texts differ in as many labelled words at least as in bits."""
    n = min(max(256, 1 << len(labelled).bit_length()), 1 << 16)
    odd = np.bincount((labelled >> np.uint64(40)).view(np.int64) % n, minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, words = None, None
    for b in batches:
        found = []
        others = _word_lists(b["text_b"].tolist())
        for a, text, other, limit, close in zip(b["a"], b["text_a"], others, b["limit"], b["close"]):
            if a != last:
                last, (words,) = a, _word_lists([text])
            found.append(distance(words, other, limit, close))
        out = b[["a", "b"]].copy()
        out["d"] = pd.array(found, "Int64")
        yield out.dropna()


def _tasks(df: DataFrame) -> int:
    """As many tasks as shuffle partitions, which adaptive execution leaves alone: a little data may be much work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _measured(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, d) of the pairs (a, b, limit, close) with a distance d up to the limit."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    tasks = _tasks(pairs)
    both = with_b.repartition(tasks, "a").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).repartition(tasks, "a").hint("merge"), "a")
    return scratch.save(both.select("a", "b", "limit", "close", "text_a", "text_b").mapInPandas(_measure, "a long, b long, d long"), name)


def _texts_of(ids: DataFrame, rows: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    wanted = nodes.select("id", "node").join(ids.distinct(), "id", "left_semi")
    return scratch.save(rows.select("node", "text").join(wanted.hint("merge"), "node").groupBy("id").agg(F.first("text").alias("text")), name)


def _count_links(share: float):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, probes, members in zip(batch["c"], batch["probes"], batch["members"]):
                words = _word_lists([m["text"] for m in members])
                links = [0] * len(members)
                for p in probes:
                    (own,), found = _word_lists([p["text"]]), 0
                    for i, m in enumerate(members):
                        limit = share * (p["n"] + m["n"]) + 1e-6
                        if p["d"] + m["r"] <= limit or (p["d"] - m["r"] <= limit and distance(own, words[i], limit, limit) is not None):
                            links[i] += 1
                            found += 1
                    out.append((p["id"], group, found))
                out += [(m["id"], None, n) for m, n in zip(members, links)]
            yield pd.DataFrame(out, columns=["id", "c", "links"]).astype({"c": "Int64"})

    return count


def _met_pivots(nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Texts (id, n, ...) and their buckets' pivots p (company, id, n), the texts of the most company; and (id, company, n) of all that have any."""
    of_band = ", ".join(f"sketches[band * {ROWS} + {r}]" for r in range(ROWS))
    keys = nodes.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).select(F.expr(f"xxhash64(band, {of_band})").alias("bucket"), "id", "n")
    shared = scratch.save(keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = scratch.save(keys.join(shared, "bucket"), "members")
    company = scratch.save(members.groupBy("id").agg(F.sum("size").alias("company"), F.first("n").alias("n")), "company")
    members = members.drop("size").join(company.drop("n"), "id")
    pivots = members.groupBy("bucket").agg(F.max(F.struct("company", "id", "n")).alias("p")).select("bucket", "p")
    return members.join(pivots, "bucket").where(F.col("id") != F.col("p.id")), company


def _cliques(nodes: DataFrame, rows: DataFrame, share: float, scratch: Scratch) -> DataFrame:
    """(id, n, c, r, size, least_n, min_x, max_y) of all texts: c names a text that this one's clique is around, at the distance r or less.

    A text joins the one of the most company whose distance from it is at most a half of what links two texts of its length, so the
    texts of a clique are all linked to each other. size, least_n (words of the shortest), min_x and max_y are of the clique.
    """
    met, company = _met_pivots(nodes, scratch)
    met = met.where(F.abs(F.col("n") - F.col("p.n")) <= share * F.greatest("n", "p.n"))
    limit, close = (share * f("n", "p.n") for f in (F.greatest, F.least))
    pairs = met.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), limit.alias("limit"), close.alias("close")).distinct()
    pairs = scratch.save(pairs, "bucket-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    measured = _measured(pairs, _texts_of(ends, rows, nodes, scratch, "bucket-texts"), scratch, "measured")
    for label in ("shared", "members", "bucket-texts", "bucket-pairs"):
        scratch.drop(label)
    near = measured.select(F.col("a").alias("id"), F.col("b").alias("c"), "d").union(measured.select("b", "a", "d"))
    around = company.select(F.col("id").alias("c"), F.col("company").alias("of_c"))
    tight = near.join(company, "id").where(F.col("d") <= share * F.col("n") + 1e-9).join(around, "c")
    tight = tight.where(F.struct("of_c", "c") > F.struct(F.col("company"), F.col("id")))
    chosen = scratch.save(tight.groupBy("id").agg(F.max(F.struct("of_c", "c", "d")).alias("best")).select("id", F.col("best.c").alias("c"), F.col("best.d").alias("r")), "chosen")
    alone = chosen.groupBy("c").agg(F.count("*").alias("k")).where("k = 1").select("c")
    # A clique of one is around that one; a text that others are around joins them if it chose none.
    chosen = scratch.save(chosen.join(alone, "c", "left_anti").select("id", "c", "r"), "joined")
    named = nodes.select("id", "n").join(chosen, "id", "left").select("id", "n", F.coalesce("c", "id").alias("c"), F.coalesce("r", F.lit(0).cast("long")).alias("r"))
    named = scratch.save(named, "in-cliques")
    x, y = F.min(share * F.col("n") - F.col("r")).alias("min_x"), F.max(share * F.col("n") + F.col("r")).alias("max_y")
    sizes = scratch.save(named.groupBy("c").agg(F.count("*").alias("size"), F.min("n").alias("least_n"), x, y), "cliques")
    units = scratch.save(named.join(sizes, "c"), "units")
    for label in ("company", "measured", "chosen", "joined", "in-cliques"):
        scratch.drop(label)
    return units


def _folded(x: str, y: str) -> Column:
    """x, its halves added up where y is half as long."""
    half = (F.size(x) / 2).cast("int")
    fold = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(x) > F.size(y), fold).otherwise(F.col(x))


def _bits_near(x: str, y: str, limit: Column) -> Column:
    """Whether bits x and y differ in so many at most; true where their lengths are further apart."""
    differing = F.zip_with(_folded(x, y), _folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.coalesce(F.aggregate(differing, F.lit(0), lambda total, d: total + d) <= limit + 1e-6, F.lit(True))


def _met_words(nodes: DataFrame, of: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, id, rank, c, held) of the rarest runs of texts that more than one c holds; of: (id, c); held: how many texts do. The others, nearly all, are shuffled once and not written."""
    ranked = nodes.select("id", "rare").join(of.select("id", "c"), "id").select("id", "c", F.posexplode("rare").alias("rank", "word"))
    held = Window.partitionBy("word")
    met = ranked.withColumn("x", F.min("c").over(held)).withColumn("y", F.max("c").over(held)).where("x < y")
    return scratch.save(met.select("word", "id", "rank", "c", F.count("*").over(held).cast("int").alias("held")), "rare-words")


def _before() -> Column:
    """The last few of a text's met runs before one that more than FEW texts hold."""
    last = F.collect_list("word").over(Window.partitionBy("id").orderBy("rank").rowsBetween(-EARLIER, -1))
    return F.when(F.col("held") > FEW, last).otherwise(F.array().cast("array<long>")).alias("before")


def _with_bits(rows: DataFrame, nodes: DataFrame, of: str, name: str) -> DataFrame:
    """rows with the bits of the texts that column ``of`` names, where they are hot."""
    hot = rows.where("hot").join(nodes.select(F.col("id").alias("_id"), F.col("bits").alias(name)), F.col(of) == F.col("_id")).drop("_id")
    return hot.unionByName(rows.where("not hot").withColumn(name, F.lit(None).cast("array<long>")))


def _rest(similarity: float, slack: bool) -> Column:
    """So many runs of words in common a text of n words can still have with others from the rank on, less its share in those that a link needs."""
    rest = (1 - _in_common(similarity, _run(similarity))) * F.col("n") - F.col("rank") + 1e-6
    return rest + F.floor(F.col("n") / SLACK) if slack else rest


def _candidates(nodes: DataFrame, units: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b, limit, close) of every text a and clique b that may have a link; b is the larger clique (of equal sizes, the later).

    Exact: linked texts share one of their rarest runs of words, from which on the runs are enough for a link, and differ in no more
    parities than in words. Text and clique that have an earlier run in common have met there, as all conditions on a run hold for
    those before it; so runs name some of those before them, and copies do not meet at each run that they share.
    """
    share, ratio = _share(similarity), _in_common(similarity, _run(similarity))
    words = _met_words(nodes, units, scratch).join(units.select("id", "n", "size", "least_n"), "id")
    words = words.select("word", "id", "n", "c", "size", "least_n", (F.col("held") > HELD).alias("hot"), _rest(similarity, slack=False).alias("e"), _before()).where(ratio * similarity * F.col("n") <= F.col("e"))
    words = scratch.save(words, "words")
    scratch.drop("rare-words")
    of_cliques = units.groupBy(F.col("c").alias("b")).agg(F.first("min_x").alias("min_x"), F.first("max_y").alias("max_y"))
    one = words.where("size = 1").select("word", "c", F.col("e").alias("e_c"), F.col("n").alias("n_c"), F.col("size").alias("size_c"), F.col("before").alias("before_c"), "hot")
    many = words.where("size > 1").groupBy("word", "c").agg(F.max("e").alias("e_c"), F.first("least_n").alias("n_c"), F.first("size").alias("size_c"), F.max_by("before", "e").alias("before_c"), F.first("hot").alias("hot"))
    cliques = one.union(many.select(*one.columns)).withColumnRenamed("c", "b").join(of_cliques.select("b", "max_y"), "b")
    cliques = _with_bits(cliques, nodes, "b", "bits_b").drop("hot")
    larger = (F.col("size_c") > F.col("size")) | ((F.col("size_c") == F.col("size")) & (F.col("b") > F.col("c")))
    enough = (ratio * F.col("n") <= F.col("e_c")) & (ratio * F.col("n_c") <= F.col("e"))
    limit = share * F.col("n") + F.col("max_y")
    new = ~F.arrays_overlap("before", "before_c") & _bits_near("bits_a", "bits_b", limit)
    met = _with_bits(words, nodes, "id", "bits_a").join(cliques.hint("merge"), "word").where(larger & enough & new)
    met = met.select(F.col("id").alias("a"), "b").distinct()
    of_a = nodes.select(F.col("id").alias("a"), "n", F.col("bits").alias("bits_a"))
    of_b = nodes.select(F.col("id").alias("b"), F.col("bits").alias("bits_b")).join(of_cliques, "b")
    near = met.join(of_a, "a").join(of_b, "b").where(_bits_near("bits_a", "bits_b", limit))
    near = scratch.save(near.select("a", "b", limit.alias("limit"), (share * F.col("n") + F.col("min_x")).alias("close")), "met")
    scratch.drop("words")
    return near


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Rows of c and a struct, in lists of about BLOCK."""
    of = rows.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(of, "c").withColumn("block", F.pmod(F.xxhash64(F.col(name)["id"]), F.col("blocks")))
    return dealt.groupBy("c", "block").agg(F.collect_list(name).alias(name)).withColumnRenamed("block", f"block_of_{name}")


def _sketch_links(nodes: DataFrame, rows: DataFrame, share: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b) of linked texts among buckets' members and their pivots, and the company of texts."""
    met, company = _met_pivots(nodes, scratch)
    limit = share * (F.col("n") + F.col("p.n"))
    pairs = met.where(F.abs(F.col("n") - F.col("p.n")) <= limit).select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), limit.alias("limit"), limit.alias("close"))
    pairs = scratch.save(pairs.distinct(), "bucket-pairs")
    for label in ("shared", "members"):
        scratch.drop(label)
    return _linked(pairs, nodes, rows, scratch, "bucket"), company


def _linked(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b) of the pairs (a, b, limit, close) that are linked."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), rows, nodes, scratch, f"{name}-texts")
    found = _measured(pairs, texts, scratch, f"{name}-measured").select("a", "b")
    for label in (f"{name}-texts", f"{name}-pairs"):
        scratch.drop(label)
    return found


def _parity(words: np.ndarray) -> tuple[int, int]:
    """The number of parities() of a text, and they as one number."""
    bits = parities(labelled_shingles(words, 1)).tobytes()
    return 8 * len(bits), int.from_bytes(bits, "little")


def _parities_apart(x: tuple[int, int], y: tuple[int, int]) -> int:
    """Bits that differ, the longer ones' halves added up until both are as long."""
    (n, p), (m, q) = sorted((x, y))
    while m > n:
        m //= 2
        q = q >> m ^ q & (1 << m) - 1
    return (p ^ q).bit_count()


def _first_links(share: float):
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for probes, members in zip(batch["probes"], batch["members"]):
                words = _word_lists([m["text"] for m in members])
                bits = [_parity(w) for w in words]
                for p in probes:
                    (own,) = _word_lists([p["text"]])
                    of_own = _parity(own)
                    for m, w, x in zip(members, words, bits):
                        limit = share * (len(own) + len(w))
                        if _parities_apart(of_own, x) <= limit + 1e-6 and distance(own, w, limit, limit) is not None:
                            out.append((p["id"], m["id"]))
                            break  # one link joins the text's group and this one
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return first


def _joined(nodes: DataFrame, groups: DataFrame, company: DataFrame, rows: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(node, label): groups (id, c) of linked texts, made whole by all links between them; the conditions are those of _candidates(),
    and that more of the rarest runs are shared than one in SLACK of the shorter text's words, or than two. The first three count: a
    text and a group that have three of the runs before one in common have met there.

    Runs of words are joined with groups, not with their texts: a group has a row for each, however many of its texts hold it. A text is
    then aligned with one text of each group that it shares enough words with, one of the most company that holds them. Only where
    this leaves text and group apart is it compared with the group's other texts.
    """
    share, ratio = _share(similarity), _in_common(similarity, _run(similarity))
    sized = groups.join(groups.join(nodes.select("id", "n"), "id").groupBy("c").agg(F.count("*").alias("size"), F.min("n").alias("least_n")), "c").join(company.select("id", "company"), "id", "left")
    words = _met_words(nodes, groups, scratch).join(nodes.select("id", "n"), "id").join(sized.drop("c"), "id")
    words = scratch.save(words.select("word", "id", "n", _rest(similarity, slack=True).alias("e"), _before(), "c", "size", "least_n", "company", (F.col("held") > HELD).alias("hot")), "words")
    scratch.drop("rare-words")
    many = words.where("size > 1").groupBy("word", "c").agg(F.max("e").alias("e_b"), F.first("least_n").alias("n_b"), F.first("size").alias("size_b"), F.max_by("before", "e").alias("before_b"), F.max_by("id", F.struct("company", "id")).alias("text_b"), F.lit(False).alias("hot"))
    one = words.where("size = 1").select("word", "c", F.col("e").alias("e_b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"), F.col("before").alias("before_b"), F.col("id").alias("text_b"), "hot")
    of_groups = one.union(many.select(*one.columns)).withColumnRenamed("c", "b")
    of_groups = _with_bits(of_groups, nodes, "text_b", "bits_b").drop("hot")
    larger = (F.col("size_b") > F.col("size")) | ((F.col("size_b") == F.col("size")) & (F.col("b") > F.col("c")))
    enough = (ratio * F.col("n") <= F.col("e_b")) & (ratio * F.col("n_b") <= F.col("e"))
    new, near = F.size(F.array_intersect("before", "before_b")) < 3, _bits_near("bits_a", "bits_b", share * (F.col("n") + F.col("n_b")))
    met = _with_bits(words, nodes, "id", "bits_a").join(of_groups.hint("merge"), "word").where(larger & enough & new & near).groupBy(F.col("id").alias("a"), "b")
    met = met.agg(F.count("*").alias("shared"), F.min(F.least("n", "n_b")).alias("shorter"), F.first("size_b").alias("size_b"), F.mode("text_b").alias("text_b"))
    met = scratch.save(met.where(F.col("shared") > F.least(F.floor(F.col("shorter") / SLACK), F.lit(2))).select("a", "b", "size_b", "text_b"), "met")
    scratch.drop("words")
    of_a, of_b = (nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in ("a", "text_b"))
    limit = share * (F.col("n_a") + F.col("n_text_b"))
    pairs = met.join(of_a, "a").join(of_b, "text_b").where(_bits_near("bits_a", "bits_text_b", limit))
    pairs = pairs.select("a", F.col("text_b").alias("b"), limit.alias("limit"), limit.alias("close"))
    links = groups.where("id <> c").select(F.col("id").alias("a"), F.col("c").alias("b"))
    links = scratch.save(links.union(_linked(scratch.save(pairs, "first-pairs"), nodes, rows, scratch, "first")), "first-links")
    labels = connected_components(links, scratch, "firsts", ALONE)
    now = scratch.save(_grouped(nodes, labels), "regrouped")
    x, y = (now.select(F.col("id").alias(i), F.col("c").alias(c)) for i, c in (("a", "x"), ("b", "y")))
    apart = scratch.save(met.where("size_b > 1").join(x, "a").join(y, "b").where("x <> y").select(F.col("a").alias("id"), F.col("b").alias("c")), "apart")
    scratch.drop("met")
    if apart.isEmpty():
        return labels
    members = scratch.save(groups.join(apart.select("c").distinct(), "c", "left_semi").select("id", "c"), "of-apart")
    texts = _texts_of(members.select("id").union(apart.select("id")), rows, nodes, scratch, "apart-texts")
    probes = apart.join(texts, "id").select("c", F.struct("id", "text").alias("probes"))
    members = members.join(texts, "id").select("c", F.struct("id", "text").alias("members"))
    blocks = scratch.save(_blocks(members, "members"), "member-blocks").join(scratch.save(_blocks(probes, "probes"), "probe-blocks"), "c")
    blocks = blocks.repartition(_tasks(rows), "c", "block_of_members", "block_of_probes").select("probes", "members")
    rest = scratch.save(blocks.mapInPandas(_first_links(share), "a long, b long"), "rest-links")
    return connected_components(scratch.save(links.union(rest), "all-links"), scratch, "labels", ALONE)


def _nodes(
    docs: DataFrame, id_col: str, text_col: str, similarity: float, scratch: Scratch
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (key, text, node), keys (key, node) and the different texts: nodes (node, least key, n, sketches, rare, bits, id)."""
    rows = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text"))
    rows = rows.select(*KEY, "text", F.unhex(F.md5("text")).alias("node"))
    counts = docs.sparkSession.sparkContext.broadcast(run_counts(rows, similarity))
    schema = f"{KEY_DDL}, node binary, n int, sketches array<long>, rare array<long>, bits array<long>"
    sketches = scratch.save(rows.mapInPandas(_sketch(counts, similarity), schema), "sketches")
    same = sketches.where("n > 0").groupBy("node")
    nodes = same.agg(F.min(F.struct(*KEY)).alias("least"), *[F.first(c).alias(c) for c in ("n", "sketches", "rare", "bits")])
    nodes = scratch.save(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    keys = scratch.save(sketches.select(*KEY, "node"), "keys")
    scratch.drop("sketches")
    return rows, keys, nodes


def _grouped(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes' id and the label of their component (their own id where they have no link)."""
    return nodes.select("id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("c"))


def class_members(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, scratch: Scratch | None = None
) -> DataFrame:
    """(key, class_id, class_text) as duplicate_classes() gives them, for callers that need no number of links.

    The links that sketches find make groups; the exact join then looks for links between groups only, as those within one do not
    change a class. So a group of many near copies costs what its texts and words cost, not their pairs.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    rows, keys, nodes = _nodes(docs, id_col, text_col, similarity, scratch)
    links, company = _sketch_links(nodes, rows, _share(similarity), scratch)
    labels = connected_components(links, scratch, "groups", ALONE)
    labels = _joined(nodes, scratch.save(_grouped(nodes, labels), "grouped"), company, rows, similarity, scratch)
    named = scratch.save(nodes.select("node", "id", "least").join(_grouped(nodes, labels), "id"), "named")
    by_node = named.join(named.groupBy("c").agg(F.min("least").alias("first")), "c").select("node", "first")
    first = F.coalesce("first", F.struct(*KEY))
    out = keys.join(by_node, "node", "left").select(*KEY, first["k_id"].alias("class_id"), first["k_text"].alias("class_text"))
    out = scratch.save(out, "in-classes")
    scratch.keep_only("in-classes")
    return out


def duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame]:
    """(key, the key of its class's first row as class_id and class_text, n_links of the row's text), and links (a, b) that make the classes, between numbers of different texts."""
    scratch = scratch or Scratch(docs.sparkSession, "near")
    share = _share(similarity)
    rows, keys, nodes = _nodes(docs, id_col, text_col, similarity, scratch)
    units = _cliques(nodes, rows, share, scratch)
    pairs = _candidates(nodes, units, similarity, scratch)
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), rows, nodes, scratch, "texts")
    measured = _measured(pairs, texts, scratch, "distances")
    scratch.drop("texts")
    sizes = units.groupBy(F.col("c").alias("b")).agg(F.first("size").alias("size"))
    found = scratch.save(measured.join(pairs, ["a", "b"]).join(sizes, "b").select("a", "b", "d", "size", (F.col("d") <= F.col("close") + 1e-6).alias("every")), "found")
    whole, in_part = found.where("every"), found.where("not every").select("a", F.col("b").alias("c"), "d")
    # Where some of a clique may be linked, its members are compared, block by block.
    of_parts = units.join(in_part.select("c").distinct(), "c", "left_semi").select("id", "c", "n", "r")
    wanted = of_parts.select("id").union(in_part.select("a"))
    texts = _texts_of(wanted, rows, nodes, scratch, "part-texts")
    members = of_parts.join(texts, "id").select("c", F.struct("id", "n", "r", "text").alias("members"))
    probes = in_part.withColumnRenamed("a", "id").join(units.select("id", "n"), "id").join(texts, "id").select("c", F.struct("id", "n", "d", "text").alias("probes"))
    blocks = scratch.save(_blocks(members, "members"), "member-blocks").join(scratch.save(_blocks(probes, "probes"), "probe-blocks"), "c")
    parts = scratch.save(blocks.repartition(_tasks(rows), "c", "block_of_members", "block_of_probes").mapInPandas(_count_links(share), "id long, c long, links long"), "parts")
    links = whole.select(F.col("a").alias("id"), F.col("size").alias("links")).union(parts.select("id", "links"))
    links = scratch.save(links.groupBy("id").agg(F.sum("links").alias("links")), "counted")
    to_clique = scratch.save(whole.groupBy(F.col("b").alias("c")).agg(F.count("*").alias("to_clique")), "to-cliques")
    edges = units.where("id <> c").select(F.col("id").alias("a"), F.col("c").alias("b")).union(whole.select("a", "b"))
    edges = scratch.save(edges.union(parts.where("c is not null and links > 0").select("id", "c")).distinct(), "links")
    labels = connected_components(edges, scratch, "labels")
    none = F.lit(0).cast("long")
    n_links = (F.col("size") - 1 + F.coalesce("links", none) + F.coalesce("to_clique", none)).alias("n_links")
    degrees = units.join(links, "id", "left").join(to_clique, "c", "left").select("id", n_links)
    named = nodes.select("node", "id", "least").join(labels, nodes.id == labels.node, "left").select(nodes.node, "id", "least", F.coalesce("label", "id").alias("label"))
    named = scratch.save(named.join(degrees, "id"), "named")
    classes = scratch.save(named.groupBy("label").agg(F.min("least").alias("first")), "classes")
    by_node = scratch.save(named.join(classes, "label").select("node", "first", "n_links"), "by-node")
    out = keys.join(by_node, "node", "left")
    first = F.coalesce("first", F.struct(*KEY))
    out = out.select(*KEY, first["k_id"].alias("class_id"), first["k_text"].alias("class_text"), F.coalesce("n_links", none).alias("n_links"))
    out = scratch.save(out, "in-classes")
    scratch.keep_only("in-classes", "links")
    return out, edges


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class: the one of the least id (of equal ids, the least text hash; of equal rows, one)."""
    scratch = Scratch(docs.sparkSession, "near-kept")
    near = Scratch(docs.sparkSession, "near")
    classes = class_members(docs, id_col, text_col, similarity, near)
    kept = scratch.save(classes.where("k_id = class_id and k_text = class_text").select(*KEY).distinct(), "kept")
    near.drop("")
    keyed = docs.withColumns(dict(zip(KEY, row_key(id_col, text_col))))
    one = keyed.join(kept, KEY, "left_semi")
    # Rows equal in id and text are few; those of one key stand together now.
    return one.dropDuplicates(KEY).select(*docs.columns)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, class_id (the least doc_id of its class), n_links of its text to other texts."""
    classes, _ = duplicate_classes(load_documents(spark, sf_dir))
    none = F.lit(-(2**63)).cast("long")
    return classes.select(F.nullif("k_id", none).alias("doc_id"), F.nullif("class_id", none).alias("class_id"), "n_links")
