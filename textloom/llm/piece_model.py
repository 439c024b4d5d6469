"""A SentencePiece byte-fallback BPE model as a max-plus lattice.

The BPE encoding of a text is the only path through its piece lattice on which every two neighbouring pieces are *consistent*:
BPE of their concatenation gives the two pieces back. Consistent arcs weigh their piece's score and all others minus infinity,
so the best path is the encoding, and everything a max-plus (tropical) scan offers applies:

* ``segment`` walks a short text left to right; each prefix has one best path, so one last piece per position is enough;
* ``transfer`` gives a chunk's matrix from the states at its left edge (pieces that touch or cross it) to those at its right;
* ``scan`` combines matrices associatively, and ``backtrace`` finds a chunk's pieces from its own two edge states alone.

A place that no piece can span (its two characters stand together in no piece) has a single state.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
import regex

from .tokens import trim

SPACE = "▁"
MINUS = -np.inf
#: A word from this length on is walked by chunks.
LONG_WORD = 4096
#: Characters of a beginning whose walk is kept; lengths to try behind those of longer pieces.
HEAD, _SHORT = 5, [2, 1]


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != 2 or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE model with identity normalisation is needed")
        self.prefix = SPACE if m.normalizer_spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.scores = np.array([p.score for p in m.pieces])
        self.score = {p: float(self.scores[i]) for p, i in self.ids.items()}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.longest = max(map(len, self.ids))
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Words begin with their spaces if no piece has a space after another character.
        self.spaced = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.word = regex.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if self.spaced else r"(?s).+")
        self.output = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" for p in m.pieces]
        self.known: dict[str, bool] = {}
        self.rank = {p: -s for p, s in self.score.items()}
        #: The two parts of each piece's last merge; pieces that BPE never makes are none.
        self.parts: dict[str, tuple[str, str]] = {}
        for p in sorted(self.ids, key=len):
            if len(p) > 1:
                if split := self._last_merge(p):
                    self.parts[p] = split
                else:
                    self.ids.pop(p)
        self.memo: dict[str, bytes] = {}
        self.segments: dict[str, bytes] = {}
        #: By the last three characters of a piece, the lengths of pieces that end so, longest first.
        self.sizes: dict[str, list[int]] = {}
        for p in self.ids:
            if len(p) > 2 and len(p) not in self.sizes.setdefault(p[-3:], []):
                self.sizes[p[-3:]].append(len(p))
        for lengths in self.sizes.values():
            lengths.sort(reverse=True)
            lengths += _SHORT
        self.heads: dict[str, list[str]] = {}

    def normalise(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def cut(self, text: str, i: int) -> bool:
        """Whether no piece spans place i."""
        return i == 0 or i == len(text) or text[i - 1 : i + 1] not in self.pairs

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = MINUS, -1
            for i in range(len(parts) - 1):
                if (s := self.score.get(parts[i] + parts[i + 1], MINUS)) > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        parts = list(piece)
        while len(parts) > 2:
            best, at = MINUS, -1
            for i in range(len(parts) - 1):
                if (s := self.score.get(parts[i] + parts[i + 1], MINUS)) > best:
                    best, at = s, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def consistent(self, a: str, b: str) -> bool:
        """Whether BPE of a + b gives a and b back.

        The last merges of either side are undone, the later one first: if the parts that then meet could merge, and better than
        what has just been undone, they would have merged before it. Of equal merges the left one goes first.
        """
        if a[-1] + b[0] not in self.pairs:
            return True
        key = a + "\0" + b
        if (found := self.known.get(key)) is not None:
            return found
        if a[-1] == b[0] == SPACE:  # runs of spaces have equal scores
            found = self.merge(a + b) == [a, b]
        else:
            found, limit, x, y, rank, parts = True, 1e18, a, b, self.rank, self.parts
            while True:
                if rank.get(x + y, 1e18) < limit:
                    found = False
                    break
                rx, ry = rank.get(x, -1.0) if x in parts else -1.0, rank.get(y, -1.0) if y in parts else -1.0
                if rx < 0 and ry < 0:
                    break
                if rx > ry:
                    limit, x = rx, parts[x][1]
                else:
                    limit, y = ry + 0.5, parts[y][0]
        self.known[key] = found
        return found

    def arcs(self, text: str, i: int) -> list[str]:
        """Pieces, and single characters, that stand at place i."""
        out = [text[i : i + n] for n in range(1, min(self.longest, len(text) - i) + 1)]
        return [p for k, p in enumerate(out) if k == 0 or p in self.ids]

    def segment(self, text: str) -> list[str]:
        """The best path of a text without places that no piece spans, by one walk over it.

        The last piece of a prefix's best path depends on the prefix alone, so what common beginnings give is kept.
        """
        ids, known, sizes, n_text = self.ids, self.known, self.sizes, len(text)
        head = self.heads.get(text[:HEAD]) if n_text > HEAD else None
        last = head + [""] * (n_text - HEAD) if head else [""] * (n_text + 1)
        for i in range(HEAD + 1 if head else 1, n_text + 1):
            for n in sizes.get(text[i - 3 : i] if i > 2 else text[:i], _SHORT):
                if n < i:
                    p = text[i - n : i]
                    if (n == 1 or p in ids) and (before := last[i - n]):
                        if (ok := known.get(before + "\0" + p)) is None:
                            ok = self.consistent(before, p)
                        if ok:
                            last[i] = p
                            break
                elif n == i and (n == 1 or text[:i] in ids):
                    last[i] = text[:i]
                    break
        if head is None and n_text > HEAD:
            self.heads[text[:HEAD]] = last[: HEAD + 1]
        out, i = [], n_text
        while i:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def word_ids(self, word: str) -> bytes:
        """Ids of a word: of its parts between places that no piece spans, each kept."""
        pairs, memo, start, out = self.pairs, self.segments, 0, []
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                part, start = word[start:i], i
                if (found := memo.get(part)) is None:
                    found = memo[part] = self.to_ids(self.segment(part)).tobytes()
                out.append(found)
        part = word[start:]
        if (found := memo.get(part)) is None:
            found = memo[part] = self.to_ids(self.segment(part)).tobytes()
        return b"".join((*out, found)) if out else found

    def weight(self, piece: str) -> float:
        return self.score.get(piece, 0.0)

    # Chunks: text is a chunk with as many characters around it as the longest piece has (fewer at the document's ends).

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that touch place at from the left or cross it; one state, (at, at), where none can cross."""
        if self.cut(text, at):
            return [(at, at)]
        found = []
        for s in range(max(0, at - self.longest), at):
            found += [(s, s + len(p)) for p in self.arcs(text, s) if s + len(p) >= at]
        return sorted(found)

    def _paths(self, text: str, a: int, b: int) -> tuple[list, list, dict, dict]:
        """Best sums from each state at a to each node, node = (start, end) of a piece, and the node before, by state at a."""
        left, right = self.states(text, a), self.states(text, b)
        value: dict[tuple[int, int], np.ndarray] = {}
        came: dict[tuple[int, int], list] = {}
        ending: dict[int, list[tuple[int, int]]] = {}
        for k, node in enumerate(left):
            value[node] = np.full(len(left), MINUS)
            value[node][k], came[node] = 0.0, [None] * len(left)
            ending.setdefault(node[1], []).append(node)
        for i in range(a, b):
            before = ending.get(i, [])
            if not before:
                continue
            for p in self.arcs(text, i):
                node = (i, i + len(p))
                best, via = np.full(len(left), MINUS), [None] * len(left)
                for prior in before:
                    if prior[0] == prior[1] or self.consistent(text[prior[0] : prior[1]], p):
                        better = value[prior] + self.weight(p) > best
                        best = np.where(better, value[prior] + self.weight(p), best)
                        via = [prior if x else v for x, v in zip(better, via)]
                if (best > MINUS).any():
                    value[node], came[node] = best, via
                    ending.setdefault(node[1], []).append(node)
        return left, right, value, came

    def _enter(self, text: str, b: int, right: list, value: dict, left: list) -> dict:
        """For each state at b, the node whose value it takes: itself, or the best that ends at a place none can cross."""
        if right != [(b, b)]:
            return {s: s for s in right}
        none = np.full(len(left), MINUS)
        ends = [n for n in value if n[1] == b]
        return {(b, b): [max(ends, key=lambda n: value.get(n, none)[k], default=(b, b)) for k in range(len(left))]}

    def _cuts(self, text: str, a: int, b: int) -> tuple[int, int]:
        """The first and the last place in [a, b] with one state; (b + 1, b + 1) if there is none."""
        first = next((i for i in range(a, b + 1) if self.cut(text, i)), b + 1)
        return first, next((i for i in range(b, first, -1) if self.cut(text, i)), first)

    def transfer(self, text: str, a: int, b: int) -> np.ndarray:
        """Matrix from states(text, a) to states(text, b) of the chunk [a, b), a < b."""
        first, last = self._cuts(text, a, b)
        if first < last:  # paths meet at a place with one state: an outer product around what stands between
            head = self.transfer(text, a, first) if first > a else np.zeros((1, 1))
            tail = self.transfer(text, last, b) if last < b else np.zeros((1, 1))
            return maxplus(head + float(self.scores[self.encode_normalised(text[first:last])].sum()), tail)
        left, right, value, _ = self._paths(text, a, b)
        none = np.full(len(left), MINUS)
        chosen = self._enter(text, b, right, value, left)
        columns = [value.get(chosen[s], none) if isinstance(chosen[s], tuple) else np.array([value.get(n, none)[k] for k, n in enumerate(chosen[s])]) for s in right]
        return np.stack(columns, 1)

    def backtrace(self, text: str, a: int, b: int, entry: int, leave: int) -> np.ndarray:
        """Ids of the pieces that start in [a, b), from the state on either edge."""
        first, last = self._cuts(text, a, b)
        if first < last:
            head = [self.backtrace(text, a, first, entry, 0)] if first > a else []
            tail = [self.backtrace(text, last, b, 0, leave)] if last < b else []
            return np.concatenate([*head, self.encode_normalised(text[first:last]), *tail])
        left, right, value, came = self._paths(text, a, b)
        chosen = self._enter(text, b, right, value, left)[right[leave]]
        node = chosen[entry] if isinstance(chosen, list) else chosen
        out = []
        while node and node != left[entry]:
            out.append(text[node[0] : node[1]])
            node = came[node][entry]
        return self.to_ids(out[::-1])

    # Whole texts of any length in one process.

    def scanned(self, text: str, chunk: int = 1024) -> np.ndarray:
        """Ids of a normalised text by chunks, transfer matrices and their scan."""
        edges = [*range(0, len(text), chunk), len(text)]
        spans = list(zip(edges, edges[1:]))
        path = best_states([self.transfer(text, a, b) for a, b in spans])
        return np.concatenate([self.backtrace(text, a, b, x, y) for (a, b), (x, y) in zip(spans, path)])

    def to_ids(self, pieces: list[str]) -> np.ndarray:
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
        return np.frombuffer(array("I", out), "<u4")

    def encode_normalised(self, text: str) -> np.ndarray:
        memo = self.memo
        if self.spaced and SPACE * 2 not in text and not text.endswith(SPACE):
            first, *rest = text.split(SPACE)
            words = [SPACE + w for w in rest]
            words[:0] = [first] if first else []
        else:
            words = self.word.findall(text)
        trim(memo, 400_000, 150_000)
        trim(self.segments, 250_000, 100_000)
        trim(self.heads, 100_000, 50_000)
        trim(self.known, 250_000, 150_000)
        for w in (w for w in set(words) if w not in memo):
            memo[w] = self.word_ids(w) if len(w) <= LONG_WORD else self.scanned(w).tobytes()
        return np.frombuffer(b"".join(map(memo.__getitem__, words)), "<u4")

    def encode(self, text: str) -> np.ndarray:
        return self.encode_normalised(self.normalise(text))

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.output.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product over (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, pairs first: the associative scan of depth log n."""
    if len(matrices) < 2:
        return list(matrices)
    pairs = scan([maxplus(a, b) for a, b in zip(matrices[::2], matrices[1::2])])
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(pairs[i // 2] if i % 2 else maxplus(pairs[i // 2 - 1], matrices[i]))
    return out


def best_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, leave) states of each chunk on the best path, from prefix and suffix products."""
    forward = [m[0] for m in scan(matrices)]
    at = [int(np.argmax(f + b)) for f, b in zip(forward, _suffixes(matrices))]
    return list(zip([0, *at[:-1]], at))


def _suffixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """For each chunk's right edge, the best sum from each state to the end."""
    tails = [t.T for t in scan([m.T for m in matrices[::-1]])][::-1]  # tails[i]: product of matrices i..end
    return [*(t[:, 0] for t in tails[1:]), np.zeros(matrices[-1].shape[1])]


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)
