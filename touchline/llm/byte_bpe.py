"""Byte-level BPE encoding and decoding by published ranks.

Pre-tokenisation uses no regular expression. Each code point gets a class (letter, number, white space, other), and each
position one of nine symbols. A symbol is a transition function over eight states of the splitter; functions are composed with
an associative scan (composition is one table lookup, since only a few dozen functions ever occur), which gives the state
before each position and so every boundary. Slices between boundaries go to pair merging behind a bounded cache. Byte offsets
of tokens stay available, and decoding goes from ids to bytes through the vocabulary alone.

Null texts count as empty; an empty text has no tokens. Rows that repeat are each encoded. Extra columns are left behind.
Letters and numbers follow this Python's Unicode tables; white space is the White_Space property.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from touchline.llm.base import over_texts

# White_Space of the Unicode Character Database.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, SPACE = range(4)
# Symbols: classes with what follows taken in. SHORT and LONG: an apostrophe before a contraction of one or two letters.
# JOIN: a space before a word; LAST: another single white space before a word; MORE: white space with white space or the end after it.
S_LETTER, S_NUMBER, S_OTHER, SHORT, LONG, JOIN, LAST, MORE, RESET = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINED, IN_SPACE, ONE_LEFT, TWO_LEFT = range(8)

# Pieces kept by a worker, beside those of the texts at hand; longer pieces than SHORT_PIECE bytes are merged one by one.
CACHE = 300_000
SHORT_PIECE = 48


def step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at this position."""
    if symbol == RESET:
        return FRESH, True
    if state in (ONE_LEFT, TWO_LEFT):
        return (ONE_LEFT if state == TWO_LEFT else FRESH), False
    goes = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER}
    if symbol in goes:
        return goes[symbol], state not in (goes[symbol], JOINED)
    if symbol in (SHORT, LONG):
        if state in (IN_OTHER, JOINED):
            return IN_OTHER, False
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol == MORE:
        return IN_SPACE, state != IN_SPACE
    return (JOINED if symbol == JOIN else FRESH), True


class Scan:
    """All compositions of the nine transition functions as one table, and the blocked scan over it."""

    def __init__(self, width: int = 128):
        self.width = width
        single = [tuple(step(s, x)[0] for s in range(8)) for x in range(9)]
        names = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *single]))}
        todo = list(names)
        while todo:
            f = todo.pop()
            for g in single:
                h = tuple(g[s] for s in f)
                if h not in names:
                    names[h] = len(names)
                    todo.append(h)
        functions = list(names)
        self.symbol = np.array([names[f] for f in single], np.uint8 if len(names) < 256 else np.uint16)
        self.after = np.array(functions, np.uint8)
        self.compose = np.zeros((len(names), len(names)), self.symbol.dtype)
        for (i, f), (j, g) in product(enumerate(functions), repeat=2):
            self.compose[i, j] = names[tuple(g[s] for s in f)]
        self.begins = np.array([[step(s, x)[1] for x in range(9)] for s in range(8)])

    def _prefixes(self, line: np.ndarray) -> np.ndarray:
        if len(line) <= self.width:
            out = line.copy()
            for i in range(1, len(out)):
                out[i] = self.compose[out[i - 1], out[i]]
            return out
        blocks = -(-len(line) // self.width)
        padded = np.zeros(blocks * self.width, line.dtype)  # 0 is the identity
        padded[: len(line)] = line
        across = np.ascontiguousarray(padded.reshape(blocks, self.width).T)
        for k in range(1, self.width):
            across[k] = self.compose[across[k - 1], across[k]]
        before = np.zeros(blocks, line.dtype)
        before[1:] = self._prefixes(across[-1].copy())[:-1]
        for k in range(self.width):
            across[k] = self.compose[before, across[k]]
        return np.ascontiguousarray(across.T).reshape(-1)[: len(line)]

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Positions at which a piece begins, the state before the first position being fresh."""
        state = np.empty(len(symbols), np.uint8)
        state[0] = FRESH
        state[1:] = self.after[self._prefixes(self.symbol[symbols]), FRESH][:-1]
        return np.flatnonzero(self.begins[state, symbols])


def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = LETTER
        elif kind == "N":
            out[point] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


class Splitter:
    def __init__(self):
        self.classes, self.scan = classes(), Scan()

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``ends``: positions of the separators behind each text."""
        kind = self.classes[points]
        out = kind.copy()  # LETTER, NUMBER and OTHER are their own symbols
        kind[ends] = RESET
        after = np.append(kind[1:], RESET)
        space = kind == SPACE
        ends_word = (after == SPACE) | (after == RESET)
        out[space] = np.where(ends_word, MORE, np.where(points == 0x20, JOIN, LAST))[space]
        quotes = np.flatnonzero((points == 0x27) & (kind == OTHER))
        if len(quotes):
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            inside = np.concatenate([kind == LETTER, np.zeros(2, bool)])
            one, two = np.where(inside[quotes + 1], padded[quotes + 1], 0), np.where(inside[quotes + 2], padded[quotes + 2], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            pairs = (("r", "e"), ("v", "e"), ("l", "l"))
            long = np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in pairs])
            out[quotes[short]] = SHORT
            out[quotes[long]] = LONG
        out[ends] = RESET
        return out

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Pieces of all texts, and the first piece of each text (one more entry at the end)."""
        whole = "\n".join(texts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = self.scan.starts(self.symbols(points, ends))
        stops = np.append(starts[1:], len(whole))
        text = np.ones(len(whole), bool)
        text[ends] = False
        own = text[starts]
        first = np.concatenate([[0], np.cumsum(own)[np.searchsorted(starts, ends)]])
        return [whole[a:b] for a, b in zip(starts[own].tolist(), stops[own].tolist(), strict=True)], first


class Pairs:
    """Merges many short pieces at once: a row of ids for each piece, one merge a row in each pass."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        found = [
            (ranks[token[:i]] * self.size + ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        found.sort()
        self.key = np.array([k for k, _ in found], np.int64)
        self.rank = np.array([r for _, r in found], np.int32)
        left, right = np.meshgrid(self.single, self.single, indexing="ij")
        self.of_bytes = self.of(left.ravel(), right.ravel()).reshape(256, 256)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], self.NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, little-endian; the pieces should be of similar length."""
        size = np.array([len(p) for p in pieces])
        wide = int(size.max()) + 1
        table = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(-1, wide)
        column = np.arange(wide)
        ids = self.single[table]
        rank = np.full(ids.shape, self.NONE)
        rank[:, :-1] = self.of_bytes[table[:, :-1], table[:, 1:]]
        rank[column[None, :] >= size[:, None] - 1] = self.NONE
        out: list[bytes] = [b""] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), at]
            done = low == self.NONE
            if done.any():
                flat, step_by = ids[done].astype("<u4").tobytes(), 4 * wide
                for k, (row, n) in enumerate(zip(rows[done].tolist(), size[done].tolist(), strict=True)):
                    out[row] = flat[k * step_by : k * step_by + 4 * n]
            on = ~done
            rows, ids, rank, size, at, low = rows[on], ids[on], rank[on], size[on] - 1, at[on], low[on]
            here = np.arange(len(rows))
            behind = column[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(behind, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(behind, rank[:, 1:], rank[:, :-1])
            ids[here, at] = low
            right = at + 1 < size
            rank[here, at] = np.where(right, self.of(low, ids[here, np.minimum(at + 1, wide - 1)]), self.NONE)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.of(ids[left, at[left] - 1], low[left])
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long piece: the pair of the lowest rank is merged first, the leftmost of equal ones."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    stop, right, left = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if gone[i] or gone[j] or right[i] != j or stop[j] != end:
            continue
        gone[j] = 1
        stop[i], right[i] = end, right[j]
        if right[i] < n:
            left[right[i]] = i
            k = right[i]
            if (r := ranks.get(piece[i : stop[k]])) is not None:
                heapq.heappush(heap, (r, i, k, stop[k]))
        if left[i] >= 0 and (r := ranks.get(piece[left[i] : end])) is not None:
            heapq.heappush(heap, (r, left[i], i, end))
    return [ranks[piece[i : stop[i]]] for i in range(n) if not gone[i]]


class Coder:
    """Encodes and decodes lists of texts; one per Python worker."""

    def __init__(self, vocabulary: bytes, cache: int = CACHE):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.splitter, self.pairs = Splitter(), Pairs(self.ranks)
        self.cache: dict[str, bytes] = {}
        self.most = cache

    def _learn(self, missing: list[str]) -> None:
        """Put pieces into the cache; those in the vocabulary as they are, short ones together by length, long ones alone."""
        short: dict[int, list[tuple[str, bytes]]] = {}
        for text in missing:
            piece = text.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(piece)
            if rank is not None:
                self.cache[text] = rank.to_bytes(4, "little")
            elif len(piece) <= SHORT_PIECE:
                short.setdefault(len(piece) // 4, []).append((text, piece))
            else:
                self.cache[text] = np.array(merge(piece, self.ranks), "<u4").tobytes()
        for group in short.values():
            self.cache.update(zip([t for t, _ in group], self.pairs.merge([p for _, p in group]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces, first = self.splitter.split(texts)
        cache = self.cache
        self._learn([p for p in set(pieces) if p not in cache])
        ids = [cache[p] for p in pieces]
        if len(cache) > self.most:
            cache.clear()
        return [b"".join(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes) -> np.ndarray:
        """The byte at which each token of a text begins."""
        sizes = [len(self.bytes_of[i]) for i in np.frombuffer(ids, "<u4").tolist()]
        return np.cumsum([0, *sizes])[:-1]


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """One coder per worker and vocabulary; the cache lives as long as the worker."""
    vocabulary = shared.value
    key = hash(vocabulary)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(vocabulary)
    return _coders[key]


def _shared(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` with ``ids`` (binary, little-endian uint32) and ``starts`` (byte offset of each token)."""
    shared = _shared(docs, path)

    def work(texts: list[bytes]) -> dict[str, list]:
        coder = _coder(shared)
        ids = coder.encode([t.decode("utf-8", "replace") for t in texts])
        return {"ids": ids, "starts": [coder.offsets(i).astype("int64").tolist() for i in ids]}

    return over_texts(docs, work, "ids binary, starts array<bigint>", *keep)


def decode(encoded: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` with ``decoded`` (binary) from the column ``ids`` alone; null ids give no bytes."""
    shared = _shared(encoded, path)

    def work(ids: list[bytes]) -> dict[str, list]:
        return {"decoded": [_coder(shared).decode(i) for i in ids]}

    return over_texts(encoded.withColumn("text", encoded["ids"]), work, "decoded binary", *keep)


def digests(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """Encode, decode again, and keep only the number of tokens and digests of ids and decoded bytes."""
    shared = _shared(docs, path)

    def work(texts: list[bytes]) -> dict[str, list]:
        coder = _coder(shared)
        ids = coder.encode([t.decode("utf-8", "replace") for t in texts])
        return {
            "n_tokens": [len(i) // 4 for i in ids],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(coder.decode(i)).hexdigest() for i in ids],
        }

    return over_texts(docs, work, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", *keep)
