"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of words in which words ``period`` apart are identical, ``period`` is the smallest such number, at least
``max(least, 3 * period)`` words long, and longer to neither side. Re-Pair replaces repeated pairs of symbols by new symbols;
what is left of a text is closed by a balanced tree. A run of the text crosses the middle of the lowest symbol that spans it,
so the runs across the middle of each symbol are computed once, at one of its places, then copied to all its places, and of
intervals with one period those inside another go.

Candidates of a symbol are the distances from its middle to further places of the few words next to the middle: of a run across
the middle, one side holds at least half, so those words come again one period away. Lengths follow by binary search over
prefix hashes (62 bits). Every text is worked on whole and by itself; memory is about 300 bytes a word of a chunk or text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.base import over_texts
from touchline.llm.hashing import mix

LEAST = 24
# Candidates that are extended at once.
CANDIDATES = 400_000
PRIMES = ((2147483647, 1103515245), (2147483629, 1664525))


def word_ids(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word; equal words of one text share it, words of different texts never do."""
    numbers = count()
    out: list[int] = []
    for words in texts:
        known: defaultdict[bytes, int] = defaultdict(numbers.__next__)
        out += map(known.__getitem__, words)
    return np.array(out, np.int64)


class Grammar:
    """Nonterminals by ``begin``, ``middle``, ``end`` of one of their places, and all places (``symbol``, ``place``)."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self._spans: list[tuple[np.ndarray, ...]] = []
        self._places: list[tuple[np.ndarray, np.ndarray]] = []
        self._number, self._base = 0, int(words.max()) + 1 if len(words) else 0
        self._symbols, self._at, self._size = words.copy(), np.arange(len(words)), np.ones(len(words), np.int64)
        self._pair_up()
        self._close(text)
        self.begin, self.middle, self.end = (np.concatenate(c) if c else np.empty(0, np.int64) for c in self._columns(self._spans, 3))
        self.symbol, self.place = (np.concatenate(c) if c else np.empty(0, np.int64) for c in self._columns(self._places, 2))

    @staticmethod
    def _columns(rows: list, n: int) -> list[list[np.ndarray]]:
        return [[r[k] for r in rows] for k in range(n)]

    def _replace(self, left: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Put new symbol ``kind[k]`` over positions ``left[k]`` and the next; ``first`` has one ``left`` for each kind. Returns what stays."""
        at, size = self._at, self._size
        self._spans.append((at[first], at[first + 1], at[first + 1] + size[first + 1]))
        self._places.append((self._number + kind, at[left]))
        self._symbols[left] = self._base + self._number + kind
        size[left] += size[left + 1]
        self._number += len(first)
        stays = np.ones(len(at), bool)
        stays[left + 1] = False
        self._symbols, self._at, self._size = self._symbols[stays], at[stays], size[stays]
        return stays

    def _pair_up(self) -> None:
        """Replace repeated pairs; of overlapping ones the more frequent first, ties by number, all over the chunk at once."""
        live = np.arange(len(self._symbols) - 1)
        while len(live):
            pairs, of, times = np.unique(self._symbols[live] << 32 | self._symbols[live + 1], return_inverse=True, return_counts=True)
            again = times[of] > 1
            live, of = live[again], of[again]
            if not len(live):
                return
            rank = np.empty(len(pairs), np.int64)
            rank[np.argsort(times, kind="stable")] = np.arange(len(pairs))
            rank = rank[of]
            touch = np.diff(live) == 1
            opens = np.concatenate([[True], ~touch | (np.diff(rank) != 0)])
            group = np.flatnonzero(opens)
            before = np.where(np.concatenate([[False], touch])[group], rank[group - 1], -1)
            last = np.concatenate([group[1:], [len(live)]]) - 1
            after = np.where(np.concatenate([touch, [False]])[last], rank[np.minimum(last + 1, len(live) - 1)], -1)
            wins = (rank[group] > before) & (rank[group] > after)
            number = np.cumsum(opens) - 1
            taken = wins[number] & ((np.arange(len(live)) - group[number]) % 2 == 0)
            left = live[taken]
            _, first, kind = np.unique(of[taken], return_index=True, return_inverse=True)
            stays = self._replace(left, kind, left[first])
            now = np.cumsum(stays) - 1
            new = now[left]
            live = np.unique(np.concatenate([now[live[stays[live]]], new, new - 1]))
            live = live[(live >= 0) & (live < len(self._symbols) - 1)]

    def _close(self, text: np.ndarray) -> None:
        """Join neighbours of one text two by two until each text is one symbol."""
        while True:
            own = text[self._at]
            opens = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.empty(0, bool)
            starts = np.flatnonzero(opens)
            if len(starts) == len(own):
                return
            odd = (np.arange(len(own)) - starts[np.cumsum(opens) - 1]) % 2
            left = np.flatnonzero((odd[:-1] == 0) & (own[:-1] == own[1:]))
            self._replace(left, np.arange(len(left)), left)


class Prefixes:
    """Prefix hashes of words, for the length of common stretches at a distance."""

    def __init__(self, words: np.ndarray):
        self._parts = []
        for prime, base in PRIMES:
            powers = np.ones(len(words) + 1, np.int64)
            filled = 1
            while filled < len(powers):
                step = powers[filled - 1] * base % prime
                take = min(filled, len(powers) - filled)
                powers[filled : filled + take] = powers[:take] * step % prime
                filled += take
            own = (words + 1) * 2654435761 % prime * powers[:-1] % prime
            sums = np.concatenate([[0], np.cumsum(own) % prime])
            self._parts.append((prime, powers, sums))

    def same(self, i: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``i`` equal those from ``i + apart``."""
        out = np.ones(len(i), bool)
        for prime, powers, sums in self._parts:
            near, far = sums[i + length] - sums[i], sums[i + apart + length] - sums[i + apart]
            out &= near % prime * powers[apart] % prime == far % prime
        return out

    def ahead(self, i: np.ndarray, apart: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal the words ``apart`` further, at most ``most``."""
        return self._search(lambda n: self.same(i, apart, n), most)

    def behind(self, i: np.ndarray, apart: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``i`` equal the words ``apart`` further, at most ``most``."""
        return self._search(lambda n: self.same(i - n, apart, n), most)

    @staticmethod
    def _search(holds, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), np.maximum(most, 0)
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = holds(middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def _candidates(words: np.ndarray, grammar: Grammar, least: int):
    """Slices of ``(symbol, anchor, period)``: the words from the anchor on come again one period later."""
    width = -(-least // 6)
    places = len(words) - width + 1
    big = np.flatnonzero(grammar.end - grammar.begin >= least)
    if places < 1 or not len(big):
        return
    grams = words[:places].astype(np.uint64)
    for k in range(1, width):
        grams = mix(grams) + words[k : places + k].astype(np.uint64)
    order = np.argsort(grams, kind="stable")
    changes = np.concatenate([[0], np.cumsum(grams[order][1:] != grams[order][:-1])])
    keys = changes * places + order
    rank = np.empty(places, np.int64)
    rank[order] = np.arange(places)
    begin, middle, end = grammar.begin[big], grammar.middle[big], grammar.end[big]
    jobs = []
    right = (end - middle) * 2 // 3
    fits = middle + width <= end
    own = rank[np.where(fits, middle, 0)]
    # Cheap test first: the next place of the same words is near enough.
    following = np.minimum(own + 1, places - 1)
    fits &= (own + 1 < places) & (changes[following] == changes[own]) & (order[following] - middle <= right)
    at = np.flatnonzero(fits)
    jobs.append((big[at], middle[at], own[at] + 1, np.searchsorted(keys, changes[own[at]] * places + middle[at] + right[at], "right"), True))
    left = (middle - begin) * 2 // 3
    spot = middle - width
    fits = spot >= begin
    own = rank[np.where(fits, spot, 0)]
    earlier = np.maximum(own - 1, 0)
    fits &= (own > 0) & (changes[earlier] == changes[own]) & (spot - order[earlier] <= left)
    at = np.flatnonzero(fits)
    jobs.append((big[at], spot[at], np.searchsorted(keys, changes[own[at]] * places + spot[at] - left[at], "left"), own[at], False))
    for symbol, spot, low, high, onward in jobs:
        sizes = np.cumsum(high - low)
        done = 0
        while done < len(symbol):
            stop = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + CANDIDATES, "right")))
            number = high[done:stop] - low[done:stop]
            which = np.repeat(np.arange(done, stop), number)
            other = order[np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number) + low[which]]
            here = spot[which]
            yield symbol[which], np.minimum(here, other), np.abs(other - here)
            done = stop


def runs_of(words: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start``, ``length``, ``period`` of all runs, by start, then period. ``text`` has the text of each word, ascending."""
    grammar = Grammar(words, text)
    prefixes, found = None, []
    for symbol, anchor, period in _candidates(words, grammar, least):
        prefixes = prefixes or Prefixes(words)
        ahead = prefixes.ahead(anchor, period, grammar.end[symbol] - period - anchor)
        behind = prefixes.behind(anchor, period, anchor - grammar.begin[symbol])
        length = ahead + behind + period
        good = length >= np.maximum(least, 3 * period)
        found.append(np.stack([symbol[good], (anchor - behind)[good], length[good], period[good]]))
    table = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
    # Multiples of the smallest period give the same interval.
    table = table[:, np.lexsort((table[3], table[2], table[1], table[0]))]
    first = np.concatenate([[True], (np.diff(table[:3]) != 0).any(axis=0)])[: table.shape[1]]
    symbol, start, length, period = table[:, first]
    order = np.argsort(grammar.symbol, kind="stable")
    sorted_symbols = grammar.symbol[order]
    low, high = np.searchsorted(sorted_symbols, symbol, "left"), np.searchsorted(sorted_symbols, symbol, "right")
    which = np.repeat(np.arange(len(symbol)), high - low)
    place = grammar.place[order[np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[which]]]
    start, length, period = start[which] - grammar.begin[symbol[which]] + place, length[which], period[which]
    order = np.lexsort((-length, start, period))
    start, length, period = start[order], length[order], period[order]
    far = len(words) + 1
    reach = np.maximum.accumulate(period * far + start + length) if len(start) else start
    stays = np.concatenate([[True], (period * far + start + length)[1:] > reach[:-1]])[: len(start)]
    start, length, period = start[stays], length[stays], period[stays]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _work(texts: list[bytes], least: int) -> dict[str, list]:
    words = [t.split() for t in texts]
    number = np.array([len(w) for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(number)])
    start, length, period = runs_of(word_ids(words), np.repeat(np.arange(len(texts)), number), least)
    owner = np.searchsorted(first, start, "right") - 1
    runs: list[list[dict]] = [[] for _ in texts]
    dropped: dict[int, np.ndarray] = {}
    for k, s, n, q in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        begin = s - int(first[k])
        runs[k].append({"start": begin, "length": n, "period": q})
        dropped.setdefault(k, np.zeros(number[k], bool))[begin + q : begin + n] = True
    for k, gone in dropped.items():
        words[k] = [words[k][i] for i in np.flatnonzero(~gone)]
    return {"n_words": number.tolist(), "runs": runs, "collapsed": [b" ".join(w).decode("utf-8", "replace") for w in words]}


def find(docs: DataFrame, *keep: str, least: int = LEAST) -> DataFrame:
    """``keep``, ``n_words``, ``runs`` (structs of ``start``, ``length``, ``period``, by start, then period) and ``collapsed``:
    the words joined by single blanks, without those that a run contains after its first ``period`` words.

    A row per row of ``docs``, repeated ones too. A null, empty or blank text has no words, no runs and an empty ``collapsed``.
    Other columns stay behind, whatever their names; an empty table gives an empty one.
    """
    schema = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return over_texts(docs, lambda texts: _work(texts, least), schema, *keep)


def planted(text: Column, key: Column) -> Column:
    """``text`` with its tail made periodic where ``crc32`` of the decimal key is a multiple of 10; null keys and texts stay."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    # A row of one: the words are bound once and not split again for each use.
    def tail(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        made = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(made, " ")).otherwise(text)

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.when(text.isNotNull() & key.isNotNull() & (h % 10 == 0), F.get(F.transform(F.array(words), tail), F.lit(0))).otherwise(text)
