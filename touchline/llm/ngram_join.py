"""Self-join of documents by the Jaccard similarity of their word shingles, as a T-occurrence search with DivideSkip.

Documents with equal shingle sets are one class, named by a fingerprint. Tokens (shingle hashes) are ordered: rare ones by
hash first, hot ones (counted over all documents) last. Two sets of similarity ``SHARE`` or more share a token among the first
``n - ceil(SHARE n) + 1`` of each, so only these enter inverted lists, and lists of one class are dropped.

* A document's vector is its prefix tokens that other classes have too. With ``c`` common tokens in both prefixes, the overlap
  is at most ``c`` and all that lies behind one of the prefixes; this gives a threshold T for ``c`` that grows with the sets.
* First wave: in every list the class that has the token earliest is the query, all others are the index. Members of one query
  are dealt in chunks, so a group of any size spreads. Pairs found are checked on whole sets.
* Components of the links are taken. A list inside one component holds nothing new.
* Second wave: in the other lists, classes outside the component of the list's query are searched against all members, chunk by
  chunk. Every pair of a list that is not yet connected is met here, so no link that matters to a component is lost.

Each search sets the longest lists of a query aside (DivideSkip), merges the short ones with a heap, keeps members that occur
often enough to still reach T, and probes the long lists for those by binary search. Before it, members are left out whose
parity maps (``parity``) differ from the query's in more places than two sets of that similarity can; this never loses a link.

Null and empty texts have empty sets and are linked with nothing. Rows that repeat an identifier are rows of their own with
that identifier. Rows with a null identifier take part like all others; a component of such rows alone has the null identifier. With no rows the result is empty.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.base import cut_lineage, over_texts, raw
from touchline.llm.components import components
from touchline.llm.hashing import Words, mix, windows

WIDTH, SHARE = 5, 80
# Documents that a token must be in to count as hot, and the most hot tokens (the bound doubles until they fit).
HOT, MOST_HOT = 3, 1_000_000
# Tokens gathered before a task sends them on, tokens of a slice, classes of a chunk, rows that may be broadcast.
GATHER, SLICE, CHUNK, SMALL = 500_000, 1_000_000, 1024, 1_000_000
# Most places of a parity map: longer sets are told apart less well, never wrongly.
MAP = 1 << 15


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle, none an empty set."""
    words = Words(texts, lower=True)
    every = windows(words.hash, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(windows(words.hash[a:b], b - a)[: b > a] ^ np.uint64(b - a))
    return out


def fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes(), usedforsecurity=False).digest()


def prefix_size(n, share: int):
    return n - -(-share * n // 100) + 1


def needed(a, b, share: int):
    """Least overlap of sets of sizes ``a`` and ``b`` with that Jaccard percent."""
    return -(-share * (a + b) // (100 + share))


def parity(tokens: np.ndarray) -> bytes:
    """Whether an odd number of tokens falls on each of two to four places a token (a power of two, bounded by ``MAP``).

    Maps of two sets differ in at most as many places as the sets have tokens that the other lacks. A map folded in half by
    exclusive or is the map of half as many places.
    """
    places = min(MAP, max(256, 1 << (2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((mix(tokens) & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Maps:
    """Parity maps of the members of a block, by their length."""

    def __init__(self, maps: list[bytes]):
        length = np.array([len(m) for m in maps])
        self.at = {int(n): np.flatnonzero(length == n) for n in np.unique(length)}
        self.rows = {n: np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), -1) for n, at in self.at.items()}
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def fold(rows: np.ndarray, words: int) -> np.ndarray:
        return np.bitwise_xor.reduce(rows.reshape(len(rows), -1, words), axis=1)

    def near(self, query: bytes, allowed: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Those ``allowed`` members whose map differs from ``query`` in at most ``most`` places."""
        left = allowed.copy()
        own = np.frombuffer(query, np.uint64).reshape(1, -1)
        for n, at in self.at.items():
            on = np.flatnonzero(allowed[at])
            if not len(on):
                continue
            words = min(n // 8, own.shape[1])
            if (n, words) not in self.folded:
                self.folded[n, words] = self.fold(self.rows[n], words)
            apart = np.bitwise_count(self.folded[n, words][on] ^ self.fold(own, words)).sum(axis=1)
            left[at[on]] = apart <= most[at[on]]
        return left


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class`` (fingerprint of the set; null if empty) and ``map`` (its parity map)."""

    def work(texts: list[bytes]) -> dict[str, list]:
        sets = shingle_sets(texts, width)
        return {
            "n_shingles": [len(s) for s in sets], "class": [fingerprint(s) if len(s) else None for s in sets],
            "map": [parity(s) if len(s) else None for s in sets],
        }

    return over_texts(docs, work, "n_shingles bigint, class binary, map binary", "doc_id")


def _small(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens) >> np.uint64(32)


def hot_tokens(docs: DataFrame, slices: int, width: int = WIDTH, hot: int = HOT, most: int = MOST_HOT) -> tuple[np.ndarray, np.ndarray]:
    """Short hashes (32 bits, sorted) of tokens in at least ``hot`` documents, and the logarithm of their counts.

    Only an order depends on it, so equal short hashes do no harm. Counted over all documents, for the two fifths of each set
    with the lowest hashes, which are all that a prefix can reach unless most of a set is hot.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def out() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held)).astype(np.uint32)
            cut = np.searchsorted(keys, (np.arange(slices + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(slices))
            parts = [(i, keys[a:b].tobytes()) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([k for _, k in parts], pa.binary())], names=["slice", "keys"])

        for batch in batches:
            for tokens in _sets_of(batch, width):
                name = hash(tokens.tobytes())
                if name not in seen and len(tokens):
                    seen.add(name)
                    held.append(_small(tokens[: len(tokens) * 2 // 5 + 1]))
                    size += len(held[-1])
                if size >= GATHER:
                    yield out()
                    held, size, seen = [], 0, set()
        if held:
            yield out()

    def count(keys: pd.DataFrame) -> pd.DataFrame:
        found, n = np.unique(np.concatenate([np.frombuffer(k, np.uint32) for k in keys["keys"]]), return_counts=True)
        on = n >= hot
        return pd.DataFrame({"key": found[on].astype(np.int64), "n": n[on]})

    sent = raw(docs).mapInArrow(send, "slice int, keys binary")
    counted = cut_lineage(sent.groupBy("slice").applyInPandas(count, "key bigint, n bigint"))
    level = F.floor(2 * F.log2("n")).cast("int")
    levels = sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, lowest = 0, 128
    for row in levels:
        total += row["count"]
        if total > most:
            break
        lowest = row["level"]
    rows = counted.where(level >= lowest).select("key", level.alias("level")).toArrow()
    keys, levels = rows["key"].to_numpy().astype(np.uint32), rows["level"].to_numpy().astype(np.int8)
    order = np.argsort(keys)
    return keys[order], levels[order]


def _sets_of(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    from touchline.llm.base import chunks

    texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
    for a, b in chunks(texts):
        yield from shingle_sets(texts[a:b], width)


def postings(docs: DataFrame, slices: int, hot: tuple[np.ndarray, np.ndarray], width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``token``, ``class``, ``n``, ``place`` for the prefix tokens that at least two classes have; ``place`` is the rank in the class.

    Tasks send tokens by slices of the hash range; a slice keeps those met twice. Hot tokens are met twice by definition and
    skip the slices, so no slice grows with a hot token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = shared.value
        held: list[tuple[np.ndarray, np.ndarray, bytes, int]] = []
        size, seen = 0, set()

        def out() -> pa.RecordBatch:
            tokens = np.concatenate([h[0] for h in held])
            number = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            place = np.concatenate([np.arange(len(h[0])) for h in held])
            is_hot = np.concatenate([h[1] for h in held])
            part = ((tokens >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
            part = np.where(is_hot, slices + number % slices, part.astype(np.int64))
            order = np.argsort(part, kind="stable")
            edge = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(part)]])
            rows: list[tuple] = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                at = order[a:b]
                own, inverse = np.unique(number[at], return_inverse=True)
                names = b"".join(held[i][2] for i in own)
                sizes = np.array([held[i][3] for i in own], np.int32)
                rows.append((int(part[at[0]]), tokens[at].tobytes(), inverse.astype(np.int32).tobytes(), place[at].astype(np.int32).tobytes(), names, sizes.tobytes()))
            kinds = [pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["slice", "tokens", "owner", "place", "names", "sizes"])

        for batch in batches:
            for tokens in _sets_of(batch, width):
                if not len(tokens):
                    continue
                name = fingerprint(tokens)
                if name not in seen:
                    seen.add(name)
                    level = np.zeros(len(tokens), np.int64)
                    if len(keys):
                        small = _small(tokens).astype(np.uint32)
                        at = np.minimum(np.searchsorted(keys, small), len(keys) - 1)
                        level = np.where(keys[at] == small, levels[at], 0)
                    first = np.lexsort((tokens, level))[: prefix_size(len(tokens), share)]
                    held.append((tokens[first], level[first] > 0, name, len(tokens)))
                    size += len(first)
                if size >= GATHER // 2:
                    yield out()
                    held, size, seen = [], 0, set()
        if held:
            yield out()

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(t, np.uint64) for t in rows["tokens"]])
        place = np.concatenate([np.frombuffer(t, np.int32) for t in rows["place"]])
        names = [n[i : i + 16] for n in rows["names"] for i in range(0, len(n), 16)]
        sizes = np.concatenate([np.frombuffer(t, np.int32) for t in rows["sizes"]])
        shift = np.cumsum([0, *(len(n) // 16 for n in rows["names"])])[:-1]
        owner = np.concatenate([np.frombuffer(t, np.int32) + s for t, s in zip(rows["owner"], shift, strict=True)])
        if rows["slice"].iloc[0] < slices:
            _, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
            on = n[inverse] > 1
            tokens, place, owner = tokens[on], place[on], owner[on]
        return pd.DataFrame({"token": tokens.view(np.int64), "class": [names[i] for i in owner], "n": sizes[owner], "place": place})

    sent = raw(docs).mapInArrow(send, "slice int, tokens binary, owner binary, place binary, names binary, sizes binary")
    found = sent.groupBy("slice").applyInPandas(keep, "token bigint, class binary, n int, place int")
    # The same class may come from several tasks.
    return found.groupBy("token", "class").agg(F.first("n").alias("n"), F.first("place").alias("place"))


class Index:
    """Inverted lists over the vectors of a chunk; ``sizes`` are those of the whole sets."""

    def __init__(self, vectors: list[np.ndarray], sizes: np.ndarray, share: int):
        self.share, self.sizes, self.known = share, sizes.astype(np.int64), {}
        self.behind = self.sizes - prefix_size(self.sizes, share)
        tokens = np.concatenate(vectors) if vectors else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        self.tokens, self.begin = np.unique(tokens[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))

    def needs(self, size: int) -> np.ndarray:
        """T for each member: prefix tokens it must share with a set of ``size``; huge where sizes alone forbid a link."""
        behind = size - prefix_size(size, self.share)
        need = np.maximum(needed(size, self.sizes, self.share) - np.maximum(self.behind, behind), 1)
        fits = 100 * np.minimum(self.sizes, size) >= self.share * np.maximum(self.sizes, size)
        return np.where(fits, need, 1 << 40)

    def search(self, query: np.ndarray, size: int, allowed: np.ndarray, weight: float = 0.02) -> list[int]:
        """Members among ``allowed`` that share T or more tokens with ``query``."""
        if not len(self.tokens):
            return []
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        if size not in self.known:
            self.known[size] = self.needs(size)
        need = np.where(allowed, self.known[size], 1 << 40)
        low = int(need.min())
        if len(at) < low:
            return []
        length = self.end[at] - self.begin[at]
        at = at[np.argsort(length, kind="stable")]
        aside = min(int(low / (weight * np.log2(int(length.max()) + 1) + 1)), low - 1)
        lists = [x[allowed[x]] for x in (self.owner[self.begin[i] : self.end[i]] for i in at.tolist())]
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        out = []
        for member, run in groupby(heapq.merge(*[x.tolist() for x in short])):
            found, least = sum(1 for _ in run), int(need[member])
            for left, probe in enumerate(long):
                if found >= least or found + len(long) - left < least:
                    break
                where = int(np.searchsorted(probe, member))
                found += where < len(probe) and bool(probe[where] == member)
            if found >= least:
                out.append(member)
        return out


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    flat, edge = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [flat[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _by_key(batches: Iterator[pa.RecordBatch], lists: Sequence[int] = ()) -> Iterator[list[tuple]]:
    """The rows of one key after the other, from rows sorted by key (the first column); ``lists`` become arrays."""
    held: list[tuple] = []
    for batch in batches:
        columns = [_arrays(batch.column(i)) if i in lists else batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


class Block:
    """Queries and members of a block, and which of them may be linked by root, size and place.

    Rows: key, class, query, root, place, size, map, and what else the caller needs.
    """

    def __init__(self, rows: list[tuple], share: int):
        self.members, self.queries = [r for r in rows if not r[2]], [r for r in rows if r[2]]
        roots = {root: i for i, root in enumerate({r[3] for r in rows})}
        column = lambda side, f: np.array([f(r) for r in side], np.int64)
        (n, place, root), (m, there, other) = (
            (column(side, lambda r: r[5]), column(side, lambda r: r[4]), column(side, lambda r: roots[r[3]])) for side in (self.queries, self.members)
        )
        least = needed(n[:, None], m[None, :], share)
        may = (root[:, None] != other[None, :]) & (n[:, None] - place[:, None] >= least) & (m[None, :] - there[None, :] >= least)
        self.asks = np.flatnonzero(may.any(axis=1)).tolist()
        self.used = np.flatnonzero(may.any(axis=0))
        self.sizes, self.n, self.may, self.least = m[self.used], n, may[:, self.used], least[:, self.used]

    def near(self) -> Iterator[tuple[int, np.ndarray]]:
        """Queries and those of the members ``used`` that their maps leave."""
        maps = Maps([self.members[k][6] for k in self.used.tolist()])
        for i in self.asks:
            left = maps.near(self.queries[i][6], self.may[i], self.n[i] + self.sizes - 2 * self.least[i])
            if left.any():
                yield i, left


def _dealt(blocks: DataFrame, vectors: DataFrame, *columns: str) -> DataFrame:
    full = blocks.join(vectors, "class").select("key", "class", "query", "root", "place", *columns)
    return full.repartition("key").sortWithinPartitions("key")


def _near(blocks: DataFrame, vectors: DataFrame, share: int) -> DataFrame:
    """The rows of blocks that have a partner by size, place and map; vectors travel for these alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            block = Block(rows, share)
            kept, met = [], np.zeros(len(block.used), bool)
            for i, left in block.near():
                kept.append(block.queries[i][:5])
                met |= left
            kept += [block.members[k][:5] for k in block.used[met].tolist()]
            if kept:
                kinds = [pa.string(), pa.binary(), pa.bool_(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], names=["key", "class", "query", "root", "place"])

    return _dealt(blocks, vectors, "n", "map").mapInArrow(work, "key string, class binary, query boolean, root binary, place int")


def _candidates(blocks: DataFrame, vectors: DataFrame, share: int) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` that reach T. ``blocks``: ``block``, ``part``, ``other``, ``class``, ``query``, ``root``, ``place``.

    A pair counts only in the block of its first common token, so it is made once. Behind that token must lie enough of both
    sets, which excludes most pairs by their sizes and the token's places (0 where the block is not of one token).

    Blocks are small and many, so a task reads sorted rows and works on one block after the other. A block holds at most two
    chunks, and blocks are dealt by a hash.
    """

    def pairs(rows: list[tuple]) -> set[tuple[bytes, bytes]]:
        """Rows as in ``Block``, then tokens and places of the tokens."""
        block = Block(rows, share)
        found: set[tuple[bytes, bytes]] = set()
        if not block.asks:
            return found
        index = Index([block.members[k][7] for k in block.used.tolist()], block.sizes, share)
        for i, own in block.near():
            _, name, _, _, place, size, _, vector, places = block.queries[i]
            for k in index.search(vector, size, own):
                other = block.members[block.used[k]]
                _, mine, _ = np.intersect1d(vector, other[7], assume_unique=True, return_indices=True)
                if other[1] != name and places[mine].min() >= place:
                    found.add((min(name, other[1]), max(name, other[1])))
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[bytes, bytes]] = set()

        def out() -> pa.RecordBatch:
            rows = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for rows in _by_key(batches, lists=(7, 8)):
            found |= pairs(rows)
            if len(found) > 50_000:
                yield out()
        yield out()

    key = F.concat_ws(":", F.hex("block"), F.col("part").cast("string"), F.col("other").cast("string")).alias("key")
    left = _near(blocks.select(key, "class", "query", "root", F.col("place").cast("int").alias("place")), vectors, share)
    return _dealt(left, vectors, "n", "map", "tokens", "places").mapInArrow(work, "a binary, b binary").distinct()


def _checked(pairs: DataFrame, docs: DataFrame, own: DataFrame, width: int, share: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity."""
    pairs = cut_lineage(pairs)
    sets = _sets(docs, own, pairs.select(F.col("a").alias("class")).union(pairs.select("b")), width)
    left, right = (sets.withColumnsRenamed({"class": c, "tokens": f"{c}_tokens"}) for c in "ab")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(t, np.uint64) for t in batch.column(i).to_pylist()] for i in (2, 3))
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
            both = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
            yield batch.select([0, 1]).filter(pa.array(common >= needed(both, 0, share)))

    full = pairs.join(left, "a").join(right, "b").select("a", "b", "a_tokens", "b_tokens")
    return cut_lineage(full.mapInArrow(work, "a binary, b binary"))


def _sets(docs: DataFrame, own: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``class`` and ``tokens`` of the classes ``wanted``, from the text of one document each."""
    one = own.join(wanted.select("class").distinct(), "class").groupBy("class").agg(F.min("doc_id").alias("one"))
    one = cut_lineage(one)
    chosen = one.select("one").distinct()
    if one.count() <= SMALL:
        chosen = F.broadcast(chosen)
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("one")).select("doc_id", "text")
    if not one.where("one is null").isEmpty():
        # Classes of rows without an identifier: any of those rows may hold the text.
        texts = texts.unionByName(docs.where("doc_id is null").select("doc_id", "text"))

    def work(texts: list[bytes]) -> dict[str, list]:
        sets = shingle_sets(texts, width)
        return {"class": [fingerprint(s) for s in sets], "tokens": [s.tobytes() for s in sets]}

    made = over_texts(texts, work, "class binary, tokens binary", "doc_id")
    # An identifier that repeats with another text gives a class more: one row for each class stays.
    return cut_lineage(made.join(one.select("class"), "class", "left_semi").dropDuplicates(["class"]).select("class", "tokens"))


def join(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least ``doc_id`` reachable over links, its own for a document without).

    Similarity links join classes; equal sets are linked as such.
    """
    own = cut_lineage(classes(docs, width))
    known = own.where(F.col("class").isNotNull())
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    slices = max(8, -(-int(total) // (2 * SLICE)))
    hot = hot_tokens(docs, slices, width)
    found = cut_lineage(postings(docs, slices, hot, width, share))
    heads = found.groupBy("token").agg(F.min(F.struct("place", "class", "n")).alias("head"), F.count("*").alias("size")).where("size > 1")
    lists = cut_lineage(found.join(heads, "token"))
    # A vector is bounded by the length of a document.
    vectors = lists.groupBy("class").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("token", "place"))).alias("vector"))
    maps = known.groupBy("class").agg(F.first("map").alias("map"))
    vectors = vectors.join(maps, "class").select("class", "n", F.col("vector.token").alias("tokens"), F.col("vector.place").alias("places"), "map")
    vectors = cut_lineage(vectors)

    # The query of a list is the class that has the token earliest: it has the fewest tokens of its own.
    near = lists.where(F.col("class") != F.col("head.class"))
    fits = 100 * F.least(F.col("n"), F.col("head.n")) >= share * F.greatest(F.col("n"), F.col("head.n"))
    pairs = cut_lineage(near.where(fits).select(F.col("head.class").alias("block"), "class").distinct())
    counts = pairs.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    none = F.lit(None).cast("binary")
    dealt = pairs.join(counts, "block").select("block", F.pmod(F.xxhash64("class"), "parts").cast("int").alias("part"), "class", F.lit(False).alias("query"), F.col("class").alias("root"))
    asking = dealt.select("block", "part").distinct().select("block", "part", F.col("block").alias("class"), F.lit(True).alias("query"), none.alias("root"))
    first = _checked(_candidates(dealt.unionByName(asking).withColumns({"other": F.lit(0), "place": F.lit(0)}), vectors, share), docs, known, width, share)

    roots = cut_lineage(components(first))
    rooted = lists.join(roots, F.col("class") == F.col("node"), "left").select("token", "class", "place", "size", F.coalesce("root", "class").alias("root"))
    mixed = rooted.groupBy("token").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("place", "class", "root")).alias("main"), F.first("size").alias("size"),
        F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("xor"),
    ).where("low < high")
    # Lists of the same members are searched once, for the token that comes first in the order.
    mixed = mixed.groupBy("size", "sum", "xor").agg(F.min_by("token", "main").alias("token"), F.min("main").alias("main"))
    open_lists = cut_lineage(rooted.drop("size").join(mixed.select("token", F.col("main.root").alias("main"), "size"), "token"))
    parts = F.ceil(F.col("size") / CHUNK).cast("int")
    asked = open_lists.where(F.col("root") != F.col("main")).select("token", F.pmod(F.xxhash64("class"), parts).cast("int").alias("part"), "class", "root", "place")
    held = open_lists.select("token", F.pmod(F.xxhash64("class"), parts).cast("int").alias("other"), "class", "root", "place")
    # Each part with queries meets each part of members of its list; blocks hold at most two chunks.
    meet = asked.select("token", "part").distinct().join(held.select("token", "other").distinct(), "token")
    queries = meet.join(asked, ["token", "part"]).select("token", "part", "other", "class", F.lit(True).alias("query"), "root", "place")
    members = meet.join(held, ["token", "other"]).select("token", "part", "other", "class", F.lit(False).alias("query"), "root", "place")
    blocks = queries.unionByName(members).withColumnRenamed("token", "block")
    second = _checked(_candidates(blocks, vectors, share), docs, known, width, share)

    merged = components(first.unionByName(second)) if not second.isEmpty() else roots
    least = known.groupBy("class").agg(F.min("doc_id").alias("least"))
    grouped = least.join(merged, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("least").alias("lowest"))
    named = grouped.join(lowest, "root").select(F.col("class").alias("own"), "lowest")
    return own.join(named, F.col("class") == F.col("own"), "left").select("doc_id", "n_shingles", F.coalesce("lowest", "doc_id").alias("component_id"))
