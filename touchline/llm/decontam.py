"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over ``SPAN`` token positions; positions where the mask is 0 are ignored, so a seed still hits when the
words there were replaced. Hashes of the masked words of every benchmark position are joined with those of every document
position. Around each hit, the item is laid over the document at that alignment and words are compared: the document is
contaminated where a window of ``WINDOW`` words (or the whole item, if shorter) agrees in at least ``SHARE`` percent.

Tokens are runs without space or 0x09-0x0D, A-Z lower-cased. Null or empty documents have no overlaps; null or empty items match
nothing; items of under ``SHORT`` words are compared wherever one of their words occurs. Repeated items are found under each of their ids.

The benchmark is cut into slabs of at most ``SLAB`` words; each slab is broadcast and held against all documents, so a
benchmark of any size is worked on whole with bounded memory per task. The result does not depend on the number of slabs: rows are
told apart by a number of their own, so repeated rows, repeated identifiers and null identifiers each keep their row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.base import cut_lineage, over_texts, raw
from touchline.llm.hashing import Words, mix

WINDOW, SHARE = 20, 80
SLAB = 2_000_000
# Fixed values. Enumeration shows: wherever 20 % of 12 to 20 words are replaced, one of the two masks still fits between them.
MASKS = ("10001111", "110111")
SHORT = 12


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The masked hash at each position where the whole mask fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k]
    return mix(out)


class Slab:
    """Items of one slab: word hashes end to end, and for each mask the sorted seed hashes with their places."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        words = Words([t for _, t in items], lower=True)
        self.hash, self.first = words.hash, words.first
        owner = words.text_of_word()
        self.owner = owner
        self.index = []
        for mask in (*MASKS, "1"):
            made = seeds(self.hash, mask)
            at = np.arange(len(made))
            sizes = np.diff(self.first)[owner[: len(made)]]
            keep = owner[at] == owner[at + len(mask) - 1]
            if mask == "1":  # short items are found by their single words
                keep &= sizes < SHORT
            at = at[keep]
            order = np.argsort(made[at], kind="stable")
            self.index.append((mask, made[at][order], at[order]))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``hashes``, position in the slab) of equal seeds."""
        left, right = [], []
        for mask, key, place in self.index:
            made = seeds(hashes, mask)
            if not len(made) or not len(key):
                continue
            low = np.searchsorted(key, made)
            at = np.flatnonzero(key[np.minimum(low, len(key) - 1)] == made)
            count = np.searchsorted(key, made[at], "right") - low[at]
            left.append(np.repeat(at, count))
            begin = np.repeat(low[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
            right.append(place[begin + np.arange(len(begin))])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(left), np.concatenate(right)

    def overlaps(self, hashes: np.ndarray, window: int, share: int) -> list[tuple[int, int, int, int]]:
        """(item, first word, one past the last word, equal words) of the best verified window of each item in one document."""
        here, there = self.hits(hashes)
        if not len(here):
            return []
        item = self.owner[there]
        start = here - (there - self.first[item])  # where the item's first word would lie
        best: dict[int, tuple[int, int, int]] = {}
        for i, begin in np.unique(np.stack([item, start], axis=1), axis=0).tolist():
            own = self.hash[self.first[i] : self.first[i + 1]]
            a, b = max(0, begin), min(len(hashes), begin + len(own))
            size = min(window, len(own))
            if b - a < size:
                continue
            same = np.concatenate([[0], np.cumsum(hashes[a:b] == own[a - begin : b - begin])])
            agree = same[size:] - same[:-size]
            top = int(agree.argmax())
            if 100 * int(agree[top]) >= share * size:
                good = np.flatnonzero(100 * agree >= share * size)
                low, high = int(good[0]), int(good[-1]) + size
                found = (int(same[high] - same[low]), a + low, a + high)
                if i not in best or found[0] > best[i][0]:
                    best[i] = found
        return [(self.ids[i], low, high, equal) for i, (equal, low, high) in sorted(best.items())]


def _slabs(bench: DataFrame, most: int):
    """The benchmark in slabs, fetched slab by slab; texts of one slab are all that the driver holds."""
    items: list[tuple[int, bytes]] = []
    size = 0
    for row in bench.select("item_id", F.col("text").cast("binary").alias("text")).orderBy("item_id").toLocalIterator():
        text = bytes(row["text"] or b"")
        items.append((row["item_id"], text))
        size += len(text) // 2 + 1
        if size >= most:
            yield items
            items, size = [], 0
    if items:
        yield items


def _against(docs: DataFrame, shared: Broadcast, window: int, share: int, *keep: str) -> DataFrame:
    """``keep``, ``n_words`` and ``overlaps`` with the items of one broadcast slab."""

    def work(texts: list[bytes]) -> dict[str, list]:
        words = Words(texts, lower=True)
        ends = zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)
        # All positions are looked up at once; only documents with a hit are then compared.
        here, _ = shared.value.hits(words.hash)
        near = set(words.text_of_word()[here].tolist())
        found = [shared.value.overlaps(words.hash[a:b], window, share) if i in near else [] for i, (a, b) in enumerate(ends)]
        named = [[{"item_id": i, "first": a, "stop": b, "equal": n} for i, a, b, n in row] for row in found]
        return {"n_words": np.diff(words.first).tolist(), "overlaps": named}

    kind = "array<struct<item_id bigint, first bigint, stop bigint, equal bigint>>".replace(" bigint", ":bigint")
    return over_texts(docs, work, f"n_words bigint, overlaps {kind}", *keep)


def overlaps(docs: DataFrame, bench: DataFrame, *keep: str, window: int = WINDOW, share: int = SHARE, slab: int = SLAB) -> DataFrame:
    """``keep``, ``n_words`` and ``overlaps``: a row per row of ``docs``, with an array of (item_id, first, stop, equal), word positions of
    each verified overlap, sorted.

    With more than one slab, rows get a number and are written to the shared folder with the overlaps of the first slab. What later
    slabs hit is written slab by slab as (number, overlaps) and joined back by the number; no text is a key.
    """
    context = docs.sparkSession.sparkContext
    slabs = _slabs(bench, slab)
    shared = context.broadcast(Slab(next(slabs, [])))
    items = next(slabs, None)
    if items is None:
        return _against(docs, shared, window, share, *keep).withColumn("overlaps", F.array_sort("overlaps"))

    # By place, whatever the names of ``keep``; the text is written once.
    names = [f"_{i}" for i in range(len(keep))]
    numbered = raw(docs, *keep).withColumnRenamed("_text", "text").withColumn("_row", F.monotonically_increasing_id())
    own = f"_{keep.index('text')}" if "text" in keep else "text"
    rows = cut_lineage(_against(numbered, shared, window, share, *names, "_row", *(["text"] if own == "text" else [])))
    shared.destroy()
    texts = rows.select("_row", F.col(own).alias("text"))
    hits = []
    while items is not None:
        shared = context.broadcast(Slab(items))
        found = _against(texts, shared, window, share, "_row").where(F.size("overlaps") > 0)
        hits.append(cut_lineage(found.select("_row", F.col("overlaps").alias("_more"))))
        shared.destroy()
        items = next(slabs, None)
    more = reduce(DataFrame.unionByName, hits).groupBy("_row").agg(F.flatten(F.collect_list("_more")).alias("_more"))
    every = F.when(F.col("_more").isNull(), F.col("overlaps")).otherwise(F.concat("overlaps", "_more"))
    out = rows.join(more, "_row", "left").select(*names, "n_words", F.array_sort(every).alias("overlaps"))
    return out.toDF(*keep, "n_words", "overlaps")


def contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_words``, ``contaminated``, ``items`` (sorted ids, comma-joined) and ``n_covered`` words: a row per row of ``docs``.    """
    found = overlaps(docs, bench, "doc_id", **options)
    ids = F.array_sort(F.transform("overlaps", lambda o: o["item_id"]))
    return found.select(
        "doc_id", "n_words", (F.size("overlaps") > 0).alias("contaminated"), F.array_join(ids.cast("array<string>"), ",").alias("items"),
        F.coalesce(F.array_max(F.transform("overlaps", lambda o: o["stop"] - o["first"])), F.lit(0)).cast("bigint").alias("longest"),
    )
