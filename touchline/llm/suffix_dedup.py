"""Removal of byte strings that repeat anywhere in the corpus, by fingerprints at anchors.

A byte goes when some ``LENGTH``-byte string over it also starts elsewhere, in the same document or another.

Sorting the suffixes at every byte would move each text ``LENGTH`` times. Only anchors are entered: the anchor of a
window is the place of the least hash among its ``LEAD``-byte strings, so equal windows have their anchors at equal places. All
windows with one anchor form a run of starts, and the run's segment is every byte they cover.

1. Sampled splitters range-partition the anchor suffixes by their leading bytes. Tasks send one of equal runs and report the
   others as repeated, so a passage in a third of all documents reaches its bucket once per task.
2. A bucket orders by leading bytes and the hashes of anchor string and segment, which groups equal ones, and compares neighbours. Equal segments: every
   window of the run repeats. Equal anchors with different segments: the run is mixed, some of its windows may repeat.
   A bucket gets whole key ranges, so equal leading bytes never straddle a boundary.
3. Windows of mixed runs only (the edges of repeats) are hashed one by one, partitioned by fixed ranges of the hash, sorted and
   compared again.
4. Spans of each document are united and cut out of its text.

Strings are compared by two 64-bit hashes. Null texts count as empty; texts shorter than ``LENGTH`` lose nothing. Rows that repeat an
identifier are told apart by their text; rows that repeat both are copies of each other and lose all of a long enough text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.base import chunks, cut_lineage, over_texts
from touchline.llm.hashing import _BACK, _BASE, _VALUES, _series, mix

LENGTH, LEAD = 200, 96
PLACE_BITS = 28  # of a position in one task's text; a single text may have 256 MB
GATHER, BUCKET, SAMPLE_DOCS, SMALL = 600_000, 500_000, 2_000, 500_000
EMPTY = hashlib.sha256(b"").hexdigest()
ROW = "doc_id bigint, digest bigint, kind int, first int, last int"


class Rolling:
    """Hashes of all substrings of ``data`` from prefix sums of byte values modulo 2^64."""

    def __init__(self, data: np.ndarray):
        values = _VALUES[data]
        values *= _series(_BASE, len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        self.back = _series(_BACK, len(data) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))

    def each(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n] + np.uint64(width)) if n > 0 else np.empty(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values: prefix and suffix minima of blocks of that width."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, x.dtype)
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


class Runs:
    """Runs of window starts with one anchor in some texts: arrays of text number, first and last start (in the text), and keys."""

    def __init__(self, texts: list[bytes], length: int, lead: int):
        data = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
        if len(data) >> PLACE_BITS:
            raise ValueError(f"a text has more than {1 << PLACE_BITS} bytes")
        at = np.cumsum([0, *map(len, texts)])
        self.rolling = Rolling(data)
        key = self.rolling.each(lead)
        key >>= np.uint64(PLACE_BITS)
        key <<= np.uint64(PLACE_BITS)
        key |= np.arange(len(key), dtype=np.uint64)
        anchor = (sliding_min(key, length - lead + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        inside = np.zeros(len(anchor) + 1, np.int8)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= length:  # windows of one text only
                inside[a] += 1
                inside[b - length + 1] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        new[at[:-1][at[:-1] < len(anchor)]] = True
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(anchor)) - 1
        on = inside[begin]
        begin, last = begin[on], last[on]
        anchor = anchor[begin]
        self.text = np.searchsorted(at, begin, "right") - 1
        self.first, self.last = begin - at[self.text], last - at[self.text]
        self.lead = np.zeros(len(begin), np.uint64)
        for j in range(8):
            self.lead = (self.lead << np.uint64(8)) | data[anchor + j]
        self.anchor = self.rolling.of(anchor, anchor + lead)
        self.segment = self.rolling.of(begin, last + length) + mix((anchor - begin).astype(np.uint64))


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Order by the keys in turn: quicksort by the first, then each run of equals by the next."""
    order = np.argsort(keys[0], kind="quicksort")
    for k in range(1, len(keys)):
        same = np.ones(max(len(order) - 1, 0), bool)
        for key in keys[:k]:
            same &= key[order][1:] == key[order][:-1]
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if not len(tied):
            break
        group = np.cumsum(np.concatenate([[True], ~same]))[tied]
        order[tied] = order[tied][np.lexsort((keys[k][order[tied]], group))]
    return order


def _equal(*sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each entry equals the one before it or the one after it."""
    same = np.ones(max(len(sorted_keys[0]) - 1, 0), bool)
    for key in sorted_keys:
        same &= key[1:] == key[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def _digest(text: bytes) -> int:
    """Half of the md5, as a signed number; it only tells rows of one identifier apart."""
    return int.from_bytes(hashlib.md5(text, usedforsecurity=False).digest()[:8], "big", signed=True)


def _digest_column():
    high = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(F.conv(F.substring(F.md5("text"), 9, 8), 16, 10).cast("bigint"))


def _ids(batch: pa.RecordBatch) -> tuple[list, list[bytes]]:
    return batch.column(0).to_pylist(), [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]


def splitters(docs: DataFrame, buckets: int, length: int, lead: int) -> np.ndarray:
    """Leading bytes that cut anchor suffixes into even ranges, from a bounded sample of documents; only balance rests on it."""
    sample = docs.where(F.octet_length("text") >= length).select("doc_id", F.substring("text", 1, 4000).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def work(texts: list[bytes]) -> dict[str, list]:
        runs = Runs(texts, length, lead)
        own = np.searchsorted(runs.text, np.arange(len(texts) + 1))
        return {"leads": [runs.lead[a:b][:16].view(np.int64).tolist() for a, b in zip(own[:-1], own[1:], strict=True)]}

    rows = over_texts(sample, work, "leads array<bigint>").collect()
    leads = np.sort(np.unique(np.array([x for r in rows for x in r["leads"]], np.int64)).view(np.uint64))
    if not len(leads):
        return np.empty(0, np.uint64)
    return np.unique(leads[(np.arange(1, buckets) * len(leads)) // buckets])


class Sender:
    """Collects keyed entries of documents and cuts them by bucket; of equal entries one is sent, the others are known to repeat."""

    NAMES = ("bucket", "keys", "owner", "first", "last", "many", "ids", "digests")

    def __init__(self, cuts: np.ndarray, most: int):
        self.cuts, self.most = cuts, most
        self._clear()

    def _clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.documents: list[tuple] = []
        self.size = 0

    def add(self, documents: list[tuple], keys: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, owner + len(self.documents), first, last))
        self.documents += documents
        self.size += len(owner)
        if self.size >= self.most:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        keys = np.concatenate([p[0] for p in self.parts])
        owner, first, last = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2, 3))
        order = multikey_order(*keys.T)
        single = all(p[3] is p[2] for p in self.parts)  # windows: the first start is the last one
        keys, owner, first = keys[order], owner[order], first[order]
        last = first if single else last[order]
        again = np.concatenate([[False], (keys[1:] == keys[:-1]).all(axis=1)])
        head = np.flatnonzero(~again)
        many = np.diff(np.append(head, len(keys))) > 1
        rows = []
        bucket = np.searchsorted(self.cuts, keys[head, 0], "right")
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(head)]])
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = head[a:b]
            rows.append(self._row(int(bucket[a]), keys[own], owner[own], start := first[own], start if single else last[own], many[a:b]))
        if again.any():  # spread over as many groups as there are buckets; nothing is compared there
            at = np.flatnonzero(again)
            spread = owner[at] % (len(self.cuts) + 1)
            for k in np.unique(spread):
                own = at[spread == k]
                rows.append(self._row(-1 - int(k), keys[:0], owner[own], start := first[own], start if single else last[own], np.ones(len(own), bool)))
        self._clear()
        kinds = [pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(self.NAMES))

    def _row(self, bucket, keys, owner, first, last, many) -> tuple:
        own, inverse = np.unique(owner, return_inverse=True)
        small = lambda x: x.astype(np.int32).tobytes()
        ids, digests = [self.documents[i][0] for i in own], np.array([self.documents[i][1] for i in own], np.int64).tobytes()
        return bucket, keys.tobytes(), small(inverse), small(first), b"" if last is first else small(last), np.packbits(many).tobytes(), ids, digests


SENT = "bucket int, keys binary, owner binary, first binary, last binary, many binary, ids array<bigint>, digests binary"


def _received(rows: pd.DataFrame, width: int):
    join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[name]])
    keys = join("keys", np.uint64).reshape(-1, width)
    ids = [i for row in rows["ids"] for i in row]
    digests = join("digests", np.int64).tolist()
    shift = np.cumsum([0, *map(len, rows["ids"])])[:-1]
    owner = np.concatenate([np.frombuffer(x, np.int32) + s for x, s in zip(rows["owner"], shift, strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(o) // 4) for m, o in zip(rows["many"], rows["owner"], strict=True)]).astype(bool)
    return keys, owner, join("first", np.int32), join("last", np.int32), many, ids, digests


def _out(on: np.ndarray, kind, owner, first, last, ids, digests) -> pd.DataFrame:
    own = owner[on].tolist()
    table = pd.DataFrame({"doc_id": pd.array([None if pd.isna(ids[i]) else int(ids[i]) for i in own], "Int64"), "digest": [digests[i] for i in own], "kind": kind, "first": first[on], "last": last[on]})
    return table.astype({"kind": "int32"})


def repeated_runs(docs: DataFrame, cuts: np.ndarray, length: int, lead: int) -> DataFrame:
    """Runs with a repeat: kind 0 all of its windows repeat, kind 1 its anchor repeats with another segment, kind 2 both."""
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(shared.value, GATHER)
        for batch in batches:
            ids, texts = _ids(batch)
            for a, b in chunks(texts):
                runs = Runs(texts[a:b], length, lead)
                keys = np.stack([runs.lead, runs.anchor, runs.segment], axis=1)
                yield from sender.add([(i, _digest(t)) for i, t in zip(ids[a:b], texts[a:b], strict=True)], keys, runs.text, runs.first, runs.last)
        if sender.size:
            yield sender.flush()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        keys, owner, first, last, many, ids, digests = _received(rows, 3)
        if rows["bucket"].iloc[0] < 0:
            return _out(np.arange(len(owner)), 0, owner, first, last, ids, digests)
        order = multikey_order(*keys.T)
        keys, owner, first, last, many = keys[order], owner[order], first[order], last[order], many[order]
        whole = _equal(*keys.T)
        # An anchor is mixed if its group has more than one segment.
        group = np.cumsum(np.concatenate([[True], (keys[1:, :2] != keys[:-1, :2]).any(axis=1)])) - 1
        begins = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0]))
        low, high = np.minimum.reduceat(keys[:, 2], begins), np.maximum.reduceat(keys[:, 2], begins)
        mixed = (low < high)[group]
        # Of equal segments one stands for all where windows are compared.
        lead_one = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        repeats = whole | many
        kind = np.where(repeats, np.where(mixed & lead_one, 2, 0), 1)
        on = np.flatnonzero(repeats | mixed)
        return _out(on, kind[on], owner, first, last, ids, digests)

    sent = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") >= length).mapInArrow(send, SENT)
    return sent.groupBy("bucket").applyInPandas(compare, ROW)


def repeated_windows(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Starts (``first`` = ``last``) of windows in the runs of ``texts`` (``runs``: array of first, last) that occur twice or more."""
    cuts = (np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets) << np.uint64(32)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(cuts, GATHER * 2)
        for batch in batches:
            ids, texts = _ids(batch)
            runs = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
                at = np.cumsum([0, *map(len, texts[a:b])])
                rolling = Rolling(data)
                pairs = [(k, r["first"], r["last"]) for k, row in enumerate(runs[a:b]) for r in row]
                text, first, last = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
                sizes = last - first + 1
                owner = np.repeat(text, sizes)
                start = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                place = start + at[owner]
                keys = np.stack([rolling.of(place, place + length), rolling.of(place + 1, place + length - 1)], axis=1)
                yield from sender.add([(i, _digest(t)) for i, t in zip(ids[a:b], texts[a:b], strict=True)], keys, owner, start, start)
        if sender.size:
            yield sender.flush()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        keys, owner, first, last, many, ids, digests = _received(rows, 2)
        if rows["bucket"].iloc[0] < 0:
            return _joined(np.arange(len(owner)), owner, first, ids, digests)
        order = multikey_order(*keys.T)
        keys, owner, first, many = keys[order], owner[order], first[order], many[order]
        return _joined(np.flatnonzero(_equal(*keys.T) | many), owner, first, ids, digests)

    def _joined(on, owner, first, ids, digests) -> pd.DataFrame:
        """Neighbouring starts of a document as one row."""
        on = on[np.lexsort((first[on], owner[on]))]
        own, start = owner[on], first[on].astype(np.int64)
        new = np.concatenate([[True], (np.diff(own) != 0) | (np.diff(start) > 1)]) if len(on) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(on)) - 1 if len(on) else begin
        return _out(begin, 0, own, start.astype(np.int32), np.append(start[end], []).astype(np.int32) if not len(on) else _spread(start[end], begin, len(on)), ids, digests)

    def _spread(values, at, n):
        out = np.zeros(n, np.int32)
        out[at] = values
        return out

    return texts.mapInArrow(send, SENT).groupBy("bucket").applyInPandas(compare, ROW)


def _cut(text: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """Text without the union of [first, last + length), bytes removed, and number of maximal runs removed."""
    kept, at, removed, runs = [], 0, 0, 0
    stop = -1
    for first, last in sorted(spans):
        begin, end = max(first, at), last + length
        if first > stop:
            runs += 1
        stop = max(stop, end)
        if end > at:
            kept.append(text[at:begin])
            removed += end - begin
            at = end
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def dedup(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, a row per row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    base = rows.select("doc_id", _digest_column().alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-int(total) * 2 // (length - lead) // BUCKET))
    cuts = splitters(rows, buckets, length, lead)
    runs = cut_lineage(repeated_runs(rows, cuts, length, lead))
    key = ["doc_id", "digest"]

    def gathered(spans: DataFrame) -> DataFrame:
        """The spans of each document in one row (bounded by the length of its text)."""
        return spans.groupBy(*key).agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    def with_text(spans: DataFrame, ids: DataFrame) -> DataFrame:
        """Rows of documents named in ``ids`` with their spans; texts of others are not moved."""
        small = F.broadcast(ids) if ids.count() <= SMALL else ids
        texts = rows.withColumn("digest", _digest_column()).join(small.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
        other = spans.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "runs")
        return texts.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("doc_id", "runs", "text")

    edges = cut_lineage(gathered(runs.where("kind > 0")))
    windows = cut_lineage(repeated_windows(with_text(edges, edges.select(*key)), buckets, length))
    spans = cut_lineage(gathered(runs.where("kind <> 1").unionByName(windows)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = _ids(batch)
            found = [_cut(t, [(r["first"], r["last"]) for r in row], length) for t, row in zip(texts, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([_digest(t) for t in texts], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in found], pa.string()),
            ], names=["_id", "_digest", "removed", "spans", "sha"])

    done = with_text(spans, spans.select(*key)).mapInArrow(work, "_id bigint, _digest bigint, removed bigint, spans bigint, sha string").dropDuplicates(["_id", "_digest"])
    full = base.join(done, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return full.select("doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
