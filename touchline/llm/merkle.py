"""Merkle manifest of a table: a tree over the leaves of each group, a tree over the groups, and a proof for each leaf.

Leaves are numbered within their group by a range partition and counts carried over its parts. Nodes are then worked on in blocks
of ``2 ** BITS`` neighbours by time-forward processing: digests are messages to the parent's label, taken from a priority queue in
order of the label. Inside a block the queue is a heap; between blocks it is a table sorted by (group, block, place) that Spark
spills and spreads. Each round leaves one node for a block, so a group of n leaves takes log(n) / BITS rounds, and a group of any
size is spread over blocks. The same rounds backwards hand each block what proofs need above it; inside, a second sweep from the
last label to the first adds a sibling a level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from touchline.llm.base import cut_lineage

# 2 ** BITS nodes are worked on at once.
BITS = 10
NODE = "_g {group}, _n bigint, _pos bigint, _digest string"


def digest_of(*columns: Column) -> Column:
    """SHA-256 in hexadecimal over the values one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(nodes: int, bits: int) -> int:
    """Levels that a block of a level with so many nodes is climbed: to the top where one block holds them, else ``bits``."""
    return min((nodes - 1).bit_length(), bits)


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """Digests by level, lowest first. Nodes are labelled from the lowest level up, from left to right; each sends its digest to its parent."""
    sizes = [len(digests)]
    for _ in range(levels):
        sizes.append((sizes[-1] + 1) // 2)
    rows, queue, label = [list(digests)], [], len(digests)
    if levels:
        for i, digest in enumerate(digests):
            heappush(queue, (label + i // 2, i, digest))
    for level in range(1, levels + 1):
        row: list[str] = []
        above = label + sizes[level]
        for i in range(sizes[level]):
            parts = ""
            while queue and queue[0][0] == label:
                parts += heappop(queue)[2]
            row.append(_hash(parts))
            if level < levels:
                heappush(queue, (above + i // 2, i, row[-1]))
            label += 1
        rows.append(row)
    return rows


def backward(rows: list[list[str]], above: str) -> list[str]:
    """For each node of the lowest level what it meets on its way up, ending in ``above``: ``L`` or ``R`` and the digest of the sibling
    on that side, or ``-`` where it has none. Labels are taken from the last to the first; each node sends its own way to its children."""
    queue: list[tuple[int, str]] = [(0, above)]
    last = 0
    for level in range(len(rows) - 1, 0, -1):
        here, below = rows[level], rows[level - 1]
        # Negative labels, so that the heap gives the largest label first.
        first_below = last + len(here)
        for i in range(len(here) - 1, -1, -1):
            _, way = heappop(queue)
            for child in range(min(2 * i + 1, len(below) - 1), 2 * i - 1, -1):
                other = child ^ 1
                step = "-" if other >= len(below) else ("L" if other < child else "R") + below[other]
                heappush(queue, (first_below + len(below) - 1 - child, step + way))
        last = first_below
    return [heappop(queue)[1] for _ in range(len(rows[0]))][::-1]


def steps_of(way: str) -> list[str]:
    out, i = [], 0
    while i < len(way):
        size = 1 if way[i] == "-" else 65
        out.append(way[i : i + size])
        i += size
    return out


def fold(digest: str, steps: list[str]) -> str:
    """The root that follows from a leaf and the siblings on its way up."""
    for step in steps:
        digest = _hash(digest if step == "-" else step[1:] + digest if step[0] == "L" else digest + step[1:])
    return digest


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``_pos``, the place in the group by ``order`` (nulls first, ties anyhow), and ``_n``, the size of the group."""
    tied = cut_lineage(rows.withColumn("_tie", F.monotonically_increasing_id()))
    by = [group, *order, "_tie"]
    placed = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    where = placed.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            index = []
            for g in batch.column(where).to_pylist():
                at = at + 1 if g == last else 0
                last = g
                index.append(at)
            parts = pa.array([part] * len(index), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(index, pa.int64())], names=[*batch.schema.names, "_part", "_index"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    placed = cut_lineage(placed.mapInArrow(run, f"{schema}, _part bigint, _index bigint"))
    # One row for each part and group.
    sizes = placed.groupBy("_part", F.col(group).alias("_key")).count()
    to_end = "sum(count) over (partition by _key order by _part)"
    sizes = sizes.select(F.col("_part").alias("_of"), "_key", F.expr(f"{to_end} - count").alias("_before"), F.expr("sum(count) over (partition by _key)").alias("_n"))
    met = placed.join(sizes, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_key")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_index")).alias("_pos"), "_n")


def _blocks(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes dealt by block, in order; the row with place -1, which carries what lies above, comes first."""
    block = F.when(F.col("_pos") < 0, F.col("_block")).otherwise(F.floor(F.col("_pos") / width)).cast("bigint")
    return nodes.withColumn("_block", block).repartition("_g", "_block").sortWithinPartitions("_g", "_block", "_pos")


def _by_block(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[dict]]:
    rows: list[dict] = []
    for batch in batches:
        for row in batch.select(names).to_pylist():
            if rows and (row["_g"], row["_block"]) != (rows[0]["_g"], rows[0]["_block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _mapped(blocks: DataFrame, work: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    names = blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_block(batches, names):
            yield pa.RecordBatch.from_pylist(work(rows), schema=arrow)

    return blocks.mapInArrow(run, fields)


def _climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Tables of nodes (``_g``, ``_n``, ``_pos``, ``_digest``), the given one first, until each group has one node."""
    group = nodes.schema["_g"].dataType.simpleString()
    width = 2**bits

    def work(rows: list[dict]) -> list[dict]:
        n = rows[0]["_n"]
        top = forward([r["_digest"] for r in rows], height(n, bits))[-1]
        return [{"_g": rows[0]["_g"], "_n": -(-n // width), "_pos": rows[0]["_block"], "_digest": top[0]}]

    rounds = [nodes]
    while True:
        most = rounds[-1].agg(F.max("_n")).first()[0] or 0
        if most <= 1:
            return rounds
        nodes = rounds[-1].select("_g", "_n", "_pos", "_digest", F.lit(0).cast("bigint").alias("_block"))
        rounds.append(cut_lineage(_mapped(_blocks(nodes, width), work, NODE.format(group=group))))


ABOVE = "_way string, _subroot string, _root string"


def _descend(rounds: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """The way up of each node of the second table of ``rounds`` (of ``above`` where there is one table); ``above`` has that of each top."""
    group = rounds[0].schema["_g"].dataType.simpleString()
    for nodes in rounds[-2:0:-1]:
        above = cut_lineage(_mapped(_with_above(nodes, above, bits), lambda rows: _ways(rows, bits), f"_g {group}, _pos bigint, {ABOVE}"))
    return above


def _with_above(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    own = nodes.withColumn("_block", F.lit(0).cast("bigint"))
    held = above.select("_g", F.col("_pos").alias("_block"), F.lit(-1).cast("bigint").alias("_pos"), "_way", "_subroot", "_root")
    return _blocks(own.unionByName(held, allowMissingColumns=True), 2**bits)


def _ways(rows: list[dict], bits: int) -> list[dict]:
    head, nodes = rows[0], rows[1:]
    levels = forward([r["_digest"] for r in nodes], height(nodes[0]["_n"], bits))
    up = backward(levels, head["_way"])
    return [{**r, "_way": way, "_subroot": head["_subroot"], "_root": head["_root"]} for r, way in zip(nodes, up, strict=True)]


def manifest(docs: DataFrame, group: str, order: list[str], leaf: Column, shown: Column, *keep: str, bits: int = BITS, proofs: bool = False) -> DataFrame:
    """``keep`` and for each row ``leaf``, ``subroot`` (of its group), ``root``, ``proof_sha256`` (of the siblings on its way up),
    ``folded_root`` (from the leaf ``shown``, null: from ``leaf``, and those siblings) and ``verified`` (whether that is the root);
    with ``proofs`` also ``proof``, the siblings after ``L`` or ``R``, ``-`` for none.

    Leaves of a group are in ascending ``order``, nulls first; rows that tie are ordered by leaf, equal ones anyhow. A null group is a group
    of its own, the first. An empty table gives an empty one; other columns stay behind. Texts enter by their digest only.
    """
    rows = docs.select(
        docs[f"`{group}`"].alias("_g"), *[docs[f"`{c}`"].alias(f"_o{i}") for i, c in enumerate(order)], leaf.alias("_digest"), shown.alias("_shown"),
        *[docs[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(keep)],
    )
    by = [f"_o{i}" for i in range(len(order))] + ["_digest"]
    leaves = cut_lineage(numbered(rows, "_g", by).drop(*by[:-1]))
    rounds = _climb(leaves, bits)
    tops = rounds[-1].select(F.col("_g").alias("_name"), "_digest", F.lit(0).cast("bigint").alias("_g"))
    crowns = cut_lineage(numbered(tops, "_g", ["_name"]))
    upper = _climb(crowns, bits)
    crown = upper[-1].select("_g", "_pos", F.lit("").alias("_way"), F.lit("").alias("_subroot"), F.col("_digest").alias("_root"))
    named = _mapped(
        _with_above(upper[0], _descend(upper, crown, bits), bits),
        lambda rows: [{"_g": r["_name"], "_pos": 0, "_way": r["_way"], "_subroot": r["_digest"], "_root": r["_root"]} for r in _ways(rows, bits)],
        f"_g {docs.schema[group].dataType.simpleString()}, _pos bigint, {ABOVE}",
    )
    above = _descend(rounds, cut_lineage(named), bits)
    kept = [f"_{i}" for i in range(len(keep))]
    types = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    made = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if proofs else "")

    def last(rows: list[dict]) -> list[dict]:
        out = []
        for r in _ways(rows, bits):
            steps = steps_of(r["_way"])
            folded = fold(r["_shown"] or r["_digest"], steps)
            out.append({
                **{c: r[c] for c in kept}, "leaf": r["_digest"], "subroot": r["_subroot"], "root": r["_root"],
                "proof_sha256": _hash("".join(s[1:] for s in steps)), "folded_root": folded, "verified": folded == r["_root"],
                **({"proof": steps} if proofs else {}),
            })
        return out

    schema = ", ".join([*[f"{c} {types[c]}" for c in kept], *[f"`_m{i}` {part.split(' ')[1]}" for i, part in enumerate(made.split(", "))]])
    names = [part.split(" ")[0] for part in made.split(", ")]
    renamed = lambda rows: [{**{c: r[c] for c in kept}, **{f"_m{i}": r[n] for i, n in enumerate(names)}} for r in last(rows)]
    return _mapped(_with_above(leaves, above, bits), renamed, schema).toDF(*keep, *names)


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row of ``documents`` with one character more, where 7 divides ``crc32`` of the decimal ``doc_id``; else null."""
    hit = (F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0) & docs["n_chars"].isNotNull()
    return F.when(hit, digest_of(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"] + 1, docs["text"]))


def documents(docs: DataFrame, *keep: str, **more) -> DataFrame:
    """``manifest`` of ``documents`` by ``lang`` and ``doc_id``; what is shown for checking is tampered with in every seventh row or so."""
    leaf = digest_of(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], docs["text"])
    return manifest(docs, "lang", ["doc_id"], leaf, tampered(docs), *keep, **more)
