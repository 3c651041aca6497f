"""A ledger of quality rules: every rule evaluated once per document, verdicts and ablations taken from the bits.

``measure`` takes the measurements of each whole text; ``ledger`` adds one failure bit per rule; ``apply_policy`` keeps documents
by a policy (a version and the rules it counts) without looking at texts again; ``ablation`` counts, for every rule of a policy,
what it alone rejects and what would come back without it, from counts by bit pattern.

Null texts count as empty: no words, all measurements 0. Repeated rows are judged each on their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.base import over_texts
from touchline.llm.hashing import Words, mix, windows

# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
WIDTH = 5
MEASURES = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_upper".split()


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


RULES = (
    Rule(0, "too_short", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule(5, "shouting", "2 * n_upper > word_chars"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        return sum(1 << r.bit for r in rules if r.name in self.rules)


BASE = Policy("base-1", ("too_short", "repeated_words"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def _measure(texts: list[bytes]) -> dict[str, list]:
    words = Words(texts)
    owner = words.text_of_word()
    sizes = np.diff(words.first)
    # Words in windows that occur twice or more in their text.
    found = windows(words.hash, WIDTH)
    whole = owner[: len(found)] == owner[len(owner) - len(found) :]
    at = np.flatnonzero(whole)
    key = mix(found[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(owner) + 1, np.int64)
    starts = at[twice]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WIDTH, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    repeat = covered[words.first[1:]] - covered[words.first[:-1]]
    out: dict[str, list] = {"n_words": sizes.tolist(), "word_chars": [], "n_symbols": [], "n_lines": [], "n_dup_lines": []}
    n_upper = []
    for text in texts:
        plain = text.decode("utf-8", "replace")
        out["word_chars"].append(len(plain) - (len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))))
        out["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
        lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        n_upper.append(len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    return {**out, "n_repeat_words": repeat.tolist(), "n_upper": n_upper}


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    return over_texts(docs, _measure, ", ".join(f"{m} bigint" for m in MEASURES), *keep)


def ledger(docs: DataFrame, *keep: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep``, the measurements and ``failed`` (a bit per rule)."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("bigint") for r in rules]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs, *keep).withColumn("failed", total)


def passes(policy: Policy, failed: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) == 0


def apply_policy(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return rows.withColumn("policy", F.lit(policy.version)).withColumn("kept", passes(policy, rules=rules))


def ablation(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of the policy: documents failing it, and those failing it alone (kept without it).

    Bit patterns are counted first, so what follows has at most 2^rules rows. An empty ledger gives zero counts.
    """
    mask = policy.mask(rules)
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    in_policy = [r for r in rules if mask >> r.bit & 1]
    hit = lambda r: F.col("failed").bitwiseAND(F.lit(1 << r.bit).cast("bigint")) != 0
    alone = lambda r: F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")) == (1 << r.bit)
    count = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
    sums = patterns.agg(*[x for r in in_policy for x in (count(hit(r), f"h{r.bit}"), count(alone(r), f"a{r.bit}"))])
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"h{r.bit}").alias("rejects"), F.col(f"a{r.bit}").alias("rejects_alone")) for r in in_policy])
    return sums.select(F.lit(policy.version).alias("policy"), F.inline(each))
