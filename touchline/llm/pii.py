"""Personal data by weak supervision.

Candidates are spans that look like an e-mail address, IP address, card or phone number, in strict and loose writing. Labelers
vote on each candidate (1 personal, 0 not, -1 no opinion): regular expressions, gazetteers (top-level domains, reserved
addresses, card prefixes, area codes) and context words before and after. Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is, without labels; the posteriors train a logistic span classifier over features
of the span and its context, again on counts by pattern. Its verdict decides on loose candidates; the strict ones (``base``)
always stay.

Counts by (kind, votes, features) have a bounded number of patterns, whatever the corpus, so the driver sees only those; all
documents are counted. Null texts count as empty and have no spans. Repeated rows are searched each on their own. With no
candidates at all, reliabilities stay at their prior and nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.base import cut_lineage, over_texts

KINDS = ("email", "ip", "card", "phone")
# The patterns of the strict kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The same languages for long texts: what stands before an anchor is walked back to, and digits are only entered at their first,
# so no start is tried twice and time grows with the length.
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AT, DOMAIN = re.compile("@"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_ONCE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
SPELLED_AT = re.compile(r"[\[(]at[\])] ?", re.IGNORECASE)
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z]++)+", re.IGNORECASE)
# Loose writings: a national phone number, four groups of digits; an address with its signs spelled out is found by its anchor.
LOOSE = {
    "phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ .][0-9]{4}){3}(?![0-9])"),
}
DIGIT = re.compile(r"[0-9]")
# Gazetteers, fixed values.
DOMAINS = frozenset("com org net edu gov info io co uk de fr es it eu us ca au ch at nl be se no dk pl ru jp cn in br mx".split())
CUES = {
    "email": frozenset("email e-mail mail contact write correo courriel adresse an à".split()),
    "ip": frozenset("ip host server address addr login from client adresse".split()),
    "card": frozenset("card visa mastercard credit payment karte carte tarjeta pay".split()),
    "phone": frozenset("phone tel call fax mobile cell telefon téléphone teléfono ruf appel whatsapp".split()),
}
AGAINST = frozenset("isbn version order invoice id no. number ref article part serial".split())
CONTEXT = 40
LABELERS = ("pattern", "check", "gazetteer", "cue", "anticue")
FEATURES = ("strict", "check", "gazetteer", "cue", "anticue", "line_start", "grouped")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def anchored(text: str, anchor: re.Pattern, rest: re.Pattern, gap: str = "") -> list[tuple[int, int]]:
    """Leftmost non-overlapping names, then ``gap`` at most, ``anchor`` and ``rest``: each character is walked over once."""
    out, last = [], 0
    for m in anchor.finditer(text):
        if m.start() < last:
            continue
        end = m.start() - 1 if gap and m.start() > last and text[m.start() - 1] == gap else m.start()
        a = end
        while a > last and text[a - 1] in NAME:
            a -= 1
        tail = rest.match(text, m.end()) if a < end else None
        if tail:
            out.append((a, tail.end()))
            last = tail.end()
    return out


def strict(text: str) -> list[tuple[str, int, int]]:
    """The base spans, leftmost and without overlap in each kind; failing matches are dropped."""
    out = []
    if "@" in text:
        out += [("email", *s) for s in anchored(text, AT, DOMAIN)]
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP_ONCE.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def loose(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loose candidates that no strict span overlaps."""
    out: list[tuple[str, int, int]] = []
    if not (DIGIT.search(text) or "at" in text.lower()):
        return out
    spans = merged((a, b) for _, a, b in taken)
    starts = [a for a, _ in spans]
    found = [("email", *s) for s in anchored(text, SPELLED_AT, SPELLED_DOMAIN, " ")] if "[" in text or "(" in text else []
    found += [(kind, *m.span()) for kind, pattern in LOOSE.items() for m in pattern.finditer(text)]
    for kind, a, b in found:
        near = bisect_left(starts, b) - 1  # the last span that begins before b
        if near < 0 or spans[near][1] <= a:
            out.append((kind, a, b))
    return out


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def describe(text: str, kind: str, a: int, b: int, is_strict: bool) -> dict:
    """Votes of the labelers and features of one candidate."""
    span, digits = text[a:b], re.sub(r"[^0-9]", "", text[a:b])
    before = text[max(0, a - CONTEXT) : a].lower().split()
    near = {w.strip(":,;.()[]") for w in [*before[-5:], *text[b : b + CONTEXT].lower().split()[:2]]}
    cue, anticue = bool(near & CUES[kind]), bool(near & AGAINST)
    if kind == "email":
        check = True
        gazetteer = re.split(r"[^A-Za-z0-9]+", span.rstrip(")] "))[-1].lower() in DOMAINS
    elif kind == "ip":
        parts = [int(p.lstrip("0") or "0") for p in span.split(".")]
        check = all(p == str(n) for p, n in zip(span.split("."), parts, strict=True))
        gazetteer = parts[0] not in (0, 10, 127, 192, 255)
    elif kind == "card":
        check, gazetteer = luhn(digits), digits[0] in "3456"
    else:
        check, gazetteer = 9 <= len(digits) <= 15, digits[0] not in "0"
    votes = [int(is_strict), int(check), 1 if gazetteer else -1, 1 if cue else -1, 0 if anticue else -1]
    grouped = any(c in span for c in " -()")
    bits = [is_strict, check, gazetteer, cue, anticue, a == 0 or text[a - 1] == "\n", grouped]
    return {"kind": kind, "start": a, "stop": b, "strict": is_strict, "votes": ",".join(map(str, votes)), "features": "".join("01"[x] for x in bits)}


CANDIDATE = "struct<kind:string,start:bigint,stop:bigint,strict:boolean,votes:string,features:string>"


def _find(texts: list[bytes]) -> dict[str, list]:
    out = []
    for raw_text in texts:
        text = raw_text.decode("utf-8", "replace")
        base = strict(text)
        found = [describe(text, *s, True) for s in base]
        found += [describe(text, *s, False) for s in loose(text, base)]
        out.append(found)
    return {"candidates": out}


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    return over_texts(docs, _find, f"candidates array<{CANDIDATE}>", *keep)


def reliabilities(patterns: list[tuple[list[int], float]], rounds: int = 100, prior: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: posterior of each pattern, and P(vote 1 | class) of each labeler, class 0 first.

    A vote has three outcomes: 1, 0, or none. Keeping silent tells as much as a vote does: a labeler that only ever votes 1 is
    told apart by how often it votes in either class. Labelers are taken as independent given the class; ``prior`` pseudo-counts
    hold rates away from 0 and 1 and say that a labeler is right more often than not, and silent as often in both classes.
    """
    labelers = len(LABELERS)
    # Pseudo-shares of the outcomes 0, 1 and none in class 0 and class 1.
    expected = np.array([[0.5, 0.15, 0.35], [0.15, 0.5, 0.35]])
    rate = np.repeat(expected[:, None, :], labelers, axis=1)
    if not patterns:
        return np.empty(0), rate[:, :, 1]
    votes = np.array([v for v, _ in patterns])
    count = np.array([n for _, n in patterns], float)
    outcome = np.where(votes < 0, 2, votes)
    share, posterior = 0.5, np.full(len(votes), 0.5)
    for _ in range(rounds):
        logs = [np.log(rate[c][np.arange(labelers), outcome]).sum(axis=1) + np.log(share if c else 1 - share) for c in (0, 1)]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        share = float(np.clip((posterior @ count + 1) / (count.sum() + 2), 0.01, 0.99))
        for c, p in ((0, 1 - posterior), (1, posterior)):
            for k in range(3):
                rate[c][:, k] = ((outcome == k) * (p * count)[:, None]).sum(axis=0) + prior * expected[c, k]
            rate[c] /= rate[c].sum(axis=1, keepdims=True)
    return posterior, rate[:, :, 1]


def train(counts: list[tuple[str, str, str, int]]) -> dict[str, list[float]]:
    """Weights of the span classifier of each kind from (kind, votes, features, count)."""
    by_kind = defaultdict(list)
    for kind, votes, features, n in sorted(counts):
        by_kind[kind].append(([int(v) for v in votes.split(",")], features, n))
    out = {}
    for kind, rows in by_kind.items():
        posterior, _ = reliabilities([(v, n) for v, _, n in rows])
        x = np.array([[1.0, *map(float, f)] for _, f, _ in rows])
        n = np.array([n for *_, n in rows], float)
        n = n / n.sum() * min(n.sum(), 10_000.0)
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (n * (p - posterior)) + w
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            move = np.linalg.solve(curve, gradient)
            w -= np.clip(move, -4, 4)
            if np.abs(move).max() < 1e-6:
                break
        out[kind] = w.tolist()
    return out


def find(docs: DataFrame, *keep: str, threshold: float = 0.5) -> DataFrame:
    """``keep`` with ``base`` and ``spans``: arrays of (kind, start, stop), code points, stop exclusive, by kind as listed, then start.

    Candidates are written to the shared folder once (a small row per document); the classifier reads their counts and the
    verdicts read them again.
    """
    own = [f"_{i}" for i in range(len(keep))]
    found = cut_lineage(candidates(docs, *keep).toDF(*own, "candidates"))
    patterns = found.select(F.inline("candidates")).groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    weights = train([tuple(r) for r in patterns.collect()])
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def is_personal(c):
        total = F.lit(0.0)
        for kind, w in weights.items():
            own = F.lit(w[0])
            for i, weight in enumerate(w[1:]):
                own = own + F.substring(c["features"], i + 1, 1).cast("double") * F.lit(weight)
            total = F.when(c["kind"] == kind, own).otherwise(total)
        return c["strict"] | (1 / (1 + F.exp(-total)) >= threshold) & (F.lit(bool(weights)))

    def ordered(keep_it):
        inside = F.transform(F.filter("candidates", keep_it), lambda c: F.struct(rank[c["kind"]].alias("rank"), c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop")))
        return F.transform(F.array_sort(inside), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))

    return found.select(*own, ordered(lambda c: c["strict"]).alias("base"), ordered(is_personal).alias("spans")).toDF(*keep, "base", "spans")


def joined(spans: str):
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def mask(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with ``masked``: the text with each span replaced by its kind in angle brackets.

    The classifier is trained on counts over all documents; texts are then read again and their candidates found anew, so texts
    neither move nor are stored.
    """
    found = candidates(docs, "doc_id")
    patterns = found.select(F.inline("candidates")).groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    shared = docs.sparkSession.sparkContext.broadcast(train([tuple(r) for r in patterns.collect()]))

    def work(texts: list[bytes]) -> dict[str, list]:
        out = []
        for raw_text in texts:
            text = raw_text.decode("utf-8", "replace")
            base = strict(text)
            more = [s for s in loose(text, base) if accepted(describe(text, *s, False), shared.value)]
            out.append(_replace([*base, *more], text))
        return {"masked": out}

    return over_texts(docs, work, "masked string", *keep)


def accepted(candidate: dict, weights: dict[str, list[float]], threshold: float = 0.5) -> bool:
    own = weights.get(candidate["kind"])
    return own is not None and 1 / (1 + np.exp(-(own[0] + sum(w for w, f in zip(own[1:], candidate["features"], strict=True) if f == "1")))) >= threshold


def _replace(spans: list[tuple[str, int, int]], text: str) -> str:
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a < last:  # overlaps one already replaced
            last = max(last, b)
            continue
        out += [text[last:a], f"<{kind}>"]
        last = b
    return "".join(out) + text[last:]
