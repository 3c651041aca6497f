"""Toxicity scores from a learned lexicon, matched with misspellings, and the words around each match.

``learn`` takes a lexicon (terms that tell toxic from clean documents) and the weights of a small logistic model from a bounded
sample of labelled documents, each class weighted to its share of all labelled ones; ``score`` applies both to every whole text.
A lexicon trie is intersected with a Levenshtein automaton: a state is a set of (trie node, edits left), made when first met, so a word costs one lookup per character until no
term is in reach. Each match counts by the evidence of its term, as exact or misspelled, and by its context window: other
matches nearby and address of the reader speak for abuse, quotation marks around the match or verbs of report before it speak
against.

Null texts count as empty and get the score of a text without matches. Documents without a label are scored like any other.
Repeated label rows of a document count once (the larger label); without usable labels the lexicon is empty and every score is
the share of toxic labels, or 0. Columns ``lang``, ``source`` and the identifier never reach a score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.base import fold_of, over_texts
from touchline.llm.hashing import Words, windows

# Labelled rows of each class that learning may take (the lowest hashes of the identifier).
SAMPLE = 12_000
# Most terms of a lexicon, and the least number of toxic sample documents a term must be in.
TERMS, SUPPORT = 1_000, 2
# Beginnings of words that count as terms of their own when they tell classes apart: any ending may follow.
STEMS = (4, 5)
WINDOW = 6
EDGE = "\"'.,;:!?()[]{}<>«»„“”‘’*#$%&|-_"
# Marks and words of quotation and report, words that address someone.
QUOTES = set("\"'«»„“”‘’")
REPORTS = frozenset("said says called quote quoted wrote citing term word dit mot dijo palabra sagte wort".split())
ADDRESS = frozenset("you your you're youre u du dich dein tu te ton toi tú usted vous ihr".split())
# Characters used for letters, as written in place of them.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
FEATURES = 8


class Automaton:
    """Words within an edit bound of some lexicon term, read one character at a time.

    Terms of up to 4 characters must match exactly, up to 8 within one edit, longer ones within two.
    """

    def __init__(self, terms: list[str], most_states: int = 200_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.slack: list[int] = [0]  # edits that some term below allows
        for i, term in enumerate(terms):
            node, allowed = 0, self.allowed(term)
            self.slack[0] = max(self.slack[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.term)
                    self.children.append({})
                    self.term.append(-1)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], allowed)
            self.term[node] = i
        self.bound = [self.allowed(t) for t in terms]
        self.most = most_states
        self._reset()

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if len(term) <= 4 else 1 if len(term) <= 8 else 2

    def _reset(self) -> None:
        self.states: list[dict[int, int]] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the state: trie node -> fewest edits, closed under letters of the term left out."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                edits = nodes[node] + 1
                if edits <= self.slack[child] and edits < nodes.get(child, 9):
                    nodes[child] = edits
                    todo.append(child)
        key = tuple(sorted(nodes.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in nodes.items() if self.term[n] >= 0 and e <= self.bound[self.term[n]]]
            self.accepts.append(min(ends) if ends else None)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        after: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.slack[node] and edits < after.get(node, 9):
                after[node] = edits

        for node, edits in self.states[state].items():
            put(node, edits + 1)  # a letter too many
            for letter, child in self.children[node].items():
                put(child, edits + (letter != c))
        found = self._state(after) if after else -1
        self.moves[state][c] = found
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within its bound, the first of equal ones; None if there is none."""
        if len(self.states) > self.most:
            self._reset()
        state = self.start
        for c in word:
            go = self.moves[state].get(c)
            state = self._move(state, c) if go is None else go
            if state < 0:
                return None
        return self.accepts[state]


@dataclass
class Model:
    """Whole terms first, then beginnings (written with a final ``*``)."""

    terms: list[str] = field(default_factory=list)
    evidence: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))


class Reader:
    """Features of a text under a model; words already looked up are kept, up to a bound."""

    def __init__(self, model: Model, keep: int = 400_000):
        self.automaton, self.evidence = Automaton([t for t in model.terms if not t.endswith("*")]), model.evidence
        self.stems = {t[:-1]: i for i, t in enumerate(model.terms) if t.endswith("*")}
        self.known: dict[str, tuple[int, int] | None] = {}
        self.keep = keep

    def _look_up(self, word: str) -> tuple[int, int] | None:
        """(edits, term): a term as written, a beginning of the lexicon, or a misspelling, in this order."""
        plain = word.strip(EDGE).lower()
        if not plain:
            return None
        found = self.automaton.match(plain)
        if found is not None and not found[0]:
            return found
        for size in STEMS:
            stem = self.stems.get(plain[:size])
            if stem is not None and len(plain) > size:
                return 0, stem
        if not plain.isalpha():
            clear = word.lower().translate(LOOKALIKES).strip(EDGE)
            again = self.automaton.match(clear) if clear != plain else None
            if again is not None and (found is None or again[0] < found[0]):
                found = (max(again[0], 1), again[1])  # still a misspelling
        return found

    def features(self, text: str) -> list[float]:
        words = text.split()
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > self.keep:
            known.clear()
            new = set(words)
        for word in new:
            known[word] = self._look_up(word)
        hits = [(i, known[w]) for i, w in enumerate(words) if known[w] is not None] if any(map(known.get, set(words))) else []
        exact = near = quoted = close = address = 0.0
        best, total = 0.0, 0.0
        last = -(10**9)
        for i, (edits, term) in hits:
            weight = self.evidence[term] * (1.0, 0.6, 0.3)[edits]
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            is_quoted = words[i][0] in QUOTES or words[i][-1] in QUOTES or any(w.lower().strip(EDGE) in REPORTS for w in words[max(0, i - 3) : i])
            close += i - last <= WINDOW
            address += any(w.lower().strip(EDGE) in ADDRESS for w in around)
            quoted += is_quoted
            exact += edits == 0
            near += edits > 0
            best, total = max(best, weight), total + weight
            last = i
        soft = math.log1p
        return [best, soft(total), soft(exact), soft(near), soft(quoted), soft(close), soft(address), soft(100 * total / (len(words) + 20))]


def usable_labels(labels: DataFrame, target: str = "toxic") -> DataFrame:
    """``labelled``, ``label``: one row for each identifier with a label outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (fold_of(F.col("doc_id")) != 0))
    return usable.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(target).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``text`` and ``label`` of at most ``sample`` documents of each class outside the held-out fold.

    The identifiers chosen are bounded, so they are broadcast; the texts are never shuffled.
    """
    once = usable_labels(labels, target)
    pick = lambda value: once.where(F.col("label") == value).orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    chosen = pick(1).unionByName(pick(0))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("text", "label")
    # Copies teach a class nothing new: one document stays of those with the same least hash of five words.
    return over_texts(rows, _least, "least bigint, copy string", "label").dropDuplicates(["least", "label"]).select(F.col("copy").alias("text"), "label")


def _least(texts: list[bytes]) -> dict[str, list]:
    words = Words(texts)
    own = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    least = [int(windows(h, min(5, len(h))).min() >> np.uint64(1)) if len(h) else 0 for h in own]
    return {"least": least, "copy": [t.decode("utf-8", "replace") for t in texts]}


def class_sizes(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> dict[int, int]:
    """Documents of each class outside the held-out fold, over all rows: what ``labelled_sample`` draws from. Two rows come to the driver."""
    rows = docs.groupBy("doc_id").count().join(usable_labels(labels, target), F.col("doc_id") == F.col("labelled"))
    return {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("count").alias("n")).collect()}


def lexicon(sample: DataFrame, terms: int = TERMS, support: int = SUPPORT) -> tuple[list[str], list[float]]:
    """Terms, then beginnings of words, whose share among toxic documents is far above that among clean ones; log odds as evidence."""
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return [], []
    words = sample.select("label", F.array_distinct(F.split(F.lower("text"), r"[\s\p{Punct}«»„“”‘’]+")).alias("words"))
    starts = [F.array_distinct(F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))) for n in STEMS]
    seen = words.select("label", F.explode(F.concat("words", *starts)).alias("word")).where("word != ''")
    counts = seen.groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    stem = F.col("word").endswith("*")
    ranked = counts.select("word", stem.alias("stem"), odds.alias("odds"), (odds / spread).alias("z"), "a")
    enough = F.col("a") >= F.when(stem, support + 1).otherwise(support)
    rows = ranked.where(enough & (F.col("odds") > 3) & (F.col("z") > F.when(stem, 3.0).otherwise(2.4))).orderBy(F.desc("z"), "word").limit(terms).collect()
    rows.sort(key=lambda r: r["stem"])
    return [r["word"] for r in rows], [float(min(r["odds"], 8.0)) for r in rows]


def fit_weights(rows: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 40, counts: np.ndarray | None = None) -> list[float]:
    """Logistic weights (intercept first) by Newton steps with a ridge; few features, so this is a small local sum.

    ``counts``: how many documents each row stands for (default: one).
    """
    counts = np.ones(len(rows)) if counts is None else counts
    x = np.hstack([np.ones((len(rows), 1)), rows])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - target)) + penalty * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, gradient)
        w -= np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE) -> Model:
    """Lexicon and weights from the bounded sample; features come to the driver as counted distinct rows.

    The sample takes classes in other shares than they have (the larger class is cut first, copies are left out), so the rows of
    each class stand for all documents of the class: the level of the scores does not move with ``sample`` or the input's size.
    """
    rows = labelled_sample(docs, labels, target, sample)
    model = Model(*lexicon(rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[bytes]) -> dict[str, list]:
        reader = Reader(shared.value)
        return {"features": [reader.features(t.decode("utf-8", "replace")) for t in texts]}

    seen = over_texts(rows, work, "features array<double>", "label").collect()
    if seen:
        found = Counter((tuple(np.round(r["features"], 4)), r["label"]) for r in seen)
        x, y = np.array([k[0] for k in found]), np.array([k[1] for k in found], float)
        real, taken = class_sizes(docs, labels, target), Counter(r["label"] for r in seen)
        counts = np.array([n * real[k[1]] / taken[k[1]] for k, n in found.items()])
        model.weights = fit_weights(x, y, counts=counts) if 0 < y.sum() < len(y) else [20.0 if y.all() else -20.0, *[0.0] * FEATURES]
    else:
        model.weights = [-20.0, *[0.0] * FEATURES]
    return model


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` with ``score`` (0 to 1), ``predicted``, and ``n_hits`` (lexicon matches, misspelled ones included)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    readers: dict[int, Reader] = {}

    def work(texts: list[bytes]) -> dict[str, list]:
        reader = readers.get(0) or readers.setdefault(0, Reader(shared.value))
        rows = np.array([reader.features(t.decode("utf-8", "replace")) for t in texts])
        weights = np.array(shared.value.weights)
        p = 1 / (1 + np.exp(-np.clip(weights[0] + rows @ weights[1:], -30, 30)))
        hits = np.round(np.expm1(rows[:, 2]) + np.expm1(rows[:, 3])).astype("int64")
        return {"score": p.tolist(), "predicted": (p >= 0.5).astype("int32").tolist(), "n_hits": hits.tolist()}

    return over_texts(docs, work, "score double, predicted int, n_hits bigint", *keep)
