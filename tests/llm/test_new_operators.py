"""Merkle manifest, periodic runs and license scan against plain versions, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import corpus, docs, none, passage, rows_of, words  # noqa: F401
from touchline.llm import license_scan, merkle, periodic_runs, queries

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- op11


def leaf_of(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level):
    """Levels of a tree, lowest first."""
    levels = [level]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append("-" if other >= len(level) else ("L" if other < at else "R") + level[other])
        at //= 2
    return out


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[g] = climb([leaf_of(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            way = siblings(trees[g], at) + siblings(top, k)
            hit = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            digest = leaf_of(r, 1 if hit else 0)
            for step in way:
                digest = sha(digest if step == "-" else step[1:] + digest if step[0] == "L" else digest + step[1:])
            proof = sha("".join(s[1:] for s in way))
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [2, merkle.BITS])
def test_manifest_equals_a_plain_tree(spark, bits):
    rng = random.Random(bits)
    langs = ["en"] * 30 + ["de"] * 4 + ["fr", "", "é", None, None, "en"]
    rows = [(i, rng.choice([None, "s", "t"]), langs[i], rng.choice([None, i, i, i, i]), rng.choice([None, "", "a b", "é" * i])) for i in range(40)]
    # Repeated rows, one identifier with two texts, and nulls in every column.
    rows += [rows[3], rows[3], (3, "s", "en", 1, "other"), (None, None, None, None, None), (None, "s", "en", 5, "x"), (70, "s", "en", 9, "x " * 90_000)]
    table = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    found = rows_of(merkle.documents(table, "doc_id", bits=bits))
    assert found == plain_manifest([r.asDict() for r in table.collect()])
    assert {r[6] for r in found} == {True, False}


def test_manifest_of_few_rows(spark):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    one = spark.createDataFrame([(1, "s", "en", 2, "ab")], schema)
    leaf = leaf_of({"doc_id": 1, "source": "s", "lang": "en", "n_chars": 2, "text": "ab"})
    assert rows_of(merkle.documents(one, "doc_id")) == [(1, leaf, leaf, leaf, sha(""), leaf, True)]
    assert rows_of(merkle.documents(one.where("doc_id < 0"), "doc_id")) == []


def test_manifest_keeps_any_columns(docs):  # noqa: F811
    kept = ("doc_id", "text", "token", "_text", "row_number", "slot", "a.b")
    found = merkle.documents(docs, *kept, bits=2, proofs=True)
    assert found.columns[: len(kept)] == list(kept)
    rows = found.collect()
    assert len(rows) == docs.count()
    assert all(merkle.fold(r["leaf"], r["proof"]) == r["root"] and sha("".join(s[1:] for s in r["proof"])) == r["proof_sha256"] for r in rows)


def test_manifest_ways_of_every_size():
    for n in range(1, 40):
        digests = [sha(str(i)) for i in range(n)]
        for levels in {merkle.height(n, 10), merkle.height(n, 10) + 2}:
            rows = merkle.forward(digests, levels)
            assert len(rows[-1]) == 1
            for digest, way in zip(digests, merkle.backward(rows, "-"), strict=True):
                assert merkle.fold(digest, merkle.steps_of(way)) == sha(rows[-1][0])


# ---- op12


def plain_runs(w, least):
    n, out = len(w), set()
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            own = w[i : i + size]
            if j > i and size >= max(least, 3 * p) and not any(own[q:] == own[:-q] for q in range(1, p)):
                out.add((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng):
    """Words with periodic stretches inside each other."""
    letters = rng.choice([1, 2, 3, 6])
    w = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
    while len(w) < 150 and rng.random() < 0.8:
        base = w[-rng.randint(1, 20) :] or [0]
        w += [base[i % len(base)] for i in range(rng.randint(1, 5 * len(base)))] + [rng.randrange(letters + 1)]
    return [b"%d" % x for x in w]


@pytest.mark.parametrize("least", [6, 12, 24])
def test_runs_equal_those_of_every_period(least, monkeypatch):
    rng = random.Random(least)
    for trial in range(120):
        monkeypatch.setattr(periodic_runs, "CANDIDATES", 7 if trial % 3 == 0 else 400_000)
        texts = [periodic(rng) for _ in range(rng.randint(1, 4))]
        made = periodic_runs._work([b" ".join(t) for t in texts], least)
        for text, found in zip(texts, made["runs"], strict=True):
            assert [(r["start"], r["length"], r["period"]) for r in found] == plain_runs(text, least)


def test_runs_of_known_texts():
    cases = {"a " * 24: [(0, 24, 1)], "a " * 23: [], "a b c d e f g h " * 3: [(0, 24, 8)], ("a " * 30 + "b ") * 3: [(0, 30, 1), (0, 93, 31), (31, 30, 1), (62, 30, 1)]}
    made = periodic_runs._work([c.encode() for c in cases], 24)
    assert [[(r["start"], r["length"], r["period"]) for r in found] for found in made["runs"]] == list(cases.values())
    assert made["collapsed"][0] == "a" and made["collapsed"][2] == "a b c d e f g h"


def test_grammar_spells_the_words():
    rng = random.Random(3)
    w = np.array([rng.randrange(3) for _ in range(500)])
    g = periodic_runs.Grammar(w, np.zeros(500, np.int64))
    assert len(g.begin) < 500 and max(g.end - g.begin) == 500
    for symbol, place in zip(g.symbol, g.place, strict=True):
        size = g.end[symbol] - g.begin[symbol]
        assert (w[place : place + size] == w[g.begin[symbol] : g.end[symbol]]).all()


def plain_op12(doc_id, text):
    w = words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 24)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    start, size, q = best or (None, None, None)
    lines = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
    return (doc_id, len(runs), start, size, q, best and 1000 * size // q, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query_equals_a_plain_one(spark, tmp_path):
    rng = random.Random(9)
    rows = corpus() + [(i, b" ".join(periodic(rng)).decode()) for i in range(100, 300)]
    # Identifiers whose texts are made periodic, among them without words.
    hit = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [None, "", " \n", "a", "a b", *[passage(i, i % 200 + 3) for i in range(60)]]
    rows += list(zip(hit, texts, strict=False))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(queries.op12_periodic_runs(spark, str(tmp_path))) == sorted((plain_op12(*r) for r in rows), key=str)


def test_runs_of_awkward_rows(docs, none):  # noqa: F811
    kept = ("doc_id", "text", "token", "_text", "a.b")
    found = periodic_runs.find(docs, *kept)
    assert found.columns == [*kept, "n_words", "runs", "collapsed"]
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in found.collect()) == sorted((str(i), len(words(t))) for i, t in corpus())
    assert rows_of(periodic_runs.find(none, *kept)) == []


def test_runs_of_a_long_text():
    for text in (b"a " * 1_000_000, b"a b c d e f g " * 40_000 + b"x", " ".join(passage(1, 100).split() * 1500).encode()):
        runs = periodic_runs._work([text], 24)["runs"][0]
        n = len(text.split())
        assert len(runs) == 1 and runs[0]["length"] in (n, n - 1)


# ---- op13


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain_places(text):
    w, out = plain_words(text), []
    for phrase, label in license_scan.BASE.items():
        parts = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(parts)] == parts]
    return len(w), sorted(out)


LICENSED = {
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "All rights reserved.": "reserved", "Lizenz: mit der Zeit": "",
    "It is not licensed under the MIT license.": "", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0", "GNU LGPL v3": "lgpl", "Her driver's license": "",
    "see https://www.mozilla.org/en-US/MPL/2.0/": "mpl-2.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License": "cc-by-sa",
    "GNU Lesser General Public License v2.1": "gpl,lgpl-2.1", "released into the public domain": "public-domain", "Modified BSD License": "bsd-3-clause",
    "cc\n\nBY cc-by; CC BY": "cc-by", "ccby acc by cc bye": "", "cc éby": "", "Tous droits réservés": "reserved", "Alle Rechte vorbehalten": "reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the": "mit",
}


def test_licenses_of_known_texts():
    scanner = license_scan.Scanner()
    for text, labels in LICENSED.items():
        assert ",".join(scanner.scan(text.encode())["labels"]) == labels, text
    assert len(scanner.rules) > 300


def test_gates_open_wherever_a_rule_matches():
    gated = license_scan.Scanner()
    samples = list(LICENSED)
    for label, _, name, identifier, address in license_scan.FAMILIES:
        for pattern in (name, identifier, address):
            # Every alternative and optional part of the expression once.
            plain = re.sub(r"\(\?:([^()]*)\)\?", r" \1 ", pattern)
            for k in range(4):
                said = re.sub(r"\(\?:([^()]*)\)", lambda m, k=k: m.group(1).split("|")[k % len(m.group(1).split("|"))], plain)
                said = re.sub(r"\[(.)[^]]*\]", r"\1", said).replace("?", "")
                samples += [f"licensed under the {said} license", f"{said} licence", f"spdx license identifier {said}", said, f"{label} {said}"]
    matched = set()
    for text in samples:
        plain = b" ".join(text.encode().translate(license_scan.PLAIN).split())
        every = {k for k, r in enumerate(gated.rules) if r.pattern.search(plain)}
        assert every <= set(gated.opened(plain.split())), text
        matched |= every
    assert len(matched) > 230


def test_suppression_equals_a_comparison_of_all():
    rng = random.Random(4)
    for _ in range(200):
        found = list({(rng.randrange(6), s := rng.randrange(20), s + rng.randint(1, 8)) for _ in range(rng.randint(0, 25))})
        want = sorted(f for f in found if not any(g[0] < f[0] and g[1] <= f[1] and f[2] <= g[2] for g in found))
        assert sorted(license_scan.uncovered(found, 6)) == want


def test_license_base_and_awkward_rows(spark, docs, none, tmp_path):  # noqa: F811
    texts = [*LICENSED, None, "", " - ", "cc by " * 40, "all rights reserved cc by all rights", "x" * 300_000 + " cc by", "copyright " + "y" * 500_000, "licensed " * 50_000]
    rows = [*corpus(), *[(100 + i, t) for i, t in enumerate(texts)], (100, texts[0]), (None, texts[0])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op13_license_scan(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        n, places = plain_places(t)
        at = [p for p, _ in places]
        want.append((i, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(want, key=str)
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} for r in found)
    kept = ("doc_id", "text", "score", "class", "token", "_text", "a.b")
    assert license_scan.find(docs, *kept).columns[: len(kept)] == list(kept) and license_scan.find(docs, *kept).count() == docs.count()
    assert rows_of(license_scan.find(none, *kept)) == []


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_periodic_runs", "op13_license_scan"])
def test_query_has_a_row_for_each_document(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows_of(found.select("doc_id")) == rows_of(table.select("doc_id"))
    assert found.where(F.col("doc_id").isNull()).count() == 0
