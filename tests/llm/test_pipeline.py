"""Registered queries against their SQL, and the pipeline stage by stage against plain versions."""

import collections
import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import VOCABULARY, passage, plain_components, ranks, words
from tools.check import TABLES, compare
from touchline.llm import pii, queries, toxicity
from touchline.llm.base import table

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert set(queries.QUERIES) < set(names) and "pipeline" in names and set(queries.SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    base = duckdb.connect()
    for t in TABLES:
        base.sql(f"create view {t} as from '{FOLDER}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    found = base.execute(queries.SQL[name])
    assert compare(frame.columns, [tuple(r) for r in frame.collect()], [c[0] for c in found.description], found.fetchall()).startswith("ok")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_a_row_for_each_document(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    if name != "op3_token_counts":
        assert found.count() == table(spark, FOLDER, "documents").count()


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, FOLDER).cache()
        assert kept.columns == columns
        if name == "ngram_join":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            first = {c for _, _, c in plain_components(rows)}
            assert {r[0] for r in kept.select("doc_id").collect()} == first
        if name == "pii":
            assert kept.count() == before.count()
            assert not [r for r in kept.select("text").collect() if "@mail" in (r["text"] or "")]
    found = corpus_pipeline.run(spark, FOLDER)
    assert collections.Counter(r["doc_id"] for r in found.collect()) == collections.Counter(r["doc_id"] for r in kept.collect())


def test_stages_on_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x y z", None, "b", 5), (4, "mail me: a.b@mail.example.com", "en", "a", 29)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for some in (docs, docs.where("doc_id < 0")):
        kept = some
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, FOLDER)
        assert kept.count() == some.count()


def test_near_duplicates_of_repeated_and_null_identifiers(spark):
    one, two, three, four = (passage(7000 + k, 60) for k in range(4))
    rows = [(1, one), (1, one), (2, one), (3, two), (3, one), (None, one), (None, three), (None, three), (None, four), (5, ""), (5, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    want = [(1, one), (3, two), (None, three), (None, four), (5, ""), (5, ""), (None, None)]
    assert kept.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter(want)


def awkward(spark):
    """Documents of the folder, one with a benchmark item inside, one with personal data, and repeated, nameless and empty ones."""
    item = next(r["text"] for r in table(spark, FOLDER, "benchmark").orderBy("item_id").collect() if len(words(r["text"])) >= 20)
    mail = "mail me: a.b@mail.example.com or 10.20.30.40, card 4111 1111 1111 1111"
    rows = [(900001, passage(1, 9) + " " + item + " " + passage(2, 5)), (900002, mail), (900002, mail), (None, mail), (None, "x y z"), (900003, None), (900004, "")]
    own = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return table(spark, FOLDER, "documents").select(own.columns).unionByName(own)


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_toxicity_stage_keeps_what_is_predicted_clean(spark, monkeypatch):
    docs = awkward(spark)
    model = toxicity.learn(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    monkeypatch.setattr(toxicity, "learn", lambda *_: model)
    reader, weights = toxicity.Reader(model), np.array(model.weights)
    toxic = lambda text: weights[0] + np.array(reader.features(text or "")) @ weights[1:] >= 0
    want = collections.Counter(tuple(r) for r in docs.collect() if not toxic(r["text"]))
    assert 0 < sum(want.values()) < docs.count()
    assert counted(corpus_pipeline.drop_toxic(spark, docs, FOLDER), *docs.columns) == want


def test_decontamination_stage_drops_what_overlaps(spark):
    docs = awkward(spark)
    number = {}
    hashed = lambda text: np.array([number.setdefault(w.lower(), len(number)) for w in words(text)])
    items = [h for r in table(spark, FOLDER, "benchmark").collect() if len(h := hashed(r["text"]))]

    def overlaps(own, item):
        size = min(20, len(item))
        for shift in range(size - len(item), len(own) - size + 1):
            a, b = max(0, shift), min(len(own), shift + len(item))
            same = np.concatenate([[0], np.cumsum(own[a:b] == item[a - shift : b - shift])])
            if b - a >= size and (100 * (same[size:] - same[:-size]) >= 80 * size).any():
                return True
        return False

    want = collections.Counter(tuple(r) for r in docs.collect() if not any(overlaps(hashed(r["text"]), item) for item in items))
    assert 0 < sum(want.values()) < docs.count()
    assert counted(corpus_pipeline.drop_contaminated(spark, docs, FOLDER), *docs.columns) == want


def test_pii_stage_replaces_the_spans_found(spark):
    docs = awkward(spark)
    spans = {r["text"] or "": [tuple(s) for s in r["spans"]] for r in pii.find(docs, "text").collect()}
    assert any(spans.values())

    def masked(text):
        out, last = "", 0
        for kind, a, b in sorted(spans[text], key=lambda s: s[1:]):
            if a >= last:
                out += text[last:a] + f"<{kind}>"
            last = max(last, b)
        return out + text[last:]

    want = collections.Counter()
    for r in docs.collect():
        new = None if r["text"] is None else masked(r["text"])
        want[(r["doc_id"], new, r["lang"], r["source"], None if new is None else len(new))] += 1
    assert counted(corpus_pipeline.mask_private(spark, docs, FOLDER), *docs.columns) == want


def test_byte_bpe_stage_equals_tiktoken(spark):
    docs = awkward(spark)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    want = collections.Counter()
    for r in docs.collect():
        text = r["text"] or ""
        ids = np.array(plain.encode_ordinary(text), "<u4").tobytes()
        want[(r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    found = corpus_pipeline.tokenize(spark, docs, FOLDER)
    assert counted(found, *found.columns) == want
