"""The registered queries ``opN_<name>`` and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import (
    byte_bpe, decontam, license_scan, merkle, ngram_join, periodic_runs, pii, quality_rules, secret_scan, sharding, suffix_dedup, token_counts, toxicity,
)
from touchline.llm.base import cut_lineage, fold_of, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, folder, "documents"), "doc_id")
    kept = quality_rules.apply_policy(rows, quality_rules.STANDARD)
    return kept.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"), "kept", "failed", "policy",
    )


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after three batches over all documents: first counts, a second tokenizer version, then edits and deletions."""
    docs = table(spark, folder, "documents")
    book = token_counts.Book(spark, token_counts.new_book(spark))
    every = docs.select("doc_id", "source", "lang", "text")
    for version in token_counts.COUNTERS:
        book.commit(f"load-{version}", token_counts.counted(every, version))
    gone = F.col("doc_id") % 10 == 3
    edited = every.where((F.col("doc_id") % 10 == 7) & ~gone).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" one more line")))
    changes = token_counts.counted(edited, "words-1").unionByName(token_counts.removed(every.where(gone), "words-1"))
    book.commit("edit-1", changes)
    book.commit("edit-1", changes)  # a repeated commit changes nothing
    return book.totals()


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY), "doc_id")


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"), "doc_id")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[number(k) for k in pii.KINDS],
        F.sha2(pii.joined("base").cast("binary"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"),
    )


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find(table(spark, folder, "documents"), "doc_id")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[number(k) for k in secret_scan.KINDS],
        F.sha2(pii.joined("base").cast("binary"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"),
    )


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """A shard for each document, and the one it would have after one shard more."""
    docs = table(spark, folder, "documents").select("doc_id")
    now = sharding.place(docs, "doc_id", [f"shard-{i:03d}" for i in range(64)])
    return sharding.place(now, "doc_id", [f"shard-{i:03d}" for i in range(65)], name="next_shard").select("doc_id", "slot", "shard", "next_shard")


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels), "doc_id")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "n_hits")


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.documents(table(spark, folder, "documents"), "doc_id")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = periodic_runs.find(docs.withColumn("text", periodic_runs.planted(F.col("text"), F.col("doc_id"))), "doc_id")
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n"))))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed")
    return found.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("listed", lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.find(table(spark, folder, "documents"), "doc_id")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_suffix_dedup, op2_quality_rules, op3_token_counts, op4_byte_bpe, op5_pii, op6_decontamination, op7_secret_scan, op8_ngram_join, op9_sharding, op10_toxicity,
    op11_merkle_manifest, op12_periodic_runs, op13_license_scan,
)}

_MATCH = "[^\\x20\\x09-\\x0D]+"


def _sized(column: str) -> str:
    return f"case when {column} is null then '-' else strlen({column}::varchar)::varchar || ':' || {column}::varchar end"


SQL: dict[str, str] = {
    "op11_merkle_manifest": f"""
with recursive d as (
    select *, list_reduce(list_prepend(4294967295::bigint, flatten([[((ascii(c) >> k) & 1)::bigint for k in range(8)] for c in string_split(doc_id::varchar, '')])),
        lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)) as crc from documents
),
e as (
    select doc_id, lang, sha256({_sized("doc_id")} || {_sized("source")} || {_sized("lang")} || {_sized("n_chars")} || {_sized("text")}) as leaf,
        case when xor(crc, 4294967295) % 7 = 0 and n_chars is not null
            then sha256({_sized("doc_id")} || {_sized("source")} || {_sized("lang")} || {_sized("(n_chars + 1)")} || {_sized("text")}) end as shown
    from d
),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from e),
low(lang, level, pos, n, digest) as (
    select lang, 0::bigint, pos, n, leaf from leaves
    union all
    select lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from low where n > 1 group by lang, level, pos // 2, n
),
tops as (select lang, digest as subroot, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as groups from low where n = 1),
high(level, pos, n, digest) as (
    select 1000::bigint, place, groups, subroot from tops
    union all
    select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from high where n > 1 group by level, pos // 2, n
),
way as (
    select l.doc_id, l.lang, l.pos as leaf_pos, x.level, case when y.digest is null then '-' when y.pos < x.pos then 'L' || y.digest else 'R' || y.digest end as step
    from leaves l join low x on x.lang is not distinct from l.lang and x.pos = l.pos >> x.level and x.n > 1
    left join low y on y.lang is not distinct from x.lang and y.level = x.level and y.pos = xor(x.pos, 1)
    union all
    select l.doc_id, l.lang, l.pos, x.level, case when y.digest is null then '-' when y.pos < x.pos then 'L' || y.digest else 'R' || y.digest end
    from leaves l join tops t on t.lang is not distinct from l.lang join high x on x.pos = t.place >> (x.level - 1000) and x.n > 1
    left join high y on y.level = x.level and y.pos = xor(x.pos, 1)
),
steps as (select doc_id, lang, leaf_pos, list(step order by level) as steps from way group by all),
folded as (
    select l.doc_id, l.lang, leaf, coalesce(steps, []) as steps, list_reduce(list_prepend(coalesce(shown, leaf), coalesce(steps, [])),
        lambda a, s: case when s = '-' then sha256(a) when s[1] = 'L' then sha256(s[2:] || a) else sha256(a || s[2:]) end) as folded_root
    from leaves l left join steps s on s.doc_id is not distinct from l.doc_id and s.lang is not distinct from l.lang and s.leaf_pos = l.pos
)
select f.doc_id, leaf, subroot, root, sha256(array_to_string([s[2:] for s in steps], '')) as proof_sha256, folded_root, folded_root = root as verified
from folded f join tops t on t.lang is not distinct from f.lang cross join (select digest as root from high where n = 1)""",
    "op3_token_counts": f"""
with d as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
w as (select *, len(regexp_extract_all(text, '{_MATCH}')) as n from d),
v as (
    select source, lang, 'words-1' as tokenizer, n + case when doc_id % 10 = 7 then 3 else 0 end as tokens from w where doc_id % 10 is distinct from 3
    union all
    select source, lang, 'bytes4-1', cast(ceil(octet_length(encode(text)) / 4.0) as bigint) from d
)
select source, lang, tokenizer, count(*) as documents, sum(tokens)::bigint as tokens from v group by all""",
    "op2_quality_rules": f"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_MATCH}') as w from documents),
lines as (
    select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
    from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{_MATCH}') group by doc_id
),
wins as (select doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from wins) where n > 1),
again as (select doc_id, count(distinct i + k) as n from twice, range(5) r(k) group by doc_id),
m as (
    select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper,
        coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(again.n, 0) as n_repeat_words
    from d left join lines using (doc_id) left join again using (doc_id)
),
f as (
    select *, (n_words < 10)::int + 2 * (100 * n_repeat_words > 20 * n_words)::int + 4 * (100 * n_symbols > 10 * n_words)::int
        + 8 * (100 * n_dup_lines > 30 * n_lines)::int + 16 * (word_chars < 2 * n_words or word_chars > 15 * n_words)::int
        + 32 * (2 * n_upper > word_chars)::int as failed from m
)
select doc_id, n_words, word_chars::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 > 0 as base_failed,
    failed = 0 as kept, failed::bigint as failed, 'standard-1' as policy from f""",
}
