"""The prefix primitives against brute force, with clocks that step back and tiny blocks."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.functions.prefix import Running, greedy_cooldown, numbered, prefix_window, running, sequence_block

SCHEMA = "match_id bigint, team_id int, period int, sequence int, elapsed_seconds int, fact int, fires boolean"


def stream(seed, matches=2, events=160, step=40, jump=0.05, size=900):
    rng = random.Random(seed)
    rows = []
    for match in range(matches):
        clock, period = 0, 1
        for sequence in range(1, events + 1):
            if sequence == events // 2:
                clock, period = 0, 2
            clock += rng.randint(0, step)
            seen = clock + (rng.choice([-size, size]) if rng.random() < jump else 0)
            rows.append((match, rng.randint(1, 2), period, sequence, max(seen, 0), int(rng.random() < 0.4), rng.random() < 0.5))
    return rows


def expected(rows, window):
    out = {}
    for m, t, p, s, e, _, fires in rows:
        if not fires:
            continue
        facts = [r for r in rows if r[0] == m and r[1] == t and r[3] <= s and r[5]]
        recent = sum(r[2] == p and r[4] > e - window for r in facts)
        out[m, s] = (recent, len(facts) - recent)
    return out


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 1), (3, 64), (4, 4096)])
def test_prefix_window_equals_brute_force(spark, seed, block):
    rows = stream(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    found = prefix_window(df, {"n": F.col("fact")}, trigger=F.col("fires"), window_seconds=600, block_rows=block)
    got = {(r["match_id"], r["sequence"]): (r["recent_n"], r["earlier_n"]) for r in found.collect()}
    assert got == expected(rows, 600)


def test_backward_clock_keeps_rows_ahead_of_now(spark):
    rows = [(1, 1, 1, s, e, 1, True) for s, e in ((1, 100), (2, 700), (3, 700), (4, 650))]
    df = spark.createDataFrame(rows, SCHEMA)
    found = prefix_window(df, {"n": F.col("fact")}, trigger=F.col("fires"), window_seconds=600)
    assert [r["recent_n"] for r in found.orderBy("sequence").collect()] == [1, 1, 2, 4]


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_running_sum_and_max(spark, block):
    rows = stream(9)
    df = spark.createDataFrame(rows, SCHEMA)
    found = running(
        df, ["match_id"], ["sequence"], sequence_block(block),
        [
            Running("total", "sum", F.col("fact"), ("team_id",)),
            Running("highest", "max", F.col("elapsed_seconds"), ("period",), exclusive=True),
            Running("after", "max", F.col("elapsed_seconds"), ("period",), exclusive=True, backward=True),
        ],
    ).collect()
    for r in found:
        same = [x for x in rows if x[0] == r["match_id"]]
        assert r["total"] == sum(x[5] for x in same if x[1] == r["team_id"] and x[3] <= r["sequence"])
        before = [x[4] for x in same if x[2] == r["period"] and x[3] < r["sequence"]]
        assert r["highest"] == (max(before) if before else None)
        after = [x[4] for x in same if x[2] == r["period"] and x[3] > r["sequence"]]
        assert r["after"] == (max(after) if after else None)


def test_numbered_is_a_row_number(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), ((F.col("id") * 37) % 101).alias("v"), "id")
    found = numbered(df, ["k"], ["v", "id"], F.floor(F.col("v") / 4), "n").collect()
    for k in range(3):
        mine = sorted((r for r in found if r["k"] == k), key=lambda r: (r["v"], r["id"]))
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_cooldown_equals_a_scan(spark, seed):
    rows = [r for r in stream(seed, events=300, jump=0.2) if r[6]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["match_id"], r["sequence"]) for r in greedy_cooldown(df, 300).collect()}
    want, until = set(), {}
    for m, t, p, s, e, _, _ in sorted(rows, key=lambda r: (r[0], r[3])):
        if e >= until.get((m, t, p), -1):
            want.add((m, s))
            until[m, t, p] = e + 300
    assert got == want


def test_one_match_with_everything_uses_many_blocks(spark):
    """A hot match is cut into blocks, and the result does not change."""
    rows = stream(11, matches=1, events=600)
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda block: sorted(
        map(tuple, prefix_window(df, {"n": F.col("fact")}, trigger=F.col("fires"), window_seconds=600, block_rows=block).collect())
    )
    assert run(16) == run(100_000)
