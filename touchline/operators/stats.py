"""Rank statistics over windows and pairs. Rows shrink to distinct values before any ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.exact import text_hash
from touchline.functions.prefix import Running, numbered, running, with_value_blocks
from touchline.session import cut_lineage

WIDE = "decimal(38,0)"


def ratio(top: Column, bottom: Column) -> Column:
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add a constant key when there is no group, so one code path serves both."""
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def _per_group(small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group; without groups that is a single row, which is safe to broadcast."""
    return F.broadcast(small) if list(keys) == ["_all"] else small


def value_counts(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Distinct values with their count and the number of rows up to them.

    ``by`` must not be empty. Values are scanned in blocks of about as many values each, cut at
    quantiles of the values themselves, so a group with many distinct values is not ordered in
    one task however they are distributed. They are written once, since cuts, blocks and totals
    read them again.
    """
    tied = cut_lineage(df.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n")))
    cut = with_value_blocks(tied, list(by), "value")
    return running(cut, list(by), ["value"], F.col("_cut"), [Running("upto", "sum", F.col("n"))]).drop("_cut")


def double_ranks(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Twice the average rank of each distinct value: a whole number even for ties."""
    rank2 = (2 * F.col("upto") - F.col("n") + 1).cast("bigint")
    return value_counts(df.where(F.col(value).isNotNull()), value, by).select(*by, F.col("value").alias(value), rank2.alias(f"{value}_rank2"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Every row with its average rank; ties share one."""
    rows, keys = _grouped(df, by)
    ranked = rows.join(double_ranks(rows, value, keys), [*keys, value])
    return ranked.withColumn(f"{value}_rank", F.col(f"{value}_rank2") / 2).drop(f"{value}_rank2", "_all")


def moments(x: str, y: str, n: Column) -> list[Column]:
    """Weighted sums of two whole-number columns, exact at any size."""
    a, b, w = (c.cast("decimal(18,0)") for c in (F.col(x), F.col(y), n))
    total = lambda c, name: F.sum(c).cast(WIDE).alias(name)
    return [
        total(w, "n"), total(w * a, "sx"), total(w * b, "sy"),
        total((a * a).cast("decimal(30,0)") * w, "sxx"), total((b * b).cast("decimal(30,0)") * w, "syy"),
        total((a * b).cast("decimal(30,0)") * w, "sxy"),
    ]


def correlation() -> Column:
    """Pearson from moments; NULL below three rows or without spread."""
    n, sx, sy, sxx, syy, sxy = (F.col(c).cast("double") for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    spread = F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0)) * F.greatest(n * syy - sy * sy, F.lit(0.0)))
    return F.when(n >= 3, (n * sxy - sx * sy) / F.nullif(spread, F.lit(0.0)))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson from central moments, which merge between tasks (values up to about 1e150); NULL below three rows or without spread."""
    rows, keys = _grouped(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("observations"), F.covar_pop(a, b).alias("_both"), F.stddev_pop(a).alias("_x"), F.stddev_pop(b).alias("_y")
    )
    value = F.col("_both") / F.nullif(F.col("_x"), F.lit(0.0)) / F.nullif(F.col("_y"), F.lit(0.0))
    found = found.withColumn("pearson", F.when(F.col("observations") >= 3, value))
    return found.select(*by, "observations", "pearson")


def rank_pairs(df: DataFrame, x: str, y: str, by: Sequence[str], cluster: str | None) -> DataFrame:
    """Distinct (cluster, x, y) with counts and doubled ranks taken over the whole group."""
    usable = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    keys = [*by, *([cluster] if cluster else [])]
    pairs = usable.groupBy(*keys, x, y).agg(F.count("*").alias("c"))
    return pairs.join(double_ranks(usable, x, by), [*by, x]).join(double_ranks(usable, y, by), [*by, y])


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    rows, keys = _grouped(df, by)
    sums = rank_pairs(rows, x, y, keys, None).groupBy(*keys).agg(*moments(f"{x}_rank2", f"{y}_rank2", F.col("c")))
    return sums.select(*by, F.col("n").cast("bigint").alias("observations"), correlation().alias("spearman"))


SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def spearman_cluster_interval(
    df: DataFrame, x: str, y: str, *, cluster: str = "match_id", by: Sequence[str] = (), seed: int = 20260928, replicates: int = 1000
) -> DataFrame:
    """Spearman with a 95% interval from resampling whole matches.

    A replicate needs only the moments of the drawn matches on the full sample's ranks, so
    each match is one row of sums. Draw ``i`` of replicate ``r`` picks a match by hash.
    """
    rows, keys = _grouped(df, by)
    # One narrow row per match, read several times below: kept as a table.
    per = cut_lineage(
        rank_pairs(rows, x, y, keys, cluster)
        .groupBy(*keys, cluster)
        .agg(*moments(f"{x}_rank2", f"{y}_rank2", F.col("c")))
    )
    indexed = numbered(with_value_blocks(per, keys, cluster), keys, [cluster], F.col("_cut"), "i").drop("_cut")
    whole = per.groupBy(*keys).agg(F.count("*").alias("matches"), *[F.sum(c).cast(WIDE).alias(c) for c in SUMS])
    draws = (
        indexed.select(*keys, "i")
        .join(_per_group(whole.select(*keys, "matches"), keys), keys)
        .withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .groupBy(*keys, "r", (text_hash(F.lit(seed), F.col("r"), F.col("i")) % F.col("matches") + 1).alias("i"))
        .agg(F.count("*").cast(WIDE).alias("times"))
    )
    # Doubles: sums of squared ranks outgrow any decimal; they are whole and exact up to 2^53.
    times = F.col("times").cast("double")
    drawn = (
        draws.join(indexed, [*keys, "i"])
        .groupBy(*keys, "r")
        .agg(*[F.sum(times * F.col(c).cast("double")).alias(c) for c in SUMS])
        .select(*keys, correlation().alias("value"))
        .where("value is not null")
    )
    # ``replicates`` values per group: a setting, not a data size.
    values = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("v"))
    at = lambda f, shift: F.get("v", (F.floor(F.size("v") * F.lit(f)) - shift).cast("int"))
    low, high = at(0.025, 0), at(0.975, 1)
    return (
        whole.withColumn("spearman", correlation())
        .join(values, keys, "left")
        .select(*by, "spearman", low.alias("low"), high.alias("high"), F.col("n").cast("bigint").alias("observations"), "matches")
    )


def quantiles(df: DataFrame, value: str, spots: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``sorted[min(n - 1, int(f * n))]`` for each named fraction, one row per group."""
    rows, keys = _grouped(df.where(F.col(value).isNotNull()), by)
    counted = value_counts(rows, value, keys)
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    place = lambda f: F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(f)))
    found = counted.join(_per_group(totals, keys), keys).groupBy(*keys).agg(
        *[F.min(F.when(F.col("upto") > place(f), F.col("value"))).alias(name) for name, f in spots.items()]
    )
    return found if by else found.drop("_all")


def medians(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median (mean of the two middle values) per group from distinct values in blocks."""
    rows, keys = _grouped(df.where(F.col(value).isNotNull()), by)
    counted = value_counts(rows, value, keys)
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    middle = lambda shift: F.min(F.when(F.col("upto") > F.floor((F.col("total") - shift) / 2), F.col("value")))
    found = counted.join(_per_group(totals, keys), keys).groupBy(*keys).agg(((middle(1) + middle(0)) / 2).alias("median"))
    return found if by else found.drop("_all")


DECILES = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    rows, keys = _grouped(df.where(F.col(value).isNotNull()), by)
    mean = rows.groupBy(*keys).agg(F.avg(F.col(value).cast("decimal(28,12)")).cast("double").alias("mean"))
    return mean.join(quantiles(rows, value, DECILES, keys), keys).drop("_all")


CUTS = {"cut1": 0.2, "cut2": 0.4, "cut3": 0.6, "cut4": 0.8}


def binned(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Bin 0-4 by the 20/40/60/80% cut values; ties stay together."""
    rows, keys = _grouped(df.where(F.col(value).isNotNull()), by)
    above = sum(((F.col(value) > F.col(c)).cast("int") for c in CUTS), F.lit(0))
    return rows.join(_per_group(quantiles(rows, value, CUTS, keys), keys), keys).withColumn("bin", above).drop(*CUTS, "_all")


def _exact(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(28,12)")


def value_bins(pairs: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    mean = lambda c, name: F.avg(_exact(c)).cast("double").alias(name)
    part = lambda c, name: (F.count_if(c) / F.count("*")).alias(name)
    after_xg = F.coalesce(_exact("xg_after"), F.lit(0).cast("decimal(28,12)"))
    found = binned(pairs, key, by)
    # Distinct matches per bin: one row per bin and match first.
    distinct = found.groupBy(*by, "bin", "match_id").agg(F.lit(1).alias("_one")).groupBy(*by, "bin").agg(F.count("*").alias("matches"))
    summary = found.groupBy(*by, "bin").agg(
        F.min(key).cast("double").alias("lowest"),
        F.max(key).cast("double").alias("highest"),
        F.count("*").alias("pairs"),
        mean(key, "mean_change"),
        mean("shots_change", "mean_shots_change"),
        mean("xg_change", "mean_xg_change"),
        part(F.col("shots_change") > 0, "share_shots_up"),
        part(F.col("shots_change") < 0, "share_shots_down"),
        part(F.col("shots_after") == 0, "share_no_shot_after"),
        mean("shots_after", "mean_shots_after"),
        mean(after_xg, "mean_xg_after"),
        ratio(F.sum(after_xg), F.sum("entries_after")).alias("xg_per_entry_after"),
    )
    return summary.join(distinct, [*by, "bin"])


def change_associations(pairs: DataFrame, by: Sequence[str] = (), seed: int = 20260928, replicates: int = 1000) -> DataFrame:
    """Entries change against shots and xG change, with intervals."""
    usable = pairs.where("xg_change is not null")
    out = None
    for offset, (name, y) in enumerate((("entries_vs_shots", "shots_change"), ("entries_vs_xg", "xg_change"))):
        found = spearman_cluster_interval(
            usable, "entries_change", y, by=by, seed=seed + offset, replicates=replicates
        ).withColumn("association", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def by_group(pairs: DataFrame, group: str, minimum_matches: int = 10, **settings) -> DataFrame:
    sizes = (
        pairs.groupBy(group, "match_id").agg(F.count("*").alias("p")).groupBy(group)
        .agg(F.sum("p").alias("pairs"), F.count("*").alias("group_matches"))
        .where(F.col("group_matches") >= minimum_matches)
    )
    kept = pairs.join(sizes.select(group), group, "left_semi")
    return sizes.join(change_associations(kept, by=[group], **settings), group)


def per_team(pairs: DataFrame, minimum_pairs: int = 30) -> DataFrame:
    """The spread of one coefficient per team, so repeated teams do not dominate."""
    usable = pairs.where("xg_change is not null")
    enough = usable.groupBy("team_id").agg(F.count("*").alias("p")).where(F.col("p") >= minimum_pairs)
    kept = usable.join(enough.select("team_id"), "team_id", "left_semi")
    out = None
    for name, y in (("entries_vs_shots", "shots_change"), ("entries_vs_xg", "xg_change")):
        found = spearman(kept, "entries_change", y, by=["team_id"]).select(
            F.lit(name).alias("association"), F.round("spearman", 9).alias("spearman")
        )
        out = found if out is None else out.unionByName(found)
    rows = out.where("spearman is not null")
    positive = rows.groupBy("association").agg(
        F.count("*").alias("teams"), (F.count_if(F.col("spearman") > 0) / F.count("*")).alias("share_positive")
    )
    return positive.join(describe(rows, "spearman", ["association"]), "association")


def tilt_sensitivity(pairs: DataFrame, minimums: Sequence[int] = (1, 5, 10, 20), seed: int = 20260928, replicates: int = 1000) -> DataFrame:
    """The tilt association at several smallest denominators."""
    total = pairs.agg(F.count("*").alias("all_pairs")).withColumn("_k", F.lit(0))
    enough = lambda m: (F.col("tilt_denominator_before") >= m) & (F.col("tilt_denominator_after") >= m)
    marked = pairs.where("xg_change is not null").withColumn(
        "minimum", F.explode(F.filter(F.array(*[F.lit(m) for m in minimums]), enough))
    )
    sizes = marked.groupBy("minimum").agg(F.count("*").alias("pairs")).withColumn("_k", F.lit(0)).join(total, "_k")
    spread = describe(marked, "tilt_change", ["minimum"])
    links = [
        spearman_cluster_interval(marked, "tilt_change", y, by=["minimum"], seed=seed + k, replicates=replicates).select(
            "minimum", F.col("spearman").alias(name), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high")
        )
        for k, (name, y) in enumerate((("tilt_vs_shots", "shots_change"), ("tilt_vs_xg", "xg_change")))
    ]
    return (
        sizes.select("minimum", "pairs", (F.col("pairs") / F.col("all_pairs")).alias("share_of_all_pairs"))
        .join(spread, "minimum").join(links[0], "minimum").join(links[1], "minimum")
    )


def counterexamples(pairs: DataFrame) -> DataFrame:
    """Counts of the strongest entry changes with the opposite outcome."""
    cuts = quantiles(pairs, "entries_change", {"top_cut": 0.9, "bottom_cut": 0.1}).withColumn("_k", F.lit(0))
    rows = pairs.withColumn("_k", F.lit(0)).join(F.broadcast(cuts), "_k")
    top, bottom = F.col("entries_change") >= F.col("top_cut"), F.col("entries_change") <= F.col("bottom_cut")
    return rows.groupBy("top_cut", "bottom_cut").agg(
        F.count_if(top).alias("top_pairs"),
        F.count_if(top & (F.col("shots_after") == 0)).alias("top_no_shot_after"),
        F.count_if(top & (F.col("shots_change") < 0)).alias("top_fewer_shots_after"),
        F.count_if(bottom).alias("bottom_pairs"),
        F.count_if(bottom & (F.col("shots_change") > 0)).alias("bottom_more_shots_after"),
    )


def counterexample_rows(pairs: DataFrame, size: int = 6, most_shots: int = 0) -> DataFrame:
    """The largest entry windows of the top decile with no (or few) shots: a ranked short list."""
    cuts = quantiles(pairs, "entries_change", {"top_cut": 0.9}).withColumn("_k", F.lit(0))
    rows = pairs.withColumn("_k", F.lit(0)).join(F.broadcast(cuts), "_k").where(
        (F.col("entries_change") >= F.col("top_cut")) & (F.col("shots_after") <= most_shots)
    )
    return rows.orderBy(F.col("entries_after").desc(), "match_id", "team_id", "period", "window_index").limit(size).drop("_k", "top_cut")


def coverage(windows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Corpus counts, one row per season and one for everything."""
    done = F.col("complete")
    totals = lambda key: (
        windows.groupBy(key.alias("competition_id")).agg(
            F.count_if(done).alias("complete_windows"), F.count_if(~done).alias("incomplete_windows"),
            F.count_if(done & (F.col("match_events") == 0)).alias("empty_windows"),
            F.sum("shots").alias("shots"), F.sum(F.when(~done, F.col("shots")).otherwise(0)).alias("shots_in_incomplete"),
            F.sum("shots_missing_xg").alias("shots_missing_xg"), F.count_if(F.col("xg").isNull()).alias("windows_missing_xg"),
        )
    )
    linked = lambda key: pairs.groupBy(key.alias("competition_id")).agg(
        F.count("*").alias("pairs"), F.count_if("goal_free").alias("pairs_goal_free")
    )
    every, own = F.lit(-1), F.col("competition_id")
    return totals(own).unionByName(totals(every)).join(linked(own).unionByName(linked(every)), "competition_id", "left")


def distributions(windows: DataFrame, minimums: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Spread of each window measure over complete windows."""
    rows = windows.where("complete").select(
        "entries", "shots", F.coalesce("xg", F.lit(0)).alias("xg"),
        (F.col("tilt_passes") + F.col("opponent_tilt_passes")).alias("tilt_denominator"),
    )
    names = ["entries", "shots", "xg", "tilt_denominator"]
    long = rows.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("decimal(28,12)").alias("v")) for n in names]))
    )
    zero = long.groupBy("measure").agg(
        (F.count_if(F.col("v") == 0) / F.count("*")).alias("share_zero"),
        *[(F.count_if(F.col("v") < m) / F.count("*")).alias(f"share_below_{m}") for m in minimums],
    )
    return describe(long, "v", ["measure"]).join(zero, "measure")


def comparisons(excess: DataFrame, attributed: DataFrame, states: DataFrame) -> DataFrame:
    """Earlier-window excess with attributed xG and the score state before the window."""
    key = ["match_id", "team_id", "period", "window_index"]
    xg = attributed.select(*key, F.col("xg").alias("_a"))
    return excess.join(xg, key, "left").join(states, key).withColumn(
        "attributed_xg", F.coalesce("_a", F.lit(0).cast("decimal(28,12)"))
    ).drop("_a")


def excess_bins(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    mean = lambda c, name: F.avg(_exact(c)).cast("double").alias(name)
    keyed = rows.withColumn("entry_excess", F.round("entry_excess", 9))
    found = binned(keyed, "entry_excess", by)
    distinct = found.groupBy(*by, "bin", "match_id").agg(F.lit(1).alias("_one")).groupBy(*by, "bin").agg(F.count("*").alias("matches"))
    return found.groupBy(*by, "bin").agg(
        F.min("entry_excess").alias("lowest"), F.max("entry_excess").alias("highest"), F.count("*").alias("windows"),
        mean("entry_excess", "mean_entry_excess"), mean("shot_excess", "mean_shot_excess"), mean("xg_excess", "mean_xg_excess"),
        (F.count_if(F.col("shots") == 0) / F.count("*")).alias("no_shot_share"),
        ratio(F.sum(_exact("xg")), F.sum("entries")).alias("all_xg_per_entry"),
        ratio(F.sum(_exact("attributed_xg")), F.sum("entries")).alias("attributed_xg_per_entry"),
    ).join(distinct, [*by, "bin"])


def excess_associations(rows: DataFrame, seed: int = 20260928, replicates: int = 1000) -> DataFrame:
    """Entry excess against shot excess: overall, per score state before, and goal-free."""
    labels = F.array_compact(
        F.array(
            F.lit("overall"), F.col("state"),
            F.when(F.col("goals_for") + F.col("goals_against") == 0, F.lit("goal_free")),
        )
    )
    keyed = rows.withColumns({"entry_excess": F.round("entry_excess", 9), "shot_excess": F.round("shot_excess", 9)})
    return spearman_cluster_interval(
        keyed.withColumn("part", F.explode(labels)), "entry_excess", "shot_excess", by=["part"], seed=seed, replicates=replicates
    )
