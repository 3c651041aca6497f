"""Expected threat: training counts, the fitted grid, valued moves, and ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import pitch
from touchline.functions.prefix import Running, running, with_value_blocks
from touchline.operators.grid import count
from touchline.session import cut_lineage
from touchline.operators.stats import medians

COLUMNS, ROWS = 16, 12


def _candidates(context: DataFrame, matches: DataFrame, before_date) -> DataFrame:
    rows = context.where(
        F.col("period").between(1, 4)
        & F.coalesce("open_play", F.lit(False))
        & F.col("event_type").isin("shot", "pass", "carry")
    )
    if before_date is None:
        return rows
    dated = matches.where(F.col("match_date") < F.lit(before_date).cast("date")).select("match_id")
    return rows.join(dated, "match_id", "left_semi")


def _eligible(rows: DataFrame, columns: int, grid_rows: int) -> DataFrame:
    usable = pitch.on_pitch("x", "y") & (
        (F.col("event_type") == "shot") | pitch.on_pitch("end_x", "end_y")
    )
    return rows.where(usable).withColumns(
        {
            "start_cell": pitch.grid_cell("x", "y", columns, grid_rows),
            "end_cell": pitch.grid_cell("end_x", "end_y", columns, grid_rows),
        }
    )


def _move() -> Column:
    return F.col("event_type").isin("pass", "carry")


def threat_training_counts(
    context, matches, before_date=None, columns=COLUMNS, rows=ROWS
) -> DataFrame:
    shot = F.col("event_type") == "shot"
    return (
        _eligible(_candidates(context, matches, before_date), columns, rows)
        .groupBy(F.col("start_cell").alias("cell"))
        .agg(
            count(shot).alias("shots"),
            count(shot & F.col("scores_goal")).alias("goals"),
            count(_move()).alias("move_attempts"),
        )
    )


def threat_transitions(context, matches, before_date=None, columns=COLUMNS, rows=ROWS) -> DataFrame:
    return (
        _eligible(_candidates(context, matches, before_date), columns, rows)
        .where(_move() & F.col("completed"))
        .groupBy("start_cell", "end_cell")
        .agg(F.count("*").alias("completed_moves"))
    )


def threat_exclusions(context, matches, before_date=None) -> DataFrame:
    """Candidates that drop out because a coordinate is off the pitch."""
    shot = F.col("event_type") == "shot"
    start, end = pitch.on_pitch("x", "y"), pitch.on_pitch("end_x", "end_y")
    return _candidates(context, matches, before_date).agg(
        count(shot).alias("candidate_shots"),
        (count(shot) - count(shot & start)).alias("excluded_shots"),
        count(_move()).alias("candidate_moves"),
        (count(_move()) - count(_move() & start & end)).alias("excluded_moves"),
    )


def threat_model(counts: DataFrame, transitions: DataFrame, cells: int) -> DataFrame:
    """One row per grid cell: reward, arcs to end cells, and why its counts are unusable."""
    per_cell = counts.groupBy("cell").agg(
        F.count("*").alias("rows"), F.max("shots").alias("shots"), F.max("goals").alias("goals"),
        F.max("move_attempts").alias("moves"),
    )
    # One entry per pair of cells, so at most ``cells`` entries here.
    arcs = (
        transitions.groupBy(F.col("start_cell").alias("cell"), "end_cell")
        .agg(F.sum("completed_moves").alias("n"), F.min("completed_moves").alias("least"))
        .groupBy("cell")
        .agg(
            F.sort_array(F.collect_list(F.struct("end_cell", "n"))).alias("arcs"),
            F.sum("n").alias("moved"), F.min("least").alias("least"),
            F.min("end_cell").alias("low"), F.max("end_cell").alias("high"),
        )
    )
    grid = counts.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell"))
    joined = grid.join(per_cell, "cell", "full").join(arcs, "cell", "full")
    reason = (
        F.when(~F.col("cell").between(0, cells - 1), "a cell is outside the grid")
        .when(F.col("rows") > 1, "a cell is counted twice")
        .when((F.col("shots") < 0) | (F.col("moves") < 0), "a count is negative")
        .when(~F.col("goals").between(0, F.col("shots")), "goals are outside shots")
        .when((F.col("least") < 0) | (F.col("low") < 0) | (F.col("high") >= cells), "a transition is invalid")
        .when(F.col("moved") > F.coalesce("moves", F.lit(0)), "completed transitions exceed attempted moves")
    )
    total = F.nullif(F.coalesce(F.col("shots") + F.col("moves"), F.lit(0)).cast("double"), F.lit(0.0))
    steps = F.transform("arcs", lambda a: F.struct(a["end_cell"].alias("to"), (a["n"] / F.col("_total")).alias("p")))
    return joined.withColumn("_total", total).select(
        "cell",
        F.coalesce(F.col("goals") / F.col("_total"), F.lit(0.0)).alias("reward"),
        F.coalesce(steps, F.array().cast("array<struct<to:int,p:double>>")).alias("arcs"),
        reason.alias("reason"),
    )


def fit_threat(
    counts: DataFrame,
    transitions: DataFrame,
    *,
    columns: int = COLUMNS,
    rows: int = ROWS,
    tolerance: float = 1e-8,
    maximum_iterations: int = 500,
) -> DataFrame:
    """Value per cell: goal reward plus the value of where successful moves lead.

    The work that grows with the data is the two count tables. The solver only sees the
    grid, whose size is a setting (at most ``cells`` cells and ``cells`` squared pairs), so
    it runs as one expression over one row; bad counts or no convergence raise there.
    """
    cells = columns * rows
    if columns < 1 or rows < 1 or not 0 < tolerance < 1 or maximum_iterations < 1:
        raise ValueError("invalid grid or solver settings")
    model = threat_model(counts, transitions, cells).agg(
        F.sort_array(F.collect_list(F.struct("cell", "reward", "arcs"))).alias("model"),
        F.max("reason").alias("reason"),
    )

    def update(values: Column) -> Column:
        return F.transform(
            "model",
            lambda c: c["reward"]
            + F.aggregate(c["arcs"], F.lit(0.0), lambda s, a: s + a["p"] * F.get(values, a["to"])),
        )

    def state(values: Column, iterations: Column, residual: Column) -> Column:
        return F.struct(values.alias("values"), iterations.alias("iterations"), residual.alias("residual"))

    def advance(s: Column) -> Column:
        change = lambda new: F.array_max(F.zip_with(new, s["values"], lambda a, b: F.abs(a - b)))
        moved = F.transform(F.array(update(s["values"])), lambda new: state(new, s["iterations"] + 1, change(new)))
        return F.when(s["residual"] <= tolerance, s).otherwise(F.get(moved, F.lit(0)))

    start = state(F.transform("model", lambda c: F.lit(0.0)), F.lit(0), F.lit(1.0))
    rounds = F.expr(f"sequence(1, {int(maximum_iterations)})")
    solved = F.aggregate(rounds, start, lambda s, _: advance(s))
    checked = F.when(F.col("reason").isNotNull(), F.raise_error(F.col("reason")).cast("int")).otherwise(F.lit(0))
    failed = F.when(
        F.col("s.residual") > tolerance, F.raise_error(F.lit("expected-threat grid did not converge")).cast("int")
    ).otherwise(F.lit(0))
    return (
        model.select("model", checked.alias("_ok"))
        .where("_ok = 0")
        .select(solved.alias("s"))
        .select("s", failed.alias("_ok"))
        .where("_ok = 0")
        .select("s.iterations", "s.residual", F.posexplode("s.values").alias("cell", "value"))
        .select("cell", "value", "iterations", "residual")
    )


def _valued(context: DataFrame) -> DataFrame:
    return context.where(
        pitch.is_move() & pitch.on_pitch("x", "y") & pitch.on_pitch("end_x", "end_y")
    )


def value_moves_threat(context: DataFrame, surface: DataFrame, columns=COLUMNS, rows=ROWS) -> DataFrame:
    """Surface value at both ends. The broadcast surface has ``columns * rows`` rows."""
    small = surface.select(F.col("cell"), F.col("value"))
    ends = {"start": ("x", "y"), "end": ("end_x", "end_y")}
    out = _valued(context)
    for name, (x, y) in ends.items():
        side = F.broadcast(small.select(F.col("cell").alias(f"_{name}"), F.col("value").alias(f"{name}_value")))
        out = out.withColumn(f"_{name}", pitch.grid_cell(x, y, columns, rows)).join(side, f"_{name}")
    return out.drop("_start", "_end").withColumn("value_change", F.col("end_value") - F.col("start_value"))


def value_moves_goal_distance(context: DataFrame) -> DataFrame:
    start, end = pitch.goal_closeness("x", "y"), pitch.goal_closeness("end_x", "end_y")
    return _valued(context).withColumns(
        {"start_value": start, "end_value": end, "value_change": end - start}
    )


def future_possession_outcomes(context: DataFrame) -> DataFrame:
    """Does the moving team shoot or score later in the same possession?

    Only the last shot and the last goal of each possession and team are needed.
    """
    key = ["match_id", "possession", "team_id"]
    shot = (F.col("event_type") == "shot") & F.coalesce("open_play", F.lit(False))
    last = context.where(shot).groupBy(*key).agg(
        F.max("sequence").alias("_shot"),
        F.max(F.when(F.col("scores_goal"), F.col("sequence"))).alias("_goal"),
    )
    moves = context.where(pitch.is_move() & pitch.on_pitch("end_x", "end_y") & F.col("possession").isNotNull())
    later = lambda c: F.coalesce(F.col(c) > F.col("sequence"), F.lit(False))
    return moves.join(last, key, "left").withColumns({"shot_later": later("_shot"), "goal_later": later("_goal")}).drop("_shot", "_goal")


def auc(scored: DataFrame, score: str, target: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mann-Whitney area with average ranks for ties, overall or per ``by``; NULL with one class.

    Rows shrink to one per distinct score first. Those are scanned in blocks cut at their own quantiles, so the
    overall case does not pull every score through one task.
    """
    groups = list(by) or ["_all"]
    rows = scored if by else scored.withColumn("_all", F.lit(0))
    tied = cut_lineage(
        rows.groupBy(*groups, F.col(score).alias("_s")).agg(F.count_if(F.col(target)).alias("_pos"), F.count("*").alias("_n"))
    )
    below = running(with_value_blocks(tied, groups, "_s"), groups, ["_s"], F.col("_cut"), [Running("_upto", "sum", F.col("_n"))])
    # Average rank of the tie group: rows below it plus (size + 1) / 2.
    rank2 = 2 * (F.col("_upto") - F.col("_n")) + F.col("_n") + 1
    sums = below.groupBy(*groups).agg(
        F.sum(F.col("_pos") * rank2.cast("decimal(20,0)")).alias("_ranks2"),
        F.sum("_pos").alias("positives"),
        F.sum(F.col("_n") - F.col("_pos")).alias("negatives"),
    )
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    area = (F.col("_ranks2").cast("double") / 2 - p * (p + 1) / 2) / F.nullif(p * n, F.lit(0.0))
    return sums.select(*by, "positives", "negatives", area.alias("auc"))


def auc_by_match(scored: DataFrame, first: str, second: str, target: str) -> DataFrame:
    """Per-match difference of two scores' areas; matches with one class are skipped."""
    a = auc(scored, first, target, ("match_id",)).select("match_id", F.col("auc").alias("_a"))
    b = auc(scored, second, target, ("match_id",)).select("match_id", F.col("auc").alias("_b"))
    gap = F.round(F.col("_a") - F.col("_b"), 9)
    gaps = a.join(b, "match_id").where("_a is not null and _b is not null").select(gap.alias("gap"))
    counts = gaps.agg(
        F.count("*").alias("evaluable_matches"),
        F.count_if(F.col("gap") > 0).alias("first_better"),
        F.count_if(F.col("gap") < 0).alias("second_better"),
        F.count_if(F.col("gap") == 0).alias("tied"),
        F.lit(0).alias("_k"),
    )
    middle = medians(gaps, "gap").select(F.lit(0).alias("_k"), F.col("median").alias("median_difference"))
    return counts.join(middle, "_k", "left").drop("_k")
