"""Pitch geometry as column expressions. 120 x 80, the acting team attacks toward +x."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch size, third lines, channel lines, penalty area, goal centre.
LENGTH, WIDTH = 120.0, 80.0
MIDDLE_THIRD_X, FINAL_THIRD_X = 40.0, 80.0
LEFT_CHANNEL_Y, RIGHT_CHANNEL_Y = 80.0 / 3, 160.0 / 3
BOX_X, BOX_LOW_Y, BOX_HIGH_Y = 102.0, 18.0, 62.0
GOAL_X, GOAL_Y = 120.0, 40.0
CHANNELS = ("left", "center", "right")


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def third(x) -> Column:
    x = col(x)
    return (
        F.when(x < MIDDLE_THIRD_X, "defensive")
        .when(x < FINAL_THIRD_X, "middle")
        .when(x >= FINAL_THIRD_X, "final")
    )


def channel(y) -> Column:
    y = col(y)
    return (
        F.when(y < LEFT_CHANNEL_Y, "left")
        .when(y > RIGHT_CHANNEL_Y, "right")
        .when(y.isNotNull(), "center")
    )


def zone(value, width: int, last: int) -> Column:
    return F.least(F.greatest(F.floor(col(value) / width), F.lit(0)), F.lit(last)).cast("int")


def in_box(x, y) -> Column:
    return (col(x) >= BOX_X) & col(y).between(BOX_LOW_Y, BOX_HIGH_Y)


def on_pitch(x, y) -> Column:
    return col(x).between(0, LENGTH) & col(y).between(0, WIDTH)


def goal_distance(x, y) -> Column:
    """Distance to the centre of the goal attacked; NULL off the pitch."""
    return F.when(on_pitch(x, y), F.hypot(F.lit(GOAL_X) - col(x), F.lit(GOAL_Y) - col(y)))


def goal_angle(x, y) -> Column:
    """Unsigned angle to the centre of the goal attacked; NULL off the pitch."""
    return F.when(
        on_pitch(x, y), F.atan2(F.abs(F.lit(GOAL_Y) - col(y)), F.lit(GOAL_X) - col(x))
    )


def goal_closeness(x, y) -> Column:
    """1 at the goal centre down to 0 at the farthest corner."""
    return 1 - goal_distance(x, y) / F.hypot(F.lit(LENGTH), F.lit(WIDTH / 2))


def grid_cell(x, y, columns: int = 16, rows: int = 12) -> Column:
    """Flat cell id of a grid over the pitch; the far edges belong to the last cells."""
    i = F.least(F.floor(col(x) / LENGTH * columns), F.lit(columns - 1))
    j = F.least(F.floor(col(y) / WIDTH * rows), F.lit(rows - 1))
    return F.when(on_pitch(x, y), (i + columns * j).cast("int"))


def is_move() -> Column:
    """A completed open-play pass or carry."""
    return (
        F.col("event_type").isin("pass", "carry")
        & F.coalesce(F.col("completed"), F.lit(False))
        & F.coalesce(F.col("open_play"), F.lit(False))
    )


def is_final_third_entry() -> Column:
    return F.coalesce(
        is_move() & (F.col("x") < FINAL_THIRD_X) & (F.col("end_x") >= FINAL_THIRD_X), F.lit(False)
    )


def is_box_entry() -> Column:
    return F.coalesce(
        is_move() & ~F.coalesce(in_box("x", "y"), F.lit(False)) & in_box("end_x", "end_y"),
        F.lit(False),
    )
