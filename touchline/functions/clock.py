"""Match clocks. Order is always ``sequence``; clocks only measure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.functions.pitch import col

# Continuous-clock minute at which each period starts.
PERIOD_START_MINUTES = {1: 0, 2: 45, 3: 90, 4: 105, 5: 120}
SHOOTOUT_PERIOD = 5


def elapsed_seconds(minute="minute", second="second") -> Column:
    return (col(minute) * 60 + col(second)).cast("int")


def clock_problem(period="period", minute="minute", second="second") -> Column:
    """Why a match clock is unusable, or NULL."""
    return (
        F.when(F.coalesce(col(period) < 1, F.lit(True)), "period must be at least 1")
        .when(F.coalesce(col(minute) < 0, F.lit(True)), "minute must not be negative")
        .when(F.coalesce(~col(second).between(0, 59), F.lit(True)), "second must be in [0, 60)")
    )


def timestamp_seconds(value) -> Column:
    """``HH:MM:SS[.mmm]`` to DECIMAL(8,3) seconds; NULL when it has another shape."""
    pattern = r"^(\d+):(\d+):(\d+)(?:\.(\d{0,3}))?$"
    part = lambda i: F.regexp_extract(col(value), pattern, i)
    whole = (
        part(1).try_cast("bigint") * 3600 + part(2).try_cast("bigint") * 60 + part(3).try_cast("bigint")
    )
    millis = F.rpad(part(4), 3, "0").try_cast("bigint")
    return F.when(
        col(value).rlike(pattern), (whole + millis / F.lit(1000).cast("decimal(5,0)"))
    ).try_cast("decimal(8,3)")


def period_start_seconds(period) -> Column:
    result = F.lit(None).cast("int")
    for number, minutes in sorted(PERIOD_START_MINUTES.items(), reverse=True):
        result = F.when(col(period) == number, F.lit(minutes * 60)).otherwise(result)
    return result


def continuous_clock_to_period_seconds(clock, period) -> Column:
    """``MM:SS`` on the running match clock to seconds of the period; NULL when invalid."""
    pattern = r"^(\d+):(\d+)$"
    minutes = F.regexp_extract(col(clock), pattern, 1).try_cast("int")
    seconds = F.regexp_extract(col(clock), pattern, 2).try_cast("int")
    value = minutes * 60 + seconds - period_start_seconds(period)
    return F.when(col(clock).rlike(pattern) & (seconds < 60) & (value >= 0), value)


def clock_text(minute="minute", second="second") -> Column:
    return F.concat(
        F.lpad(col(minute).cast("string"), F.greatest(F.length(col(minute).cast("string")), F.lit(2)), F.lit("0")),
        F.lit(":"),
        F.lpad(col(second).cast("string"), 2, "0"),
    )
