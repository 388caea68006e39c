"""Filling of scalar gaps from a series itself. Evidence is always the analytic value, never a filled one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationfill.functions.rules import RULES, SCALARS
from stationfill.operators.gaps import beside, with_runs

WEEK = 168


def in_range(value: Column) -> Column:
    """Whether a value is plausible for the row's variable."""
    return reduce(lambda other, v: F.when(F.col("variable") == v, value.between(*RULES[v][2:])).otherwise(other), SCALARS, F.lit(True))


def step_in_gap() -> Column:
    return F.expr("timestampdiff(HOUR, gap_start, ts)") + 1


def linear(left: Column, right: Column) -> Column:
    return left + (right - left) * step_in_gap() / (F.col("n_steps") + 1)


def with_short_fill(anchored: DataFrame, short_gap_hours: int = 4, zero_for: str | None = "PP") -> DataFrame:
    """short_value and short_method of the hours of short gaps between two anchors.

    Linear in time; for `zero_for` (precipitation) zero where both anchors are zero. A value out of the plausible range is dropped, not clipped.
    """
    short = F.col("is_gap") & (F.col("n_steps") <= short_gap_hours) & F.col("left_value").isNotNull() & F.col("right_value").isNotNull()
    zero = F.lit(zero_for is not None) & F.col("variable").eqNullSafe(F.lit(zero_for)) & (F.col("left_value") == 0) & (F.col("right_value") == 0)
    value = F.when(zero, F.lit(0.0)).otherwise(linear(F.col("left_value"), F.col("right_value")))
    filled = anchored.withColumn("short_value", F.when(short & in_range(value), value))
    return filled.withColumn("short_method", F.when(F.col("short_value").isNotNull(), F.when(zero, "short_zero").otherwise("short_linear")))


def weeks(n_weeks: int) -> list[int]:
    """The same hour 1 to n_weeks weeks before and after, from -n to n; on a dense grid offsets are rows."""
    return [WEEK * k for k in range(-n_weeks, n_weeks + 1) if k]


def weekly_donors(cells: DataFrame, n_weeks: int = 2, column: str = "value", piece_hours: int | None = None) -> DataFrame:
    """donors: the values at the same hour of the weeks around, those that aren't there as nulls."""
    return beside(cells, (column,), weeks(n_weeks), piece_hours).withColumnRenamed(f"donors_{column}", "donors")


def mean_of_donors(least: int) -> tuple[Column, Column]:
    """Mean of the donors there are, null under `least`, and their number."""
    there = F.filter("donors", lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(there) >= least, total / F.size(there)), F.size(there)


def with_weekly_fill(runs: DataFrame, n_weeks: int = 2, min_donors: int = 3, piece_hours: int | None = None) -> DataFrame:
    """weekly_value and n_donors of every gap hour with enough donors."""
    value, n = mean_of_donors(min_donors)
    donors = weekly_donors(runs, n_weeks, piece_hours=piece_hours).withColumn("weekly_value", F.when(F.col("is_gap"), value))
    kept = F.when(in_range(F.col("weekly_value")), F.col("weekly_value"))
    return donors.withColumn("n_donors", F.when(F.col("weekly_value").isNotNull(), n)).withColumn("weekly_value", kept).drop("donors")


def cross_year_values(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """(station, variable, ts, year_value): for wanted hours the value one calendar year later, or else earlier.

    An equi-join on shifted hours, since leap years make row offsets wrong. Only hours still empty are wanted, so that side is small.
    """
    known = cells.filter("value is not null")
    keys = ["station", "variable", "ts"]
    wanted = wanted.select(*keys)
    after = known.select("station", "variable", F.col("ts").alias("_ts"), F.col("value").alias("_after"))
    before = known.select("station", "variable", F.col("ts").alias("_ts"), F.col("value").alias("_before"))
    year = F.expr("INTERVAL 1 YEAR")
    for side, shifted in ((after, F.col("ts") + year), (before, F.col("ts") - year)):
        wanted = wanted.withColumn("_ts", shifted).join(side, ["station", "variable", "_ts"], "left").drop("_ts")
    return wanted.select(*keys, F.coalesce("_after", "_before").alias("year_value")).filter("year_value is not null")


def merge_candidates(cells: DataFrame, candidates: list[tuple[str, Column]]) -> DataFrame:
    """after and method: the analytic value, or else the first candidate (method column or name, value) that isn't null."""
    filled = F.coalesce(*[c for _, c in candidates])
    method = reduce(lambda rest, x: F.when(x[1].isNotNull(), F.col(x[0]) if x[0].endswith("_method") else F.lit(x[0])).otherwise(rest), reversed(candidates), F.lit(None).cast("string"))
    gap = F.col("is_gap")
    return cells.withColumn("after", F.when(gap, filled).otherwise(F.col("value"))).withColumn("method", F.when(gap, method))


def own_candidates(cells: DataFrame, short_gap_hours: int = 4, n_weeks: int = 2, min_donors: int = 3, zero_for: str | None = "PP", piece_hours: int | None = None) -> DataFrame:
    """Cells with runs and what short gaps and other weeks offer."""
    return with_weekly_fill(with_short_fill(with_runs(cells, piece_hours=piece_hours), short_gap_hours, zero_for), n_weeks, min_donors, piece_hours)


def fill_temporal(cells: DataFrame, short_gap_hours: int = 4, n_weeks: int = 2, min_donors: int = 3, cross_year: bool = True, zero_for: str | None = "PP", piece_hours: int | None = None) -> DataFrame:
    """Scalar cells with runs, after, method and n_donors: short gaps, then weekly means, then the adjacent year."""
    return merged_temporal(own_candidates(cells, short_gap_hours, n_weeks, min_donors, zero_for, piece_hours), cross_year)


def merged_temporal(runs: DataFrame, cross_year: bool = True) -> DataFrame:
    """own_candidates with after and method; where they offer nothing, the adjacent year is asked."""
    candidates = [("short_method", F.col("short_value")), ("weekly_seasonal", F.col("weekly_value"))]
    if cross_year:
        wanted = runs.filter("is_gap AND short_value IS NULL AND weekly_value IS NULL")
        runs = runs.join(cross_year_values(runs, wanted), ["station", "variable", "ts"], "left")
        candidates.append(("cross_year_analog", F.when(in_range(F.col("year_value")), F.col("year_value"))))
    return merge_candidates(runs, candidates).drop("short_value", "short_method", "weekly_value", "year_value")
