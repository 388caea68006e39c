"""Wind as a vector: gaps and fills of both fields together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationfill.functions.expressions import direction_of, numerical_calm, speed_of, valid_wind, wind_u, wind_v
from stationfill.functions.rules import DIRECTION, SPEED
from stationfill.operators.fill import linear, weeks
from stationfill.operators.gaps import beside, with_runs

#: The series name of vector rows.
VECTOR = "VIENTO_VECTOR"


def vectors(cells: DataFrame) -> DataFrame:
    """One row for each station and hour: direction and speed fit for analysis, eligible, u and v (null unless both are known)."""
    pick = lambda v, c: F.max(F.when(F.col("variable") == v, F.col(c))).alias(f"{v}_{c}")
    wide = cells.filter(F.col("variable").isin(DIRECTION, SPEED)).groupBy("station", "ts").agg(pick(DIRECTION, "value"), pick(SPEED, "value"), F.min("eligible").alias("eligible"))
    direction, speed = F.col(f"{DIRECTION}_value"), F.col(f"{SPEED}_value")
    known = (speed == 0) | (direction.isNotNull() & speed.isNotNull())
    return wide.select("station", F.lit(VECTOR).alias("variable"), "ts", direction.alias("direction"), speed.alias("speed"), "eligible",
        F.when(known, wind_u(direction, speed)).alias("u"), F.when(known, wind_v(direction, speed)).alias("v"))


def with_wind_gaps(vector: DataFrame, piece_hours: int | None = None) -> DataFrame:
    """Runs of eligible hours without a whole vector, with the vectors next to them."""
    runs = with_runs(vector, (F.col("u").isNull() | F.col("v").isNull()) & F.col("eligible"), ("u", "v"), piece_hours)
    whole = F.col("left_u").isNotNull() & F.col("right_u").isNotNull()
    return runs.withColumn("anchored", F.col("is_gap") & whole)


def conflict(u: Column, v: Column) -> Column:
    """A calm candidate where one field was observed that says the wind blew."""
    one = (F.col("direction").isNotNull() & F.col("speed").isNull()) | ((F.col("speed") > 0) & F.col("direction").isNull())
    return valid_wind(u, v) & numerical_calm(F.hypot(u, v)) & F.coalesce(one, F.lit(False))


def candidates(vector: DataFrame, short_gap_hours: int = 4, n_weeks: int = 2, min_donors: int = 3, piece_hours: int | None = None) -> DataFrame:
    """Gap hours with short_u/short_v (linear between whole vectors) and weekly_u/weekly_v (mean of whole donors)."""
    runs = beside(with_wind_gaps(vector, piece_hours), ("u", "v"), weeks(n_weeks), piece_hours)
    short = F.col("anchored") & (F.col("n_steps") <= short_gap_hours)
    for c in ("u", "v"):
        runs = runs.withColumn(f"short_{c}", F.when(short, linear(F.col(f"left_{c}"), F.col(f"right_{c}"))))
        runs = runs.withColumn(f"donors_{c}", F.filter(f"donors_{c}", lambda x: x.isNotNull()))
    for c in ("u", "v"):
        mean = F.aggregate(f"donors_{c}", F.lit(0.0), lambda a, x: a + x) / F.size(f"donors_{c}")
        runs = runs.withColumn(f"weekly_{c}", F.when(F.col("is_gap") & (F.size(f"donors_{c}") >= min_donors), mean))
    return runs.withColumn("n_donors", F.size("donors_u")).drop("donors_u", "donors_v")


def merge(runs: DataFrame, sources: list[tuple[str, str]]) -> DataFrame:
    """after_u, after_v and method from the first candidate (method, column prefix) that is valid and in no conflict; n_conflicts counts the conflicts met on the way."""
    u, v, method, conflicts = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(0)
    for name, prefix in reversed(sources):
        a, b = F.col(f"{prefix}_u"), F.col(f"{prefix}_v")
        clash = F.coalesce(conflict(a, b), F.lit(False))
        good = F.coalesce(valid_wind(a, b), F.lit(False)) & ~clash
        u, v, method = F.when(good, a).otherwise(u), F.when(good, b).otherwise(v), F.when(good, name).otherwise(method)
        conflicts = F.when(good, F.lit(0)).otherwise(conflicts + clash.cast("int"))
    gap = F.col("is_gap")
    return runs.withColumns({"after_u": F.when(gap, u).otherwise(F.col("u")), "after_v": F.when(gap, v).otherwise(F.col("v")), "method": F.when(gap, method), "n_conflicts": F.when(gap, conflicts).otherwise(0)})


def compose_fields(merged: DataFrame) -> DataFrame:
    """direction_after, speed_after and which of them the vector wrote: an observed field is never replaced.

    A calm candidate gives no direction, and no speed against an observed direction.
    """
    filled = F.col("method").isNotNull()
    u, v = F.col("after_u"), F.col("after_v")
    calm = numerical_calm(F.hypot(u, v))
    wrote_speed = filled & F.col("speed").isNull() & ~(F.col("direction").isNotNull() & calm)
    wrote_direction = filled & F.col("direction").isNull() & ~calm
    return merged.withColumns({
        "wrote_speed": wrote_speed, "wrote_direction": wrote_direction,
        "speed_after": F.when(wrote_speed, speed_of(u, v)).otherwise(F.col("speed")),
        "direction_after": F.when(wrote_direction, direction_of(u, v)).otherwise(F.col("direction")),
    })


def fill_wind_temporal(cells: DataFrame, **policy) -> DataFrame:
    return compose_fields(merge(candidates(vectors(cells), **policy), [("short_vector_linear", "short"), ("weekly_vector_seasonal", "weekly")]))


def cross_year_vectors(vector: DataFrame, wanted: DataFrame) -> DataFrame:
    """(station, ts, year_u, year_v): the whole vector one year later, or else earlier."""
    known = vector.filter("u is not null and v is not null").select("station", F.col("ts").alias("_ts"), F.struct("u", "v").alias("w"))
    wanted = wanted.select("station", "ts")
    year = F.expr("INTERVAL 1 YEAR")
    for name, shifted in (("_after", F.col("ts") + year), ("_before", F.col("ts") - year)):
        wanted = wanted.withColumn("_ts", shifted).join(known.withColumnRenamed("w", name), ["station", "_ts"], "left").drop("_ts")
    best = F.coalesce("_after", "_before")
    return wanted.select("station", "ts", best["u"].alias("year_u"), best["v"].alias("year_v")).filter("year_u is not null")
