"""The hourly grid: every station at every hour of one global period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationfill.functions.expressions import date_code, hour_code, timestamp_of


def with_timestamp(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", timestamp_of(F.col("FECHA"), F.col("HORA")))


def hourly_grid(obs: DataFrame) -> DataFrame:
    """(station, ts) for all stations and all hours from the first to the last of any station.

    The stations are one row each and the period one row, so the product is made by exploding, without a join of facts.
    """
    span = obs.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    hours = F.explode(F.expr("sequence(first_ts, last_ts, INTERVAL 1 HOUR)"))
    return obs.select("station").distinct().join(F.broadcast(span)).filter("first_ts is not null").select("station", hours.alias("ts"))


def reindex_to_grid(obs: DataFrame, grid: DataFrame, dealt: int | None = None) -> DataFrame:
    """obs on the grid: hours without a row get nulls, and source_row tells whether there was a row.

    With `dealt` both sides are dealt by station into so many parts, which all later windows and joins of a station can keep.
    """
    if dealt:
        obs, grid = obs.repartition(dealt, "station"), grid.repartition(dealt, "station")
    return grid.join(obs.withColumn("source_row", F.lit(True)), ["station", "ts"], "left").withColumn("source_row", F.coalesce("source_row", F.lit(False)))


def implicit_row_counts(obs: DataFrame, grid: DataFrame) -> DataFrame:
    missing = grid.join(obs.select("station", "ts"), ["station", "ts"], "left_anti")
    return missing.groupBy("station").agg(F.count(F.lit(1)).alias("n_added"))


def fill_station_metadata(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each station's one known value of its constants on all of its rows; a small aggregate joined back, not a window."""
    known = rows.groupBy("station").agg(*[F.max(c).alias(c) for c in columns])
    return rows.drop(*columns).join(known, "station")


def to_long(wide: DataFrame, fields: dict[str, dict[str, Column]], keep: list[str]) -> DataFrame:
    """A row for each variable with the given fields. Generate keeps the partitioning of its input, where unpivot loses it."""
    structs = [F.struct(F.lit(v).alias("variable"), *[c.alias(k) for k, c in own.items()]) for v, own in fields.items()]
    return wide.select(*keep, F.inline(F.array(*structs)))


def to_long_cells(wide: DataFrame, variables: list[str]) -> DataFrame:
    return to_long(wide, {v: {"raw": F.col(v)} for v in variables}, ["station", "ts", "source_row"])


def to_wide_output(states: DataFrame, variables: list[str]) -> DataFrame:
    """One row for each station and hour: FECHA, HORA, and a value and a source column for each variable."""
    p = states.groupBy("station", "ts").pivot("variable", variables).agg(F.first("final").alias("value"), F.first("source").alias("source"))
    columns = [c for v in variables for c in (F.col(f"{v}_value").alias(v), F.col(f"{v}_source").alias(f"{v}_SOURCE"))]
    return p.select(F.col("station").alias("ESTACION"), date_code(F.col("ts")).alias("FECHA"), hour_code(F.col("ts")).alias("HORA"), *columns)
