"""Input contract: each check returns the rows (or keys) that break a rule; an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationfill.functions.expressions import is_finite, timestamp_of
from stationfill.functions.rules import DIRECTION, KEYS, METADATA, SPEED, VARIABLES


class ContractError(ValueError):
    """The input breaks the contract; the message lists every broken rule with its count."""


def check_columns(df: DataFrame, expected: list[str] | None = None) -> list[str]:
    """Faults of the column set: missing keys, unknown columns, no or other measurements than expected, half a wind."""
    have = set(df.columns)
    measured = [v for v in VARIABLES if v in have]
    faults = [f"missing key column {k}" for k in KEYS if k not in have]
    faults += [f"unknown column {c}" for c in df.columns if c not in {*KEYS, *METADATA, *VARIABLES}]
    if not measured:
        faults.append("no measurement column")
    if expected is not None and set(expected) != set(measured):
        faults.append(f"measurements {measured} where {sorted(expected)} are expected")
    if (DIRECTION in have) != (SPEED in have):
        faults.append("wind direction and speed must come together")
    return faults


def number(text: str) -> Column:
    """A text column as a double; an empty text is null, and so is garbage (see coerce_numeric)."""
    return F.expr(f"try_cast(nullif(trim({text}), '') AS DOUBLE)")


def coerce_numeric(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with numeric columns, count of garbage values by column)."""
    bad = [F.count_if((F.trim(c) != "") & number(c).isNull()).alias(c) for c in columns]
    wide = df.agg(*bad)
    counts = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_bad")) for c in columns])))
    return df.withColumns({c: number(c) for c in columns}), counts


def coordinate_violations(df: DataFrame) -> DataFrame:
    """Rows without a finite latitude in [-90, 90] and longitude in [-180, 180]."""
    good = is_finite(F.col("LATITUD")) & F.col("LATITUD").between(-90, 90) & is_finite(F.col("LONGITUD")) & F.col("LONGITUD").between(-180, 180)
    return df.filter(~good)


def time_code_violations(df: DataFrame) -> DataFrame:
    """Rows whose FECHA is no date or whose HORA is no whole hour of 0 to 23."""
    day = F.expr("try_to_timestamp(lpad(CAST(CAST(FECHA AS BIGINT) AS STRING), 8, '0'), 'yyyyMMdd')")
    good = F.col("FECHA").isNotNull() & (F.col("FECHA") == F.floor("FECHA")) & day.isNotNull()
    good = good & F.col("HORA").isNotNull() & F.col("HORA").between(0, 230000) & (F.col("HORA") % 10000 == 0)
    return df.filter(~F.coalesce(good, F.lit(False)))


def bad_time_examples(df: DataFrame, n: int = 10) -> DataFrame:
    return time_code_violations(df).select("FECHA", "HORA").distinct().orderBy("FECHA", "HORA").limit(n)


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys of more than one row, with the count. Partial counts go through the shuffle, so one frequent key costs nothing."""
    return df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def station_id_violations(df: DataFrame) -> DataFrame:
    """Rows whose station is null, blank or padded with spaces."""
    return df.filter(F.col("ESTACION").isNull() | (F.trim("ESTACION") == "") | (F.col("ESTACION") != F.trim("ESTACION")))


def metadata_conflicts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ESTACION, column_name, n_values) where a station has several values of what should be constant; null isn't a value."""
    columns = columns or [c for c in METADATA if c in df.columns]
    long = df.select("ESTACION", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])))
    return long.filter("v is not null").groupBy("ESTACION", "column_name").agg(F.count_distinct("v").alias("n_values")).filter("n_values > 1")


def period_span(df: DataFrame, max_days: int = 731) -> DataFrame:
    """One row: first and last hour, whole days between them, and whether the period is too long for a grid."""
    ts = timestamp_of(F.col("FECHA"), F.col("HORA"))
    span = df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    days = F.expr("timestampdiff(DAY, first_ts, last_ts)")
    return span.withColumn("n_days", days.cast("long")).withColumn("too_long", F.coalesce(F.expr("last_ts - first_ts") > F.make_dt_interval(F.lit(max_days)), F.lit(False)))


def violation_counts(df: DataFrame) -> DataFrame:
    """(rule, n) of every row rule over numeric columns, in one plan."""
    checks = {"coordinates": coordinate_violations(df), "time_codes": time_code_violations(df), "station_id": station_id_violations(df), "duplicate_keys": duplicate_keys(df), "metadata": metadata_conflicts(df)}
    return reduce(DataFrame.unionByName, [x.agg(F.lit(k).alias("rule"), F.count(F.lit(1)).alias("n")) for k, x in checks.items()])


def validate_input(df: DataFrame, expected: list[str] | None = None, max_days: int = 731) -> DataFrame:
    """df itself; raises ContractError naming every broken rule."""
    faults = check_columns(df, expected)
    if not faults:
        faults = [f"{r['rule']}: {r['n']}" for r in violation_counts(df).collect() if r["n"]]
        if not any(f.startswith("time_codes") for f in faults) and period_span(df, max_days).first()["too_long"]:
            faults.append(f"the period is longer than {max_days} days")
    if faults:
        raise ContractError("; ".join(faults))
    return df
