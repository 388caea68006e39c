"""The external modelled series: payload checks, normalisation, alignment and attachment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationfill.functions.expressions import is_finite
from stationfill.functions.rules import RULES


def payload_faults(payloads: DataFrame, timezone: str = "America/Lima", unit: str = "mm") -> DataFrame:
    """(station, fault) of payloads without a required field, of another zone or unit, without valid coordinates, or
    whose times are not whole increasing hours as long as the values. One row a payload, so arrays are checked in place.
    """
    times, values = F.col("hourly.time"), F.col("hourly.precipitation")
    parsed = F.transform(times, lambda t: F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz"))
    steps = F.expr("transform(sequence(1, size(_ts) - 1), i -> timestampdiff(MINUTE, _ts[i - 1], _ts[i]))")
    checked = payloads.withColumn("_ts", parsed)
    tests = {
        "missing_field": times.isNull() | values.isNull() | F.col("hourly_units.precipitation").isNull() | F.col("timezone").isNull(),
        "timezone": F.col("timezone") != timezone,
        "unit": F.col("hourly_units.precipitation") != unit,
        "coordinates": ~(is_finite(F.col("latitude")) & F.col("latitude").between(-90, 90) & is_finite(F.col("longitude")) & F.col("longitude").between(-180, 180)),
        "lengths": (F.size(times) != F.size(values)) | (F.size(times) == 0),
        "times": F.exists("_ts", lambda t: t.isNull()) | F.when(F.size("_ts") > 1, F.exists(steps, lambda d: d.isNull() | (d != 60))).otherwise(False),
    }
    faults = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in tests.items()]), lambda x: x.isNotNull())
    return checked.select("station", F.explode(faults).alias("fault"))


def normalize(values: DataFrame, column: str = "value") -> DataFrame:
    """Negative, non-finite or implausible precipitation as null."""
    good = is_finite(F.col(column)) & F.col(column).between(*RULES["PP"][2:])
    return values.withColumn(column, F.when(good, F.col(column)))


def payload_rows(payloads: DataFrame) -> DataFrame:
    """(station, ts, value) of checked payloads, normalised."""
    rows = payloads.select("station", F.inline(F.arrays_zip(F.col("hourly.time").alias("time"), F.col("hourly.precipitation").alias("value"))))
    return normalize(rows.select("station", F.to_timestamp("time", "yyyy-MM-dd'T'HH:mm").cast("timestamp_ntz").alias("ts"), "value"))


def missing_external(grid: DataFrame, external: DataFrame) -> DataFrame:
    """Station hours of the grid that the external series lacks; there must be none."""
    return grid.select("station", "ts").join(external.select("station", "ts"), ["station", "ts"], "left_anti")


def align_external(grid: DataFrame, external: DataFrame) -> DataFrame:
    """The external values on the grid; raises if an hour is missing or repeated."""
    missing = missing_external(grid, external).count()
    repeated = external.groupBy("station", "ts").count().filter("count > 1").count()
    if missing or repeated:
        raise ValueError(f"external series: {missing} station hours are missing, {repeated} are repeated")
    return grid.select("station", "ts").join(external, ["station", "ts"])


def attach_external(rows: DataFrame, external: DataFrame, column: str = "PP_IFS") -> DataFrame:
    """rows with the external value of their station and hour; never evidence for a fill."""
    return rows.join(external.select("station", "ts", F.col("value").alias(column)), ["station", "ts"], "left")
