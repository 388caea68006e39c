"""Classification of cells: hard-invalid, outlier, analytic value, observed span, eligibility for filling.

A cell is (station, variable, ts). Spans are an aggregate, a row a series, and are joined to the cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationfill.functions.expressions import hard_invalid, operational_outlier
from stationfill.functions.rules import DIRECTION, SPEED
from stationfill.operators.grid import to_long


def analytic_value(variable: str, columns: list[str]) -> Column:
    """The value fit for analysis: null where it can't be or is implausible; north is 0, and calm has no direction."""
    raw = F.col(variable)
    value = F.when(~hard_invalid(raw, variable) & ~operational_outlier(raw, variable), raw)
    if variable == DIRECTION and SPEED in columns:
        calm = F.coalesce(analytic_value(SPEED, columns) == 0, F.lit(False))
        return F.when(~calm, F.when(value == 360, F.lit(0.0)).otherwise(value))
    return value


def classify(wide: DataFrame, variables: list[str]) -> DataFrame:
    """Cells with raw, hard, outlier, value; seen (does the cell open or close its span) and excluded (never filled).

    For wind the pair decides: calm or both fields are seen, and an outlier in either field excludes the hour.
    """
    has_wind = DIRECTION in variables and SPEED in variables
    fields = {}
    for v in variables:
        raw, value = F.col(v), analytic_value(v, variables)
        own = {"raw": raw, "hard": hard_invalid(raw, v), "outlier": operational_outlier(raw, v), "value": value, "seen": value.isNotNull(), "excluded": operational_outlier(raw, v)}
        if has_wind and v in (DIRECTION, SPEED):
            speed, direction = analytic_value(SPEED, variables), analytic_value(DIRECTION, variables)
            own["seen"] = F.coalesce(speed == 0, F.lit(False)) | (speed.isNotNull() & direction.isNotNull())
            own["excluded"] = operational_outlier(F.col(DIRECTION), DIRECTION) | operational_outlier(F.col(SPEED), SPEED)
        fields[v] = own
    return to_long(wide, fields, ["station", "ts", "source_row"])


def observed_span(cells: DataFrame) -> DataFrame:
    """First and last seen hour of each series, null for a series never seen."""
    hour = F.when(F.col("seen"), F.col("ts"))
    return cells.groupBy("station", "variable").agg(F.min(hour).alias("span_start"), F.max(hour).alias("span_end"))


def with_eligibility(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """eligible: within the series' span (see observed_span) and not an outlier. Edges and never-seen series are not."""
    inside = F.coalesce(F.col("ts").between(F.col("span_start"), F.col("span_end")), F.lit(False))
    return cells.join(spans, ["station", "variable"], "left").withColumn("eligible", inside & ~F.col("excluded"))
