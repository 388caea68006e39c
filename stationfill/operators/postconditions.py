"""Post-conditions of a finished product. Each returns the violating rows; an empty result is a pass.

`states` are cell states (see provenance.cell_states) whose source and final come from the product under test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationfill.functions.expressions import close_to, is_finite
from stationfill.functions.rules import DIRECTION, LOG_COLUMNS, RULES, SPEED
from stationfill.operators.provenance import allowed
from stationfill.operators.reports import imputed

CELL = ["station", "variable", "ts"]


class PostconditionError(ValueError):
    """The product breaks post-conditions; the message lists them with their counts."""


def output_key_violations(wide: DataFrame) -> DataFrame:
    """Keys that are incomplete or not unique."""
    keys = wide.groupBy("ESTACION", "FECHA", "HORA").agg(F.count(F.lit(1)).alias("n_rows"))
    return keys.filter("n_rows > 1 OR ESTACION IS NULL OR FECHA IS NULL OR HORA IS NULL")


def log_integrity(log: DataFrame) -> DataFrame:
    """Log rows whose hours don't match their count, or whose acceptance doesn't."""
    listed = F.when(F.coalesce(F.col("imputed_timestamps"), F.lit("")) == "", 0).otherwise(F.size(F.split("imputed_timestamps", r"\|")))
    return log.filter((listed != F.col("n_values_imputed")) | (F.col("accepted") != (F.col("n_values_imputed") > 0)))


def missing_log_columns(log: DataFrame) -> list[str]:
    return [c for c in LOG_COLUMNS if c not in log.columns]


def original_changes(states: DataFrame) -> DataFrame:
    """Observed analytic values that the product has changed."""
    return states.filter(F.col("value").isNotNull() & (F.col("variable") != DIRECTION) & ~F.coalesce(close_to(F.col("final"), F.col("value")), F.lit(False)))


def unlogged_or_phantom_fills(states: DataFrame, contributions: DataFrame) -> DataFrame:
    """Cells filled but not in the log (unlogged), or in the log but not filled (phantom)."""
    filled = states.filter("value is null and after is not null").select(*CELL, F.lit(True).alias("filled"))
    logged = contributions.select(*CELL).distinct().withColumn("logged", F.lit(True))
    both = filled.join(logged, CELL, "full")
    return both.filter("filled is null or logged is null").select(*CELL, F.when(F.col("logged").isNull(), "unlogged").otherwise("phantom").alias("fault"))


def structural_fills(states: DataFrame) -> DataFrame:
    return states.filter("value is null and after is not null and not eligible")


def range_violations(states: DataFrame) -> DataFrame:
    """Values after filling that are not finite or not plausible."""
    good = reduce(lambda rest, v: F.when(F.col("variable") == v, F.col("after").between(*RULES[v][2:])).otherwise(rest), RULES, F.lit(False))
    return states.filter(F.col("after").isNotNull() & ~(is_finite(F.col("after")) & good))


def outlier_preservation(states: DataFrame) -> DataFrame:
    """Outliers that are eligible, not kept as they were, or said to be imputed."""
    kept = F.coalesce((F.col("final") == F.col("raw")) | ~F.col("is_applicable"), F.lit(False))
    return states.filter(F.col("outlier") & (F.col("eligible") | ~kept | imputed()))


def source_vocabulary(states: DataFrame) -> DataFrame:
    return states.join(F.broadcast(allowed(states.sparkSession)), ["variable", "source"], "left_anti")


def source_value_coherence(states: DataFrame) -> DataFrame:
    """A missing source with a value, an observed or imputed one without, or `not_applicable` for anything but a direction."""
    there = F.col("final").isNotNull()
    named = imputed() | F.col("source").isin("senamhi_observed", "senamhi_operational_outlier")
    return states.filter((F.col("source").startswith("missing_") & there) | (named & ~there) | ((F.col("source") == "not_applicable") & (F.col("variable") != DIRECTION)))


def calm_coherence(states: DataFrame) -> DataFrame:
    """Hours where the direction is `not_applicable` without calm, calm without it, or has a value in a calm."""
    pick = lambda v, c, name: F.max(F.when(F.col("variable") == v, F.col(c))).alias(name)
    hours = states.filter(F.col("variable").isin(DIRECTION, SPEED)).groupBy("station", "ts").agg(
        pick(DIRECTION, "source", "direction_source"), pick(DIRECTION, "final", "direction"), pick(SPEED, "final", "speed"))
    calm, said = F.coalesce(F.col("speed") == 0, F.lit(False)), F.col("direction_source") == "not_applicable"
    return hours.filter((calm != said) | (calm & F.col("direction").isNotNull()))


def external_range(rows: DataFrame, column: str = "PP_IFS") -> DataFrame:
    return rows.filter(F.col(column).isNotNull() & ~(is_finite(F.col(column)) & F.col(column).between(*RULES["PP"][2:])))


def canonical_direction(states: DataFrame) -> DataFrame:
    """Generated directions outside [0, 360)."""
    return states.filter((F.col("variable") == DIRECTION) & imputed() & ~((F.col("final") >= 0) & (F.col("final") < 360)))


def postconditions(states: DataFrame, wide: DataFrame, contributions: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """(rule, n_violations) of all rules on one product; with its log also the rules on that."""
    found = {
        "output_keys": output_key_violations(wide), "original_changes": original_changes(states), "fills_logged": unlogged_or_phantom_fills(states, contributions),
        "structural_fills": structural_fills(states), "ranges": range_violations(states), "outliers_kept": outlier_preservation(states),
        "vocabulary": source_vocabulary(states), "coherence": source_value_coherence(states), "calm": calm_coherence(states), "directions": canonical_direction(states),
    }
    if log is not None:
        missing = missing_log_columns(log)
        if missing:
            raise PostconditionError(f"the log lacks {', '.join(missing)}")
        found["log"] = log_integrity(log)
    return reduce(DataFrame.unionByName, [x.agg(F.lit(k).alias("rule"), F.count(F.lit(1)).alias("n_violations")) for k, x in found.items()])


def assert_postconditions(states: DataFrame, wide: DataFrame, contributions: DataFrame, log: DataFrame | None = None) -> None:
    broken = postconditions(states, wide, contributions, log).filter("n_violations > 0").collect()
    if broken:
        raise PostconditionError("; ".join(f"{r['rule']}: {r['n_violations']}" for r in broken))
