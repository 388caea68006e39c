"""Reports on cell states: summaries, breakdowns, histograms, profiles. Partial aggregates on few keys throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationfill.functions.expressions import circular_mean
from stationfill.functions.rules import DIRECTION


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))


def imputed(source: str = "source") -> Column:
    return F.col(source).startswith("imputed_")


def execution_summary(states: DataFrame) -> DataFrame:
    """Counts for each series and in total (station and variable TOTAL). Observed and hard-invalid count cells that aren't applicable too."""
    lacking = (F.col("origin_state") == "hard_invalid") | F.col("origin_state").startswith("missing_")
    flags = states.select("station", "variable", "is_applicable", "output_present", "origin_state", imputed().alias("i"), lacking.alias("m"))
    counts = [
        F.count_if("is_applicable").alias("applicable"),
        F.count_if(F.col("origin_state") == "senamhi_observed").alias("observed"),
        F.count_if(F.col("origin_state") == "hard_invalid").alias("hard_invalid"),
        F.count_if(F.col("origin_state") == "operational_outlier").alias("outliers"),
        F.count_if("m").alias("missing_before"),
        F.count_if("i").alias("imputed"),
        F.count_if(F.col("is_applicable") & ~F.col("output_present")).alias("remaining"),
    ]
    sets = flags.groupingSets([["station", "variable"], []], "station", "variable").agg(F.grouping_id().alias("g"), *counts)
    name = lambda c: F.when(F.col("g") > 0, "TOTAL").otherwise(F.col(c)).alias(c)
    return sets.select(name("station"), name("variable"), "applicable", "observed", "hard_invalid", "outliers", "missing_before", "imputed", "remaining",
        percent(F.col("applicable") - F.col("remaining"), F.col("applicable")).alias("coverage_pct"))


def method_breakdown(states: DataFrame) -> DataFrame:
    """Imputed cells of each source with their share, for each series and in total."""
    sets = states.filter(imputed()).groupingSets([["station", "variable", "source"], ["source"]], "station", "variable", "source").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(W.partitionBy("station", "variable", "g"))
    name = lambda c: F.when(F.col("g") > 0, "TOTAL").otherwise(F.col(c)).alias(c)
    return sets.withColumn("pct", 100.0 * F.col("n") / whole).select(name("station"), name("variable"), "source", "n", "pct")


def external_coverage(rows: DataFrame, column: str) -> DataFrame:
    sets = rows.rollup("station").agg(F.grouping("station").alias("g"), F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("available"))
    return sets.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("station")).alias("station"), "n_rows", "available", (F.col("n_rows") - F.col("available")).alias("missing"))


def daily_coverage(states: DataFrame) -> DataFrame:
    """Share of the hours of each day with an analytic value before, and with a value after."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    return states.groupBy("station", "variable", F.to_date("ts").alias("day")).agg(share("value").alias("before"), share("after").alias("after"))


def gap_histogram(gaps: DataFrame, bins: int = 29) -> DataFrame:
    """Gaps of each variable by duration, in bins of equal width of the logarithm from 1 to the longest plus 1."""
    longest = F.max("duration_h").over(W.partitionBy("variable"))
    # the small addend keeps an edge in the bin that it opens
    place = F.floor(F.ln("duration_h") / F.ln(longest + 1) * bins + 1e-9)
    binned = gaps.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    return binned.groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("duration_h").alias("hours"))


def method_totals(states: DataFrame) -> DataFrame:
    return states.filter("method is not null").groupBy("variable", "method").agg(F.count(F.lit(1)).alias("n_imputed")).filter("n_imputed > 0")


def r2_histogram(attempts: DataFrame, bins: int = 10) -> DataFrame:
    """Accepted models by r2 in bins of equal width between the least and the largest; one bin if they are equal."""
    models = attempts.filter("accepted").select("station", "variable", "neighbor", "r2").distinct()
    ends = models.agg(F.min("r2").alias("low"), F.max("r2").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("r2") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    return models.join(F.broadcast(ends)).withColumn("bin", place.cast("int")).groupBy("bin").agg(F.count(F.lit(1)).alias("n_models"))


def diurnal_profile(states: DataFrame) -> DataFrame:
    """Mean by hour of day before and after (of directions the circular mean), and coverage before; all 24 hours are there."""
    def mean(c: str) -> Column:
        return F.when(F.first("variable") == DIRECTION, circular_mean(F.col(c))).otherwise(F.avg(c))

    hours = states.groupBy("station", "variable", F.hour("ts").alias("hour")).agg(
        mean("value").alias("before"), mean("after").alias("after"), F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"))
    frame = states.select("station", "variable").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return frame.join(hours, ["station", "variable", "hour"], "left")


def annotated_series(states: DataFrame) -> DataFrame:
    return states.select("station", "variable", "ts", F.col("value").alias("before"), "after", "method")
