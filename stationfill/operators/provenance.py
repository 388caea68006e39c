"""Provenance of every cell: where it came from, where its published value comes from, and the value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationfill.functions.rules import DIRECTION, SPEED, VARIABLES, allowed_sources


FILLED = ("station", "variable", "ts", "source_row", "raw", "hard", "outlier", "value", "eligible", "after", "method", "calm")


def filled_cells(scalars: DataFrame, wind: DataFrame, cells: DataFrame) -> DataFrame:
    """All cells with after and method: scalar cells as filled, and both fields of the wind from its vector rows."""
    keys = ["station", "ts"]
    fields = wind.select(*keys, "direction_after", "speed_after", "wrote_direction", "wrote_speed", F.col("method").alias("vector_method"))
    both = cells.filter(F.col("variable").isin(DIRECTION, SPEED)).join(fields, keys)
    is_speed = F.col("variable") == SPEED
    wrote = F.when(is_speed, F.col("wrote_speed")).otherwise(F.col("wrote_direction"))
    both = both.withColumn("after", F.when(is_speed, F.col("speed_after")).otherwise(F.col("direction_after"))).withColumn("method", F.when(wrote, F.col("vector_method")))
    both = both.withColumn("calm", F.coalesce(~is_speed & (F.col("speed_after") == 0), F.lit(False)))
    return scalars.withColumn("calm", F.lit(False)).select(*FILLED).unionByName(both.select(*FILLED))


def never_seen(cells: DataFrame) -> DataFrame:
    """Cells of series without a seen hour, in the columns of filled cells: no hour of theirs can be filled."""
    return cells.filter("span_start is null").withColumns({"after": F.col("value"), "method": F.lit(None).cast("string"), "calm": F.lit(False)}).select(*FILLED)


def cell_states(filled: DataFrame) -> DataFrame:
    """Cells with origin_state, source, final, output_present and is_applicable.

    A direction isn't applicable where the speed, filled or not, is zero. The two classifications test in different order:
    for the origin a hard-invalid value comes first, for the source what isn't applicable does.
    """
    missing = F.col("raw").isNull()
    na, hard, out = F.col("calm"), F.col("hard"), F.col("outlier")
    kinds = [
        (~missing, "senamhi_observed"),
        (~F.col("eligible"), "missing_structural"),
        (F.col("source_row"), "missing_explicit"),
        (F.lit(True), "missing_implicit"),
    ]
    origin = F.when(hard, "hard_invalid").when(na, "not_applicable").when(out, "operational_outlier")
    source = F.when(F.col("method").isNotNull(), F.concat(F.lit("imputed_"), F.col("method"))).when(na, "not_applicable").when(out, "senamhi_operational_outlier").when(hard, "missing_hard_invalid")
    for test, name in kinds:
        origin, source = origin.when(test, name), source.when(test, name)
    final = F.when(~na, F.when(hard | missing, F.col("after")).otherwise(F.col("raw")))
    states = filled.withColumns({"origin_state": origin, "source": source, "final": final, "is_applicable": ~na})
    return states.withColumn("output_present", F.col("final").isNotNull())


def allowed(spark: SparkSession) -> DataFrame:
    """(variable, source) pairs that a product may hold."""
    return spark.createDataFrame([(v, s) for v in VARIABLES for s in allowed_sources(v)], "variable string, source string")


def logged_cells(log: DataFrame) -> DataFrame:
    """(station, variable, method_used, ts): the hours of the log's accepted rows, once for each row that lists them."""
    rows = log.filter("accepted").select("station", "variable", "method_used", F.explode(F.split("imputed_timestamps", r"\|")).alias("t")).filter("t <> ''")
    return rows.select("station", "variable", "method_used", F.to_timestamp_ntz("t").alias("ts"))


def attribute_cells(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one method for each cell, cells that several log rows claim)."""
    counted = logged_cells(log).groupBy("station", "variable", "ts").agg(F.min("method_used").alias("method"), F.count(F.lit(1)).alias("n_claims"))
    return counted.filter("n_claims = 1").drop("n_claims"), counted.filter("n_claims > 1")


def select_by_provenance(wide: DataFrame, variable: str, include_imputed: bool = False, methods: list[str] | None = None) -> DataFrame:
    """Published rows whose value was observed; with include_imputed also imputed ones, of the given methods if named. instant is in UTC."""
    source = F.col(f"{variable}_SOURCE")
    wanted = source == "senamhi_observed"
    if include_imputed:
        wanted = wanted | (source.isin([f"imputed_{m}" for m in methods]) if methods else source.startswith("imputed_"))
    ts = F.expr("make_timestamp_ntz(FECHA DIV 10000, (FECHA DIV 100) % 100, FECHA % 100, HORA DIV 10000, 0, 0)")
    return wide.filter(wanted).select("ESTACION", ts.alias("ts"), F.to_utc_timestamp(ts.cast("timestamp"), "America/Lima").cast("timestamp_ntz").alias("instant"), F.col(variable).alias("value"), source.alias("source"))
