"""Verification of a published product against raw rows and log, and the coverage tables recomputed from it.

Coverage tables are roll-ups of one aggregate by station, variable, month and source (month_counts).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationfill.functions.rules import DIRECTION, SPEED
from stationfill.operators.provenance import allowed, logged_cells
from stationfill.operators.reports import imputed, percent


def verify_schema(df: DataFrame, expected: list[str]) -> list[str]:
    """Missing and unexpected columns."""
    return [f"missing {c}" for c in expected if c not in df.columns] + [f"unexpected {c}" for c in df.columns if c not in expected]


def verify_grid(product: DataFrame) -> DataFrame:
    """Stations without exactly one row for each hour of the common period: (station, n_rows, n_hours, first_ts, last_ts)."""
    own = product.groupBy("station").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ts").alias("n_hours"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    span = product.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    hours = F.expr("timestampdiff(HOUR, a, b)") + 1
    bad = (F.col("n_rows") != hours) | (F.col("n_hours") != hours) | (F.col("first_ts") != F.col("a")) | (F.col("last_ts") != F.col("b"))
    return own.join(F.broadcast(span)).filter(bad).drop("a", "b")


def verify_age(product: DataFrame, reference: Column, years: int = 10) -> DataFrame:
    """Days outside the `years` before the reference date, with their row counts."""
    day = F.to_date("ts")
    return product.filter(~day.between(F.add_months(reference, -12 * years), reference)).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))


def verify_key_conservation(raw: DataFrame, product: DataFrame) -> DataFrame:
    return raw.select("station", "ts").join(product.select("station", "ts"), ["station", "ts"], "left_anti")


def verify_georeference(product: DataFrame, raw: DataFrame) -> DataFrame:
    """(station, n_tuples, n_bad, n_changed): stations whose metadata vary, lie off the globe, or differ from the raw rows'."""
    place = F.struct("LATITUD", "LONGITUD", "ALTITUD", "DISTRITO")
    good = F.col("LATITUD").between(-90, 90) & F.col("LONGITUD").between(-180, 180)
    original = raw.groupBy("station").agg(F.max(place).alias("original"))
    rows = product.withColumn("place", place).withColumn("good", F.coalesce(good, F.lit(False))).join(F.broadcast(original), "station", "left")
    found = rows.groupBy("station").agg(F.count_distinct("place").alias("n_tuples"), F.count_if(~F.col("good")).alias("n_bad"), F.count_if(~F.col("place").eqNullSafe(F.col("original"))).alias("n_changed"))
    return found.filter("n_tuples > 1 OR n_bad > 0 OR n_changed > 0")


def verify_provenance(states: DataFrame) -> DataFrame:
    """(fault, n): sources out of vocabulary, values without a source or sources without a value, directions not applicable without calm."""
    valued = imputed() | F.col("source").isin("senamhi_observed", "senamhi_operational_outlier")
    speed = states.filter(F.col("variable") == SPEED).select("station", "ts", F.col("final").alias("speed"))
    not_applicable = states.filter("source = 'not_applicable'").join(speed, ["station", "ts"], "left")
    parts = {
        "vocabulary": states.join(F.broadcast(allowed(states.sparkSession)), ["variable", "source"], "left_anti"),
        "value": states.filter(valued != F.col("final").isNotNull()),
        "not_applicable": not_applicable.filter((F.col("variable") != DIRECTION) | ~F.coalesce(F.col("speed") == 0, F.lit(False))),
    }
    return reduce(DataFrame.unionByName, [x.agg(F.lit(k).alias("fault"), F.count(F.lit(1)).alias("n")) for k, x in parts.items()])


def verify_observations(states: DataFrame) -> DataFrame:
    """(variable, n_checked, n_equal, n_equivalent, n_different) of observed and outlier cells; directions also agree modulo 360."""
    kept = states.filter(F.col("source").isin("senamhi_observed", "senamhi_operational_outlier"))
    near = F.coalesce(F.abs(F.col("final") - F.col("raw")) <= 1e-9, F.lit(False))
    turn = F.pmod(F.abs(F.col("final") - F.col("raw")), F.lit(360.0))
    both = F.col("final").between(0, 360) & F.col("raw").between(0, 360)
    turned = F.coalesce((F.col("variable") == DIRECTION) & both & (F.least(turn, 360 - turn) <= 1e-9), F.lit(False))
    return kept.groupBy("variable").agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(near).alias("n_equal"), F.count_if(~near & turned).alias("n_equivalent"), F.count_if(~near & ~turned).alias("n_different"))


def verify_log(states: DataFrame, log: DataFrame) -> DataFrame:
    """(station, variable, ts, source, n_product, n_log) where the imputed cells of product and log differ, as multisets."""
    key = ["station", "variable", "ts", "source"]
    product = states.filter(imputed()).groupBy(*key).agg(F.count(F.lit(1)).alias("n_product"))
    logged = logged_cells(log).withColumn("source", F.concat(F.lit("imputed_"), "method_used")).groupBy(*key).agg(F.count(F.lit(1)).alias("n_log"))
    both = product.join(logged, key, "full").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_product", "n_log")})
    return both.filter("n_product <> n_log")


def month_counts(states: DataFrame) -> DataFrame:
    """(station, variable, month, source, n, applicable, available): the one aggregate over cells of which the tables below are roll-ups."""
    return states.groupBy("station", "variable", F.trunc("ts", "month").alias("month"), "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_applicable").alias("applicable"), F.count_if("output_present").alias("available"))


def _summed(when: Column | None = None, n: str = "n") -> Column:
    return F.coalesce(F.sum(F.col(n) if when is None else F.when(when, F.col(n))), F.lit(0).cast("long"))


def _coverage(counts: DataFrame, *by: str) -> DataFrame:
    """Counts by kind; the table's other columns follow by subtraction."""
    source = F.col("source")
    found = counts.groupBy(*by).agg(
        _summed(n="applicable").alias("applicable"), _summed(source == "senamhi_observed").alias("observed"),
        _summed(source == "senamhi_operational_outlier").alias("outliers"), _summed(imputed()).alias("imputed"))
    before = F.col("applicable") - F.col("observed") - F.col("outliers")
    after = before - F.col("imputed")
    return found.withColumns({"missing_before": before, "missing_after": after, "coverage_pct": percent(F.col("applicable") - after, F.col("applicable"))})


def coverage_table(counts: DataFrame) -> DataFrame:
    return _coverage(counts, "variable")


def coverage_by_station(counts: DataFrame) -> DataFrame:
    return _coverage(counts, "station", "variable")


def external_coverage_row(rows: DataFrame, column: str = "PP_IFS") -> DataFrame:
    """The coverage row of an external variable: nothing observed or imputed to count."""
    n, there = F.count(F.lit(1)), F.count(column)
    none = F.lit(None).cast("long")
    return rows.agg(F.lit(column).alias("variable"), n.alias("applicable"), none.alias("observed"), none.alias("imputed"), (n - there).alias("missing_after"), percent(there, n).alias("coverage_pct"))


def monthly_coverage(counts: DataFrame) -> DataFrame:
    """Hours of each calendar month, observed, imputed, available; the share of observed keeps calm hours in its denominator."""
    found = counts.groupBy("station", "variable", "month").agg(
        _summed(F.col("source").isin("senamhi_observed", "senamhi_operational_outlier")).alias("observed"), _summed(imputed()).alias("imputed"), _summed(n="available").alias("available"))
    days = F.datediff(F.last_day("month"), F.col("month")) + 1
    return found.withColumn("expected", (days * 24).cast("long")).withColumn("observed_pct", percent(F.col("observed"), F.col("expected")))


def method_counts(counts: DataFrame) -> DataFrame:
    return counts.filter(imputed()).groupBy("station", "variable", "source").agg(_summed().alias("n"))


def longest_month_run(counts: DataFrame) -> DataFrame:
    """(variable, months): the longest run of consecutive months with an observation of any station."""
    months = counts.filter("source = 'senamhi_observed'").select("variable", (F.year("month") * 12 + F.month("month")).alias("m")).distinct()
    island = F.col("m") - F.row_number().over(W.partitionBy("variable").orderBy("m"))
    return months.withColumn("island", island).groupBy("variable", "island").count().groupBy("variable").agg(F.max("count").alias("months"))


def station_catalog(product: DataFrame) -> DataFrame:
    """Coordinates at each station's first hour, and its rows; the struct keeps a null altitude."""
    place = F.min_by(F.struct("LATITUD", "LONGITUD", "ALTITUD"), F.col("ts"))
    return product.groupBy("station").agg(place.alias("p"), F.count(F.lit(1)).alias("n_rows")).select("station", "p.*", "n_rows")


def external_availability(rows: DataFrame, column: str = "PP_IFS") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_available"), (F.count(F.lit(1)) == F.count(column)).alias("complete"))


def compare_reference_table(found: DataFrame, reference: DataFrame, fields: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(variable, field, found, expected) that differ; a blank must meet a blank."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select("variable", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias(name)) for f in fields])))

    both = long(found, "found").join(long(reference, "expected"), ["variable", "field"], "full")
    same = (F.col("found").isNull() & F.col("expected").isNull()) | F.coalesce(F.abs(F.col("found") - F.col("expected")) <= tolerance, F.lit(False))
    return both.filter(~same)


def product_states(product: DataFrame, raw: DataFrame, variables: list[str]) -> DataFrame:
    """Cells of a published product (station, ts, a value and a source for each variable) beside the raw values.

    Only what the product says counts: source and value are its own, whether an hour is applicable follows from its source.
    """
    fields = lambda v: F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("final"), F.coalesce(f"{v}_SOURCE", F.lit("")).alias("source"), F.col(f"raw_{v}").cast("double").alias("raw"))
    observed = raw.select("station", "ts", *[F.col(v).alias(f"raw_{v}") for v in variables])
    cells = product.join(observed, ["station", "ts"], "left").select("station", "ts", F.inline(F.array(*[fields(v) for v in variables])))
    applicable = F.col("source") != "not_applicable"
    return cells.withColumns({"is_applicable": applicable, "output_present": applicable & F.col("final").isNotNull()})


def product_criteria(product: DataFrame, raw: DataFrame, log: DataFrame, states: DataFrame, counts: DataFrame, reference: Column, expected: list[str], least_months: int = 6, table: DataFrame | None = None, external: str | None = None) -> dict[str, DataFrame | Exception]:
    """Violations of every criterion, of a product read as published (station, ts, metadata, values, sources), its raw rows and its log.

    `states` and `counts` are product_states and month_counts of it, `reference` the date to which no row may be later or
    over ten years earlier, `expected` its columns, `table` known figures of coverage_table to compare with.
    """
    faults = verify_schema(product, expected)
    spark = product.sparkSession
    twice = product.groupBy("station", "ts").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR station IS NULL OR ts IS NULL")
    months = counts.select("variable").distinct().join(longest_month_run(counts), "variable", "left").filter(F.coalesce("months", F.lit(0)) < least_months)
    found: dict[str, DataFrame | Exception] = {
        "schema": spark.createDataFrame([(f,) for f in faults], "fault string"), "keys_unique": twice, "period_and_frequency": verify_grid(product), "age": verify_age(product, reference),
        "keys_kept": verify_key_conservation(raw, product), "georeference": verify_georeference(product, raw), "provenance": verify_provenance(states).filter("n > 0"),
        "observations_kept": verify_observations(states).filter("n_different > 0"), "log": verify_log(states, log), "months_with_observations": months,
    }
    if external is not None:
        found["external_available"] = external_availability(product, external).filter("NOT complete")
    if table is not None:
        found["reference_table"] = compare_reference_table(coverage_table(counts), table, [c for c in table.columns if c != "variable"])
    return found


def verification_report(criteria: dict[str, DataFrame | Exception]) -> DataFrame:
    """(criterion, status, detail): CUMPLE for an empty frame of violations, NO_CUMPLE with their number, or with the error met on the way."""
    spark = next(x for x in criteria.values() if isinstance(x, DataFrame)).sparkSession
    parts = []
    for name, x in criteria.items():
        if isinstance(x, DataFrame):
            n = F.count(F.lit(1))
            parts.append(x.agg(F.lit(name).alias("criterion"), F.when(n == 0, "CUMPLE").otherwise("NO_CUMPLE").alias("status"), n.cast("string").alias("detail")))
        else:
            parts.append(spark.range(1).select(F.lit(name).alias("criterion"), F.lit("NO_CUMPLE").alias("status"), F.lit(str(x)).alias("detail")))
    return reduce(DataFrame.unionByName, parts)
