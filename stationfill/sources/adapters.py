"""Station series from the general tables that tests and benchmarks are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationfill.functions.expressions import date_code, hour_code


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve stations with six variables over a month, from events: (station, ts, one column a variable), with gaps and faults."""
    e = _table(spark, sf_dir, "events").filter("event_id % 5 <> 4")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    c = e.groupBy((F.col("user_id") % 12).alias("k"), hour.alias("ts")).agg(F.max("event_id").alias("eid"), F.max("value").alias("v"))
    h = c.withColumn("hi", F.day("ts") * 24 + F.hour("ts")).filter("(hi + 37*k) % 97 >= 11 AND (hi + 5*k) % 23 >= 2")
    return h.selectExpr(
        "concat('S', lpad(CAST(k AS STRING), 2, '0')) AS station",
        "ts",
        "CASE WHEN (hi + 13*k) % 211 = 0 THEN -1.0D WHEN (hi + 29*k) % 307 = 0 THEN 5000.0D ELSE v END AS PM2_5",
        "CAST(15 + abs(hour(ts) - 12) AS DOUBLE) + (eid % 3) * 0.25D + k * 0.5D AS TEMP",
        "CAST(CASE WHEN eid % 31 = 0 THEN NULL ELSE eid % 101 END AS DOUBLE) AS HR",
        "CAST(CASE WHEN eid % 4 = 0 THEN eid % 7 ELSE 0 END AS DOUBLE) AS PP",
        "CAST(CASE WHEN eid % 17 = 0 THEN NULL ELSE (eid * 37) % 361 END AS DOUBLE) AS DIR_VIENTO",
        "CAST(CASE WHEN eid % 19 = 0 THEN NULL ELSE eid % 13 END AS DOUBLE) AS VEL_VIENTO",
    )


def obs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five stations with one variable over 18 months, from lineitem: (station, ts, PM2_5)."""
    first = "TIMESTAMP_NTZ'1999-01-01 00:00:00'"
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 5 AS k", "l_shipdate", "l_orderkey", "l_quantity", "explode(sequence(0, l_linenumber - 1)) AS i")
    rows = rows.selectExpr("k", "CAST(l_shipdate AS TIMESTAMP_NTZ) AS day", "CAST(l_shipdate AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST((l_orderkey + i) % 24 AS INT)) AS ts", "l_quantity")
    rows = rows.filter(f"day >= {first} AND day < TIMESTAMP_NTZ'2000-07-01 00:00:00' AND (timestampdiff(HOUR, {first}, ts) + 611*k) % 1009 >= 130")
    return rows.groupBy(F.concat(F.lit("L"), F.col("k").cast("string")).alias("station"), "ts").agg(F.max("l_quantity").alias("PM2_5"))


def stations(df: DataFrame) -> DataFrame:
    """The station dimension of a view: coordinates and district from the number in the name."""
    k = F.substring("station", 2, 2).cast("int")
    return df.select("station").distinct().select(
        "station",
        (F.lit(-12.0) - F.lit(0.01) * k).alias("LATITUD"),
        (F.lit(-77.0) - F.lit(0.007) * ((k * 5) % 12)).alias("LONGITUD"),
        F.when(k % 4 != 3, (100 + 10 * k).cast("double")).alias("ALTITUD"),
        F.concat(F.lit("D"), (k % 3).cast("string")).alias("DISTRITO"),
    )


def raw_rows(df: DataFrame) -> DataFrame:
    """A view as raw rows: ESTACION, FECHA, HORA, metadata and measurements."""
    values = [c for c in df.columns if c not in ("station", "ts")]
    return df.join(F.broadcast(stations(df)), "station").select(
        F.col("station").alias("ESTACION"), date_code(F.col("ts")).alias("FECHA"), hour_code(F.col("ts")).alias("HORA"), "LATITUD", "LONGITUD", "ALTITUD", "DISTRITO", *values
    )


def dirty_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text rows with faults of every kind, from orders."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS row_id",
        "CASE WHEN o_orderkey % 50 = 0 THEN concat(' ', substr(o_orderpriority, 1, 1)) WHEN o_orderkey % 333 = 1 THEN ' ' WHEN o_orderkey % 444 = 2 THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS ESTACION",
        "CASE WHEN o_orderkey % 701 = 3 THEN '20230230' WHEN o_orderkey % 703 = 4 THEN '' ELSE date_format(o_orderdate, 'yyyyMMdd') END AS FECHA",
        "CASE WHEN o_orderkey % 709 = 5 THEN '1030' ELSE CAST((o_orderkey % 26) * 10000 AS STRING) END AS HORA",
        "CASE WHEN o_orderkey % 601 = 6 THEN '-95.5' WHEN o_orderkey % 607 = 7 THEN 'south' ELSE '-12.5' END AS LATITUD",
        "CASE WHEN o_orderkey % 613 = 8 THEN '' ELSE CAST(-77 - o_orderkey % 2 AS STRING) END AS LONGITUD",
        "CASE WHEN o_orderkey % 617 = 9 THEN 'n/a' ELSE CAST(o_custkey % 1000 AS STRING) END AS PM2_5",
    )
