"""Queries of the library by name, with SQL for those that SQL can express."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationfill.functions import expressions as E
from stationfill.functions.rules import DIRECTION, SCALARS, SPEED, VARIABLES, CurationConfig
from stationfill.jobs import curate as jobs
from stationfill.jobs.oracle import ALLOWED, sql
from stationfill.operators import contract, external, fill, gaps, grid, neighbors, postconditions, provenance, quality, reports, verify, wind
from stationfill.sources import adapters, io
from stationfill.sources.scratch import Scratch, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class View:
    """The station views of one data folder, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def obs(self) -> DataFrame:
        return adapters.obs_hourly(self.spark, self.sf_dir)

    @cached_property
    def long(self) -> DataFrame:
        return adapters.obs_long(self.spark, self.sf_dir)

    @cached_property
    def stations(self) -> DataFrame:
        return adapters.stations(self.obs)

    @cached_property
    def grid(self) -> DataFrame:
        return grid.hourly_grid(self.obs)

    @cached_property
    def wide(self) -> DataFrame:
        return grid.reindex_to_grid(self.obs, self.grid)

    @cached_property
    def cells(self) -> DataFrame:
        return jobs.cells_of(self.obs)

    @cached_property
    def scalars(self) -> DataFrame:
        return self.cells.filter(F.col("variable").isin(*SCALARS))

    @cached_property
    def anchored(self) -> DataFrame:
        return gaps.with_runs(self.scalars)

    @cached_property
    def vector(self) -> DataFrame:
        return wind.vectors(self.cells)

    @cached_property
    def filled_wind(self) -> DataFrame:
        return wind.fill_wind_temporal(self.cells)

    @cached_property
    def product(self) -> jobs.Product:
        return jobs.curate(self.obs)

    @cached_property
    def long_product(self) -> jobs.Product:
        return jobs.curate(self.long)

    @cached_property
    def whole(self) -> jobs.Product:
        return jobs.curate(self.obs, CurationConfig(), self.stations)

    @property
    def states(self) -> DataFrame:
        return self.product.states

    @cached_property
    def counts(self) -> DataFrame:
        return verify.month_counts(self.states)

    @cached_property
    def faulty(self) -> DataFrame:
        """The product with faults of every kind put in, by the hour and the station."""
        s = self.states.withColumn("n", _hour_number())
        final, source, after = F.col("final"), F.col("source"), F.col("after")
        at = lambda m, r: F.col("n") % m == r
        return s.withColumns({
            "final": F.when(at(53, 1), final + 1).when(at(59, 2), None).when(at(61, 3) & final.isNull(), 5.0).when(at(67, 4) & (F.col("variable") == DIRECTION) & source.startswith("imputed_"), 360.0).otherwise(final),
            "source": F.when(at(71, 5), "imputed_unknown").when(at(73, 6), "not_applicable").otherwise(source),
            "after": F.when(at(79, 7) & after.isNull(), 5.0).when(at(83, 8) & after.isNotNull() & F.col("value").isNull(), -999.0).otherwise(after),
        })

    @cached_property
    def dirty(self) -> DataFrame:
        return adapters.dirty_raw(self.spark, self.sf_dir)

    @cached_property
    def typed(self) -> DataFrame:
        return contract.coerce_numeric(self.dirty, ["FECHA", "HORA", "LATITUD", "LONGITUD", "PM2_5"])[0]

    @cached_property
    def external(self) -> DataFrame:
        """A modelled series on the grid, with values out of range and missing ones."""
        k = F.substring("station", 2, 2).cast("int")
        n = F.day("ts") * 24 + F.hour("ts") + k
        return self.grid.select("station", "ts", F.when(n % 17 != 0, (n % 71 - 3).cast("double")).alias("value"))

    @cached_property
    def with_external(self) -> DataFrame:
        return external.attach_external(self.wide, external.normalize(self.external))

    @cached_property
    def near(self) -> DataFrame:
        return neighbors.rank_neighbors(self.stations)

    @cached_property
    def sound_log(self) -> DataFrame:
        return jobs.imputation_log(self.product)

    @cached_property
    def log(self) -> DataFrame:
        """The log with faults in some rows."""
        odd = F.day("gap_start") + F.hour("gap_start")
        n = F.col("n_values_imputed")
        return self.sound_log.withColumns({"n_values_imputed": F.when(odd % 13 == 0, n + 1).otherwise(n), "accepted": F.when(odd % 17 == 0, ~F.col("accepted")).otherwise(F.col("accepted"))})


def _hour_number() -> Column:
    return F.day("ts") * 24 + F.hour("ts") + 7 * F.substring("station", 2, 2).cast("int")


def query(layer: str | None = None, tail: str = "", *more: str):
    def put(f: Callable[[View], DataFrame]) -> Callable[[View], DataFrame]:
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(View(spark, sf_dir))
        if layer:
            _SQL[name] = sql(layer, tail, *more)
        return f

    return put


def r(c: Column | str, places: int = 6) -> Column:
    """Rounded, without a negative zero: the engines' last bits differ."""
    return F.round(c, places) + F.lit(0.0)


def R(c: str, places: int = 6) -> str:  # noqa: N802
    return f"round({c}, {places}) + 0.0e0"


_CELL = ["station", "variable", "ts"]
_MONTHS = "date_trunc('month', ts)"


# ── input contract ───────────────────────────────────────────────────────────────────────────────────────────────────


@query("dirty", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (trim(d.{c}) <> '' AND t.{c} IS NULL) AS n_bad FROM dirty d JOIN typed t USING (row_id)" for c in ("FECHA", "HORA", "LATITUD", "LONGITUD", "PM2_5")) + ")")
def coerce_numeric(v):
    return contract.coerce_numeric(v.dirty, ["FECHA", "HORA", "LATITUD", "LONGITUD", "PM2_5"])[1]


@query("dirty", "SELECT row_id, LATITUD, LONGITUD FROM typed WHERE NOT coalesce(LATITUD BETWEEN -90 AND 90 AND LONGITUD BETWEEN -180 AND 180, false)")
def coordinate_violations(v):
    return contract.coordinate_violations(v.typed).select("row_id", "LATITUD", "LONGITUD")


_BAD_TIME = "NOT coalesce(FECHA = floor(FECHA) AND try_strptime(lpad(CAST(CAST(FECHA AS BIGINT) AS VARCHAR), 8, '0'), '%Y%m%d') IS NOT NULL AND HORA BETWEEN 0 AND 230000 AND CAST(HORA AS BIGINT) % 10000 = 0, false)"


@query("dirty", f"SELECT row_id, FECHA, HORA FROM typed WHERE {_BAD_TIME}")
def time_code_violations(v):
    return contract.time_code_violations(v.typed).select("row_id", "FECHA", "HORA")


@query("dirty", f"SELECT DISTINCT FECHA, HORA FROM typed WHERE {_BAD_TIME} ORDER BY FECHA NULLS FIRST, HORA NULLS FIRST LIMIT 10")
def bad_time_examples(v):
    return contract.bad_time_examples(v.typed)


@query("dirty", "SELECT ESTACION, FECHA, HORA, count(*) AS n_rows FROM typed GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(v):
    return contract.duplicate_keys(v.typed)


@query("dirty", "SELECT row_id, ESTACION FROM typed WHERE ESTACION IS NULL OR trim(ESTACION) = '' OR ESTACION <> trim(ESTACION)")
def station_id_violations(v):
    return contract.station_id_violations(v.typed).select("row_id", "ESTACION")


@query("dirty", "SELECT * FROM (SELECT ESTACION, 'LATITUD' AS column_name, count(DISTINCT LATITUD) AS n_values FROM typed GROUP BY 1 UNION ALL SELECT ESTACION, 'LONGITUD', count(DISTINCT LONGITUD) FROM typed GROUP BY 1) WHERE n_values > 1")
def metadata_conflicts(v):
    return contract.metadata_conflicts(v.typed)


@query("obs", "SELECT min(ts) AS first_ts, max(ts) AS last_ts, date_diff('hour', min(ts), max(ts)) // 24 AS n_days, max(ts) - min(ts) > INTERVAL 20 DAY AS too_long FROM obs")
def period_span(v):
    return contract.period_span(adapters.raw_rows(v.obs), 20)


@query("stations", f"SELECT station AS ESTACION, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INTEGER) AS FECHA, CAST(hour(ts) * 10000 AS INTEGER) AS HORA, {R('LATITUD')} AS LATITUD, {R('LONGITUD')} AS LONGITUD, ALTITUD, DISTRITO, " + ", ".join(VARIABLES) + " FROM obs JOIN stations USING (station)")
def validate_input(v):
    """Every rule on clean rows: all counts are 0 and the rows come back."""
    return contract.validate_input(adapters.raw_rows(v.obs)).withColumns({c: r(c) for c in ("LATITUD", "LONGITUD")})


# ── time and grid ────────────────────────────────────────────────────────────────────────────────────────────────────


@query("obs", "SELECT station AS ESTACION, year(ts) * 10000 + month(ts) * 100 + day(ts) AS FECHA, hour(ts) * 10000 AS HORA, ts FROM obs")
def with_timestamp(v):
    return grid.with_timestamp(adapters.raw_rows(v.obs)).select("ESTACION", F.col("FECHA").cast("long").alias("FECHA"), F.col("HORA").cast("long").alias("HORA"), "ts")


@query("grid", "SELECT station, ts FROM grid")
def hourly_grid(v):
    return v.grid


@query("grid", "SELECT station, ts, source_row, PM2_5, TEMP, HR, PP, DIR_VIENTO, VEL_VIENTO FROM wide")
def reindex_to_grid(v):
    return v.wide.select("station", "ts", "source_row", *VARIABLES)


@query("grid", "SELECT station, count(*) AS n_added FROM wide WHERE NOT source_row GROUP BY 1")
def implicit_row_counts(v):
    return grid.implicit_row_counts(v.obs, v.grid)


@query("stations", "SELECT g.station, g.ts, LATITUD, ALTITUD, DISTRITO FROM grid g JOIN stations USING (station)", "hours AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (SELECT min(ts) AS a, max(ts) AS b FROM obs))", "grid AS (SELECT station, ts FROM stations, hours)")
def fill_station_metadata(v):
    known = v.obs.join(F.broadcast(v.stations), "station")
    rows = grid.reindex_to_grid(known.select("station", "ts", "LATITUD", "ALTITUD", "DISTRITO"), v.grid)
    return grid.fill_station_metadata(rows, ["LATITUD", "ALTITUD", "DISTRITO"]).select("station", "ts", "LATITUD", "ALTITUD", "DISTRITO")


@query("cells", "SELECT station, ts, variable, raw FROM cells")
def to_long_cells(v):
    return grid.to_long_cells(v.wide, list(VARIABLES)).select("station", "ts", "variable", "raw")


_PIVOT = ", ".join(f"round(max(final) FILTER (variable = '{x}'), 6) + 0.0e0 AS {x}, max(source) FILTER (variable = '{x}') AS {x}_SOURCE" for x in VARIABLES)


@query("states", f"SELECT station AS ESTACION, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INTEGER) AS FECHA, CAST(hour(ts) * 10000 AS INTEGER) AS HORA, {_PIVOT} FROM states GROUP BY station, ts ORDER BY 1, 2, 3")
def to_wide_output(v):
    wide = grid.to_wide_output(v.states, list(VARIABLES))
    return wide.withColumns({x: r(x) for x in VARIABLES}).orderBy("ESTACION", "FECHA", "HORA")


# ── quality ──────────────────────────────────────────────────────────────────────────────────────────────────────────


@query("cells", "SELECT station, variable, ts, raw FROM cells WHERE hard")
def hard_invalid(v):
    return v.cells.filter("hard").select(*_CELL, "raw")


@query("cells", "SELECT station, variable, ts, raw FROM cells WHERE outlier")
def operational_outlier(v):
    return v.cells.filter("outlier").select(*_CELL, "raw")


@query("cells", "SELECT station, variable, ts, value FROM cells")
def analytic_snapshot(v):
    return quality.classify(v.wide, list(VARIABLES)).select(*_CELL, "value")


@query("cells", "SELECT station, variable, min(span_start) AS span_start, max(span_end) AS span_end FROM cells WHERE variable NOT IN ('DIR_VIENTO', 'VEL_VIENTO') GROUP BY 1, 2")
def observed_span(v):
    return quality.observed_span(quality.classify(v.wide, list(SCALARS)))


@query("cells", "SELECT station, variable, min(span_start) AS span_start, max(span_end) AS span_end FROM cells WHERE variable IN ('DIR_VIENTO', 'VEL_VIENTO') GROUP BY 1, 2")
def wind_span(v):
    return quality.observed_span(quality.classify(v.wide, [DIRECTION, SPEED]))


@query("cells", "SELECT station, variable, ts, eligible FROM cells")
def eligibility(v):
    return v.cells.select(*_CELL, "eligible")


# ── gaps ─────────────────────────────────────────────────────────────────────────────────────────────────────────────

_GAPS = "SELECT station, variable, gap_start, gap_end, n_steps FROM runs WHERE is_gap AND ts = gap_start"


@query("runs", f"SELECT *, CAST(row_number() OVER (PARTITION BY station, variable ORDER BY gap_start) AS INTEGER) AS gap_id, n_steps AS duration_h FROM ({_GAPS})")
def find_gaps(v):
    return gaps.find_gaps(v.scalars)


@query("runs", f"SELECT station, variable, gap_start, n_steps AS duration_h, CASE WHEN n_steps <= 4 THEN 'short' ELSE 'long' END AS gap_class FROM ({_GAPS})")
def classify_gaps(v):
    return gaps.classify_gaps(gaps.find_gaps(v.scalars)).select("station", "variable", "gap_start", "duration_h", "gap_class")


@query("runs", "SELECT station, variable, gap_start, gap_end, n_steps, left_value, right_value, left_value IS NOT NULL AND right_value IS NOT NULL AS anchored FROM runs WHERE is_gap AND ts = gap_start")
def gap_anchors(v):
    return gaps.gap_anchors(v.scalars)


# ── scalar fills ─────────────────────────────────────────────────────────────────────────────────────────────────────


def _short(v: View) -> DataFrame:
    return fill.with_short_fill(v.anchored).filter("short_value is not null")


@query("filled", f"SELECT station, variable, ts, {R('short_value')} AS short_value FROM filled WHERE short_value IS NOT NULL AND NOT coalesce(zero, false)")
def fill_short_linear(v):
    return _short(v).filter("short_method = 'short_linear'").select(*_CELL, r("short_value").alias("short_value"))


@query("filled", "SELECT station, variable, ts, short_value FROM filled WHERE short_value IS NOT NULL AND zero")
def fill_short_zero(v):
    return _short(v).filter("short_method = 'short_zero'").select(*_CELL, "short_value")


@query("filled", "SELECT station, variable, ts, CAST(len(donors) AS INTEGER) AS n_donors, list_reduce(list_prepend(0.0e0, donors), lambda a, b: a + b) AS total FROM filled WHERE is_gap")
def weekly_donors(v):
    donors = fill.weekly_donors(gaps.with_runs(v.scalars)).filter("is_gap")
    there = F.filter("donors", lambda x: x.isNotNull())
    return donors.select(*_CELL, F.size(there).alias("n_donors"), F.aggregate(there, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("filled", f"SELECT station, variable, ts, {R('weekly_value')} AS weekly_value, CAST(n_donors AS INTEGER) AS n_donors FROM filled WHERE weekly_value IS NOT NULL AND is_gap")
def fill_weekly_mean(v):
    return fill.with_weekly_fill(gaps.with_runs(v.scalars)).filter("is_gap and weekly_value is not null").select(*_CELL, r("weekly_value").alias("weekly_value"), "n_donors")


@query("long", "SELECT station, variable, ts, year_value FROM y WHERE year_value IS NOT NULL")
def fill_cross_year(v):
    cells = jobs.cells_of(v.long)
    runs = fill.own_candidates(cells)
    return fill.cross_year_values(cells, runs.filter("is_gap AND short_value IS NULL AND weekly_value IS NULL"))


_MERGED = f"SELECT station, variable, ts, {R('after')} AS after, method FROM filled WHERE is_gap"


@query("filled", _MERGED)
def merge_candidates(v):
    return v.product.scalars.filter("is_gap").select(*_CELL, r("after").alias("after"), "method")


@query("long", _MERGED)
def fill_long_gaps(v):
    return v.long_product.scalars.filter("is_gap").select(*_CELL, r("after").alias("after"), "method")


@query("log", "SELECT * FROM log")
def imputation_log(v):
    """Scalars and wind by their own evidence."""
    return v.sound_log


@query("long_log", "SELECT * FROM log")
def imputation_log_long(v):
    return jobs.imputation_log(v.long_product)


def _millionths(text: Column) -> Column:
    """The numbers of a text (one, or a JSON list of numbers or lists) in millionths, as a text: the engines print numbers in different ways."""
    numbers = F.regexp_extract_all(text, F.lit(r"[-+0-9.eE]+"), F.lit(0))
    return F.when(text.isNotNull(), F.array_join(F.transform(numbers, lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ","))


@query("whole_log", "SELECT * FROM log")
def imputation_log_near(v):
    """The log of the whole cascade: near stations too, with every attempt, its reason and its model (coefficients in millionths)."""
    found = jobs.imputation_log(v.whole)
    return found.withColumns({c: _millionths(F.col(c)) for c in ("model_intercept", "model_coefficient")} | {"interstation_r2": r("interstation_r2"), **{c: F.round(c, 6) for c in ("distance_km", "predictor_coverage")}})


# ── neighbours ───────────────────────────────────────────────────────────────────────────────────────────────────────

_HAVERSINE = "2 * 6371.0088e0 * atan2(sqrt(h), sqrt(greatest(0.0e0, 1 - h)))"
_NEAR = f"""
near AS (
  SELECT a.station, b.station AS neighbor, {_HAVERSINE} AS distance_km
  FROM stations a JOIN stations b ON a.station <> b.station,
  LATERAL (SELECT pow(sin(radians(b.LATITUD - a.LATITUD) / 2), 2) + cos(radians(a.LATITUD)) * cos(radians(b.LATITUD)) * pow(sin(radians(b.LONGITUD - a.LONGITUD) / 2), 2) AS h))"""


@query("stations", f"SELECT station, neighbor, {R('distance_km')} AS distance_km FROM near", _NEAR)
def station_distance_km(v):
    return v.near.select("station", "neighbor", r("distance_km").alias("distance_km"))


@query("stations", "SELECT * FROM (SELECT station, neighbor, CAST(row_number() OVER (PARTITION BY station ORDER BY round(distance_km, 9), neighbor) AS INTEGER) AS rank FROM near) WHERE rank <= 5", _NEAR)
def rank_neighbors(v):
    return neighbors.rank_neighbors(v.stations, 5).select("station", "neighbor", "rank")


_PAIRS = """
pairs AS (
  SELECT a.variable, a.station, b.station AS neighbor, a.ts, a.value AS y, b.value AS x
  FROM cells a JOIN cells b ON a.variable = b.variable AND a.ts = b.ts AND a.station <> b.station
  WHERE a.value IS NOT NULL AND b.value IS NOT NULL AND a.variable IN ('PM2_5', 'TEMP', 'HR', 'PP')),
p1 AS (SELECT *, count(*) OVER q AS n, row_number() OVER (q ORDER BY ts) - 1 AS rn FROM pairs WINDOW q AS (PARTITION BY variable, station, neighbor)),
p2 AS (SELECT *, n - 5 * (n // 6) AS head, n // 6 AS t FROM p1 WHERE n >= 48),
seg AS (SELECT *, CASE WHEN rn < head THEN 0 ELSE 1 + (rn - head) // t END AS seg FROM p2),
model AS (
  SELECT variable, station, neighbor, count(*) AS training_pairs, CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) / var_pop(x) ELSE 0 END AS slope, avg(y) AS my, avg(x) AS mx FROM seg GROUP BY 1, 2, 3),
fold AS (
  SELECT s.variable, s.station, s.neighbor, f.j, CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) / var_pop(x) ELSE 0 END AS b, avg(y) AS my, avg(x) AS mx
  FROM seg s JOIN (SELECT unnest(range(1, 6)) AS j) f ON s.seg < f.j GROUP BY 1, 2, 3, 4),
tested AS (
  SELECT s.variable, s.station, s.neighbor, s.seg, sum(pow(y - (my - b * mx) - b * x, 2)) AS sse, var_pop(y) * count(*) AS sst
  FROM seg s JOIN fold f ON s.variable = f.variable AND s.station = f.station AND s.neighbor = f.neighbor AND s.seg = f.j GROUP BY 1, 2, 3, 4),
r2 AS (SELECT variable, station, neighbor, avg(CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1 ELSE 0 END) AS r2 FROM tested GROUP BY 1, 2, 3)"""


@query("station_cells", f"SELECT variable, station, neighbor, training_pairs, {R('slope')} AS slope, {R('my - slope * mx')} AS intercept, {R('r2')} AS r2 FROM model JOIN r2 USING (variable, station, neighbor)", _PAIRS)
def fit_station_models(v):
    m = neighbors.fit_station_models(neighbors.training_pairs(v.scalars, v.near)).filter("r2 is not null")
    return m.select("variable", "station", "neighbor", "training_pairs", *[r(c).alias(c) for c in ("slope", "intercept", "r2")])


_ATTEMPT = ("value", "r2", "predictor_coverage", "distance_km", "slope", "intercept")


@query("near_scalars", f"SELECT station, variable, gap_start, ts, neighbor, accepted, rejection_reason, training_pairs, {', '.join(f'{R(c)} AS {c}' for c in _ATTEMPT)} FROM attempts")
def fill_from_neighbors(v):
    """Every attempt of the cascade, and the hours of the accepted ones."""
    return v.whole.attempts.select("station", "variable", "gap_start", "ts", "neighbor", "accepted", "rejection_reason", "training_pairs", *[r(c).alias(c) for c in _ATTEMPT])


_FINAL = f"SELECT station, variable, ts, source, {R('final', 4)} AS final, method FROM states WHERE variable "


@query("whole", _FINAL + "NOT IN ('DIR_VIENTO', 'VEL_VIENTO')")
def impute_series(v):
    """All scalar series by the whole cascade, neighbours included."""
    return v.whole.states.filter(F.col("variable").isin(*SCALARS)).select(*_CELL, "source", r("final", 4).alias("final"), "method")


# ── wind ─────────────────────────────────────────────────────────────────────────────────────────────────────────────


@query("wind", f"SELECT station, ts, {R('u')} AS u, {R('v')} AS v FROM vec")
def wind_to_components(v):
    return v.vector.select("station", "ts", r("u").alias("u"), r("v").alias("v"))


@query("wind", f"SELECT station, ts, {R('CASE WHEN speed = 0 THEN 0 ELSE sqrt(u * u + v * v) END')} AS speed, {R('CASE WHEN speed <> 0 THEN round((degrees(atan2(-u, -v)) + 360) % 360, 6) % 360 END')} AS direction FROM vec")
def components_to_wind(v):
    u, w = F.col("u"), F.col("v")
    return v.vector.select("station", "ts", r(E.speed_of(u, w)).alias("speed"), r(F.pmod(F.round(E.direction_of(u, w), 6), F.lit(360.0))).alias("direction"))


@query("wind", "SELECT station, count(*) FILTER (speed = 0) AS n_calm, count(speed) AS n_speed FROM vec GROUP BY 1")
def numerical_calm(v):
    return v.vector.groupBy("station").agg(F.count_if(E.numerical_calm(F.col("speed"))).alias("n_calm"), F.count("speed").alias("n_speed"))


@query("wind", "SELECT station, ts, coalesce(isfinite(u) AND isfinite(v) AND sqrt(u*u*36 + v*v*36) <= 75, false) AS valid FROM vec")
def valid_wind_candidate(v):
    """Of vectors six times as long, so that some are too fast."""
    return v.vector.select("station", "ts", E.valid_wind(F.col("u") * 6, F.col("v") * 6).alias("valid"))


@query("wind", "SELECT station, ts, method, n_conflicts FROM merged WHERE is_gap")
def merge_wind_candidate(v):
    return v.filled_wind.filter("is_gap").select("station", "ts", "method", "n_conflicts")


@query("wind", "SELECT station, gap_start, gap_end, n_steps, anchored FROM cand WHERE is_gap AND ts = gap_start")
def wind_gaps(v):
    return wind.with_wind_gaps(v.vector).filter("is_gap and ts = gap_start").select("station", "gap_start", "gap_end", "n_steps", "anchored")


@query("wind", f"SELECT station, ts, {R('short_u')} AS u, {R('short_v')} AS v FROM cand WHERE short_u IS NOT NULL")
def fill_wind_short(v):
    return wind.candidates(v.vector).filter("short_u is not null").select("station", "ts", r("short_u").alias("u"), r("short_v").alias("v"))


@query("wind", f"SELECT station, ts, {R('weekly_u')} AS u, {R('weekly_v')} AS v, CAST(len(du) AS INTEGER) AS n_donors FROM cand WHERE weekly_u IS NOT NULL")
def fill_wind_weekly(v):
    return wind.candidates(v.vector).filter("weekly_u is not null").select("station", "ts", r("weekly_u").alias("u"), r("weekly_v").alias("v"), "n_donors")


def _as_wind(df: DataFrame) -> DataFrame:
    """A view's scalar as wind: speed modulo 13, direction 7 times the value modulo 360."""
    value = F.col("PM2_5")
    return df.select("station", "ts", (value % 13).alias(SPEED), F.pmod(value * 7, F.lit(360.0)).alias(DIRECTION))


_LONG_WIND = """
lw AS (SELECT g.station, g.ts, PM2_5 % 13 AS speed, (PM2_5 * 7) % 360 AS direction FROM wide g),
lv AS (SELECT *, CASE WHEN speed = 0 THEN 0.0e0 ELSE -speed * sin(radians(direction)) END AS u, CASE WHEN speed = 0 THEN 0.0e0 ELSE -speed * cos(radians(direction)) END AS v FROM lw)"""


@query("long", f"SELECT w.station, w.ts, {R('coalesce(a.u, b.u)')} AS u, {R('coalesce(a.v, b.v)')} AS v FROM lv w LEFT JOIN lv a ON a.station = w.station AND a.ts = w.ts + INTERVAL 1 YEAR LEFT JOIN lv b ON b.station = w.station AND b.ts = w.ts - INTERVAL 1 YEAR WHERE w.u IS NULL AND coalesce(a.u, b.u) IS NOT NULL", _LONG_WIND)
def fill_wind_cross_year(v):
    cells = jobs.cells_of(_as_wind(v.long))
    vector = wind.vectors(cells)
    return wind.cross_year_vectors(vector, vector.filter("u is null")).select("station", "ts", r("year_u").alias("u"), r("year_v").alias("v"))


_WIND_MODEL = ("u_by_u", "u_by_v", "v_by_u", "v_by_v", "u_base", "v_base", "r2")


@query("wind_models", f"SELECT station, neighbor, training_pairs, {', '.join(f'{R(c)} AS {c}' for c in _WIND_MODEL)} FROM wmodel WHERE r2 IS NOT NULL")
def fit_wind_models(v):
    m = neighbors.fit_wind_models(neighbors.wind_pairs(v.vector, v.near)).filter("r2 is not null")
    return m.select("station", "neighbor", "training_pairs", *[r(c).alias(c) for c in _WIND_MODEL])


_WIND_ATTEMPT = ("near_u", "near_v", "r2", "predictor_coverage", "distance_km")


@query("near_wind", f"SELECT station, variable, gap_start, ts, neighbor, accepted, rejection_reason, training_pairs, {', '.join(f'{R(c)} AS {c}' for c in _WIND_ATTEMPT)} FROM wattempts")
def fill_wind_from_neighbors(v):
    """Every attempt of the wind's cascade, by a policy that takes nearly all models."""
    config = CurationConfig(interstation_min_r2=-10.0, predictor_min_gap_coverage=0.5)
    found = neighbors.fill_wind_from_neighbors(v.vector, v.filled_wind.filter("is_gap AND method IS NULL"), v.stations, config)
    return found.select("station", "variable", "gap_start", "ts", "neighbor", "accepted", "rejection_reason", "training_pairs", *[r(c).alias(c) for c in _WIND_ATTEMPT])


@query("wind", f"SELECT station, ts, {R('round(direction_after, 6) % 360')} AS direction_after, {R('speed_after')} AS speed_after, wrote_direction, wrote_speed FROM wind WHERE is_gap")
def compose_wind_fields(v):
    return v.filled_wind.filter("is_gap").select("station", "ts", r(F.pmod(F.round("direction_after", 6), F.lit(360.0))).alias("direction_after"), r("speed_after").alias("speed_after"), "wrote_direction", "wrote_speed")


@query("whole", f"SELECT station, variable, ts, source, CASE WHEN variable = 'DIR_VIENTO' THEN round(final, 4) % 360 ELSE round(final, 4) END + 0.0e0 AS final, method FROM states WHERE variable IN ('DIR_VIENTO', 'VEL_VIENTO')")
def impute_wind(v):
    """Both wind fields by the whole cascade, neighbours included."""
    turned = F.when(F.col("variable") == DIRECTION, F.round("final", 4) % 360).otherwise(F.round("final", 4)) + F.lit(0.0)
    return v.whole.states.filter(F.col("variable").isin(DIRECTION, SPEED)).select(*_CELL, "source", turned.alias("final"), "method")


_CIRCULAR = "CASE WHEN sqrt(s*s + c*c) > 1e-12 THEN CASE WHEN 360 - m <= 360 * 1e-5 + 1e-8 THEN 0.0e0 ELSE m END END"


@query("wind", f"SELECT station, {R(_CIRCULAR)} AS mean_direction FROM (SELECT *, (degrees(atan2(s, c)) + 360) % 360 AS m FROM (SELECT station, avg(sin(radians(direction))) AS s, avg(cos(radians(direction))) AS c FROM vec GROUP BY 1))")
def circular_mean_deg(v):
    return v.vector.groupBy("station").agg(r(E.circular_mean(F.col("direction"))).alias("mean_direction"))


# ── provenance ───────────────────────────────────────────────────────────────────────────────────────────────────────


@query("states", "SELECT station, variable, ts, origin_state FROM states")
def origin_state(v):
    return v.states.select(*_CELL, "origin_state")


@query("states", "SELECT station, variable, ts, source FROM states")
def cell_source(v):
    return v.states.select(*_CELL, "source")


@query("states", f"SELECT station, variable, ts, {R('final', 4)} AS final FROM states")
def final_value(v):
    return v.states.select(*_CELL, r("final", 4).alias("final"))


@query("states", "SELECT station, variable, ts, method FROM states WHERE method IS NOT NULL")
def attribute_cells(v):
    return provenance.attribute_cells(v.sound_log)[0]


@query("states", "SELECT station, variable, ts, origin_state, source, output_present, is_applicable FROM states")
def cell_states(v):
    return v.states.select(*_CELL, "origin_state", "source", "output_present", "is_applicable")


@query("states", "SELECT variable, source, coalesce(n, 0) AS n_cells FROM allowed LEFT JOIN (SELECT variable, source, count(*) AS n FROM states GROUP BY 1, 2) USING (variable, source)", ALLOWED)
def allowed_sources(v):
    """How many cells of the product have each source of the vocabulary."""
    found = v.states.groupBy("variable", "source").agg(F.count(F.lit(1)).alias("n_cells"))
    return provenance.allowed(v.spark).join(found, ["variable", "source"], "left").fillna(0, ["n_cells"]).select("variable", "source", "n_cells")


_SELECT = f"SELECT station AS ESTACION, ts, ts + INTERVAL 5 HOUR AS instant, {R('final')} AS value, source FROM states WHERE variable = 'TEMP' AND source "


@query("states", _SELECT + "= 'senamhi_observed'")
def select_by_provenance(v):
    return provenance.select_by_provenance(grid.to_wide_output(v.states, list(VARIABLES)), "TEMP").withColumn("value", r("value"))


@query("states", _SELECT + "IN ('senamhi_observed', 'imputed_weekly_seasonal')")
def select_with_imputed(v):
    return provenance.select_by_provenance(grid.to_wide_output(v.states, list(VARIABLES)), "TEMP", True, ["weekly_seasonal"]).withColumn("value", r("value"))


# ── reports ──────────────────────────────────────────────────────────────────────────────────────────────────────────

_SUMMARY = """
SELECT CASE WHEN grouping(station) > 0 THEN 'TOTAL' ELSE station END AS station, CASE WHEN grouping(station) > 0 THEN 'TOTAL' ELSE variable END AS variable,
  count(*) FILTER (is_applicable) AS applicable, count(*) FILTER (origin_state = 'senamhi_observed') AS observed, count(*) FILTER (origin_state = 'hard_invalid') AS hard_invalid,
  count(*) FILTER (origin_state = 'operational_outlier') AS outliers, count(*) FILTER (origin_state = 'hard_invalid' OR starts_with(origin_state, 'missing_')) AS missing_before,
  count(*) FILTER (starts_with(source, 'imputed_')) AS imputed, count(*) FILTER (is_applicable AND NOT output_present) AS remaining,
  round(100.0e0 * count(*) FILTER (is_applicable AND output_present) / count(*) FILTER (is_applicable), 6) + 0.0e0 AS coverage_pct
FROM states GROUP BY GROUPING SETS ((station, variable), ())"""


@query("states", _SUMMARY)
def execution_summary(v):
    return reports.execution_summary(v.states).withColumn("coverage_pct", r("coverage_pct"))


@query("states", "SELECT *, round(100.0e0 * n / sum(n) OVER (PARTITION BY station, variable), 6) + 0.0e0 AS pct FROM (SELECT CASE WHEN grouping(station) > 0 THEN 'TOTAL' ELSE station END AS station, CASE WHEN grouping(station) > 0 THEN 'TOTAL' ELSE variable END AS variable, source, count(*) AS n FROM states WHERE starts_with(source, 'imputed_') GROUP BY GROUPING SETS ((station, variable, source), (source)))")
def method_breakdown(v):
    return reports.method_breakdown(v.states).withColumn("pct", r("pct"))


_EXTERNAL = """
ext AS (SELECT station, ts, CASE WHEN n % 17 <> 0 THEN CAST(n % 71 - 3 AS DOUBLE) END AS value FROM (SELECT station, ts, day(ts) * 24 + hour(ts) + CAST(substr(station, 2, 2) AS INTEGER) AS n FROM grid)),
ifs AS (SELECT station, ts, CASE WHEN value BETWEEN 0 AND 60 THEN value END AS PP_IFS FROM ext)"""


@query("grid", "SELECT CASE WHEN grouping(station) > 0 THEN 'TOTAL' ELSE station END AS station, count(*) AS n_rows, count(PP_IFS) AS available, count(*) - count(PP_IFS) AS missing FROM ifs GROUP BY ROLLUP (station)", _EXTERNAL)
def external_coverage(v):
    return reports.external_coverage(v.with_external, "PP_IFS")


@query("states", f"SELECT station, variable, CAST(ts AS DATE) AS day, {R('avg(CAST(value IS NOT NULL AS INTEGER))')} AS before, {R('avg(CAST(after IS NOT NULL AS INTEGER))')} AS after FROM states GROUP BY 1, 2, 3")
def daily_coverage(v):
    return reports.daily_coverage(v.states).withColumns({c: r(c) for c in ("before", "after")})


@query("runs", f"SELECT variable, bin, count(*) AS n_gaps, CAST(sum(n_steps) AS BIGINT) AS hours FROM (SELECT variable, n_steps, CAST(least(floor(ln(n_steps) / ln(max(n_steps) OVER (PARTITION BY variable) + 1) * 29 + 1e-9), 28) AS INTEGER) AS bin FROM ({_GAPS})) GROUP BY 1, 2")
def gap_histogram(v):
    return reports.gap_histogram(gaps.find_gaps(v.scalars))


@query("states", "SELECT variable, method, count(*) AS n_imputed FROM states WHERE method IS NOT NULL GROUP BY 1, 2")
def method_totals(v):
    return reports.method_totals(v.states)


@query("near_scalars", "SELECT bin, count(*) AS n_models FROM (SELECT CAST(CASE WHEN high > low THEN least(floor((r2 - low) / (high - low) * 10), 9) ELSE 0 END AS INTEGER) AS bin FROM (SELECT *, min(r2) OVER () AS low, max(r2) OVER () AS high FROM (SELECT DISTINCT station, variable, neighbor, r2 FROM attempts WHERE accepted))) GROUP BY 1")
def r2_histogram(v):
    return reports.r2_histogram(v.whole.attempts)


def _mean(c: str) -> str:
    s, k = f"avg(sin(radians({c})))", f"avg(cos(radians({c})))"
    m = f"((degrees(atan2({s}, {k})) + 360) % 360)"
    return f"CASE WHEN variable = 'DIR_VIENTO' THEN CASE WHEN sqrt({s} * {s} + {k} * {k}) > 1e-12 THEN CASE WHEN 360 - {m} <= 360 * 1e-5 + 1e-8 THEN 0 ELSE {m} END END ELSE avg({c}) END"


@query("states", f"SELECT station, variable, hour, {R('before', 8)} AS before, {R('after', 8)} AS after, {R('coverage')} AS coverage FROM (SELECT station, variable, unnest(range(24))::INTEGER AS hour FROM (SELECT DISTINCT station, variable FROM states)) LEFT JOIN (SELECT station, variable, hour(ts)::INTEGER AS hour, {_mean('value')} AS before, {_mean('after')} AS after, avg(CAST(value IS NOT NULL AS INTEGER)) AS coverage FROM states GROUP BY 1, 2, 3) USING (station, variable, hour)")
def diurnal_profile(v):
    return reports.diurnal_profile(v.states).withColumns({"before": r("before", 8), "after": r("after", 8), "coverage": r("coverage")})


@query("states", f"SELECT station, variable, ts, {R('value', 4)} AS before, {R('after', 4)} AS after, method FROM states")
def annotated_series(v):
    return reports.annotated_series(v.states).withColumns({c: r(c, 4) for c in ("before", "after")})


# ── post-conditions, on a product with faults ────────────────────────────────────────────────────────────────────────


@query("dirty", "SELECT ESTACION, FECHA, HORA, count(*) AS n_rows FROM typed GROUP BY ALL HAVING count(*) > 1 OR ESTACION IS NULL OR FECHA IS NULL OR HORA IS NULL")
def output_key_violations(v):
    return postconditions.output_key_violations(v.typed)


_LOG_FAULTS = """
bad_log AS (
  SELECT * EXCLUDE (n_values_imputed, accepted, odd), n_values_imputed AS listed, CASE WHEN odd % 13 = 0 THEN n_values_imputed + 1 ELSE n_values_imputed END AS n_values_imputed,
    CASE WHEN odd % 17 = 0 THEN NOT accepted ELSE accepted END AS accepted
  FROM (SELECT *, day(gap_start) + hour(gap_start) AS odd FROM log))"""


@query("log", "SELECT station, variable, gap_start, method_used FROM bad_log WHERE listed <> n_values_imputed OR accepted <> (n_values_imputed > 0)", _LOG_FAULTS)
def log_integrity(v):
    return postconditions.log_integrity(v.log).select("station", "variable", "gap_start", "method_used")


@query("faulty", "SELECT station, variable, ts FROM faulty WHERE value IS NOT NULL AND variable <> 'DIR_VIENTO' AND NOT coalesce(abs(final - value) <= 1e-8 + 1e-5 * abs(value), false)")
def original_changes(v):
    return postconditions.original_changes(v.faulty).select(*_CELL)


@query("faulty", "SELECT coalesce(a.station, b.station) AS station, coalesce(a.variable, b.variable) AS variable, coalesce(a.ts, b.ts) AS ts, CASE WHEN b.ts IS NULL THEN 'unlogged' ELSE 'phantom' END AS fault FROM (SELECT * FROM faulty WHERE value IS NULL AND after IS NOT NULL) a FULL JOIN (SELECT * FROM faulty WHERE method IS NOT NULL AND n % 89 <> 9) b ON a.station = b.station AND a.variable = b.variable AND a.ts = b.ts WHERE a.ts IS NULL OR b.ts IS NULL")
def unlogged_or_phantom_fills(v):
    """Against a log that lacks some hours."""
    return postconditions.unlogged_or_phantom_fills(v.faulty, provenance.logged_cells(v.sound_log).filter(_hour_number() % 89 != 9))


@query("faulty", "SELECT station, variable, ts FROM faulty WHERE value IS NULL AND after IS NOT NULL AND NOT eligible")
def structural_fills(v):
    return postconditions.structural_fills(v.faulty).select(*_CELL)


@query("faulty", "SELECT station, variable, ts FROM faulty WHERE after = -999")
def range_violations(v):
    return postconditions.range_violations(v.faulty).select(*_CELL)


@query("faulty", "SELECT station, variable, ts FROM faulty WHERE outlier AND (eligible OR NOT coalesce(final = raw OR NOT is_applicable, false) OR starts_with(source, 'imputed_'))")
def outlier_preservation(v):
    return postconditions.outlier_preservation(v.faulty).select(*_CELL)


@query("faulty", "SELECT station, variable, ts, source FROM faulty WHERE (variable, source) NOT IN (SELECT (variable, source) FROM allowed)", ALLOWED)
def source_vocabulary(v):
    return postconditions.source_vocabulary(v.faulty).select(*_CELL, "source")


@query("faulty", "SELECT station, variable, ts FROM faulty WHERE (starts_with(source, 'missing_') AND final IS NOT NULL) OR ((starts_with(source, 'imputed_') OR source IN ('senamhi_observed', 'senamhi_operational_outlier')) AND final IS NULL) OR (source = 'not_applicable' AND variable <> 'DIR_VIENTO')")
def source_value_coherence(v):
    return postconditions.source_value_coherence(v.faulty).select(*_CELL)


@query("faulty", "SELECT station, ts FROM (SELECT station, ts, max(source) FILTER (variable = 'DIR_VIENTO') AS ds, max(final) FILTER (variable = 'DIR_VIENTO') AS d, coalesce(max(final) FILTER (variable = 'VEL_VIENTO') = 0, false) AS calm FROM faulty GROUP BY 1, 2) WHERE calm <> (ds = 'not_applicable') OR (calm AND d IS NOT NULL)")
def calm_coherence(v):
    return postconditions.calm_coherence(v.faulty).select("station", "ts")


@query("grid", "SELECT station, ts, value FROM ext WHERE value IS NOT NULL AND NOT value BETWEEN 0 AND 60", _EXTERNAL)
def external_range(v):
    return postconditions.external_range(v.external, "value")


@query("faulty", "SELECT station, ts FROM faulty WHERE variable = 'DIR_VIENTO' AND starts_with(source, 'imputed_') AND NOT (final >= 0 AND final < 360)")
def canonical_direction(v):
    return postconditions.canonical_direction(v.faulty).select("station", "ts")


# ── external series ──────────────────────────────────────────────────────────────────────────────────────────────────


@query("grid", "SELECT station, ts, PP_IFS AS value FROM ifs", _EXTERNAL)
def normalize_payload(v):
    return external.normalize(v.external)


@query("grid", "SELECT station, ts FROM ext WHERE value IS NULL", _EXTERNAL)
def align_external(v):
    """Hours that the series lacks, where it would be refused."""
    return external.missing_external(v.grid, v.external.filter("value is not null"))


@query("grid", "SELECT station, ts, PP, PP_IFS FROM wide JOIN ifs USING (station, ts)", _EXTERNAL)
def attach_external(v):
    return v.with_external.select("station", "ts", "PP", "PP_IFS")


# ── verification of a product ────────────────────────────────────────────────────────────────────────────────────────


@query("obs", "SELECT station, n_rows, n_hours, first_ts, last_ts FROM (SELECT station, count(*) AS n_rows, count(DISTINCT ts) AS n_hours, min(ts) AS first_ts, max(ts) AS last_ts FROM obs GROUP BY 1), (SELECT min(ts) AS a, max(ts) AS b FROM obs) WHERE n_rows <> date_diff('hour', a, b) + 1 OR n_hours <> date_diff('hour', a, b) + 1 OR first_ts <> a OR last_ts <> b")
def verify_grid(v):
    """On the observations before they are put on the grid, which have holes."""
    return verify.verify_grid(v.obs)


@query("long", "SELECT CAST(ts AS DATE) AS day, count(*) AS n_rows FROM obs WHERE NOT CAST(ts AS DATE) BETWEEN DATE '1999-02-28' AND DATE '2000-02-29' GROUP BY 1")
def verify_age(v):
    return verify.verify_age(v.long, F.lit("2000-02-29").cast("date"), 1)


@query("grid", "SELECT station, ts FROM obs WHERE hour(ts) % 7 = 0")
def verify_key_conservation(v):
    """Against a product that has lost some hours of the day."""
    return verify.verify_key_conservation(v.obs, v.wide.filter("hour(ts) % 7 <> 0"))


_GEO = """
geo AS (SELECT o.station, CASE WHEN hour(ts) = 5 AND o.station = 'S03' THEN -200.0e0 ELSE LATITUD END AS LATITUD, LONGITUD, CASE WHEN o.station = 'S04' THEN 1.0e0 ELSE ALTITUD END AS ALTITUD, DISTRITO, LATITUD AS lat0, ALTITUD AS alt0 FROM obs o JOIN stations s ON o.station = s.station)"""


@query("stations", "SELECT * FROM (SELECT station, count(DISTINCT concat_ws('|', LATITUD, LONGITUD, coalesce(CAST(ALTITUD AS VARCHAR), '-'), DISTRITO)) AS n_tuples, count(*) FILTER (LATITUD < -90) AS n_bad, count(*) FILTER (LATITUD <> lat0 OR ALTITUD IS DISTINCT FROM alt0) AS n_changed FROM geo GROUP BY 1) WHERE n_tuples > 1 OR n_bad > 0 OR n_changed > 0", _GEO)
def verify_georeference(v):
    raw = v.obs.select("station", "ts").join(F.broadcast(v.stations), "station")
    bad = raw.withColumn("LATITUD", F.when((F.hour("ts") == 5) & (F.col("station") == "S03"), -200.0).otherwise(F.col("LATITUD"))).withColumn("ALTITUD", F.when(F.col("station") == "S04", 1.0).otherwise(F.col("ALTITUD")))
    return verify.verify_georeference(bad, raw)


_VALUED = "(starts_with(source, 'imputed_') OR source IN ('senamhi_observed', 'senamhi_operational_outlier'))"


@query("faulty", f"SELECT 'vocabulary' AS fault, count(*) AS n FROM faulty WHERE (variable, source) NOT IN (SELECT (variable, source) FROM allowed) UNION ALL SELECT 'value', count(*) FROM faulty WHERE {_VALUED} <> (final IS NOT NULL) UNION ALL SELECT 'not_applicable', count(*) FROM faulty f LEFT JOIN (SELECT station, ts, final AS speed FROM faulty WHERE variable = 'VEL_VIENTO') s USING (station, ts) WHERE source = 'not_applicable' AND (variable <> 'DIR_VIENTO' OR NOT coalesce(speed = 0, false))", ALLOWED)
def verify_provenance(v):
    return verify.verify_provenance(v.faulty)


_TURN = "coalesce(variable = 'DIR_VIENTO' AND final BETWEEN 0 AND 360 AND raw BETWEEN 0 AND 360 AND least(abs(final - raw) % 360, 360 - abs(final - raw) % 360) <= 1e-9, false)"
_SAME = "coalesce(abs(final - raw) <= 1e-9, false)"


@query("faulty", f"SELECT variable, count(*) AS n_checked, count(*) FILTER ({_SAME}) AS n_equal, count(*) FILTER (NOT {_SAME} AND {_TURN}) AS n_equivalent, count(*) FILTER (NOT {_SAME} AND NOT {_TURN}) AS n_different FROM faulty WHERE source IN ('senamhi_observed', 'senamhi_operational_outlier') GROUP BY 1")
def verify_observations(v):
    return verify.verify_observations(v.faulty)


@query("faulty", "SELECT station, variable, ts, source, CAST(sum(p) AS BIGINT) AS n_product, CAST(sum(l) AS BIGINT) AS n_log FROM (SELECT station, variable, ts, source, 1 AS p, 0 AS l FROM faulty WHERE starts_with(source, 'imputed_') UNION ALL SELECT station, variable, ts, 'imputed_' || method, 0, 1 FROM states WHERE method IS NOT NULL) GROUP BY 1, 2, 3, 4 HAVING sum(p) <> sum(l)")
def verify_log(v):
    return verify.verify_log(v.faulty, v.sound_log)


_COVERAGE = """count(*) FILTER (is_applicable) AS applicable, count(*) FILTER (source = 'senamhi_observed') AS observed, count(*) FILTER (source = 'senamhi_operational_outlier') AS outliers, count(*) FILTER (starts_with(source, 'imputed_')) AS imputed"""
_FINISH = "applicable - observed - outliers AS missing_before, applicable - observed - outliers - imputed AS missing_after, round(CASE WHEN applicable > 0 THEN 100.0e0 * (observed + outliers + imputed) / applicable ELSE 0 END, 6) + 0.0e0 AS coverage_pct"


@query("states", f"SELECT *, {_FINISH} FROM (SELECT variable, {_COVERAGE} FROM states GROUP BY 1)")
def coverage_table(v):
    return verify.coverage_table(v.counts).withColumn("coverage_pct", r("coverage_pct"))


@query("states", f"SELECT *, {_FINISH} FROM (SELECT station, variable, {_COVERAGE} FROM states GROUP BY 1, 2)")
def coverage_by_station(v):
    return verify.coverage_by_station(v.counts).withColumn("coverage_pct", r("coverage_pct"))


@query("grid", "SELECT 'PP_IFS' AS variable, count(*) AS applicable, CAST(NULL AS BIGINT) AS observed, CAST(NULL AS BIGINT) AS imputed, count(*) - count(PP_IFS) AS missing_after, round(100.0e0 * count(PP_IFS) / count(*), 6) + 0.0e0 AS coverage_pct FROM ifs", _EXTERNAL)
def external_coverage_row(v):
    return verify.external_coverage_row(v.with_external).withColumn("coverage_pct", r("coverage_pct"))


@query("states", f"SELECT *, round(100.0e0 * observed / expected, 6) + 0.0e0 AS observed_pct FROM (SELECT station, variable, CAST({_MONTHS} AS DATE) AS month, count(*) FILTER (source IN ('senamhi_observed', 'senamhi_operational_outlier')) AS observed, count(*) FILTER (starts_with(source, 'imputed_')) AS imputed, count(*) FILTER (output_present) AS available, CAST(24 * day(last_day(any_value(ts))) AS BIGINT) AS expected FROM states GROUP BY 1, 2, 3)")
def monthly_coverage(v):
    return verify.monthly_coverage(v.counts).withColumn("observed_pct", r("observed_pct"))


@query("states", "SELECT station, variable, source, count(*) AS n FROM states WHERE starts_with(source, 'imputed_') GROUP BY 1, 2, 3")
def method_counts(v):
    return verify.method_counts(v.counts)


@query("long", "SELECT variable, max(n) AS months FROM (SELECT variable, count(*) AS n FROM (SELECT variable, m - row_number() OVER (PARTITION BY variable ORDER BY m) AS island FROM (SELECT DISTINCT variable, year(ts) * 12 + month(ts) AS m FROM cells WHERE value IS NOT NULL)) GROUP BY variable, island) GROUP BY 1")
def longest_month_run(v):
    return verify.longest_month_run(verify.month_counts(v.long_product.states))


@query("stations", "SELECT station, LATITUD, LONGITUD, ALTITUD, n_rows FROM stations JOIN (SELECT station, count(*) AS n_rows FROM obs GROUP BY 1) USING (station)")
def station_catalog(v):
    return verify.station_catalog(v.obs.select("station", "ts").join(F.broadcast(v.stations), "station"))


@query("grid", "SELECT count(*) AS n_rows, count(PP_IFS) AS n_available, count(*) = count(PP_IFS) AS complete FROM ifs", _EXTERNAL)
def external_availability(v):
    return verify.external_availability(v.with_external)


@query("faulty", f"SELECT * FROM (SELECT variable, 'observed' AS field, CAST(a.observed AS DOUBLE) AS found, CAST(b.observed AS DOUBLE) AS expected FROM (SELECT variable, {_COVERAGE} FROM faulty GROUP BY 1) a JOIN (SELECT variable, {_COVERAGE} FROM states GROUP BY 1) b USING (variable) UNION ALL SELECT variable, 'imputed', CAST(a.imputed AS DOUBLE), CAST(b.imputed AS DOUBLE) FROM (SELECT variable, {_COVERAGE} FROM faulty GROUP BY 1) a JOIN (SELECT variable, {_COVERAGE} FROM states GROUP BY 1) b USING (variable)) WHERE found <> expected")
def compare_reference_table(v):
    return verify.compare_reference_table(verify.coverage_table(verify.month_counts(v.faulty)), verify.coverage_table(v.counts), ["observed", "imputed"])


def _report(v: View, product: DataFrame, log: DataFrame, table: DataFrame) -> DataFrame:
    """The report on a product in published columns, with the stations' metadata."""
    scratch = Scratch(v.spark, "verify")
    raw = scratch.save(v.obs.join(F.broadcast(v.stations), "station"), "raw")
    rows = product.withColumn("ts", F.expr("make_timestamp_ntz(FECHA DIV 10000, (FECHA DIV 100) % 100, FECHA % 100, HORA DIV 10000, 0, 0)")).withColumnRenamed("ESTACION", "station").drop("FECHA", "HORA")
    rows = scratch.save(rows.join(F.broadcast(v.stations), "station"), "product")
    states = scratch.save(verify.product_states(rows, raw, list(VARIABLES)), "states")
    counts = scratch.save(verify.month_counts(states), "counts")
    expected = ["station", "ts", "LATITUD", "LONGITUD", "ALTITUD", "DISTRITO", *VARIABLES, *(f"{x}_SOURCE" for x in VARIABLES)]
    reference = raw.agg(F.max("ts")).first()[0]
    found = verify.product_criteria(rows, raw, log, states, counts, F.lit(reference).cast("date"), expected, 1, table)
    return verify.verification_report(found)


_CRITERIA = ("schema", "keys_unique", "period_and_frequency", "age", "keys_kept", "georeference", "provenance", "observations_kept", "log", "months_with_observations", "reference_table")
_KNOWN = ("applicable", "observed", "outliers", "imputed")


@query("obs", "SELECT criterion, 'CUMPLE' AS status, '0' AS detail FROM (VALUES " + ", ".join(f"('{c}')" for c in _CRITERIA) + ") t(criterion) WHERE (SELECT count(*) FROM obs) >= 0")
def verification_report(v):
    """Every criterion on the product as it is published and read back, which has no faults."""
    path = _folder(v)
    jobs.publish(v.product, path)
    data, log, _ = io.read_curated(v.spark, path)
    log = log.withColumn("accepted", F.col("accepted").cast("boolean"))
    return _report(v, data, log, verify.coverage_table(v.counts).select("variable", *_KNOWN))


_N = "(day(ts) * 24 + hour(ts) + 7 * CAST(substr(station, 2, 2) AS INTEGER))"
_MUTATED = f"""
mut AS (
  SELECT s.*, {_N} AS m,
    CASE WHEN {_N} % 53 = 1 THEN final + 1 WHEN {_N} % 59 = 2 THEN NULL ELSE final END AS mfinal, CASE WHEN {_N} % 71 = 5 THEN 'imputed_unknown' ELSE source END AS msource
  FROM states s WHERE {_N} % 97 <> 3),
hrs AS (SELECT station, ts, max(m) AS m FROM mut GROUP BY 1, 2),
per AS (SELECT station, count(*) AS n, min(ts) AS a, max(ts) AS b FROM hrs GROUP BY 1),
spn AS (SELECT min(ts) AS a, max(ts) AS b FROM hrs),
val AS (SELECT *, starts_with(msource, 'imputed_') OR msource IN ('senamhi_observed', 'senamhi_operational_outlier') AS valued FROM mut),
cov AS (SELECT variable, count(*) FILTER (is_applicable) AS applicable, count(*) FILTER (source = 'senamhi_observed') AS observed, count(*) FILTER (source = 'senamhi_operational_outlier') AS outliers, count(*) FILTER (starts_with(source, 'imputed_')) AS imputed FROM states GROUP BY 1),
mcov AS (SELECT variable, count(*) FILTER (msource <> 'not_applicable') AS applicable, count(*) FILTER (msource = 'senamhi_observed') AS observed, count(*) FILTER (msource = 'senamhi_operational_outlier') AS outliers, count(*) FILTER (starts_with(msource, 'imputed_')) AS imputed FROM mut GROUP BY 1),
faults(criterion, n) AS (
  SELECT 'schema', 0 UNION ALL SELECT 'keys_unique', 0 UNION ALL SELECT 'age', 0 UNION ALL SELECT 'georeference', 0 UNION ALL SELECT 'months_with_observations', 0
  UNION ALL SELECT 'period_and_frequency', count(*) FROM per, spn WHERE n <> date_diff('hour', spn.a, spn.b) + 1 OR per.a <> spn.a OR per.b <> spn.b
  UNION ALL SELECT 'keys_kept', count(*) FROM obs o WHERE NOT EXISTS (SELECT 1 FROM hrs h WHERE h.station = o.station AND h.ts = o.ts)
  UNION ALL SELECT 'provenance', (SELECT CAST(count(*) > 0 AS INTEGER) FROM val WHERE (variable, msource) NOT IN (SELECT (variable, source) FROM allowed))
    + (SELECT CAST(count(*) > 0 AS INTEGER) FROM val WHERE valued <> (mfinal IS NOT NULL))
    + (SELECT CAST(count(*) > 0 AS INTEGER) FROM val d LEFT JOIN (SELECT station, ts, mfinal AS speed FROM val WHERE variable = 'VEL_VIENTO') s USING (station, ts) WHERE msource = 'not_applicable' AND (variable <> 'DIR_VIENTO' OR NOT coalesce(speed = 0, false)))
  UNION ALL SELECT 'observations_kept', count(DISTINCT variable) FROM val WHERE msource IN ('senamhi_observed', 'senamhi_operational_outlier') AND NOT coalesce(abs(mfinal - raw) <= 1e-9, false)
    AND NOT coalesce(variable = 'DIR_VIENTO' AND mfinal BETWEEN 0 AND 360 AND raw BETWEEN 0 AND 360 AND least(abs(mfinal - raw) % 360, 360 - abs(mfinal - raw) % 360) <= 1e-9, false)
  UNION ALL SELECT 'log', count(*) FROM (SELECT station, variable, ts, source FROM (SELECT station, variable, ts, msource AS source, 1 AS p FROM mut WHERE starts_with(msource, 'imputed_') UNION ALL SELECT station, variable, ts, 'imputed_' || method, -1 FROM states WHERE method IS NOT NULL) GROUP BY 1, 2, 3, 4 HAVING sum(p) <> 0)
  UNION ALL SELECT 'reference_table', (SELECT count(*) FROM cov c JOIN mcov m USING (variable), LATERAL (SELECT unnest([c.applicable <> m.applicable, c.observed <> m.observed, c.outliers <> m.outliers, c.imputed <> m.imputed]) AS off) WHERE off))"""


@query("states", "SELECT criterion, CASE WHEN n = 0 THEN 'CUMPLE' ELSE 'NO_CUMPLE' END AS status, CAST(n AS VARCHAR) AS detail FROM faults", ALLOWED, _MUTATED)
def verification_report_faulty(v):
    """The criteria on a product that has lost hours and whose values and sources were changed."""
    at = F.expr("(FECHA % 100) * 24 + HORA DIV 10000") + 7 * F.substring("ESTACION", 2, 2).cast("int")
    wide = grid.to_wide_output(v.states, list(VARIABLES)).withColumn("n", at).filter("n % 97 <> 3")
    changes = {x: F.when(F.col("n") % 53 == 1, F.col(x) + 1).when(F.col("n") % 59 == 2, None).otherwise(F.col(x)) for x in VARIABLES}
    changes |= {f"{x}_SOURCE": F.when(F.col("n") % 71 == 5, "imputed_unknown").otherwise(F.col(f"{x}_SOURCE")) for x in VARIABLES}
    return _report(v, wide.withColumns(changes).drop("n"), v.sound_log, verify.coverage_table(v.counts).select("variable", *_KNOWN))


# ── reading and writing ──────────────────────────────────────────────────────────────────────────────────────────────


def _folder(v: View) -> str:
    return f"{shared_folder(v.spark)}/tables-{uuid.uuid4().hex}"


_VALUES = ", ".join(f"{R(c)} AS {c}" for c in VARIABLES)


@query("obs", f"SELECT station AS ESTACION, year(ts) * 10000 + month(ts) * 100 + day(ts) AS FECHA, hour(ts) * 10000 AS HORA, {_VALUES} FROM obs")
def read_observations(v):
    """The observations as CSV files with a header, read back."""
    path = _folder(v)
    adapters.raw_rows(v.obs).write.csv(path, header=True)
    found = io.read_observations(v.spark, path, list(VARIABLES))
    return found.select("ESTACION", *[F.col(c).cast("long").alias(c) for c in ("FECHA", "HORA")], *[r(c).alias(c) for c in VARIABLES])


def _payloads(v: View, rows: DataFrame) -> DataFrame:
    """Forecast answers, one a station, of rows (station, ts, value)."""
    hours = rows.groupBy("station").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("h")).join(v.stations, "station")
    times = F.transform("h.ts", lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm"))
    return hours.select(
        "station", F.col("LATITUD").alias("latitude"), F.col("LONGITUD").alias("longitude"), F.lit("America/Lima").alias("timezone"),
        F.struct(F.lit("mm").alias("precipitation")).alias("hourly_units"), F.struct(times.alias("time"), F.col("h.value").alias("precipitation")).alias("hourly"),
    )


@query("obs", f"SELECT station, ts, {R('PP')} AS value FROM obs WHERE PP IS NOT NULL")
def read_forecast_payloads(v):
    """Answers as JSON files, one each, read back as rows."""
    path = _folder(v)
    answers = _payloads(v, v.obs.select("station", "ts", F.col("PP").alias("value")).filter("value is not null"))
    answers.select(F.to_json(F.struct(*answers.columns)).alias("answer"), F.col("station").alias("of")).write.partitionBy("of").text(path)
    return external.payload_rows(io.read_forecast_payloads(v.spark, path)).select("station", "ts", r("value").alias("value"))


_FAULTS = {"S03": "timezone", "S04": "unit", "S05": "coordinates", "S06": "lengths", "S07": "missing_field", "S08": "times"}


@query("grid", "SELECT DISTINCT station, CASE station " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in _FAULTS.items()) + " END AS fault FROM wide WHERE station IN (" + ", ".join(f"'{k}'" for k in _FAULTS) + ")")
def payload_faults(v):
    """Answers on the grid of all stations, of which six have a fault each."""
    hours = v.wide.select("station", "ts", F.col("PP").alias("value")).filter("NOT (station = 'S08' AND day(ts) % 3 = 0 AND hour(ts) = 5)")
    at = F.col("station")
    answers = _payloads(v, hours).withColumns({
        "timezone": F.when(at == "S03", "UTC").otherwise(F.col("timezone")),
        "hourly_units": F.struct(F.when(at == "S04", "inch").when(at != "S07", "mm").alias("precipitation")),
        "latitude": F.when(at == "S05", 95.0).otherwise(F.col("latitude")),
        "hourly": F.when(at == "S06", F.struct(F.col("hourly.time").alias("time"), F.slice("hourly.precipitation", 2, 1 << 30).alias("precipitation"))).otherwise(F.col("hourly")),
    })
    return external.payload_faults(answers)


@query("states", "SELECT station AS ESTACION, count(DISTINCT ts) AS n_rows, " + ", ".join(f"count(final) FILTER (variable = '{c}') AS {c}" for c in VARIABLES) + " FROM states GROUP BY 1")
def write_curated(v):
    """The product written with its log and a summary, and its data read back: rows and values by station."""
    path = _folder(v)
    jobs.publish(v.product, path)
    data = io.read_curated(v.spark, path)[0].groupBy("ESTACION").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(c) for c in VARIABLES])
    return data


@query("obs", "SELECT station, length(line) AS bytes, sha256(line) AS sha256 FROM (SELECT station, concat(station, ' ', count(*), ' ', max(ts), chr(10)) AS line FROM obs GROUP BY 1)")
def artifact_manifest(v):
    """A file for each station with its count of rows and last hour."""
    path = _folder(v)
    lines = v.obs.groupBy("station").agg(F.concat_ws(" ", "station", F.count(F.lit(1)), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss")).alias("line"))
    lines.write.partitionBy("station").text(path)
    return io.artifact_manifest(v.spark, [path]).select(F.regexp_extract("path", "station=([^/]+)/", 1).alias("station"), "bytes", "sha256")


@query()
def write_report_tables(v):
    """The totals by method as a CSV table, read back."""
    path, totals = _folder(v), method_totals(v)
    io.write_report_tables({"method_totals": (totals, totals.columns)}, path)
    return v.spark.read.csv(f"{path}/method_totals", schema=totals.schema, header=True)


_SQL["write_report_tables"] = _SQL["method_totals"]


def _with_cells(faults: list[str], rows: DataFrame) -> DataFrame:
    """Each fault with the number of values in the columns that it names."""
    named = [[c for c in rows.columns if c in re.findall(r"\w+", x)] for x in faults]
    n = [sum((F.count(c) for c in own), F.lit(0).cast("long")) for own in named]
    return rows.agg(F.array(*[F.struct(F.lit(x).alias("fault"), k.alias("n_values")) for x, k in zip(faults, n, strict=True)]).alias("f")).select(F.inline("f"))


@query("dirty", "SELECT 'unknown column row_id' AS fault, count(row_id) AS n_values FROM dirty UNION ALL SELECT 'measurements [''PM2_5''] where [''PM2_5'', ''TEMP''] are expected', count(PM2_5) FROM dirty")
def check_columns(v):
    """Faults of the raw table's columns, and how many values they concern."""
    return _with_cells(contract.check_columns(v.dirty, ["PM2_5", "TEMP"]), v.dirty)


@query("grid", "SELECT 'missing ALTITUD' AS fault, CAST(0 AS BIGINT) AS n_values UNION ALL SELECT 'unexpected source_row', count(source_row) FROM wide")
def verify_schema(v):
    """Columns that the grid lacks or has too many, and how many values they hold."""
    return _with_cells(verify.verify_schema(v.wide, ["station", "ts", *VARIABLES, "ALTITUD"]), v.wide)


_WHOLE_PIVOT = ", ".join(f"round(max(final) FILTER (variable = '{x}'), 4) + 0.0e0 AS {x}, max(source) FILTER (variable = '{x}') AS {x}_SOURCE" for x in VARIABLES)


@query("whole", f"SELECT station AS ESTACION, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INTEGER) AS FECHA, CAST(hour(ts) * 10000 AS INTEGER) AS HORA, {_WHOLE_PIVOT} FROM states GROUP BY station, ts")
def curate_product(v):
    """The whole job: every station and hour with values and sources of all variables, neighbours included."""
    return grid.to_wide_output(v.whole.states, list(VARIABLES)).withColumns({x: r(x, 4) for x in VARIABLES})


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each station and variable after filling."""
    return _QUERIES["coverage_by_station"](spark, sf_dir)
