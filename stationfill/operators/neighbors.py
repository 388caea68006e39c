"""Other stations as evidence: distances, pair models with time-ordered validation, and the cascade over near stations in rounds."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stationfill.functions.expressions import EARTH_RADIUS_KM, distance_km
from stationfill.functions.rules import RULES, CurationConfig
from stationfill.operators.wind import VECTOR
from stationfill.sources.scratch import Scratch

METHOD = "interstation_regression"
PAIR = ["variable", "station", "neighbor"]


# ── near stations ────────────────────────────────────────────────────────────────────────────────────────────────────


def _cells(df: DataFrame, edge: float) -> DataFrame:
    """Columns cx, cy, cz: the cube of this edge that holds the station's point on the unit sphere."""
    lat, lon = F.radians("lat"), F.radians("lon")
    at = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    return df.withColumns({name: F.floor(c / edge).cast("long") for name, c in zip(("cx", "cy", "cz"), at, strict=True)})


def rank_neighbors(stations: DataFrame, k: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(station, neighbor, distance_km, rank) from near to far, ties by name; stations without coordinates have none.

    Exact at every size, without broadcast. For `k` neighbours stations meet in cubes around points on the sphere, so
    neither a pole nor longitude 180 parts them; the cubes grow for those whose k-th distance isn't below the edge. Without
    `k` every pair is wanted, which is as long as it is wide. With `targets` (station) only those get neighbours.
    """
    own = stations.select("station", F.col("LATITUD").alias("lat"), F.col("LONGITUD").alias("lon")).filter("lat is not null and lon is not null")
    left = own if targets is None else own.join(targets, "station", "left_semi")
    twin = {"station": "neighbor", "lat": "lat2", "lon": "lon2"}
    order = W.partitionBy("station").orderBy("distance_km", "neighbor")
    n = own.count()

    def ranked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter("station <> neighbor").select("station", "neighbor", distance_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("distance_km"))
        return pairs.withColumn("rank", F.row_number().over(order))

    def all_pairs(some: DataFrame) -> DataFrame:
        parts = min(64, 1 + n // 1000)
        other = own.withColumnsRenamed(twin).withColumn("part", F.pmod(F.xxhash64("neighbor"), F.lit(parts)).cast("int"))
        return ranked(some.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(other.hint("merge"), "part"))

    if not k or k >= n - 1:
        return all_pairs(left)
    edge = min(2.0, math.sqrt(4 * math.pi * k / max(n, 1)))
    while edge > 1e-7 and n > 8 * k + 64:
        most = _cells(own, edge).groupBy("cx", "cy", "cz").count().agg(F.max("count")).first()[0]
        if most <= 8 * k + 64:
            break
        edge /= 4
    scratch, found = Scratch(stations.sparkSession, "near"), []
    while edge < 2:
        step = lambda c: F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)]))
        wide = _cells(left, edge)
        for c in ("cx", "cy", "cz"):
            wide = wide.withColumn(c, step(c))
        near = ranked(wide.join(_cells(own, edge).withColumnsRenamed(twin).hint("merge"), ["cx", "cy", "cz"])).filter(F.col("rank") <= k)
        # all that is nearer than an edge (a chord) lies in the adjacent cubes
        reach = 2 * EARTH_RADIUS_KM * math.asin(edge / 2) * (1 - 1e-6)
        near = scratch.save(near, f"round{len(found)}")
        done = near.filter((F.col("rank") == k) & (F.col("distance_km") < reach)).select("station")
        found.append(near.join(done, "station", "left_semi"))
        left = scratch.save(left.join(done, "station", "left_anti"), f"left{len(found)}")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
        edge *= 4
    return reduce(DataFrame.unionByName, [*found, all_pairs(left).filter(F.col("rank") <= k)])


# ── models ───────────────────────────────────────────────────────────────────────────────────────────────────────────


def known_hours(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(variable, station, ts) and the columns under their new names, where all of them are there."""
    known = rows.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    return known.select("variable", "station", "ts", *[F.col(c).alias(name) for c, name in columns.items()])


def training_pairs(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """(variable, station, neighbor, ts, y, x) of the hours that both observed; an equi-join on the hour for each pair (station, neighbor, and variable if it is there)."""
    return _common_hours(known_hours(cells, {"value": "y"}), known_hours(cells, {"value": "x"}), pairs)


def wind_pairs(vector: DataFrame, pairs: DataFrame) -> DataFrame:
    """As training_pairs, with the target's y1, y2 and the neighbour's x1, x2."""
    return _common_hours(known_hours(vector, {"u": "y1", "v": "y2"}), known_hours(vector, {"u": "x1", "v": "x2"}), pairs)


def _common_hours(own: DataFrame, other: DataFrame, pairs: DataFrame) -> DataFrame:
    wanted = pairs.select(*[c for c in PAIR if c in pairs.columns])
    target = own.join(wanted, [c for c in ("variable", "station") if c in wanted.columns])
    return target.join(other.withColumnRenamed("station", "neighbor"), ["variable", "neighbor", "ts"])


def with_segments(pairs: DataFrame, splits: int) -> DataFrame:
    """n, k, and seg: 0 for the hours no fold tests, j for those that fold j tests; folds are equal runs at the end of the time order."""
    own = W.partitionBy(*PAIR)
    p = pairs.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rn", F.row_number().over(own.orderBy("ts")) - 1)
    p = p.withColumn("k", F.least(F.lit(splits), F.col("n") - 1)).withColumn("size", F.floor(F.col("n") / (F.col("k") + 1)))
    first = F.col("n") - F.col("k") * F.col("size")
    return p.withColumn("seg", F.when(F.col("rn") < first, 0).otherwise(1 + F.floor((F.col("rn") - first) / F.col("size"))).cast("int"))


class _Moments:
    """Count, means and centred co-moments of named columns: of a group of rows, or merged from an array of such moments.

    Co-moments are about the group's own means and merged pairwise, so a large common offset costs no digits.
    """

    def __init__(self, names: list[str]):
        self.names = names
        self.pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]

    @staticmethod
    def c(a: str, b: str) -> str:
        return f"c_{min(a, b)}_{max(a, b)}"

    def of_rows(self) -> list[Column]:
        n = F.count(F.lit(1))
        return [n.alias("m"), *[F.avg(a).alias(f"m_{a}") for a in self.names], *[(F.covar_pop(a, b) * n).alias(self.c(a, b)) for a, b in self.pairs]]

    def as_struct(self) -> Column:
        return F.struct("m", *[f"m_{a}" for a in self.names], *[self.c(a, b) for a, b in self.pairs])

    def merged(self, df: DataFrame, parts: str, prefix: str) -> DataFrame:
        """Columns of the moments under a prefix; null where the array is empty."""
        total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["m"])
        df = df.withColumn(f"{prefix}m", F.when(F.size(parts) > 0, total))
        mean = lambda a: F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["m"] * p[f"m_{a}"]) / F.col(f"{prefix}m")
        df = df.withColumns({f"{prefix}m_{a}": mean(a) for a in self.names})

        def about(a: str, b: str) -> Column:
            x, y = F.col(f"{prefix}m_{a}"), F.col(f"{prefix}m_{b}")
            return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p[self.c(a, b)] + p["m"] * (p[f"m_{a}"] - x) * (p[f"m_{b}"] - y))

        return df.withColumns({f"{prefix}{self.c(a, b)}": about(a, b) for a, b in self.pairs})


def _coefficients(prefix: str, xs: list[str], y: str) -> list[Column]:
    """Least squares of y by xs (one or two) from centred co-moments, of least norm where they are dependent."""
    c = lambda a, b: F.col(prefix + _Moments.c(a, b))
    if len(xs) == 1:
        return [F.when(c(*xs, *xs) > 0, c(*xs, y) / c(*xs, *xs)).otherwise(F.lit(0.0))]
    s11, s12, s22, t1, t2 = c(xs[0], xs[0]), c(*xs), c(xs[1], xs[1]), c(xs[0], y), c(xs[1], y)
    root = F.sqrt((s11 - s22) * (s11 - s22) + 4 * s12 * s12)
    high, low, det = (s11 + s22 + root) / 2, (s11 + s22 - root) / 2, s11 * s22 - s12 * s12  # eigenvalues of the predictors
    whole = [(s22 * t1 - s12 * t2) / det, (s11 * t2 - s12 * t1) / det]
    # of rank one, a symmetric matrix divided by its eigenvalue's square is its pseudoinverse
    line = [(s11 * t1 + s12 * t2) / (high * high), (s12 * t1 + s22 * t2) / (high * high)]
    return [F.when(low > 1e-10 * high, a).when(high > 0, b).otherwise(F.lit(0.0)) for a, b in zip(whole, line, strict=True)]


def fit_models(pairs: DataFrame, xs: list[str], ys: list[str], splits: int = 5, least: int = 48) -> DataFrame:
    """A row a pair: training_pairs, coefficients b_<y>_<x>, intercepts a_<y>, and r2, the mean over outputs and folds in time order.

    Rows of a pair are read once, for the moments of at most splits + 1 segments. A fold's model comes from the merged
    moments of the segments before it, and its errors from the moments of its own. Fewer than `least` pairs give no model: all
    but their number is null.
    """
    mo = _Moments([*xs, *ys])
    parts = with_segments(pairs, splits).groupBy(*PAIR, "seg").agg(*mo.of_rows(), F.first("n").alias("n"), F.first("k").alias("k"))
    before = F.collect_list(mo.as_struct()).over(W.partitionBy(*PAIR).orderBy("seg").rowsBetween(W.unboundedPreceding, -1))
    tested = mo.merged(parts.withColumn("before", before), "before", "b_")
    # in steps of columns, so that no expression is written out twice
    tested = tested.withColumns(dict(zip([f"k_{y}_{x}" for y in ys for x in xs], [k for y in ys for k in _coefficients("b_", xs, y)], strict=True)))
    own = lambda p, q: F.col(mo.c(p, q))
    coefficient = lambda y, x: F.col(f"k_{y}_{x}")
    off = lambda y: F.col(f"m_{y}") - F.col(f"b_m_{y}") - sum(coefficient(y, x) * (F.col(f"m_{x}") - F.col(f"b_m_{x}")) for x in xs)
    tested = tested.withColumns({f"off_{y}": off(y) for y in ys})
    spread = lambda y: sum(coefficient(y, x) * coefficient(y, z) * own(x, z) for x in xs for z in xs) - sum(2 * coefficient(y, x) * own(x, y) for x in xs)
    tested = tested.withColumns({f"sse_{y}": F.greatest(F.lit(0.0), own(y, y) + F.col("m") * F.col(f"off_{y}") * F.col(f"off_{y}") + spread(y)) for y in ys})
    score = lambda y: F.when(own(y, y) > 0, 1 - F.col(f"sse_{y}") / own(y, y)).otherwise(F.when(F.col(f"sse_{y}") == 0, 1.0).otherwise(0.0))
    whole = tested.withColumn("score", F.when(F.col("seg") > 0, sum(score(y) for y in ys) / len(ys))).groupBy(*PAIR).agg(F.first("n").alias("n"), F.first("k").alias("k"), F.avg("score").alias("r2"), F.collect_list(mo.as_struct()).alias("parts"))
    whole, enough = mo.merged(whole, "parts", "w_"), (F.col("n") >= least) & (F.col("k") >= 2)
    whole = whole.withColumns({f"b_{y}_{x}": F.when(enough, k) for y in ys for x, k in zip(xs, _coefficients("w_", xs, y), strict=True)})
    intercepts = [(F.col(f"w_m_{y}") - sum(F.col(f"b_{y}_{x}") * F.col(f"w_m_{x}") for x in xs)).alias(f"a_{y}") for y in ys]
    return whole.select(*PAIR, F.col("n").alias("training_pairs"), F.when(enough, F.col("r2")).alias("r2"), *[f"b_{y}_{x}" for y in ys for x in xs], *intercepts)


def fit_station_models(pairs: DataFrame, splits: int = 5, least: int = 48) -> DataFrame:
    """(variable, station, neighbor, training_pairs, slope, intercept, r2) of y by x; of a pair with too few hours only their number."""
    return fit_models(pairs, ["x"], ["y"], splits, least).withColumnsRenamed({"b_y_x": "slope", "a_y": "intercept"})


def fit_wind_models(pairs: DataFrame, splits: int = 5, least: int = 48) -> DataFrame:
    """Linear models of (u, v) by a neighbour's (u, v): coefficients row by row, intercepts, and r2 as the mean of both outputs over folds."""
    names = {"b_y1_x1": "u_by_u", "b_y1_x2": "u_by_v", "b_y2_x1": "v_by_u", "b_y2_x2": "v_by_v", "a_y1": "u_base", "a_y2": "v_base"}
    return fit_models(pairs, ["x1", "x2"], ["y1", "y2"], splits, least).withColumnsRenamed(names)


# ── the cascade ──────────────────────────────────────────────────────────────────────────────────────────────────────

_LOG = (
    "station string, variable string, gap_start timestamp_ntz, ts timestamp_ntz, neighbor string, distance_km double, accepted boolean, "
    "rejection_reason string, value double, r2 double, training_pairs long, predictor_coverage double, slope double, intercept double"
)
_WIND_LOG = (
    "station string, variable string, gap_start timestamp_ntz, ts timestamp_ntz, neighbor string, accepted boolean, rejection_reason string, near_u double, near_v double, "
    "r2 double, predictor_coverage double, distance_km double, training_pairs long, model_intercept string, model_coefficient string"
)


def _names(kinds: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in kinds.split(",")]


def rounds(most: int) -> Iterator[tuple[int, int]]:
    """First and last rank of each round, up to `most`: few at first, where most gaps end, and never over 32, so that no group of a gap is large."""
    low, widths = 0, [4, 12]
    while low < most:
        width = widths.pop(0) if widths else 32
        high = most if most - low <= 16 else min(most, low + width)
        yield low + 1, high
        low = high


def in_rounds(known: DataFrame, empty: DataFrame, stations: DataFrame, config: CurationConfig, fit: Callable, attempt: Callable, kinds: str) -> DataFrame:
    """Attempts of all rounds: each asks the next few near stations for the hours still empty, and drops what it fills.

    `known` is (variable, station, ts) and predictors of all stations; `empty` holds the hours (station, variable,
    gap_start, ts). A round ranks neighbours for stations with empty hours only, and `fit` (of pairs variable, station,
    neighbor) makes models only for those near stations that know one of the hours asked for. A group is a gap times a
    round's stations. Rounds end when nothing is empty or no station is left; each is a written table.
    """
    spark = known.sparkSession
    scratch = Scratch(spark, "cascade")
    stations = scratch.save(stations.select("station", "LATITUD", "LONGITUD"), "stations")
    most = max(0, stations.filter("LATITUD is not null and LONGITUD is not null").count() - 1)
    most = min(config.neighbors or most, most)
    other = known.withColumnRenamed("station", "neighbor")
    cell, found, left = ["station", "variable", "ts"], [], empty
    for low, high in rounds(most):
        if left.isEmpty():
            break
        near = rank_neighbors(stations, high, left.select("station").distinct()).filter(F.col("rank").between(low, high))
        asked = scratch.save(left.join(near, "station").join(other, ["variable", "neighbor", "ts"], "left"), f"asked-{low}")
        first = [c for c in known.columns if c not in cell][0]
        models = fit(asked.filter(F.col(first).isNotNull()).select(*PAIR).distinct())
        tried = asked.join(models, PAIR, "left").groupBy("station", "variable", "gap_start").applyInPandas(attempt, kinds)
        found.append(scratch.save(tried, f"tried-{low}"))
        scratch.drop(f"asked-{low}")
        left = empty.join(reduce(DataFrame.unionByName, found).filter("accepted").select(*cell), cell, "left_anti")
    scratch.drop("stations")
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kinds)


def _by_rank(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """The hours of a gap, the order of its rows by rank and hour (every rank has every hour once), and a row for each rank."""
    order = np.lexsort((rows["ts"].to_numpy(), rows["rank"].to_numpy()))
    ts = np.unique(rows["ts"].to_numpy())
    return ts, order, rows.iloc[order[:: len(ts)]]


def _number(m) -> int:
    """The common hours of a pair; without a row there are none."""
    return 0 if np.isnan(m.training_pairs) else int(m.training_pairs)


def cascade(config: CurationConfig):
    """For the hours of one gap: near stations in order, each filling what it can of the hours still empty; every attempt is a row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ts, order, near = _by_rank(rows)
        x = rows["x"].to_numpy(dtype=float)[order].reshape(len(near), len(ts))
        first, out = rows.iloc[0], []
        low, high = RULES[first["variable"]][2:]
        empty = np.ones(len(ts), bool)
        for k, m in enumerate(near.itertuples()):
            if not empty.any():
                break
            there = ~np.isnan(x[k]) & empty
            coverage = there.sum() / empty.sum()
            facts, good, reason = (m.r2, _number(m), m.slope, m.intercept), np.zeros(len(ts), bool), None
            if coverage < config.predictor_min_gap_coverage:
                reason, facts = "insufficient_gap_coverage", (None,) * 4
            elif np.isnan(m.slope) or np.isnan(m.r2):
                reason, facts = "insufficient_training_pairs_or_cv", (None, _number(m), None, None)
            elif m.r2 < config.interstation_min_r2:
                reason = "r2_below_threshold"
            elif not there.any():
                continue
            else:
                value = m.intercept + m.slope * x[k]
                good = there & (value >= low) & (value <= high)
                reason = None if good.any() else "predictions_out_of_range"
            r2, pairs, slope, intercept = facts
            made = zip(ts[good], value[good], strict=True) if reason is None else [(None, None)]
            out += [(first["station"], first["variable"], first["gap_start"], t, m.neighbor, m.distance_km, reason is None, reason, v, r2, pairs, coverage, slope, intercept) for t, v in made]
            empty &= ~good
        return pd.DataFrame(out, columns=_names(_LOG))

    return run


def fill_from_neighbors(cells: DataFrame, empty: DataFrame, stations: DataFrame, config: CurationConfig) -> DataFrame:
    """Attempts and filled hours (columns of the attempt, ts and value where accepted) for the hours `empty` (station, variable, gap_start, ts)."""
    known = known_hours(cells, {"value": "x"})

    def fit(pairs: DataFrame) -> DataFrame:
        return fit_station_models(training_pairs(cells, pairs), config.interstation_cv_splits, config.min_training_pairs)

    return in_rounds(known, empty.select("station", "variable", "gap_start", "ts"), stations, config, fit, cascade(config), _LOG)


def wind_cascade(config: CurationConfig):
    """As `cascade` for vectors: hours whose calm candidate an observed field denies are refused, and go on to the next station."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ts, order, near = _by_rank(rows)
        x1, x2, directions, speeds = (rows[c].to_numpy(dtype=float)[order].reshape(len(near), len(ts)) for c in ("x1", "x2", "direction", "speed"))
        d, s, first, out = directions[0], speeds[0], rows.iloc[0], []
        empty = np.ones(len(ts), bool)
        for k, m in enumerate(near.itertuples()):
            if not empty.any():
                break
            there = ~np.isnan(x1[k]) & empty
            coverage, good, reason, refused = there.sum() / empty.sum(), np.zeros(len(ts), bool), None, [None]
            facts, r2 = (coverage, m.distance_km, None, None, None), None
            if coverage >= config.predictor_min_gap_coverage:
                facts = (coverage, m.distance_km, _number(m), None, None)
                if not np.isnan(m.r2):
                    r2, slopes = m.r2, [[m.u_by_u, m.u_by_v], [m.v_by_u, m.v_by_v]]
                    facts = (*facts[:3], json.dumps([m.u_base, m.v_base]), json.dumps(slopes))
            if coverage < config.predictor_min_gap_coverage:
                reason = "insufficient_gap_coverage"
            elif np.isnan(m.r2):
                reason = "insufficient_training_pairs_or_cv"
            elif m.r2 < config.interstation_min_r2:
                reason = "r2_below_threshold"
            else:
                u, v = m.u_base + m.u_by_u * x1[k] + m.u_by_v * x2[k], m.v_base + m.v_by_u * x1[k] + m.v_by_v * x2[k]
                size = np.hypot(u, v)
                calm = size <= 16 * 2.0**-52 * np.maximum(1, size)
                clash = calm & ((~np.isnan(d) & np.isnan(s)) | ((s > 0) & np.isnan(d)))
                valid = there & (size <= RULES["VEL_VIENTO"][3])
                good = valid & ~clash
                out += [(first["station"], VECTOR, first["gap_start"], t, m.neighbor, True, None, a, b, r2, *facts) for t, a, b in zip(ts[good], u[good], v[good], strict=True)]
                if (valid & clash).any():
                    refused = ts[valid & clash]
                    reason = "calm_candidate_conflicts_with_observed_component"
                elif not valid.any():
                    reason = "predictions_out_of_range"
            if reason:
                out += [(first["station"], VECTOR, first["gap_start"], t, m.neighbor, False, reason, None, None, r2, *facts) for t in refused]
            empty &= ~good
        return pd.DataFrame(out, columns=_names(_WIND_LOG))

    return run


def fill_wind_from_neighbors(vector: DataFrame, empty: DataFrame, stations: DataFrame, config: CurationConfig) -> DataFrame:
    """Attempts and filled hours for empty hours (station, variable, gap_start, ts, direction, speed), by the wind cascade.

    Accepted hours and those refused over a calm have their ts; other refusals are one row for a near station. Coefficients
    are JSON, a row for each of u and v.
    """
    known = known_hours(vector, {"u": "x1", "v": "x2"})

    def fit(pairs: DataFrame) -> DataFrame:
        return fit_wind_models(wind_pairs(vector, pairs), config.interstation_cv_splits, config.min_training_pairs)

    return in_rounds(known, empty.select("station", "variable", "gap_start", "ts", "direction", "speed"), stations, config, fit, wind_cascade(config), _WIND_LOG)
