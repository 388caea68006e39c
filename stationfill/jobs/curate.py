"""Jobs: curate a product, log it, publish it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationfill.functions.rules import SCALARS, VARIABLES, CurationConfig
from stationfill.operators import fill, log, neighbors, postconditions, provenance, quality, reports, wind
from stationfill.operators.grid import hourly_grid, reindex_to_grid, to_wide_output
from stationfill.sources import io
from stationfill.sources.scratch import Scratch


@dataclass
class Product:
    """The stages of a curation, each a written table: states, log, reports and post-conditions read them, and nothing is computed twice."""

    cells: DataFrame
    states: DataFrame
    scalars: DataFrame
    wind: DataFrame | None
    attempts: DataFrame | None = None
    wind_attempts: DataFrame | None = None
    scratch: Scratch | None = None

    def drop(self) -> None:
        """Remove the stages; the product can't be read any more."""
        if self.scratch is not None:
            self.scratch.drop("cells", "candidates", "scalars", "scalars-near", "wind", "wind-filled", "states")


def cells_of(obs: DataFrame, variables: tuple[str, ...] | None = None, dealt: int | None = None) -> DataFrame:
    """Classified cells on the global grid of a view (station, ts, one column a variable).

    Spans come from the observations, not from the grid: a row a series, joined to its cells.
    """
    variables = list(variables or [v for v in VARIABLES if v in obs.columns])
    wide = reindex_to_grid(obs, hourly_grid(obs), dealt)
    spans = quality.observed_span(quality.classify(obs.withColumn("source_row", F.lit(True)), variables))
    return quality.with_eligibility(quality.classify(wide, variables), spans)


def curate(obs: DataFrame, config: CurationConfig = CurationConfig(), stations: DataFrame | None = None) -> Product:
    """Fill a view by the cascade: short gaps, same hours of other weeks, the adjacent year and, given stations, near stations.

    Hours that stay empty after the series' own evidence go to the neighbours; the evidence is always what was observed.
    Series that were never seen take no part in any window. Each stage is written once, into the shared folder; with
    `station_buckets` in buckets by station, so that after the grid's join no window has an exchange.
    """
    scratch, dealt = Scratch(obs.sparkSession, "curate"), config.station_buckets
    save = partial(scratch.save_dealt, key="station", parts=dealt) if dealt else scratch.save
    cells = save(cells_of(obs, dealt=dealt), "cells")
    seen = cells.filter("span_start is not null")
    policy = dict(short_gap_hours=config.short_gap_hours, n_weeks=config.weekly_n_weeks, min_donors=config.min_weekly_donors, piece_hours=config.piece_hours)
    own = fill.own_candidates(seen.filter(F.col("variable").isin(*SCALARS)), **policy, zero_for="PP" if config.pp_short_method == "zero" else None)
    scalars = save(fill.merged_temporal(save(own, "candidates")), "scalars")
    attempts = wind_attempts = filled = None
    if stations is not None:
        attempts = neighbors.fill_from_neighbors(scalars, scalars.filter("is_gap AND after IS NULL"), stations, config)
        found = attempts.filter("accepted").select("station", "variable", "ts", F.col("value").alias("near"))
        method = F.when(F.col("near").isNotNull(), neighbors.METHOD).otherwise(F.col("method"))
        scalars = scalars.join(found, ["station", "variable", "ts"], "left").withColumns({"method": method, "after": F.coalesce("after", "near")}).drop("near")
        scalars = save(scalars, "scalars-near")
    if {"DIR_VIENTO", "VEL_VIENTO"} <= set(obs.columns):
        vector = wind.vectors(seen)
        sources = [("short_vector_linear", "short"), ("weekly_vector_seasonal", "weekly")]
        runs = save(wind.candidates(vector, **policy), "wind")
        open_hours = wind.merge(runs, sources).filter("is_gap AND method IS NULL")
        runs = runs.join(wind.cross_year_vectors(runs, open_hours), ["station", "ts"], "left")
        sources.append(("cross_year_vector_analog", "year"))
        if stations is not None:
            empty = wind.merge(runs, sources).filter("is_gap AND method IS NULL")
            wind_attempts = neighbors.fill_wind_from_neighbors(runs, empty, stations, config)
            runs = runs.join(wind_attempts.filter("accepted").select("station", "ts", "near_u", "near_v"), ["station", "ts"], "left")
            sources.append(("interstation_vector_regression", "near"))
        filled = save(wind.compose_fields(wind.merge(runs, sources)), "wind-filled")
    after = provenance.filled_cells(scalars, filled, seen) if filled is not None else scalars.withColumn("calm", F.lit(False)).select(*provenance.FILLED)
    states = save(provenance.cell_states(after.unionByName(provenance.never_seen(cells))), "states")
    return Product(cells, states, scalars, filled, attempts, wind_attempts, scratch)


def imputation_log(product: Product, config: CurationConfig = CurationConfig()) -> DataFrame:
    """The log of a product in its published columns: scalars and, where there is wind, its fields and vectors.

    `config` is that of the product.
    """
    rows = log.scalar_log(product.scalars, product.attempts, config)
    return rows if product.wind is None else rows.unionByName(log.wind_log(product.wind, product.wind_attempts, config))


def publish(product: Product, path: str, config: CurationConfig = CurationConfig()) -> None:
    """Test a product by its post-conditions, the log among them, and write data, log and summary; a breach writes nothing."""
    scratch = Scratch(product.states.sparkSession, "publish")
    states, written = product.states, scratch.save(imputation_log(product, config), "log")
    there = {r[0] for r in states.select("variable").distinct().collect()}
    wide = to_wide_output(states, [v for v in VARIABLES if v in there])
    try:
        postconditions.assert_postconditions(states, wide, provenance.logged_cells(written), written)
        io.write_curated(wide, written, reports.execution_summary(states), path)
    finally:
        scratch.drop("log")
