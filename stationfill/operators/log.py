"""The imputation log: a row for each contribution to a gap and each refused attempt, in the published columns.

Every row comes from one aggregate over the hours of a gap, so a group is never longer than a gap. Hours are text,
sorted and parted by bars. Of a model that lacks hours for its fit only their number is told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationfill.functions.rules import DIRECTION, LOG_COLUMNS, SPEED, CurationConfig
from stationfill.operators.wind import VECTOR, conflict

GAP = ("station", "variable", "gap_start", "gap_end", "n_steps")
CONFLICT = "calm_candidate_conflicts_with_observed_component"
_TYPES = {
    "gap_start": "timestamp_ntz", "gap_end": "timestamp_ntz", "accepted": "boolean",
    **dict.fromkeys(("n_steps", "duration_h", "n_values_imputed", "n_values_remaining", "training_pairs", "n_donors"), "long"),
    **dict.fromkeys(("interstation_r2", "distance_km", "predictor_coverage", "acceptance_threshold"), "double"),
}
#: Facts of a model, by their names in the attempts over near stations.
_FACTS = {"interstation_r2": "r2", "distance_km": "distance_km", "predictor_coverage": "predictor_coverage", "training_pairs": "training_pairs"}


def hours_text(when: Column, ts: str = "ts") -> Column:
    """The hours of a group for which `when` holds; an empty text if there are none."""
    hours = F.array_sort(F.collect_list(F.when(when, F.col(ts))))
    return F.array_join(F.transform(hours, lambda t: F.replace(t.cast("string"), F.lit(" "), F.lit("T"))), "|")


def published(rows: DataFrame) -> DataFrame:
    """The log's columns in order; what a method has no value for is null."""
    rows = rows.withColumn("duration_h", F.col("n_steps"))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in LOG_COLUMNS])


def _row(there: Column, method: str | Column, accepted: Column, reason: Column, n: Column, hours: Column, remaining: Column, **more: Column) -> Column:
    """A log row as a struct, or null where it isn't due."""
    more = {"n_donors": F.lit(None), "rejected_timestamps": F.lit(None), "variable": F.col("variable")} | more
    fields = {"method_used": F.lit(method), "accepted": accepted, "rejection_reason": reason, "n_values_imputed": n, "imputed_timestamps": hours, "n_values_remaining": remaining} | more
    return F.when(there, F.struct(*[c.cast(_TYPES.get(k, "string")).alias(k) for k, c in fields.items()]))


def _rows(gaps: DataFrame, made: list[Column]) -> DataFrame:
    key = [c for c in GAP if c != "variable"]
    return gaps.select(*key, F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))


def scalar_log(scalars: DataFrame, attempts: DataFrame | None, config: CurationConfig) -> DataFrame:
    """Rows of the scalar series: the short method of every short gap, what other weeks, the adjacent year and near stations gave, and what is left."""
    no, yes, none, zero = F.lit(False), F.lit(True), F.lit(None).cast("string"), F.lit(0)
    by = {"short": F.col("method").isin("short_linear", "short_zero"), "weekly": F.col("method") == "weekly_seasonal", "year": F.col("method") == "cross_year_analog"}
    both_zero = (F.col("variable") == "PP") & (F.col("left_value") == 0) & (F.col("right_value") == 0)
    gaps = scalars.filter("is_gap").groupBy(*GAP).agg(
        F.count_if(F.col("after").isNull()).alias("left"), F.max(F.coalesce(both_zero, no)).alias("both_zero"), F.min("n_donors").alias("donors"),
        *[F.count_if(F.coalesce(c, no)).alias(f"n_{k}") for k, c in by.items()], *[hours_text(c).alias(f"hours_{k}") for k, c in by.items()])
    n = {k: F.col(f"n_{k}") for k in by}
    is_zero = F.col("both_zero") if config.pp_short_method == "zero" else no
    short = F.when(is_zero, "short_zero").otherwise("short_linear")
    rows = _rows(gaps, [
        _row(F.col("n_steps") <= config.short_gap_hours, short, n["short"] > 0, F.when(n["short"] == 0, "missing_valid_anchors"), n["short"], F.col("hours_short"), F.col("n_steps") - n["short"]),
        _row(n["weekly"] > 0, "weekly_seasonal", yes, none, n["weekly"], F.col("hours_weekly"), F.col("left"), n_donors=F.col("donors")),
        _row(n["year"] > 0, "cross_year_analog", yes, none, n["year"], F.col("hours_year"), F.col("left"), n_donors=F.lit(1)),
        _row(F.col("left") > 0, "unimputable", no, F.lit("no_method_available"), zero, none, F.col("left")),
    ])
    if attempts is None:
        return published(rows)
    done = F.col("accepted")
    facts = [F.first(c).alias(k) for k, c in _FACTS.items()] + [F.first("intercept").alias("model_intercept"), F.first("slope").alias("model_coefficient")]
    key = ["station", "variable", "gap_start"]
    near = attempts.groupBy(*key, F.col("neighbor").alias("source_station")).agg(
        F.max("accepted").alias("ok"), F.max("rejection_reason").alias("rejection_reason"), F.count_if(done).alias("n_values_imputed"), F.nullif(hours_text(done), F.lit("")).alias("imputed_timestamps"), *facts)
    near = near.withColumnRenamed("ok", "accepted").join(gaps.select(*GAP, F.col("left").alias("n_values_remaining")), key)
    return published(rows).unionByName(published(_named(near, "interstation_regression", config, "")))


def _named(near: DataFrame, method: str, config: CurationConfig, scheme: str) -> DataFrame:
    name = f"TimeSeriesSplit({config.interstation_cv_splits}){scheme}"
    return near.withColumns({"method_used": F.lit(method), "acceptance_threshold": F.lit(config.interstation_min_r2), "validation_scheme": F.lit(name)})


#: Sources of the series' own vectors: method, and prefix of the candidate's columns.
_OWN = (("short_vector_linear", "short"), ("weekly_vector_seasonal", "weekly"), ("cross_year_vector_analog", "year"))


def wind_log(wind: DataFrame, attempts: DataFrame | None, config: CurationConfig) -> DataFrame:
    """Rows of the wind: a row for each field that a contribution wrote, and rows of the vector for what was refused or is left."""
    no, yes, none, zero = F.lit(False), F.lit(True), F.lit(None).cast("string"), F.lit(0)
    sources = [(m, p, k) for k, (m, p) in enumerate(_OWN) if f"{p}_u" in wind.columns]
    rank = F.lit(len(_OWN) + 1)
    for method, k in [*[(m, k) for m, _, k in sources], ("interstation_vector_regression", len(_OWN))]:
        rank = F.when(F.col("method") == method, k).otherwise(rank)
    hours = wind.filter("is_gap").withColumn("variable", F.lit(VECTOR)).withColumn("rank", rank)
    wrote = {DIRECTION: F.col("wrote_direction"), SPEED: F.col("wrote_speed")}
    blank = {DIRECTION: F.col("direction").isNull(), SPEED: F.col("speed").isNull()}
    found: dict[str, Column] = {}
    for _, p, k in [*sources, ("", "end", len(_OWN))]:
        found[f"{p}_left"] = F.count_if(F.col("rank") > k)
        for f in wrote:
            found[f"{p}_left_{f}"] = F.count_if(blank[f] & ~(F.coalesce(wrote[f], no) & (F.col("rank") <= k)))
    for _, p, k in sources:
        clash = (F.col("rank") > k) & F.coalesce(conflict(F.col(f"{p}_u"), F.col(f"{p}_v")), no)
        found[f"{p}_n"], found[f"{p}_clash"], found[f"{p}_refused"] = F.count_if(F.col("rank") == k), F.count_if(clash), hours_text(clash)
        for f in wrote:
            mine = (F.col("rank") == k) & F.coalesce(wrote[f], no)
            found[f"{p}_n_{f}"], found[f"{p}_hours_{f}"] = F.count_if(mine), hours_text(mine)
    found["donors"] = F.min(F.when(F.col("weekly_u").isNotNull(), F.col("n_donors")))
    gaps = hours.groupBy(*GAP).agg(*[c.alias(k) for k, c in found.items()])
    made = []
    for method, p, _ in sources:
        col = lambda name, p=p: F.col(f"{p}_{name}")
        donors = {"weekly": F.col("donors"), "year": F.lit(1)}.get(p, F.lit(None))
        refused = F.nullif(col("refused"), F.lit(""))
        for f in wrote:
            made.append(_row(col(f"n_{f}") > 0, method, yes, none, col(f"n_{f}"), col(f"hours_{f}"), col(f"left_{f}"), n_donors=donors, variable=F.lit(f), rejected_timestamps=refused if p == "short" else none))
        unwritten = (col("n") > 0) & (col(f"n_{DIRECTION}") == 0) & (col(f"n_{SPEED}") == 0)
        made.append(_row(unwritten, method, no, F.lit("no_output_field_written"), zero, none, col("left"), n_donors=donors))
        due = col("clash") > 0
        if p == "short":
            due = (F.col("n_steps") <= config.short_gap_hours) & (due | (col("n") == 0))
        made.append(_row(due, method, no, F.when(col("clash") > 0, CONFLICT).otherwise("missing_valid_anchors"), zero, none, col("left"), n_donors=donors, rejected_timestamps=refused))
    made.append(_row(F.col("end_left") > 0, "unimputable", no, F.lit("no_vector_method_available"), zero, none, F.col("end_left")))
    rows = published(_rows(gaps, made))
    if attempts is None:
        return rows
    key = ["station", "gap_start"]
    fields = hours.select("station", "ts", *[F.coalesce(c, no).alias(f"wrote_{f}") for f, c in wrote.items()])
    done, said = F.col("accepted"), F.col("rejection_reason")
    clash = F.coalesce(said == CONFLICT, no)
    near = attempts.join(fields, ["station", "ts"], "left").groupBy(*key, F.col("neighbor").alias("source_station")).agg(
        F.count_if(done).alias("n"), F.max(said).alias("said"), hours_text(clash).alias("refused"),
        *[F.count_if(done & F.col(f"wrote_{f}")).alias(f"n_{f}") for f in wrote], *[hours_text(done & F.col(f"wrote_{f}")).alias(f"hours_{f}") for f in wrote],
        *[F.first(c).alias(k) for k, c in _FACTS.items()], F.first("model_intercept").alias("model_intercept"), F.first("model_coefficient").alias("model_coefficient"))
    near = near.join(gaps.select(*GAP, "end_left", *[f"end_left_{f}" for f in wrote]), key)
    made = [_row(F.col(f"n_{f}") > 0, "", yes, none, F.col(f"n_{f}"), F.col(f"hours_{f}"), F.col(f"end_left_{f}"), variable=F.lit(f)) for f in wrote]
    unwritten = (F.col("n") > 0) & (F.col(f"n_{DIRECTION}") == 0) & (F.col(f"n_{SPEED}") == 0)
    made.append(_row(unwritten, "", no, F.lit("no_output_field_written"), zero, none, F.col("end_left")))
    made.append(_row(F.col("said").isNotNull(), "", no, F.col("said"), zero, none, F.col("end_left"), rejected_timestamps=F.nullif("refused", F.lit(""))))
    facts = [*_FACTS, "model_intercept", "model_coefficient", "source_station"]
    near = near.select(*[c for c in GAP if c != "variable"], *facts, F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))
    return rows.unionByName(published(_named(near, "interstation_vector_regression", config, " multisalida")))
