"""The registered queries as DuckDB SQL: layers of common table expressions, each query a tail on the layers it needs."""

from __future__ import annotations

from stationfill.functions.rules import LOG_COLUMNS, RULES, SCALARS, VARIABLES, allowed_sources

_OBS = """
c AS (
  SELECT user_id % 12 AS k, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, max(event_id) AS eid, max(value) AS v
  FROM events WHERE event_id % 5 <> 4 GROUP BY 1, 2),
h AS (SELECT *, (day(ts) * 24 + hour(ts)) AS hi FROM c),
obs AS (
  SELECT concat('S', lpad(CAST(k AS VARCHAR), 2, '0')) AS station, ts,
    CASE WHEN (hi + 13*k) % 211 = 0 THEN -1.0e0 WHEN (hi + 29*k) % 307 = 0 THEN 5000.0e0 ELSE v END AS PM2_5,
    CAST(15 + abs(hour(ts) - 12) AS DOUBLE) + (eid % 3) * 0.25e0 + k * 0.5e0 AS TEMP,
    CAST(CASE WHEN eid % 31 = 0 THEN NULL ELSE eid % 101 END AS DOUBLE) AS HR,
    CAST(CASE WHEN eid % 4 = 0 THEN eid % 7 ELSE 0 END AS DOUBLE) AS PP,
    CAST(CASE WHEN eid % 17 = 0 THEN NULL ELSE (eid * 37) % 361 END AS DOUBLE) AS DIR_VIENTO,
    CAST(CASE WHEN eid % 19 = 0 THEN NULL ELSE eid % 13 END AS DOUBLE) AS VEL_VIENTO
  FROM h WHERE (hi + 37*k) % 97 >= 11 AND (hi + 5*k) % 23 >= 2)"""

_LONG = """
lo AS (
  SELECT l_suppkey % 5 AS k, l_shipdate, l_quantity, l_shipdate + to_hours(CAST((l_orderkey + i) % 24 AS INTEGER)) AS ts
  FROM lineitem, LATERAL (SELECT unnest(range(l_linenumber)) AS i)),
obs AS (
  SELECT 'L' || CAST(k AS VARCHAR) AS station, CAST(ts AS TIMESTAMP) AS ts, max(l_quantity) AS PM2_5 FROM lo
  WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '2000-07-01'
    AND (date_diff('hour', TIMESTAMP '1999-01-01', ts) + 611*k) % 1009 >= 130
  GROUP BY 1, 2)"""

_STATIONS = """
stations AS (
  SELECT station, -12.0e0 - 0.01e0 * k AS LATITUD, -77.0e0 - 0.007e0 * ((k * 5) % 12) AS LONGITUD,
    CASE WHEN k % 4 <> 3 THEN CAST(100 + 10 * k AS DOUBLE) END AS ALTITUD, 'D' || CAST(k % 3 AS VARCHAR) AS DISTRITO
  FROM (SELECT DISTINCT station, CAST(substr(station, 2, 2) AS INTEGER) AS k FROM obs))"""

_GRID = """
hours AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (SELECT min(ts) AS a, max(ts) AS b FROM obs)),
grid AS (SELECT station, ts FROM (SELECT DISTINCT station FROM obs), hours),
wide AS (SELECT g.*, o.* EXCLUDE (station, ts), o.station IS NOT NULL AS source_row FROM grid g LEFT JOIN obs o USING (station, ts))"""


def _hard(v: str) -> str:
    low, high, _, _ = RULES[v]
    bounds = [f"NOT isfinite({v})"] + ([f"{v} < {low}"] if low is not None else []) + ([f"{v} > {high}"] if high is not None else [])
    return f"({v} IS NOT NULL AND ({' OR '.join(bounds)}))"


def _outlier(v: str) -> str:
    return f"({v} IS NOT NULL AND NOT {_hard(v)} AND NOT ({v} BETWEEN {RULES[v][2]} AND {RULES[v][3]}))"


def _value(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL AND NOT {_hard(v)} AND NOT {_outlier(v)} THEN {v} END"


def _cells(variables: tuple[str, ...]) -> str:
    """Layers snap (wide analytic values), base (long), cells (with spans and eligibility)."""
    wind = "DIR_VIENTO" in variables
    snap = [f"{_value(v)} AS {v}_v" for v in variables if v != "DIR_VIENTO"]
    rows = []
    for v in variables:
        value, seen, excluded = f"{v}_v", f"{v}_v IS NOT NULL", _outlier(v)
        if wind and v in ("DIR_VIENTO", "VEL_VIENTO"):
            seen = "coalesce(VEL_VIENTO_v = 0, false) OR (VEL_VIENTO_v IS NOT NULL AND DIR_VIENTO_v IS NOT NULL)"
            excluded = f"{_outlier('DIR_VIENTO')} OR {_outlier('VEL_VIENTO')}"
        rows.append(f"SELECT station, ts, source_row, '{v}' AS variable, {v} AS raw, {_hard(v)} AS hard, {_outlier(v)} AS outlier, {value} AS value, {seen} AS seen, {excluded} AS excluded FROM snap")
    direction = ""
    if wind:
        direction = f", CASE WHEN coalesce(({_value('VEL_VIENTO')}) = 0, false) THEN NULL WHEN ({_value('DIR_VIENTO')}) = 360 THEN 0.0e0 ELSE {_value('DIR_VIENTO')} END AS DIR_VIENTO_v"
    return f"""
snap AS (SELECT *, {', '.join(snap)}{direction} FROM wide),
base AS ({' UNION ALL '.join(rows)}),
cells AS (
  SELECT *, coalesce(ts BETWEEN span_start AND span_end, false) AND NOT excluded AS eligible
  FROM (SELECT *, min(CASE WHEN seen THEN ts END) OVER s AS span_start, max(CASE WHEN seen THEN ts END) OVER s AS span_end
        FROM base WINDOW s AS (PARTITION BY station, variable)))"""


_SCALAR = ", ".join(f"'{v}'" for v in SCALARS)
_RUNS = f"""
sc AS (SELECT * FROM cells WHERE variable IN ({_SCALAR})),
r0 AS (SELECT *, value IS NULL AND eligible AS is_gap, lag(value) OVER w AS bv, lead(value) OVER w AS av FROM sc WINDOW w AS (PARTITION BY station, variable ORDER BY ts)),
r1 AS (SELECT *, CASE WHEN is_gap = lag(is_gap) OVER w THEN 0 ELSE 1 END AS chg FROM r0 WINDOW w AS (PARTITION BY station, variable ORDER BY ts)),
r2 AS (SELECT *, sum(chg) OVER (PARTITION BY station, variable ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM r1),
runs AS (
  SELECT *, CASE WHEN is_gap THEN min(ts) OVER q END AS gap_start, CASE WHEN is_gap THEN max(ts) OVER q END AS gap_end, CASE WHEN is_gap THEN count(*) OVER q END AS n_steps,
    CASE WHEN is_gap THEN arg_min_null(bv, ts) OVER q END AS left_value, CASE WHEN is_gap THEN arg_max_null(av, ts) OVER q END AS right_value
  FROM r2 WINDOW q AS (PARTITION BY station, variable, run))"""
_RANGE = "CASE variable " + " ".join(f"WHEN '{v}' THEN {{x}} BETWEEN {RULES[v][2]} AND {RULES[v][3]}" for v in SCALARS) + " END"
_FILL = f"""
f0 AS (
  SELECT *, variable = 'PP' AND left_value = 0 AND right_value = 0 AS zero,
    left_value + (right_value - left_value) * (date_diff('hour', gap_start, ts) + 1) / (n_steps + 1) AS lin,
    [x FOR x IN [lag(value, 336) OVER w, lag(value, 168) OVER w, lead(value, 168) OVER w, lead(value, 336) OVER w] IF x IS NOT NULL] AS donors
  FROM runs WINDOW w AS (PARTITION BY station, variable ORDER BY ts)),
f1 AS (
  SELECT *, CASE WHEN is_gap AND n_steps <= 4 AND left_value IS NOT NULL AND right_value IS NOT NULL THEN CASE WHEN zero THEN 0.0e0 ELSE lin END END AS s0,
    CASE WHEN is_gap AND len(donors) >= 3 THEN list_reduce(list_prepend(0.0e0, donors), lambda a, b: a + b) / len(donors) END AS w0 FROM f0),
f2 AS (
  SELECT *, CASE WHEN {_RANGE.format(x='s0')} THEN s0 END AS short_value, CASE WHEN {_RANGE.format(x='w0')} THEN w0 END AS weekly_value, CASE WHEN w0 IS NOT NULL THEN len(donors) END AS n_donors FROM f1),
y AS (
  SELECT f.station, f.variable, f.ts, coalesce(a.value, b.value) AS year_value FROM f2 f
  LEFT JOIN sc a ON a.station = f.station AND a.variable = f.variable AND a.ts = f.ts + INTERVAL 1 YEAR
  LEFT JOIN sc b ON b.station = f.station AND b.variable = f.variable AND b.ts = f.ts - INTERVAL 1 YEAR
  WHERE f.is_gap AND f.short_value IS NULL AND f.weekly_value IS NULL),
filled AS (
  SELECT f.*, y.year_value, CASE WHEN is_gap THEN coalesce(short_value, weekly_value, yv) ELSE value END AS after,
    CASE WHEN NOT is_gap THEN NULL WHEN short_value IS NOT NULL THEN CASE WHEN zero THEN 'short_zero' ELSE 'short_linear' END
      WHEN weekly_value IS NOT NULL THEN 'weekly_seasonal' WHEN yv IS NOT NULL THEN 'cross_year_analog' END AS method
  FROM f2 f LEFT JOIN (SELECT *, CASE WHEN {_RANGE.format(x='year_value')} THEN year_value END AS yv FROM y) y USING (station, variable, ts))"""
_EPS = "(16 * 2.220446049250313e-16)"
_CALM = "(sqrt({u}*{u} + {v}*{v}) <= " + _EPS + " * greatest(1.0e0, sqrt({u}*{u} + {v}*{v})))"
_VALID = "coalesce(isfinite({u}) AND isfinite({v}) AND sqrt({u}*{u} + {v}*{v}) <= 75, false)"


def _clash(p: str) -> str:
    u, v = f"{p}_u", f"{p}_v"
    return f"({_VALID.format(u=u, v=v)} AND {_CALM.format(u=u, v=v)} AND coalesce((direction IS NOT NULL AND speed IS NULL) OR (speed > 0 AND direction IS NULL), false))"


def _donors(c: str) -> str:
    return f"[x FOR x IN [lag({c}, 336) OVER w, lag({c}, 168) OVER w, lead({c}, 168) OVER w, lead({c}, 336) OVER w] IF x IS NOT NULL] AS d{c}"


_WIND = f"""
w0 AS (
  SELECT station, ts, max(value) FILTER (variable = 'DIR_VIENTO') AS direction, max(value) FILTER (variable = 'VEL_VIENTO') AS speed, bool_and(eligible) AS eligible
  FROM cells WHERE variable IN ('DIR_VIENTO', 'VEL_VIENTO') GROUP BY 1, 2),
vec AS (
  SELECT *, CASE WHEN speed = 0 THEN 0.0e0 ELSE -speed * sin(radians(direction)) END AS u, CASE WHEN speed = 0 THEN 0.0e0 ELSE -speed * cos(radians(direction)) END AS v FROM w0),
w1 AS (SELECT *, (u IS NULL OR v IS NULL) AND eligible AS is_gap, lag(u) OVER w AS bu, lead(u) OVER w AS au, lag(v) OVER w AS bv, lead(v) OVER w AS av, {_donors('u')}, {_donors('v')} FROM vec WINDOW w AS (PARTITION BY station ORDER BY ts)),
w2 AS (SELECT *, CASE WHEN is_gap = lag(is_gap) OVER (PARTITION BY station ORDER BY ts) THEN 0 ELSE 1 END AS chg FROM w1),
w3 AS (SELECT *, sum(chg) OVER (PARTITION BY station ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM w2),
wruns AS (
  SELECT *, CASE WHEN is_gap THEN min(ts) OVER q END AS gap_start, CASE WHEN is_gap THEN max(ts) OVER q END AS gap_end, CASE WHEN is_gap THEN count(*) OVER q END AS n_steps,
    arg_min_null(bu, ts) OVER q AS lu, arg_min_null(bv, ts) OVER q AS lv, arg_max_null(au, ts) OVER q AS ru, arg_max_null(av, ts) OVER q AS rv
  FROM w3 WINDOW q AS (PARTITION BY station, run)),
cand AS (
  SELECT *, is_gap AND lu IS NOT NULL AND ru IS NOT NULL AS anchored,
    CASE WHEN is_gap AND lu IS NOT NULL AND ru IS NOT NULL AND n_steps <= 4 THEN lu + (ru - lu) * (date_diff('hour', gap_start, ts) + 1) / (n_steps + 1) END AS short_u,
    CASE WHEN is_gap AND lu IS NOT NULL AND ru IS NOT NULL AND n_steps <= 4 THEN lv + (rv - lv) * (date_diff('hour', gap_start, ts) + 1) / (n_steps + 1) END AS short_v,
    CASE WHEN is_gap AND len(du) >= 3 THEN list_reduce(list_prepend(0.0e0, du), lambda a, b: a + b) / len(du) END AS weekly_u,
    CASE WHEN is_gap AND len(dv) >= 3 THEN list_reduce(list_prepend(0.0e0, dv), lambda a, b: a + b) / len(dv) END AS weekly_v
  FROM wruns),
wm AS (
  SELECT *, {_VALID.format(u='short_u', v='short_v')} AND NOT {_clash('short')} AS use_short, {_VALID.format(u='weekly_u', v='weekly_v')} AND NOT {_clash('weekly')} AS use_weekly,
    CAST({_clash('short')} AS INTEGER) AS clash_short, CAST({_clash('weekly')} AS INTEGER) AS clash_weekly FROM cand),
merged AS (
  SELECT *, CASE WHEN NOT is_gap THEN u WHEN use_short THEN short_u WHEN use_weekly THEN weekly_u END AS after_u, CASE WHEN NOT is_gap THEN v WHEN use_short THEN short_v WHEN use_weekly THEN weekly_v END AS after_v,
    CASE WHEN NOT is_gap THEN NULL WHEN use_short THEN 'short_vector_linear' WHEN use_weekly THEN 'weekly_vector_seasonal' END AS method,
    CASE WHEN NOT is_gap OR use_short THEN 0 WHEN use_weekly THEN clash_short ELSE clash_short + clash_weekly END AS n_conflicts FROM wm),
wf AS (
  SELECT *, method IS NOT NULL AND speed IS NULL AND NOT (direction IS NOT NULL AND calm) AS wrote_speed, method IS NOT NULL AND direction IS NULL AND NOT calm AS wrote_direction
  FROM (SELECT *, coalesce({_CALM.format(u='after_u', v='after_v')}, false) AS calm FROM merged)),
wind AS (
  SELECT *, CASE WHEN wrote_speed THEN CASE WHEN calm THEN 0.0e0 ELSE sqrt(after_u * after_u + after_v * after_v) END ELSE speed END AS speed_after,
    CASE WHEN wrote_direction THEN (degrees(atan2(-after_u, -after_v)) + 360) % 360 ELSE direction END AS direction_after FROM wf)"""
_STATES = """
every AS (
  SELECT station, variable, ts, source_row, raw, hard, outlier, value, eligible, after, method, false AS calm FROM filled
  UNION ALL
  SELECT c.station, c.variable, c.ts, source_row, raw, hard, outlier, value, c.eligible,
    CASE WHEN c.variable = 'VEL_VIENTO' THEN speed_after ELSE direction_after END, CASE WHEN CASE WHEN c.variable = 'VEL_VIENTO' THEN wrote_speed ELSE wrote_direction END THEN w.method END,
    coalesce(c.variable = 'DIR_VIENTO' AND speed_after = 0, false)
  FROM cells c JOIN wind w USING (station, ts) WHERE c.variable IN ('DIR_VIENTO', 'VEL_VIENTO')),
st0 AS (
  SELECT *, CASE WHEN raw IS NOT NULL THEN 'senamhi_observed' WHEN NOT eligible THEN 'missing_structural' WHEN source_row THEN 'missing_explicit' ELSE 'missing_implicit' END AS plain FROM every),
states AS (
  SELECT *, CASE WHEN hard THEN 'hard_invalid' WHEN calm THEN 'not_applicable' WHEN outlier THEN 'operational_outlier' ELSE plain END AS origin_state,
    CASE WHEN method IS NOT NULL THEN 'imputed_' || method WHEN calm THEN 'not_applicable' WHEN outlier THEN 'senamhi_operational_outlier' WHEN hard THEN 'missing_hard_invalid' ELSE plain END AS source,
    CASE WHEN calm THEN NULL WHEN hard OR raw IS NULL THEN after ELSE raw END AS final, NOT calm AS is_applicable,
    CASE WHEN calm THEN false WHEN hard OR raw IS NULL THEN after IS NOT NULL ELSE true END AS output_present FROM st0)"""
#: A product with faults of every kind, by the hour's number n in the month and the station's number.
_FAULTY = """
n0 AS (SELECT *, day(ts) * 24 + hour(ts) + 7 * CAST(substr(station, 2, 2) AS INTEGER) AS n FROM states),
faulty AS (
  SELECT * EXCLUDE (final, source, after, n), n,
    CASE WHEN n % 53 = 1 THEN final + 1 WHEN n % 59 = 2 THEN NULL WHEN n % 61 = 3 AND final IS NULL THEN 5.0e0 WHEN n % 67 = 4 AND variable = 'DIR_VIENTO' AND starts_with(source, 'imputed_') THEN 360.0e0 ELSE final END AS final,
    CASE WHEN n % 71 = 5 THEN 'imputed_unknown' WHEN n % 73 = 6 THEN 'not_applicable' ELSE source END AS source,
    CASE WHEN n % 79 = 7 AND after IS NULL THEN 5.0e0 WHEN n % 83 = 8 AND after IS NOT NULL AND value IS NULL THEN -999.0e0 ELSE after END AS after
  FROM n0)"""
_ISO = "string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '|' ORDER BY ts) FILTER ({})"
_LOG_TYPES = {
    "gap_start": "TIMESTAMP", "gap_end": "TIMESTAMP", "accepted": "BOOLEAN",
    **dict.fromkeys(("n_steps", "duration_h", "n_values_imputed", "n_values_remaining", "training_pairs", "n_donors"), "BIGINT"),
    **dict.fromkeys(("interstation_r2", "distance_km", "predictor_coverage", "acceptance_threshold"), "DOUBLE"),
}


def _log_row(table: str, where: str, **found: str) -> str:
    found = {"station": "station", "gap_start": "gap_start", "gap_end": "gap_end", "n_steps": "n_steps", "duration_h": "n_steps", "n_values_imputed": "0"} | found
    return "SELECT " + ", ".join(f"CAST({found.get(c, 'NULL')} AS {_LOG_TYPES.get(c, 'VARCHAR')}) AS {c}" for c in LOG_COLUMNS) + f" FROM {table} WHERE {where}"


def _scalar_log() -> tuple[str, list[str]]:
    """A row for each gap (layer sg), and the log's rows from it."""
    kinds = {"s": "method IN ('short_linear', 'short_zero')", "w": "method = 'weekly_seasonal'", "c": "method = 'cross_year_analog'"}
    found = ", ".join(f"count(*) FILTER ({c}) AS n_{k}, {_ISO.format(c)} AS h_{k}" for k, c in kinds.items())
    gaps = f"\nsg AS (SELECT station, variable, gap_start, gap_end, n_steps, count(*) FILTER (after IS NULL) AS rest, bool_or(coalesce(zero, false)) AS zeros, min(n_donors) AS donors, {found} FROM filled WHERE is_gap GROUP BY 1, 2, 3, 4, 5)"
    v = {"variable": "variable"}
    return gaps, [
        _log_row("sg", "n_steps <= 4", **v, method_used="CASE WHEN zeros THEN 'short_zero' ELSE 'short_linear' END", accepted="n_s > 0", rejection_reason="CASE WHEN n_s = 0 THEN 'missing_valid_anchors' END", n_values_imputed="n_s", imputed_timestamps="coalesce(h_s, '')", n_values_remaining="n_steps - n_s"),
        _log_row("sg", "n_w > 0", **v, method_used="'weekly_seasonal'", accepted="true", n_values_imputed="n_w", imputed_timestamps="h_w", n_values_remaining="rest", n_donors="donors"),
        _log_row("sg", "n_c > 0", **v, method_used="'cross_year_analog'", accepted="true", n_values_imputed="n_c", imputed_timestamps="h_c", n_values_remaining="rest", n_donors="1"),
        _log_row("sg", "rest > 0", **v, method_used="'unimputable'", accepted="false", rejection_reason="'no_method_available'", n_values_remaining="rest"),
    ]


def _wind_log() -> tuple[str, list[str]]:
    """A row for each gap of the vector (layer wg), and the log's rows from it."""
    fields = {"DIR_VIENTO": "direction", "VEL_VIENTO": "speed"}
    sources = {"short": ("short_vector_linear", "method = 'short_vector_linear'", "clash_short = 1"), "weekly": ("weekly_vector_seasonal", "method IN ('short_vector_linear', 'weekly_vector_seasonal')", "clash_weekly = 1 AND method IS DISTINCT FROM 'short_vector_linear'")}
    found = ["count(*) FILTER (method IS NULL) AS end_left"]
    for p, (method, so_far, clash) in sources.items():
        found += [f"count(*) FILTER (NOT coalesce({so_far}, false)) AS {p}_left", f"count(*) FILTER (method = '{method}') AS {p}_n", f"count(*) FILTER ({clash}) AS {p}_clash", f"{_ISO.format(clash)} AS {p}_refused"]
        for f in fields.values():
            mine = f"method = '{method}' AND wrote_{f}"
            found += [f"count(*) FILTER ({f} IS NULL AND NOT (wrote_{f} AND {so_far})) AS {p}_left_{f}", f"count(*) FILTER ({mine}) AS {p}_n_{f}", f"{_ISO.format(mine)} AS {p}_hours_{f}"]
    gaps = f"\nwg AS (SELECT station, gap_start, gap_end, n_steps, min(CASE WHEN weekly_u IS NOT NULL THEN len(du) END) AS donors, {', '.join(found)} FROM wind WHERE is_gap GROUP BY 1, 2, 3, 4)"
    rows, vector = [], {"variable": "'VIENTO_VECTOR'", "accepted": "false"}
    for p, (method, _, _) in sources.items():
        m = {"method_used": f"'{method}'", "n_donors": "donors" if p == "weekly" else "NULL"}
        for variable, f in fields.items():
            rows.append(_log_row("wg", f"{p}_n_{f} > 0", **m, variable=f"'{variable}'", accepted="true", n_values_imputed=f"{p}_n_{f}", imputed_timestamps=f"{p}_hours_{f}", n_values_remaining=f"{p}_left_{f}", rejected_timestamps="short_refused" if p == "short" else "NULL"))
        due = "n_steps <= 4 AND (short_clash > 0 OR short_n = 0)" if p == "short" else "weekly_clash > 0"
        rows.append(_log_row("wg", due, **m, **vector, rejection_reason=f"CASE WHEN {p}_clash > 0 THEN 'calm_candidate_conflicts_with_observed_component' ELSE 'missing_valid_anchors' END", n_values_remaining=f"{p}_left", rejected_timestamps=f"{p}_refused"))
    rows.append(_log_row("wg", "end_left > 0", **vector, method_used="'unimputable'", rejection_reason="'no_vector_method_available'", n_values_remaining="end_left"))
    return gaps, rows


_SCALAR_GAPS, _SCALAR_ROWS = _scalar_log()
_WIND_GAPS, _WIND_ROWS = _wind_log()
_SCALAR_LOG = [_SCALAR_GAPS, "\nlog AS (" + " UNION ALL ".join(_SCALAR_ROWS) + ")"]
_LOG = [_SCALAR_GAPS, _WIND_GAPS, "\nlog AS (" + " UNION ALL ".join(_SCALAR_ROWS + _WIND_ROWS) + ")"]
# Near stations: models of all pairs, and the cascade as a recursion over ranks whose state is the hours still empty.

_RANKED = """
ranked AS (
  SELECT a.station, b.station AS neighbor, 2 * 6371.0088e0 * atan2(sqrt(h), sqrt(greatest(0.0e0, 1 - h))) AS distance_km,
    row_number() OVER (PARTITION BY a.station ORDER BY round(2 * 6371.0088e0 * atan2(sqrt(h), sqrt(greatest(0.0e0, 1 - h))), 9), b.station) AS rank
  FROM stations a JOIN stations b ON a.station <> b.station,
  LATERAL (SELECT pow(sin(radians(b.LATITUD - a.LATITUD) / 2), 2) + cos(radians(a.LATITUD)) * cos(radians(b.LATITUD)) * pow(sin(radians(b.LONGITUD - a.LONGITUD) / 2), 2) AS h))"""


def _segments(name: str, rows: str) -> str:
    """Layers of a pair's common hours with the folds' segments: equal runs at the end of the time order, all before is 0."""
    return f"""
{name}_p AS ({rows}),
{name}_n AS (SELECT *, count(*) OVER q AS n, row_number() OVER (q ORDER BY ts) - 1 AS rn FROM {name}_p WINDOW q AS (PARTITION BY variable, station, neighbor)),
{name}_s AS (SELECT *, CASE WHEN rn < n - 5 * (n // 6) THEN 0 ELSE 1 + (rn - (n - 5 * (n // 6))) // (n // 6) END AS seg FROM {name}_n WHERE n >= 48),
{name}_j AS (SELECT variable, station, neighbor, unnest(range(1, 7)) AS j FROM (SELECT DISTINCT variable, station, neighbor FROM {name}_s)),
{name}_few AS (SELECT variable, station, neighbor, max(n) AS training_pairs FROM {name}_n GROUP BY 1, 2, 3)"""


#: Fold j learns from all segments before j; 6 is the whole.
_SCALAR_MODELS = _segments("sp", """
  SELECT a.variable, a.station, b.station AS neighbor, a.ts, a.value AS y, b.value AS x
  FROM cells a JOIN cells b ON a.variable = b.variable AND a.ts = b.ts AND a.station <> b.station
  WHERE a.value IS NOT NULL AND b.value IS NOT NULL AND a.variable IN ('PM2_5', 'TEMP', 'HR', 'PP')""") + """,
sfit AS (
  SELECT variable, station, neighbor, j, CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) / var_pop(x) ELSE 0 END AS slope, avg(y) - CASE WHEN var_pop(x) > 0 THEN covar_pop(y, x) / var_pop(x) ELSE 0 END * avg(x) AS intercept
  FROM sp_s JOIN sp_j USING (variable, station, neighbor) WHERE seg < j GROUP BY 1, 2, 3, 4),
stest AS (
  SELECT variable, station, neighbor, j, sum(pow(y - intercept - slope * x, 2)) AS sse, var_pop(y) * count(*) AS sst
  FROM sp_s JOIN sfit USING (variable, station, neighbor) WHERE seg = j GROUP BY 1, 2, 3, 4),
smodel AS (
  SELECT * FROM sp_few
  LEFT JOIN (SELECT variable, station, neighbor, slope, intercept FROM sfit WHERE j = 6) USING (variable, station, neighbor)
  LEFT JOIN (SELECT variable, station, neighbor, avg(CASE WHEN sst > 0 THEN 1 - sse / sst WHEN sse = 0 THEN 1 ELSE 0 END) AS r2 FROM stest GROUP BY 1, 2, 3) USING (variable, station, neighbor))"""
_CASCADE = f"""
known AS (SELECT variable, station, ts, value FROM cells WHERE value IS NOT NULL AND variable IN ({_SCALAR})),
tries(rank, station, variable, gap_start, ts, neighbor, distance_km, coverage, training_pairs, slope, intercept, r2, value) AS (
  SELECT 0::BIGINT, station, variable, gap_start, ts, NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
  FROM filled_own WHERE is_gap AND after IS NULL
  UNION ALL
  SELECT rank, station, variable, gap_start, ts, neighbor, distance_km, coverage, training_pairs, slope, intercept, r2,
    CASE WHEN coverage >= 0.9 AND r2 >= 0.5 AND {_RANGE.format(x='guess')} THEN guess END
  FROM (
    SELECT n.rank, t.station, t.variable, t.gap_start, t.ts, n.neighbor, n.distance_km, coalesce(m.training_pairs, 0) AS training_pairs, m.slope, m.intercept, m.r2,
      count(k.value) OVER g::DOUBLE / count(*) OVER g AS coverage, m.intercept + m.slope * k.value AS guess
    FROM tries t JOIN ranked n ON n.station = t.station AND n.rank = t.rank + 1
    LEFT JOIN known k ON k.variable = t.variable AND k.station = n.neighbor AND k.ts = t.ts
    LEFT JOIN smodel m ON m.variable = t.variable AND m.station = t.station AND m.neighbor = n.neighbor
    WHERE t.value IS NULL
    WINDOW g AS (PARTITION BY t.station, t.variable, t.gap_start))),
tried AS (SELECT *, max(value) OVER (PARTITION BY station, variable, gap_start, rank) IS NOT NULL AS made_any FROM tries WHERE rank > 0),
attempts AS (
  SELECT station, variable, gap_start, CASE WHEN made_any THEN ts END AS ts, neighbor, any_value(distance_km) AS distance_km, made_any AS accepted,
    CASE WHEN made_any THEN NULL WHEN any_value(coverage) < 0.9 THEN 'insufficient_gap_coverage' WHEN any_value(r2) IS NULL THEN 'insufficient_training_pairs_or_cv'
      WHEN any_value(r2) < 0.5 THEN 'r2_below_threshold' ELSE 'predictions_out_of_range' END AS rejection_reason,
    any_value(value) AS value, CASE WHEN any_value(coverage) >= 0.9 THEN any_value(r2) END AS r2, CASE WHEN any_value(coverage) >= 0.9 THEN any_value(training_pairs) END AS training_pairs,
    any_value(coverage) AS predictor_coverage, CASE WHEN any_value(coverage) >= 0.9 THEN any_value(slope) END AS slope, CASE WHEN any_value(coverage) >= 0.9 THEN any_value(intercept) END AS intercept
  FROM tried WHERE NOT made_any OR value IS NOT NULL GROUP BY station, variable, gap_start, rank, neighbor, made_any, CASE WHEN made_any THEN ts END),
filled AS (
  SELECT f.* EXCLUDE (after, method), coalesce(after, near) AS after, CASE WHEN near IS NOT NULL THEN 'interstation_regression' ELSE method END AS method
  FROM filled_own f LEFT JOIN (SELECT station, variable, ts, value AS near FROM attempts WHERE accepted) a USING (station, variable, ts))"""


def _solved(k: int) -> str:
    """The k-th coefficient of least squares by x1 and x2 of each output y, least norm where they are dependent."""
    s, t = ("s22", "s11")[k - 1], ("{t}1", "{t}2")
    whole = f"({s} * {t[k - 1]} - s12 * {t[2 - k]}) / (s11 * s22 - s12 * s12)"
    own = "s11" if k == 1 else "s22"
    line = f"({own} * {t[k - 1]} + s12 * {t[2 - k]}) / (high * high)"
    return f"CASE WHEN low > 1e-10 * high THEN {whole} WHEN high > 0 THEN {line} ELSE 0 END"


_WIND_MODELS = _segments("wp", """
  SELECT 'VIENTO_VECTOR' AS variable, a.station, b.station AS neighbor, a.ts, a.u AS y1, a.v AS y2, b.u AS x1, b.v AS x2
  FROM vec a JOIN vec b ON a.ts = b.ts AND a.station <> b.station WHERE a.u IS NOT NULL AND a.v IS NOT NULL AND b.u IS NOT NULL AND b.v IS NOT NULL""") + f""",
wsum AS (
  SELECT variable, station, neighbor, j, var_pop(x1) AS s11, covar_pop(x1, x2) AS s12, var_pop(x2) AS s22, covar_pop(x1, y1) AS p1, covar_pop(x2, y1) AS p2, covar_pop(x1, y2) AS q1, covar_pop(x2, y2) AS q2,
    avg(x1) AS mx1, avg(x2) AS mx2, avg(y1) AS my1, avg(y2) AS my2
  FROM wp_s JOIN wp_j USING (variable, station, neighbor) WHERE seg < j GROUP BY 1, 2, 3, 4),
weig AS (SELECT *, (s11 + s22 + sqrt((s11 - s22) * (s11 - s22) + 4 * s12 * s12)) / 2 AS high, (s11 + s22 - sqrt((s11 - s22) * (s11 - s22) + 4 * s12 * s12)) / 2 AS low FROM wsum),
wfit0 AS (SELECT *, {_solved(1).format(t='p')} AS u_by_u, {_solved(2).format(t='p')} AS u_by_v, {_solved(1).format(t='q')} AS v_by_u, {_solved(2).format(t='q')} AS v_by_v FROM weig),
wfit AS (SELECT variable, station, neighbor, j, u_by_u, u_by_v, v_by_u, v_by_v, my1 - u_by_u * mx1 - u_by_v * mx2 AS u_base, my2 - v_by_u * mx1 - v_by_v * mx2 AS v_base FROM wfit0),
wtest AS (
  SELECT variable, station, neighbor, j, sum(pow(y1 - u_base - u_by_u * x1 - u_by_v * x2, 2)) AS sse1, var_pop(y1) * count(*) AS sst1, sum(pow(y2 - v_base - v_by_u * x1 - v_by_v * x2, 2)) AS sse2, var_pop(y2) * count(*) AS sst2
  FROM wp_s JOIN wfit USING (variable, station, neighbor) WHERE seg = j GROUP BY 1, 2, 3, 4),
wmodel AS (
  SELECT * FROM wp_few
  LEFT JOIN (SELECT * EXCLUDE (j) FROM wfit WHERE j = 6) USING (variable, station, neighbor)
  LEFT JOIN (
    SELECT variable, station, neighbor, avg((CASE WHEN sst1 > 0 THEN 1 - sse1 / sst1 WHEN sse1 = 0 THEN 1 ELSE 0 END + CASE WHEN sst2 > 0 THEN 1 - sse2 / sst2 WHEN sse2 = 0 THEN 1 ELSE 0 END) / 2) AS r2
    FROM wtest GROUP BY 1, 2, 3) USING (variable, station, neighbor))"""


def _wind_cascade(coverage: float, r2: float) -> str:
    valid = f"coverage >= {coverage} AND r2 >= {r2} AND {_VALID.format(u='gu', v='gv')}"
    clash = f"({_CALM.format(u='gu', v='gv')} AND coalesce((direction IS NOT NULL AND speed IS NULL) OR (speed > 0 AND direction IS NULL), false))"
    facts = ", ".join(f"CASE WHEN any_value(coverage) >= {coverage} THEN any_value({c}) END AS {c}" for c in ("r2", "training_pairs", "u_by_u", "u_by_v", "v_by_u", "v_by_v", "u_base", "v_base"))
    keep = "neighbor, distance_km, coverage, training_pairs, u_by_u, u_by_v, v_by_u, v_by_v, u_base, v_base, r2"
    nothing = "NULL::VARCHAR, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT" + ", NULL::DOUBLE" * 7
    return f"""
wtries(rank, station, gap_start, ts, direction, speed, {keep}, near_u, near_v, refused) AS (
  SELECT 0::BIGINT, station, gap_start, ts, direction, speed, {nothing}, NULL::DOUBLE, NULL::DOUBLE, false
  FROM merged_own WHERE is_gap AND method IS NULL
  UNION ALL
  SELECT rank, station, gap_start, ts, direction, speed, {keep}, CASE WHEN valid AND NOT clash THEN gu END, CASE WHEN valid AND NOT clash THEN gv END, valid AND clash
  FROM (
    SELECT *, coalesce({valid}, false) AS valid, coalesce({clash}, false) AS clash
    FROM (
      SELECT n.rank, t.station, t.gap_start, t.ts, t.direction, t.speed, n.neighbor, n.distance_km, coalesce(m.training_pairs, 0) AS training_pairs, m.u_by_u, m.u_by_v, m.v_by_u, m.v_by_v, m.u_base, m.v_base, m.r2,
        count(k.u) OVER g::DOUBLE / count(*) OVER g AS coverage, m.u_base + m.u_by_u * k.u + m.u_by_v * k.v AS gu, m.v_base + m.v_by_u * k.u + m.v_by_v * k.v AS gv
      FROM wtries t JOIN ranked n ON n.station = t.station AND n.rank = t.rank + 1
      LEFT JOIN vec k ON k.station = n.neighbor AND k.ts = t.ts AND k.u IS NOT NULL AND k.v IS NOT NULL
      LEFT JOIN wmodel m ON m.station = t.station AND m.neighbor = n.neighbor
      WHERE t.near_u IS NULL
      WINDOW g AS (PARTITION BY t.station, t.gap_start)))),
wtried AS (SELECT *, bool_or(near_u IS NOT NULL) OVER q AS made_any, bool_or(refused) OVER q AS clashed FROM wtries WHERE rank > 0 WINDOW q AS (PARTITION BY station, gap_start, rank)),
wattempts AS (
  SELECT station, 'VIENTO_VECTOR' AS variable, gap_start, CASE WHEN made_any OR clashed THEN ts END AS ts, neighbor, any_value(near_u) IS NOT NULL AS accepted,
    CASE WHEN any_value(near_u) IS NOT NULL THEN NULL WHEN any_value(refused) THEN 'calm_candidate_conflicts_with_observed_component' WHEN any_value(coverage) < {coverage} THEN 'insufficient_gap_coverage'
      WHEN any_value(r2) IS NULL THEN 'insufficient_training_pairs_or_cv' WHEN any_value(r2) < {r2} THEN 'r2_below_threshold' ELSE 'predictions_out_of_range' END AS rejection_reason,
    any_value(near_u) AS near_u, any_value(near_v) AS near_v, any_value(coverage) AS predictor_coverage, any_value(distance_km) AS distance_km, {facts}
  FROM wtried WHERE NOT (made_any OR clashed) OR near_u IS NOT NULL OR refused GROUP BY station, gap_start, rank, neighbor, CASE WHEN made_any OR clashed THEN ts END)"""


_WIND_WHOLE = """
merged AS (
  SELECT m.* EXCLUDE (after_u, after_v, method), coalesce(near_u, after_u) AS after_u, coalesce(near_v, after_v) AS after_v, CASE WHEN near_u IS NOT NULL THEN 'interstation_vector_regression' ELSE method END AS method
  FROM merged_own m LEFT JOIN (SELECT station, ts, near_u, near_v FROM wattempts WHERE accepted) a USING (station, ts))"""
_FILL_OWN = _FILL.replace("\nfilled AS (", "\nfilled_own AS (")
_WIND_OWN, _WIND_REST = _WIND.replace("\nmerged AS (", "\nmerged_own AS (").split(",\nwf AS (")
_WIND_REST = "\nwf AS (" + _WIND_REST
_NEAR_SCALARS = [_OBS, _STATIONS, _GRID, _cells(VARIABLES), _RUNS, _FILL_OWN, _RANKED, _SCALAR_MODELS, _CASCADE]
_NEAR_WIND = [_WIND_OWN, _WIND_MODELS]


def _near_log() -> tuple[str, list[str]]:
    """Rows of near stations, of scalars from attempts and of wind from wattempts; coefficients in millionths, as texts."""
    millionths = lambda c: f"CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR)"
    listed = lambda *cs: f"CASE WHEN {cs[0]} IS NOT NULL THEN concat_ws(',', {', '.join(map(millionths, cs))}) END"
    scalars = """
nl AS (
  SELECT a.*, g.gap_end, g.n_steps, g.rest FROM (
    SELECT station, variable, gap_start, neighbor, bool_or(accepted) AS accepted, max(rejection_reason) AS reason, count(*) FILTER (accepted) AS n, string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '|' ORDER BY ts) FILTER (accepted) AS hours,
      any_value(r2) AS r2, any_value(distance_km) AS distance_km, any_value(predictor_coverage) AS coverage, any_value(training_pairs) AS pairs, any_value(slope) AS slope, any_value(intercept) AS intercept
    FROM attempts GROUP BY 1, 2, 3, 4) a JOIN sg g ON g.station = a.station AND g.variable = a.variable AND g.gap_start = a.gap_start)"""
    fields = {"DIR_VIENTO": "direction", "VEL_VIENTO": "speed"}
    parts = ", ".join(f"count(*) FILTER (a.accepted AND wrote_{f}) AS n_{f}, string_agg(strftime(a.ts, '%Y-%m-%dT%H:%M:%S'), '|' ORDER BY a.ts) FILTER (a.accepted AND wrote_{f}) AS hours_{f}" for f in fields.values())
    wind = f"""
wnl AS (
  SELECT a.*, g.gap_end, g.n_steps, g.end_left, g.end_left_direction, g.end_left_speed FROM (
    SELECT a.station, a.gap_start, neighbor, count(*) FILTER (a.accepted) AS n, max(rejection_reason) AS reason, {parts},
      string_agg(strftime(a.ts, '%Y-%m-%dT%H:%M:%S'), '|' ORDER BY a.ts) FILTER (rejection_reason = 'calm_candidate_conflicts_with_observed_component') AS refused,
      any_value(r2) AS r2, any_value(distance_km) AS distance_km, any_value(predictor_coverage) AS coverage, any_value(training_pairs) AS pairs, {', '.join(f'any_value({c}) AS {c}' for c in ('u_by_u', 'u_by_v', 'v_by_u', 'v_by_v', 'u_base', 'v_base'))}
    FROM wattempts a LEFT JOIN wind w ON w.station = a.station AND w.ts = a.ts GROUP BY 1, 2, 3) a
  JOIN (SELECT station, gap_start, gap_end, n_steps, count(*) FILTER (method IS NULL) AS end_left, {', '.join(f'count(*) FILTER ({f} IS NULL AND NOT coalesce(wrote_{f}, false)) AS end_left_{f}' for f in fields.values())}
        FROM wind WHERE is_gap GROUP BY 1, 2, 3, 4) g ON g.station = a.station AND g.gap_start = a.gap_start)"""
    same = {"source_station": "neighbor", "interstation_r2": "round(r2, 6) + 0.0e0", "distance_km": "round(distance_km, 6)", "predictor_coverage": "round(coverage, 6)", "training_pairs": "pairs", "acceptance_threshold": "0.5"}
    rows = [_log_row("nl", "true", **same, variable="variable", method_used="'interstation_regression'", accepted="accepted", rejection_reason="reason", n_values_imputed="n", imputed_timestamps="hours", n_values_remaining="rest",
                     model_intercept=listed("intercept"), model_coefficient=listed("slope"), validation_scheme="'TimeSeriesSplit(5)'")]
    same |= {"method_used": "'interstation_vector_regression'", "validation_scheme": "'TimeSeriesSplit(5) multisalida'", "model_intercept": listed("u_base", "v_base"), "model_coefficient": listed("u_by_u", "u_by_v", "v_by_u", "v_by_v")}
    for v, f in fields.items():
        rows.append(_log_row("wnl", f"n_{f} > 0", **same, variable=f"'{v}'", accepted="true", n_values_imputed=f"n_{f}", imputed_timestamps=f"hours_{f}", n_values_remaining=f"end_left_{f}"))
    vector = {"variable": "'VIENTO_VECTOR'", "accepted": "false", "n_values_remaining": "end_left"}
    rows.append(_log_row("wnl", "n > 0 AND n_direction = 0 AND n_speed = 0", **same, **vector, rejection_reason="'no_output_field_written'"))
    rows.append(_log_row("wnl", "reason IS NOT NULL", **same, **vector, rejection_reason="reason", rejected_timestamps="refused"))
    return scalars + "," + wind, rows


_NEAR_GAPS, _NEAR_ROWS = _near_log()
_WHOLE = [*_NEAR_SCALARS, *_NEAR_WIND, _wind_cascade(0.9, 0.5), _WIND_WHOLE, _WIND_REST]
_DIRTY = """
dirty AS (
  SELECT o_orderkey AS row_id,
    CASE WHEN o_orderkey % 50 = 0 THEN ' ' || substr(o_orderpriority, 1, 1) WHEN o_orderkey % 333 = 1 THEN ' ' WHEN o_orderkey % 444 = 2 THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS ESTACION,
    CASE WHEN o_orderkey % 701 = 3 THEN '20230230' WHEN o_orderkey % 703 = 4 THEN '' ELSE strftime(o_orderdate, '%Y%m%d') END AS FECHA,
    CASE WHEN o_orderkey % 709 = 5 THEN '1030' ELSE CAST((o_orderkey % 26) * 10000 AS VARCHAR) END AS HORA,
    CASE WHEN o_orderkey % 601 = 6 THEN '-95.5' WHEN o_orderkey % 607 = 7 THEN 'south' ELSE '-12.5' END AS LATITUD,
    CASE WHEN o_orderkey % 613 = 8 THEN '' ELSE CAST(-77 - o_orderkey % 2 AS VARCHAR) END AS LONGITUD,
    CASE WHEN o_orderkey % 617 = 9 THEN 'n/a' ELSE CAST(o_custkey % 1000 AS VARCHAR) END AS PM2_5
  FROM orders),
typed AS (SELECT row_id, ESTACION, TRY_CAST(nullif(trim(FECHA), '') AS DOUBLE) AS FECHA, TRY_CAST(nullif(trim(HORA), '') AS DOUBLE) AS HORA,
    TRY_CAST(nullif(trim(LATITUD), '') AS DOUBLE) AS LATITUD, TRY_CAST(nullif(trim(LONGITUD), '') AS DOUBLE) AS LONGITUD, TRY_CAST(nullif(trim(PM2_5), '') AS DOUBLE) AS PM2_5 FROM dirty)"""
_ALLOWED = "allowed AS (SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{s}')" for v in VARIABLES for s in allowed_sources(v)) + ") t(variable, source))"

LAYERS = {
    "obs": [_OBS],
    "grid": [_OBS, _GRID],
    "cells": [_OBS, _GRID, _cells(VARIABLES)],
    "runs": [_OBS, _GRID, _cells(VARIABLES), _RUNS],
    "filled": [_OBS, _GRID, _cells(VARIABLES), _RUNS, _FILL],
    "wind": [_OBS, _GRID, _cells(VARIABLES), _WIND],
    "states": [_OBS, _GRID, _cells(VARIABLES), _RUNS, _FILL, _WIND, _STATES],
    "faulty": [_OBS, _GRID, _cells(VARIABLES), _RUNS, _FILL, _WIND, _STATES, _FAULTY],
    "log": [_OBS, _GRID, _cells(VARIABLES), _RUNS, _FILL, _WIND, *_LOG],
    "long_log": [_LONG, _GRID, _cells(("PM2_5",)), _RUNS, _FILL, *_SCALAR_LOG],
    "long": [_LONG, _GRID, _cells(("PM2_5",)), _RUNS, _FILL],
    "stations": [_OBS, _STATIONS],
    "station_cells": [_OBS, _STATIONS, _GRID, _cells(VARIABLES)],
    "dirty": [_DIRTY],
    "near_scalars": _NEAR_SCALARS,
    "wind_models": [_OBS, _STATIONS, _GRID, _cells(VARIABLES), _WIND, _WIND_MODELS],
    "near_wind": [_OBS, _STATIONS, _GRID, _cells(VARIABLES), _RANKED, *_NEAR_WIND, _wind_cascade(0.5, -10.0)],
    "whole": [*_WHOLE, _STATES],
    "whole_log": [*_WHOLE, _SCALAR_GAPS, _WIND_GAPS, _NEAR_GAPS, "\nlog AS (" + " UNION ALL ".join(_SCALAR_ROWS + _WIND_ROWS + _NEAR_ROWS) + ")"],
}


#: Layers that later ones read more than once; computed once each.
ONCE = ("obs", "wide", "cells", "sc", "runs", "f2", "filled", "filled_own", "merged", "merged_own", "wind", "states", "faulty", "ranked", "known", "vec", "sp_n", "sp_s", "wp_n", "wp_s", "smodel", "wmodel", "attempts", "wattempts")


def sql(layer: str, tail: str, *more: str) -> str:
    whole = "WITH RECURSIVE " + ",".join([*LAYERS[layer], *more]) + "\n" + tail
    for name in ONCE:
        whole = whole.replace(f"\n{name} AS (", f"\n{name} AS MATERIALIZED (")
    return whole


ALLOWED = _ALLOWED
