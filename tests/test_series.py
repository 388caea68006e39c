"""Small series with known answers: gaps, fills, wind, provenance, contract, product checks."""

import json
import math
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stationfill.functions.rules import LOG_COLUMNS, CurationConfig
from stationfill.jobs import curate as jobs
from stationfill.operators import contract, external, fill, gaps, grid, neighbors, postconditions, verify, wind
from stationfill.sources import io
from stationfill.sources.scratch import Scratch

T0 = datetime(2025, 1, 1)


def frame(spark, values, variable="TEMP", station="A", start=T0):
    rows = [(station, start + timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"station string, ts timestamp_ntz, {variable} double")


def windy(spark, pairs):
    rows = [("A", T0 + timedelta(hours=i), None if d is None else float(d), None if s is None else float(s)) for i, (d, s) in enumerate(pairs)]
    return spark.createDataFrame(rows, "station string, ts timestamp_ntz, DIR_VIENTO double, VEL_VIENTO double")


def series(product, column="final", variable="TEMP"):
    return [r[column] for r in product.states.filter(F.col("variable") == variable).orderBy("station", "ts").collect()]


def test_edges_are_structural_and_only_the_middle_is_filled(spark):
    p = jobs.curate(frame(spark, [None, 10, None, 12, None]))
    assert series(p) == [None, 10, 11, 12, None]
    assert series(p, "source") == ["missing_structural", "senamhi_observed", "imputed_short_linear", "senamhi_observed", "missing_structural"]


def test_invalid_is_filled_and_an_outlier_is_kept_and_is_no_anchor(spark):
    p = jobs.curate(frame(spark, [20, -274, 24, 200, 25]))
    assert series(p) == [20, 22, 24, 200, 25]
    assert series(p, "origin_state")[1] == "hard_invalid" and series(p, "source")[3] == "senamhi_operational_outlier"
    p = jobs.curate(frame(spark, [10, None, 200, None, 20]))
    assert series(p) == [10, None, 200, None, 20]


def test_long_gaps_stay_empty_without_evidence(spark):
    p = jobs.curate(frame(spark, [10, *[None] * 5, 20]))
    assert series(p)[1:6] == [None] * 5
    log = jobs.imputation_log(p).collect()
    assert [(r["method_used"], r["n_values_remaining"]) for r in log] == [("unimputable", 5)]


def test_precipitation_is_zero_between_zeros_and_linear_elsewhere(spark):
    p = jobs.curate(frame(spark, [0, None, 0, None, 2], "PP"))
    assert series(p, variable="PP") == [0, 0, 0, 1, 2]
    assert series(p, "method", "PP") == [None, "short_zero", None, "short_linear", None]


def test_weekly_means_need_three_donors(spark):
    values = [10.0 + (i % 5) for i in range(168 * 5)]
    values[336:344] = [None] * 8
    p = jobs.curate(frame(spark, values))
    want = [sum(values[336 + k + 168 * w] for w in (-2, -1, 1, 2)) / 4 for k in range(8)]
    assert series(p)[336:344] == pytest.approx(want)
    values[168:176] = [None] * 8
    values[504:512] = [None] * 8
    assert series(jobs.curate(frame(spark, values)))[336:344] == [None] * 8


def test_the_adjacent_year_gives_what_weeks_do_not(spark):
    first = frame(spark, [1, *[None] * 6, 2])
    later = frame(spark, range(40, 48), start=datetime(2026, 1, 1))
    p = jobs.curate(first.unionByName(later))
    got = p.states.filter(F.col("ts") < datetime(2025, 1, 1, 8)).orderBy("ts").collect()
    assert [r["final"] for r in got] == [1, 41, 42, 43, 44, 45, 46, 2] and got[1]["method"] == "cross_year_analog"


def test_gaps_are_maximal_runs(spark):
    found = gaps.find_gaps(jobs.cells_of(frame(spark, [1, None, None, 4, None, 6]))).orderBy("gap_start").collect()
    assert [(r["gap_id"], r["n_steps"]) for r in found] == [(1, 2), (2, 1)]


def test_wind_is_filled_as_a_vector(spark):
    p = jobs.curate(windy(spark, [(350, 10), (None, None), (10, 10)]))
    direction, speed = series(p, variable="DIR_VIENTO")[1], series(p, variable="VEL_VIENTO")[1]
    assert min(direction, 360 - direction) < 1e-6 and speed == pytest.approx(10 * math.cos(math.radians(10)))


def test_calm_has_no_direction_and_conflicts_are_refused(spark):
    p = jobs.curate(windy(spark, [(90, 0), (None, None), (90, 0)]))
    assert series(p, variable="VEL_VIENTO") == [0, 0, 0] and series(p, "source", "DIR_VIENTO") == ["not_applicable"] * 3
    filled = wind.fill_wind_temporal(jobs.cells_of(windy(spark, [(90, 0), (45, None), (90, 0)])))
    assert [r["n_conflicts"] for r in filled.orderBy("ts").collect()] == [0, 1, 0]
    p = jobs.curate(windy(spark, [(360, 5), (0, 5)]))
    assert series(p, variable="DIR_VIENTO") == [360, 0]


def two_stations(spark, n=240, offset=3.0, hole=range(200, 206), variable="TEMP", scale=2.0):
    x = [10 + 8 * math.sin(i * 0.7) + i % 7 for i in range(n)]
    near = frame(spark, x, variable, "B")
    target = frame(spark, [None if i in hole else scale * v + offset for i, v in enumerate(x)], variable, "A")
    stations = spark.createDataFrame([("A", -12.0, -77.0), ("B", -12.1, -77.0)], "station string, LATITUD double, LONGITUD double")
    return target.unionByName(near), stations, x


def test_a_near_station_gives_exact_values_for_an_exact_relation(spark):
    obs, stations, x = two_stations(spark, variable="PM2_5")
    p = jobs.curate(obs, CurationConfig(min_weekly_donors=99), stations)
    got = p.states.filter("station = 'A' AND method = 'interstation_regression'").orderBy("ts").collect()
    assert [r["final"] for r in got] == pytest.approx([2 * x[i] + 3 for i in range(200, 206)])
    assert p.attempts.filter("accepted").first()["r2"] == pytest.approx(1)


def test_predictions_out_of_range_are_dropped(spark):
    obs, stations, _ = two_stations(spark, variable="HR", scale=1.0, offset=0.0, hole=[*range(200, 206)])
    obs = obs.withColumn("HR", F.when((F.col("station") == "B") & F.col("ts").between(T0 + timedelta(hours=200), T0 + timedelta(hours=205)), F.lit(99.0)).when(F.col("station") == "A", F.col("HR") + 74).otherwise(F.col("HR")))
    reasons = {r["rejection_reason"] for r in jobs.curate(obs, CurationConfig(min_weekly_donors=99), stations).attempts.collect()}
    assert reasons == {"predictions_out_of_range"}


@pytest.mark.parametrize("k", [1, 3, None])
def test_neighbors_are_exact_far_apart_at_poles_and_across_180(spark, k):
    import random

    rng = random.Random(2)
    at = [(rng.uniform(-12.3, -12), rng.uniform(-77.1, -77)) for _ in range(110)] + [(0.0, 179.95), (0.0, -179.95), (0.3, 178.9), (89.9, 0.0), (89.9, 180.0), (89.8, 90.0), (-60.0, 20.0)]
    names = [f"s{i:03d}" for i in range(len(at))]

    def km(a, b):
        (p, x), (q, y) = (map(math.radians, at[i]) for i in (a, b))
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2
        return math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    stations = spark.createDataFrame([*[(n, *c) for n, c in zip(names, at, strict=True)], ("none", None, 1.0)], "station string, LATITUD double, LONGITUD double")
    found = {(r["station"], r["rank"]): r["neighbor"] for r in neighbors.rank_neighbors(stations, k).collect()}
    want = {}
    for i, name in enumerate(names):
        order = sorted((j for j in range(len(at)) if j != i), key=lambda j: (km(i, j), names[j]))
        want |= {(name, rank + 1): names[j] for rank, j in enumerate(order[:k])}
    differ = [key for key in want | found if want.get(key) != found.get(key)]
    assert len(want) == len(found) and all(abs(km(names.index(s), names.index(want[s, r])) - km(names.index(s), names.index(found[s, r]))) < 1e-12 for s, r in differ)


def test_many_stations_keep_neighbors_that_are_far(spark):
    n = 20_100
    many = spark.range(n).select(F.col("id").cast("string").alias("station"), (F.col("id") % 142 * 0.05 - 4).alias("LATITUD"), (F.floor(F.col("id") / 142) * 0.05 + 10).alias("LONGITUD"))
    far = spark.createDataFrame([("x", 60.0, 179.9), ("y", 62.0, -179.9), ("z", -80.0, 0.0)], "station string, LATITUD double, LONGITUD double")
    found = neighbors.rank_neighbors(many.unionByName(far), 1).cache()
    assert found.count() == n + 3
    got = {r["station"]: r["neighbor"] for r in found.filter("station IN ('x', 'y', 'z')").collect()}
    assert got["x"] == "y" and got["y"] == "x" and got["z"] not in ("x", "y")


def test_models_follow_the_time_ordered_folds(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=97)
    y = 2 * x + rng.normal(size=97)
    rows = [("TEMP", "A", "B", T0 + timedelta(hours=i), float(y[i]), float(x[i])) for i in range(97)]
    pairs = spark.createDataFrame(rows, "variable string, station string, neighbor string, ts timestamp_ntz, y double, x double")
    got = neighbors.fit_station_models(pairs).first()
    t, scores = 97 // 6, []
    for j in range(1, 6):
        a = 97 - (6 - j) * t
        b, c = np.polyfit(x[:a], y[:a], 1)
        test = y[a : a + t]
        scores.append(1 - ((test - c - b * x[a : a + t]) ** 2).sum() / ((test - test.mean()) ** 2).sum())
    assert got["r2"] == pytest.approx(np.mean(scores)) and (got["slope"], got["intercept"]) == pytest.approx(tuple(np.polyfit(x, y, 1))) and got["training_pairs"] == 97


def test_wind_models_recover_a_linear_map(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 2))
    y = x @ np.array([[1.0, 0.5], [-0.5, 2.0]]) + [0.1, -0.2]
    rows = [("A", "B", T0 + timedelta(hours=i), *map(float, (*y[i], *x[i]))) for i in range(120)]
    m = neighbors.fit_wind_models(spark.createDataFrame([(wind.VECTOR, *r) for r in rows], "variable string, station string, neighbor string, ts timestamp_ntz, y1 double, y2 double, x1 double, x2 double")).first()
    assert (m["u_by_u"], m["u_by_v"], m["v_by_u"], m["v_by_v"], m["u_base"], m["v_base"], m["r2"]) == pytest.approx((1, -0.5, 0.5, 2, 0.1, -0.2, 1))


def test_contract_names_every_broken_rule(spark):
    good = spark.createDataFrame([("A", 20250101, 0, -12.0, -77.0, 1.0)], "ESTACION string, FECHA int, HORA int, LATITUD double, LONGITUD double, TEMP double")
    assert contract.validate_input(good).count() == 1
    assert contract.check_columns(good.drop("FECHA").withColumn("odd", F.lit(1)).withColumn("DIR_VIENTO", F.lit(1.0)))
    bad = good.union(good).union(spark.createDataFrame([(" A", 20250230, 1030, 95.0, None, 1.0)], good.schema))
    with pytest.raises(contract.ContractError) as e:
        contract.validate_input(bad)
    for rule in ("coordinates: 1", "time_codes: 1", "station_id: 1", "duplicate_keys: 1"):
        assert rule in str(e.value)


def test_a_sound_product_passes_and_each_fault_is_found(spark):
    p = jobs.curate(frame(spark, [10, None, 12, 200, 14]))
    wide, log = grid.to_wide_output(p.states, ["TEMP"]), p.states.filter("method is not null")
    postconditions.assert_postconditions(p.states, wide, log)
    for column, value, rule in (("final", F.lit(99.0), "original_changes"), ("source", F.lit("odd"), "vocabulary"), ("after", F.lit(1e9), "ranges")):
        with pytest.raises(postconditions.PostconditionError, match=rule):
            postconditions.assert_postconditions(p.states.withColumn(column, value), wide, log)
    assert verify.verification_report({"a": p.states.limit(0), "b": ValueError("unreadable")}).orderBy("criterion").collect()[1]["status"] == "NO_CUMPLE"


def test_empty_input_gives_empty_results(spark):
    p = jobs.curate(frame(spark, []))
    assert p.states.count() == 0 and gaps.find_gaps(p.cells).count() == 0


def test_payloads_are_checked_and_normalised(spark, tmp_path):
    text = '{"station":"A","latitude":-12,"longitude":-77,"timezone":"America/Lima","hourly_units":{"precipitation":"mm"},"hourly":{"time":["2025-01-01T00:00","2025-01-01T01:00"],"precipitation":[-1,2.5]}}'
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json").write_text(text.replace('"A"', '"B"').replace("T01:00", "T02:00").replace('"mm"', '"in"'))
    payloads = io.read_forecast_payloads(spark, str(tmp_path))
    assert {(r["station"], r["fault"]) for r in external.payload_faults(payloads).collect()} == {("B", "unit"), ("B", "times")}
    rows = external.payload_rows(payloads.filter("station = 'A'")).orderBy("ts").collect()
    assert [r["value"] for r in rows] == [None, 2.5]
    hours = payloads.limit(1).select(F.lit("A").alias("station"), F.explode(F.sequence(F.lit(T0), F.lit(T0 + timedelta(hours=3)), F.expr("INTERVAL 1 HOUR"))).alias("t")).select("station", F.col("t").cast("timestamp_ntz").alias("ts"))
    with pytest.raises(ValueError, match="2 station hours"):
        external.align_external(hours, external.payload_rows(payloads.filter("station = 'A'")))


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("ESTACION,FECHA,HORA,TEMP\nA,20250101,0,1.5\nA,20250101,10000,\n")
    raw = io.read_observations(spark, str(tmp_path / "raw.csv"), ["TEMP"])
    assert [r["TEMP"] for r in raw.orderBy("HORA").collect()] == [1.5, None]
    (tmp_path / "twice.csv").write_text("ESTACION,ESTACION\nA,B\n")
    with pytest.raises(contract.ContractError):
        io.read_observations(spark, str(tmp_path / "twice.csv"), [])
    manifest = io.artifact_manifest(spark, [str(tmp_path / "raw.csv")]).first()
    assert manifest["bytes"] == (tmp_path / "raw.csv").stat().st_size and len(manifest["sha256"]) == 64
    io.write_report_tables({"t": (raw, ["TEMP", "ESTACION"])}, str(tmp_path / "tables"))
    assert spark.read.csv(str(tmp_path / "tables/t"), header=True).columns == ["TEMP", "ESTACION"]


def logged(product, config=CurationConfig()):
    rows = Scratch(product.states.sparkSession, "log").save(jobs.imputation_log(product, config), "log")
    assert rows.columns == list(LOG_COLUMNS)
    assert postconditions.log_integrity(rows).isEmpty() and verify.verify_log(product.states, rows).isEmpty()
    return [r.asDict() for r in rows.orderBy("station", "variable", "gap_start", "method_used", "source_station").collect()]


def test_log_of_a_short_gap_without_anchors(spark):
    short, left = sorted(logged(jobs.curate(frame(spark, [10, None, 12, None, 200, 20])))[1:], key=lambda r: r["method_used"])
    assert (short["method_used"], short["accepted"], short["rejection_reason"], short["imputed_timestamps"], short["n_values_remaining"]) == ("short_linear", False, "missing_valid_anchors", "", 1)
    assert (left["method_used"], left["rejection_reason"], left["n_values_remaining"]) == ("unimputable", "no_method_available", 1)


def test_log_of_near_stations_has_models_and_refusals(spark):
    obs, stations, _ = two_stations(spark, variable="PM2_5")
    config = CurationConfig(min_weekly_donors=99)
    (row,) = logged(jobs.curate(obs, config, stations), config)
    assert (row["method_used"], row["accepted"], row["n_values_imputed"], row["n_values_remaining"], row["source_station"]) == ("interstation_regression", True, 6, 0, "B")
    assert row["imputed_timestamps"].split("|")[0] == (T0 + timedelta(hours=200)).isoformat() and row["training_pairs"] == 234
    assert float(row["model_coefficient"]) == pytest.approx(2) and float(row["model_intercept"]) == pytest.approx(3)
    assert row["validation_scheme"] == "TimeSeriesSplit(5)" and row["acceptance_threshold"] == 0.5 and row["interstation_r2"] == pytest.approx(1)
    config = CurationConfig(min_weekly_donors=99, interstation_min_r2=1.5)
    refused, left = logged(jobs.curate(obs, config, stations), config)
    assert (refused["accepted"], refused["rejection_reason"], refused["imputed_timestamps"], refused["n_values_remaining"]) == (False, "r2_below_threshold", None, 6)
    assert left["method_used"] == "unimputable"


def test_log_of_wind_names_fields_written_and_vectors_refused(spark):
    rows = logged(jobs.curate(windy(spark, [(0, 2), (None, None), (0, 2)])))
    assert [(r["variable"], r["method_used"], r["n_values_imputed"], r["n_values_remaining"]) for r in rows] == [("DIR_VIENTO", "short_vector_linear", 1, 0), ("VEL_VIENTO", "short_vector_linear", 1, 0)]
    rows = logged(jobs.curate(windy(spark, [(None, 0), (90, None), (None, 0)])))
    assert [(r["variable"], r["method_used"], r["rejection_reason"]) for r in rows] == [
        ("VIENTO_VECTOR", "short_vector_linear", "calm_candidate_conflicts_with_observed_component"), ("VIENTO_VECTOR", "unimputable", "no_vector_method_available")]
    assert rows[0]["rejected_timestamps"] == (T0 + timedelta(hours=1)).isoformat() and rows[0]["n_values_remaining"] == 1



def test_log_of_wind_from_a_near_station(spark):
    def of(i, turn):
        return (i * 37 + turn) % 360, 2.0 + i % 7

    near = windy(spark, [of(i, 0) for i in range(240)]).withColumn("station", F.lit("B"))
    target = windy(spark, [(None, None) if 200 <= i < 206 else of(i, 30) for i in range(240)])
    stations = spark.createDataFrame([("A", -12.0, -77.0), ("B", -12.1, -77.0)], "station string, LATITUD double, LONGITUD double")
    config = CurationConfig(min_weekly_donors=99)
    product = jobs.curate(target.unionByName(near), config, stations)
    rows = logged(product, config)
    assert [(r["variable"], r["method_used"], r["accepted"], r["n_values_imputed"], r["n_values_remaining"], r["source_station"]) for r in rows] == [
        (v, "interstation_vector_regression", True, 6, 0, "B") for v in ("DIR_VIENTO", "VEL_VIENTO")]
    assert rows[0]["validation_scheme"] == "TimeSeriesSplit(5) multisalida" and rows[0]["training_pairs"] == 234
    (uu, uv), (vu, vv) = json.loads(rows[0]["model_coefficient"])
    turn = math.radians(30)
    assert [uu, uv, vu, vv] == pytest.approx([math.cos(turn), math.sin(turn), -math.sin(turn), math.cos(turn)], abs=1e-9)


def test_publishing_checks_first_and_writes_nothing_on_a_breach(spark, tmp_path):
    product = jobs.curate(frame(spark, [10, None, 12, 13]))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    jobs.publish(product, good)
    data, log, summary = io.read_curated(spark, good)
    assert data.count() == 4 and log.columns == list(LOG_COLUMNS) and summary.count() == 2
    with pytest.raises(postconditions.PostconditionError, match="log"):
        jobs.publish(replace(product, scalars=product.scalars.withColumn("method", F.lit(None).cast("string"))), bad)
    assert not (tmp_path / "bad").exists()


def test_precipitation_between_zeros_by_the_linear_policy(spark):
    product = jobs.curate(frame(spark, [0, None, 0], "PP"), CurationConfig(pp_short_method="linear"))
    assert series(product, "method", "PP") == [None, "short_linear", None] and series(product, variable="PP") == [0, 0, 0]


def test_rounds_cover_every_rank_once():
    for most in (0, 1, 11, 16, 17, 50, 200):
        ranks = [k for low, high in neighbors.rounds(most) for k in range(low, high + 1)]
        assert ranks == list(range(1, most + 1)) and all(high - low < 32 for low, high in neighbors.rounds(most))


def many_stations(spark, n=26, hours=160):
    """Station 0 lacks hours that its near stations lack too, so that far ones, in later rounds, fill them."""
    rows, near = [], []
    for s in range(n):
        near.append((f"s{s:02d}", -12.0 - 0.01 * s, -77.0))
        for i in range(hours):
            v = 20 + 10 * math.sin(i * 0.9) + (i * 7 % 5) + 0.1 * s * (i % 3)
            gone = (s == 0 and 100 <= i < 110) or (1 <= s <= 19 and 100 <= i < 110 and not (s == 3 and i < 104) and not (s == 18 and i >= 104)) or (s == 2 and i > 30)
            rows.append((f"s{s:02d}", T0 + timedelta(hours=i), None if gone else v))
    return spark.createDataFrame(rows, "station string, ts timestamp_ntz, TEMP double"), spark.createDataFrame(near, "station string, LATITUD double, LONGITUD double")


def test_near_stations_in_several_rounds(spark):
    """Against the cascade by plain loops: order, coverage of the hours still empty, refusals and their numbers of pairs."""
    import numpy as np

    obs, stations = many_stations(spark)
    config = CurationConfig(min_weekly_donors=99, predictor_min_gap_coverage=0.4, interstation_min_r2=0.6)
    attempts = jobs.curate(obs, config, stations).attempts.filter("station = 's00'").collect()
    value = {(r["station"], r["ts"]): r["TEMP"] for r in obs.collect()}
    hours = sorted({t for _, t in value})
    empty, want = [t for t in hours if value["s00", t] is None], []
    for s in range(1, 26):
        if not empty:
            break
        name = f"s{s:02d}"
        there = [t for t in empty if value[name, t] is not None]
        if len(there) / len(empty) < 0.4:
            want.append((name, False, "insufficient_gap_coverage", None, 0))
            continue
        both = [(value[name, t], value["s00", t]) for t in hours if value[name, t] is not None and value["s00", t] is not None]
        if len(both) < 48:
            want.append((name, False, "insufficient_training_pairs_or_cv", len(both), 0))
            continue
        x, y = (np.array(v) for v in zip(*both, strict=True))
        size, scores = len(x) // 6, []
        for j in range(1, 6):
            a = len(x) - (6 - j) * size
            b, c = np.polyfit(x[:a], y[:a], 1)
            scores.append(1 - ((y[a : a + size] - c - b * x[a : a + size]) ** 2).sum() / ((y[a : a + size] - y[a : a + size].mean()) ** 2).sum())
        good = np.mean(scores) >= 0.6
        want.append((name, bool(good), None if good else "r2_below_threshold", len(both), len(there) if good else 0))
        if good:
            empty = [t for t in empty if t not in there]
    got = {}
    for r in attempts:
        key = (r["neighbor"], r["accepted"], r["rejection_reason"], r["training_pairs"])
        got[key] = got.get(key, 0) + (r["ts"] is not None)
    assert {(*k, n) for k, n in got.items()} == set(want) and len(want) > 16 and any(w[1] for w in want[16:])


def test_models_keep_their_digits_with_a_large_common_offset(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(130, 2))
    y = x @ np.array([[0.7, -0.2], [0.4, 1.1]]) + 0.05 * rng.normal(size=(130, 2))
    rows = [(wind.VECTOR, "A", "B", T0 + timedelta(hours=i), *(1e7 + y[i]).tolist(), *(1e7 + x[i]).tolist()) for i in range(130)]
    rows += [(wind.VECTOR, "A", "C", T0 + timedelta(hours=i), *y[i].tolist(), float(x[i, 0]), float(2 * x[i, 0])) for i in range(130)]
    rows += [(wind.VECTOR, "A", "D", T0 + timedelta(hours=i), *y[i].tolist(), 1.0, 1.0) for i in range(47)]
    pairs = spark.createDataFrame(rows, "variable string, station string, neighbor string, ts timestamp_ntz, y1 double, y2 double, x1 double, x2 double")
    found = {r["neighbor"]: r for r in neighbors.fit_wind_models(pairs).collect()}
    for name, predictors in (("B", x), ("C", np.stack([x[:, 0], 2 * x[:, 0]], axis=1))):
        scores = []
        for j in range(1, 6):
            a = 130 - (6 - j) * 21
            p, q = predictors[:a], y[:a]
            coef = np.linalg.pinv(p - p.mean(axis=0)) @ (q - q.mean(axis=0))
            miss = y[a : a + 21] - q.mean(axis=0) - (predictors[a : a + 21] - p.mean(axis=0)) @ coef
            scores.append((1 - (miss**2).sum(axis=0) / ((y[a : a + 21] - y[a : a + 21].mean(axis=0)) ** 2).sum(axis=0)).mean())
        coef = np.linalg.pinv(predictors - predictors.mean(axis=0)) @ (y - y.mean(axis=0))
        m = found[name]
        assert [m["u_by_u"], m["u_by_v"], m["v_by_u"], m["v_by_v"], m["r2"]] == pytest.approx([*coef[:, 0], *coef[:, 1], np.mean(scores)], abs=1e-6)
    assert (found["D"]["training_pairs"], found["D"]["r2"], found["D"]["u_by_u"], found["D"]["u_base"]) == (47, None, None, None)


@pytest.mark.parametrize("piece", [24, 700])
def test_series_in_pieces_give_the_rows_of_whole_series(spark, piece):
    """Gaps over several pieces, at their borders, and donors two weeks away; scalars and wind."""
    import random

    rng = random.Random(piece)
    rows = []
    for s in "AB":
        gone, i = set(), 0
        while i < 1200:
            n = rng.choice([1, 2, 3, 5, 30, 130])
            if rng.random() < 0.4:
                gone |= set(range(i, i + n))
            i += n + rng.randint(1, 60)
        rows += [(s, T0 + timedelta(hours=i), None if i in gone else 10.0 + i % 24 + i % 7, None if i in gone else (i * 31 % 360) + 0.0, None if i in gone else (i % 9) + 0.5) for i in range(1200)]
    obs = spark.createDataFrame(rows, "station string, ts timestamp_ntz, TEMP double, DIR_VIENTO double, VEL_VIENTO double")
    whole, parts = (jobs.curate(obs, CurationConfig(piece_hours=p)) for p in (None, piece))
    for a, b in ((whole.states, parts.states), (whole.scalars, parts.scalars), (whole.wind, parts.wind)):
        columns = sorted(a.columns)
        assert sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))
    assert whole.scalars.filter("is_gap AND n_steps > 100").count() > 0 and whole.scalars.filter("method = 'weekly_seasonal'").count() > 0


def test_never_seen_series_stay_structural_and_out_of_the_windows(spark):
    some = frame(spark, [10, None, 12]).withColumn("HR", F.lit(None).cast("double"))
    p = jobs.curate(some)
    assert series(p, "source", "HR") == ["missing_structural"] * 3 and series(p) == [10, 11, 12]
    assert p.scalars.filter("variable = 'HR'").count() == 0


def test_a_failed_publication_leaves_the_old_product_whole(spark, tmp_path, monkeypatch):
    """Whatever step fails, readers see data, log and summary of one run."""
    path = str(tmp_path / "out")
    run = lambda k: spark.createDataFrame([("A", 20250101, 0, float(k))], "ESTACION string, FECHA int, HORA int, TEMP double")
    seen = lambda: [x.first()["TEMP"] for x in io.read_curated(spark, path)]
    with pytest.raises(FileNotFoundError):
        io.read_curated(spark, path)
    io.write_curated(run(1), run(1), run(1), path)
    bad = run(2).withColumn("TEMP", F.expr("CAST(raise_error('lost') AS DOUBLE)"))
    for parts in ((bad, run(2), run(2)), (run(2), bad, run(2)), (run(2), run(2), bad)):
        with pytest.raises(Exception, match="lost"):
            io.write_curated(*parts, path)
        assert list(map(float, seen())) == [1.0] * 3
    with monkeypatch.context() as m:
        m.setattr(io, "_replace", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            io.write_curated(run(2), run(2), run(2), path)
    assert list(map(float, seen())) == [1.0] * 3
    for k in (3, 4, 5):
        io.write_curated(run(k), run(k), run(k), path)
        assert list(map(float, seen())) == [float(k)] * 3
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("v-")]) == 2


def test_digests_of_files_of_every_kind(spark, tmp_path):
    import hashlib
    import os

    kinds = {"empty": b"", "feed": b"\n", "feeds": b"\n\n", "open": b"a\nb", "closed": b"a\r\nb\n", "mark": b"\xef\xbb\xbfa\nb", "mark_closed": b"\xef\xbb\xbfa\n", "only_mark": b"\xef\xbb\xbf", "bytes": os.urandom(300_000), "long line": b"x" * 200_000, "packed.gz": b"not really packed"}
    for name, raw in kinds.items():
        (tmp_path / name).write_bytes(raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")  # files in several splits
    try:
        found = {os.path.basename(r["path"]): (r["bytes"], r["sha256"]) for r in io.artifact_manifest(spark, [str(tmp_path)]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {name: (len(raw), hashlib.sha256(raw).hexdigest()) for name, raw in kinds.items()}


def exchanges(df):
    """The exchanges by key of the plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]


def test_one_exchange_by_station_serves_all_windows(spark):
    """Both sides of the grid's join are dealt by station, and no window, of scalars or wind, deals anything again."""
    rows = [(s, T0 + timedelta(hours=i), None if i % 5 == 3 else float(i % 24), None if i % 7 == 2 else float(i * 31 % 360), None if i % 7 == 2 else 2.0 + i % 3) for s in "ABCDE" for i in range(400)]
    obs = spark.createDataFrame(rows, "station string, ts timestamp_ntz, TEMP double, DIR_VIENTO double, VEL_VIENTO double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        keys = [line.split("hashpartitioning(")[1].split("#")[0] for line in exchanges(jobs.cells_of(obs, dealt=3))]
        assert keys.count("station") == len(keys) and not any("ts#" in line or "variable#" in line.split("),")[0] for line in exchanges(jobs.cells_of(obs, dealt=3)) if "hashpartitioning(station#" in line and ", 3)" in line)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before["spark.sql.requireAllClusterKeysForCoPartition"])
        whole, parts = jobs.curate(obs), jobs.curate(obs, CurationConfig(station_buckets=3))
        assert sorted(map(repr, whole.states.collect())) == sorted(map(repr, parts.states.select(*whole.states.columns).collect()))
        assert exchanges(fill.own_candidates(parts.cells)) == [] and len(exchanges(fill.own_candidates(whole.cells))) == 1
        assert exchanges(wind.candidates(wind.vectors(parts.cells))) == []
        assert exchanges(verify.month_counts(parts.states).groupBy("station").count()) == []
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    parts.drop()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("curate_")]
