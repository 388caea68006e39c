"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from stationfill.jobs import registry

SF = "/root/testdata/sf0.001"
CHECKED = ["coverage_by_station", "find_gaps", "fill_cross_year", "compose_wind_fields", "execution_summary", "verify_provenance", "duplicate_keys", "to_wide_output", "read_observations", "read_forecast_payloads", "payload_faults", "write_curated", "artifact_manifest", "imputation_log_near", "verification_report_faulty", "validate_input"]


def rows(table, names):
    def norm(x):
        if x is None or x != x:
            return None
        return round(float(x), 4) + 0.0 if isinstance(x, (float, int)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(norm(x) for x in r) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toArrow()
    want = duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got, sorted(got.column_names)) == rows(want, sorted(got.column_names))


def test_all_sql_belongs_to_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
