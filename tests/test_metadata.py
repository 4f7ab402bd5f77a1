"""Times of the metadata are printed as the SQL prints them."""

import duckdb
import pytest

from sectorflow.plans import catalog


@pytest.mark.parametrize("times", [["2024-01-01 00:00:11.172420", "2024-01-30 23:59:25.200000"], ["2024-01-01 00:00:00", "2024-01-01 00:00:00.000001"], []])
def test_metadata_file(spark, tmp_path, times):
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    for i, t in enumerate(times):
        con.execute("INSERT INTO events VALUES (?, CAST(? AS TIMESTAMP), 1, 'view', 1.0, '{\"k\": 1}')", [i, t])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    sql = con.execute(catalog.oracle_sql()["metadata_file"])
    names = [c[0] for c in sql.description]
    assert [tuple(r) for r in catalog.queries()["metadata_file"](spark, str(tmp_path)).select(*names).collect()] == sql.fetchall()
