"""Cells of lattice points that lie just between cells, against the SQL of the queries."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from sectorflow.functions.geo import HexGrid
from sectorflow.plans import catalog

#: Users whose coordinates are equally far from two centres, in one way of rounding or another.
BETWEEN = [6, 93, 279, 30000, 30005, 30007, 59594, 59913, 60001, 60004, 90012, 150012]


@pytest.fixture(scope="module")
def lattice(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lattice"))
    con = duckdb.connect()
    users = ", ".join(f"({u})" for u in BETWEEN)
    con.execute(f"""COPY (SELECT row_number() OVER (ORDER BY u, i) AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (7 * i) AS ts, u AS user_id, 'view' AS event_type, CAST(u % 7 + i AS DOUBLE) AS value, '{{"k": 1}}' AS props
      FROM (SELECT DISTINCT n::BIGINT AS u FROM (VALUES {users}) t(v), (SELECT unnest([v - 15, v - 1, v, v + 1, v + 15]) AS n) WHERE n >= 0), range(12) r(i)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["hex_cells", "cell_text", "cell_centroids", "cell_ring", "neighbor_edges", "hex_coverage", "neighbor_same_hour_agg"])
def test_points_between_cells(spark, lattice, name):
    folder, con = lattice
    sql = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    key = lambda rows: sorted(tuple(round(float(v), 5) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert key(catalog.queries()[name](spark, folder).select(*names).collect()) == key(sql.fetchall())


def test_odd_coordinates_have_no_cell(spark):
    odd = [(0, float("nan"), 0.0), (1, 1e300, 0.0), (2, 0.0, float("inf")), (3, None, 0.0), (4, 0.0, -180.5), (5, 90.0, 180.0), (6, -90.0, -180.0), (7, 30.0, -97.9)]
    got = {r.id: r.cell for r in spark.createDataFrame(odd, "id int, lat double, lon double").select("id", HexGrid().cell(F.col("lat"), F.col("lon")).alias("cell")).collect()}
    assert [got[i] is None for i in range(8)] == [True] * 5 + [False] * 3
    assert got[7] == (1 << 20) * (2 << 20) + (1 << 20)
