"""Groups of one row: the query against its SQL."""

import duckdb

from dosewise.catalog import load


def test_quantile_without_degrees_of_freedom(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts, CASE WHEN i = 0 THEN 7 ELSE 1 + i % 2 END AS user_id, 'view' AS event_type, (i * 37 % 97)::DOUBLE AS value, '{\"k\": ' || (i % 100) || '}' AS props FROM range(41) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = {tuple(r) for r in con.execute(load().ORACLE["student_t_quantile"]).fetchall()}
    got = {(r["subject"], r["df"], r["t_crit"]) for r in load().QUERIES["student_t_quantile"](spark, str(tmp_path)).collect()}
    assert got == want and (7, 0, 0.0) in got
