"""Of equal values the first row in the table's files is best, as in SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seriesmith import catalog


def write(path, rows):
    columns = {"event_id": pa.int64(), "user_id": pa.int64(), "event_type": pa.string(), "value": pa.float64()}
    pq.write_table(pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(columns.items())}), path)


def test_any_and_best_of_equal_values(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    nan = float("nan")
    (tmp_path / "events.parquet").mkdir()
    # ids fall, so their order is not the files'
    first = [
        (90, 1, "view", 5.0), (89, 1, "click", 7.5), (88, 1, "error", 7.5), (87, 1, "click", 7.5), (86, 1, "signup", 1.0),
        (85, 2, None, 9.0), (84, 2, "view", 3.0), (83, 2, "click", None), (82, 2, "error", 3.0),
        (81, 3, "view", 250.0), (80, 3, "click", nan), (79, 3, "error", nan),
        (78, 4, "view", -0.0), (77, 4, "click", 0.0), (76, 5, "view", None), (75, 6, "purchase", 4.0),
    ]
    write(tmp_path / "events.parquet" / "a.parquet", first)
    write(tmp_path / "events.parquet" / "b.parquet", [(9, 6, "click", 4.0), (8, 7, "error", 2.0), (7, 7, "view", 2.0)])
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["any_and_best"] + " ORDER BY user_id").fetchall()
    got = [tuple(r[c] for c in ("user_id", "any_high", "best", "clicks")) for r in catalog.queries()["any_and_best"](spark, str(tmp_path)).orderBy("user_id").collect()]
    assert got == want
    assert [r[2] for r in got] == ["click", "view", "click", "view", None, "purchase", "error"]
