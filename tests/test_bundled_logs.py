"""Logs of many runs in few files, whole and told apart."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seriesmith import catalog
from seriesmith.queries import files
from seriesmith.sources import logs


def parts(path):
    return sorted(p for p in path.rglob("*.txt"))


def test_bundles_are_logs_one_after_another(spark, tmp_path):
    log = spark.createDataFrame([(7, 1, 1.234, None, 12), (7, 0, 0.0, 50, 21), (-8, 0, 0.0, 5, 0), (None, 3, 2.0, 1, 0)], "run_id long, frame int, dist double, speed int, flag int")
    head = spark.createDataFrame([(7, ["log v1", "video=a, fps=25.000"]), (-8, ["video=b"]), (9, ["video=c"])], "run_id long, header array<string>")
    logs.write_bundles(log, head, str(tmp_path / "logs"))
    raw = b"".join(p.read_bytes() for p in parts(tmp_path / "logs"))
    assert sorted(raw.split(b"\xef\xbb\xbf")) == [
        b"", b"# run_id=\n3,2.00,1,0\n", b"# run_id=-8\n# video=b\n0,0.00,5,0\n", b"# run_id=7\n# log v1\n# video=a, fps=25.000\n0,0.00,50,21\n1,1.23,-1,12\n", b"# run_id=9\n# video=c\n",
    ]
    lines = logs.read_bundles(spark, str(tmp_path / "logs"))
    run = lambda r: r["path"].rsplit("run_id=", 1)[1]
    rows = sorted((run(r), r["frame"], r["dist"], r["speed"], r["flag"]) for r in logs.body_rows(lines).collect())
    assert rows == [("", 3.0, 2.0, 1.0, 0), ("-8", 0.0, 0.0, 5.0, 0), ("7", 0.0, 0.0, 50.0, 21), ("7", 1.0, 1.23, -1.0, 12)]
    assert {run(r): r["settings"].get("video") for r in logs.headers(lines).collect()} == {"": None, "-8": "b", "7": "a", "9": "c"}


@pytest.mark.parametrize("size", [61, 64, 67, 1 << 20])
def test_bundles_read_by_several_tasks(spark, tmp_path, size):
    log = spark.range(900).selectExpr("id % 60 AS run_id", "int(id div 60) AS frame", "0.0D AS dist", "int(id) AS speed", "0 AS flag")
    head = spark.range(60).selectExpr("id AS run_id", "array('log v1', concat('video=', repeat('x', int(id)))) AS header")
    logs.write_bundles(log.coalesce(1), head, str(tmp_path / "logs"))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for k in keys:
        spark.conf.set(k, size)
    try:
        lines = logs.read_bundles(spark, str(tmp_path / "logs"))
        assert size > 1000 or lines.rdd.getNumPartitions() > 60
        rows = logs.body_rows(lines).collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert sorted((int(r["path"].rsplit("run_id=", 1)[1]), r["frame"], r["speed"]) for r in rows) == sorted((k % 60, k // 60, k) for k in range(900))


def test_round_trip_of_many_runs_takes_few_files(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    n = 1200
    users = [None if k % 300 == 7 else k % 300 - 2 for k in range(n)]
    table = pa.table({
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array([k * 1_700_000_000 for k in range(n)], pa.timestamp("us")), "user_id": pa.array(users, pa.int64()),
        "event_type": ["error" if k % 7 == 0 else "view" for k in range(n)], "value": [k * 37 % 400 / 2 for k in range(n)],
    })
    pq.write_table(table, tmp_path / "events.parquet")
    monkeypatch.setattr(files, "scratch", lambda spark, label: str(tmp_path / label))
    columns = ("run_id", "frame", "dist", "speed", "flag")
    got = [tuple(r[c] for c in columns) for r in catalog.queries()["log_round_trip"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()['log_round_trip']})").fetchall()
    in_order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert in_order(got) == in_order(want)
    assert len(parts(tmp_path / "logs")) <= 8
