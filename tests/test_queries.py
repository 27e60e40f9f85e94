"""Every query that has SQL, against a second engine on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tideway.plans import shapes
from tideway.plans.adapters import Views
from tideway.plans.registry import ORACLES, QUERIES
from tideway.sources import feeds

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def second(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, second, sf, name):
    got = QUERIES[name](spark, sf)
    want = second.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    assert rows == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())
    assert rows


def test_components_of_every_reception(spark, tmp_path):
    """One chain of nodes over many receptions, and a group of its own, against a plain union-find."""
    paths = {i: [f"s{i}", f"s{i + 1}"] for i in range(1, 60)} | {60: ["s200", "", "s201"], 61: ["s300", "s301"]}
    rows = [(i, f"c{i if i > 59 else 0}", 0, 0, p) for i, p in paths.items()]
    views = Views(spark, str(tmp_path))
    views.mesh_observations = spark.createDataFrame(rows, "obs_id long, pubkey string, heard_at long, snr int, path_nodes array<string>")
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for _, sender, _, _, path in rows:
        for x, y in zip([sender, *path], path, strict=False):
            if x and y and x != y:
                low, high = sorted((root(x), root(y)))
                above[high] = low
    assert {r.node: r.root for r in shapes.a18_components_whole(views).collect()} == {x: root(x) for x in list(above)}
    assert {root(x) for x in list(above)} == {"c0", "c60", "c61"}


def test_forecast_hours_of_many_bodies(spark):
    """The later block counts, whatever the places in the bodies."""
    item = '{"validTime":"2024-01-01T00:00:00Z/PT%dH","value":%d}'
    body = '{"properties":{"amount":{"values":[%s]}}}'
    rows = [(1, body % (item % (2, 6))), (0, body % ",".join([item % (3, 9), item % (3, 12)]))]
    got = feeds.forecast_hours(spark.createDataFrame(rows, "block long, body string"), "amount").orderBy("hour").collect()
    assert [(r.value, r.share) for r in got] == [(6, 3), (6, 3), (12, 4)]


def events_folder(tmp_path, rows):
    """A folder of tables whose events (event_id, ts, user_id, event_type, value, k) are these."""
    con = duckdb.connect()
    con.execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into e values (?, ?, ?, ?, ?, ?)", [(*r[:5], '{"k": %d}' % r[5]) for r in rows])
    con.execute(f"copy e to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    con.execute("set threads=1")
    return con


#: Events between which an order by time, place or distance leaves a tie: the earlier one of the table counts.
TIED = {
    "a21_node_reports": [(1, "2024-01-02 00:00:00.1", 7, "view", 11.0, 1), (2, "2024-01-02 00:00:00.6", 7, "view", 22.0, 1)],
    "q23_road_incidents": [(4_000, "2024-01-02", 7, "error", 11.0, 2), (24_000, "2024-01-03", 7, "error", 11.0, 5)],
    "j23_continued_ids": [(3, "2024-01-02", 7, "click", 1.0, 2), (9_999, "2024-01-02", 7, "view", 1.0, 2), (14_999, "2024-01-02", 7, "view", 1.0, 2)],
}


@pytest.mark.parametrize("name", sorted(TIED))
def test_tied_rows_by_the_order_of_the_table(spark, tmp_path, name):
    con = events_folder(tmp_path, TIED[name])
    want = con.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    got = [tuple(plain(r[c]) for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())


def test_entry_and_registry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[0] == "id"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark, sf):
    plan = QUERIES["a3_coverage"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan or "PushedFilters: [Or(EqualTo(event_type" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_fires_equally_near_but_for_their_rounding(spark, tmp_path):
    """Two fires of one distance, told apart by places as they were observed, not as the shapes have them."""
    seq = {35_000 + i * 7919 % 5000: i for i in range(5000)}
    rows = [(seq[38_795], "2024-01-02", 1443, "click", 11.0, 1), (seq[39_013], "2024-01-02", 1618, "click", 11.0, 1), (seq[38_904], "2024-01-02 01:00:00", 947, "error", 11.0, 1)]
    con = events_folder(tmp_path, rows)
    for name in ("j25_related_rules", "q6_related_events"):
        want = con.execute(ORACLES[name])
        columns = [x[0] for x in want.description]
        got = sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(want.fetchall()) and any(947 == int(x.split(":")[1]) for r in got for x in r[:2])
