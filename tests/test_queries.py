from pathlib import Path

import pytest
from oracle import connection, rows_of, rows_of_sql

from rankloom.plans import packing, ranking, registry, scoring  # noqa: F401


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_rows_equal_sql(spark, con, sf, name):
    assert rows_of(registry.QUERIES[name](spark, sf)) == rows_of_sql(con, registry.SQL[name])


def test_shuffle_keeps_requests_whole(spark, sf):
    rows = [tuple(r) for r in registry.QUERIES["shuffled_requests"](spark, sf).collect()]
    assert rows == [tuple(r) for r in registry.QUERIES["shuffled_requests"](spark, sf).collect()]
    users = [r[1] for r in rows]
    runs = [u for i, u in enumerate(users) if i == 0 or users[i - 1] != u]
    assert len(runs) == len(set(runs))
    assert all(a[0] < b[0] for a, b in zip(rows, rows[1:], strict=False) if a[1] == b[1])


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_expansion_has_no_exchange(spark, sf):
    from rankloom.operators import expand
    from rankloom.plans import fixtures

    path = fixtures.nested(spark, sf)
    from rankloom.sources.shared import shared_folder

    folder = shared_folder(spark, "nested")
    path.write.parquet(folder)
    plan = expand.expand_agg(spark.read.parquet(folder), fixtures.LAYOUT, fixtures.KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("name,padding", [("bag_mean_pool_whole", False), ("bag_mean_pool_whole_with_padding", True)])
def test_whole_pooling_has_every_order_and_line(spark, con, sf, name, padding):
    vectors = {i: v for i, v in con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    bags = {}
    for k, i in con.execute("SELECT l_orderkey, l_partkey % 200 FROM lineitem").fetchall():
        bags.setdefault(k, []).append(i)
    assert any(len(x) > 4 for x in bags.values()) and any(k % 3 for k in bags)
    got = {r["k"]: (r["first"], r["last"]) for r in registry.QUERIES[name](spark, sf).collect()}
    assert got.keys() == bags.keys()
    for k, ids in bags.items():
        n = max(1, len(ids) if padding else sum(i != 0 for i in ids))
        for d, x in zip((0, 63), got[k], strict=True):
            assert abs(x - sum(vectors[i][d] for i in ids if i) / n) < 0.00051


def test_table_shapes_equal_sql_beyond_the_widths_of_small_tables(spark, con, monkeypatch):
    rows = [(f"b{p}", p, 2 * p, "mild") for p in (1, 900, 1001, 4096, 4097, 65_536, 65_537, 131_072, 900_000, 1_000_001, 3_000_000)]
    monkeypatch.setattr(scoring, "_grown", lambda *_: spark.createDataFrame(rows, "field string, projected long, stress long, tier string"))
    given = "g AS (SELECT 1), u AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {p}.0, {r}.0, '{t}')" for f, p, r, t in rows) + ") v(field, p, r, tier))"
    sql = registry.SQL["table_shapes"].replace(scoring._GROWN, given)
    assert rows_of(registry.QUERIES["table_shapes"](spark, "")) == rows_of_sql(con, sql)


@pytest.fixture
def small_parts(spark):
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.files.maxPartitionBytes": "16384"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name,tag,least", [("running_auc", "running-auc-*/in", 5), ("running_counters", "running-counters-*/in", 5), ("running_monitor", "running-monitor-*/in", 5), ("split_statistics", "split-*/part=*", 4)])
def test_files_of_a_query_grow_with_its_table(spark, con, sf, small_parts, name, tag, least):
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(top.glob(f"{tag}/*.parquet"))
    assert rows_of(registry.QUERIES[name](spark, sf)) == rows_of_sql(con, registry.SQL[name])
    assert len(set(top.glob(f"{tag}/*.parquet")) - before) >= least


@pytest.mark.parametrize("name", ["batches_of_rows", "pack_by_length", "compare_pipelines", "differences_by_path"])
def test_nested_rows_are_joined_once_in_a_query(spark, sf, monkeypatch, name):
    from rankloom.plans import fixtures

    own, calls = fixtures.nested, []
    monkeypatch.setattr(fixtures, "nested", lambda *args: calls.append(1) or own(*args))
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(calls) == 1 and "events.parquet" not in plan and "event_type" not in plan
