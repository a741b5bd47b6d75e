"""Queries on lines whose keys are beyond what a long holds."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone import suite
from lodestone.catalog import latest
from lodestone.operators import listing
from lodestone.operators.search import ranked
from lodestone.sources import adapters
from tests.conftest import DATA

QUERIES = ["date_aliases", "dedup_latest", "dm_before", "dm_cmp", "dm_day", "dm_month", "dm_open_range", "dm_range", "dm_year", "recent_20", "size_open"]


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """(folder, connection): the lines again with order keys around 2 ** 23, MOST_ORDER and 2 ** 33, the other tables as they are.
    The connection has the order key as a wide number, so that the same SQL gives the whole file_id."""
    folder, con, sf = tmp_path_factory.mktemp("large"), duckdb.connect(), DATA / "sf0.001"
    for t in ("supplier", "nation", "region"):
        con.execute(f"copy (from '{sf}/{t}.parquet') to '{folder}/{t}.parquet'")
        con.execute(f"create view {t} as from '{folder}/{t}.parquet'")
    # 2 ** 23 - 700: some of these keys just fit
    con.execute(f"copy (select * replace (l_orderkey + shift as l_orderkey) from '{sf}/lineitem.parquet', (values (0), (8387908), (16711000), (8589934592)) x(shift)) to '{folder}/lineitem.parquet'")
    con.execute(f"create view lineitem as select * replace (l_orderkey::hugeint as l_orderkey) from '{folder}/lineitem.parquet'")
    return str(folder), con


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def seen(rows):
    """Rows (name, file_id, ...) without the ids that are hashes."""
    return sorted((r[0], 0 if int(r[0][1:].split("_")[0]) > adapters.MOST_ORDER else signed(int(r[1])), *r[2:]) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_like_sql_in_wide_numbers(spark, large, name):
    folder, con = large
    df = entry.queries()[name](spark, folder)
    columns = ["name", "file_id", *(c for c in df.columns if c not in ("name", "file_id"))]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name == "recent_20":  # lines of one time go by their ids, hashes among them
        lines = sorted(adapters.catalog(spark, folder, "lineitem").collect(), key=lambda r: (-r.mod_time, -(r.file_id % (1 << 64))))
        assert got == [tuple({**r.asDict(), "rank": i}[c] for c in columns) for i, r in enumerate(lines[:20], 1)]
        return
    assert seen(got) == seen(con.execute(f"select {', '.join(columns)} from ({suite.SQL[name]}) x").fetchall())
    assert any(r[1] < 0 for r in got) and any(r[1] > 0 for r in got)


def test_ties_go_by_the_whole_key(spark, large):
    """Lines of one time, score or path whose keys are within 64 bits."""
    folder, con = large
    lines = adapters.catalog(spark, folder, "lineitem").withColumns({"mod_time": F.lit(0).cast("long"), "order": F.substring_index(F.substring("name", 2, 99), "_", 1).cast("long")})
    lines = lines.filter(F.col("order") <= adapters.MOST_ORDER).drop("order")
    ids = sorted(r.file_id % (1 << 64) for r in lines.select("file_id").collect())
    assert ids[0] < 1 << 63 <= ids[-1]
    assert [r.file_id % (1 << 64) for r in listing.recent(lines, 200).orderBy("rank").collect()] == ids[:-201:-1]
    found = ranked(lines.withColumn("score", F.lit(0)), 10_000).orderBy("rank").collect()
    assert [r.file_id % (1 << 64) for r in found] == ids[:10_000]
    assert [r.file_id % (1 << 64) for r in latest(lines.withColumns({"path": F.lit("/"), "name": F.lit("x")})).collect()] == ids[-1:]


def test_ids_differ_at_any_order_key(spark):
    """Exact where the key fits, negative and distinct beyond; null where a key is."""
    keys = [*range(-3, 4), (1 << 23) - 1, 1 << 23, adapters.MOST_ORDER, adapters.MOST_ORDER + 1, (1 << 24) - 1, 1 << 24, (1 << 24) + 1, 1 << 40, 1 << 62, (1 << 63) - 1]
    lines = [(o, n, p, s) for o in keys for n in (1, 7) for p in (0, 19_999, 1_199_999) for s in (0, 999)]
    lines += [(None, 1, 1, 1), (1 << 40, None, 1, 1), (1, 1, None, 1), (1, 1, 1, None)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").selectExpr("*", "timestamp_ntz'1995-01-02 00:00:00' l_shipdate")
    key = adapters.LINE_KEYS["spark"].format(days=adapters.DIALECTS["spark"]["days"].format("l_shipdate"))
    got = {tuple(r[:4]): r.id for r in df.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{key} id").collect()}
    whole = {x: None if None in x else (((x[0] * 8 + x[1]) * 32768 + x[2]) * 1024 + x[3]) * 4096 + 1097 for x in lines}
    assert all(got[x] == (n if n is None or n < 1 << 63 else signed(n)) for x, n in whole.items() if n is None or x[0] <= adapters.MOST_ORDER)
    beyond = [got[x] for x, n in whole.items() if n is not None and n >= 1 << 63]
    assert max(beyond) < 0 and len(set(beyond)) == len(beyond)
    for o in keys[-8:]:  # a line's rows are in the order of their whole keys
        for n in (1, 7):
            ids = [got[o, n, p, s] for p in (0, 19_999, 1_199_999) for s in (0, 999)]
            assert ids == sorted(ids)


#: Added to a line's part key, and to its and its supplier's supplier key, by millions of its order key.
OTHER = [(0, 0), (0, 1 << 51), (0, 1 << 53), (0, (1 << 62) + (1 << 61)), (1 << 62, 0), (-(1 << 62), -(1 << 53))]


@pytest.fixture(scope="module")
def others(tmp_path_factory):
    """(folder, connection): the lines again with each of OTHER. Of the first two, ids are within 64 bits."""
    folder, con, sf = tmp_path_factory.mktemp("others"), duckdb.connect(), DATA / "sf0.001"
    for t in ("nation", "region"):
        con.execute(f"copy (from '{sf}/{t}.parquet') to '{folder}/{t}.parquet'")
        con.execute(f"create view {t} as from '{folder}/{t}.parquet'")
    con.execute("create table x as select * from (values " + ", ".join(f"({i}, {p}::bigint, {s}::bigint)" for i, (p, s) in enumerate(OTHER)) + ") x(i, p, s)")
    con.execute(f"copy (select * replace (s_suppkey + s as s_suppkey) from '{sf}/supplier.parquet', (select distinct s from x)) to '{folder}/supplier.parquet'")
    con.execute(f"copy (select * exclude (i, p, s) replace (l_orderkey + i * 1000000 as l_orderkey, l_partkey + p as l_partkey, l_suppkey + s as l_suppkey) from '{sf}/lineitem.parquet', x) to '{folder}/lineitem.parquet'")
    con.execute(f"create view supplier as from '{folder}/supplier.parquet'")
    con.execute(f"create view lineitem as select * replace (l_orderkey::hugeint as l_orderkey) from '{folder}/lineitem.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["dm_before", "dm_cmp", "dm_day", "dm_month", "dm_open_range", "dm_range", "dm_year"])
def test_other_keys_of_any_size(spark, others, name):
    """Part and supplier keys beyond what the id holds raise nothing either."""
    folder, con = others
    df = entry.queries()[name](spark, folder)
    columns = ["name", "file_id", *(c for c in df.columns if c not in ("name", "file_id"))]
    at = lambda row: int(row[0][1:].split("_")[0]) // 1_000_000
    whole = lambda rows: sorted((r[0], signed(int(r[1])) if at(r) < 2 else 0, *r[2:]) for r in rows)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert whole(got) == whole(con.execute(f"select {', '.join(columns)} from ({suite.SQL[name]}) x").fetchall())
    assert {at(r) for r in got} == set(range(len(OTHER))) and all((r[1] < 0) == (at(r) > 0) for r in got)
    assert len({r[1] for r in got}) == len(got)


def test_ids_of_integer_keys(spark):
    """Keys that are stored as integers have the ids of longs."""
    lines = [(o, n, p, s) for o in (0, 1, (1 << 23) - 1, 1 << 23, adapters.MOST_ORDER) for n in (1, 7) for p in (0, 1_199_999) for s in (0, 59_999)]
    df = spark.createDataFrame(lines, "l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int").selectExpr("*", "timestamp_ntz'1995-01-02 00:00:00' l_shipdate")
    key = adapters.LINE_KEYS["spark"].format(days=adapters.DIALECTS["spark"]["days"].format("l_shipdate"))
    got = {tuple(r[:4]): r.id for r in df.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{key} id").collect()}
    assert got == {x: signed((((x[0] * 8 + x[1]) * 32768 + x[2]) * 1024 + x[3]) * 4096 + 1097) for x in lines}
