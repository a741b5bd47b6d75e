"""Searches over small catalogs, held against a row-by-row reading of the language."""

import pytest

from lodestone.catalog import derive, latest, renumbered
from lodestone.operators import search as ops
from lodestone.operators.listing import recent, sort_results
from lodestone.query.dates import Clock


def catalog(spark, rows, **how):
    """Rows (name, path[, type, size, mod_time]); ids from 0."""
    whole = [(i, *r, *(1, 0, 0)[len(r) - 2 :]) for i, r in enumerate(rows)]
    return derive(spark.createDataFrame(whole, "file_id long, name string, path string, type int, size long, mod_time long"), **how)


def names(df):
    return [r.name for r in df.orderBy("rank").collect()]


PATHS = [("main.cpp", "/usr/local/src", 1, 100, 1000), ("config.json", "/etc/myapp", 1, 200, 2000), ("readme.md", "/home/user/projects", 1, 300, 3000), ("libfoo.dylib", "/usr/local/lib", 1, 400, 4000), ("include", "/usr/local", 2, 0, 5000), ("top.txt", "", 1, 5, 1)]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("local", {0, 3, 4}), ("/usr/local", set()), ("usr/include", {4}), ("/etc/config", {1}), ("projects", {2}), ("*/lib/*", {3}), ("LIBFOO", {3}),
        ("usr/*/main", {0}), ("usr/lib/libfoo", set()), ("local/lib/lib", {3}), ("/usr/local/*", set()), ("usr/include/", {4}), ("depth:0", {5}),
        ("!local", {1, 2, 5}), ("type:folder", {4}), ("len:<8", {4, 5}), ("parent:/usr/local", {4}), ("size:>250", {2, 3}),
        ("regex:^(main|top)", {0, 5}), ("regex:(?=x)", set()), ("!regex:(", {0, 1, 2, 3, 4, 5}), ("!dm:nonsense", set()), ("path://top", set()), ("/top", {5}),
    ],
)
def test_paths(spark, query, want):
    assert {r.file_id for r in ops.hits(catalog(spark, PATHS), query).collect()} == want


def test_ranking(spark):
    rows = [("xorchid", "/tmp"), ("Orchid 5.app", "/Applications", 5), ("orchid_helper", "/bin"), ("Orchid", "/opt")]
    assert names(ops.search(catalog(spark, rows), "orchid")) == ["Orchid", "orchid_helper", "Orchid 5.app", "xorchid"]
    rows = [("main.cpp", "/usr/local/src"), ("local.conf", "/etc"), ("readme.md", "/usr/local/docs")]
    found = names(ops.search(catalog(spark, rows), "local"))
    assert found[0] == "local.conf" and len(found) == 3
    rows = [("test.txt", "/a/b/c/d/e"), ("test.txt", "/tmp"), ("test.txt", "/a/b/c")]
    assert [r.path for r in ops.search(catalog(spark, rows), "test.txt").orderBy("rank").collect()] == ["/tmp", "/a/b/c", "/a/b/c/d/e"]
    rows = [(f"target_{i}.dat", "/deep/nested/dir") for i in range(20)] + [("target", "/usr")]
    found = ops.search(catalog(spark, rows), "target", 5)
    assert names(found)[0] == "target" and found.count() == 5


def test_words_and_wildcards(spark):
    rows = [("hello.cpp", "/src"), ("hello.h", "/src"), ("world.cpp", "/src"), ("my_test.py", "/src"), ("testing.py", "/src"), ("a%b_c", "/src"), ("étest", "/src")]
    c = catalog(spark, rows)
    ids = lambda q: {r.file_id for r in ops.hits(c, q).collect()}
    assert ids("*.cpp") == {0, 2} and ids("hello.*") == {0, 1} and ids("?orld.cpp") == {2} and ids("a%b*") == {5} and ids("*_c") == {5} and ids("a?b_*") == {5}
    assert ids("ww:test") == {3, 6} and ids("wfn:HELLO.H") == {1} and ids("*") == set(range(7)) and ids("hello.?") == {1}


def test_segments_do_not_go_back(spark):
    rows = [("f", "/a/b/x/b"), ("f", "/a/b"), ("f", "/a/x/b"), ("f", "/x/a/b/y")]
    c = catalog(spark, rows)
    ids = lambda q: {r.file_id for r in ops.hits(c, q).collect()}
    assert ids("a/b/f") == {1, 3} and ids("a/*/b/f") == {0, 1, 2, 3}


def test_directories_are_listed(spark):
    rows = [("local", "/usr", 2), ("bin", "/usr/local", 2), ("x", "/USR/Local"), ("deep", "/usr/local/bin"), ("local", "/opt", 2), ("y", "/opt/local"), ("local", "/usr/x")]
    ids = lambda q: [r.file_id for r in ops.search(catalog(spark, rows), q).orderBy("rank").collect()]
    assert ids("usr/local/*") == [2, 1] and ids("local/*") == [2, 5, 1] and ids("none/*") == []


def test_two_forms_of_unicode(spark):
    rows = [("café.txt", "/x"), ("café.txt", "/y")]
    for query in ("café", "café"):
        assert ops.hits(catalog(spark, rows), query).count() == 2


def test_initials(spark):
    rows = [("重庆报告.txt", "/x"), ("音乐", "/y"), ("zz", "/cq")]
    c = catalog(spark, rows, initials=True)
    assert {r.initials for r in c.collect()} == {"cqbgtxt", "yy", ""}
    assert {r.file_id for r in ops.hits(c, "cqbg").collect()} == {0} and {r.file_id for r in ops.hits(c, "yy").collect()} == {1}


def test_windows(spark):
    rows = [(f"n{i:03}.txt", "/a" if i % 2 else "/b", 1, i, i) for i in range(30)]
    c = catalog(spark, rows)
    assert names(ops.page(c, "txt", 2, 10)) == [f"n{i:03}.txt" for i in range(10, 20)]
    assert [r["rank"] for r in ops.search(c, "txt", 6, path_filter=" /A ").orderBy("rank").collect()] == [2, 4, 6]
    assert tuple(ops.has_more(c, "txt", 29).first()) == (29, True) and tuple(ops.has_more(c, "txt", 30).first()) == (30, False)
    assert ops.search(c, "txt", None).count() == 30 and ops.clamp(None) == 100 and ops.clamp(10**9) == 10_000 and ops.clamp(0) == 1


def test_recent_and_sorts(spark):
    rows = [(f"file{i}.txt", "/tmp", 1, 9 - i, 1000 + 100 * (i // 2)) for i in range(6)] + [("dir", "/tmp", 2, 0, 1)]
    c = catalog(spark, rows)
    assert names(recent(c, 3)) == ["file5.txt", "file4.txt", "file3.txt"]
    found = ops.search(c, "tmp")
    assert names(sort_results(found, "size"))[:2] == ["dir", "file5.txt"]
    assert names(sort_results(found, "name", descending=True))[:2] == ["dir", "file5.txt"]
    assert names(sort_results(found, "path"))[0] == "dir" and names(sort_results(found, "path", descending=True))[0] == "file5.txt"


def test_narrowing_gives_the_same(spark):
    c = catalog(spark, [("a", "/p"), ("zzz-alpha", "/tmp"), ("alpine", "/opt"), ("readme.txt", "/q"), ("beta", "/p")])
    n = ops.Narrowing(c)
    for query in ("a", "al", "alp", "b", "al !z"):
        assert [tuple(r) for r in n.search(query).collect()] == [tuple(r) for r in ops.search(c, query).collect()]
    n.forget()


def test_top_k_plan(spark):
    plan = ops.search(catalog(spark, PATHS), "local size:>1", 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_conditions_reach_the_reader(spark, tmp_path):
    target = str(tmp_path / "catalog")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    catalog(spark, PATHS).write.parquet(target)
    plan = ops.hits(spark.read.parquet(target), "local size:>100 ext:cpp", Clock()).select("file_id")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(match_path_lc,local)" in plan and "GreaterThan(size,100)" in plan and "EqualTo(ext,cpp)" in plan


def test_loading(spark):
    df = spark.createDataFrame([(1, "A", "/x", 1, 1, 1), (2, "a", "/X", 1, 2, 2), (3, "b", "/x", 0, 0, 0)], "file_id long, name string, path string, type int, size long, mod_time long")
    assert {(r.file_id, r.size) for r in latest(df).collect()} == {(2, 2), (3, 0)}
    assert derive(df).count() == 2
    ids = renumbered(spark.range(5, 500, 3).withColumnRenamed("id", "file_id")).orderBy("old_id").collect()
    assert [r.file_id for r in ids] == list(range(165))


def test_contents_narrow(spark):
    found = spark.createDataFrame([(0,), (0,), (2,)], "file_id long")
    assert {r.file_id for r in ops.hits(catalog(spark, PATHS), "nopath:zzz", contents=found).collect()} == {0, 2}
    assert ops.hits(catalog(spark, PATHS), "a >").count() == 0
