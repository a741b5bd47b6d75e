"""Content search, postings, mutations, streams, sources, sinks, highlights and history on small tables."""

import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestone import catalog as catalogs
from lodestone.functions import text
from lodestone.operators import content, highlight, history, listing, mutations, postings
from lodestone.operators.content_index import ContentIndex, keyed
from lodestone.operators.postings import NameIndex
from lodestone.operators.search import hits, subtree
from lodestone.operators.sessions import Cancelled, Sessions
from lodestone.sinks import export
from lodestone.sources import scan
from lodestone.streaming import changes as streams

FILE = "file_id long, name string, path string, type int, size long, mod_time long"


def files(spark, rows):
    return spark.createDataFrame([(i, n, p, 1, 0, 0) for i, (n, p) in enumerate(rows)], FILE)


def change(seq, op, target, path=None, size=0):
    name = (path or target).rpartition("/")[2]
    return (seq, op, target, name, (path or target).rpartition("/")[0], 1, size, 0)


def changes(spark, rows):
    return spark.createDataFrame(rows, streams.CHANGE)


def paths(df):
    return sorted(r[0] for r in df.select(text.full_path(F.col("path"), F.col("name"))).collect())


def test_content(spark):
    body = "first line\n" + "x" * 100 + " the Needle here\nnext " + "y" * 200
    rows = [(1, body), (2, "needle"), (3, "no"), (4, None), (5, ""), (6, "é needle é")]
    df = spark.createDataFrame(rows, "file_id long, text string")
    found = {r.file_id: r for r in content.content_search(df, "NEEDLE").collect()}
    assert set(found) == {1, 2, 6} and found[6].match_offset == 3 and found[2].snippet == "needle"
    s = found[1].snippet
    assert s.startswith("...") and s.endswith("...") and " the Needle here next " in s and "\n" not in s
    assert content.content_search(df, "ne").count() == 0 and content.content_search(df, "needle", 1).collect()[0].file_id == 1
    near = spark.createDataFrame([(1, "a" * 50 + "\n needle")], "file_id long, text string")
    assert content.content_hits(near, "needle").first().snippet == "a" * 50 + "  needle"  # the window holds the start
    far = spark.createDataFrame([(1, "a" * 90 + "\n needle")], "file_id long, text string")
    assert content.content_hits(far, "needle").first().snippet == "...needle"


def test_content_config(spark):
    config = content.ContentConfig(frozenset(("py", "makefile")))
    df = spark.createDataFrame([("a.PY",), ("Makefile",), ("x.makefile",), ("b.c",), ("py",), ("d.",)], "name string")
    assert [r[0] for r in df.filter(config.allows(F.col("name"))).collect()] == ["a.PY", "Makefile", "x.makefile", "py"]
    for bad in ({"extensions": frozenset((".c",))}, {"extensions": frozenset(("x" * 65,))}, {"largest": 0}):
        with pytest.raises(ValueError):
            content.ContentConfig(**bad)


def test_postings(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, "ab"), (3, "HELLO"), (4, "")], "file_id long, name_lc string")
    rows = postings.trigram_postings(df).collect()
    assert sum(r.file_id == 1 for r in rows) == 9 and not any(r.file_id in (2, 4) for r in rows)
    found = {r.file_id for r in postings.candidates(postings.trigram_postings(df), "hello").collect()}
    assert found == {1, 3} and postings.candidates(postings.trigram_postings(df), "he") is None
    pairs = spark.createDataFrame([(1, "中文字a中文"), (2, "中a文")], "file_id long, name_lc string")
    assert sorted((r.file_id, r.key) for r in postings.pair_postings(pairs).collect()) == [(1, "中文"), (1, "文字")]


def test_last_change_wins(spark):
    base = files(spark, [("file0.txt", "/data"), ("file1.txt", "/Data"), ("file2.txt", "/data")])
    log = changes(spark, [change(1, "REMOVE", "/data/FILE0.txt"), change(2, "UPDATE", "/data/file1.txt", size=999), change(3, "UPDATE", "/data/file3.txt"), change(4, "ADD", "/x/a", size=1), change(5, "ADD", "/X/A", size=2), change(6, "REMOVE", "/gone")])
    out = mutations.apply(base, log)
    assert paths(out) == ["/X/A", "/data/file1.txt", "/data/file2.txt", "/data/file3.txt"]
    assert {r.size for r in out.filter("size > 0").collect()} == {999, 2}
    assert paths(mutations.apply(out, log)) == paths(out)  # a replay changes nothing


def test_updates_move(spark):
    base = files(spark, [("a", "/d"), ("b", "/d")])
    log = changes(spark, [change(1, "UPDATE", "/d/a", "/d/b"), change(2, "UPDATE", "/d/b", "/e/c")])
    assert paths(mutations.apply(base, log)) == ["/e/c"]
    assert paths(mutations.apply(base, log.limit(0))) == ["/d/a", "/d/b"]


def test_prefixes(spark):
    base = files(spark, [("a", "/Users"), ("b", "/Users2"), ("Users", "/"), ("c", "/users/x")])
    assert paths(mutations.remove_prefix(base, "/users/")) == ["/Users2/b"]
    fresh = files(spark, [("n", "/Users/new")])
    assert paths(mutations.rescan_prefix(base, "/Users", fresh)) == ["/Users/new/n", "/Users2/b"]
    df = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/d/",), ("/c/d/e",), ("",)], "path string")
    assert sorted(r.path for r in mutations.minimal_paths(df).collect()) == ["/a", "/ab", "/c/d"]
    root = df.unionAll(spark.createDataFrame([("/",)], "path string"))
    assert [r.path for r in mutations.minimal_paths(root).collect()] == ["/"]


def test_compaction(spark):
    base = files(spark, [("a", "/d"), ("A", "/d"), ("b", "/d"), ("c", "/d")]).withColumn("type", F.when(F.col("name") == "b", 0).otherwise(1))
    out, followed = mutations.compact(base, base.select("file_id", F.col("name").alias("content")))
    assert sorted((r.file_id, r.name) for r in out.collect()) == [(0, "A"), (1, "c")]
    assert sorted((r.file_id, r.content) for r in followed.collect()) == [(0, "A"), (1, "c")]


def test_renames_by_identity(spark):
    old = spark.createDataFrame([("a", "/d", 7, 1), ("b", "/d", 0, 1), ("c", "/d", 7, 2)], "name string, path string, inode long, dev_id int")
    events = spark.createDataFrame([(7, 1, "/e/a"), (0, 1, "/e/b"), (7, 2, "/D/C")], "inode long, dev_id int, full_path string")
    assert [(r.full_path, r.old_path) for r in mutations.renamed_from(events, old).collect()] == [("/e/a", "/d/a")]


def test_stream_equals_batch(spark, tmp_path):
    base = files(spark, [("file0.txt", "/data"), ("keep", "/data")])
    table = streams.ChangeTable(spark, str(tmp_path / "table"))
    table.create(base)
    logs = [[change(1, "ADD", "/n/1"), change(2, "REMOVE", "/data/file0.txt")], [change(3, "UPDATE", "/n/1", "/n/2", 5), change(4, "ADD", "/n/3")], [change(5, "REMOVE", "/n/3")]]
    source = str(tmp_path / "source")
    for log in logs:
        changes(spark, log).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(streams.CHANGE).parquet(source)
        query = table.follow(stream, str(tmp_path / "checkpoint"))
        query.awaitTermination(60)
    want = mutations.apply(base, changes(spark, sum(logs, [])))
    assert paths(table.read()) == paths(want) == ["/data/keep", "/n/2"]
    table.append(changes(spark, logs[1]), 1)  # a batch again
    assert paths(table.read()) == paths(want)
    table.compact()
    table.append(changes(spark, logs[0]), 0)  # and one that the base holds
    assert paths(table.read()) == paths(want)


def test_sessions(spark):
    rows = [("a", 0), ("a", 4), ("a", 8), ("a", 20), ("b", 3)]
    df = spark.createDataFrame(rows, "root string, s long").select("root", F.timestamp_seconds("s").alias("at"))
    want = [("a", 0, 8, 3), ("a", 20, 20, 1), ("b", 3, 3, 1)]
    for made in (streams.gaps(df), streams.sessions(df)):
        assert sorted((r.root, int(r.first_at.timestamp()), int(r.last_at.timestamp()), r.requests) for r in made.collect()) == want
    runs = lambda seconds: sorted((r.root, int(r.run_at.timestamp()), r.requests) for r in streams.throttled(streams.gaps(df), seconds).collect())
    assert runs(300) == [("a", 8, 3), ("a", 308, 1), ("b", 3, 1)] and runs(10) == [("a", 8, 3), ("a", 20, 1), ("b", 3, 1)]


def test_routes(spark):
    schema = "seq long, full_path string, exists boolean, must_rescan boolean, is_dir boolean, name string, path string, type int, size long, mod_time long"
    rows = [(1, "/a/b", True, False, False, "b", "/a", 1, 0, 0), (2, "/a/c", False, False, True, "c", "/a", 2, 0, 0), (3, "/d", False, False, True, "d", "", 2, 0, 0), (4, "/e", True, True, True, "e", "", 2, 0, 0)]
    out = streams.routed(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert [(r.op, r.rescan) for r in out] == [("UPDATE", None), ("REMOVE", "/a"), ("REMOVE", "/"), ("UPDATE", "/e")]


def test_scans(spark, tmp_path):
    for name in ("a/b/x.txt", "a/.hidden/y", "a/Tool.app/inner", "node/z.o", "Library/Caches/c", "top.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text " + name)
    os.symlink(tmp_path / "top.md", tmp_path / "link")
    root = str(tmp_path)
    config = scan.ScanConfig((root,), excluded=(root + "/NODE",), patterns=("*.tmp",))
    got = scan.complete(scan.scan(spark, config))
    assert {p.removeprefix(root): t for p, t in ((r[0], r[1]) for r in got.select(text.full_path(F.col("path"), F.col("name")), "type").collect())} == {"/a": 2, "/a/b": 2, "/a/b/x.txt": 1, "/a/Tool.app": 5, "/Library": 2, "/top.md": 1, "/link": 3}
    everything = scan.ScanConfig((root,), hidden=True, system=True, bundles=True)
    assert scan.scan(spark, everything).count() == 14
    full = text.full_path(F.col("path"), F.col("name"))
    assert scan.scan(spark, everything).filter(scan.allowed(config, full, F.col("name"))).count() == 8
    with pytest.raises(ValueError):
        scan.complete(spark.createDataFrame([("no access",)], "error string"))
    (tmp_path / "bin").write_bytes(b"a\0b")
    (tmp_path / "empty").write_bytes(b"")
    texts = {r.full_path.removeprefix(root): r.text for r in scan.read_texts(spark, root).collect()}
    assert texts["/a/b/x.txt"] == "text a/b/x.txt" and "/bin" not in texts and "/empty" not in texts


def test_logs_stop_at_damage(spark, tmp_path):
    log = scan.with_checksum(changes(spark, [change(i, "ADD", f"/x/{i}") for i in range(6)]))
    damaged = log.withColumn("size", F.when(F.col("seq") == 4, 9).otherwise(F.col("size")))
    for name, df, n in (("good", log, 6), ("bad", damaged, 4)):
        df.write.parquet(str(tmp_path / name))
        assert scan.read_log(spark, str(tmp_path / name)).count() == n


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, '=x"y.TXT', "/a\tb", 1, 7, 86_400)], FILE)
    assert export.csv_lines(df).first().line == '"\'=x""y.TXT","/a\tb","txt","7","1970-01-02T00:00:00Z",""'
    assert export.txt_lines(df).first().line == '=x"y.TXT\t/a b\ttxt\t7\t1970-01-02T00:00:00Z\t'
    assert export.json_lines(df).first().line == '{"name":"=x\\"y.TXT","path":"/a\\tb/=x\\"y.TXT","type":1,"size":7,"modTime":86400}'
    match = df.withColumn("snippet", F.lit("s")).withColumn("match_offset", F.lit(3))
    assert export.json_lines(match).first().line.endswith('"snippet":"s","matchOffset":3}')
    target = str(tmp_path / "out")
    export.write_lines(export.csv_lines(df), target, "name")
    part = next(x for x in os.listdir(target) if x.startswith("part"))
    assert (tmp_path / "out" / part).read_text().startswith("﻿name\n")


def test_highlights(spark):
    assert highlight.ranges_of("red ring.txt", "/bring/x", highlight.hints("ring")) == ([(4, 8)], [(2, 6)])
    assert highlight.ranges_of("b.txt", "/x/a", highlight.hints('"a/b"')) == ([(0, 1)], [(3, 4)])
    assert highlight.ranges_of("aXbc", "/p", highlight.hints("a*c !x")) == ([(0, 1), (3, 4)], [])
    assert highlight.ranges_of("my_test", "/test", highlight.hints("ww:test")) == ([(3, 7)], [])
    assert highlight.ranges_of("Abc", "/d", highlight.hints("regex:b.")) == ([(1, 3)], []) and highlight.hints("a >") == []
    assert highlight.merged([(3, 5), (1, 3), (7, 7)]) == [(1, 5)]
    df = spark.createDataFrame([("ring", "/p")], "name string, path string")
    assert highlight.highlight(df, "ring").first().name_ranges[0].length == 4


def test_history(spark):
    log = spark.createDataFrame([("Foo", 1), ("foo ", 5), ("fob", 9), ("f", 1), ("content:x", 2)], "query string, at long")
    counted = history.frequencies(log)
    assert {(r.query, r.uses, r.last_used) for r in counted.collect()} == {("foo", 2, 5), ("fob", 1, 9)}
    assert history.best_match(counted, "FO").first().query == "foo" and history.best_match(counted, "x").count() == 0
    words = spark.createDataFrame([("alphabet",), ("alpha",), ("Alps",)], "keyword string")
    assert history.shortest_keyword(words, "al").first().keyword == "Alps"
    assert history.compose(" a ", "images", (5, 1), "today") == "a pic: size:1mb..5mb dm:today"
    recent = spark.createDataFrame([("a.PDF", 1), ("d", 2), ("b.app", 5)], "name string, type int")
    assert [history.quick_recent(recent, q).count() for q in ("all", "files", "folders", "documents")] == [3, 2, 1, 1]
    timings = spark.createDataFrame([("a", float(x)) for x in range(1, 102)], "query string, ms double")
    assert tuple(history.latencies(timings).first())[1:4] == (51.0, 51.0, 96.0)


def test_functions(spark):
    df = spark.createDataFrame([(".bashrc", "/"), ("a.tar.GZ", ""), ("none", "/x"), ("dot.", "/x")], "name string, path string")
    got = df.select(text.extension(F.col("name")), text.full_path(F.col("path"), F.col("name")), text.depth(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [("bashrc", "/.bashrc", 1), ("gz", "a.tar.GZ", 0), ("", "/x/none", 1), ("", "/x/dot.", 1)]
    assert text.initials_of("长城Ａ b-1") == "ccab1" and text.initials_of("abc") == "" and text.initials_of("㐀") == "㐀"
    nfd = spark.createDataFrame([("é",), ("a",), (None,)], "t string").select(text.composed(F.col("t"))).collect()
    assert [r[0] for r in nfd] == ["é", "a", None]


def test_policy_below_the_roots(spark):
    rows = [("/home/.data/a/x.txt", True), ("/home/.data/.b/x", False), ("/home/.data/a/tmp1/y", False), ("/home/other", False), ("/System/Volumes/z", True), ("/System/Library/q", False), ("/home/.data/out/k", True), ("/home/.data/skip/k", False)]
    config = scan.ScanConfig(("/home/.data", "/System/Volumes"), excluded=("/home", "/home/.data/SKIP"), patterns=("TMP[0-9]", "[!a-z]*.bak"))
    df = spark.createDataFrame([(p, p.rpartition("/")[2], want) for p, want in rows], "p string, name string, want boolean")
    assert df.filter(scan.allowed(config, F.col("p"), F.col("name")) != F.col("want")).collect() == []
    assert config.exclusions == ["/home/.data/SKIP"] and config.system_roots == ["/System/Volumes"]
    assert not config.skips("/System/Volumes/z", "z") and config.skips("/System/x", "x")


def test_scans_of_many_levels(spark, tmp_path):
    for i in range(3):
        for j in range(4):
            (tmp_path / f"top/d{i}/e{j}/f").mkdir(parents=True)
            (tmp_path / f"top/d{i}/e{j}/f/file").write_text("x")
    config = scan.ScanConfig((str(tmp_path), str(tmp_path / "absent")))
    full = text.full_path(F.col("path"), F.col("name"))
    for enough in (1, 3, 1000):
        found = scan.scan(spark, config, enough=enough)
        assert found.filter("error is null").select(full).distinct().count() == found.filter("error is null").count() == 1 + 3 + 12 + 12 + 12
        with pytest.raises(ValueError, match="absent"):
            scan.complete(found)


def test_texts_of_scanned_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("é text")
    (tmp_path / "big").write_text("x" * 2000)
    (tmp_path / "bin").write_bytes(b"a\0b")
    (tmp_path / "empty").write_bytes(b"")
    os.symlink(tmp_path / "a.txt", tmp_path / "link")
    scanned = scan.scan(spark, scan.ScanConfig((str(tmp_path),)))
    rows = scan.texts_of(scanned.unionByName(scanned.filter("name = 'a.txt'").withColumn("name", F.lit("gone"))), largest=1000).collect()
    assert [(r.text, r.size) for r in rows] == [("é text", 7)]


def test_saving_over_what_is_read(spark, tmp_path):
    target = str(tmp_path / "catalog")
    df = catalogs.derive(files(spark, [(f"n{i}", f"/p{i % 7}") for i in range(100)]))
    catalogs.save(df, target)
    catalogs.save(spark.read.parquet(target).filter("name <> 'n5'"), target)
    assert spark.read.parquet(target).count() == 99 and os.listdir(tmp_path) == ["catalog"]
    plan = subtree(spark.read.parquet(target), "/P3/")._jdf.queryExecution().executedPlan().toString()
    assert subtree(spark.read.parquet(target), "/P3/").count() == 14 and "StringStartsWith(path_lc,/p3/)" in plan


def test_subtrees_by_stored_columns(spark):
    df = catalogs.derive(files(spark, [("Users", ""), ("Users", "/"), ("a", "/users"), ("b", "/Users2"), ("c", "/users/x"), ("users", "/x"), ("top", "")]))
    full = text.full_path(F.col("path"), F.col("name"))
    for prefix in ("/Users", "/users/", "/", "", "/users/x", "/x/users", "/none"):
        assert paths(subtree(df, prefix)) == paths(df.filter(text.within(full, prefix))), prefix


def test_ids_of_logged_records_are_new(spark, tmp_path):
    table = streams.ChangeTable(spark, str(tmp_path / "t"))
    assert table.read().count() == 0
    table.append(changes(spark, [change(1, "ADD", "/n/0")]), 0)  # before there is a base
    assert paths(table.read()) == ["/n/0"]
    table.create(files(spark, [("a", "/d"), ("b", "/d"), ("c", "/d")]))
    table.append(changes(spark, [change(i, "ADD", f"/n/{i}") for i in range(3)]), 1)
    ids = lambda: sorted(r.file_id for r in table.read().collect())
    assert len(set(ids())) == 6
    before = ids()
    table.compact()
    assert ids() == before
    table.append(changes(spark, [change(i, "ADD", f"/m/{i}") for i in range(3)]), 2)
    assert len(set(ids())) == 9 and set(before) <= set(ids())


def test_a_log_that_does_not_reach_back(spark, tmp_path):
    table = streams.ChangeTable(spark, str(tmp_path / "t"))
    table.create(files(spark, [("a", "/d")]))
    fresh = lambda: files(spark, [("z", "/d")]).withColumn("error", F.lit(None).cast("string"))
    assert table.resume(changes(spark, [change(4, "ADD", "/d/old"), change(5, "ADD", "/d/b")]), 4, fresh, 0)
    assert paths(table.read()) == ["/d/a", "/d/b"]
    assert not table.resume(changes(spark, [change(9, "ADD", "/d/c")]), 5, fresh, 1)
    assert paths(table.read()) == ["/d/z"]


def test_polling(spark, tmp_path):
    table = streams.ChangeTable(spark, str(tmp_path / "t"))
    table.create(files(spark, [("a", "/d"), ("b", "/d")]))
    fresh = lambda: files(spark, [("a", "/d"), ("c", "/e")]).withColumn("error", F.lit(None).cast("string"))
    query = table.poll(fresh, str(tmp_path / "checkpoint"), seconds=1)
    try:
        deadline = time.time() + 60
        while not table._numbers("log") and time.time() < deadline:
            time.sleep(0.3)
    finally:
        query.stop()
    assert paths(table.read()) == ["/d/a", "/e/c"]


def test_difference_turns_one_into_the_other(spark):
    old, new = files(spark, [("a", "/d"), ("b", "/d"), ("C", "/d")]), files(spark, [("a", "/d"), ("c", "/d"), ("x", "/e")])
    out = mutations.difference(old, new)
    assert sorted((r.op, r.target) for r in out.collect()) == [("REMOVE", "/d/b"), ("UPDATE", "/d/C"), ("UPDATE", "/e/x")]
    assert paths(mutations.apply(old, out)) == paths(new) and mutations.difference(new, new).count() == 0


def test_index_changes_no_result(spark, tmp_path):
    rng = random.Random(4)
    df = catalogs.derive(files(spark, [("".join(rng.choice("abc/".replace("/", "")) for _ in range(rng.randint(1, 8))) + ".t", "/" + "/".join("".join(rng.choice("abc") for _ in range(4)) for _ in range(2))) for _ in range(400)]))
    df = df.persist()
    NameIndex.of(df).save(str(tmp_path / "index"))
    for listed in (0, 1000):
        index = NameIndex.load(spark, str(tmp_path / "index"), df.count())
        index.listed = listed
        for query in ("abca", "abc|bca", "abcab !ca", "*bca?b*", "regex:ab[ab]cc?a", "path:abca", "cab/abc", "abcabc", "ww:abcb", "zzz", "ab", "regex:(abc|bca)+x?"):
            assert {r.file_id for r in hits(df, query, index=index).collect()} == {r.file_id for r in hits(df, query).collect()}, query
    joined = NameIndex.load(spark, str(tmp_path / "index"), 10**9)
    joined.listed = 0
    assert "LeftSemi" in hits(df, "abcab", index=joined)._jdf.queryExecution().executedPlan().toString()


def test_content_index_follows_texts(spark, tmp_path):
    index = ContentIndex(spark, str(tmp_path / "index"))
    schema = "file_id long, text string, mod_time long"
    one = spark.createDataFrame([(1, "red rings", 1), (2, "Blue ring", 1), (3, "", 1), (4, "ab", 1)], schema)
    find = lambda texts, key: sorted(r.file_id for r in index.hits(texts, key).collect())
    assert index.count() == 0 and find(one, "ring") == []
    index.build(one)
    assert index.count() == 4 and find(one, "RING") == [1, 2] and find(one, "ri") == []
    two = spark.createDataFrame([(1, "red rings", 2), (2, "Blue bolt", 2), (5, "a ring", 2), (4, "ab", 1)], schema)
    states = {r.file_id: r.change for r in index.refresh(two, 1).collect()}
    assert states == {1: "unchanged", 2: "upserted", 3: "removed", 4: "unchanged", 5: "upserted"}
    assert find(two, "ring") == [1, 5] and find(two, "bolt") == [2] and index.count() == 4
    index.remove(two.filter("file_id = 5"), 2)
    assert find(two, "ring") == [1]
    before = sorted(map(tuple, index.postings().collect()))
    index.compact()
    assert sorted(map(tuple, index.postings().collect())) == before and find(two, "ring") == [1]
    index.append(spark.createDataFrame([(9, "ADD", 7, 0, 0, ["rin"])], "seq long, op string, file_id long, content_hash long, mod_time long, keys array<string>"), 2)
    assert index.count() == 3  # the base holds that batch
    assert [r.file_id for r in index.search(two, "ring", 1).collect()] == [1]
    index.clear()
    assert index.count() == 0 and index.postings().count() == 0
    index.build(two, F.col("file_id") > 2)
    assert index.count() == 2


def test_content_log_stops_at_damage(spark, tmp_path):
    index = ContentIndex(spark, str(tmp_path / "index"))
    texts = lambda k: spark.createDataFrame([(k, f"text {k}", k)], "file_id long, text string, mod_time long")
    for k in (1, 2, 3):
        rows = keyed(texts(k)).selectExpr(f"{k}L seq", "'ADD' op", "*")
        index.append(rows, k)
    where = str(tmp_path / "index/log/batch=2")
    damaged = spark.createDataFrame(spark.read.parquet(where).withColumn("content_hash", F.lit(5).cast("long")).collect(), spark.read.parquet(where).schema)
    damaged.write.mode("overwrite").parquet(where)
    assert sorted(r.file_id for r in index.files().collect()) == [1]


def test_sessions_cancel_what_they_overtake(spark):
    sessions, out = Sessions(spark), {}

    def slow():
        return spark.range(8).repartition(2).mapInPandas(lambda it: (time.sleep(20) or x for x in it), "id long")

    def first():
        try:
            out["first"] = sessions.collect(7, slow)
        except Cancelled:
            out["first"] = "cancelled"

    thread = threading.Thread(target=first)
    thread.start()
    time.sleep(2)
    began = time.time()
    assert len(sessions.collect(7, lambda: spark.range(3))) == 3
    thread.join(15)
    assert out["first"] == "cancelled" and time.time() - began < 15
    assert len(sessions.collect(0, lambda: spark.range(2))) == 2


def test_small_functions(spark, tmp_path):
    df = spark.createDataFrame([("size1", "a%20b+c"), ("size12", "%zz"), ("a size1", None)], "name string, url string")
    assert [r[0] for r in df.select(text.name_priority(F.col("name"), "size1")).collect()] == [0, 1, 2]
    assert [r[0] for r in df.select(text.url_decoded(F.col("url"))).collect()] == ["a b c", None, None]
    lines = spark.createDataFrame([("/a\nb",), ("/c",)], "line string").coalesce(1)
    export.write_separated(lines, str(tmp_path / "out"))
    part = next(x for x in os.listdir(tmp_path / "out") if x.startswith("part"))
    assert (tmp_path / "out" / part).read_text() == "/a\nb\0/c\0"
    many = spark.range(25_000).selectExpr("id file_id", "cast(id as string) name", "'/p' path", "1 type", "id size", "id mod_time", "0L rank")
    assert listing.sort_results(many, "size").count() == 25_000
    assert sorted(r.key for r in postings.trigram_postings(spark.createDataFrame([(1, "İab🙂c"), (2, "ab")], "file_id long, name_lc string")).collect()) == sorted({"i̇a", "̇ab", "ab🙂", "b🙂c"})


def test_highlight_of_arguments_and_initials():
    assert highlight.ranges_of("my ring.txt", "/ring", highlight.hints("file:ring")) == ([(3, 7)], [])
    assert highlight.ranges_of("长城 report", "/x", highlight.hints("ccr")) == ([(0, 2), (3, 4)], [])
    assert highlight.ranges_of("abc", "/x", highlight.hints("regex:(?P<a>b)\\pL")) == ([(1, 3)], [])
