"""Queries that apply every operator to the star-schema tables, and DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import catalog as catalogs
from lodestone import storage
from lodestone.functions import text
from lodestone.operators import content, highlight, history, listing, mutations, postings
from lodestone.operators.content_index import ContentIndex
from lodestone.operators.search import Narrowing, has_more, hits, page, search, subtree
from lodestone.query import filters
from lodestone.query.dates import Clock
from lodestone.sinks import export
from lodestone.sources import adapters, scan
from lodestone.streaming import changes as streams

Query = Callable[[SparkSession, str], DataFrame]
CLOCK = Clock()
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def at(day: str) -> int:
    return int(datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp())


def files_sql(name: str, change: str = "") -> str:
    """CTE ``files``: the catalog, with columns changed, and the columns that conditions need; p is the string that terms
    look at."""
    changed = f"select * replace ({change}) from raw" if change else "select * from raw"
    return f"""with recursive raw as ({adapters.sql(name, 'duckdb')}), base as ({changed}),
files as (select *, lower(name) as nl, lower(path) as pl, lower(path) || '/' || lower(name) as p,
  case when contains(name, '.') then lower(regexp_extract(name, '([^.]*)$', 1)) else '' end as ext,
  strlen(path) - strlen(replace(path, '/', '')) as depth, case when path = '' or path like '%/' then path || name else path || '/' || name end as fp from base)"""


def score_sql(terms: list[str] | None) -> str:
    """The score of scoring terms; None for queries on numbers and types alone."""
    if terms is None:
        return "cast(0 as bigint)"
    quality = lambda t: f"case when nl = '{t}' then 0 when starts_with(nl, '{t}') then 1 when regexp_matches(substr(nl, strpos(nl, '{t}') - 1, 1), '[0-9a-z]') then 3 else 2 end"
    missed = " + ".join(f"case when contains(nl, '{t}') then 0 else 1 end" for t in terms) or "0"
    matched = " + ".join(f"case when contains(nl, '{t}') then {quality(t)} else 3 end" for t in terms) or "0"
    return f"cast(({missed}) * 16777216 + least({matched}, 255) * 65536 + least(strlen(path) + 1 + strlen(nl), 65535) as bigint)"


def _hits(name: str, on: str, query: str, where: str, terms: list[str] | None) -> None:
    """All hits of a query with their scores."""
    QUERIES[name] = lambda spark, d: hits(adapters.catalog(spark, d, on), query, CLOCK).select("file_id", "name", "path", "score")
    SQL[name] = f"{files_sql(on)} select file_id, name, path, {score_sql(terms)} as score from files where {where}"


_COLUMNS = "file_id, name, path, type, size, mod_time"


def _top(name: str, on: str, query: str, where: str, terms: list[str] | None, limit: int, **how) -> None:
    """The best hits with ranks."""
    QUERIES[name] = lambda spark, d: search(adapters.catalog(spark, d, on), query, limit, CLOCK, **how)
    after = f" and contains(lower(fp), '{how['path_filter']}')" if how else ""
    SQL[name] = f"{files_sql(on)}, s as (select *, {score_sql(terms)} as score from files where {where}), r as (select *, row_number() over (order by score, file_id) as rank from s) select {_COLUMNS}, score, rank from r where rank <= {limit}{after}"


A, B = "parts", "lineitem"
has = lambda t: f"contains(p, '{t}')"


def _macro(*names: str) -> str:
    return f"ext in ({', '.join(repr(e) for n in names for e in filters.MACROS[n].split(';'))})"



_hits("term_single", A, "ring", has("ring"), ["ring"])
_hits("term_and", A, "red ring", f"{has('red')} and {has('ring')}", ["red", "ring"])
_hits("term_or", A, "ring|bolt", f"{has('ring')} or {has('bolt')}", ["ring", "bolt"])
_hits("term_not", A, "ring !red", f"{has('ring')} and not {has('red')}", ["ring"])
_hits("term_group", A, "<red|blue> ring", f"({has('red')} or {has('blue')}) and {has('ring')}", ["red", "blue", "ring"])
_hits("term_nested", A, "!<red|<blue steel>> ring", f"not ({has('red')} or ({has('blue')} and {has('steel')})) and {has('ring')}", ["ring"])
_hits("term_quoted", A, '"red ring"', has("red ring"), ["red ring"])
_hits("term_path_hit", A, "economy", has("economy"), ["economy"])
_hits("term_void", A, "ring >", "false", ["ring"])
_hits("term_unknown_filter", A, "brand:x", "contains(p, 'brand:x')", ["brand:x"])
_hits("case_sensitive", A, "case:Small", "contains(path || '/' || name, 'Small')", ["small"])
_hits("nocase", A, "nocase:SMALL", has("small"), ["small"])
_hits("glob_suffix", A, "*.cpp", "nl like '%.cpp'", [])
_hits("glob_prefix", A, "small*", "nl like 'small%'", [])
_hits("glob_contains", A, "*ring*", "nl like '%ring%'", [])
_hits("glob_exact", A, "case:size1?", "nl like 'size1_'", [])
_hits("glob_generic", A, "*ring_??4.h", "nl like '%ring$___4.h' escape '$'", [])
_hits("glob_path", A, "*/promo/*", "p like '%/promo/%'", [])
_hits("regex_name", A, r"regex:^red.*\.h$", r"regexp_matches(nl, '(?i)^red.*\.h$') or regexp_matches(p, '(?i)^red.*\.h$')", [])
_hits("regex_path", A, "regex:brand_1.*/economy", "regexp_matches(nl, '(?i)brand_1.*/economy') or regexp_matches(p, '(?i)brand_1.*/economy')", [])
_hits("regex_options", A, "regex:(?options:case,ww,wfn)Red", r"regexp_matches(name, '\b(?:Red)\b')", [])
_hits("regex_invalid", A, "regex:(", "false", [])
_hits("whole_word", A, "ww:ring", "regexp_matches(nl, '(^|[^0-9a-z])ring([^0-9a-z]|$)')", [])
_hits("whole_filename", A, "wfn:size11", "nl = 'size11'", [])
_hits("ext_one", A, "ext:cpp", "ext = 'cpp'", [])
_hits("ext_many", A, "ext:cpp;h;GZ", "ext in ('cpp', 'h', 'gz')", [])
_hits("macro_pic", A, "pic:", _macro("pic"), [])
_hits("macro_doc", A, "doc:", _macro("doc"), [])
_hits("macro_audio_or_zip", A, "audio:|zip:", _macro("audio", "zip"), [])
_hits("macro_video_exe", A, "video:|exe:", _macro("video", "exe"), [])
_hits("size_gt", A, "size:>1mb", "size > 1048576", None)
_hits("size_range", A, "size:512kb..2mb", "size between 524288 and 2097152", None)
_hits("size_open", B, "size:..1mb", "size between 0 and 1048576", None)
_hits("size_eq", A, "size:0", "size = 0", None)
_hits("size_fraction", A, "size:>=1.5mb", "size >= 1572864", None)
_hits("type_file", A, "type:file", "type = 1", None)
_hits("type_folder", A, "type:DIR", "type = 2", None)
_hits("type_other", A, "type:link", "false", None)
_hits("file_kw", A, "file: ring", f"type = 1 and {has('ring')}", ["ring"])
_hits("folder_kw", A, "folder:", "type = 2", None)
_hits("path_has", A, "path:Brand_1", "contains(p, 'brand_1')", [])
_hits("path_has_pages", "pages", "path:.com/", "contains(p, '.com/')", [])
_hits("nopath", A, "nopath:brand_1 ring", f"not contains(p, 'brand_1') and {has('ring')}", ["ring"])
_hits("parent", A, "parent:/Brand_2/Economy", "pl = '/brand_2/economy'", [])
_hits("depth_cmp", A, "depth:<3", "depth < 3", [])
_hits("len_cmp", A, "len:>15", "strlen(nl) > 15", [])
_hits("dm_year", B, "dm:1998", f"mod_time between {at('1998-01-01')} and {at('1998-12-31') + 86399}", None)
_hits("dm_month", B, "datemodified:1997-02", f"mod_time between {at('1997-02-01')} and {at('1997-03-01') - 1}", None)
_hits("dm_day", B, "dm:1995-06-15", f"mod_time between {at('1995-06-15')} and {at('1995-06-15') + 86399}", None)
_hits("dm_cmp", B, "dm:>1997-06", f"mod_time > {at('1997-07-01') - 1}", None)
_hits("dm_before", B, "dm:<1996-02", f"mod_time < {at('1996-02-01')}", None)
_hits("dm_range", B, "dm:1994-03..1995", f"mod_time between {at('1994-03-01')} and {at('1996-01-01') - 1}", None)
_hits("dm_open_range", B, "dm:1998-06..", f"mod_time >= {at('1998-06-01')}", None)
_hits("dm_last7days", A, "dm:last7days", f"mod_time between {at('2024-01-24')} and {at('2024-01-31')}", None)
_hits("dm_thisweek", A, "dm:thisweek", f"mod_time between {at('2024-01-28')} and {at('2024-02-04') - 1}", None)
_hits("dm_lastmonth_year", A, "dm:lastmonth|dm:thisyear", f"mod_time between {at('2023-12-01')} and {at('2025-01-01') - 1}", None)
_hits("dm_invalid", A, "dm:someday|!dm:2023-13", "false", None)
_hits("date_aliases", B, "dc:1998 da:1998", f"mod_time between {at('1998-01-01')} and {at('1999-01-01') - 1}", None)
_hits("content_filter", A, "content:ring", "false", None)

_segment = "len(list_filter(string_split(pl, '/'), lambda c: contains(c, 'brand_2'))) > 0"
_last = "list_extract(list_filter(string_split(pl, '/'), lambda c: c <> ''), -1)"
_hits("seg_name", A, "economy/size1", f"contains(nl, 'size1') and contains({_last}, 'economy') or contains(nl, 'size1') and len(list_filter(string_split(pl, '/'), lambda c: contains(c, 'economy'))) > 0", ["size1"])
_hits("seg_two", A, "brand_2/ring", f"{_segment} and contains(nl, 'ring')", ["ring"])
_hits("seg_adjacent", A, "brand_2/economy/ring", "regexp_matches(pl, '^/[^/]*brand_2[^/]*/[^/]*economy') and contains(nl, 'ring')", ["ring"])
_hits("seg_gap", A, "brand_2/*/size1/ring", "regexp_matches(pl, '^/[^/]*brand_2[^/]*/.*size1[^/]*$') and contains(nl, 'ring')", ["ring"])
_hits("dir_exact", A, "brand_2/economy/", f"{_segment} and nl = 'economy' and type = 2", ["economy"])

_top("rank_multi", A, "ring red", f"{has('ring')} and {has('red')}", ["ring", "red"], 1000)
_top("rank_pure_filter", A, "type:folder size:0", "type = 2 and size = 0", None, 50)
_top("topk_10", B, "l1 !ext:nf", f"{has('l1')} and ext <> 'nf'", ["l1"], 10)
_top("window_path_filter", A, "ring", has("ring"), ["ring"], 60, path_filter="promo")

QUERIES["dir_list"] = lambda spark, d: hits(adapters.catalog(spark, d, A), "brand_2/economy/*", CLOCK).select("file_id", "name", "path", "score")
SQL["dir_list"] = f"{files_sql(A)} select file_id, name, path, cast(2 * 65536 + least(strlen(path) + 1 + strlen(nl), 65535) as bigint) as score from files where pl in (select lower(fp) from files where type = 2 and nl = 'economy' and {_segment})"

QUERIES["subtree"] = lambda spark, d: subtree(adapters.catalog(spark, d, A), "/brand_2").select("file_id", "name", "path")
SQL["subtree"] = f"{files_sql(A)} select file_id, name, path from files where lower(fp) = '/brand_2' or starts_with(lower(fp), '/brand_2/')"

QUERIES["recent_20"] = lambda spark, d: listing.recent(adapters.catalog(spark, d, B), 20)
SQL["recent_20"] = f"{files_sql(B)}, r as (select *, row_number() over (order by mod_time desc, file_id desc) as rank from files) select {_COLUMNS}, rank from r where rank <= 20"

for _by, _key in (("name", "nl"), ("ext", "ext"), ("path", "lower(fp)"), ("size", "size"), ("modified", "mod_time")):
    _down = _by in ("size", "modified")
    _first = "" if _by == "path" else "case when type = 2 then 0 else 1 end, "
    QUERIES[f"sort_{_by}"] = lambda spark, d, by=_by, down=_down: listing.sort_results(search(adapters.catalog(spark, d, A), "economy", 500), by, down)
    SQL[f"sort_{_by}"] = f"""{files_sql(A)}, s as (select *, {score_sql(['economy'])} as score from files where {has('economy')}), w as (select *, row_number() over (order by score, file_id) as k from s),
r as (select *, row_number() over (order by {_first}{_key}{' desc' if _down else ''}, lower(fp), file_id) as rank from w where k <= 500) select {_COLUMNS}, rank from r"""

QUERIES["page_2"] = lambda spark, d: page(adapters.catalog(spark, d, A), "ring", 2)
SQL["page_2"] = f"{files_sql(A)}, s as (select *, {score_sql(['ring'])} as score from files where {has('ring')}), r as (select *, row_number() over (order by score, file_id) as rank from s) select {_COLUMNS}, score, rank from r where rank between 101 and 200"

QUERIES["has_more"] = lambda spark, d: has_more(adapters.catalog(spark, d, A), "ring", 100)
SQL["has_more"] = f"{files_sql(A)}, n as (select count(*) as n from files where {has('ring')}) select least(n, 100) as results, n > 100 as limited from n"

QUERIES["counts_by_type"] = lambda spark, d: listing.counts_by_type(adapters.catalog(spark, d, A))
SQL["counts_by_type"] = f"{files_sql(A)} select type, count(*) as files from files group by type"

QUERIES["status"] = lambda spark, d: listing.status(adapters.project(spark, d, B))
SQL["status"] = f"{files_sql(B)} select count(*) as records, count(*) as live, cast(0 as double) as dead_share from files"

QUERIES["breakdown"] = lambda spark, d: listing.breakdown(adapters.catalog(spark, d, A))
SQL["breakdown"] = f"""{files_sql(A)}, e as (select ext, count(*) as k from files where ext <> '' group by ext), rows as (
select 'names' as part, count(*) as entries, sum(strlen(name)) as bytes from files union all select 'lower_names', count(*), sum(strlen(nl)) from files
union all select 'paths', count(*), sum(strlen(path)) from (select distinct path from files) x union all select 'extensions', count(*), sum(strlen(ext) + 8 * k) from e
union all select 'records', count(*), count(*) * 36 from files) select part, cast(entries as bigint) as entries, cast(bytes as bigint) as bytes from rows"""

QUERIES["trigram_postings"] = lambda spark, d: postings.lengths(postings.trigram_postings(adapters.catalog(spark, d, A)))
SQL["trigram_postings"] = f"{files_sql(A)}, t as (select distinct file_id, unnest(list_transform(range(1, length(nl) - 1), lambda i: substr(nl, i, 3))) as key from files) select key, count(*) as files, min(file_id) as first_id, max(file_id) as last_id from t group by key"
QUERIES["trigram_candidates"] = lambda spark, d: postings.candidates(postings.trigram_postings(adapters.catalog(spark, d, A)), "ring")
SQL["trigram_candidates"] = f"{files_sql(A)} select file_id from files where contains(nl, 'rin') and contains(nl, 'ing')"
QUERIES["posting_union"] = lambda spark, d: postings.any_of(postings.extension_postings(adapters.catalog(spark, d, A)), ["cpp", "h"])
SQL["posting_union"] = f"{files_sql(A)} select file_id from files where ext in ('cpp', 'h')"
QUERIES["ext_postings"] = lambda spark, d: postings.lengths(postings.extension_postings(adapters.catalog(spark, d, A)))
SQL["ext_postings"] = f"{files_sql(A)} select ext as key, count(*) as files, min(file_id) as first_id, max(file_id) as last_id from files where ext <> '' group by ext"


def _texts(spark: SparkSession, d: str, table: str = "documents", key: str = "doc_id", column: str = "text") -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").select(F.col(key).alias("file_id"), F.col(column).alias("text"))


def _snippet_sql(key: str, table: str, id_column: str, column: str) -> str:
    n = len(key)
    return f"""m as (select {id_column} as file_id, {column} as t, strpos(lower({column}), '{key}') as place from {table} where contains(lower({column}), '{key}')),
w as (select *, greatest(place - 81, 0) as b0, least(place - 1 + {n} + 80, length(t)) as e from m),
h as (select *, substr(t, b0 + 1, place - b0) as head from w),
l as (select *, case when b0 > 0 then b0 + length(head) - length(regexp_extract(head, '[^\\n]*$')) else b0 end as b from h),
found as (select file_id, cast(strlen(substr(t, 1, place - 1)) as bigint) as match_offset,
  (case when b > 0 then '...' else '' end) || trim(translate(substr(t, b + 1, e - b), chr(10) || chr(13), '  '), ' ' || chr(9)) || (case when e < length(t) then '...' else '' end) as snippet from l)"""


QUERIES["content_search"] = lambda spark, d: content.content_search(_texts(spark, d), "Thin", 50)
SQL["content_search"] = f"with {_snippet_sql('thin', 'documents', 'doc_id', 'text')}, r as (select *, row_number() over (order by file_id) as rank from found) select file_id, match_offset, snippet, rank from r where rank <= 50"
QUERIES["content_snippet"] = lambda spark, d: content.content_hits(_texts(spark, d), "ément")
SQL["content_snippet"] = f"with {_snippet_sql("ément", 'documents', 'doc_id', 'text')} select * from found"
QUERIES["content_pages"] = lambda spark, d: content.content_hits(_texts(spark, d, "pages", "page_id", "html"), "</title>")
SQL["content_pages"] = f"with {_snippet_sql('</title>', 'pages', 'page_id', 'html')} select * from found"
QUERIES["content_short_key"] = lambda spark, d: content.content_hits(_texts(spark, d), "th")
SQL["content_short_key"] = "select doc_id as file_id, cast(0 as bigint) as match_offset, '' as snippet from documents where false"
QUERIES["content_join"] = lambda spark, d: content.with_records(content.content_hits(_texts(spark, d), "license"), adapters.catalog(spark, d, "documents"))
SQL["content_join"] = f"{files_sql('documents')}, {_snippet_sql('license', 'documents', 'doc_id', 'text')} select file_id, match_offset, snippet, name, fp as full_path from found join files using (file_id)"
QUERIES["content_in_search"] = lambda spark, d: hits(adapters.catalog(spark, d, "documents"), "ext:en", CLOCK, contents=content.content_hits(_texts(spark, d), "license")).select("file_id", "name")
SQL["content_in_search"] = f"{files_sql('documents')} select file_id, name from files where ext = 'en' and file_id in (select doc_id from documents where contains(lower(text), 'license'))"
QUERIES["content_prune"] = lambda spark, d: content.stale(_texts(spark, d).select("file_id"), spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("file_id")))
SQL["content_prune"] = "select doc_id as file_id from documents where doc_id not in (select doc_id from labels)"
QUERIES["content_allowed"] = lambda spark, d: adapters.catalog(spark, d, A).filter(content.ContentConfig(frozenset(("cpp", "md", "size11"))).allows(F.col("name"))).select("file_id")
SQL["content_allowed"] = f"{files_sql(A)} select file_id from files where ext in ('cpp', 'md') or nl = 'size11'"


def _refresh(spark: SparkSession, d: str) -> DataFrame:
    """The index knows the labelled documents, some by another time or text, and all benchmark items, which are gone."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_id"), "text", "lang", (F.col("doc_id") * 60).alias("mod_time"), F.length("text").alias("n"))
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("file_id")).distinct()
    hashed = F.xxhash64(F.when(F.col("lang") == "en", "old").otherwise(F.col("text"))).alias("content_hash")
    known = docs.join(labels, "file_id", "left_semi").select("file_id", hashed, (F.col("mod_time") - F.when(F.col("n") > 900, 0).otherwise(1)).alias("mod_time"))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") + 1_000_000_000).cast("long").alias("file_id"), F.xxhash64("text").alias("content_hash"), F.lit(7).cast("long").alias("mod_time"))
    return content.refresh(known.unionAll(items), docs.select("file_id", "text", "mod_time")).select("file_id", "mod_time", "change")


QUERIES["content_refresh"] = _refresh
SQL["content_refresh"] = """select doc_id as file_id, doc_id * 60 as mod_time, case when doc_id in (select doc_id from labels) and (length(text) > 900 or lang <> 'en') then 'unchanged' else 'upserted' end as change from documents
union all select cast(item_id + 1000000000 as bigint), cast(7 as bigint), 'removed' from benchmark"""

QUERIES["dedup_latest"] = lambda spark, d: catalogs.latest(catalogs.records(adapters.project(spark, d, B))).select("file_id", "name", "path", "size")
SQL["dedup_latest"] = f"{files_sql(B)}, r as (select *, row_number() over (partition by lower(fp) order by file_id desc) as k from files) select file_id, name, path, size from r where k = 1"

_NONE = "select cast(null as bigint) file_id, '' name, '' path, 1 type, cast(0 as bigint) size, cast(0 as bigint) mod_time limit 0"
QUERIES["replay_final_state"] = lambda spark, d: mutations.apply(spark.sql(_NONE), adapters.project(spark, d, "changes")).select("file_id", "name", "path", "size", "mod_time")
SQL["replay_final_state"] = f"with c as ({adapters.sql('changes', 'duckdb')}), r as (select *, row_number() over (partition by lower(target) order by seq desc) as k from c) select seq as file_id, name, path, size, mod_time from r where k = 1 and op <> 'REMOVE'"


def _renames(spark: SparkSession, d: str) -> DataFrame:
    """Files of one extension move below /moved, those of another go."""
    files = adapters.project(spark, d, A).filter("type = 1")
    moved = files.filter("name like '%.md'").select(F.col("file_id").alias("seq"), F.lit("UPDATE").alias("op"), text.full_path(F.col("path"), F.col("name")).alias("target"), "name", F.lit("/moved").alias("path"), "type", "size", "mod_time")
    gone = files.filter("name like '%.h'").select((F.col("file_id") + 10_000_000).alias("seq"), F.lit("REMOVE").alias("op"), text.full_path(F.col("path"), F.col("name")).alias("target"), "name", "path", "type", "size", "mod_time")
    return mutations.apply(files, moved.unionAll(gone), first_id=2_000_000_000).select("file_id", "name", "path")


QUERIES["update_rename"] = _renames
SQL["update_rename"] = f"{files_sql(A)} select case when ext = 'md' then 2000000000 + file_id else file_id end as file_id, name, case when ext = 'md' then '/moved' else path end as path from files where type = 1 and ext <> 'h'"

QUERIES["remove_prefix"] = lambda spark, d: mutations.remove_prefix(adapters.catalog(spark, d, A), "/brand_2/economy").select("file_id", "name", "path")
SQL["remove_prefix"] = f"{files_sql(A)} select file_id, name, path from files where not (lower(fp) = '/brand_2/economy' or starts_with(lower(fp), '/brand_2/economy/'))"
QUERIES["rescan_prefix"] = lambda spark, d: mutations.rescan_prefix(adapters.project(spark, d, A), "/Brand_1", adapters.project(spark, d, A).filter("path like '/Brand_1/%' and type = 1").withColumn("file_id", F.col("file_id") + 3_000_000_000)).select("file_id", "name", "path")
SQL["rescan_prefix"] = f"{files_sql(A)} select file_id, name, path from files where not (lower(fp) = '/brand_1' or starts_with(lower(fp), '/brand_1/')) union all select file_id + 3000000000, name, path from files where path like '/Brand_1/%' and type = 1"


def _compacted(spark: SparkSession, d: str) -> DataFrame:
    files = adapters.project(spark, d, A).withColumn("type", F.when(F.col("name").endswith(".h"), 0).otherwise(F.col("type")))
    records, followed = mutations.compact(files, files.select("file_id", F.col("mod_time").alias("indexed_at")))
    return records.join(followed, "file_id").select("file_id", "name", "path", "indexed_at")


QUERIES["compact_remap"] = _compacted
SQL["compact_remap"] = f"{files_sql(A)} select row_number() over (order by file_id) - 1 as file_id, name, path, mod_time as indexed_at from files where ext <> 'h'"

QUERIES["minimal_paths"] = lambda spark, d: mutations.minimal_paths(adapters.project(spark, d, A).filter("type = 2 and (name like 'Brand#_1%' escape '#' or name like 'size%')").select(text.full_path(F.col("path"), F.col("name")).alias("path")))
SQL["minimal_paths"] = f"{files_sql(A)}, s as (select distinct fp as path from files where type = 2 and (name like 'Brand#_1%' escape '#' or name like 'size%')) select path from s where not exists (select 1 from s t where t.path <> s.path and starts_with(s.path, t.path || '/'))"

QUERIES["rescan_sessions"] = lambda spark, d: streams.gaps(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("root"), F.col("ts").cast("timestamp").alias("at")), 3600).select("root", F.unix_seconds("first_at").alias("first_at"), F.unix_seconds("last_at").alias("last_at"), "requests")
SQL["rescan_sessions"] = """with e as (select user_id as root, ts, case when coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) > 3600000000, true) then 1 else 0 end as n from events),
s as (select *, sum(n) over (partition by root order by ts) as s from e) select root, cast(floor(epoch(min(ts))) as bigint) as first_at, cast(floor(epoch(max(ts))) as bigint) as last_at, count(*) as requests from s group by root, s"""

_iso = "strftime(make_timestamp(mod_time * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_quote = lambda c: f"'\"' || replace(case when regexp_matches({c}, '^[=+@\\t\\r-]') then '''' || {c} else {c} end, '\"', '\"\"') || '\"'"
_exported = ["name", "path", "ext", "cast(size as string)", _iso, "''"]
QUERIES["export_csv_rows"] = lambda spark, d: export.csv_lines(adapters.project(spark, d, A))
SQL["export_csv_rows"] = f"{files_sql(A)} select file_id, {' || chr(44) || '.join(map(_quote, _exported))} as line from files"
QUERIES["export_txt_rows"] = lambda spark, d: export.txt_lines(adapters.project(spark, d, A))
SQL["export_txt_rows"] = f"{files_sql(A)} select file_id, {' || chr(9) || '.join(_exported)} as line from files"
QUERIES["export_json_rows"] = lambda spark, d: export.json_lines(adapters.project(spark, d, A))
SQL["export_json_rows"] = f"""{files_sql(A)} select file_id, '{{"name":"' || name || '","path":"' || fp || '","type":' || type || ',"size":' || size || ',"modTime":' || mod_time || '}}' as line from files"""

QUERIES["history_frequency"] = lambda spark, d: history.frequencies(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("query"), F.col("event_id").alias("at")))
SQL["history_frequency"] = "select event_type as query, count(*) as uses, max(event_id) as last_used from events group by event_type"
QUERIES["history_best_match"] = lambda spark, d: history.best_match(history.frequencies(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("query"), F.col("p_partkey").alias("at"))), "r")
SQL["history_best_match"] = "select lower(p_name) as query, count(*) as uses, max(p_partkey) as last_used from part where starts_with(lower(p_name), 'r') group by 1 order by 2 desc, 3 desc, 1 limit 1"
QUERIES["history_suggestion"] = lambda spark, d: history.shortest_keyword(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("keyword")), "s")
SQL["history_suggestion"] = "select p_name as keyword from part where starts_with(lower(p_name), 's') order by length(p_name), 1 limit 1"
QUERIES["quick_filter"] = lambda spark, d: hits(adapters.catalog(spark, d, A), history.compose("ring", "documents", "1_to_100mb", ("2024-03-01", "2024-01-10")), CLOCK).select("file_id", "name", "path", "score")
SQL["quick_filter"] = f"{files_sql(A)} select file_id, name, path, {score_sql(['ring'])} as score from files where {has('ring')} and ext in ('md', 'txt') and size between 1048576 and 104857600 and mod_time between {at('2024-01-10')} and {at('2024-03-02') - 1}"


def _highlighted(spark: SparkSession, d: str) -> DataFrame:
    """Ranges as text: start+length, with commas."""
    marked = highlight.highlight(search(adapters.catalog(spark, d, A), "ring brand", 100, CLOCK), "ring brand")
    plain = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("+", r["start"], r["length"])), ",").alias(c)
    return marked.select("file_id", plain("name_ranges"), plain("path_ranges"))


def _marks_sql(column: str, terms: list[str]) -> str:
    """Places of the characters that some term covers."""
    covered = " or ".join(f"i > {k} and substr({column}, cast(i as bigint) - {k}, {len(t)}) = '{t}'" for t in terms for k in range(len(t)))
    return f"list_filter(range(1, length({column}) + 1), lambda i: {covered})"


def _runs_sql(marks: str) -> str:
    """Runs of places, as start+length from 0."""
    starts, ends = (f"list_filter({marks}, lambda i: not list_contains({marks}, i {sign} 1))" for sign in "-+")
    return f"array_to_string(list_transform(list_zip({starts}, {ends}), lambda x: cast(x[1] - 1 as varchar) || '+' || cast(x[2] - x[1] + 1 as varchar)), ',')"


QUERIES["highlight_ranges"] = _highlighted
SQL["highlight_ranges"] = f"""{files_sql(A)}, s as (select *, {score_sql(['ring', 'brand'])} as score from files where {has('ring')} and {has('brand')}), r as (select *, row_number() over (order by score, file_id) as rank from s),
m as (select file_id, {_marks_sql('nl', ['ring', 'brand'])} as nm, {_marks_sql('pl', ['ring', 'brand'])} as pm from r where rank <= 100) select file_id, {_runs_sql('nm')} as name_ranges, {_runs_sql('pm')} as path_ranges from m"""

# index tables change no result
_INDEXED = {
    "index_rare_name": ("_199 !red", f"{has('_199')} and not {has('red')}", ["_199"]),
    "index_path": ("brand_23 ring", f"{has('brand_23')} and {has('ring')}", ["brand_23", "ring"]),
    "index_common": ("red ring", f"{has('red')} and {has('ring')}", ["red", "ring"]),
    "index_glob": ("*ring_1?9.*", "nl like '%ring$_1_9.%' escape '$'", []),
    "index_regex": (r"regex:bolt_1\d+\.h", r"regexp_matches(p, '(?i)bolt_1\d+\.h')", []),
    "index_or": ("_198|_197", f"{has('_198')} or {has('_197')}", ["_198", "_197"]),
}


def _indexed(query: str, listed: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        files = adapters.catalog(spark, d, A)
        index = postings.NameIndex.of(files)
        index.listed = listed
        return hits(files, query, CLOCK, index=index).select("file_id", "name", "path", "score")

    return run


for _name, (_query, _where, _terms) in _INDEXED.items():
    for _kind, _listed in (("", postings.LISTED), ("_joined", 0)):
        QUERIES[_name + _kind] = _indexed(_query, _listed)
        SQL[_name + _kind] = f"{files_sql(A)} select file_id, name, path, {score_sql(_terms)} as score from files where {_where}"


def _maintained(spark: SparkSession, d: str) -> DataFrame:
    """Every file gets a longer name, and the index follows."""
    old = adapters.project(spark, d, A)
    new = catalogs.derive(old.withColumn("name", F.concat(F.lit("xq_"), "name")))
    index = postings.NameIndex.of(catalogs.derive(old)).maintained(old, new)
    return hits(new, "xq_ring", CLOCK, index=index).select("file_id", "name", "path", "score")


_longer = files_sql(A, "'xq_' || name as name")
QUERIES["index_maintained"] = _maintained
SQL["index_maintained"] = f"{_longer} select file_id, name, path, {score_sql(['xq_ring'])} as score from files where {has('xq_ring')}"


def _content_index(spark: SparkSession) -> ContentIndex:
    return ContentIndex(spark, storage.fresh_path(spark, "content_index"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).withColumn("mod_time", F.col("file_id") * 60)


def _content_built(spark: SparkSession, d: str) -> DataFrame:
    index = _content_index(spark)
    index.build(_dated(spark, d))
    return index.hits(_texts(spark, d), "License")


def _content_logged(spark: SparkSession, d: str) -> DataFrame:
    """The base has other texts of the same files, and a file that is gone; the log brings the index up to date."""
    index = _content_index(spark)
    old = _dated(spark, d).withColumns({"text": F.lit("the text as it was"), "mod_time": F.col("mod_time") - 1})
    items = spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") + 1_000_000_000).cast("long").alias("file_id"), "text", F.lit(7).cast("long").alias("mod_time"))
    index.build(old.unionAll(items))
    index.refresh(_dated(spark, d), 1)
    return index.hits(_texts(spark, d), "ément")


def _content_compacted(spark: SparkSession, d: str) -> DataFrame:
    """(stage, files, entries) after building, after removing a subtree, after compaction and after clearing."""
    index, files = _content_index(spark), adapters.catalog(spark, d, "documents")
    sizes = lambda stage: (stage, index.count(), index.postings().count())
    index.build(_dated(spark, d))
    rows = [sizes("built")]
    index.remove_prefix(files, "/corpus/src1", 1)
    rows.append(sizes("removed"))
    index.compact()
    rows.append(sizes("compacted"))
    index.clear()
    rows.append(sizes("cleared"))
    return spark.createDataFrame(rows, "stage string, files long, entries long")


QUERIES["content_indexed"] = _content_built
SQL["content_indexed"] = f"with {_snippet_sql('license', 'documents', 'doc_id', 'text')} select * from found"
QUERIES["content_index_log"] = _content_logged
SQL["content_index_log"] = f"with {_snippet_sql('ément', 'documents', 'doc_id', 'text')} select * from found"
QUERIES["content_index_sizes"] = _content_compacted
SQL["content_index_sizes"] = """with t as (select doc_id, source, coalesce(len(list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3)))), 0) as n from documents),
a as (select count(*) as files, sum(n) as entries from t), b as (select count(*) as files, sum(n) as entries from t where source <> 'src1')
select 'built' as stage, files, cast(entries as bigint) as entries from a union all select 'removed', files, cast(entries as bigint) from b union all select 'compacted', files, cast(entries as bigint) from b union all select 'cleared', cast(0 as bigint), cast(0 as bigint)"""

_CONFIG = scan.ScanConfig(("/Brand_1", "/brand_2/", "/Brand_2/SMALL"), excluded=("/Brand_1/economy", "/Brand_2"), patterns=("size1?", "*.CPP"))
QUERIES["scan_allowed"] = lambda spark, d: adapters.catalog(spark, d, A).filter(scan.allowed(_CONFIG, text.full_path(F.col("path"), F.col("name")), F.col("name"))).select("file_id", "name", "path")
SQL["scan_allowed"] = f"""{files_sql(A)} select file_id, name, path from files where regexp_matches(lower(fp), '^/brand_[12](/|$)') and not regexp_matches(lower(fp), '^/brand_1/economy(/|$)')
and not regexp_matches(lower(fp), '/size1[^/](/|$)') and ext <> 'cpp'"""
QUERIES["events_relevant"] = lambda spark, d: streams.relevant(adapters.catalog(spark, d, A).select("file_id", text.full_path(F.col("path"), F.col("name")).alias("full_path")).unionAll(adapters.catalog(spark, d, A).select("file_id", F.concat(F.lit("/private/var/folders/x/com.apple."), "name"))), scan.ScanConfig(("/",), system=True, patterns=("*.h",))).select("file_id", "full_path")
SQL["events_relevant"] = f"{files_sql(A)} select file_id, fp as full_path from files where ext <> 'h'"


def _routed(spark: SparkSession, d: str) -> DataFrame:
    log = adapters.project(spark, d, "changes")
    state = {"exists": F.when(F.col("op") == "ADD", F.lit(None).cast("boolean")).otherwise(F.col("op") != "REMOVE"), "must_rescan": F.col("name") == "f3.dat", "is_dir": F.col("name") == "f5.dat", "full_path": F.col("target")}
    return streams.routed(log.withColumns(state)).select("seq", "op", "target", "rescan", "content")


QUERIES["events_routed"] = _routed
SQL["events_routed"] = f"""with c as ({adapters.sql('changes', 'duckdb')}) select seq, op, target, case when name = 'f3.dat' then target when op = 'REMOVE' and name = 'f5.dat' then path end as rescan,
case when op = 'UPDATE' then 'upsert' else 'remove' end as content from c where op <> 'ADD'"""


def _identities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files, and events that saw those of one extension elsewhere and the others where they are."""
    files = adapters.project(spark, d, A).filter("type = 1").withColumns({"inode": F.col("file_id") + 1, "dev_id": F.lit(1)})
    at = F.when(F.col("name").endswith(".py"), F.concat(F.lit("/moved/"), "name")).otherwise(text.full_path(F.col("path"), F.col("name")))
    return files, files.select(F.col("file_id").alias("seq"), at.alias("full_path"), F.lit(True).alias("exists"), "inode", "dev_id")


def _moved(spark: SparkSession, d: str) -> DataFrame:
    files, events = _identities(spark, d)
    return streams.moved(events, files).select("seq", "op", "target", "name", "path")


QUERIES["events_moved"] = _moved
SQL["events_moved"] = f"{files_sql(A)} select file_id as seq, 'REMOVE' as op, fp as target, name, path from files where type = 1 and ext = 'py'"


def _difference(spark: SparkSession, d: str) -> DataFrame:
    """Between two scans files grew, one tree went and another came."""
    parts, docs, pages = (catalogs.records(adapters.project(spark, d, n)) for n in (A, "documents", "pages"))
    grown = parts.withColumn("size", F.when(F.col("type") == 1, F.col("size") + 1).otherwise(F.col("size")))
    return mutations.difference(catalogs.latest(parts.unionAll(docs)), catalogs.latest(grown.unionAll(pages))).select("op", "target", "size")


QUERIES["poll_difference"] = _difference
SQL["poll_difference"] = f"""{files_sql(A)}, k as (select lower(case when path = '' or path like '%/' then path || name else path || '/' || name end) as low, * from ({adapters.sql('pages', 'duckdb')}) x),
pg as (select *, row_number() over (partition by low order by file_id desc) as n from k)
select 'UPDATE' as op, fp as target, size + 1 as size from files where type = 1 union all select 'REMOVE', path || '/' || name, size from ({adapters.sql('documents', 'duckdb')}) y
union all select 'UPDATE', case when path = '' or path like '%/' then path || name else path || '/' || name end, size from pg where n = 1"""


def _throttled(spark: SparkSession, d: str) -> DataFrame:
    requests = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("root"), F.col("ts").cast("timestamp").alias("at"))
    runs = streams.throttled(streams.gaps(requests, 3600), 86_400)
    return runs.select("root", *(F.unix_micros(c).alias(c) for c in ("run_at", "first_at", "last_at")), "requests")


QUERIES["rescan_throttled"] = _throttled
SQL["rescan_throttled"] = """with recursive e as (select user_id as root, epoch_us(ts) as t, case when coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) > 3600000000, true) then 1 else 0 end as n from events),
s as (select *, sum(n) over (partition by root order by t) as s from e), g as (select root, min(t) as a, max(t) as z, count(*) as n from s group by root, s),
run as (select root, min(z) as t from g group by root union all
  select run.root, greatest(min(g.z), run.t + 86400000000) from run join g on g.root = run.root and g.z > run.t group by run.root, run.t),
own as (select g.*, (select min(run.t) from run where run.root = g.root and run.t >= g.z) as run_at from g)
select root, run_at, min(a) as first_at, max(z) as last_at, cast(sum(n) as bigint) as requests from own group by root, run_at"""

QUERIES["recent_quick_filter"] = lambda spark, d: history.quick_recent(listing.recent(adapters.catalog(spark, d, A), 200), "code").select("file_id", "name", "rank")
SQL["recent_quick_filter"] = f"{files_sql(A)}, r as (select *, row_number() over (order by mod_time desc, file_id desc) as rank from files) select file_id, name, rank from r where rank <= 200 and ext in ('cpp', 'h', 'py')"
QUERIES["rename_identity"] = lambda spark, d: mutations.renamed_from(*reversed(_identities(spark, d)))
SQL["rename_identity"] = f"{files_sql(A)} select file_id + 1 as inode, 1 as dev_id, '/moved/' || name as full_path, fp as old_path from files where type = 1 and ext = 'py'"
QUERIES["latency_statistics"] = lambda spark, d: history.latencies(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("query"), F.col("value").cast("double").alias("ms"))).select("query", *(F.round(c, 4).alias(c) for c in ("mean", "median", "p95", "p99", "stddev")))
SQL["latency_statistics"] = "select event_type as query, round(avg(value), 4) as mean, round(quantile_cont(value, 0.5), 4) as median, round(quantile_cont(value, 0.95), 4) as p95, round(quantile_cont(value, 0.99), 4) as p99, round(stddev_samp(value), 4) as stddev from (select event_type, cast(value as double) as value from events) e group by event_type"
QUERIES["composed_form"] = lambda spark, d: _texts(spark, d).select("file_id", F.md5(text.composed(F.col("text"))).alias("digest"))
SQL["composed_form"] = "select doc_id as file_id, md5(nfc_normalize(text)) as digest from documents"
QUERIES["ideograph_postings"] = lambda spark, d: postings.lengths(postings.pair_postings(adapters.catalog(spark, d, A).withColumn("name_lc", F.concat(F.lit("档案号"), "name_lc"))))
SQL["ideograph_postings"] = f"{files_sql(A)} select key, count(*) as files, min(file_id) as first_id, max(file_id) as last_id from files, (values ('档案'), ('案号')) k(key) group by key"
QUERIES["initials_term"] = lambda spark, d: hits(catalogs.derive(adapters.project(spark, d, A).withColumn("name", F.concat(F.lit("长城"), "name")), initials=True), "ccred", CLOCK).select("file_id", "name", "path", "score")
SQL["initials_term"] = f"{files_sql(A, "'长城' || name as name")} select file_id, name, path, {score_sql(['ccred'])} as score from files where {has('ccred')} or contains('cc' || regexp_replace(nl, '[^0-9a-z]', '', 'g'), 'ccred')"
QUERIES["application_alias"] = lambda spark, d: hits(catalogs.derive(adapters.project(spark, d, A).withColumn("name", F.concat("name", F.lit(" Finder")))), "访达", CLOCK).select("file_id", "name", "path", "score")
SQL["application_alias"] = f"{files_sql(A, "name || ' Finder' as name")} select file_id, name, path, {score_sql(['访达', 'finder'])} as score from files where {has('finder')}"
QUERIES["home_path"] = lambda spark, d: hits(adapters.catalog(spark, d, A), "~/economy/ring", CLOCK, home="/brand_2").select("file_id", "name", "path", "score")
SQL["home_path"] = f"{files_sql(A)} select file_id, name, path, {score_sql(['ring'])} as score from files where regexp_matches(pl, '^/[^/]*brand_2[^/]*/[^/]*economy') and contains(nl, 'ring')"
QUERIES["search_options"] = lambda spark, d: hits(adapters.catalog(spark, d, A), filters.with_options("ring", whole_word=True), CLOCK).select("file_id", "name", "path", "score")
SQL["search_options"] = f"{files_sql(A)} select file_id, name, path, {score_sql([])} as score from files where regexp_matches(nl, '(^|[^0-9a-z])ring([^0-9a-z]|$)')"
for _name, _pattern in (("regex_named_group", r"(?P<word>ring|bolt)_\d+\.[[:alpha:]]+$"), ("regex_unicode_class", r"^\pL+ \p{Latin}+_1\p{Nd}\b"), ("regex_quoted", r"\Q.tar.\E[g-z]{2}\z"), ("regex_folded", r"(?s:BRAND_1\x33).*[^a-z&&[:^digit:]]_")):
    _hits(_name, A, f"regex:{_pattern}", f"regexp_matches(nl, '(?i){_pattern}') or regexp_matches(p, '(?i){_pattern}')", [])
QUERIES["narrowed_search"] = lambda spark, d: _narrowed(adapters.catalog(spark, d, A))
SQL["narrowed_search"] = f"{files_sql(A)}, s as (select *, {score_sql(['ring_1'])} as score from files where {has('ring_1')}), r as (select *, row_number() over (order by score, file_id) as rank from s) select {_COLUMNS}, score, rank from r where rank <= 100"
QUERIES["name_priority"] = lambda spark, d: adapters.catalog(spark, d, A).select("file_id", text.name_priority(F.col("name_lc"), "size1").alias("priority"))
SQL["name_priority"] = f"{files_sql(A)} select file_id, case when nl = 'size1' then 0 when starts_with(nl, 'size1') then 1 else 2 end as priority from files"
QUERIES["path_lines"] = lambda spark, d: export.path_lines(adapters.project(spark, d, A))
SQL["path_lines"] = f"{files_sql(A)} select file_id, fp as line from files"
QUERIES["json_content_rows"] = lambda spark, d: export.json_lines(content.content_hits(_texts(spark, d), "license").join(adapters.catalog(spark, d, "documents"), "file_id"))
SQL["json_content_rows"] = f"{files_sql('documents')}, {_snippet_sql('license', 'documents', 'doc_id', 'text')} select file_id, cast(to_json({{'fileName': name, 'filePath': fp, 'snippet': snippet, 'matchOffset': match_offset}}) as varchar) as line from found join files using (file_id)"
QUERIES["export_content_rows"] = lambda spark, d: export.txt_lines(content.content_hits(_texts(spark, d), "license").join(adapters.catalog(spark, d, "documents"), "file_id"))
SQL["export_content_rows"] = f"{files_sql('documents')}, {_snippet_sql('license', 'documents', 'doc_id', 'text')} select file_id, name || chr(9) || path || chr(9) || chr(9) || chr(9) || chr(9) || translate(snippet, chr(9) || chr(13) || chr(10), '   ') as line from found join files using (file_id)"
QUERIES["rows_by_id"] = lambda spark, d: scan.with_ids(adapters.catalog(spark, d, "documents"), spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("file_id"))).select("file_id", "name")
SQL["rows_by_id"] = f"{files_sql('documents')} select file_id, name from files where file_id in (select doc_id from labels)"


def _narrowed(files: DataFrame) -> DataFrame:
    slot = Narrowing(files)
    slot.search("ring")
    return slot.search("ring_1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked search of two terms."""
    return search(adapters.catalog(spark, sf_dir, A), "red ring", 100, CLOCK)


