"""Catalogs, texts and change logs as projections of the star-schema tables.

The projections are SQL that Spark and other engines run alike, but for the few functions in DIALECTS.

A line's file_id is its five keys side by side, which a long holds up to order key 2 ** 23. Where it doesn't fit, the
SQL of other engines raises; Spark's takes the lower 64 bits as a signed number, which differ up to MOST_ORDER,
and beyond that a hash of order and line to which the other keys are added, so that a line's rows keep their order
(part keys up to 2 ** 33 and supplier keys up to 2 ** 43 are added whole). Both are negative, so they meet no id that fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.catalog import derive

DIALECTS = {
    "spark": {"bytes": "octet_length({})", "seconds": "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {})", "days": "datediff(cast({} as date), date'1992-01-01')"},
    "duckdb": {"bytes": "strlen({})", "seconds": "cast(floor(epoch({})) as bigint)", "days": "date_diff('day', date '1992-01-01', cast({} as date))"},
}
#: The key's lower 22 bits, with what carries beyond them, and the bits above for order keys of up to 24 bits and part keys
#: of up to 60. Neither raises for any keys, integers or longs, as Spark may work out both before it looks at a condition.
MOST_ORDER = (1 << 24) - (1 << 16)  #: a line's rows are all below 2 ** 64 or all beyond this
_LOW = "((l_suppkey & 1023L) * 4096 + {days})"
_HIGH = f"((l_orderkey % {1 << 25}L * 8 + l_linenumber % {1 << 33}) * 32768 + l_partkey % {1 << 61} + shiftright(l_suppkey, 10) + shiftright({_LOW}, 22))"
_NARROW = f"l_orderkey between {-(1 << 24)} and {MOST_ORDER} and l_linenumber between {-(1 << 32)} and {1 << 32} and l_partkey between {-(1 << 60)} and {1 << 60}"
LINE_KEYS = {
    "spark": f"""case when {_NARROW} and {_HIGH} between {-(1 << 41)} and {(1 << 42) - 1} then shiftleft({_HIGH}, 22) | ({_LOW} & {(1 << 22) - 1})
              when l_orderkey is null or l_linenumber is null or l_partkey is null or l_suppkey is null or l_shipdate is null then null
              else {-(1 << 63) + (1 << 32)} + pmod(xxhash64(l_orderkey, l_linenumber), {(1 << 63) - (1 << 57)}) + pmod(l_partkey, {1 << 33}) * 4194304 + pmod(l_suppkey, {1 << 43}) * 4096 + {{days}} end""",
    "duckdb": "(((l_orderkey * 8 + l_linenumber) * 32768 + l_partkey) * 1024 + l_suppkey) * 4096 + {days}",
}

_LEAF = """select p_partkey as file_id,
  (case when p_partkey % 3 = 0 then upper(substr(p_name, 1, 1)) || substr(p_name, 2) else p_name end) || '_' || cast(p_partkey as string) || '.' ||
  case p_partkey % 8 when 0 then 'cpp' when 1 then 'h' when 2 then 'py' when 3 then 'md' when 4 then 'txt' when 5 then 'JPG' when 6 then 'mp3' else 'tar.gz' end as name,
  '/' || replace(p_brand, '#', '_') as l1, p_type as l2, 'size' || cast(p_size as string) as l3,
  cast(p_size as bigint) * 65536 + p_partkey as size, 1704067200 + p_partkey * 3600 as mod_time from part"""


def _levels() -> str:
    """Directories of each level of the parts' paths."""
    out = []
    for base, keys, name, path in ((1_000_000_000, "l1", "substr(l1, 2)", "''"), (1_100_000_000, "l1, l2", "l2", "l1"), (1_200_000_000, "l1, l2, l3", "l3", "l1 || '/' || l2")):
        out.append(f"select {base} + cast(row_number() over (order by {keys}) as bigint) as file_id, {name} as name, {path} as path, 2 as type, cast(0 as bigint) as size, max(mod_time) as mod_time from leaf group by {keys}")
    return " union all ".join(out)


def sql(name: str, dialect: str) -> str:
    """The projection's SQL."""
    own = DIALECTS[dialect]
    size, seconds, days = (lambda c, k=k: own[k].format(c) for k in ("bytes", "seconds", "days"))
    match name:
        case "parts":
            return f"with leaf as ({_LEAF}) select file_id, name, l1 || '/' || l2 || '/' || l3 as path, 1 as type, size, mod_time from leaf union all {_levels()}"
        case "lineitem":
            key = LINE_KEYS[dialect].format(days=days("l_shipdate"))
            return f"""select {key} as file_id, 'l' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string) || '.' || lower(l_returnflag) || lower(l_linestatus) as name,
              '/' || r_name || '/' || n_name || '/' || replace(s_name, '#', '_') as path, 1 as type, cast(round(l_extendedprice * 100) as bigint) as size, {seconds('l_shipdate')} as mod_time
              from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
        case "pages":
            return f"""select page_id as file_id, regexp_extract(u, '([^/]+)$', 1) as name, '/' || regexp_extract(u, '^(.*)/[^/]+$', 1) as path, 1 as type,
              cast({size('html')} as bigint) as size, 1704067200 + page_id * 60 as mod_time
              from (select page_id, html, regexp_replace(regexp_extract(url, '^https?://([^?#]*)', 1), '/+$', '') as u from pages) x"""
        case "documents":
            return f"""select doc_id as file_id, 'doc_' || cast(doc_id as string) || '.' || lang as name, '/corpus/' || source as path, 1 as type,
              cast({size('text')} as bigint) as size, 1704067200 + doc_id * 60 as mod_time from documents"""
        case "changes":
            return f"""select event_id as seq, case event_type when 'signup' then 'ADD' when 'error' then 'REMOVE' else 'UPDATE' end as op,
              '/users/u' || cast(user_id as string) || '/f' || cast(event_id % 7 as string) || '.dat' as target, 'f' || cast(event_id % 7 as string) || '.dat' as name,
              '/users/u' || cast(user_id as string) as path, 1 as type, cast(round(value * 100) as bigint) as size, {seconds('ts')} as mod_time from events"""
    raise KeyError(name)


_TABLES = {"parts": ["part"], "lineitem": ["lineitem", "supplier", "nation", "region"], "pages": ["pages"], "documents": ["documents"], "changes": ["events"]}


def project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection of the tables in a folder."""
    text = sql(name, "spark")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    for t, df in tables.items():
        df.createOrReplaceTempView(f"lodestone_{t}")
        text = text.replace(f"from {t}", f"from lodestone_{t}").replace(f"join {t} ", f"join lodestone_{t} ")
    return spark.sql(text)


def catalog(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derive(project(spark, sf_dir, name))
