"""Searches by name and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.catalog import by_id
from lodestone.functions import text
from lodestone.operators.postings import NameIndex
from lodestone.plans import scoring
from lodestone.plans.predicates import predicate, segments
from lodestone.query import rewrites
from lodestone.query.dates import Clock
from lodestone.query.filters import DIRECTORY

#: Limits of the service and, for pages and sorts, of a window of results.
DEFAULT_LIMIT, LARGEST_LIMIT, LARGEST_WINDOW = 100, 10_000, 100_000
RESULT = ["file_id", "name", "path", "type", "size", "mod_time", "score", "rank"]


def ranked(hits: DataFrame, limit: int | None, order: list[Column] | None = None) -> DataFrame:
    """The first so many hits with their ``rank``; the window sees no more rows than the limit keeps.

    Without a limit all hits come, unranked by position: their ``rank`` is null, as a total order of all rows is for
    a sink to make.
    """
    order = order or [F.col("score"), *by_id()]
    if limit is None:
        return hits.withColumn("rank", F.lit(None).cast("long"))
    top = hits.orderBy(*order).limit(max(0, limit))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def clamp(limit: int | None, most: int = LARGEST_LIMIT, default: int = DEFAULT_LIMIT) -> int:
    """A client's limit as the service takes it."""
    return default if limit is None else max(1, min(limit, most))


def hits(catalog: DataFrame, query: str, clock: Clock | None = None, home: str | None = None, contents: DataFrame | None = None, index: NameIndex | None = None) -> DataFrame:
    """All rows that match, with ``score``. A void query has none.

    A query that isn't in Unicode's composed or decomposed form is tried in the other one too. ``contents``: file_ids
    that a content search found; only these remain. ``index``: of the catalog's names; it spares reading rows that can't
    match and changes no result. A catalog with initials is read in full, as these aren't indexed.
    """
    query = rewrites.prepared(query, home)
    forms = [q for q in (query, text.other_form(query)) if q]
    trees = [t for t in (rewrites.understand(q, clock) for q in forms) if t is not None]
    if not trees:
        return catalog.filter(F.lit(False)).withColumn("score", F.lit(0).cast("long"))
    path = rewrites.path_query(query)
    if path.mode == rewrites.DIR_LIST:
        found = children(catalog, path)
    else:
        initials = "initials" in catalog.columns
        scores = [scoring.score(t) for t in trees]
        found = (catalog if index is None or initials else index.narrowed(catalog, trees)).filter(text.any_of([predicate(t, initials) for t in trees])).withColumn("score", scores[0] if len(scores) == 1 else F.least(*scores))
    return found if contents is None else found.join(contents.select("file_id").distinct(), "file_id", "left_semi")


def children(catalog: DataFrame, path: rewrites.PathQuery) -> DataFrame:
    """Direct children of the directories that a path names exactly: a semi-join of parents' paths."""
    named = catalog.filter((F.col("type") == DIRECTORY) & (F.col("name_lc") == path.name))
    if path.parts:
        named = named.filter(segments(path.parts, F.col("path_lc")))
    parents = named.select(text.full_path(F.col("path_lc"), F.col("name_lc")).alias("_dir"))
    below = catalog.join(parents, F.col("path_lc") == F.col("_dir"), "left_semi")
    return below.withColumn("score", scoring.packed(F.lit(0), F.lit(scoring.AT_WORD)))


def search(catalog: DataFrame, query: str, limit: int | None = DEFAULT_LIMIT, clock: Clock | None = None, home: str | None = None, path_filter: str = "", contents: DataFrame | None = None, index: NameIndex | None = None) -> DataFrame:
    """RESULT of a query, best first. ``path_filter`` narrows what the limit has left, and keeps its ranks."""
    top = ranked(hits(catalog, query, clock, home, contents, index), limit).select(*RESULT)
    needle = path_filter.strip().lower()
    if not needle:
        return top
    return top.filter(F.lower(text.full_path(F.col("path"), F.col("name"))).contains(needle))


def subtree(catalog: DataFrame, prefix: str) -> DataFrame:
    """Rows whose full path is the prefix or lies below it."""
    return catalog.filter(text.stored_within(prefix))


def page(catalog: DataFrame, query: str, number: int, size: int = 100, limit: int = LARGEST_WINDOW, **how) -> DataFrame:
    """Page ``number`` (from 1) of the first ``limit`` results."""
    return search(catalog, query, min(limit, number * size), **how).filter(F.col("rank").between((number - 1) * size + 1, number * size))


def has_more(catalog: DataFrame, query: str, limit: int, **how) -> DataFrame:
    """(results, limited): how many results a limit leaves and whether there are more; counts limit + 1 rows at most."""
    n = hits(catalog, query, **how).select("file_id").limit(limit + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(limit)).alias("results"), (F.col("n") > limit).alias("limited"))


class Narrowing:
    """Reuses the last plain query's hits for one that lengthens it, until the catalog changes."""

    def __init__(self, catalog: DataFrame):
        self.catalog, self.query, self.kept = catalog, None, None

    def search(self, query: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
        from lodestone.query.lexer import has_syntax

        plain = not has_syntax(query) and not any(c in query for c in '/*?"')
        base = self.kept if plain and self.query and query.startswith(self.query) else self.catalog
        if plain and base is self.catalog:
            self.forget()
            self.kept, self.query = hits(self.catalog, query).drop("score").persist(), query
            base = self.kept
        return search(base, query, limit)

    def forget(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
        self.query = self.kept = None
