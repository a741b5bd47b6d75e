"""Index tables: a row for each (key, file). Optional; they change no results.

Lists stay rows, sorted by key within files: a frequent key's list is as long as the catalog, and no task has to hold it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.plans.patterns import atoms
from lodestone.query import nodes as n

#: Share of the catalog beyond which a scan is better than an index's candidates; ids and paths that a filter lists at most.
NAME_SHARE, LISTED = 0.10, 1000


def trigram_postings(catalog: DataFrame, column: str = "name_lc") -> DataFrame:
    return catalog.select("file_id", F.explode(text.trigrams(F.col(column))).alias("key"))


def pair_postings(catalog: DataFrame, column: str = "name_lc") -> DataFrame:
    """Postings of pairs of ideographs."""
    return catalog.select("file_id", F.explode(text.ideograph_pairs(F.col(column))).alias("key"))


def extension_postings(catalog: DataFrame) -> DataFrame:
    return catalog.filter("ext <> ''").select("file_id", F.col("ext").alias("key"))


def lengths(postings: DataFrame) -> DataFrame:
    """(key, files, first_id, last_id) of each posting list."""
    return postings.groupBy("key").agg(F.count("*").alias("files"), F.min("file_id").alias("first_id"), F.max("file_id").alias("last_id"))


def save(postings: DataFrame, target: str) -> None:
    """Write postings so that a key's rows are few row groups."""
    postings.repartitionByRange("key", "file_id").sortWithinPartitions("key", "file_id").write.mode("overwrite").parquet(target)


def all_of(postings: DataFrame, keys: list[str]) -> DataFrame:
    """file_ids in every key's list."""
    wanted = sorted(set(keys))
    found = postings.filter(F.col("key").isin(wanted)).groupBy("file_id").agg(F.count_distinct("key").alias("n"))
    return found.filter(F.col("n") == len(wanted)).select("file_id")


def any_of(postings: DataFrame, keys: list[str]) -> DataFrame:
    """file_ids in some key's list."""
    return postings.filter(F.col("key").isin(sorted(set(keys)))).select("file_id").distinct()


def candidates(postings: DataFrame, term: str) -> DataFrame | None:
    """file_ids that may hold the term; None if it is too short to tell."""
    low = term.lower()
    keys = [low[i : i + 3] for i in range(len(low) - 2)]
    return all_of(postings, keys) if keys else None


def maintain(postings: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings without those of the file_ids that are gone or changed, and with those of the fresh ones (same columns)."""
    return postings.join(gone.select("file_id").distinct(), "file_id", "left_anti").select(postings.columns).unionByName(fresh)


def required(node: n.Node) -> list[str]:
    """Lower-case texts of three characters or more, without a slash, that the name or the path of each hit holds."""
    match node:
        case n.And():
            return [t for c in node.children for t in required(c)]
        case n.Term():
            parts = {n.GLOB: lambda t: re.split("[*?]", t), n.REGEX: atoms}.get(node.mode, lambda t: [t])(node.text)
            pieces = [p for part in parts for p in ([part] if node.mode == n.REGEX else part.split("/"))]
        case n.PathHas() if not node.negated:
            pieces = node.text.split("/")
        case n.Segments():
            pieces = [t for t, _ in node.parts]
        case _:
            return []
    return [p.lower() for p in pieces if len(p) >= 3 and "/" not in p]


@dataclass
class NameIndex:
    """Trigrams of names, (key, file_id, path_lc) sorted by key; the length of each key's list; distinct paths."""

    names: DataFrame
    lengths: DataFrame
    paths: DataFrame
    total: int
    listed: int = LISTED

    @classmethod
    def of(cls, catalog: DataFrame) -> NameIndex:
        names = catalog.select("file_id", "path_lc", F.explode(text.trigrams(F.col("name_lc"))).alias("key"))
        return cls(names, names.groupBy("key").agg(F.count("*").alias("files")), catalog.select("path_lc").distinct(), catalog.count())

    def save(self, target: str) -> None:
        self.names.repartitionByRange("key", "path_lc").sortWithinPartitions("key", "path_lc").write.mode("overwrite").parquet(f"{target}/names")
        self.lengths.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{target}/lengths")
        self.paths.repartitionByRange("path_lc").sortWithinPartitions("path_lc").write.mode("overwrite").parquet(f"{target}/paths")

    @classmethod
    def load(cls, spark: SparkSession, target: str, total: int) -> NameIndex:
        return cls(*(spark.read.parquet(f"{target}/{part}") for part in ("names", "lengths", "paths")), total)

    def maintained(self, gone: DataFrame, fresh: DataFrame) -> NameIndex:
        """The index after file_ids are gone or changed; ``fresh``: the catalog's rows that are new or changed."""
        own = fresh.select("file_id", "path_lc", F.explode(text.trigrams(F.col("name_lc"))).alias("key"))
        names = maintain(self.names, gone, own)
        paths = self.paths.unionAll(fresh.select("path_lc")).distinct()  # paths that are empty now find nothing
        return NameIndex(names, names.groupBy("key").agg(F.count("*").alias("files")), paths, self.total)

    def rarest(self, texts: list[str]) -> tuple[str, int] | None:
        """The text whose rarest trigram has the fewest files, and how many; a row for each trigram of the query is read."""
        keys = {t: [t[i : i + 3] for i in range(len(t) - 2)] for t in texts}
        found = {r.key: r.files for r in self.lengths.filter(F.col("key").isin(sorted({k for ks in keys.values() for k in ks}))).collect()}
        return min(((t, min(found.get(k, 0) for k in ks)) for t, ks in keys.items()), key=lambda x: x[1], default=None)

    def _candidates(self, needle: str) -> DataFrame:
        """(file_id, path_lc) of names that hold all trigrams of the text."""
        keys = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
        rows = self.names.filter(F.col("key").isin(keys)).groupBy("file_id").agg(F.first("path_lc").alias("path_lc"), F.count("*").alias("n"))
        return rows.filter(F.col("n") == len(keys)).drop("n")

    def narrowed(self, catalog: DataFrame, trees: list[n.Node]) -> DataFrame:
        """The catalog's rows that may match some tree: all of them where a tree has no rare text.

        A hit holds a required text in its name, so it's among the candidates of the text's trigrams, or in its path,
        which then is among the distinct paths that hold it. Short lists become a filter on path and id that prunes a
        catalog sorted by path; longer ones, up to NAME_SHARE of the catalog, a semi-join.
        """
        chosen = [self.rarest(required(t)) for t in trees]
        if not trees or any(c is None or c[1] > NAME_SHARE * self.total for c in chosen):
            return catalog
        ids = reduce(DataFrame.unionAll, [self._candidates(needle) for needle, _ in chosen])
        paths = self.paths.filter(text.any_of([F.col("path_lc").contains(needle) for needle, _ in chosen]))
        listed = self._listed(ids, paths, sum(files for _, files in chosen))
        if listed is not None:
            return catalog.filter(listed)
        marked = ids.select("file_id").unionAll(catalog.join(paths, "path_lc", "left_semi").select("file_id"))
        return catalog.join(marked, "file_id", "left_semi")

    def _listed(self, ids: DataFrame, paths: DataFrame, files: int) -> Column | None:
        if files > self.listed:
            return None
        some = [r[0] for r in paths.limit(self.listed + 1).collect()]  # bounded, as are the candidates by ``files``
        if len(some) > self.listed:
            return None
        rows = ids.collect() if files else []
        here = F.col("path_lc").isin(sorted({r.path_lc for r in rows})) & F.col("file_id").isin([r.file_id for r in rows]) if rows else F.lit(False)
        return here | F.col("path_lc").isin(sorted(some)) if some else here
