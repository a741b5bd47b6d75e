"""Relevance: smaller is better.

A score packs, from high to low, how many scoring terms the name misses, how well the others match it, and the length
of the full path. Scoring terms are the plain substrings that aren't negated. A query on numbers and types alone has
score 0 everywhere, so its order is that of ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.query import nodes as n

EXACT, PREFIX, AT_WORD, INSIDE = 0, 1, 2, 3


def scoring_terms(node: n.Node) -> list[str]:
    match node:
        case n.And() | n.Or():
            return [t for c in node.children for t in scoring_terms(c)]
        case n.Term() if node.mode == n.SUBSTRING and node.text:
            return [node.text.lower()]
    return []


def is_pure(node: n.Node) -> bool:
    """Does the query look at numbers and types only?"""
    return all(isinstance(x, (n.TypeIs, n.Never)) or (isinstance(x, n.Compare) and x.field in ("size", "time")) for x in n.leaves(node))


def quality(name: Column, term: str) -> Column:
    """How well a name that holds the term matches it, by the term's first place."""
    at = F.instr(name, term)
    before = F.substring(name, at - 1, F.lit(1))
    return F.when(name == term, EXACT).when(at == 1, PREFIX).when(~before.rlike("[0-9a-z]"), AT_WORD).otherwise(INSIDE)


def path_length() -> Column:
    return F.octet_length("path") + 1 + F.octet_length("name_lc")


def packed(missed: Column, matched: Column) -> Column:
    low = F.least(path_length(), F.lit(65_535)).cast("long")
    return missed.cast("long") * (1 << 24) + F.least(matched, F.lit(255)).cast("long") * (1 << 16) + low


def score(node: n.Node) -> Column:
    if is_pure(node):
        return F.lit(0).cast("long")
    name, terms = F.col("name_lc"), scoring_terms(node)
    total = lambda parts: reduce(Column.__add__, parts, F.lit(0))
    missed = total(F.when(name.contains(t), 0).otherwise(1) for t in terms)
    matched = total(F.when(name.contains(t), quality(name, t)).otherwise(INSIDE) for t in terms)
    return packed(missed, matched)
