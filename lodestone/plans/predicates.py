"""A query's tree as one boolean column over a catalog."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.plans.patterns import java_pattern
from lodestone.query import nodes as n

_COLUMN = {"size": "size", "depth": "depth", "time": "mod_time"}


def _full(term: n.Term) -> Column:
    return F.concat("path", F.lit("/"), "name") if term.case_sensitive else F.col("match_path_lc")


def _substring(term: n.Term, initials: bool) -> Column:
    text = term.text if term.case_sensitive else term.text.lower()
    name = F.col("name" if term.case_sensitive else "name_lc")
    if term.name_only:
        return name == text if term.anchor == "exact" else name.contains(text)
    found = _full(term).contains(text)  # which holds the name
    if initials and not term.case_sensitive and re.fullmatch(r"[0-9a-z]*[a-z][0-9a-z]*", text):
        found |= F.col("initials").contains(text)
    return found


def glob_pattern(text: str) -> str:
    """SQL LIKE for a glob: ``*`` any characters, ``?`` one."""
    return re.sub(r"[%_\\]", lambda m: "\\" + m[0], text).replace("*", "%").replace("?", "_")


def _glob(term: n.Term) -> Column:
    text = term.text.lower()
    target = F.col("match_path_lc" if "/" in text else "name_lc")
    inner = text.strip("*")
    if re.search(r"[*?]", inner):
        return target.like(glob_pattern(text))
    starts, ends = text.startswith("*"), text.endswith("*")
    if not inner:
        return F.lit(True) if text else target == ""
    return target.contains(inner) if starts and ends else target.endswith(inner) if starts else target.startswith(inner) if ends else target == inner


def _regex(term: n.Term) -> Column:
    pattern = java_pattern(term.text, term.case_sensitive)
    if pattern is None:
        return F.lit(False)
    name = F.col("name" if term.case_sensitive else "name_lc").rlike(pattern)
    return name if term.name_only else name | _full(term).rlike(pattern)


def word_pattern(word: str) -> str:
    """The word between characters that aren't ASCII letters or digits, or at an end; in lower case."""
    return "(^|[^0-9a-z])" + re.sub(r"([^0-9A-Za-z\x80-\U0010ffff])", r"\\\1", word.lower()) + "([^0-9a-z]|$)"


def _term(term: n.Term, initials: bool) -> Column:
    match term.mode:
        case n.GLOB:
            return _glob(term)
        case n.REGEX:
            return _regex(term)
        case n.WORD:
            return F.col("name_lc").rlike(word_pattern(term.text))
        case n.NAME:
            return F.col("name_lc") == term.text.lower()
    return _substring(term, initials)


def _compare(node: n.Compare) -> Column:
    value = F.octet_length("name_lc").cast("long") if node.field == "len" else F.col(_COLUMN[node.field])
    match node.op:
        case n.EQ:
            return value == node.low
        case n.LT:
            return value < node.low
        case n.LE:
            return value <= node.low
        case n.GT:
            return value > node.low
        case n.GE:
            return value >= node.low
    low = value >= node.low if node.low else F.lit(True)
    return low if node.high is None else low & (value <= node.high)


def segments(parts: tuple[tuple[str, bool], ...], path: Column) -> Column:
    """Do the path's components hold the parts? From the right, each at its first place, without going back.

    State of the fold over the components from the right: how many parts are found, or -1 once a part that had to be
    next wasn't there.
    """
    wanted = [text for text, _ in reversed(parts)]
    gap = [True, *(not adjacent for _, adjacent in reversed(parts[:-1]))]  # may components be passed over before it?
    components = F.reverse(F.filter(F.split(path, "/"), lambda c: c != ""))
    want, may = F.array(*map(F.lit, wanted)), F.array(*map(F.lit, gap))

    def step(found: Column, component: Column) -> Column:
        at = found + 1
        hit = component.contains(F.get(want, found))
        return F.when((found < 0) | (found >= len(wanted)), found).when(hit, at).when(F.get(may, found), found).otherwise(F.lit(-1))

    return F.aggregate(components, F.lit(0), step) == len(wanted)


def predicate(node: n.Node, initials: bool = False) -> Column:
    """The condition that a row has to meet."""
    match node:
        case n.And():
            return reduce(Column.__and__, (predicate(c, initials) for c in node.children))
        case n.Or():
            return reduce(Column.__or__, (predicate(c, initials) for c in node.children))
        case n.Not():
            if node.child == n.Never(invalid=True):
                return F.lit(False)
            return ~predicate(node.child, initials)
        case n.Term():
            return _term(node, initials)
        case n.Ext():
            found = [e for e in node.extensions if e]
            return F.col("ext").isin(found) if found else F.lit(False)
        case n.Compare():
            return _compare(node)
        case n.TypeIs():
            return F.col("type") == node.code if node.code is not None else F.lit(False)
        case n.PathHas():
            found = F.col("match_path_lc").contains(node.text)
            return ~found if node.negated else found
        case n.ParentIs():
            return F.col("path_lc") == node.text
        case n.Segments():
            return segments(node.parts, F.col("path_lc"))
    return F.lit(False)
