"""Where a query's terms stand in names and paths."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from lodestone.functions.text import initials_with_places
from lodestone.plans.patterns import java_pattern
from lodestone.query import nodes as n
from lodestone.query.dates import Clock
from lodestone.query.rewrites import understand

NAME, PATH, ANY = "name", "path", "any"
RANGES = "array<struct<start: int, length: int>>"


@dataclass(frozen=True)
class Hint:
    """What to mark, and in which field."""

    text: str
    mode: str
    field: str
    case_sensitive: bool = False


def hints(query: str, clock: Clock | None = None, home: str | None = None) -> list[Hint]:
    """Of all terms that aren't negated, and of the arguments of path: and file:."""

    def of(node) -> list[Hint]:
        match node:
            case n.And() | n.Or():
                return [h for c in node.children for h in of(c)]
            case n.Term():
                field = NAME if node.name_only or node.mode in (n.WORD, n.NAME) else ANY
                return [Hint(node.text, node.mode, field, node.case_sensitive)]
            case n.PathHas() if not node.negated:
                return [Hint(node.text, n.SUBSTRING, PATH)]
            case n.TypeIs() if node.text:
                return [Hint(node.text, n.SUBSTRING, NAME)]
            case n.Segments():
                return [Hint(t, n.SUBSTRING, PATH) for t, _ in node.parts]
        return []

    tree = understand(query, clock, home)
    return of(tree) if tree is not None else []


def _pattern(hint: Hint) -> re.Pattern | None:
    flags = 0 if hint.case_sensitive else re.IGNORECASE
    match hint.mode:
        case n.GLOB:
            literals = [re.escape(x) for x in re.split(r"[*?]+", hint.text) if x]
            return re.compile("|".join(literals), flags) if literals else None
        case n.REGEX:
            return _own_pattern(hint.text, flags) if java_pattern(hint.text) else None
        case n.WORD:
            return re.compile(r"(?<![0-9A-Za-z])" + re.escape(hint.text) + r"(?![0-9A-Za-z])", flags)
        case n.NAME:
            return re.compile(rf"\A{re.escape(hint.text)}\Z", flags)
    return re.compile(re.escape(hint.text), flags) if hint.text else None


def _own_pattern(pattern: str, flags: int):
    """A pattern of the language for marking; null if this side has no such classes."""
    try:
        import regex
    except ImportError:
        regex = re
    try:
        return regex.compile(pattern, flags)
    except regex.error:
        return None


def initials_ranges(text: str, hint: Hint) -> list[tuple[int, int]]:
    """Where a plain term of ASCII letters and digits matches the text's Mandarin initials."""
    key = hint.text.lower()
    if hint.mode != n.SUBSTRING or hint.case_sensitive or not re.fullmatch("[0-9a-z]+", key):
        return []
    initials, places = initials_with_places(text)
    return [(p, p + 1) for m in re.finditer(key, initials) for p in places[m.start() : m.end()]]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges [from, to) in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(r for r in ranges if r[0] < r[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def ranges_of(name: str, path: str, marks: list[Hint]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges in the name and in the path; a hit across both is split at the slash."""
    patterns = [(h, p) for h in marks if (p := _pattern(h))]
    in_name = [m.span() for h, p in patterns if h.field != PATH for m in p.finditer(name)] + [r for h in marks if h.field != PATH for r in initials_ranges(name, h)]
    in_path = [m.span() for h, p in patterns if h.field != NAME for m in p.finditer(path)] + [r for h in marks if h.field != NAME for r in initials_ranges(path, h)]
    edge, whole = len(path), f"{path}/{name}"
    both = [p for h, p in patterns if h.field == ANY and h.mode == n.SUBSTRING and "/" in h.text]
    across = [m.span() for p in both for m in p.finditer(whole) if m.start() < edge + 1 < m.end()]
    in_name += [(0, z - edge - 1) for _, z in across]
    in_path += [(a, min(z, edge)) for a, z in across]
    return merged(in_name), merged(in_path)


def highlight(results: DataFrame, query: str, clock: Clock | None = None, home: str | None = None) -> DataFrame:
    """results with ``name_ranges`` and ``path_ranges``, in characters from 0."""
    marks = hints(query, clock, home)

    @F.pandas_udf(f"name {RANGES}, path {RANGES}")
    def of(names: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [ranges_of(a, b, marks) for a, b in zip(names, paths)]
        as_rows = lambda rs: [{"start": a, "length": z - a} for a, z in rs]
        return pd.DataFrame({"name": [as_rows(x) for x, _ in found], "path": [as_rows(y) for _, y in found]})

    own = results.withColumn("_h", of("name", "path"))
    return own.select(*results.columns, F.col("_h.name").alias("name_ranges"), F.col("_h.path").alias("path_ranges"))


