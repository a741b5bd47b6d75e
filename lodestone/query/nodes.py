"""Nodes of a parsed query. Trees are immutable; rewrites build new ones."""

from __future__ import annotations

from dataclasses import dataclass, replace

SUBSTRING, GLOB, REGEX, WORD, NAME = "substring", "glob", "regex", "word", "name"
EQ, LT, LE, GT, GE, RANGE = "=", "<", "<=", ">", ">=", "range"


@dataclass(frozen=True)
class Term:
    """Text to find. ``anchor``: None, or how the name alone is to match ("substring" or "exact")."""

    text: str
    mode: str = SUBSTRING
    case_sensitive: bool = False
    name_only: bool = False
    anchor: str | None = None
    quoted: bool = False


@dataclass(frozen=True)
class Ext:
    extensions: tuple[str, ...]


@dataclass(frozen=True)
class Compare:
    """``field``: size, depth, len or time. ``high`` is for ranges; None leaves an end open."""

    field: str
    op: str
    low: int | None
    high: int | None = None


@dataclass(frozen=True)
class TypeIs:
    """``text``: what a result shows as found; it decides nothing."""

    code: int | None
    text: str = ""


@dataclass(frozen=True)
class PathHas:
    text: str
    negated: bool = False


@dataclass(frozen=True)
class ParentIs:
    text: str


@dataclass(frozen=True)
class Segments:
    """Components that the parent path must hold, as (text, next to the one that follows)."""

    parts: tuple[tuple[str, bool], ...]


@dataclass(frozen=True)
class Never:
    """Matches nothing. ``invalid``: an argument couldn't be read; its negation matches nothing either."""

    invalid: bool = False


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class And:
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Node, ...]


Node = Term | Ext | Compare | TypeIs | PathHas | ParentIs | Segments | Never | Not | And | Or


def rewrite(node: Node, leaf) -> Node:
    """The tree with each leaf replaced by leaf(node)."""
    if isinstance(node, (And, Or)):
        return replace(node, children=tuple(rewrite(c, leaf) for c in node.children))
    if isinstance(node, Not):
        return Not(rewrite(node.child, leaf))
    return leaf(node)


def leaves(node: Node):
    """All leaves, in order."""
    if isinstance(node, (And, Or)):
        for c in node.children:
            yield from leaves(c)
    elif isinstance(node, Not):
        yield from leaves(node.child)
    else:
        yield node
