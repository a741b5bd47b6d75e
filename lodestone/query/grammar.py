"""Tokens to a tree.

    any   := all ("|" all)*
    all   := one one*
    one   := "!" atom | atom
    atom  := "<" any ">" | quoted | filter | word

A stray operator makes the whole query void; a closing ``>`` may be missing; a ``!`` without an atom is itself.
"""

from __future__ import annotations

from lodestone.query import filters
from lodestone.query.dates import Clock
from lodestone.query.lexer import Token, tokens
from lodestone.query.nodes import And, Node, Not, Or, Term

DEEPEST = 64


class _Parser:
    def __init__(self, found: list[Token], clock: Clock):
        self.found, self.at, self.depth, self.clock = found, 0, 0, clock

    def kind(self) -> str | None:
        return self.found[self.at].kind if self.at < len(self.found) else None

    def take(self) -> Token:
        self.at += 1
        return self.found[self.at - 1]

    def any(self) -> Node | None:
        parts = [self.all()]
        while parts[-1] is not None and self.kind() == "|":
            self.take()
            parts.append(self.all())
        if parts[-1] is None:
            return None
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def all(self) -> Node | None:
        parts = [self.one()]
        while parts[-1] is not None and self.kind() not in (None, "|", ">"):
            parts.append(self.one())
        whole = [p for p in parts if p is not None]
        if parts[0] is None:
            return None
        return whole[0] if len(whole) == 1 else And(tuple(whole))

    def one(self) -> Node | None:
        if self.kind() != "!":
            return self.atom()
        self.take()
        child = self.atom()
        return Term("!") if child is None else Not(child)

    def atom(self) -> Node | None:
        if self.kind() is None:
            return None
        token = self.take()
        match token.kind:
            case "<":
                return self.group()
            case "quoted":
                return Term(token.value, quoted=True) if token.value else None
            case "filter":
                return filters.bind(token.value, token.argument, self.clock)
            case "word":
                return Term(token.value)
        return None

    def group(self) -> Node | None:
        if self.depth >= DEEPEST:
            still_open = 1  # too deep: the group is passed over and stands for its bracket
            while still_open and self.kind() is not None:
                still_open += {"<": 1, ">": -1}.get(self.take().kind, 0)
            return Term("<")
        self.depth += 1
        inside = self.any()
        self.depth -= 1
        if self.kind() == ">":
            self.take()
        return inside


def parse(query: str, clock: Clock | None = None) -> Node | None:
    """The tree of a query; None if it is void."""
    parser = _Parser(tokens(query), clock or Clock())
    tree = parser.any()
    return tree if parser.kind() is None else None
