"""Query strings to tokens."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Names that make ``name:argument`` a filter.
FILTERS = frozenset(
    "ext size file folder path nopath parent depth len dm dc da datemodified datecreated dateaccessed "
    "case nocase regex ww wfn wholeword wholefilename audio video pic doc exe zip content infile type".split()
)

_TOKEN = re.compile(
    r"""[ \t]+
    |(?P<operator>[|!<>])
    |"(?P<quoted>[^"]*)"?
    |(?P<word>[^ \t|!<>"]+)""",
    re.VERBOSE,
)
_ARGUMENT = re.compile(r'[<>]?[^ \t|!<>"]*')


class Token(NamedTuple):
    """``kind``: an operator itself, "quoted", "word" or "filter" (value: name, argument: the rest)."""

    kind: str
    value: str
    argument: str = ""


def tokens(query: str) -> list[Token]:
    out, at = [], 0
    while at < len(query):
        found = _TOKEN.match(query, at)
        word, start, at = found["word"], at, found.end()
        if found["operator"]:
            out.append(Token(found["operator"], found["operator"]))
        elif found["quoted"] is not None:
            out.append(Token("quoted", found["quoted"]))
        elif word:
            name, colon, _ = word.partition(":")
            if colon and name.lower() in FILTERS:
                begin = start + len(name) + 1
                # a pattern may hold any character, so it takes all that is left
                at = len(query) if name.lower() == "regex" else _ARGUMENT.match(query, begin).end()
                out.append(Token("filter", name.lower(), query[begin:at]))
            else:
                out.append(Token("word", word))
    return out


def has_syntax(query: str) -> bool:
    """Does the query hold more than plain words?"""
    if re.search(r'[|!<>"]', query):
        return True
    return any(m[1].lower() in FILTERS for m in re.finditer(r"([^\s|!<>:]+):", query))
