"""Regular expressions of the search language, in Java's terms.

The language is that of automata: no look-around, no back-references, no possessive or atomic groups; ``\\w``, ``\\d``,
``\\s`` and ``\\b`` are ASCII, ``.`` is all but the line feed, ``$`` the end of the text unless ``(?m)`` holds, and case is
folded for all of Unicode. Java's engine differs in all of these, so patterns are read token by token and written anew.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

#: POSIX classes, and the general categories that Java knows by the same name.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
CATEGORIES = frozenset("C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split())
SPACE, MOST_REPEATS = r"\t\n\f\r ", 1000
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_INNER = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"
_QUANTIFIER = re.compile(r"[*+?]|\{(\d+)(?:,(\d*))?\}")


class Invalid(ValueError):
    """The pattern isn't one of the language."""


def _property(pattern: str, i: int) -> tuple[str, int]:
    """The class of a ``\\p`` at i."""
    found = re.compile(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))").match(pattern, i)
    if not found:
        raise Invalid("a class without a name")
    negated = (found[1] == "P") != bool(found[2])
    name = found[3] or found[4]
    own = name if name in CATEGORIES else "IsAssigned" if name == "Any" else f"Is{name}"
    if name == "Any":
        return ("[^\\x{0}-\\x{10FFFF}]" if negated else "[\\x{0}-\\x{10FFFF}]"), found.end()
    return f"\\{'P' if negated else 'p'}{{{own}}}", found.end()


def _escape(pattern: str, i: int, inside: bool) -> tuple[str, int]:
    """What an escape at i stands for, and where it ends."""
    if i + 1 >= len(pattern):
        raise Invalid("a backslash at the end")
    c = pattern[i + 1]
    if c in "pP":
        return _property(pattern, i)
    if c in "01234567":
        octal = re.compile("[0-7]{1,3}").match(pattern, i + 1)[0]
        if c != "0" and len(octal) < 2:
            raise Invalid("a back-reference")
        return f"\\x{{{int(octal, 8):x}}}", i + 1 + len(octal)
    if c == "x":
        hexa = re.compile(r"\\x(?:\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2}))").match(pattern, i)
        if not hexa or int(hexa[1] or hexa[2], 16) > 0x10FFFF:
            raise Invalid("a wrong code point")
        return f"\\x{{{hexa[1] or hexa[2]}}}", hexa.end()
    if c in "dDwWafnrt":
        return f"\\{c}", i + 2
    if c == "v":
        return r"\x0B", i + 2
    if c == "s":
        return (SPACE if inside else f"[{SPACE}]"), i + 2
    if c == "S":
        return (f"[^{SPACE}]"), i + 2
    if not inside and c in "bBAz":
        return {"b": _EDGE, "B": _INNER, "A": r"\A", "z": r"\z"}[c], i + 2
    if c.isascii() and c.isalnum():
        raise Invalid(f"an unknown escape \\{c}")
    return (f"\\{c}" if c.isascii() else c), i + 2


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The bracket expression at i."""
    out, i = "[", i + 1
    if pattern[i : i + 1] == "^":
        out, i = "[^", i + 1
    first = True
    while True:
        if i >= len(pattern):
            raise Invalid("a bracket without an end")
        c = pattern[i]
        if c == "]" and not first:
            return out + "]", i + 1
        first = False
        posix = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i)
        if posix:
            if posix[2] not in POSIX:
                raise Invalid("an unknown class")
            out += f"[^{POSIX[posix[2]]}]" if posix[1] else POSIX[posix[2]]
            i = posix.end()
        elif c == "\\":
            text, i = _escape(pattern, i, inside=True)
            out += text
        else:
            out += f"\\{c}" if c in "[]&^~" or (c == "-" and pattern[i + 1 : i + 2] in ("", "]")) else c
            i += 1


def _group(pattern: str, i: int) -> tuple[str, int]:
    """The opening of the group at i."""
    if not pattern.startswith("(?", i):
        return "(", i + 1
    named = re.compile(r"\(\?P?<(\w+)>").match(pattern, i)
    if named:
        return "(", named.end()  # names say nothing to a search
    flags = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])").match(pattern, i)
    if not flags:
        raise Invalid("a group that the language lacks")
    on, off = (x and "".join(("iu" if f == "i" else f) for f in x if f != "U") for x in (flags[1], flags[2]))  # greed decides nothing here
    if not on and not off and flags[3] == ")":
        return "(?:)", flags.end()
    return f"(?{on or ''}{'-' + off if off else ''}{flags[3]}", flags.end()


def _java(pattern: str) -> str:
    quoted = re.compile(r"\\Q(.*?)(?:\\E|$)", re.DOTALL)
    lines = re.search(r"\(\?[a-zA-Z]*m", pattern)
    out, depth, i, repeatable = [], 0, 0, False
    while i < len(pattern):
        c, start = pattern[i], i
        quantifier = _QUANTIFIER.match(pattern, i)
        if quantifier:
            low, high = int(quantifier[1] or 0), quantifier[2]
            if not repeatable or low > MOST_REPEATS or (high and not low <= int(high) <= MOST_REPEATS):
                raise Invalid("a wrong repetition")
            out.append(quantifier[0])
            i = quantifier.end()
            if pattern[i : i + 1] == "?":
                out.append("?")
                i += 1
            if _QUANTIFIER.match(pattern, i):
                raise Invalid("a repetition of a repetition")
            repeatable = False
            continue
        repeatable = True
        if literal := quoted.match(pattern, i) if c == "\\" else None:
            out.append(re.sub(r"([^\w\s])", r"\\\1", literal[1], flags=re.ASCII) if literal[1].isascii() else re.escape(literal[1]))
            i, repeatable = literal.end(), bool(literal[1])
        elif c == "\\":
            text, i = _escape(pattern, i, inside=False)
            out.append(text)
        elif c == "[":
            text, i = _class(pattern, i)
            out.append(text)
        elif c == "(":
            text, i = _group(pattern, i)
            out.append(text)
            depth, repeatable = depth + (not text.endswith(")")), False
        elif c == ")":
            depth, i = depth - 1, i + 1
            out.append(c)
            if depth < 0:
                raise Invalid("a bracket without a beginning")
        else:
            out.append({"$": "$" if lines else r"\z", "{": r"\{", "}": r"\}", "]": r"\]"}.get(c, c))
            i, repeatable = start + 1, c != "|"
    if depth:
        raise Invalid("a bracket without an end")
    return "(?d)" + "".join(out)


def java_pattern(pattern: str, case_sensitive: bool = False) -> str | None:
    """The pattern for Java's engine; None if it isn't one of the language, or Java knows a class of it by no name."""
    try:
        out = ("" if case_sensitive else "(?iu)") + _java(pattern)
    except Invalid:
        return None
    context = SparkContext._active_spark_context
    if context is not None:
        matcher = context._jvm.java.util.regex.Pattern
        try:
            matcher.compile(out)
        except (IllegalArgumentException, Py4JJavaError):
            return None
    return out


def atoms(pattern: str, shortest: int = 3) -> list[str]:
    """Lower-case literals of at least that length, all of which each match holds."""
    try:
        _java(pattern)
    except Invalid:
        return []
    out, run, i = [], "", 0
    if re.search(r"[|]|\\Q", pattern):
        return []  # what alternatives have in common isn't looked for

    def end() -> None:
        nonlocal run
        if len(run) >= shortest:
            out.append(run.lower())
        run = ""

    depth = 0
    while i < len(pattern):
        quantifier = _QUANTIFIER.match(pattern, i)
        if quantifier:
            run = run[:-1]  # the last character may be missing, or stand several times
            end()
            i = quantifier.end() + (pattern[quantifier.end() : quantifier.end() + 1] == "?")
            continue
        c = pattern[i]
        if c == "[":
            end()
            i = _class(pattern, i)[1]
        elif c == "(":
            end()
            text, i = _group(pattern, i)
            depth += not text.endswith(")")
        elif c == ")":
            end()
            depth, i = depth - 1, i + 1
        elif c == "\\":
            text, after = _escape(pattern, i, inside=False)
            literal = pattern[i + 1] if after == i + 2 and not pattern[i + 1].isalnum() else None
            if literal is None or depth:
                end()
            else:
                run += literal
            i = after
        elif c in ".^$" or depth:  # groups may be repeated as a whole, so their literals don't count
            end()
            i += 1
        else:
            run += c
            i += 1
    end()
    return list(dict.fromkeys(out))
