"""Filter tokens to nodes."""

from __future__ import annotations

import re

from lodestone.query import dates
from lodestone.query.nodes import EQ, GE, GT, LE, LT, NAME, RANGE, REGEX, WORD, Compare, Ext, Never, Node, ParentIs, PathHas, Term, TypeIs

#: Extension lists of the macros.
MACROS = {
    "audio": "mp3;wav;flac;aac;ogg;m4a;wma;alac",
    "video": "mp4;avi;mkv;mov;wmv;flv;webm;m4v",
    "pic": "jpg;jpeg;png;gif;bmp;tiff;tif;webp;svg;ico;heic;heif;raw",
    "doc": "pdf;doc;docx;xls;xlsx;ppt;pptx;txt;rtf;odt;ods;odp;csv;md",
    "exe": "app;dmg;pkg;sh;command;csh;action",
    "zip": "zip;rar;7z;tar;gz;bz2;xz;tgz;zst;lz4",
}

#: Type codes.
FILE, DIRECTORY, SYMLINK, OTHER, BUNDLE, TOMBSTONE = 1, 2, 3, 4, 5, 0

LARGEST = (1 << 63) - 1
_UNITS = {"k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}
_TIMES = frozenset(("dm", "datemodified", "dc", "datecreated", "da", "dateaccessed"))
_MARKER = re.compile(r"\(\?options:([^)]*)\)")


def amount(text: str) -> int:
    """A number with an optional size unit; 0 if it doesn't start with one."""
    digits = re.match(r"[0-9.]*", text)[0]
    number = re.match(r"[0-9]+\.?[0-9]*|\.[0-9]+", digits)
    if not number:
        return 0
    return min(LARGEST, int(float(number[0]) * (1 << _UNITS.get(text[len(digits) :].lower(), 0))))


def numeric(field: str, argument: str) -> Node:
    low, dots, high = argument.partition("..")
    if dots:
        return Compare(field, RANGE, amount(low), amount(high) if high else None)
    op = next((o for o in (GE, LE, GT, LT) if argument.startswith(o)), EQ)
    return Compare(field, op, amount(argument[len(op) :] if op != EQ else argument))


def extensions(argument: str) -> Node:
    return Ext(tuple(x for x in argument.lower().split(";") if x))


def regex(argument: str) -> Node:
    """A pattern; an option marker in front of it, ``(?options:case,ww,wfn)``, sets case, whole words and names only."""
    if marker := _MARKER.match(argument):
        flags = {f for f in marker[1].split(",") if f}
        if flags <= {"case", "ww", "wfn"}:
            pattern = argument[marker.end() :]
            return Term(rf"\b(?:{pattern})\b" if "ww" in flags else pattern, REGEX, "case" in flags, "wfn" in flags)
    return Term(argument, REGEX)


def with_options(keyword: str, pattern: bool = False, case: bool = False, whole_word: bool = False, whole_name: bool = False) -> str:
    """The query of a keyword and a search field's switches. A pattern takes all that follows it, so its switches stand in a
    marker; other switches are filters in front of the keyword."""
    if not keyword:
        return keyword
    if pattern:
        flags = [f for f, on in (("case", case), ("ww", whole_word), ("wfn", whole_name)) if on]
        return "regex:" + (f"(?options:{','.join(flags)})" if flags else "") + keyword
    return "".join(f for f, on in (("case:", case), ("ww:", whole_word), ("wfn:", whole_name)) if on) + keyword


def bind(name: str, argument: str, clock: dates.Clock) -> Node:
    if name in MACROS:
        return extensions(MACROS[name])
    if name in _TIMES:
        return dates.compare(argument, clock)
    match name:
        case "ext":
            return extensions(argument)
        case "size" | "len" | "depth":
            return numeric(name, argument)
        case "file":
            return TypeIs(FILE, argument)
        case "folder":
            return TypeIs(DIRECTORY)
        case "type":
            return TypeIs({"file": FILE, "folder": DIRECTORY, "dir": DIRECTORY}.get(argument.lower()))
        case "path" | "nopath":
            return PathHas(argument.lower(), negated=name == "nopath")
        case "parent":
            return ParentIs(argument.lower())
        case "case" | "nocase":
            return Term(argument, case_sensitive=name == "case")
        case "regex":
            return regex(argument)
        case "ww" | "wholeword":
            return Term(argument, WORD)
        case "wfn" | "wholefilename":
            return Term(argument, NAME)
    return Never()  # content: and infile: are for content searches
