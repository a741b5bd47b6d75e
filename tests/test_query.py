"""The search language: lexer, grammar, arguments and rewrites."""

import pytest

from lodestone.query import filters, nodes as n
from lodestone.query.dates import Clock, period
from lodestone.query.grammar import parse
from lodestone.query.lexer import has_syntax, tokens
from lodestone.query.rewrites import DIR_EXACT, DIR_LIST, PLAIN, SEGMENTS, path_query, prepared, understand
from lodestone.suite import at

CLOCK = Clock()


def test_tokens():
    kinds = [(t.kind, t.value, t.argument) for t in tokens('a|"b c" !size:>1mb <ext:h> foo:bar "open')]
    assert kinds == [
        ("word", "a", ""), ("|", "|", ""), ("quoted", "b c", ""), ("!", "!", ""), ("filter", "size", ">1mb"), ("<", "<", ""),
        ("filter", "ext", "h"), (">", ">", ""), ("word", "foo:bar", ""), ("quoted", "open", ""),
    ]
    assert tokens("x regex:a|b c") == [("word", "x", ""), ("filter", "regex", "a|b c")]
    assert tokens("DEPTH:<3") == [("filter", "depth", "<3")] and tokens(" \t") == []


def test_syntax():
    assert has_syntax("a|b") and has_syntax("x ext:h") and has_syntax('"a"') and not has_syntax("a b c:d")


def test_grammar():
    t = n.Term
    assert parse("a b|c") == n.Or((n.And((t("a"), t("b"))), t("c")))
    assert parse("!a <b|c>") == n.And((n.Not(t("a")), n.Or((t("b"), t("c")))))
    assert parse("<a b") == n.And((t("a"), t("b")))
    assert parse("!") == t("!") and parse("a !") == n.And((t("a"), t("!")))
    for void in ("", "  ", "|", "a|", "|a", "a>", ">", '""', "a||b", "<>"):
        assert parse(void) is None, void
    assert parse('"a" ') == n.Term("a", quoted=True)


def test_deep_groups_are_literal():
    assert list(n.leaves(parse("<" * 64 + "a" + ">" * 64))) == [n.Term("a")]
    assert list(n.leaves(parse("<" * 70 + "a" + ">" * 70))) == [n.Term("<")]


@pytest.mark.parametrize(
    ("text", "value"),
    [("1kb", 1024), ("1.5mb", 1572864), ("2G", 2 << 30), ("1t", 1 << 40), ("12b", 12), ("7x", 7), ("abc", 0), ("", 0), (".5k", 512), (".", 0), ("99999999999t", (1 << 63) - 1)],
)
def test_amounts(text, value):
    assert filters.amount(text) == value


def test_numbers():
    assert parse("size:>=1kb") == n.Compare("size", n.GE, 1024)
    assert parse("size:1kb..") == n.Compare("size", n.RANGE, 1024, None)
    assert parse("len:..5") == n.Compare("len", n.RANGE, 0, 5)
    assert parse("size:abc") == n.Compare("size", n.EQ, 0)


def test_filters():
    assert parse("ext:CPP;;h") == n.Ext(("cpp", "h")) and parse("type:Dir") == n.TypeIs(2) and parse("type:x") == n.TypeIs(None)
    assert parse("case:Ab") == n.Term("Ab", case_sensitive=True)
    assert parse("regex:(?options:ww,case)x") == n.Term(r"\b(?:x)\b", n.REGEX, True)
    assert parse("regex:(?options:no)x") == n.Term("(?options:no)x", n.REGEX)
    assert parse("zip:ignored") == n.Ext(tuple(filters.MACROS["zip"].split(";")))
    assert parse("nopath:A") == n.PathHas("a", negated=True) and parse("content:x") == n.Never()


@pytest.mark.parametrize(
    ("text", "first", "last"),
    [
        ("today", "2024-01-31", "2024-02-01"), ("yesterday", "2024-01-30", "2024-01-31"), ("thisweek", "2024-01-28", "2024-02-04"),
        ("lastweek", "2024-01-21", "2024-01-28"), ("thismonth", "2024-01-01", "2024-02-01"), ("lastmonth", "2023-12-01", "2024-01-01"),
        ("thisyear", "2024-01-01", "2025-01-01"), ("lastyear", "2023-01-01", "2024-01-01"), ("2024", "2024-01-01", "2025-01-01"),
        ("2024-02", "2024-02-01", "2024-03-01"), ("2024-02-29", "2024-02-29", "2024-03-01"),
    ],
)
def test_periods(text, first, last):
    assert period(text.upper(), CLOCK) == (at(first), at(last) - 1)


@pytest.mark.parametrize(("text", "first"), [("last7days", "2024-01-24"), ("last1day", "2024-01-30"), ("last2weeks", "2024-01-17"), ("last2months", "2023-11-30"), ("last1year", "2023-01-31")])
def test_relative_periods_end_now(text, first):
    assert period(text, CLOCK) == (at(first), CLOCK.now)


def test_no_periods():
    for text in ("", "someday", "2024-13", "2023-02-29", "1899", "lastdays", "last0days", "last9days2", "2024-1", "last999999999days"):
        assert period(text, CLOCK) is None, text
    assert parse("dm:x..2024") == parse("dm:..") == parse("dm:") == n.Never(invalid=True)


def test_date_comparisons():
    assert parse("dm:>2023-06") == n.Compare("time", n.GT, at("2023-07-01") - 1)
    assert parse("dm:>=2023-06") == n.Compare("time", n.GE, at("2023-06-01"))
    assert parse("da:<2023-06") == n.Compare("time", n.LT, at("2023-06-01"))
    assert parse("dc:<=2023-06") == n.Compare("time", n.LE, at("2023-07-01") - 1)
    assert parse("dm:2022..2023") == n.Compare("time", n.RANGE, at("2022-01-01"), at("2024-01-01") - 1)


def test_time_zones():
    berlin = Clock(CLOCK.now, "Europe/Berlin")
    assert period("2023-07-01", berlin) == (at("2023-07-01") - 7200, at("2023-07-02") - 7201)


@pytest.mark.parametrize(
    ("text", "mode", "parts", "name"),
    [
        ("hello", PLAIN, (), "hello"), ("/abc/def", SEGMENTS, (("abc", True),), "def"), ("/ABC/def/", DIR_EXACT, (("abc", True),), "def"),
        ("/abc/def/*", DIR_LIST, (("abc", True),), "def"), ("/abc/*/def", SEGMENTS, (("abc", False),), "def"), ("/usr/", SEGMENTS, (), "usr"),
        ("*/lib/*", PLAIN, (), "*/lib/*"), ("a/b?/c", PLAIN, (), "a/b?/c"), ("/", PLAIN, (), ""), ("/*", PLAIN, (), ""), ("a//b", SEGMENTS, (("a", True),), "b"),
        ("dir/*/", DIR_EXACT, (("dir", True),), "*"),
    ],
)
def test_path_queries(text, mode, parts, name):
    found = path_query(text)
    assert (found.mode, found.parts, found.name) == (mode, parts, name)


def test_rewrites():
    assert understand("A/b") == n.And((n.Segments((("a", True),)), n.Term("b", name_only=True, anchor="substring")))
    assert understand('"a/b"') == n.Term("a/b", quoted=True)
    assert understand("*.c").mode == n.GLOB and understand("case:*.C").mode == n.GLOB and understand('"*"').mode == n.SUBSTRING
    assert understand("case:X/Yy").children[1] == n.Term("Yy", case_sensitive=True, name_only=True, anchor="substring")
    assert understand("dir/*/").children[1].mode == n.GLOB


def test_preparation():
    assert prepared(" ~/x ", "/home/u/") == "/home/u/x" and prepared("~", "/h") == "~" and prepared("~/x") == "~/x"
    assert prepared("终端") == '<"终端"|"terminal">' and prepared("终端 x") == "终端 x"
