import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.plans.patterns import atoms, java_pattern

TEXTS = ["", "a", "abc", "ABC", "a.b", "É", "é", "中文", "Straße", "x1", "_", "a b", "a\nb", "a\rb", "ab\n", "a{2}", "a-b", "[x]", "a&b", "Ω", "٣", "\x0b", "ſ", "K", "a b", "tab\t", "naïve café"]
PATTERNS = [
    "(?P<x>a)b", r"\p{Han}", r"\pL", r"\P{Latin}", r"\p{^Greek}", "é", "[[:alpha:]]", "[[:^alpha:]]", "[[:word:]-]", "[^[:space:]]", "a.b", "b$", "(?m)a$", "^a", r"\bé", r"f\b", r"\Bb",
    r"\w\W", r"\d", r"\s", r"\S", r"\x{4e2d}", r"\x61", r"\141", r"\Qa.b\E", r"\Q{2}", "a{2}", "a{", "a{,2}", "a{1,}", "[a&&b]", "[]x]", "[^]]", "[a-]", "(?i:É)", "(?s)a.b", "(?U)a+", "a+?", "(a|b)*c", "(?:a)(?-i:B)",
    r"\z", r"\Aab", "ß", "k", "s", r"[\p{Lu}\d]", r"\.", r"\-", "a|", "()", "x*", r"\v", r"\t", "中|É",
]
INVALID = [r"(a)\1", "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "a++", "a*+", "(?>a)", "*a", "(", ")", "[a", "a**", "a{2000}", r"\p{NoSuch}", r"a\Z", r"\h", r"\R", r"\G", "(?x)a", "a\\", "[[:nosuch:]]", "(?P=x)", "a{3,2}"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").persist()


@pytest.fixture(scope="module")
def con():
    return duckdb.connect()


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_like_an_automaton(texts, con, case_sensitive):
    """DuckDB's engine has the language's semantics."""
    columns = [F.col("t").rlike(java_pattern(p, case_sensitive)).alias(f"c{k}") for k, p in enumerate(PATTERNS)]
    got = {r.i: r for r in texts.select("i", *columns).collect()}
    for k, p in enumerate(PATTERNS):
        want = [con.execute("select regexp_matches(?, ?)", [t, p if case_sensitive else f"(?i){p}"]).fetchone()[0] for t in TEXTS]
        assert [got[i][f"c{k}"] for i in range(len(TEXTS))] == want, p


def test_others_are_invalid(spark, con):
    for p in INVALID:
        assert java_pattern(p) is None, p
        with pytest.raises(duckdb.Error):
            con.execute("select regexp_matches('a', ?)", [p]).fetchone()


def test_atoms():
    assert atoms(r"test.*\.py") == ["test", ".py"] and atoms("abcd?ef+ghi") == ["abc", "ghi"] and atoms("abc|def") == []
    assert atoms("(abc)+def[xyz]ghi{2}jkl") == ["def", "jkl"] and atoms("ab") == [] and atoms("(") == [] and atoms("ABCdef") == ["abcdef"]


def test_atoms_are_in_every_match():
    rng = random.Random(1)
    for _ in range(3000):
        p = "".join(rng.choice(["a", "b", "c", "abc", ".", "?", "*", "+", "(", ")", "[ab]", r"\.", "{2}", "$"]) for _ in range(rng.randint(3, 9)))
        found = atoms(p)
        if found:
            text = "".join(rng.choice("abc.") for _ in range(40))
            try:
                m = re.search(p.replace("$", r"\Z"), text, re.IGNORECASE)
            except re.error:
                continue  # that engine doesn't repeat the end of a text
            assert m is None or all(a in m[0].lower() for a in found), (p, m)


def test_names_of_groups_of_either_form(texts):
    assert texts.filter(F.col("t").rlike(java_pattern("(?<y_1>a)b"))).count() == texts.filter(F.col("t").rlike(java_pattern("(?P<y_1>a)b"))).count() > 0
