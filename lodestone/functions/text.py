"""Column functions on names, paths and texts."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Initials of words whose characters have several readings.
INITIALS_OF_WORDS = {
    "重庆": "cq", "长城": "cc", "长江": "cj", "长期": "cq", "长征": "cz", "长度": "cd", "重复": "cf", "重新": "cx", "重阳": "cy",
    "音乐": "yy", "乐曲": "yq", "乐器": "yq", "乐队": "yd", "银行": "yh", "行业": "hy", "行长": "hz", "调整": "tz", "调节": "tj",
    "空调": "kt", "调查": "dc", "睡觉": "sj", "校对": "jd", "便宜": "py", "西藏": "xz", "藏族": "zz", "宝藏": "bz", "处理": "cl",
    "了解": "lj", "归还": "gh", "曾经": "cj",
}

#: First characters, in GB 2312's order of pronunciation, of each initial's range.
_RANGES = [("a", "啊"), ("b", "芭"), ("c", "擦"), ("d", "搭"), ("e", "蛾"), ("f", "发"), ("g", "噶"), ("h", "哈"), ("j", "击"), ("k", "喀"), ("l", "垃"), ("m", "妈"),
           ("n", "拿"), ("o", "哦"), ("p", "啪"), ("q", "期"), ("r", "然"), ("s", "撒"), ("t", "塌"), ("w", "挖"), ("x", "昔"), ("y", "压"), ("z", "匝")]
_IDEOGRAPH = (("㐀", "䶿"), ("一", "鿿"), ("豈", "﫿"))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(name.contains("."), F.substring_index(F.lower(name), ".", -1)).otherwise(F.lit(""))


def full_path(path: Column, name: Column) -> Column:
    return F.concat(path, F.when((path == "") | path.endswith("/"), F.lit("")).otherwise(F.lit("/")), name)


def depth(path: Column) -> Column:
    """Slashes of the parent path."""
    return (F.octet_length(path) - F.octet_length(F.replace(path, F.lit("/"), F.lit("")))).cast("long")


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters, in lower case; none of shorter texts."""

    def of(chars: Column) -> Column:
        at = F.when(F.size(chars) >= 3, F.sequence(F.lit(0), F.size(chars) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))

    # the outer array binds the characters, so that they are split once and the work is linear in the text
    return F.array_distinct(F.flatten(F.transform(F.array(F.split(F.lower(text), "")), of)))


def ideograph_pairs(text: Column) -> Column:
    """Distinct pairs of neighbouring ideographs."""
    size = F.length(text)
    at = F.when(size >= 2, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
    pair = "^[" + "".join(f"{a}-{b}" for a, b in _IDEOGRAPH) + "]{2}$"
    return F.array_distinct(F.filter(F.transform(at, lambda i: F.substring(text, i, F.lit(2))), lambda x: x.rlike(pair)))


def name_priority(name: Column, key: str) -> Column:
    """0 if the name is the key, 1 if it begins so, else 2."""
    return F.when(name == key, 0).when(name.startswith(key), 1).otherwise(2)


def url_decoded(text: Column) -> Column:
    """Percent escapes and ``+`` decoded; null where an escape is broken."""
    return F.try_url_decode(text)


def _initial(c: str) -> str:
    try:
        code = c.encode("gb2312")
    except UnicodeEncodeError:
        return c
    if not b"\xb0\xa1" <= code <= b"\xd7\xf9":
        return c  # beyond the part that is ordered by pronunciation
    return [k for k, first in _RANGES if first.encode("gb2312") <= code][-1]


def initials_with_places(name: str) -> tuple[str, list[int]]:
    """A search key of Mandarin initials, empty without an ideograph, and the place in the name of each of its characters."""
    clusters: list[tuple[int, str]] = []  # marks go with the character before them
    for i, c in enumerate(name):
        clusters[-1:] = [(clusters[-1][0], clusters[-1][1] + c)] if clusters and unicodedata.combining(c) else [*clusters[-1:], (i, c)]
    folded = [(c, i) for i, cluster in clusters for c in unicodedata.normalize("NFKC", cluster)]
    text = "".join(c for c, _ in folded)
    ideographs = [any(a <= c <= b for a, b in _IDEOGRAPH) for c in text]
    if not any(ideographs):
        return "", []
    out, places, i = [], [], 0
    while i < len(text):
        word = next((w for w in sorted(INITIALS_OF_WORDS, key=lambda w: (-len(w), w)) if text.startswith(w, i)), None)
        key = INITIALS_OF_WORDS[word] if word else _initial(text[i]) if ideographs[i] else text[i].lower() if text[i].isascii() and text[i].isalnum() else ""
        out.append(key)
        places += [folded[i + k][1] for k in range(len(key))]
        i += len(word) if word else 1
    return "".join(out), places


def initials_of(name: str) -> str:
    """The key alone."""
    return initials_with_places(name)[0]


def initials(name: Column) -> Column:
    @F.pandas_udf("string")
    def of(names: pd.Series) -> pd.Series:
        return names.map(initials_of, na_action="ignore")

    # names of ASCII only, which are most, don't reach Python
    return F.when(name.rlike(r"[^\x00-\x7F]"), of(name)).otherwise(F.lit(""))


def composed(text: Column, form: str = "NFC") -> Column:
    """Text in a Unicode normal form."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return F.when(text.rlike(r"[^\x00-\x7F]"), of(text)).otherwise(text)


def other_form(query: str) -> str | None:
    """The query in the normal form that it isn't in, if there is one."""
    return next((x for x in (unicodedata.normalize(f, query) for f in ("NFC", "NFD")) if x != query), None)


def within(path: Column, prefix: str) -> Column:
    """Is the path the prefix or below it? Ignores case."""
    prefix = prefix.lower().rstrip("/")
    low = F.lower(path)
    return (low == prefix) | low.startswith(prefix + "/") if prefix else F.lit(True)


def stored_within(prefix: str) -> Column:
    """The same over a catalog's stored columns path_lc and name_lc, by conditions that reach the Parquet reader."""
    prefix = prefix.lower().rstrip("/")
    if not prefix:
        return F.lit(True)
    parent, _, name = prefix.rpartition("/")
    own = F.col("path_lc").isin([x for x in (parent, parent + "/") if x or not prefix.startswith("/")])
    return (F.col("path_lc") == prefix) | F.col("path_lc").startswith(prefix + "/") | (own & (F.col("name_lc") == name))


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))
