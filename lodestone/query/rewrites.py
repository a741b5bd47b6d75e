"""Rewrites of a tree that change what terms mean: paths, globs, aliases, home."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from lodestone.query.dates import Clock
from lodestone.query.filters import DIRECTORY
from lodestone.query.grammar import parse
from lodestone.query.nodes import GLOB, SUBSTRING, And, Node, Segments, Term, TypeIs, rewrite

PLAIN, SEGMENTS, DIR_EXACT, DIR_LIST = "plain", "segments", "dir_exact", "dir_list"

#: applications' names by their Chinese names.
ALIASES = {
    "终端": ["terminal"],
    "活动监视器": ["activity monitor"],
    "磁盘工具": ["disk utility"],
    "系统设置": ["system settings", "system preferences"],
    "系统偏好设置": ["system preferences", "system settings"],
    "访达": ["finder"],
    "文本编辑": ["textedit"],
    "预览": ["preview"],
    "计算器": ["calculator"],
    "日历": ["calendar"],
    "通讯录": ["contacts"],
    "邮件": ["mail"],
    "信息": ["messages"],
    "照片": ["photos"],
    "音乐": ["music"],
    "地图": ["maps"],
    "备忘录": ["notes"],
    "提醒事项": ["reminders"],
    "图书": ["books"],
    "播客": ["podcasts"],
    "语音备忘录": ["voice memos"],
    "快捷指令": ["shortcuts"],
    "自动操作": ["automator"],
    "脚本编辑器": ["script editor"],
    "控制台": ["console"],
    "钥匙串访问": ["keychain access"],
    "字体册": ["font book"],
    "屏幕共享": ["screen sharing"],
    "截屏": ["screenshot"],
    "数码测色计": ["digital color meter"],
    "迁移助理": ["migration assistant"],
    "时间机器": ["time machine"],
    "启动台": ["launchpad"],
    "国际象棋": ["chess"],
    "图像捕捉": ["image capture"],
    "快速播放器": ["quicktime player"],
    "应用商店": ["app store"],
}


@dataclass(frozen=True)
class PathQuery:
    """A text with slashes: how it is meant, what its parent must hold, and its last component."""

    mode: str
    parts: tuple[tuple[str, bool], ...] = ()
    name: str = ""


def path_query(text: str) -> PathQuery:
    """Read a text as a path. Wildcards make it a glob, but for ``*`` alone between components (a gap) or at the end."""
    lowered = text.lower()
    if "/" not in lowered:
        return PathQuery(PLAIN, name=lowered)
    body = "" if lowered == "/*" else lowered.removeprefix("/")
    inner = body[:-2] if body.endswith("/*") else body
    components = inner.removesuffix("/").split("/")
    if components[0] == "*" or any(c != "*" and re.search("[*?]", c) for c in components):
        return PathQuery(PLAIN, name=lowered)
    if lowered.endswith("/*"):
        mode, rest = DIR_LIST, lowered[:-2]
    elif lowered.endswith("/"):
        mode, rest = DIR_EXACT, lowered[:-1]
    else:
        mode, rest = SEGMENTS, lowered
    rest = rest.removeprefix("/")
    if not rest:
        return PathQuery(PLAIN)
    *parents, name = rest.split("/")
    if not parents and mode == DIR_EXACT:
        mode = SEGMENTS
    parts: list[tuple[str, bool]] = []
    for p in parents:
        if p == "*":
            parts[-1:] = [(t, False) for t, _ in parts[-1:]]
        elif p:
            parts.append((p, True))
    return PathQuery(mode, tuple(parts), name)


def slashes(node: Node) -> Node:
    """Terms with slashes as conditions on the parent's components and the name."""
    if not isinstance(node, Term) or node.mode != SUBSTRING or node.quoted or "/" not in node.text:
        return node
    found = path_query(node.text)
    if found.mode in (PLAIN, DIR_LIST) or not (found.parts or found.name):
        return node
    out: list[Node] = [Segments(found.parts)] if found.parts else []
    if found.name:
        own = node.text.removesuffix("/").removeprefix("/").rpartition("/")[2] if node.case_sensitive else found.name
        exact = found.mode == DIR_EXACT
        out.append(Term(own, case_sensitive=node.case_sensitive, name_only=True, anchor="exact" if exact else "substring"))
    if found.mode == DIR_EXACT:
        out.append(TypeIs(DIRECTORY))
    return out[0] if len(out) == 1 else And(tuple(out))


def globs(node: Node) -> Node:
    """Terms with wildcards as globs. They ignore case, whatever the term says."""
    if isinstance(node, Term) and node.mode == SUBSTRING and not node.quoted and re.search(r"[*?]", node.text):
        return replace(node, mode=GLOB)
    return node


def prepared(query: str, home: str | None = None) -> str:
    """The query without outer white space, with home for a leading ``~/`` and application aliases spelt out."""
    query = query.strip(" \t")
    if home and query.startswith("~/"):
        query = home.rstrip("/") + query[1:]
    if not re.search(r'[ \t|!<>"/\\:*?]', query) and (names := ALIASES.get(query.lower().removesuffix(".app"))):
        return "<" + "|".join(f'"{n}"' for n in [query, *names]) + ">"
    return query


def understand(query: str, clock: Clock | None = None, home: str | None = None) -> Node | None:
    """Parse and rewrite; None if the query is void."""
    tree = parse(prepared(query, home), clock)
    return tree and rewrite(rewrite(tree, slashes), globs)
