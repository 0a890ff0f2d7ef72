"""Small lexers for tasks: comments of source files and markdown, and the names that files import.

They know strings and comments, not grammars: enough to tell a token in a comment from one in a
string, and an import from a mention of one. All walk forward once, without recursion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: The languages read, by extension.
LANGUAGES = {
    **dict.fromkeys(("cjs", "cts", "js", "jsx", "mjs", "mts", "ts", "tsx"), "script"),
    **dict.fromkeys(("ex", "exs"), "elixir"), "py": "python", "rs": "rust",
}

_HASH = r'(?P<s>"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)|(?P<c>\#[^\n]*)'
_PARTS = {
    "python": re.compile(_HASH, re.S),
    "elixir": re.compile(r"\?\\?[\"'#]|" + _HASH, re.S),
    "script": re.compile(r'(?P<s>"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|`(?:\\.|[^`\\])*`?)|(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))', re.S),
    "rust": re.compile(r'(?P<s>r(?P<h>\#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"?|\'(?:\\.[^\']*|[^\'\\\n])\')|(?P<c>//[^\n]*|/\*)', re.S),
}
_NEST = re.compile(r"/\*|\*/")


def parts(text: str, language: str) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of strings (``s``) and comments (``c``), in order."""
    at, pattern = 0, _PARTS[language]
    while m := pattern.search(text, at):
        at = m.end()
        if m["c"] == "/*":
            depth = 1
            while depth and (n := _NEST.search(text, at)):
                depth += 1 if n[0] == "/*" else -1
                at = n.end()
            at = at if not depth else len(text)
        if m["s"] or m["c"]:
            yield ("s" if m["s"] else "c"), m.start(), at


def comments(text: str, language: str) -> list[tuple[int, str]]:
    """``(line, text)`` of each line of each comment."""
    out, line, at = [], 1, 0
    for kind, start, end in parts(text, language):
        if kind == "c":
            line, at = line + text.count("\n", at, start), start
            out += [(line + k, piece.removesuffix("\r")) for k, piece in enumerate(text[start:end].split("\n"))]
    return out


def bare_code(text: str, language: str) -> tuple[str, dict[int, str]]:
    """The text with comments blank and strings' insides masked (same places), and strings by start."""
    out, strings, at = [], {}, 0
    for kind, start, end in parts(text, language):
        out.append(text[at:start])
        piece = text[start:end]
        if kind == "s":
            strings[start] = piece[1:-1]
            out.append(piece[0] + re.sub(r"[^\n]", "\0", piece[1:-1]) + piece[-1] if len(piece) > 1 else piece)
        else:
            out.append(re.sub(r"[^\n]", " ", piece))
        at = end
    return "".join([*out, text[at:]]), strings


_FENCE = re.compile(r"﻿? {0,3}(`{3,}|~{3,})(.*)\Z")


def fence_open(line: str) -> tuple[str, int, str] | None:
    """Fence character, length and first info word of a line that opens a fenced block."""
    m = _FENCE.match(line)
    if not m or (m[1][0] == "`" and "`" in m[2]):
        return None
    return m[1][0], len(m[1]), (m[2].split() or [""])[0]


def fence_closes(line: str, char: str, length: int) -> bool:
    m = _FENCE.match(line.removeprefix("﻿"))
    return bool(m and m[1][0] == char and len(m[1]) >= length and not m[2].strip())


def markdown_comments(text: str) -> list[tuple[int, str]]:
    """``(line, text)`` of what lies within HTML comments, outside fenced code and code spans."""
    out, fence, inside = [], None, False
    for number, line in enumerate(text.split("\n"), 1):
        if fence:
            if fence_closes(line, *fence):
                fence = None
            continue
        if not inside and (opened := fence_open(line)):
            fence = opened[:2]
            continue
        at = 0
        while at <= len(line):
            if inside:
                end = line.find("-->", at)
                out.append((number, line[at : end if end >= 0 else len(line)]))
                if end < 0:
                    break
                at, inside = end + 3, False
                continue
            m = re.compile(r"<!--|(?<!\\)(?:\\\\)*(`+)").search(line, at)
            if not m:
                break
            if m[0] == "<!--":
                at, inside = m.end(), True
            else:
                close = re.compile(rf"(?<!`){m[1]}(?!`)").search(line, m.end())
                at = close.end() if close else m.end()
    return out


def fenced_blocks(text: str) -> list[tuple[str, int, str]]:
    """``(info, line, body)`` of each fenced block; one within an HTML comment block is none."""
    out, lines, k = [], text.split("\n"), 0
    while k < len(lines):
        if re.match(r" {0,3}<!--", lines[k]):
            start = lines[k].index("<!--") + 4
            if "-->" not in lines[k][start:]:
                k += 1
                while k < len(lines) and "-->" not in lines[k]:
                    k += 1
            k += 1
            continue
        opened = fence_open(lines[k])
        if not opened:
            k += 1
            continue
        first, body = k, []
        k += 1
        while k < len(lines) and not fence_closes(lines[k], *opened[:2]):
            body.append(lines[k].removesuffix("\r") + "\n")
            k += 1
        out.append((opened[2], first + 1, "".join(body)))
        k += 1
    return out


def _script_names(code: str, strings: dict[int, str]) -> Iterator[tuple[int, str]]:
    for m in re.finditer(r"""(?<![\w$.])(?:import|export)\b[^;"'`()]*?(?P<a>["'])|(?<![\w$.])(?:require|import)\s*\(\s*(?P<b>["'])""", code):
        start = m.start("a") if m["a"] else m.start("b")
        if start in strings and (m["b"] or re.search(r"\bfrom\s*\Z|\A(?:import)\s*\Z", code[m.start() : start])):
            yield start, strings[start]


def _rust_names(code: str, strings: dict[int, str]) -> Iterator[tuple[int, str]]:
    for m in re.finditer(r"(?<![\w#])(?:use\s+([^;]+);|extern\s+crate\s+(\w+))", code):
        for item in [m[2]] if m[2] else re.sub(r"\A\s*(?:::)?\s*\{(.*)\}\s*\Z", r"\1", re.sub(r"\{[^{}]*\}(?=[^{}]*\})", "", m[1]), flags=re.S).split(","):
            head = re.split(r"[:{\s]", item.strip().lstrip(":"), maxsplit=1)[0]
            if head and re.fullmatch(r"\w+", head) and head not in ("crate", "self", "super"):
                yield m.start(), head


def _python_names(code: str, strings: dict[int, str]) -> Iterator[tuple[int, str]]:
    for m in re.finditer(r"(?m)^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import\b|import[ \t]+((?:[^\n\\]|\\\n)+))|;[ \t]*import[ \t]+([^\n;]+)", code):
        if m[1]:
            if not m[1].startswith("."):
                yield m.start(1), m[1]
        else:
            for item in re.split(r"[,;]", m[2] or m[3]):
                name = (item.replace("\\\n", " ").split() or [""])[0]
                if re.fullmatch(r"\w+(\.\w+)*", name):
                    yield m.start(2 if m[2] else 3), name


_MODULE = r"[A-Z]\w*(?:\.[A-Z]\w*)*"


def _elixir_names(code: str, strings: dict[int, str]) -> Iterator[tuple[int, str]]:
    for m in re.finditer(rf"(?<![\w.:@])({_MODULE})(?:\.\{{([^}}]*)\}})?", code):
        if m[2] is None:
            yield m.start(), m[1]
        else:
            for name in re.finditer(_MODULE, m[2]):
                yield m.start(2) + name.start(), f"{m[1]}.{name[0]}"


_NAMES = {"script": _script_names, "rust": _rust_names, "python": _python_names, "elixir": _elixir_names}


def imported(text: str, language: str) -> list[tuple[str, int, str]]:
    """``(name, line, trimmed source line)`` of each import."""
    code, strings = bare_code(text, language)
    lines = text.split("\n")
    out = []
    for at, name in _NAMES[language](code, strings):
        line = code.count("\n", 0, at) + 1
        out.append((name, line, lines[line - 1].strip()))
    return out


def declared_modules(text: str) -> list[str]:
    """Full names of an Elixir file's modules; nested ones carry the outer name, quoted ones none."""
    code, _ = bare_code(text, "elixir")
    out, scope, depth = [], [], 0
    for m in re.finditer(rf"\bdefmodule\s+({_MODULE})(?![\w.])|\b(defmodule|quote)\b|\b(do|fn)\b(?!:)|\b(end)\b(?!:)", code):
        if m[1]:
            known = all(s is not None for _, s in scope)
            if known:
                out.append(".".join([*(s for _, s in scope), m[1]]))
            scope.append((depth + 1, m[1] if known else None))
        elif m[2]:
            scope.append((depth + 1, None))
        elif m[3]:
            depth += 1
        elif m[4]:
            depth -= 1
            while scope and scope[-1][0] > depth:
                scope.pop()
    return out
