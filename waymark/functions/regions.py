"""Named definitions of source files: where they begin and end, and what they are called.

Built on the lexers: comments are blank and strings masked, so what looks like a definition in
either is none.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

from .lexing import bare_code, fence_closes, fence_open

# The words that begin a named definition, by language.
_BEGIN = {
    "python": re.compile(r"(?m)^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+(?P<a>\w+)"),
    "rust": re.compile(r"(?<![\w'])(?:const|enum|fn|macro_rules\s*!|mod|static|struct|trait|type|union)\s+(?:mut\s+)?(?!(?:fn|unsafe|async|extern|_)\b)(?P<a>\w+)"),
    "script": re.compile(
        r"(?<![\w$.])(?:class|enum|function\b\s*\*?|interface|type(?=\s+[\w$]+\s*[=<]))\s*(?<=[\s*])(?P<a>[\w$]+)"
        r"|(?m:^)[ \t]*(?:(?:public|private|protected|static|async|get|set|override)\s+)*\*?(?!(?:if|for|while|switch|catch|with|function|return|do)\b)(?P<b>#?[\w$]+)\s*\([^(){}]*\)\s*(?::[^{};=]+)?(?=\{)"
    ),
    "elixir": re.compile(r"(?m)(?<![\w.:@])(?:def|defp|defmacro|defmacrop|defguard|defdelegate|defmodule|defprotocol|defimpl)[ \t(]+(?P<a>[\w.]+[?!]?)"),
}
#: Lines that stand between a comment and the definition it belongs to.
_ATTACHED = re.compile(r"\s*(?:$|#!?\[|@(?:doc|moduledoc|typedoc|spec|impl|deprecated|since)\b|@\w[\w.]*(?:\(.*\))?\s*$)")


@dataclass(frozen=True)
class Region:
    """Lines from 1, both ends included; ``attached`` is the first line of the comments and attributes right above."""

    name: str
    line: int
    end: int
    attached: int
    begin: int
    stop: int


def _braced(code: str, at: int) -> int:
    """Past the block or the semicolon that ends a definition whose head ends at ``at``."""
    depth = 0
    for m in re.compile(r"[{}();\[\]]").finditer(code, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return m.start()
            if depth == 0 and c == "}":
                return m.end()
        elif depth == 0:
            return m.end()
    return len(code)


def _indented(code: str, start: int, at: int) -> int:
    """Past the last line that is indented deeper than the one at ``start``."""
    line = code.rfind("\n", 0, start) + 1
    own = len(code[line:]) - len(code[line:].lstrip(" \t"))
    end = code.find("\n", at)
    stop = end if end >= 0 else len(code)
    depth = 0
    for m in re.compile(r"[^\n]*\n?").finditer(code, line):
        text = m[0]
        if not text:
            break
        if depth <= 0 and m.start() > start and text.strip() and len(text) - len(text.lstrip(" \t")) <= own and not text.lstrip().startswith((")", "]", "}")):
            break
        depth += sum(map(text.count, "([{")) - sum(map(text.count, ")]}"))
        if text.strip():
            stop = m.start() + len(text.rstrip())
    return stop


def _to_end(code: str, at: int) -> int:
    """Past the ``end`` of a ``do`` block, or past the line of a ``do:`` definition."""
    line = code.find("\n", at)
    line = len(code) if line < 0 else line
    head = code[at:line]
    if re.search(r"\bdo:", head) or not re.search(r"\bdo\b", head):
        return line
    depth = 0
    for m in re.compile(r"(?<![\w:.])(?:(do|fn)|(end))\b(?!:)").finditer(code, at):
        depth += 1 if m[1] else -1
        if depth == 0:
            return m.end()
    return len(code)


def _arity(code: str, at: int) -> int:
    """How many arguments stand in the parentheses that open at ``at``: commas at their own level, and one."""
    if code[at : at + 1] != "(":
        return 0
    depth, commas, filled = 0, 0, False
    for m in re.compile(r"[(\[{]|[)\]}]|,|<<|>>|[^\s,]").finditer(code, at):
        if m[0] in ("(", "[", "{", "<<"):
            depth += 1
            filled |= depth > 1
        elif m[0] in (")", "]", "}", ">>"):
            depth -= 1
            if not depth:
                break
        elif m[0] == ",":
            commas += depth == 1
        else:
            filled = True
    return commas + 1 if filled else 0


def regions(text: str, language: str) -> list[Region]:
    """The named definitions of a text, in source order; inner ones follow outer ones."""
    code, _ = bare_code(text, language)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect.bisect_right(starts, at)
    raw, bare = text.split("\n"), code.split("\n")
    out = []
    for m in _BEGIN[language].finditer(code):
        group = "a" if m["a"] else "b"
        begin, name = m.start(), m[group]
        begin += len(m[0]) - len(m[0].lstrip())
        if language == "python":
            stop = _indented(code, begin, m.end())
        elif language == "elixir":
            stop = _to_end(code, m.end())
            if not name[0].isupper():
                name = f"{name}/{_arity(code, m.end())}"
        else:
            stop = _braced(code, m.end())
        line = line_of(begin)
        top = line
        while top > 1 and not bare[top - 2].strip() and raw[top - 2].strip() or top > 1 and bare[top - 2].strip() and _ATTACHED.match(bare[top - 2]):
            top -= 1
        out.append(Region(name, line, line_of(max(begin, stop - 1)), top, begin, stop))
    return out


def bound_region(found: list[Region], line: int) -> Region | None:
    """What a comment at ``line`` speaks of: the definition right below it, else the innermost one around it."""
    below = [r for r in found if r.attached <= line < r.line]
    if below:
        return min(below, key=lambda r: r.line)
    around = [r for r in found if r.line <= line <= r.end]
    return max(around, key=lambda r: (r.line, -r.end)) if around else None


_HEADING = re.compile(r"[ \t]*(#{1,6})(?:[ \t]+(.*)|)\Z")


def headings(text: str) -> list[tuple[int, int, str]]:
    """``(line, level, text)`` of each ATX heading outside fenced code; closing marks are dropped."""
    out, fence = [], None
    for number, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        if fence:
            if fence_closes(line, *fence):
                fence = None
            continue
        if opened := fence_open(line):
            fence = opened[:2]
            continue
        if m := _HEADING.match(line):
            out.append((number, len(m[1]), (m[2] or "").strip().rstrip("#").rstrip()))
    return out


def segments(text: str, fence: str, marker: str = "@graph") -> list[tuple[str, str]]:
    """A node file as ``(descriptor, text)`` parts in order: authored block, generated regions, and the prose between.

    A generated region is from an HTML comment that begins with ``marker`` to one with ``@end``; prose
    is named by its first heading, and blank prose is none.
    """
    lines, out, prose, k = text.split("\n"), [], [], 0
    if lines and not lines[-1]:
        lines.pop()

    def close() -> None:
        joined = "".join(x + "\n" for x in prose)
        if joined.strip():
            first = next((x.strip() for x in prose if x.lstrip().startswith("#")), None)
            out.append((f'unmanaged prose block "{first}"' if first else "unmanaged prose block (untitled)", joined))
        prose.clear()

    while k < len(lines):
        opened = fence_open(lines[k])
        region = re.search(rf"<!--\s*{re.escape(marker)}(?![\w-])\s*([\w-]+)?", lines[k])
        if opened and opened[2] == fence:
            end = next((j for j in range(k + 1, len(lines)) if fence_closes(lines[j], *opened[:2])), len(lines) - 1)
            name = "authored block"
        elif region:
            end = next((j for j in range(k, len(lines)) if re.search(r"<!--\s*@end\s*-->", lines[j])), len(lines) - 1)
            name = f"generated {region[1] or 'router'} region"
        else:
            prose.append(lines[k])
            k += 1
            continue
        close()
        out.append((name, "".join(x + "\n" for x in lines[k : end + 1])))
        k = end + 1
    close()
    return out


# -- commands as text -----------------------------------------------------------------------------

_WORD = re.compile(r"""(?:[^\s'"\\;&|]|&(?!&)|\\.|'[^']*'?|"(?:\\.|[^"\\])*"?)+|\\\Z""", re.S)
_OPERATOR = re.compile(r"&&|\|\|?|;")
_ASSIGNMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")


def _plain(word: str) -> str:
    """A word without its quotes and escapes."""

    def one(m: re.Match) -> str:
        s = m[0]
        if s[0] == "'":
            return s[1:].removesuffix("'")
        if s[0] == '"':
            return re.sub(r"\\(.)", r"\1", s[1:-1] if len(s) > 1 and s.endswith('"') else s[1:], flags=re.S)
        return s[1:]

    return re.sub(r"""'[^']*'?|"(?:\\.|[^"\\])*"?|\\.""", one, word, flags=re.S)


def command_words(command: str) -> Iterator[list[str]]:
    """The words of each part of a command line between ``&&``, ``||``, ``|`` and ``;``, leading assignments left out."""
    words: list[str] = []
    at = 0
    while at <= len(command):
        if at == len(command) or (m := _OPERATOR.match(command, at)):
            while words and _ASSIGNMENT.match(words[0]):
                words.pop(0)
            if words:
                yield words
            words = []
            at = m.end() if at < len(command) else at + 1
        elif m := _WORD.match(command, at):
            words.append(_plain(m[0]))
            at = m.end()
        else:
            at += 1


def manifest_tasks(path: str, text: str) -> tuple[str, list[str]] | None:
    """The runner that a root manifest serves, and the names of its tasks; None for other files."""
    import json
    import tomllib

    if path == "mix.exs":
        block = text.split("aliases do", 1)
        lines = [x.strip() for x in block[1].split("\n")[1:]] if len(block) > 1 else []
        body = lines[: lines.index("end")] if "end" in lines else lines
        found = [re.match(r'"([^"]*)"\s*:|([\w.]+):', x) for x in body]
        return "mix", [m[1] or m[2] for m in found if m]
    if path == "package.json":
        try:
            scripts = json.loads(text).get("scripts")
        except (ValueError, AttributeError):
            scripts = None
        return "npm", list(scripts) if isinstance(scripts, dict) else []
    if path in (".cargo/config.toml", ".cargo/config"):
        try:
            alias = tomllib.loads(text).get("alias", {})
        except tomllib.TOMLDecodeError:
            alias = {}
        return "cargo", list(alias) if isinstance(alias, dict) else []
    if path in ("justfile", "Justfile"):
        heads = re.findall(r"(?m)^(?:alias[ \t]+([\w-]+)[ \t]*:=|@?([\w-]+)(?:[ \t][^:\n]*)?:(?!=))", text)
        return "just", [a or b for a, b in heads]
    return None
