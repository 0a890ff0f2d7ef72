"""Digests of code by its nesting: a tree of brackets, indented blocks and definitions, hashed bottom up.

A node's hash covers its kind, its tokens and its children's hashes in order, so a statement that
leaves a block changes the hash even if every token stays. Comments and layout are no part of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from .lexing import LANGUAGES, parts
from .regions import Region, bound_region, regions

_CLOSING = {")": "(", "]": "[", "}": "{"}
_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Where indentation nests: line breaks with the white space after them, and joined lines, are read, too.
_LINED = re.compile(r"\\\r?\n|\n[ \t\f\r]*|\w+|[^\w\s]")


class _Node:
    __slots__ = ("indent", "kind", "region", "sum")

    def __init__(self, kind: str, region: int | None = None, indent: int | None = None) -> None:
        self.kind, self.region, self.indent, self.sum = kind, region, indent, hashlib.sha256(kind.encode())

    def leaf(self, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        self.sum.update(b"t%d:" % len(raw) + raw)

    def child(self, node: _Node) -> None:
        self.sum.update(b"n" + node.sum.digest())


def _pieces(text: str, language: str) -> Iterator[tuple[str, int]]:
    """Tokens, strings as a whole and (for Python) line breaks, with their places; comments left out."""
    pattern, at = _LINED if language == "python" else _TOKEN, 0
    for kind, start, end in parts(text, language):
        for m in pattern.finditer(text, at, max(at, start)):
            yield m[0], m.start()
        if kind == "s":
            yield text[start:end], start
        at = max(at, end)
    for m in pattern.finditer(text, at):
        yield m[0], m.start()


def tree_digests(text: str, language: str, found: list[Region]) -> tuple[str, list[str]]:
    """The digest of the whole text, and one for each of its ``found`` regions, from one walk without recursion."""
    digests, stack = [hashlib.sha256(b"nothing").hexdigest()] * len(found), [_Node("file", indent=0)]
    opening = sorted(range(len(found)), key=lambda k: (found[k].begin, -found[k].stop), reverse=True)
    brackets, opened, line = dict.fromkeys("([{", 0), [], 0 if language == "python" else None

    def close() -> None:
        node = stack.pop()
        if node.kind in brackets:
            brackets[node.kind] -= 1
        if node.region is not None:
            digests[node.region] = node.sum.hexdigest()
            opened.remove(node.region)
        stack[-1].child(node)

    def until(wanted) -> None:
        while not wanted(stack[-1]):
            close()
        close()

    for piece, at in _pieces(text, language):
        while (ended := next((r for r in opened if found[r].stop <= at), None)) is not None:
            until(lambda n, last=ended: n.region == last)
        if language == "python":
            if piece[0] == "\\" and piece != "\\":
                continue
            if piece[0] == "\n":
                line = len(piece[1:].replace("\r", "").replace("\f", "").expandtabs(8)) if not any(brackets.values()) else None
                continue
            if line is not None:
                while line < next(n.indent for n in reversed(stack) if n.indent is not None) and len(stack) > 1:
                    until(lambda n: n.indent is not None)
                if line > next(n.indent for n in reversed(stack) if n.indent is not None):
                    stack.append(_Node("block", indent=line))
                stack[-1].sum.update(b"line")
                line = None
        while opening and found[opening[-1]].begin <= at:
            if found[opening[-1]].stop > at:
                stack.append(_Node("definition", region=opening[-1]))
                opened.append(opening[-1])
            opening.pop()
        if piece in ("(", "[", "{"):
            stack.append(_Node(piece))
            brackets[piece] += 1
        elif brackets.get(_CLOSING.get(piece)):
            until(lambda n, kind=_CLOSING[piece]: n.kind == kind)
        else:
            stack[-1].leaf(piece)
    while len(stack) > 1:
        close()
    return stack[0].sum.hexdigest(), digests


def file_digests(text: str, path: str, landmark: str) -> list[tuple[str, str, int, str, str]] | None:
    """All that an anchor can be bound to in one version of a file: ``(kind, name, line, region, digest)``.

    ``file`` stands for the whole text, ``symbol`` for the first definition of a name, ``mark`` for a line
    that holds a landmark: the definition right below it, else the innermost around it, else the file.
    None where the language has no lexer. The text is parsed once.
    """
    language = LANGUAGES.get(path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower())
    if language is None:
        return None
    found, base = regions(text, language), path.rsplit("/", 1)[-1]
    whole, digests = tree_digests(text, language, found)
    out, of = [("file", "", 0, base, whole)], dict(zip(map(id, found), digests, strict=True))
    seen = set()
    for region, digest in zip(found, digests, strict=True):
        if region.name not in seen:
            seen.add(region.name)
            out.append(("symbol", region.name, region.line, region.name, digest))
    mark = re.compile(re.escape(landmark) + r"(\S+)")
    for number, content in enumerate(text.split("\n"), 1) if landmark in text else ():
        for m in mark.finditer(content):
            bound = bound_region(found, number)
            out.append(("mark", m[1], number, bound.name if bound else base, of[id(bound)] if bound else whole))
    return out
