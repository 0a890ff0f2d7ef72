"""Places in a text by byte offset: fenced code, HTML comments, the generated region, and what patterns match."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .lexing import fence_closes, fence_open

#: Fixed value: the line that ends a generated region.
END = "<!-- @end -->"


class Malformed(ValueError):
    pass


@dataclass(frozen=True)
class Generated:
    """The one generated region: its name, the byte offsets of what lies between the markers, and those lines (from 1)."""

    name: str
    start: int
    stop: int
    first: int
    last: int


def scan(text: str, marker: str = "@graph") -> tuple[list[tuple[str, int, int]], Generated | None]:
    """``(kind, start, stop)`` of each fence (``fence``) and HTML comment (``comment``) of a markdown text, and its generated region.

    Offsets count UTF-8 bytes. Markers within fences or comments, or indented by more than three columns,
    are none. A second region, a begin without an end and an end without a begin are malformed.
    """
    begins = re.compile(rf"<!-- {re.escape(marker)}(?![\w-])[ \t]*((?:\w+(?:-\w+)*)?)(?:(?!-->).)*-->")
    spans: list[tuple[str, int, int]] = []
    fence = comment = opened = region = None
    at, number = 0, 0
    for number, line in enumerate(text.splitlines(keepends=True) if "\x0b" not in text else re.findall(r"[^\n]*\n|[^\n]+", text), 1):
        start, at, bare = at, at + len(line.encode("utf-8", "surrogatepass")), line.rstrip("\r\n")
        if fence:
            if fence_closes(bare, *fence[:2]):
                spans.append(("fence", fence[2], at))
                fence = None
            continue
        if comment is not None:
            if "-->" in line:
                spans.append(("comment", comment, start + len(line[: line.index("-->") + 3].encode())))
                comment = None
            continue
        if found := fence_open(bare):
            fence = (*found[:2], start)
            continue
        lead, stripped = len(line) - len(line.lstrip(" \t")), line.strip()
        if lead <= 3 and (m := begins.match(stripped)):
            if opened or region:
                raise Malformed(f"line {number}: a second generated region")
            if stripped[m.end() :].strip() == END:
                inner = start + lead + len(m[0].encode())
                region = Generated(m[1] or "router", inner, inner, number, number)
            else:
                opened = (m[1] or "router", at, number + 1)
            continue
        if lead <= 3 and stripped == END:
            if not opened:
                raise Malformed(f"line {number}: an end without a begin")
            region, opened = Generated(opened[0], opened[1], start, opened[2], number - 1), None
            continue
        for m in re.finditer(r"<!--(.*?)(?:-->|\Z)", bare):
            begin = start + len(line[: m.start()].encode())
            if m[0].endswith("-->"):
                spans.append(("comment", begin, start + len(line[: m.end()].encode())))
            else:
                comment = begin
    if opened:
        raise Malformed(f"line {opened[2] - 1}: a generated region without an end")
    if fence:
        spans.append(("fence", fence[2], at))
    if comment is not None:
        spans.append(("comment", comment, at))
    return spans, region


def splice(content: bytes, body: str, marker: str = "@graph") -> bytes | None:
    """The file with ``body`` as its generated region and every other byte as it was; None without a region.

    A body ends in a line break, unless it is empty. Doing it again changes nothing.
    """
    region = scan(content.decode("utf-8"), marker)[1]
    if region is None:
        return None
    body = body + "\n" if body and not body.endswith("\n") else body
    head = content[: region.start]
    lead = b"\n" if body and not head.endswith(b"\n") else b""
    return head + lead + body.encode("utf-8") + content[region.stop :]
