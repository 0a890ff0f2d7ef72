"""Ignore rules over paths: each ancestor judged by its last matching pattern, an ignored one final."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    dirs_only: bool


def parse_rules(text: str) -> list[Rule]:
    """The rules of an ignore file: ``#`` comments, ``!`` re-includes, a last ``/`` means directories only.

    A pattern with another slash is anchored at the root. ``**`` is any number of segments, at least
    one at the end; ``*`` and ``?`` stay within a segment.
    """
    out = []
    for raw in text.removeprefix("﻿").split("\n"):
        line = raw.removesuffix("\r").rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line.removeprefix("!")
        dirs_only = line.endswith("/")
        line = line.removesuffix("/")
        parts = [s for s in line.split("/") if s]
        if not parts:
            continue
        if "/" not in line:
            parts.insert(0, "**")
        regex = ""
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part == "**":
                regex += "[^/]+(?:/[^/]+)*" if last else "(?:[^/]+/)*"
            else:
                regex += re.sub(r"\\\*|\\\?", lambda m: "[^/]*" if m[0] == r"\*" else "[^/]", re.escape(part)) + ("" if last else "/")
        out.append(Rule(rf"\A{regex}\z", negated, dirs_only))
    return out


def _ignored_here(path: Column, is_file: Column, rules: list[Rule]) -> Column:
    """Whether the last matching rule ignores ``path``; a chain of conditions, last rule first."""
    verdict = F.lit(False)
    for rule in rules:
        hit = path.rlike(rule.regex)
        verdict = F.when(hit & ~is_file if rule.dirs_only else hit, F.lit(not rule.negated)).otherwise(verdict)
    return verdict


def is_ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether ``path`` or one of the directories above it is ignored; a re-included file in an ignored directory stays out."""
    if not rules:
        return F.lit(False)
    clean = F.array_join(F.filter(X.segments(path), lambda s: s != ""), "/")
    return F.exists(X.ancestors(clean, root=False), lambda p: _ignored_here(p, p == clean, rules))


def drop_ignored(files: DataFrame, rules: list[Rule], *, path: str = "path") -> DataFrame:
    """Files that no rule ignores. Directories are judged once each, then files alone."""
    if not rules:
        return files
    placed = files.withColumn("__dir", X.parent_dir(F.col(path)))
    dirs = placed.select("__dir").distinct().filter(F.col("__dir") != "")
    out = dirs.filter(F.exists(X.ancestors(F.col("__dir"), root=False), lambda p: _ignored_here(p, F.lit(False), rules)))
    return placed.join(out, "__dir", "left_anti").filter(~_ignored_here(F.col(path), F.lit(True), rules)).drop("__dir")
