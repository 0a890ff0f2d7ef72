"""Scalar rules of the graph as Column expressions: ids, slugs, addresses, paths, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The system node's id, and the lexeme of a slug.
SYSTEM_ID = "/"
SLUG = r"\A[a-z0-9]+(-[a-z0-9]+)*\z"


def segments(path: Column) -> Column:
    return F.split(path, "/", -1)


def is_normalizable(raw: Column) -> Column:
    """No ``..`` segment, and not absolute (``/`` alone is the system node)."""
    slashed = F.replace(raw, F.lit("\\"), F.lit("/"))
    return ~F.array_contains(segments(slashed), "..") & ((slashed == "/") | ~slashed.startswith("/"))


def normalize_id(raw: Column) -> Column:
    """Slashes one way, no empty or ``.`` segments; nothing left is the system node; null where refused."""
    parts = F.filter(segments(F.replace(raw, F.lit("\\"), F.lit("/"))), lambda s: ~s.isin("", "."))
    return F.when(is_normalizable(raw), F.when(F.size(parts) == 0, F.lit(SYSTEM_ID)).otherwise(F.array_join(parts, "/")))


def node_id(raw: Column) -> Column:
    """A normalised id that can stand in a table cell: no bar, backtick, control or odd white space; else null."""
    return F.when(~raw.rlike(r"[|`\p{Cc}]|(?U)[\s&&[^ ]]"), normalize_id(raw))


def collapse_symbol(symbol: Column) -> Column:
    """ASCII letters and digits in lower case, every run of others one dash, none at the ends."""
    dashed = F.regexp_replace(symbol, "[^A-Za-z0-9]+", "-")
    lowered = F.translate(dashed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(lowered, r"\A-|-\z", "")


def derive_slug(anchor: Column, landmark: str) -> Column:
    """A claim's slug from its anchor: what follows the landmark token, or the symbol past the last ``#``."""
    named = F.when(anchor.startswith(landmark), F.substring(anchor, len(landmark) + 1, 1 << 30)).otherwise(collapse_symbol(F.substring_index(anchor, "#", -1)))
    return F.when(is_valid_slug(named), named)


def is_valid_slug(slug: Column) -> Column:
    return slug.rlike(SLUG)


def is_claim_address(address: Column) -> Column:
    """``<node id>/<slug>``: split at the last slash, a valid slug after it, a fit id before it."""
    node = F.regexp_extract(address, r"(?s)\A(.*)/[^/]*\z", 1)
    return address.contains("/") & (node != "") & is_valid_slug(F.substring_index(address, "/", -1)) & is_normalizable(node)


def decision_number(token: Column, prefix: str) -> Column:
    """The digits after ``prefix``, as text; null if the token has another form."""
    rest = F.substring(token, len(prefix) + 1, 1 << 30)
    return F.when(token.startswith(prefix) & rest.rlike(r"\A[0-9]+\z"), rest)


def parent_dir(path: Column) -> Column:
    """All but the last segment; empty for a root file."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """In lower case, without the dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"(?s).\.([^.]*)\z", 1))


def last_segment(id_: Column) -> Column:
    return F.when(id_ == SYSTEM_ID, F.lit(SYSTEM_ID)).otherwise(basename(id_))


def ancestors(dir_: Column, *, root: bool = True) -> Column:
    """The directory and all above it, deepest last; with the root (empty) first if wanted."""
    parts = segments(dir_)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.when(dir_ == "", F.array().cast("array<string>")).otherwise(above)
    return F.concat(F.array(F.lit("")), above) if root else above


def dir_contains(dir_: Column, path: Column) -> Column:
    """Whether ``path`` is the directory or lies within it, by whole segments."""
    return (dir_ == "") | (path == dir_) | path.startswith(F.concat(dir_, F.lit("/")))


def join_path(base: Column, relative: Column) -> Column:
    """``relative`` against ``base``; ``.`` and empty segments go, ``..`` takes one off (none above the root)."""
    parts = segments(F.concat_ws("/", base, relative))
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, s: F.when(s.isin("", "."), done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(walked, "/")


def heading_slug(text: Column) -> Column:
    """Letters and digits of any script in lower case; white space and dashes one dash; the rest dropped."""
    kept = F.regexp_replace(text, r"(?U)[^\p{Alnum}\s-]+", "")
    return F.lower(F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s-]+", "-"), r"\A-|-\z", ""))


def flat(text: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"\A | \z", "")


def cell(text: Column) -> Column:
    """``flat``, safe inside a table cell."""
    return F.replace(flat(text), F.lit("|"), F.lit("\\|"))


def status_word(text: Column) -> Column:
    """The first word of a status line in lower case; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(text, "[A-Za-z][A-Za-z-]*", 0)), F.lit(""))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def kib(n: Column) -> Column:
    """Bytes as KiB with one decimal, halves to the even one."""
    return F.format_string("%.1f KiB", F.bround(n / F.lit(1024.0), 1))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def short_digest(digest: Column) -> Column:
    return F.concat(F.substring(digest, 1, 4), F.lit("…"))


def relativize(file: Column, dir_: Column) -> Column:
    """A path below a directory without it; another path as it is."""
    return F.when((dir_ != "") & file.startswith(F.concat(dir_, F.lit("/"))), F.substring(file, F.length(dir_) + 2, F.length(file))).otherwise(file)


def rule_slug(id_: Column) -> Column:
    """A node id as the stem of a file name."""
    return F.when(id_ == SYSTEM_ID, F.lit("root")).otherwise(F.replace(id_, F.lit("/"), F.lit("-")))


def glob_regex(glob: str, *, across: bool) -> str:
    """A whole-string pattern for ``*`` and ``?``; ``across`` lets them match a slash."""
    import re

    one = "(?s:.)" if across else "[^/]"
    return r"\A" + "".join(f"{one}*" if c == "*" else one if c == "?" else re.escape(c) for c in glob) + r"\z"
