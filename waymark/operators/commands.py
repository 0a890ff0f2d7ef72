"""Commands as text: their parts and words, the tasks that manifests offer, and what resolves to neither."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import regions

# Shell builtins, and each runner's own subcommands.
SHELL_BUILTINS = (
    ".", ":", "[", "alias", "bg", "break", "cd", "command", "continue", "echo", "eval", "exec", "exit", "export", "false", "fg", "getopts", "hash", "jobs", "printf", "pwd", "read",
    "readonly", "return", "set", "shift", "test", "times", "trap", "true", "type", "ulimit", "umask", "unalias", "unset", "wait",
)
RUNNERS = {"mix": "mix", "cargo": "cargo", "just": "just", "npm": "npm", "pnpm": "npm", "yarn": "npm"}
RUNNER_OWN = {
    "mix": (
        "app.config", "app.start", "app.tree", "archive", "archive.build", "archive.install", "archive.uninstall", "clean", "cmd", "compile", "deps", "deps.clean", "deps.compile", "deps.get",
        "deps.tree", "deps.unlock", "deps.update", "do", "docs", "escript", "escript.build", "escript.install", "escript.uninstall", "eval", "format", "help", "loadconfig", "loadpaths", "local",
        "local.hex", "local.rebar", "new", "profile.cprof", "profile.eprof", "profile.fprof", "profile.tprof", "release", "release.init", "run", "source", "test", "test.coverage", "xref",
    ),
    "cargo": (
        "add", "b", "bench", "build", "c", "check", "clean", "clippy", "d", "doc", "fetch", "fix", "fmt", "generate-lockfile", "help", "info", "init", "install", "locate-project", "login", "logout",
        "metadata", "new", "owner", "package", "pkgid", "publish", "r", "remove", "report", "rm", "run", "rustc", "rustdoc", "search", "t", "test", "tree", "uninstall", "update", "vendor",
        "version", "yank",
    ),
    "just": (),
    "npm": ("audit", "ci", "exec", "i", "init", "install", "link", "ls", "outdated", "pack", "publish", "run", "start", "test", "update"),
}
#: Files at the root that name tasks.
MANIFESTS = ("mix.exs", "package.json", ".cargo/config.toml", ".cargo/config", "justfile", "Justfile")


def command_parts(commands: DataFrame) -> DataFrame:
    """``commands(command, ...)`` with ``part, words``: a row for each part between operators, its leading assignments left out."""
    schema = commands.withColumns({"part": F.lit(0), "words": F.array(F.lit(""))}).schema
    names = commands.columns
    at = names.index("command")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, words = [], [], []
            for k, command in enumerate(batch.column(at).to_pylist()):
                for n, found in enumerate(regions.command_words(command or "")):
                    rows.append(k)
                    parts.append(n)
                    words.append(found)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(parts, pa.int32()), pa.array(words, pa.list_(pa.string()))], [*names, "part", "words"])

    return commands.mapInArrow(run, schema)


def manifest_tasks(texts: DataFrame) -> DataFrame:
    """``runner, task`` of the root's manifests; a runner without tasks has one row with a null task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [regions.manifest_tasks(p, t or "") for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            rows = [(f[0], task) for f in found if f for task in (f[1] or [None])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows]), pa.array([t for _, t in rows], pa.string())], ["runner", "task"])

    return texts.filter(F.col("path").isin(*MANIFESTS)).select("path", "text").mapInArrow(run, "runner string, task string").distinct()


def unresolved(parts: DataFrame, tasks: DataFrame, tracked: DataFrame, programs: Sequence[str]) -> DataFrame:
    """``parts(words, ...)`` that do not resolve, with ``why``.

    The first word is a builtin, one of ``programs``, or the path of a tracked file. Where a runner's
    manifest is tracked, its second word (the third after ``run``) is a task of it or a subcommand of its own.
    """
    first, second = F.get("words", F.lit(0)), F.get("words", F.lit(1))
    runner = F.coalesce(*(F.when(first == k, F.lit(v)) for k, v in RUNNERS.items()))
    task = F.when((runner == "npm") & (second == "run"), F.get("words", F.lit(2))).otherwise(second)
    own = F.coalesce(*(F.when(runner == k, task.isin(*v) if v else F.lit(False)) for k, v in RUNNER_OWN.items()), F.lit(False)) & ~((runner == "npm") & (second == "run"))
    asked = parts.withColumns({"__first": first, "__runner": runner, "__task": task, "__own": own, "__path": X.normalize_id(first)})
    have = tasks.select(F.col("runner").alias("__runner"), F.col("task").alias("__task"), F.lit(True).alias("__found")).filter("__task IS NOT NULL").distinct()
    served = tasks.select(F.col("runner").alias("__runner")).distinct().withColumn("__served", F.lit(True))
    files = tracked.select(F.col("path").alias("__path")).distinct().withColumn("__tracked", F.lit(True))
    seen = asked.join(served, "__runner", "left").join(have, ["__runner", "__task"], "left").join(files, "__path", "left")
    why = F.when(F.col("__served") & F.col("__task").isNotNull() & ~F.col("__own") & F.col("__found").isNull(), F.concat("__task", F.lit(" is no task of "), "__first")).when(
        F.col("__served").isNull() & ~F.col("__first").isin(*SHELL_BUILTINS, *programs) & F.col("__tracked").isNull(), F.concat("__first", F.lit(" is no known program or tracked file"))
    )
    return seen.withColumn("why", why).filter("why IS NOT NULL").select(*parts.columns, "why")
