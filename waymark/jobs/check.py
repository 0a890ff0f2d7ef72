"""Reconcile a compiled graph: one DataFrame of findings for each class of assertion, and their union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import budget, commands, edges, history, lineage, prefix, resolve
from ..sources.config import Settings
from ..sources.files import Notation
from ..sources.shared import stored
from .graph import GraphTables, anchor_digests, stamp_claims

# The classes in their order. The texts of findings below are fixed forms, too.
CLASSES = ("referential", "structural", "exhaustiveness", "budget", "freshness", "liveness")
_LOCATIONS = "array<struct<file:string,line:int,text:string>>"


def _finding(frame: DataFrame, class_: str, message: Column, *, node: Column | None = None, detail: Column | None = None, locations: Column | None = None, profile: str | None = None, fix: Column | None = None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return frame.select(
        F.lit(class_).alias("class"), F.lit(profile).cast("string").alias("profile"), text(node).alias("node"), message.alias("message"),
        text(detail).alias("detail"), (F.lit(None) if locations is None else locations).cast(_LOCATIONS).alias("locations"), text(fix).alias("fix"),
    )


def referential(graph: GraphTables, tracked: DataFrame, notation: Notation) -> DataFrame:
    """Anchors resolve once, landmarks are unique, decisions live and unique, guards tracked, back-references found."""
    say = F.concat
    open_ = graph.claims.filter(F.startswith("anchor", F.lit(notation.landmark)) & F.col("resolved").isNull())
    unresolved = _finding(open_, "referential", say(F.lit("anchor "), "anchor", F.lit(f' unresolved (0 occurrences of "{notation.landmark}'), "slug", F.lit('")')), node=F.col("node_id"), detail=F.concat(F.lit("claim now unanchored: "), "text"))
    symbol = graph.claims.filter(~F.startswith("anchor", F.lit(notation.landmark)))
    path, name = F.substring_index("anchor", "#", 1), F.substring_index("anchor", "#", -1)
    bad_path, none, several = X.normalize_id(path).isNull(), F.col("n") == 0, F.col("n") > 1
    named = lambda what: say(F.lit("anchor "), "anchor", F.lit(f' {what} definitions of "'), name, F.lit('" in '), path)
    why = F.when(bad_path, say(F.lit("anchor "), "anchor", F.lit(" unresolved ("), path, F.lit(" is not a repository-relative path)"))).when(none, say(named("unresolved (0"), F.lit(")"))).otherwise(say(named("ambiguous (>1"), F.lit(")")))
    unnamed = _finding(symbol.filter(none | several), "referential", why, node=F.col("node_id"), detail=F.concat(F.lit("claim now unanchored: "), "text"))
    referenced = graph.claim_refs.select(F.substring_index("addr", "/", -1).alias("slug"))
    declared = graph.claims.filter(F.startswith("anchor", F.lit(notation.landmark))).select("slug")
    used = declared.union(referenced).distinct()
    places = F.array_sort(F.collect_list(F.struct("file", "line", F.lit(None).cast("string").alias("text"))))
    many = graph.landmark_occ.join(used, "slug", "left_semi").groupBy("slug").agg(F.count("*").alias("n"), places.alias("at")).filter("n > 1")
    ambiguous = _finding(many, "referential", say(F.lit(f"landmark {notation.landmark}"), "slug", F.lit(" has slug-match cardinality "), "n"), locations=F.col("at"))
    guards = graph.claims.filter("enforced_by IS NOT NULL").join(tracked.select(F.col("path").alias("enforced_by")), "enforced_by", "left_anti")
    unguarded = _finding(guards, "referential", say(F.lit("enforced_by "), "enforced_by", F.lit(" is not a tracked file")), node=F.col("node_id"))
    state = resolve.decision_references(graph.decided_by.select("token"), graph.records, notation.decision)
    by_node = graph.decided_by.join(state.filter("outcome IN ('missing', 'superseded')"), "token")
    tail = F.when(F.col("outcome") == "missing", " resolves to no decision record").otherwise(" names a superseded decision record")
    undecided = _finding(by_node, "referential", say(F.lit("decided_by target "), "token", tail), node=F.col("node_id"))
    numbers = graph.decided_by.select(X.decision_number(F.col("token"), notation.decision).alias("number")).distinct()
    copies = graph.records.join(numbers, "number", "left_semi").groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("paths")).filter("n > 1")
    duplicated = _finding(copies, "referential", say(F.lit("decision record "), "id", F.lit(" is declared by "), "n", F.lit(" files: "), "paths"))
    every = graph.nodes.select(F.col("id").alias("node_id"), F.lit(None).cast("string").alias("slug")).unionByName(graph.claims.select("node_id", "slug"))
    lost = resolve.claim_lookup(graph.claim_refs.select(F.col("addr").alias("address")), every).filter("outcome <> 'found'")
    lost = graph.claim_refs.join(lost, graph.claim_refs["addr"] == lost["address"])
    why = F.when(F.col("outcome") == "ambiguous", " is an ambiguous abbreviation (matches multiple nodes)").otherwise(" resolves to no declared claim")
    dangling = _finding(lost, "referential", say(F.lit(notation.claim), "addr", why), locations=F.array(F.struct("file", "line", F.lit(None).cast("string"))))
    out = unresolved
    for more in (unnamed, ambiguous, undecided, duplicated, unguarded, dangling):
        out = out.unionByName(more)
    return out


def structural(graph: GraphTables, baseline: DataFrame | None = None) -> DataFrame:
    """Imports that no edge declares, and declared edges that no import backs, less what is allowed or frozen."""
    declared = graph.depends.select(F.col("node_id").alias("from_id"), F.col("target").alias("to_id"))
    allowed = graph.allow.select(F.col("node_id").alias("from_id"), F.col("edge").alias("to_id"))
    found = edges.structural_violations(graph.imports, declared, allowed)
    if baseline is not None:
        found = edges.subtract_frozen(found, baseline)
    seen = graph.imports.groupBy(F.col("from_id").alias("node"), F.col("to_id").alias("target")).agg(F.array_sort(F.collect_set(F.struct("file", "line", F.col("source").alias("text")))).alias("at"))
    listed = graph.depends.groupBy(F.col("node_id").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda t: t["target"]), ", ").alias("list"))
    joined = found.join(seen, ["node", "target"], "left").join(listed, "node", "left")
    new = F.col("direction") == "undeclared"
    message = F.when(new, F.concat("node", F.lit(" imports "), "target", F.lit(" — edge not declared"))).otherwise(F.concat("node", F.lit(" declares depends on "), "target", F.lit(" — no import found")))
    detail = F.when(new, F.concat(F.lit("declared depends of "), "node", F.lit(": ["), F.coalesce("list", F.lit("")), F.lit("]")))
    fix = F.when(new, "remove the import, declare the edge, or allow it with a reason").otherwise("remove the edge, or allow it with a reason")
    return _finding(joined, "structural", message, node=F.col("node"), detail=detail, locations=F.when(new, F.col("at")), fix=fix)


def exhaustiveness(graph: GraphTables, tracked: DataFrame, *, depth: int = 1, excluded: Column | None = None) -> DataFrame:
    """Directories that no node except the system's covers, shallowest first met."""
    covering = graph.nodes.filter("kind <> 'system'").select("dir").union(graph.records.select(X.parent_dir(F.col("path"))))
    kept = tracked.filter(~F.exists(X.segments(X.parent_dir(F.col("path"))), lambda s: s == ".git"))
    bare = prefix.uncovered_dirs(kept, covering, depth=depth, excluded=excluded)
    unit = F.when(F.col("n_files") == 1, " file").otherwise(" files")
    return _finding(bare, "exhaustiveness", F.concat("dir", F.lit(" ("), "n_files", unit, F.lit(") is covered by no node — unreachable via any router")), fix=F.concat(F.lit("declare a node for "), "dir", F.lit(", or exclude it")))


def chain_budget(graph: GraphTables, texts: DataFrame, notation: Notation, *, cap: int = 32768) -> DataFrame:
    """The one chain of node files, from the root down, that is furthest over the cap."""
    docs = texts.filter(X.basename(F.col("path")) == notation.node_file).select(X.parent_dir(F.col("path")).alias("dir"), "text")
    worst = budget.worst_chain(prefix.chain_bytes(graph.nodes, docs), cap)
    return _finding(worst, "budget", F.concat(F.lit("root chain to "), "id", F.lit(" → "), X.kib(F.col("chain_bytes")), F.lit(f" > {cap // 1024} KiB cap")), node=F.col("id"), profile="codex")


def token_budgets(graph: GraphTables, texts: DataFrame, notation: Notation, size: Column | None = None, *, root_cap: int = 2000) -> DataFrame:
    """Node files over their declared budget, with their largest part, and a root file over its ceiling.

    ``size`` measures ``text``; by default in words. Give a token count of one's own for exact tokens
    (see ``functions.sizes.token_count``).
    """
    size = F.regexp_count("text", F.lit(r"\S+")) if size is None else size
    parts = budget.file_parts(graph.nodes.select(F.col("source").alias("path")).join(texts, "path"), notation.fence)
    sized = parts.withColumn("part_size", size.cast("long"))
    whole = budget.largest_part(sized, "path", "part_size", "ord", "name").withColumnRenamed("total", "in_parts")
    files = graph.nodes.select("id", "budget", F.col("source").alias("path")).join(texts.select("path", size.cast("long").alias("size")), "path")
    over = files.filter((F.col("budget").isNotNull() & (F.col("size") > F.col("budget"))) | ((F.col("id") == X.SYSTEM_ID) & (F.col("size") > root_cap)))
    both = over.join(whole, "path", "left")
    n = lambda c: X.thousands(F.col(c))
    own = both.filter(F.col("size") > F.col("budget"))
    root = both.filter((F.col("id") == X.SYSTEM_ID) & (F.col("size") > root_cap))
    by_node = _finding(own, "budget", F.concat("id", F.lit(" renders "), n("size"), F.lit(" tokens > declared budget "), n("budget")), node=F.col("id"), detail=F.concat(F.lit("largest contributor: "), "name", F.lit(" ("), n("part_size"), F.lit(" tokens)")), profile="node")
    return by_node.unionByName(_finding(root, "budget", F.concat(F.lit("always-loaded set for "), "id", F.lit(" renders "), n("size"), F.lit(f" tokens > {root_cap:,}")), node=F.col("id"), profile="root"))


def claim_states(
    graph: GraphTables, texts: DataFrame, stamps: DataFrame, commits: DataFrame, notation: Notation = Notation(), *,
    parents: DataFrame | None = None, head: str | None = None, versions: DataFrame | None = None, changed: DataFrame | None = None,
) -> DataFrame:
    """Each claim with its committed stamp, what it digests now, and its outcome as ``history.blame`` names it.

    ``stamps(node_id, slug, verified_sha, verified_digest)``, ``commits(seq, sha, file, ...)``. Adds
    ``file, region, current_digest, mark, n_later``: the commits to its file after the stamp's; and
    ``attribution, staled_sha``: what a changed digest is put down to (``lineage.attribute``).

    Without ``parents(sha, ord, parent)`` the commits are one line; with them and a ``head``, commits count if the
    head holds them and the stamp's commit does not; a commit without files is a row, too (``file`` null). ``versions(sha, file, text)`` are the files at the commits
    that touch them (text null: deleted), ``changed(file)`` those whose work tree differs from the head.
    """
    claims = graph.claims.select("node_id", "slug", "anchor", "enforced_by", "resolved", F.regexp_extract("resolved", r"(?s)\A(.*):[0-9]+\z", 1).alias("file"))
    now = stamp_claims(graph, texts, "", notation).select("node_id", "slug", "region", F.col("verified_digest").alias("current_digest"))
    marks = commits.select(F.col("sha").alias("verified_sha"), F.col("seq").alias("mark")).distinct()
    known = stamps.select("node_id", "slug", "verified_sha", "verified_digest").join(marks, "verified_sha", "left")
    joined = stored(claims.join(known, ["node_id", "slug"], "left").join(now, ["node_id", "slug"], "left"), "states")
    if parents is None:
        counted = history.churn(joined.withColumn("threshold", F.lit(0).cast("long")), commits.select("file", "seq")).drop("state", "threshold")
        return history.blame(counted).withColumns({"attribution": F.lit(None).cast("string"), "staled_sha": F.lit(None).cast("string")})
    bound = joined.filter("verified_sha IS NOT NULL").select("file", "anchor").distinct()
    digests = commits.select("sha", "file").distinct().join(bound, "file").withColumn("digest", F.lit(None).cast("string"))
    if versions is not None:
        digests = anchor_digests(bound.withColumn("at_line", F.lit(None).cast("int")), versions.select("file", "sha", "text"), notation).select("sha", "file", "anchor", "digest")
    each = lambda frame: frame.withColumn("file", F.concat_ws("\0", "file", "anchor"))
    differs = changed.select("file", F.lit(True).alias("tree_differs")).distinct() if changed is not None else joined.select("file", F.lit(False).alias("tree_differs")).limit(0)
    asked = each(joined.filter("verified_sha IS NOT NULL").join(differs, "file", "left").select("node_id", "slug", "file", "anchor", "verified_sha", "verified_digest", F.coalesce("tree_differs", F.lit(False)).alias("tree_differs")))
    found = lineage.attribute(lineage.since_stamps(asked, commits.select("sha", "seq").distinct(), parents, each(digests), head))
    by = commits.select(F.col("seq").alias("staled_by"), F.col("sha").alias("staled_sha")).distinct()
    found = found.join(by, "staled_by", "left").select("node_id", "slug", "n_later", "attribution", "staled_sha")
    return history.blame(joined.join(found, ["node_id", "slug"], "left").withColumn("n_later", F.coalesce("n_later", F.lit(0))))


def freshness(states: DataFrame, nodes: DataFrame, *, threshold: int | None = None, leash: int | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Findings of ``claim_states``: regions whose digest changed, files that churned past a threshold, marks that history lacks.

    Guarded claims (``enforced_by``) are not held to digests, and to ``leash`` instead of
    ``threshold``; ``overrides(node_id, threshold)`` stand for both. Without a threshold churn is not looked at.
    A changed digest names the commit that changed it, where ``claim_states`` was given the history's parents.
    """
    own = overrides if overrides is not None else states.sparkSession.createDataFrame([], "node_id string, threshold long")
    limit = F.when(F.col("enforced_by").isNotNull(), F.lit(leash).cast("long")).otherwise(F.lit(threshold).cast("long"))
    seen = states.filter("outcome IN ('stale', 'history-unavailable', 'churn')").join(own.select("node_id", F.col("threshold").alias("__own")), "node_id", "left")
    seen = seen.withColumn("limit", F.coalesce("__own", limit))
    address = resolve.short_addresses(seen.select("node_id", "slug").unionByName(nodes.select(F.col("id").alias("node_id"), F.lit(None).cast("string").alias("slug")))).filter("slug IS NOT NULL").distinct()
    seen = seen.join(address, ["node_id", "slug"])
    say = lambda f, *end: _finding(f, "freshness", F.concat(F.lit("claim "), "address", *end), node=F.col("node_id"), detail=F.concat(F.lit("verified at "), X.short_sha(F.col("verified_sha")), F.lit("; anchored in "), "file"))
    drifted = say(seen.filter("outcome = 'stale' AND enforced_by IS NULL"), F.lit(" — digest of its region "), "region", F.lit(" changed"))
    why = F.when(F.col("attribution") == "commit", X.short_sha(F.col("staled_sha"))).when(F.col("attribution") == "uncommitted", "(uncommitted working-tree change)").otherwise("history unavailable (shallow clone?)")
    named = seen.filter("outcome = 'stale'").select("node_id", F.concat(F.lit("claim "), "address", F.lit(" — digest of its region "), "region", F.lit(" changed")).alias("message"), F.when(F.col("attribution").isNotNull(), F.concat(F.lit("; staling commit: "), why)).alias("__why"))
    drifted = drifted.join(named.withColumnRenamed("node_id", "node").distinct(), ["node", "message"], "left").withColumn("detail", F.concat("detail", F.coalesce("__why", F.lit("")))).select(*drifted.columns)
    churned = say(seen.filter("outcome = 'churn' AND n_later > limit"), F.lit(" — anchored file changed in "), F.col("n_later").cast("string"), F.lit(" commits, past its leash "), F.col("limit").cast("string"))
    lost = say(seen.filter("outcome = 'history-unavailable' AND limit IS NOT NULL"), F.lit(" — cannot verify freshness: history unavailable"))
    return drifted.unionByName(churned).unionByName(lost)


def liveness(graph: GraphTables, texts: DataFrame, tracked: DataFrame, *, programs: Sequence[str] = ()) -> DataFrame:
    """Declared commands whose parts name no known program, tracked file or task of a root manifest. Nothing is run."""
    parts = commands.command_parts(graph.nodes.select("id", F.explode("commands").alias("name", "command")))
    tasks = commands.manifest_tasks(texts)
    return _finding(
        commands.unresolved(parts, tasks, tracked.select("path"), programs), "liveness",
        F.concat(F.lit("command "), "name", F.lit(" does not resolve: "), "why"), node=F.col("id"), detail=F.concat(F.lit("in: "), "command"),
    )


def check(
    graph: GraphTables, files: DataFrame, texts: DataFrame, notation: Notation = Notation(), *, baseline: DataFrame | None = None, depth: int = 1, cap: int = 32768, root_cap: int = 2000,
    size: Column | None = None, stamps: DataFrame | None = None, commits: DataFrame | None = None, threshold: int | None = None, leash: int | None = None, overrides: DataFrame | None = None,
    programs: Sequence[str] | None = None, only: Sequence[str] = CLASSES,
) -> DataFrame:
    """All findings, in the order of the classes; none means that declarations and code agree.

    Freshness needs the committed ``stamps`` and the ``commits``; liveness a list of ``programs`` that
    are taken for granted. ``only`` names the classes to run.
    """
    makers = {
        "referential": lambda: referential(graph, files, notation), "structural": lambda: structural(graph, baseline), "exhaustiveness": lambda: exhaustiveness(graph, files, depth=depth),
        "budget": lambda: chain_budget(graph, texts, notation, cap=cap).unionByName(token_budgets(graph, texts, notation, size, root_cap=root_cap)),
        "freshness": lambda: freshness(claim_states(graph, texts, stamps, commits, notation), graph.nodes, threshold=threshold, leash=leash, overrides=overrides) if stamps is not None and commits is not None else None,
        "liveness": lambda: liveness(graph, texts, files, programs=programs) if programs is not None else None,
    }
    found = [f for f in (makers[c]() for c in CLASSES if c in only) if f is not None]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))
    return out.orderBy(rank, "node", "message")


def check_with(
    graph: GraphTables, settings: Settings, notation: Notation = Notation(), *, baseline: DataFrame | None = None, size: Column | None = None, states: DataFrame | None = None, programs: Sequence[str] | None = None,
) -> DataFrame:
    """``check`` of a compiled graph as a repository's settings want it: ceilings, depth, excluded directories, disabled classes, thresholds.

    ``states`` come from ``claim_states`` (none: no freshness). Directories are left out by the settings'
    globs for their names; a node's own threshold stands for both general ones.
    """
    spark = graph.files.sparkSession
    names = X.basename(F.col("dir"))
    excluded = None
    for glob in settings.exclude:
        hit = names.rlike(X.glob_regex(glob, across=True))
        excluded = hit if excluded is None else excluded | hit
    overrides = spark.createDataFrame(sorted(settings.node_thresholds.items()), "node_id string, threshold long")
    makers = {
        "referential": lambda: referential(graph, graph.files, notation), "structural": lambda: structural(graph, baseline),
        "exhaustiveness": lambda: exhaustiveness(graph, graph.files, depth=settings.depth, excluded=excluded),
        "budget": lambda: chain_budget(graph, graph.texts, notation, cap=settings.chain_bytes).unionByName(token_budgets(graph, graph.texts, notation, size, root_cap=settings.root_tokens)),
        "freshness": lambda: None if states is None else freshness(states, graph.nodes, threshold=settings.churn_threshold, leash=settings.enforced_leash, overrides=overrides),
        "liveness": lambda: None if programs is None else liveness(graph, graph.texts, graph.files, programs=programs),
    }
    found = [f for f in (makers[c]() for c in CLASSES if c not in settings.disable) if f is not None]
    if not found:
        return referential(graph, graph.files, notation).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.orderBy(F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")), "node", "message")


def findings_text(findings: DataFrame) -> DataFrame:
    """``class, node, message, value``: each finding as lines of text: what it says, its detail, its places, and how to mend it."""
    place = lambda p: F.concat(F.lit("\n  at "), p["file"], F.lit(":"), p["line"].cast("string"), F.coalesce(F.concat(F.lit(" "), p["text"]), F.lit("")))
    places = F.coalesce(F.array_join(F.transform("locations", place), ""), F.lit(""))
    more = lambda c, head: F.coalesce(F.concat(F.lit(f"\n  {head}"), F.col(c)), F.lit(""))
    return findings.select("class", "node", "message", F.concat("class", F.lit(": "), "message", more("detail", ""), places, more("fix", "fix: ")).alias("value"))


def summary(findings: DataFrame) -> DataFrame:
    """``class, n``: findings per class, and the total under the class ``all``; zeroes are listed."""
    classes = findings.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    per = classes.join(findings.groupBy("class").agg(F.count("*").alias("n")), "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.unionByName(findings.agg(F.lit("all").alias("class"), F.count("*").alias("n")))


def findings_json(findings: DataFrame) -> DataFrame:
    """``value``: each finding as one JSON object, null fields left out."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def allow_report(graph: GraphTables) -> DataFrame:
    """``node_id, edge, reason, ord``: every allowed edge, by node, then as declared; reasons on one line."""
    return graph.allow.select("node_id", "edge", X.flat(F.col("reason")).alias("reason"), "ord").orderBy("node_id", "ord")


def freeze(graph: GraphTables) -> DataFrame:
    """The structural violations as a baseline: ``node, direction, target`` in order."""
    declared = graph.depends.select(F.col("node_id").alias("from_id"), F.col("target").alias("to_id"))
    allowed = graph.allow.select(F.col("node_id").alias("from_id"), F.col("edge").alias("to_id"))
    return edges.structural_violations(graph.imports, declared, allowed).orderBy("node", "direction", "target")


def write_baseline(frozen: DataFrame, path: str) -> None:
    """A baseline as JSON lines in key order, range-partitioned."""
    keys = ["node", "direction", "target"]
    frozen.select(keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A stored baseline, empty where there is none; rows of another form are refused."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], "node string, direction string, target string")
    rows = spark.read.schema("node string, direction string, target string").option("mode", "FAILFAST").json(path)
    if not rows.filter("node IS NULL OR target IS NULL OR direction NOT IN ('undeclared', 'vestigial') OR direction IS NULL").isEmpty():
        raise ValueError("a baseline's rows are (node, undeclared or vestigial, target)")
    return rows
