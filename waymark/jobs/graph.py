"""Compile a graph from files: authored blocks, comment tokens and imports, joined into tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.lexing import LANGUAGES, comments, declared_modules, fenced_blocks, imported, markdown_comments
from ..functions.regions import headings, regions
from ..functions.spans import Malformed, scan
from ..functions.structure import file_digests
from ..operators import edges, prefix, resolve, tokens
from ..sources.files import Notation, named, readable
from ..sources.shared import stored

#: What an authored block may hold, level by level; anything else is refused.
_BLOCK = {"kind", "id", "purpose", "commands", "invariants", "hazards", "edges", "budget"}
_CLAIM, _EDGES, _ALLOW = {"claim", "anchor", "enforced_by"}, {"depends", "decided_by", "allow"}, {"edge", "reason"}
_KINDS = ("component", "container", "system")
_NODE_SCHEMA = (
    "path string, error string, kind string, id string, purpose string, commands map<string,string>, budget long, "
    "claims array<struct<kind:string,text:string,anchor:string,enforced_by:string>>, depends array<string>, decided_by array<string>, allow array<struct<edge:string,reason:string>>"
)


class Refused(ValueError):
    pass


#: What both YAML readers take alike: no tabs, line breaks of other scripts, explicit keys or flow maps.
_COMMON = re.compile(r"[^\x00-\x09\x0b-\x1f\x7f-\xa0\u2028\u2029\ud800-\udfff\ufeff\ufffe\uffff?{}]*")


def composed(yaml, body: str, loader: type):
    """The block's tree by one of the readers; its events are looked at first where an alias or 64 levels are possible."""
    depth = 0
    for event in yaml.parse(body, Loader=loader) if "&" in body or "*" in body or sum(map(body.count, "-:?[{")) > 64 else ():
        if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
            raise Refused(f"line {event.start_mark.line + 1}: aliases are not allowed")
        if isinstance(event, yaml.CollectionStartEvent):
            depth += 1
            if depth > 64:
                raise Refused("block is nested too deep")
        elif isinstance(event, yaml.CollectionEndEvent):
            depth -= 1
    return yaml.compose(body, Loader=loader)


def read_block(body: str) -> dict:
    """One authored block: the YAML subset, strict about keys and types.

    No aliases, no repeated keys, 64 KiB and 64 levels at most; plain scalars are text, except for
    the budget, a whole number.
    """
    import yaml

    if len(body.encode()) > 64 * 1024:
        raise Refused("block is over 64 KiB")
    # libyaml reads a block some ten times as fast; what it refuses is read by the other reader, whose words are reported.
    fast = getattr(yaml, "CBaseLoader", None) if _COMMON.fullmatch(body) else None
    try:
        seen = composed(yaml, body, fast or yaml.BaseLoader)
    except yaml.YAMLError as e:
        if fast is None:
            raise Refused(str(e).splitlines()[0]) from e
        try:
            seen = composed(yaml, body, yaml.BaseLoader)
        except yaml.YAMLError as own:
            raise Refused(str(own).splitlines()[0]) from own

    def plain(node):
        if isinstance(node, yaml.MappingNode):
            out = {}
            for k, v in node.value:
                if k.value in out:
                    raise Refused(f"line {k.start_mark.line + 1}: duplicate key {k.value!r}")
                out[k.value] = plain(v)
            return out
        if isinstance(node, yaml.SequenceNode):
            return [plain(v) for v in node.value]
        return None if node.value in ("", "~", "null") and not node.style else node.value

    def check(value, allowed, required, what):
        if not isinstance(value, dict):
            raise Refused(f"{what} must be a map")
        if extra := sorted(set(value) - allowed):
            raise Refused(f"{what} has an unknown field {extra[0]!r}")
        for k in required:
            if not isinstance(value.get(k), str) or not value[k].strip():
                raise Refused(f"{what} needs {k}")
        return value

    raw = check(plain(seen) if seen is not None else None, _BLOCK, ("kind",), "block")
    if empty := sorted(k for k in ("invariants", "hazards") if raw.get(k) == []):
        raise Refused(f"{empty[0]} is an empty list; leave it out")
    if raw["kind"] not in _KINDS:
        raise Refused(f"unknown kind {raw['kind']!r}")
    if raw.get("purpose") is not None and len(raw["purpose"]) > 200:
        raise Refused("purpose is over 200 characters")
    commands = raw.get("commands") or {}
    if not isinstance(commands, dict) or not all(isinstance(v, str) for v in commands.values()):
        raise Refused("commands must map names to text")
    claims = [
        {"kind": kind, "text": c["claim"], "anchor": c["anchor"], "enforced_by": c.get("enforced_by")}
        for kind, group in (("invariant", "invariants"), ("hazard", "hazards")) for c in (check(c, _CLAIM, ("claim", "anchor"), "claim") for c in raw.get(group) or [])
    ]
    for c in claims:
        named = c["anchor"].split("#")
        if not re.match(r"\S+ [a-z0-9]+(-[a-z0-9]+)*\Z", c["anchor"]) and not (len(named) == 2 and all(named)):
            raise Refused(f"anchor {c['anchor']!r} is neither a landmark nor <path>#<symbol>")
    links = check(raw.get("edges") or {}, _EDGES, (), "edges")
    allow = [check(a, _ALLOW, ("edge", "reason"), "allow") for a in links.get("allow") or []]
    budget = raw.get("budget")
    if budget is not None and not budget.isdigit():
        raise Refused("budget must be a whole number")
    return {
        "kind": raw["kind"], "id": raw.get("id"), "purpose": raw.get("purpose"), "commands": list(commands.items()), "budget": None if budget is None else min(int(budget), (1 << 63) - 1),
        "claims": claims, "depends": links.get("depends") or [], "decided_by": links.get("decided_by") or [], "allow": allow,
    }


def authored_blocks(files: DataFrame, notation: Notation) -> DataFrame:
    """One row per node file with a block: its fields, or why it is refused."""
    columns = [c.split()[0] for c in "path error kind id purpose commands budget claims depends decided_by allow".split()]
    types = [
        *[pa.string()] * 5, pa.map_(pa.string(), pa.string()), pa.int64(), pa.list_(pa.struct([(k, pa.string()) for k in ("kind", "text", "anchor", "enforced_by")])),
        pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("edge", pa.string()), ("reason", pa.string())])),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = dict.fromkeys(columns) | {"path": path}
                try:
                    blocks = fenced_blocks(raw.decode("utf-8"))
                    own = [b for b in blocks if b[0] == notation.fence]
                    if not own:
                        continue
                    if len(own) > 1:
                        raise Refused(f"two blocks in one file: lines {own[0][1]} and {own[1][1]}")
                    if blocks[0] is not own[0]:
                        raise Refused("the block must be the first fenced block of its file")
                    made |= read_block(own[0][2])
                except (Refused, UnicodeDecodeError) as e:
                    made["error"] = str(e)
                rows.append(made)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(columns, types, strict=True)], columns)

    return named(files, [notation.node_file]).select("path", "content").mapInArrow(run, _NODE_SCHEMA)


def lexed(texts: DataFrame, notation: Notation) -> DataFrame:
    """``kind, file, language, line, content, source`` of what one pass over ``texts(path, ext, text)`` finds.

    ``line``: a line of a comment (in markdown of an HTML comment outside the generated region, in other
    files any line) that holds a token; ``import`` and ``module``: names that code imports and declares.
    """
    marks = (notation.landmark, notation.claim)
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    columns = ["kind", "file", "language", "line", "content", "source"]

    def lines_of(ext: str, text: str) -> list[tuple[int, str]]:
        if not any(m in text for m in marks):
            return []
        if ext in LANGUAGES:
            return comments(text, LANGUAGES[ext])
        if ext in ("md", "markdown"):
            try:
                region = scan(text)[1]
            except Malformed:
                region = None
            return [(line, content) for line, content in markdown_comments(text) if not (region and region.first <= line <= region.last)]
        return list(enumerate((x.removesuffix("\r") for x in text.split("\n")), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, ext, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [("line", path, None, line, content, None) for line, content in lines_of(ext, text) if any(m in content for m in marks)]
                if language := LANGUAGES.get(ext):
                    rows += [("import", path, language, line, name, source) for name, line, source in imported(text, language)]
                    if language == "elixir":
                        rows += [("module", path, language, 0, name, "") for name in declared_modules(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

    return texts.select("path", "ext", "text").mapInArrow(run, "kind string, file string, language string, line int, content string, source string")


def file_references(files: DataFrame, names: DataFrame) -> DataFrame:
    """``from_file, to_file, line, source``: imports that name a tracked file (a crate's directory for Rust).

    ``names(file, language, name, line, source, declares)`` are the names that files import and declare.
    Packages and module paths are written in between, as each is read twice.
    """
    used = names.filter(~F.col("declares"))
    paths = files.select("path")

    modules = resolve.first_declarer(names.filter("declares"), "name", "file").withColumnRenamed("file", "to_file")
    elixir = used.filter("language = 'elixir'").join(modules, "name").select("file", "to_file", "line", "source")

    py = paths.filter(F.endswith("path", F.lit(".py")))
    dotted = F.replace(F.regexp_replace(F.regexp_replace("path", r"\.py\z", ""), r"/__init__\z", ""), F.lit("/"), F.lit("."))
    modules = resolve.first_declarer(py.withColumn("name", dotted), "name", "path").withColumnRenamed("path", "to_file")
    python = used.filter("language = 'python'").join(modules, "name").select("file", "to_file", "line", "source")

    manifests = readable(named(files, ["Cargo.toml", "package.json"])).withColumn("dir", X.parent_dir(F.col("path")))
    package = F.regexp_extract("text", r"(?ms)^\[package\]\s*$(?:(?!^\[).)*?^name\s*=\s*[\"']([^\"']+)[\"']", 1)
    crates = manifests.filter(F.endswith("path", F.lit("Cargo.toml"))).withColumn("name", F.replace(package, F.lit("-"), F.lit("_"))).filter("name <> ''")
    crates = resolve.first_declarer(crates, "name", "path", "dir")
    rust = used.filter("language = 'rust'").join(crates.select("name", "dir"), "name").select("file", F.concat_ws("/", F.nullif("dir", F.lit("")), F.lit("Cargo.toml")).alias("to_file"), "line", "source")

    script = used.filter("language = 'script'")
    near = script.filter(F.startswith("name", F.lit("."))).withColumn("target", X.join_path(X.parent_dir(F.col("file")), F.col("name")))
    json_ = manifests.filter(X.basename(F.col("path")) == "package.json").select("path", "dir", F.get_json_object("text", "$.name").alias("name"), F.get_json_object("text", "$.main").alias("main")).filter("name IS NOT NULL")
    json_ = stored(json_, "packages")
    mains = json_.select("path", X.join_path(F.col("dir"), F.col("main")).alias("target")).filter("target IS NOT NULL")
    mains = mains.join(resolve.probe(mains, paths, resolve.module_candidates(F.col("target"))), "target").select("path", F.col("found").alias("__main"))
    packages = json_.join(mains, "path", "left").select("name", "dir", F.col("__main").alias("main"), X.segments(F.col("path")).alias("ord"))
    bare = script.filter(~F.startswith("name", F.lit("."))).withColumnRenamed("name", "source_name")
    bare = bare.join(resolve.bare_specifiers(bare.select(F.col("source_name").alias("source")), packages).withColumnRenamed("source", "source_name"), "source_name")
    both = stored(near.select("file", "target", "line", "source").unionByName(bare.select("file", "target", "line", "source")), "specifiers")
    scripts = both.join(resolve.probe(both, paths, resolve.module_candidates(F.col("target"))), "target").filter("found IS NOT NULL").select("file", F.col("found").alias("to_file"), "line", "source")

    every = elixir.unionByName(python).unionByName(rust).unionByName(scripts)
    return every.withColumnRenamed("file", "from_file")


def definitions(texts: DataFrame) -> DataFrame:
    """``path, symbol, line``: what ``<path>#<symbol>`` can name: definitions of code, headings of markdown by their slugs' prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, ext, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ext in LANGUAGES:
                    rows += [(path, r.name, r.line, False) for r in regions(text, LANGUAGES[ext]) if LANGUAGES[ext] != "elixir"]
                else:
                    rows += [(path, title, line, True) for line, _, title in headings(text)]
            if rows:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "symbol", "line", "heading"])

    found = texts.filter(F.col("ext").isin(*LANGUAGES, "md", "markdown")).select("path", "ext", "text").mapInArrow(run, "path string, symbol string, line int, heading boolean")
    code = found.filter(~F.col("heading")).select("path", "symbol", "line")
    slugs = found.filter("heading").select("path", X.heading_slug(F.col("symbol")).alias("slug"), "line")
    return code.unionByName(tokens.slug_prefixes(slugs).select("path", "symbol", "line"))


def content_digests(versions: DataFrame, notation: Notation) -> DataFrame:
    """``content, ext, kind, name, line, region, digest``: what anchors can be bound to in each distinct content.

    ``versions(file, text, content)``, ``content`` a hash of the text. A content that stands in any number
    of files and versions of one kind is parsed once, whatever its anchors are.
    """
    parsed = versions.filter("text IS NOT NULL").select("content", X.extension(F.col("file")).alias("ext"), "text").filter(F.col("ext").isin(*LANGUAGES)).dropDuplicates(["content", "ext"])
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    columns = ["content", "ext", "kind", "name", "line", "region", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, ext, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(content, ext, *found) for found in file_digests(text, f".{ext}", notation.landmark) or ()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

    return parsed.mapInArrow(run, "content string, ext string, kind string, name string, line int, region string, digest string")


def anchor_digests(anchors: DataFrame, versions: DataFrame, notation: Notation) -> DataFrame:
    """The rows of ``anchors(file, anchor, at_line, ...)`` joined with ``versions(file, text, ...)``, with ``region, digest``.

    ``at_line`` (null: look it up) is the landmark's line. A symbol that is gone, and a line without the
    landmark, stand for the whole file; both columns are null where the language has no lexer, where
    the landmark is not in that version, and where the file is not (text null). Only versions of anchored
    files are parsed, and equal contents once (``content_digests``); rows meet by the contents' hashes.
    """
    wanted = versions.join(anchors.select("file").distinct(), "file", "left_semi").withColumn("__content", F.sha2("text", 256))
    known = stored(content_digests(wanted.select("file", "text", F.col("__content").alias("content")), notation), "digests").withColumnRenamed("content", "__content").withColumnRenamed("ext", "__ext")
    bound = F.struct("region", "digest")
    whole = known.filter("kind = 'file'").select("__content", "__ext", bound.alias("__whole"))
    symbols = known.filter("kind = 'symbol'").select("__content", "__ext", F.col("name").alias("__name"), bound.alias("__symbol"))
    marks = known.filter("kind = 'mark'").select("__content", "__ext", F.col("name").alias("__name"), "line", bound.alias("__bound"))
    first = marks.groupBy("__content", "__ext", "__name").agg(F.min_by("__bound", "line").alias("__first"))
    at = marks.groupBy("__content", "__ext", "__name", F.col("line").alias("at_line")).agg(F.first("__bound").alias("__at"))

    rows = wanted.drop("text").withColumn("__ext", X.extension(F.col("file"))).join(anchors, "file")
    is_mark = F.startswith("anchor", F.lit(notation.landmark))
    rows = rows.withColumn("__name", F.when(is_mark, F.substring(F.col("anchor"), F.lit(len(notation.landmark) + 1), F.length("anchor"))).otherwise(F.substring_index("anchor", "#", -1)))
    key = ["__content", "__ext", "__name"]
    rows = rows.join(whole, key[:2], "left").join(symbols, key, "left").join(first, key, "left").join(at, [*key, "at_line"], "left")
    mark = F.when(F.col("at_line").isNull(), F.col("__first")).otherwise(F.coalesce("__at", "__whole"))
    chosen = F.when(is_mark, mark).otherwise(F.coalesce("__symbol", "__whole"))
    rows = rows.withColumns({"__chosen": chosen, "__file": F.substring_index("file", "/", -1)})
    # The whole file goes by its own name; a content does not know in which file it stands.
    region = F.when(F.startswith("__chosen.region", F.lit(".")), F.col("__file")).otherwise(F.col("__chosen.region"))
    return rows.withColumns({"region": region, "digest": F.col("__chosen.digest")}).drop(*[c for c in rows.columns if c.startswith("__")])


class GraphTables:
    """The graph that ``files(path, content)`` declare and show: one DataFrame for each kind of row.

    Refused blocks are rows of ``errors`` and make no node. Everything is attributed to the node with
    the deepest directory above it; landmarks without an owner belong to the root. A table is computed
    when it is first asked for. What others build on (files, blocks, what lexing found, claims) is
    written once to the shared folder; nothing is cached on executors.
    """

    def __init__(self, files: DataFrame, notation: Notation = Notation()) -> None:
        self.given, self.notation = files, notation

    @cached_property
    def files(self) -> DataFrame:
        """``path, content``: the files as they are compiled."""
        return stored(self.given.select("path", "content"), "files")

    @cached_property
    def texts(self) -> DataFrame:
        return readable(self.files)

    @cached_property
    def _blocks(self) -> DataFrame:
        own_dir = X.parent_dir(F.col("path"))
        blocks = refuse_equal_slugs(authored_blocks(self.files, self.notation), self.notation).withColumn("dir", own_dir)
        node = X.node_id(F.coalesce("id", F.when(own_dir == "", F.lit(X.SYSTEM_ID)).otherwise(own_dir)))
        return stored(blocks.withColumn("node", F.when(F.col("error").isNull(), node)), "blocks")

    @cached_property
    def _good(self) -> DataFrame:
        return self._blocks.filter("node IS NOT NULL")

    @cached_property
    def nodes(self) -> DataFrame:
        return self._good.select(F.col("node").alias("id"), "kind", "purpose", "commands", "budget", F.col("path").alias("source"), "dir")

    @cached_property
    def errors(self) -> DataFrame:
        blocks = self._blocks
        twice = self._good.groupBy("node").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n > 1")
        return (
            blocks.filter("error IS NOT NULL").select("path", "error")
            .unionByName(blocks.filter("error IS NULL AND node IS NULL").select("path", F.lit("id is no repository path").alias("error")))
            .unionByName(twice.select("path", F.concat(F.lit("id declared twice: "), "node").alias("error")))
        )

    @cached_property
    def depends(self) -> DataFrame:
        return self._good.select(F.col("node").alias("node_id"), F.posexplode("depends").alias("ord", "t")).select("node_id", X.node_id(F.col("t")).alias("target"), "ord")

    @cached_property
    def decided_by(self) -> DataFrame:
        return self._good.select(F.col("node").alias("node_id"), F.posexplode("decided_by").alias("ord", "token"))

    @cached_property
    def allow(self) -> DataFrame:
        return self._good.select(F.col("node").alias("node_id"), F.posexplode("allow").alias("ord", "a")).select("node_id", X.node_id(F.col("a.edge")).alias("edge"), "a.reason", "ord")

    @cached_property
    def _found(self) -> DataFrame:
        """What one pass over all files finds: lines with tokens, names that are imported, modules that are declared."""
        return stored(lexed(self.texts, self.notation), "lexed")

    def _tokens(self, token: str) -> DataFrame:
        lines = self._found.filter((F.col("kind") == "line") & F.col("content").contains(token))
        return lines.select("file", "line", F.explode(tokens.payloads(F.col("content"), token)).alias("payload"))

    @cached_property
    def landmark_occ(self) -> DataFrame:
        return self._tokens(self.notation.landmark).filter(X.is_valid_slug(F.col("payload"))).select("file", "line", F.col("payload").alias("slug"))

    @cached_property
    def claim_refs(self) -> DataFrame:
        return self._tokens(self.notation.claim).filter(X.is_claim_address(F.col("payload"))).select("file", "line", F.col("payload").alias("addr"))

    @cached_property
    def landmarks(self) -> DataFrame:
        won = tokens.landmark_winners(self.landmark_occ, "file", "line")
        return stored(prefix.territory_owner(won, self.nodes, path="file", fallback=X.SYSTEM_ID).select("slug", "file", "line", F.col("owner").alias("node")), "landmarks")

    @cached_property
    def claims(self) -> DataFrame:
        """The claims with what their anchors resolve to; only files that anchors name by a symbol are searched for definitions."""
        claims = self._good.select(F.col("node").alias("node_id"), F.posexplode("claims").alias("ord", "c")).select(
            "node_id", "ord", "c.*", X.derive_slug(F.col("c.anchor"), self.notation.landmark).alias("slug")
        )
        columns = [*claims.columns, "resolved", "n", "resolution"]
        is_mark = F.startswith("anchor", F.lit(self.notation.landmark))
        marks = claims.filter(is_mark).join(self.landmarks.select("slug", F.concat_ws(":", "file", "line").alias("resolved")), "slug", "left")
        marks = marks.withColumns({"n": F.when(F.col("resolved").isNotNull(), 1).otherwise(0).cast("long"), "resolution": F.when(F.col("resolved").isNotNull(), "resolved").otherwise("unresolved")})
        split = F.split("anchor", "#", 2)
        named_ = claims.filter(~is_mark).withColumns({"path": X.normalize_id(split[0]), "symbol": split[1]})
        wanted = named_.select("path", "symbol").distinct()
        searched = self.texts.join(wanted.select("path").distinct(), "path", "left_semi")
        known = definitions(searched).join(wanted, ["path", "symbol"], "left_semi")
        named_ = resolve.by_cardinality(named_, known, ["path", "symbol"], "line").withColumn("resolved", F.when(F.col("line").isNotNull(), F.concat_ws(":", "path", "line")))
        return stored(marks.select(*columns).unionByName(named_.select(*columns)), "claims")

    @cached_property
    def imports(self) -> DataFrame:
        names = self._found.filter("kind <> 'line'").select("file", "language", F.col("content").alias("name"), "line", "source", (F.col("kind") == "module").alias("declares"))
        found = edges.attribute_refs(file_references(self.files, names), self.nodes)
        return stored(found.select("from_id", "to_id", F.col("from_file").alias("file"), "line", "source").distinct(), "imports")

    @cached_property
    def contains(self) -> DataFrame:
        return prefix.contains_edges(self.nodes)

    @cached_property
    def records(self) -> DataFrame:
        status = self.texts.select("path", resolve.record_status(F.col("text")).alias("status"))
        return resolve.decision_records(self.files.select("path")).join(status, "path").select("id", "number", "status", "path")


def compile_graph(files: DataFrame, notation: Notation = Notation()) -> GraphTables:
    """All tables of the graph that ``files(path, content)`` declare and show; see ``GraphTables``."""
    return GraphTables(files, notation)


def refuse_equal_slugs(blocks: DataFrame, notation: Notation) -> DataFrame:
    """``blocks`` with an ``error`` where two claims of one block derive the same slug; within each row, no join."""
    slugs = F.transform("claims", lambda c: X.derive_slug(c["anchor"], notation.landmark))
    twice = F.filter(slugs, lambda s: F.size(F.filter(slugs, lambda t: t == s)) > 1)
    said = F.concat(F.lit("two claims derive the same slug: "), F.array_min(twice))
    return blocks.withColumn("error", F.coalesce("error", F.when(F.size(twice) > 0, said)))


def stamp_claims(graph: GraphTables, texts: DataFrame, head: Column | str, notation: Notation = Notation()) -> DataFrame:
    """``node_id, slug, verified_sha, verified_digest, region`` for each resolved claim: the stamp that a build at ``head`` gives.

    The digest is null where the anchored file's language has no lexer.
    """
    placed = graph.claims.filter("resolved IS NOT NULL").select("node_id", "slug", "anchor", F.regexp_extract("resolved", r"(?s)\A(.*):([0-9]+)\z", 1).alias("file"), F.regexp_extract("resolved", r"([0-9]+)\z", 1).cast("int").alias("at_line"))
    made = anchor_digests(placed, texts.select(F.col("path").alias("file"), "text"), notation)
    sha = F.lit(head) if isinstance(head, str) else head
    return made.select("node_id", "slug", sha.alias("verified_sha"), F.col("digest").alias("verified_digest"), "region")


def lock_rows(graph: GraphTables, stamps: DataFrame | None = None) -> DataFrame:
    """``part, key, value``: the graph as keyed JSON rows, one for each node, landmark and record; made by joins on the node.

    Lists are put together per node; nothing is collected. Written as text in order of (part, key)
    it is a stored graph; ``read_lock`` reads it back.
    """
    claims = graph.claims if stamps is None else graph.claims.join(stamps.select("node_id", "slug", F.struct(F.col("verified_sha").alias("sha"), F.col("verified_digest").alias("digest")).alias("verified")), ["node_id", "slug"], "left")
    if stamps is None:
        claims = claims.withColumn("verified", F.lit(None).cast("struct<sha:string,digest:string>"))
    listed = lambda frame, key, name, value: frame.groupBy(F.col(key).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", value.alias("v")))), lambda r: r["v"]).alias(name))
    sets = lambda frame, key, name, value: frame.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(value)).alias(name))
    claim = F.struct("anchor", "enforced_by", F.col("slug").alias("id"), "kind", "resolved", "text", "verified")
    per = [
        sets(graph.contains, "parent", "contains", F.col("child")), listed(graph.depends, "node_id", "depends", F.col("target")), listed(graph.decided_by, "node_id", "decided_by", F.col("token")),
        listed(graph.allow, "node_id", "allow", F.struct("edge", "reason")), sets(graph.imports, "from_id", "imports", F.col("to_id")), listed(claims, "node_id", "claims", claim),
    ]
    nodes = graph.nodes
    for frame in per:
        nodes = nodes.join(frame, "id", "left")
    empty = lambda c: F.coalesce(c, F.expr("array()").cast(dict(nodes.dtypes)[c]))
    commands = F.coalesce("commands", F.expr("map()").cast("map<string,string>"))
    node = F.struct(
        "budget", empty("claims").alias("claims"), commands.alias("commands"), empty("contains").alias("contains"),
        F.struct(empty("allow").alias("allow"), empty("decided_by").alias("decided_by"), empty("depends").alias("depends")).alias("declared"),
        F.struct(empty("imports").alias("imports")).alias("extracted"), "id", "kind", "purpose", "source",
    )
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return (
        nodes.select(F.lit("nodes").alias("part"), F.col("id").alias("key"), text(node).alias("value"))
        .unionByName(graph.landmarks.select(F.lit("landmarks").alias("part"), F.col("slug").alias("key"), text(F.struct("file", "line", "node")).alias("value")))
        .unionByName(graph.records.groupBy(F.col("id").alias("key")).agg(F.min(F.struct("path", "number", "status")).alias("r")).select(F.lit("records").alias("part"), "key", text(F.struct(F.col("r.number").cast("int").alias("number"), "r.path", "r.status")).alias("value")))
    )


def write_lock(rows: DataFrame, path: str, *, version: int = 3) -> None:
    """``lock_rows`` as JSON lines in order of (part, key), range-partitioned, after one line with the version."""
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit("").alias("part"), F.lit("version").alias("key"), F.lit(str(version)).alias("value"))
    rows.unionByName(head).repartitionByRange("part", "key").sortWithinPartitions("part", "key").select(F.to_json(F.struct("part", "key", "value")).alias("value")).write.mode("overwrite").text(path)


def read_lock(spark: SparkSession, path: str, *, version: int = 3) -> DataFrame:
    """``part, key, value`` of a stored graph. Another version is refused before anything is read of it."""
    rows = spark.read.text(path).select(F.from_json("value", "part string, key string, value string").alias("r")).select("r.*")
    found = rows.filter("part = '' AND key = 'version'").first()
    if found is None or found["value"] != str(version):
        raise Refused(f"stored graph has version {found['value'] if found else None!r}, not {version}: build it again")
    return rows.filter("part <> ''")


def committed_stamps(rows: DataFrame) -> DataFrame:
    """``node_id, slug, verified_sha, verified_digest`` of a stored graph's stamped claims."""
    node = F.from_json("value", "id string, claims array<struct<id:string,verified:struct<sha:string,digest:string>>>")
    claims = rows.filter("part = 'nodes'").select(node.alias("n")).select(F.col("n.id").alias("node_id"), F.explode("n.claims").alias("c"))
    return claims.filter("c.verified IS NOT NULL").select("node_id", F.col("c.id").alias("slug"), F.col("c.verified.sha").alias("verified_sha"), F.col("c.verified.digest").alias("verified_digest"))
