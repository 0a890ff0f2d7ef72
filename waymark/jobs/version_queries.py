"""Registered queries over versions and histories, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lineage, masks, resolve
from ..sources.files import Notation
from ..sources.shared import shared_root
from ..sources.tables import customer_files, page_paths, table
from . import emit, graph, store
from .queries import _CUST, _NODE_ROWS, query

_CODE = "# ※ rule\ndef thing(x):\n    if x > {k}:\n        x = x + 1\n        x = x * 2\n    return x\n\n\ndef other():\n    return 1\n"
#: What is done to the code in a version, and what stands in the text then.
_EDITS = [
    ("x = x + 1", "x = x + 1"), ("x = x + 1", "x = x+1  # why"), ("x = x + 1", "\n        # more\n        x = (\n  x + 1)"), ("        x = x * 2", "    x = x * 2"),
    ("x = x * 2", "x = x * 3"), ("return 1", "return 2"), ("x = x + 1\n        x = x * 2", "x = x * 2\n        x = x + 1"), ("x = x + 1", "x  =  x +  1"),
]


@query(
    "version_digests",
    """WITH v AS (SELECT c_custkey AS k, s, (c_custkey + s) % 8 AS edit FROM customer, range(6) r(s)),
      g AS (SELECT 'c' || k || '/lib.py' AS file, s, unnest(['mark', 'symbol', 'other']) AS bound, edit FROM v),
      d AS (SELECT *, CASE WHEN bound = 'other' THEN (edit = 5)::INT WHEN edit IN (2, 3, 4, 6) THEN edit ELSE 0 END AS same FROM g)
      SELECT file, bound, s::INT AS seq, CASE bound WHEN 'other' THEN 'other' ELSE 'thing' END AS region, min(s) OVER (PARTITION BY file, bound, same)::INT AS first_seq FROM d""",
)
def version_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six versions of each customer's file, edited in turn; the first version whose region had the same digest.

    Comments, spaces and edits of another definition keep a digest; a changed constant, a changed order, a
    pair of parentheses and a statement that leaves its block do not.
    """
    n = (F.col("k") + F.col("seq")) % len(_EDITS)
    code = F.replace(F.lit(_CODE), F.lit("{k}"), F.col("k").cast("string"))
    edited = F.coalesce(*(F.when(n == e, F.replace(code, F.lit(old), F.lit(new))) for e, (old, new) in enumerate(_EDITS)))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("c"), "c_custkey", F.lit("/lib.py")).alias("file"))
    versions = people.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("file", "seq", edited.alias("text"))
    named = F.create_map(*(F.lit(x) for x in ("mark", "※ rule", "symbol", "lib.py#thing", "other", "lib.py#other")))
    anchors = people.select("file", F.explode(named).alias("bound", "anchor")).withColumn("at_line", F.lit(None).cast("int"))
    found = graph.anchor_digests(anchors, versions, Notation()).select("file", "bound", "seq", "region", "digest")
    same = Window.partitionBy("file", "bound", "digest")
    return found.filter("digest IS NOT NULL").select("file", "bound", "seq", "region", F.min("seq").over(same).alias("first_seq"))


@query(
    "lineage_attribution",
    """WITH RECURSIVE steps AS (SELECT c_custkey AS k, c_custkey - 5 AS p FROM customer WHERE c_custkey > 5 UNION ALL SELECT c_custkey, c_custkey - 1 FROM customer WHERE c_custkey % 7 = 0),
      claims AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey * 7 END AS v, s_suppkey % 13 AS file, 'd' || s_suppkey % 3 AS digest, s_suppkey % 2 = 0 AS differs FROM supplier),
      starts AS (SELECT DISTINCT v FROM claims WHERE v IS NOT NULL UNION SELECT max(c_custkey) FROM customer),
      held(v, k) AS (SELECT v, v FROM starts UNION SELECT v, p FROM held JOIN steps USING (k)),
      ours AS (SELECT k FROM held WHERE v = (SELECT max(c_custkey) FROM customer)),
      later AS (SELECT c.*, o.k, CASE WHEN o.k % 11 <> 0 THEN 'd' || o.k % 3 END AS was FROM claims c JOIN ours o ON o.k % 13 = c.file AND c.v IS NOT NULL
        WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.v = c.v AND h.k = o.k)),
      found AS (SELECT id, count(*) AS n_later, min(k) FILTER (was IS NULL OR was <> digest) AS staled_by FROM later GROUP BY id)
      SELECT c.id, v IS NOT NULL AS known, coalesce(n_later, 0)::BIGINT AS n_later, staled_by,
        CASE WHEN staled_by IS NOT NULL THEN 'commit' WHEN v IS NOT NULL AND differs THEN 'uncommitted' ELSE 'history-unavailable' END AS attribution
      FROM claims c LEFT JOIN found f ON f.id = c.id""",
)
def lineage_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as commits on five lines that merge; suppliers as claims stamped at some of them.

    A commit's first parent has the key less 5, each seventh one also holds the key before; the last key is
    the head.
    """
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    sha = lambda c: F.concat(F.lit("c"), c.cast("string"))
    k = F.col("k")
    commits = keys.select(sha(k).alias("sha"), k.cast("long").alias("seq"))
    parents = keys.filter("k > 5").select(sha(k).alias("sha"), F.lit(0).alias("ord"), sha(k - 5).alias("parent"))
    parents = parents.unionByName(keys.filter("k % 7 = 0").select(sha(k).alias("sha"), F.lit(1).alias("ord"), sha(k - 1).alias("parent")))
    file, digest = lambda c: F.concat(F.lit("f"), (c % 13).cast("string")), lambda c: F.concat(F.lit("d"), (c % 3).cast("string"))
    versions = keys.select(sha(k).alias("sha"), file(k).alias("file"), F.when(k % 11 != 0, digest(k)).alias("digest"))
    s = F.col("s_suppkey")
    claims = table(spark, sf_dir, "supplier").select(s.alias("id"), file(s).alias("file"), F.when(s % 10 == 0, "lost").otherwise(sha(s * 7)).alias("verified_sha"), digest(s).alias("verified_digest"), (s % 2 == 0).alias("tree_differs"))
    head = keys.agg(F.max("k")).first()[0]
    found = lineage.attribute(lineage.since_stamps(claims, commits, parents, versions, f"c{head}"))
    return found.select("id", "known", "n_later", "staled_by", "attribution")


@query(
    "graph_changes",
    f"""WITH {_CUST}, {_NODE_ROWS}, keys AS (SELECT id, regexp_extract(id, '/c([0-9]+)$', 1) AS k FROM node_rows),
      edited AS (SELECT id, k::INT AS k FROM keys WHERE k <> '')
      SELECT 'nodes' AS part, CASE WHEN k % 50 = 2 THEN id || '-new' ELSE id END AS key, CASE k % 50 WHEN 1 THEN 'changed' WHEN 2 THEN 'added' ELSE 'lost' END AS change FROM edited WHERE k % 50 IN (1, 2, 3)""",
)
def graph_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of the customers is published, and compared with one in which some nodes are other, new or gone."""
    rows = graph.lock_rows(graph.compile_graph(customer_files(spark, sf_dir)))
    root = f"{shared_root(spark)}/waymark/published-{uuid.uuid4().hex}"
    store.publish(rows, root)
    rows = store.read(spark, root).withColumn("k", F.when(F.col("part") == "nodes", F.nullif(F.regexp_extract("key", r"/c([0-9]+)\z", 1), F.lit(""))).cast("int") % 50)
    kept = rows.filter("k IS NULL OR k <> 3").withColumn("value", F.when(F.col("k") == 1, F.concat("value", F.lit(" "))).otherwise(F.col("value")))
    new = rows.filter("k = 2").withColumn("key", F.concat("key", F.lit("-new")))
    return store.changes(kept.unionByName(new).select("part", "key", "value"), root)


@query(
    "node_suggestions",
    r"""WITH ids AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS id FROM (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*', '') AS path FROM pages) WHERE contains(path, '/')),
      asked AS (SELECT substr(id, 2, 4) AS query FROM ids UNION SELECT substr(id, 3, 2) FROM ids UNION SELECT substr(id, 1, 1) || 'zq' FROM ids UNION SELECT right(id, 9) FROM ids)
      SELECT query, id FROM asked JOIN ids ON contains(id, query) WHERE query <> ''""",
)
def node_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of pages that contain pieces of others."""
    nodes = page_paths(spark, sf_dir).filter(F.contains("path", F.lit("/"))).select(F.regexp_replace("path", r"/[^/]*\z", "").alias("id")).distinct()
    pieces = F.array(F.substring("id", 2, 4), F.substring("id", 3, 2), F.concat(F.substring("id", 1, 1), F.lit("zq")), F.expr("right(id, 9)"))
    return resolve.containing(nodes.select(F.explode(pieces).alias("query")), nodes)


@query(
    "masked_links",
    r"""WITH bare AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<nav.*?</nav>', '', 'g') AS rest, html FROM pages)
      SELECT page_id, (length(html) - length(replace(html, '<a href', '')))::BIGINT // 7 AS n_links,
        (length(html) - length(replace(html, '<a href', '')))::BIGINT // 7 - (length(rest) - length(replace(rest, '<a href', '')))::BIGINT // 7 AS n_masked
      FROM bare WHERE contains(html, '<a href')""",
)
def masked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page, and how many of them lie in comments or menus."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    found = emit.spans(pages, "page_id", "html", {"mask": "<!--.*?-->|<nav.*?</nav>", "link": "<a href"})
    links = found.filter("kind = 'link'").select("page_id", F.col("start").alias("at"))
    told = masks.inside(links, found.filter("kind = 'mask'"), ["page_id"])
    return told.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if("inside").alias("n_masked"))


@query(
    "spliced_files",
    """WITH f AS (SELECT page_id, page_id % 4 AS form, replace(replace(html, '```', ''), '<!--', '') AS tail, 'row ' || url AS body FROM pages)
      SELECT page_id, CASE form WHEN 2 THEN 'no generated region' WHEN 3 THEN 'malformed: line 3: an end without a begin' ELSE 'changed' END AS state,
        CASE WHEN form < 2 THEN 'same' WHEN form = 2 THEN 'no generated region' ELSE 'malformed: line 3: an end without a begin' END AS again,
        sha256(CASE form WHEN 0 THEN '# é' || chr(10) || chr(10) || '<!-- @graph router -->' || chr(10) || body || chr(10) || '<!-- @end -->' || chr(10) || tail WHEN 1 THEN '# é' || chr(10) || chr(10) || '<!-- @graph -->' || chr(10) || body || chr(10) || '<!-- @end -->' || chr(10) || tail
          WHEN 2 THEN '# é' || chr(10) || chr(10) || tail ELSE '# é' || chr(10) || chr(10) || '<!-- @end -->' || chr(10) || tail END) AS sha FROM f""",
)
def spliced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages behind a generated region that is full, empty, missing or malformed; spliced twice."""
    p = table(spark, sf_dir, "pages")
    form = F.col("page_id") % 4
    head = F.when(form == 0, "# é\n\n<!-- @graph router -->\nold | row\n<!-- @end -->\n").when(form == 1, "# é\n\n<!-- @graph --><!-- @end -->\n").when(form == 2, "# é\n\n").otherwise("# é\n\n<!-- @end -->\n")
    tail = F.replace(F.replace("html", F.lit("```"), F.lit("")), F.lit("<!--"), F.lit(""))
    files = p.select(F.col("page_id").cast("string").alias("path"), F.encode(F.concat(head, tail), "utf-8").alias("content"))
    bodies = p.select(F.col("page_id").cast("string").alias("path"), F.concat(F.lit("row "), "url").alias("body"))
    once = emit.spliced(files, bodies)
    twice = emit.spliced(once.select("path", "content"), bodies).select("path", F.col("state").alias("again"), "content")
    return once.select("path", "state").join(twice, "path").select(F.col("path").cast("long").alias("page_id"), "state", "again", F.sha2("content", 256).alias("sha"))
