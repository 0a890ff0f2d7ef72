"""Views of the driver's tables as the entities of a graph: files, nodes, edges, claims, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, path``: a page's url without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", r"\A[a-z]+://", ""), r"[?#].*", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def site_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, dir``: the root, each host, and each host's ``en`` directory."""
    host = F.substring_index("path", "/", 1)
    hosts = page_paths(spark, sf_dir).select(host.alias("dir")).distinct()
    dirs = hosts.union(hosts.select(F.concat("dir", F.lit("/en"))))
    root = spark.range(1).select(F.lit("/").alias("id"), F.lit("").alias("dir"))
    return root.unionByName(dirs.select(F.col("dir").alias("id"), "dir"))


#: Order lines that one task joins and sums up, about.
LINES = 1 << 19


def line_parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions that hold about LINES order lines each; none where Spark's cores hold that many at once."""
    parts = -(-table(spark, sf_dir, "lineitem").count() // LINES)
    # Fewer partitions than Spark's own number would be dealt out once more by a join.
    return max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))) if parts > spark.sparkContext.defaultParallelism else None


def trade_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``from_id, to_id, l_orderkey, l_linenumber``: each order line, from its customer to its supplier.

    Of tables over LINES a core the partitions of the join follow the number of lines, so a task's memory does not grow with the table.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("from_id"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("to_id"))
    buyers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "from_id")
    parts = line_parts(spark, sf_dir)
    if parts:
        lines, buyers = lines.repartition(parts, "l_orderkey"), buyers.repartition(parts, "o_orderkey")
    return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("from_id", "to_id", "l_orderkey", "l_linenumber")


def home_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``from_id, group`` and ``to_id, group``: customers and suppliers with their nations."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("from_id"), F.col("c_nationkey").alias("group"))
    return customers, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("to_id"), F.col("s_nationkey").alias("group"))


def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``from_id, to_id``: ordered pairs of different nations of one region."""
    n = table(spark, sf_dir, "nation")
    one, two = n.select(F.col("n_name").alias("from_id"), "n_regionkey"), n.select(F.col("n_name").alias("to_id"), "n_regionkey")
    return one.join(two, "n_regionkey").filter("from_id <> to_id").select("from_id", "to_id")


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, dir``: regions, nations within regions and customers within nations, as paths."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("dir"))
    people = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "dir", "c_name").alias("dir"))
    dirs = region.select(F.col("r_name").alias("dir")).unionByName(nations.select("dir")).unionByName(people)
    root = spark.range(1).select(F.lit("/").alias("id"), F.lit("").alias("dir"))
    return root.unionByName(dirs.select(F.col("dir").alias("id"), "dir"))


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: the customers as a repository, so that a graph can be compiled whose rows are known from the tables.

    The root, each nation below its region, and each customer ``c<key>`` below the nation have a node
    file. Each customer has a module in four languages that names the customer with the next key, a
    landmark ``rule-<key>``, and a claim on it. Keys with remainder 5 to 8 of 97 have blocks that are
    refused: unknown kind, empty list, two claims of one slug, an absolute id.
    """
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.concat_ws("/", "r_name", "n_name").alias("up"))
    people = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), "up", F.concat(F.col("up"), F.lit("/c"), F.col("c_custkey")).alias("dir"))
    other = people.select((F.col("k") - 1).alias("k"), F.col("dir").alias("next"))
    both = people.join(other, "k", "left")
    k, n = F.col("k").cast("string"), (F.col("k") + 1).cast("string")
    lines = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    rest = F.col("k") % 97
    block = lines(
        "# c", k, "\n\n```graph\nkind: ", F.when(rest == 5, "module").otherwise("component"), "\npurpose: customer ", k, "\n", F.when(rest == 8, "id: /abs\n").otherwise(""), "budget: ", (F.col("k") % 60).cast("string"), "\n",
        F.when(rest == 6, lines("invariants: []\n")).otherwise(lines("invariants:\n  - claim: rule of ", k, "\n    anchor: ※ rule-", k, "\n", F.when(F.col("k") % 2 == 0, lines("    enforced_by: ", F.col("dir"), "/lib.py\n")).otherwise(""))),
        "hazards:\n  - claim: mind ", k, "\n    anchor: ", F.when(rest == 7, lines("※ rule-", k)).otherwise(lines(F.col("dir"), "/lib.py#", F.when(F.col("k") % 3 == 0, "gone").when(F.col("k") % 3 == 1, "thing").otherwise("twice"))), "\n",
        F.when((F.col("k") % 3 != 0) & F.col("next").isNotNull(), lines("edges:\n  depends: [", F.col("next"), "]\n")).otherwise(""), "```\n\n## Notes\n\nfree words here\n",
    )
    python = lines("import os\n", F.when(F.col("next").isNotNull(), lines("from ", F.replace("next", F.lit("/"), F.lit(".")), ".lib import thing\n")).otherwise(""), "\n# ※ rule-", k, "\ndef thing(x):\n    return x + ", k, "\n\n\ndef twice(): pass\ndef twice(): pass\n")
    script = lines("import { x } from '", F.when(F.col("next").isNotNull(), lines("../../../", F.col("next"), "/ui")).otherwise("lib"), "'; // ⊨ ", F.col("dir"), "/", F.when(F.col("k") % 10 == 1, "gone").otherwise(lines("rule-", k)), "\n")
    rust = lines("use c", n, "::thing;\n/* ※ shared-", (F.col("k") % 50).cast("string"), " */\nfn go() {}\n")
    elixir = lines("defmodule Shop.C", k, " do\n  alias Shop.C", n, "\nend\n")
    crate = lines("[package]\nname = \"c", k, "\"\n")
    named = {"AGENTS.md": block, "lib.py": python, "ui.ts": script, "src/lib.rs": rust, "mod.ex": elixir, "Cargo.toml": crate}
    files = both.select("dir", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), c.alias("c")) for p, c in named.items()))).alias("f")).select(F.concat_ws("/", "dir", "f.p").alias("path"), F.col("f.c").alias("content"))
    upper = nations.select(F.concat_ws("/", "up", F.lit("AGENTS.md")).alias("path"), lines("```graph\nkind: container\npurpose: ", F.col("n_name"), "\nedges:\n  decided_by: [\"§ 000", (F.col("n_nationkey") % 4).cast("string"), "\"]\n```\n").alias("content"))
    adr = nation.filter("n_nationkey < 3").select(lines("adr/000", F.col("n_nationkey").cast("string"), "-note.md").alias("path"), lines("# Note\n\nStatus: ", F.when(F.col("n_nationkey") == 1, "Superseded").otherwise("Accepted"), "\n").alias("content"))
    root = spark.range(1).select(F.lit("AGENTS.md").alias("path"), F.lit("```graph\nkind: system\npurpose: all customers\ncommands:\n  test: X=1 make test && ./run.sh | sort\nedges:\n  allow:\n    - edge: adr\n      reason: why  not\n```\n").alias("content"))
    return files.unionByName(upper).unionByName(adr).unionByName(root).select("path", F.encode("content", "utf-8").alias("content"))
