"""Histories with merges against plain walks; blocked scans against plain loops, with a hot file."""

import random
import subprocess

import pytest

from waymark.jobs import check as C
from waymark.jobs.graph import compile_graph, stamp_claims
from waymark.jobs.reads import blame
from waymark.operators import history, lineage
from waymark.sources import files as S
from waymark.sources.shared import stored


def ancestors(parents, sha):
    seen, todo = set(), [sha]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += parents.get(x, [])
    return seen


def dag(seed, n=60):
    rng = random.Random(seed)
    parents = {"c0": []}
    for k in range(1, n):
        pool = [f"c{j}" for j in range(max(0, k - rng.choice([1, 2, 5, 20])), k)]
        parents[f"c{k}"] = rng.sample(pool, min(len(pool), rng.choice([1, 1, 1, 2, 3]))) if rng.random() < 0.97 else []
    return parents


def frames(spark, parents):
    commits = spark.createDataFrame([(sha, int(sha[1:])) for sha in parents], "sha string, seq long")
    return commits, spark.createDataFrame([(sha, k, p) for sha, ps in parents.items() for k, p in enumerate(ps)], "sha string, ord int, parent string")


@pytest.mark.parametrize("seed", range(3))
def test_since_stamps_equals_walks(spark, seed):
    parents, rng = dag(seed), random.Random(seed)
    head = f"c{len(parents) - 3}"
    versions = [(sha, f"f{rng.randrange(3)}", rng.choice(["x", "y", None])) for sha in parents for _ in range(2)]
    versions = list({(s, f): (s, f, d) for s, f, d in versions}.values())
    claims = [(f"f{k % 4}", rng.choice([*parents, "lost"]), rng.choice(["x", "y", None]), bool(k % 2), k) for k in range(40)]
    frame = spark.createDataFrame(claims, "file string, verified_sha string, verified_digest string, tree_differs boolean, id int")
    got = lineage.attribute(lineage.since_stamps(frame, *frames(spark, parents), spark.createDataFrame(versions, "sha string, file string, digest string"), head))
    want = {}
    for file, sha, digest, differs, k in claims:
        left = ancestors(parents, head) - ancestors(parents, sha) if sha in parents else set()
        later = sorted((int(s[1:]), d) for s, f, d in versions if f == file and s in left)
        by = next((q for q, d in later if d is None or d != digest), None)
        want[k] = (sha in parents, len(later), by, "commit" if by is not None else "uncommitted" if sha in parents and differs else "history-unavailable")
    assert {r.id: (r.known, r.n_later, r.staled_by, r.attribution) for r in got.collect()} == want


def test_linear_history_is_one_line(spark):
    parents = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(300)}
    assert {r.line for r in lineage.lines(*frames(spark, parents)).collect()} == {"c299"}


def test_merged_lines_make_pairs_in_proportion_to_merges(spark, monkeypatch):
    monkeypatch.setattr(lineage, "WIDTH", 2, raising=False)
    written = []
    monkeypatch.setattr(lineage, "stored", lambda df, label: written.append(stored(df, label)) or written[-1])
    parents = {f"c{k}": [f"c{j}" for j in ((k - 3, k - 1) if k % 2 == 0 else (k - 3,)) if j >= 0] for k in range(120)}
    commits, links = frames(spark, parents)
    placed = lineage.lines(commits, links)
    wanted = placed.select("line").distinct()
    reach = lineage.reaches(placed, links, wanted)
    onward = lineage._entered(links.filter("ord = 1").selectExpr("'c119' AS other", "int(substr(sha, 2)) AS seq"), reach)
    got = {(r.line, r.sha): r["at"] for r in lineage.entries(placed, reach, wanted).collect()}
    line = {r.sha: r.line for r in placed.collect()}
    want = {}
    for sha in sorted(parents, key=lambda s: int(s[1:])):
        for held in ancestors(parents, sha):
            want.setdefault((line[sha], held), int(sha[1:]))
    assert got == want
    counts = onward.groupBy("line", "seq").count().filter("count > 1")
    assert counts.isEmpty() and max(w.count() for w in written) <= 5 * len(parents)


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_blocked_scans_with_a_hot_file(spark, width):
    rng = random.Random(width)
    versions = [("hot" if k % 2 else f"f{k % 9}", rng.randrange(600), k * 37 % 1009, rng.choice(["x", "y", "z", None])) for k in range(900)]
    marks = [(f, m) for f in ("hot", "f2", "none") for m in (-1, 0, 5, 299, 300, 598, 600)]
    got = history.after_marks(spark.createDataFrame(marks, "file string, mark long"), spark.createDataFrame(versions, "file string, at long, seq long, digest string"), ["file"], width)
    want = {}
    for f, m in marks:
        later = sorted(((s, d) for file, at, s, d in versions if file == f and at > m), key=lambda x: x[0])
        first = later[0] if later else (None, None)
        want[f, m] = (len(later), *first, next((s for s, d in later if d != first[1]), None))
    assert {(r.file, r.mark): (r.n_later, r["first"], r.first_digest, r.second) for r in got.collect()} == want


def test_no_window_over_a_whole_file_of_versions(spark):
    versions = spark.createDataFrame([("a", 1, 1, "x")], "file string, at long, seq long, digest string")
    plan = history.after_marks(versions.selectExpr("file", "at AS mark"), versions, ["file"])._jdf.queryExecution().optimizedPlan().toString()
    over_versions = [line for line in plan.split("\n") if "Window [" in line and "[at#" in line]
    assert over_versions and all("__range#" in line for line in over_versions) and "NestedLoop" not in plan


NODE = "```graph\nkind: system\npurpose: all\ninvariants:\n  - claim: adds\n    anchor: m.py#total\n  - claim: kept\n    anchor: m.py#kept\n  - claim: noted\n    anchor: notes.md#one\n```\n"
CODE = "def total(xs):\n    return sum(xs)\n\n\ndef kept(x):\n    return x\n"


def test_freshness_of_a_repository_with_merges(spark, tmp_path):
    def git(*words):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", "-c", "commit.gpgsign=false", *words], check=True, capture_output=True, text=True).stdout.strip()

    def commit(message, **texts):
        for name, text in texts.items():
            (tmp_path / {"md": "AGENTS.md", "py": "m.py", "notes": "notes.md"}[name]).write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", message)
        return git("rev-parse", "HEAD")

    git("init", "-q", "-b", "main")
    first = commit("first", md=NODE, py=CODE, notes="# One\n")
    graph = compile_graph(from_folder_of(spark, tmp_path))
    stamps = stored(stamp_claims(graph, graph.texts, first), "stamps")
    git("checkout", "-q", "-b", "side")
    side = commit("side changes it", py=CODE.replace("sum(xs)", "sum(xs) + 1"))
    git("checkout", "-q", "main")
    commit("notes", notes="# One\n\nmore\n")
    git("merge", "-q", "--no-ff", "-m", "merge", "side")
    (tmp_path / "m.py").write_text((tmp_path / "m.py").read_text().replace("return x\n", "return -x\n"))

    graph = compile_graph(from_folder_of(spark, tmp_path))
    commits, parents, head = S.lineage(spark, str(tmp_path))
    touched = commits.join(S.history(spark, str(tmp_path)).select("sha", "file"), "sha", "left")
    states = stored(C.claim_states(graph, graph.texts, stamps, touched, parents=parents, head=head, versions=S.versions(str(tmp_path), touched.filter("file IS NOT NULL")), changed=S.changed_files(spark, str(tmp_path))), "states")
    got = {r.slug: (r.outcome, r.attribution if r.outcome == "stale" else None, r.staled_sha, r.n_later) for r in states.collect()}
    assert got == {"total": ("stale", "commit", side, 1), "kept": ("stale", "uncommitted", None, 1), "one": ("churn", None, got["one"][2], 1)}
    said = {r.message: r.detail for r in C.freshness(states, graph.nodes, threshold=0).collect()}
    assert said == {
        "claim //total — digest of its region total changed": f"verified at {first[:7]}; anchored in m.py; staling commit: {side[:7]}",
        "claim //kept — digest of its region kept changed": f"verified at {first[:7]}; anchored in m.py; staling commit: (uncommitted working-tree change)",
        "claim //one — anchored file changed in 1 commits, past its leash 0": f"verified at {first[:7]}; anchored in notes.md",
    }
    asked = spark.createDataFrame([(a.replace("claim ", "").split(" — ")[0],) for a in said] + [("//none",)], "address string")
    assert {(r.lookup, r.outcome) for r in blame(graph, states, asked).collect()} >= {("not-found", None)}
    assert C.read_baseline(spark, str(tmp_path / "none")).collect() == []


def from_folder_of(spark, root):
    return S.from_repository(spark, str(root), partitions=2)
