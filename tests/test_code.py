"""Extraction, resolution and graph building on small literal repositories."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import explain
from loomgraph.operators.extract import extract_imports
from loomgraph.operators.graph import build_graph, hubs
from loomgraph.operators.resolve import resolve_imports
from loomgraph.operators.scan import keep_sources, scan
from loomgraph.session import materialize

REPOS = {
    "py": {
        "app/__init__.py": "", "app/helpers.py": "",
        "app/main.py": "from .models import User\nfrom app.db import get_conn\nimport os, sys\nfrom . import helpers\n",
        "app/models.py": "from .db import Base\n", "app/db.py": "import sqlalchemy\n",
    },
    "go": {
        "go.mod": "module example.com/svc\n\ngo 1.22\n", "internal/model/model.go": "package model\n",
        "main.go": 'package main\n\nimport (\n\t"fmt"\n\t"example.com/svc/internal/store"\n)\n',
        "internal/store/store.go": 'package store\n\nimport "example.com/svc/internal/model"\n',
    },
    "rs": {
        "src/lib.rs": "mod graph;\npub mod layout;\nuse crate::graph::Node;\n", "src/types.rs": "pub struct Node;\n",
        "src/graph.rs": "use crate::types::Node;\nuse std::{fmt, collections::{self, HashMap as M}};\n",
        "src/layout.rs": "use super::graph;\n",
    },
    "ws": {
        "packages/app/package.json": '{"name":"@acme/app","main":"./src/main.ts"}',
        "packages/lib/package.json": '{"name":"@acme/lib","exports":{".":{"import":"./src/index.ts"},"./sub":"./src/deep.ts"}}',
        "packages/app/src/main.ts": "\n".join([
            'import { sib } from "./sibling.js"', 'import { Comp } from "./Component.js"',
            'import { feat } from "./feature/index.js"', 'import { util } from "@acme/lib"', 'import React from "react"',
            'import { d } from "@acme/lib/sub"', "// import no from './none'", "const l = await import('./lazy')", "",
        ]),
        "packages/app/src/sibling.ts": "export const sib = 1\n", "packages/app/src/Component.tsx": "export const Comp = 1\n",
        "packages/app/src/feature/index.ts": "export * from '../sibling'\n", "packages/lib/src/index.ts": "export const util = 1\n",
        "packages/lib/src/deep.ts": "export const d = 1\n", "packages/app/src/lazy.ts": "/* import a from 'b'\n */ import x = require('../src/sibling')\n",
        "packages/app/src/generic.ts": "export function hit<T extends Pick<L, 'from' | 'to' | 'type'>>(link: T) {}",
        "packages/app/src/system.ts": "import fs from 'node:fs'\nimport path from 'path'\nimport x from './missing.js'",
    },
    "al": {
        "tsconfig.json": '{ // paths\n "extends": "./base", "compilerOptions": {"paths": {"@/*": ["./src/*"],}, /* x */ }}',
        "base.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"~lib": ["lib/entry"]}}}',
        "src/a.ts": "import b from '@/b'\nimport l from '~lib'\nimport z from '@/zzz'\n", "src/b.ts": "", "lib/entry.ts": "",
    },
}


@pytest.fixture(scope="module")
def resolved(spark):
    rows = [(repo, path, text) for repo, files in REPOS.items() for path, text in files.items()]
    files = materialize(spark.createDataFrame(rows, "repo_id string, path string, text string"))
    sources = keep_sources(files)
    facts = materialize(resolve_imports(extract_imports(files), sources, files))
    return files, facts


def _edges(facts, repo, kind="internal"):
    rows = facts.filter((facts.repo_id == repo) & (facts.res_kind == kind)).collect()
    return {(r.path, r.res_value) for r in rows}


def test_python_edges(resolved):
    assert _edges(resolved[1], "py") >= {
        ("app/main.py", "app/models.py"), ("app/main.py", "app/db.py"), ("app/main.py", "app/helpers.py"),
        ("app/models.py", "app/db.py"),
    }
    assert {v for _, v in _edges(resolved[1], "py", "external")} == {"os", "sys", "sqlalchemy"}


def test_go_edges(resolved):
    assert _edges(resolved[1], "go") == {
        ("main.go", "internal/store/store.go"), ("internal/store/store.go", "internal/model/model.go"),
    }
    assert _edges(resolved[1], "go", "system") == {("main.go", "fmt")}


def test_rust_edges(resolved):
    assert _edges(resolved[1], "rs") == {
        ("src/lib.rs", "src/graph.rs"), ("src/lib.rs", "src/layout.rs"), ("src/graph.rs", "src/types.rs"),
        ("src/layout.rs", "src/graph.rs"),
    }
    specs = {r.spec for r in resolved[1].filter("path = 'src/graph.rs'").collect()}
    assert specs == {"crate::types::Node", "std::fmt", "std::collections", "std::collections::HashMap"}


def test_workspace_edges(resolved):
    app = "packages/app/src/"
    assert _edges(resolved[1], "ws") == {
        (app + "main.ts", app + "sibling.ts"), (app + "main.ts", app + "Component.tsx"),
        (app + "main.ts", app + "feature/index.ts"), (app + "main.ts", "packages/lib/src/index.ts"),
        (app + "main.ts", "packages/lib/src/deep.ts"), (app + "main.ts", app + "lazy.ts"),
        (app + "feature/index.ts", app + "sibling.ts"), (app + "lazy.ts", app + "sibling.ts"),
    }
    assert _edges(resolved[1], "ws", "external") == {(app + "main.ts", "react")}
    assert len(_edges(resolved[1], "ws", "system")) == 2
    kinds = {(r.path.rsplit("/", 1)[1], r.kind) for r in resolved[1].filter("repo_id = 'ws'").collect()}
    assert {("index.ts", "reexport"), ("main.ts", "dynamic"), ("lazy.ts", "require")} <= kinds


def test_aliases_with_extends(resolved):
    assert _edges(resolved[1], "al") == {("src/a.ts", "src/b.ts"), ("src/a.ts", "lib/entry.ts")}
    assert _edges(resolved[1], "al", "unresolved") == {("src/a.ts", "@/zzz")}


def test_facts_with_one_answer_ask_once(spark):
    from loomgraph.operators.resolve import _question

    rows = [
        ("react", "a/x.ts"), ("react", "b/c/y.tsx"), ("react", "b/y.py"), ("./m", "a/x.ts"), ("../a/m", "b/x.py"), ("../../m", "b/x.py"),
        ("crate::g", "src/x.rs"), ("crate::g", "src/y.rs"), ("self::g", "src/x.rs"), ("self::g", "src/y.rs"),
    ]
    facts = spark.createDataFrame(rows, "spec string, path string")
    asked = {(r.spec, r.path): tuple(r.q) for r in facts.select("*", _question(facts.spec, facts.path).alias("q")).collect()}
    same = lambda *facts: len({asked[fact] for fact in facts}) == 1
    assert same(rows[0], rows[1]) and not same(rows[0], rows[2]) and same(rows[3], rows[4]) and not same(rows[3], rows[5])
    assert same(rows[6], rows[7]) and not same(rows[8], rows[9])


def test_shared_answers_are_each_facts_own(spark):
    """A specifier from several files and repositories, missed ones, and facts without path or repository."""
    from loomgraph.sources.manifests import alias_rows

    made = [("r", "a/m.ts", ""), ("r", "a/n.ts", ""), ("r", "b/m.py", ""), ("s", "b/o.ts", "")]
    files = materialize(spark.createDataFrame(made, "repo_id string, path string, text string"))
    asked = [
        ("r", "a/x.ts", "./m"), ("r", "b/x.ts", "../a/m"), ("r", "b/x.py", ".m"), ("r", "b/x.py", ".gone"), ("r", "b/x.ts", "../../m"), ("s", "a/x.ts", "./m"),
        (None, "a/x.ts", "./m"), ("r", None, "./m"), ("r", None, "react"), ("r", "a/x.ts", "./m"),
    ]
    told = "'' AS statement", "'static' AS kind", "1 AS start_line", "1 AS end_line", "'e' AS extractor", "'exact' AS confidence"
    facts = spark.createDataFrame(asked, "repo_id string, path string, spec string").selectExpr("*", *told)
    rows = resolve_imports(facts, files, files).select("repo_id", "path", "spec", "res_kind", "res_value").collect()
    missed = "unresolved"
    assert alias_rows(files).count() == 0
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [
        ("r", "a/x.ts", "./m", "internal", "a/m.ts"), ("r", "a/x.ts", "./m", "internal", "a/m.ts"), ("r", "b/x.ts", "../a/m", "internal", "a/m.ts"),
        ("r", "b/x.py", ".m", "internal", "b/m.py"), ("r", "b/x.py", ".gone", missed, ".gone"), ("r", "b/x.ts", "../../m", missed, "../../m"),
        ("s", "a/x.ts", "./m", missed, "./m"), (None, "a/x.ts", "./m", missed, "./m"), ("r", None, "./m", missed, "./m"), ("r", None, "react", "external", "react"),
    ]))


def test_crate_roots_are_looked_up_once_per_folder(spark):
    """`crate::` from several folders of one crate, of nested, implicit and top-level crates, with and without a root file."""
    from loomgraph.operators import resolve
    from loomgraph.operators.probe import file_keys

    paths = ["a/lib.rs", "a/x/m.rs", "a/m.rs", "a/in/main.rs", "a/in/m.rs", "b/m.rs", "b/y/m.rs", "a/tests/m.rs", "src/lib.rs", "src/m.rs", "src/bin/m.rs"]
    files = materialize(spark.createDataFrame([("r", path, "") for path in paths], "repo_id string, path string, text string"))
    asked = {
        "a/t.rs": "a/m.rs", "a/x/t.rs": "a/m.rs", "a/x/y/t.rs": "a/m.rs", "a/in/t.rs": "a/in/m.rs", "a/in/k/t.rs": "a/in/m.rs", "a/tests/t.rs": "a/tests/m.rs",
        "b/t.rs": "src/m.rs", "b/y/t.rs": "src/m.rs", "t.rs": "src/m.rs", "src/t.rs": "src/m.rs", "src/bin/t.rs": "src/bin/m.rs", None: "src/m.rs",
    }
    told = "'' AS statement", "'static' AS kind", "1 AS start_line", "1 AS end_line", "'e' AS extractor", "'exact' AS confidence"
    facts = spark.createDataFrame([(repo, path, "crate::m::Thing") for path in asked for repo in ("r", None, "s")], "repo_id string, path string, spec string").selectExpr("*", *told)
    rows = resolve_imports(facts, files, files).collect()
    assert {row.path: row.res_value for row in rows if row.repo_id == "r"} == asked
    assert {row.res_kind for row in rows if row.repo_id != "r"} == {"ignored"} and len(rows) == 3 * len(asked)

    folders = spark.createDataFrame([("r", "a"), ("r", "a/x"), ("r", "a/in/k"), ("r", "b/y"), ("r", "c/tests"), (None, "a/x")], "repo_id string, dir string")
    roots = resolve.crate_roots(folders, file_keys(files)).collect()
    assert {(row.repo_id, row.dir): row.root for row in roots} == {
        ("r", "a"): "a", ("r", "a/x"): "a", ("r", "a/in/k"): "a/in", ("r", "b/y"): "src", ("r", "c/tests"): "c/tests", (None, "a/x"): "a/x",
    }


def test_many_aliases(spark):
    import json

    listed = {f"@p{at}/*": [f"packages/p{at}/src/*"] for at in range(10_000)}
    listed |= {"exact": ["one/exact"], "*.css": ["styles/*.css"], "@p7/in/*": ["other/*"], "*": ["no/*"], "@p": ["one/p"], "two*end": ["none/*", "one/*x"]}
    text = "".join(f"import a{at} from '{spec}'\n" for at, spec in enumerate(
        ["@p7/b", "@p9999/deep/c", "exact", "theme.css", "@p7/in/d", "@p", "twoMIDend", "@p10000/x", "react"]))
    rows = [("r", "tsconfig.json", json.dumps({"compilerOptions": {"paths": listed}})), ("r", "main.ts", text)]
    rows += [("r", path, "") for path in ("packages/p7/src/b.ts", "packages/p9999/src/deep/c.tsx", "one/exact.ts", "other/d.ts", "one/p.ts", "one/MIDx.ts")]
    rows += [("other", "main.ts", "import b from '@p7/b'\n"), ("other", "packages/p7/src/b.ts", "")]
    files = spark.createDataFrame(rows, "repo_id string, path string, text string")
    facts = resolve_imports(extract_imports(files), files, files).collect()
    told = {row.spec: (row.res_kind, row.res_value) for row in facts if row.repo_id == "r"}
    assert told == {
        "@p7/b": ("internal", "packages/p7/src/b.ts"), "@p9999/deep/c": ("internal", "packages/p9999/src/deep/c.tsx"),
        "exact": ("internal", "one/exact.ts"), "theme.css": ("unresolved", "theme.css"), "@p7/in/d": ("internal", "other/d.ts"),
        "@p": ("internal", "one/p.ts"), "twoMIDend": ("internal", "one/MIDx.ts"), "@p10000/x": ("external", "@p10000/x"), "react": ("external", "react"),
    }
    assert [row.res_kind for row in facts if row.repo_id == "other"] == ["external"]


def test_graph_counts_and_containment(spark, resolved):
    files, facts = resolved
    graph = build_graph(materialize(scan(files)), facts, rollup_depth=8)
    stats = {r.repo_id: r for r in graph.stats.collect()}
    assert stats["ws"].links == 9 and stats["ws"].packages == 1
    cover = {r.repo_id: r for r in graph.coverage.collect()}
    for row in cover.values():
        assert row.import_facts == (
            row.internal_facts + row.external_facts + row.system_facts + row.unresolved_facts + row.ignored_facts
        )
    flows = graph.links.filter("type <> 'containment'")
    assert flows.filter("size(evidence) = 0").isEmpty()
    assert graph.links.filter("`from` = `to`").isEmpty()
    degree = {(r.repo_id, r.id): (r["in"], r["out"]) for r in graph.nodes.collect()}
    assert degree[("ws", "packages/app/src/sibling.ts")] == (3, 0)
    assert degree[("ws", "dir:packages")] == (0, 0)
    assert hubs(graph.nodes, 1).filter("repo_id = 'ws'").first().id == "packages/app/src/main.ts"


def _records(spark, paths):
    rows = [("r", p) for p in paths]
    return scan(spark.createDataFrame(rows, "repo_id string, path string").selectExpr("*", "'x\\n' AS text"))


def test_budget_shrinks_depth_then_folds_areas(spark):
    paths = [f"a/f{i}.ts" for i in range(30)] + [f"b/f{i}.ts" for i in range(20)] + [f"c/d/e/f{i}.ts" for i in range(9)]
    records = materialize(_records(spark, paths))
    facts = spark.createDataFrame(
        [], "repo_id string, path string, spec string, statement string, kind string, start_line int, end_line int,"
        "extractor string, confidence string, res_kind string, res_value string",
    )
    # depth one: 30 + 20 + 1 visible, 3 areas; folding `a` (the larger) leaves 22
    graph = build_graph(records, facts, max_nodes=30)
    plan = {r.area: (r.depth, r.dense) for r in graph.plan.collect()}
    assert plan == {"a": (1, True), "b": (1, False), "c": (1, False)}
    assert graph.nodes.count() == 1 + 20 + 1 + 1
    # more areas than the budget: every area with loose files folds
    tight = build_graph(records, facts, max_nodes=2)
    assert {r.area for r in tight.plan.filter("dense").collect()} == {"a", "b"}
    wide = build_graph(records, facts, max_nodes=500)
    assert wide.nodes.count() == 59 + 3


def test_dense_area_folds(spark):
    records = materialize(_records(spark, ["tests/a.ts", "tests/x/b.ts", "src/a.ts"]))
    empty = spark.createDataFrame(
        [], "repo_id string, path string, spec string, statement string, kind string, start_line int, end_line int,"
        "extractor string, confidence string, res_kind string, res_value string",
    )
    graph = build_graph(records, empty)
    assert {r.id for r in graph.nodes.collect()} == {"dir:tests", "dir:src", "src/a.ts"}


def test_scan_filters(spark):
    rows = [("r", p, t) for p, t in [
        ("./src/a.ts", "x"), ("node_modules/x/i.js", "x"), ("src/.env.ts", "x"), ("src\\b.PY", "a\n\tb  \n\nc"),
        ("yarn.lock", "x"), ("src/bin.ts", "a\0b"), ("docs/readme.md", "x"), (".claude/worktrees/w/a.ts", "x"), ("skip/a.ts", "x"),
    ]]
    got = {r.path: r for r in scan(spark.createDataFrame(rows, "repo_id string, path string, text string"), ["skip/"]).collect()}
    assert set(got) == {"src/a.ts", "src/b.PY"}
    assert got["src/b.PY"].excerpt == ["a", "  b", "c"] and got["src/b.PY"].lines == 4 and got["src/b.PY"].ext == "py"


def _many_facts(spark, n=300):
    """One edge with many facts: places repeat, two statements, the second one late; and a small edge."""
    row = lambda i: ("r", "import", "a", "b", f"p{i // 200}", i // 40, 0, "s", "one" if i < n - 5 else "two", "x", "heuristic" if i == n - 1 else "exact")
    rows = [row(i) for i in range(n)] + [("r", "import", "a", "c", "p", 1, 1, "s", "three", "x", "exact")]
    kinds = "repo_id string, type string, from string, to string, path string, start_line int, end_line int, spec string, statement string, extractor string, confidence string"
    return spark.createDataFrame(rows, kinds)


def test_links_of_crowded_edges_are_whole_and_facts_travel_once(spark):
    from loomgraph.operators import graph

    facts = materialize(_many_facts(spark))
    for reach in (4, 64, 1000):
        made = {r["to"]: r for r in graph.links_of(facts, reach).collect()}
        assert made["b"].observations == 300 and made["b"].confidence == "heuristic" and made["b"].samples == ["one", "two"]
        places = sorted({(f"p{i // 200}", i // 40) for i in range(300)})
        assert [(e.path, e.start_line) for e in made["b"].evidence] == places[:12]
        assert (made["b"].first_fact.path, made["b"].first_fact.start_line) == places[0]
        assert made["c"].observations == 1 and made["c"].samples == ["three"] and len(made["c"].evidence) == 1
    # an edge's lists come from one exchange: what is read back holds no aggregate over facts
    assert "Aggregate" not in graph.links_of(facts)._jdf.queryExecution().optimizedPlan().toString()


def test_node_samples_look_behind_the_first_links(spark):
    from loomgraph.operators import focus

    links = [("r", "import", "hub", f"n{i:03}", ["same"] if i < 90 else ["same", f"late{i}"], (f"f{i:03}",)) for i in range(100)]
    frame = materialize(spark.createDataFrame(links, "repo_id string, type string, from string, to string, samples array<string>, first_fact struct<path:string>"))
    for reach in (2, 16, 200):
        said = {r.id: r.node_samples for r in focus.node_samples(frame, reach=reach).collect()}
        assert said["hub"] == ["same", "late90", "late91", "late92", "late93", "late94"]
        assert said["n000"] == ["same"] and said["n095"] == ["same", "late95"]


def test_neighbours_are_ordered_by_the_other_end(spark):
    from loomgraph.operators import focus

    place = ("p", 1, 1, "s")
    rows = [("r", "import", a, b, ["x" + b], place) for a, b in (("n", "c"), ("n", "a"), ("b", "n"), ("a", "n"), ("n", "b"))]
    rows += [("r", "external", "n", "0", ["y"], ("a", 1, 1, "s"))]
    fact = "struct<path:string,start_line:int,end_line:int,spec:string>"
    links = spark.createDataFrame(rows, f"repo_id string, type string, `from` string, `to` string, samples array<string>, first_fact {fact}")
    shown = focus.shown_neighbours(links, k=3)
    got = sorted((r.side, r.rank, r.other, r.more) for r in shown.filter("id = 'n'").collect())
    assert got == [(0, 1, "a", 1), (0, 2, "b", 1), (0, 3, "c", 1), (1, 1, "a", 0), (1, 2, "b", 0)]
    packets = {r.id: (r.outgoing, r.incoming, r.packet) for r in focus.inspect_nodes(links).collect()}
    assert packets["n"] == (4, 2, "xa") and packets["0"] == (0, 1, "y") and packets["b"] == (1, 1, "xn")
    windows = [line for line in shown._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in line]
    assert windows and not any("from#" in line for line in windows)


def test_context_of_wanted_nodes_only(spark):
    """Asked for packages only, the links of files do not travel; the rows are those of the whole, filtered."""
    from loomgraph.operators.focus import neighbour_context

    spots = [("r", "a.ts", "file"), ("r", "b.ts", "file"), ("r", "ext:x", "external"), ("s", "ext:x", "external"), (None, "ext:y", "external")]
    nodes = spark.createDataFrame([(*s, s[1].removeprefix("ext:")) for s in spots], "repo_id string, id string, kind string, path string")
    place = "struct<path:string,start_line:int,end_line:int,spec:string>"
    rows = [("r", "import", "a.ts", "b.ts"), ("r", "external", "b.ts", "ext:x"), ("r", "external", "a.ts", "ext:x"), ("s", "external", "c.ts", "ext:x")]
    links = spark.createDataFrame([(*r, (r[2], 1, 1, "s")) for r in rows], f"repo_id string, type string, `from` string, `to` string, first_fact {place}")
    told = lambda frame: sorted(map(str, frame.collect()))
    packages = neighbour_context(nodes, links, wanted=F.col("kind") == "external")
    assert told(packages) == told(neighbour_context(nodes, links).filter("kind = 'external'"))
    assert {(r.repo_id, r.id): r.imported_by for r in packages.collect()} == {("r", "ext:x"): ["a.ts", "b.ts"], ("s", "ext:x"): [], (None, "ext:y"): []}


def test_written_tables_come_apart(spark):
    """A file opens by row groups of sixteen megabytes, and settings for one write end with it."""
    import glob

    import pyarrow.parquet as pq

    from loomgraph.session import SORTING, settings

    made = materialize(spark.range(3_000_000, numPartitions=1).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b")))
    files = [pq.ParquetFile(name.removeprefix("file:")) for path in made.inputFiles() for name in glob.glob(path.replace("file://", ""))]
    assert sum(f.metadata.num_row_groups for f in files) >= 2
    before = {name: spark.conf.get(name) for name in SORTING}
    with pytest.raises(ValueError), settings(spark, SORTING):
        assert spark.conf.get("spark.sql.execution.replaceHashWithSortAgg") == "true"
        raise ValueError
    assert {name: spark.conf.get(name) for name in SORTING} == before


def test_texts_are_cut_and_never_broadcast(spark):
    """A text column may hold any number of bytes for each of its table's, which no estimate sees."""
    ids = [("r", f"{i}.py", f"{i}.py", "file", ["f"] if i else []) for i in range(3)]
    nodes = spark.createDataFrame(ids, "repo_id string, id string, path string, kind string, symbols array<string>")
    links = spark.createDataFrame([], "repo_id string, type string, from string, to string, first_fact struct<path:string>")
    texts = ["x" * 4001, "y" * 4000, "z" * 9000]
    files = spark.createDataFrame([("r", f"{i}.py", t) for i, t in enumerate(texts)], "repo_id string, path string, text string")
    requests = explain.explain_requests(nodes, links, files)
    plan = requests._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "4001)" in plan
    got = {row.id: row.source for row in requests.collect()}
    told = texts[2][:4000] + "\n… (truncated)\n\n/* also declares: f */"
    assert got == {"0.py": texts[0][:4000] + "\n… (truncated)", "1.py": texts[1], "2.py": told}


def test_shuffles_of_a_written_table_are_removed(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {name.rsplit("/", 1)[-1] for name in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}
    counted = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").agg(F.count("*").alias("n"))
    assert counted.count() == 7
    before = shuffles()
    assert before
    written = materialize(counted)
    assert not shuffles() - before
    assert written.count() == 7 and counted.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
