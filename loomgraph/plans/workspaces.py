"""Queries over seven repositories with equal paths, every manifest and every way to import, dealt from `part`.

A part is one user file of repository shop<p_partkey % 7>, in the language p_partkey % 4 gives; what it imports follows
from its size. Manifests, packages, modules and crates are there once per repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import build, correlate, extract, graph, resolve, scan
from loomgraph.plans.adapters import table
from loomgraph.session import materialize
from loomgraph.sources import files as readers
from loomgraph.sources import manifests

# path and text of a user file; k is p_size % 10, r the repository
_USERS = [
    (
        "'src/users/u' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.ts' ELSE '.tsx' END",
        r"""'import a from "@/m' || k || '"\nimport b from "~' || k || '/extra"\nimport c, { d } from "@acme/lib' || k || '"\nimport e from "@acme/lib' || k ||
        '/sub"\nexport * from "../m' || k || '.js"\nconst f = await import("@acme/lib' || k || '/src/extra")\nimport g from "react"\nimport h from "node:fs"\nimport i from "./gone' || k ||
        '"\nconst again = require("@/m' || k || '")\n'""",
    ),
    (
        "'cmd/u' || p_partkey || '.go'",
        r"""'package main\n\nimport (\n\t"fmt"\n\t"example.com/shop' || r || '/pkg/p' || k || '"\n\tx "example.com/other' || r || '/pkg/p' || k ||
        '"\n)\n\nimport "github.com/acme/tool/sub"\n'""",
    ),
    (
        "'src/u' || p_partkey || '.rs'",
        r"""'mod part;\nuse crate::c' || k || '::inner::Thing;\nuse self::part::X;\nuse super::c' || k || '::Other;\nuse shop_util::deep::{Thing as T, Other};\nuse std::fmt;\n' ||
        'use serde::Serialize;\nuse serde_json;\nuse mystery;\n'""",
    ),
    (
        "'app/u' || p_partkey || '.py'",
        r"""'from .d' || k || ' import thing\nimport app.d' || k || ', flask\nfrom ..gone import x\nimport os\n'""",
    ),
]


def workspace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", (F.col("p_partkey") % 7).alias("r"), (F.col("p_size") % 10).alias("k")
    ).withColumn("repo_id", F.concat(F.lit("shop"), F.col("r")))
    path, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for language, (at, said) in enumerate(_USERS):
        path = F.when(F.col("p_partkey") % 4 == language, F.expr(at)).otherwise(path)
        text = F.when(F.col("p_partkey") % 4 == language, F.expr(said)).otherwise(text)
    users = parts.select("repo_id", path.alias("path"), text.alias("text"))
    own = parts.filter("p_partkey % 4 = 2").select("repo_id", F.expr("'src/u' || p_partkey || '/part.rs'").alias("path"), F.lit("").alias("text"))
    repos = parts.select("repo_id", "r").distinct()
    single = [
        ("package.json", """'{"name":"' || repo_id || '","private":true}'"""),
        ("tsconfig.json", r"""'{ // aliases\n "extends": "./base.json", "compilerOptions": {"paths": {"@/*": ["./src/*"], ' || array_join(transform(sequence(0, 9), k -> '"~' || k || '/*": ["packages/lib' || k || '/src/*"]'), ', ') || ',}}}'"""),
        ("base.json", """'{"compilerOptions": {"baseUrl": "."}}'"""),
        ("go.mod", r"""'module example.com/' || repo_id || '\n\ngo 1.22\n'"""),
        ("Cargo.toml", r"""'[package]\nname = "' || repo_id || '-core"\n\n[dependencies]\nserde = "1"\nserde-json = { version = "1" }\n[dev-dependencies]\ninsta = "1"\n'"""),
        ("crates/util/Cargo.toml", r"""'[package]\nname = "shop-util"\n[lib]\npath = "src/lib.rs"\n'"""),
        ("crates/util/src/lib.rs", "''"), ("crates/util/src/deep.rs", "''"), ("src/lib.rs", "''"), ("app/__init__.py", "''"),
    ]
    listed = F.array(*[F.struct(F.lit(at).alias("path"), F.expr(said).alias("text")) for at, said in single])
    ten = [
        ("'packages/lib' || k || '/package.json'",
         """'{"name":"@acme/lib' || k || '","main":"./src/index.ts","exports":{".":{"import":"./src/index.ts"},"./sub":"./src/deep.ts"}}'"""),
        *[(f"'packages/lib' || k || '/src/{name}.ts'", "''") for name in ("index", "deep", "extra")],
        ("CASE WHEN k < 8 THEN 'src/m' || k || '.ts' END", "''"), ("'pkg/p' || k || '/p' || k || '.go'", "''"), ("'pkg/p' || k || '/a.go'", "''"),
        ("'src/c' || k || '.rs'", "''"), ("'src/c' || k || '/inner.rs'", "''"), ("'app/d' || k || '.py'", "''"),
    ]
    each = F.array(*[F.struct(F.expr(at).alias("path"), F.expr(said).alias("text")) for at, said in ten])
    numbered = repos.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("repo_id", F.explode(each).alias("f")).filter("f.path is not null")
    whole = repos.select("repo_id", F.explode(listed).alias("f"))
    return users.unionByName(own).unionByName(whole.select("repo_id", "f.*")).unionByName(numbered.select("repo_id", "f.*"))


_KEPT: dict[tuple, tuple[DataFrame, DataFrame, DataFrame]] = {}


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, sources, resolved facts), written once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        files = materialize(workspace_files(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism))
        sources = scan.keep_sources(files)
        facts = materialize(resolve.resolve_imports(extract.extract_imports(sources, scanned=True), sources, files))
        _KEPT[key] = files, sources, facts
    return _KEPT[key]


def workspace_facts(spark, sf_dir):
    return _made(spark, sf_dir)[2].select("repo_id", "path", "spec", "kind", "start_line", "end_line", "res_kind", "res_value")


def built_workspaces(spark, sf_dir):
    """Whole graphs without the folder of commands, nothing folded: counters and the note on what is shown."""
    made = build.build(_made(spark, sf_dir)[0], exclude=["cmd"], max_nodes=1 << 40)
    counters = made.graph.coverage.select("repo_id", "import_facts", "unresolved_facts")
    stats = made.graph.stats.select("repo_id", "source_files", "lines", "links", "packages")
    return stats.join(counters, "repo_id").join(made.notes, "repo_id")


def workspace_kinds(spark, sf_dir):
    return graph.kinds_by_language(_made(spark, sf_dir)[2])


def workspace_ratio(spark, sf_dir):
    return graph.resolution_ratio(_made(spark, sf_dir)[2]).select("repo_id", "internal", "unresolved", F.round("ratio", 9).alias("ratio"))


def first_unresolved(spark, sf_dir):
    return graph.first_unresolved(_made(spark, sf_dir)[2]).select("repo_id", "rank", "path", "start_line", "spec")


def declared_things(spark, sf_dir):
    """What manifests declare, a row each: modules, crates, dependencies, packages, exports, aliases, names."""
    files, sources, _ = _made(spark, sf_dir)
    from loomgraph.operators.probe import file_keys

    crates, deps = manifests.cargo(files, sources)
    packages = manifests.packages(files, file_keys(sources))
    aliases = manifests.alias_rows(files)
    row = lambda df, kind, name, detail: df.select("repo_id", F.lit(kind).alias("kind"), name.alias("name"), detail.alias("detail"))
    parts = [
        row(manifests.go_modules(files), "go", F.col("prefix"), F.col("dir")),
        row(crates, "crate", F.col("name"), F.concat_ws(" ", "dir", "root", "entry")),
        row(deps, "dependency", F.col("name"), F.lit("")),
        row(packages, "package", F.col("name"), F.concat_ws(" ", "dir", "entry")),
        row(packages.select("repo_id", "name", F.explode("exports")), "export", F.concat("name", F.lit(" "), "key"), F.col("value")),
        row(aliases, "alias", F.concat("head", F.when(F.col("starred"), "*").otherwise(""), "tail"),
            F.concat(F.col("nth").cast("string"), F.lit(" "), "base", F.lit(" "), F.array_join("targets", ","))),
        row(manifests.repo_names(files), "name", F.col("name"), F.lit("")),
    ]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return made


def extract_lexical(spark, sf_dir):
    """Specifiers of scripts whose documents stand in comments, templates, strings and regular expressions among live imports."""
    plain = F.translate(F.col("text"), "`\\$*/'\"\n", "        ")
    text = F.concat(
        F.lit("const tick = /[`'\"]/g\nimport a from './live_a_"), F.col("doc_id"), F.lit("'\nconst star = /\\/*/\n/* import x from './dead1' "), plain,
        F.lit(" */\nconst t = `import y from './dead2' "), plain, F.lit(" ${await import('./live_b_"), F.col("doc_id"), F.lit("')} ${ {k: `${require('./live_c_"),
        F.col("doc_id"), F.lit("')}`}.k } require('./dead3')`\n// import z from './dead4' "), plain, F.lit("\nconst s = \"import('./dead5')\", q = a / b / c // '\nexport const E = () => <p title='"),
        plain, F.lit("'>see http://"), plain, F.lit(" it's {import('./live_d_"), F.col("doc_id"), F.lit("')}</p>\nexport * from './live_e_"), F.col("doc_id"), F.lit("'\n"),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.lit("main").alias("repo_id"), F.concat(F.lit("src/d"), F.col("doc_id"), F.lit(".tsx")).alias("path"), text.alias("text")
    )
    return extract.extract_imports(docs, scanned=True).select("path", "spec", "kind")


def tree_filters(spark, sf_dir):
    """Which archive members are wanted, binary or too long."""
    path = F.expr(
        """'root-' || doc_id || '/' || CASE doc_id % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'a/dist/' WHEN 2 THEN 'a/b/' ELSE '' END ||
           CASE doc_id % 7 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'tsconfig.json' WHEN 3 THEN 'd' || doc_id || '.py'
           WHEN 4 THEN 'd.txt' WHEN 5 THEN 'x.d/readme' ELSE 'Main.TS' END"""
    )
    text = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("\0"))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", readers.strip_archive_root(path).alias("path"), text.alias("text"))
    from loomgraph.functions.text import is_binary

    return docs.select(
        "doc_id", "path", readers.wanted(F.col("path")).alias("wanted"), is_binary(F.col("text")).alias("binary"),
        scan.is_source(F.col("path")).alias("source"),
    )


def oversized_files(spark, sf_dir):
    """Files left out for their length, and those kept, per source."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_id"), F.concat(F.lit("d"), F.col("doc_id"), F.lit(".py")).alias("path"), "text"
    )
    kept = scan.keep_sources(docs, max_chars=2000).groupBy("repo_id").agg(F.count("*").alias("kept"))
    return scan.oversized(docs, 2000).join(kept, "repo_id", "left").select("repo_id", "oversized", F.coalesce("kept", F.lit(0)).alias("kept"))


def file_budgets(spark, sf_dir):
    """The first forty files of each source by path, within a budget of characters."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_id"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text"
    )
    capped = readers.cap_files(docs, max_files=40, max_total=60_000)
    return capped.files.select("repo_id", "path").join(capped.report.select("repo_id", "truncated"), "repo_id")


_RECORDED = r"""CASE event_id % 9 WHEN 0 THEN file WHEN 1 THEN './x/../' || file WHEN 2 THEN 'C:\\srv\\app\\' || replace(file, '/', '\\') WHEN 3 THEN 'C:/srv/app/../app/' || file
    WHEN 4 THEN '/srv/app/' || file WHEN 5 THEN '//host/share/srv/app/' || file WHEN 6 THEN '\\' || file WHEN 7 THEN 'C:' || file ELSE '../' || file END"""


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("src/m"), (F.col("event_id") % 10).cast("string"), F.lit(".ts"))
    return table(spark, sf_dir, "events").select("event_id", file.alias("file")).withColumn("recorded", F.expr(_RECORDED))


def recorded_paths(spark, sf_dir):
    """Flavour, prefix and segments of recorded paths of every kind."""
    from loomgraph.functions.paths import normalize_recorded

    return _recorded(spark, sf_dir).select("event_id", normalize_recorded(F.col("recorded")).alias("n")).select(
        "event_id", "n.flavor", "n.prefix", F.array_join("n.segments", "/").alias("segments"), "n.escaped"
    )


def correlate_repositories(spark, sf_dir):
    """Spans of eight services, seven of which are a repository; the paths are those of every repository."""
    files = _made(spark, sf_dir)[0]
    nodes = files.select("repo_id", "path", F.concat("repo_id", F.lit(":"), "path").alias("id"), F.lit("file").alias("kind"))
    services = files.select(F.replace("repo_id", F.lit("shop"), F.lit("svc")).alias("service"), "repo_id").distinct()
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), F.lit("string").alias("type"), value.alias("scalar"))
    service = F.concat(F.lit("svc"), (F.col("event_id") % 8).cast("string"))
    spans = _recorded(spark, sf_dir).select(
        "event_id", F.struct(F.array(pair("service.name", service)).alias("attributes")).alias("resource"),
        F.array(pair("code.file.path", F.col("recorded"))).alias("attributes"),
    )
    found = correlate.correlate(correlate.with_repository(spans, services), nodes, source_root="C:\\srv\\app")
    return found.select("event_id", "repo_id", F.col("source.node_id").alias("node_id"))


def text_outline(spark, sf_dir):
    """Names that the documents' lines, each made a declaration, declare."""
    from loomgraph.functions import text as texts

    said = F.concat(F.lit("class "), F.replace("text", F.lit("\n"), F.lit("\nclass ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(texts.outline(texts.lines_of(said)), ",").alias("symbols"))


QUERIES = {
    query.__name__: query
    for query in (
        workspace_facts, built_workspaces, workspace_kinds, workspace_ratio, first_unresolved, declared_things, extract_lexical, tree_filters, oversized_files, file_budgets,
        recorded_paths, correlate_repositories, text_outline,
    )
}
