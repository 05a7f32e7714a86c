"""Trees, limits, framing, missing nodes and several repositories."""

import json

import pytest

from loomgraph.operators import correlate, focus, traverse
from loomgraph.sources import otlp
from loomgraph.sources.files import cap_files, read_trees
from tests.test_traces import _doc, _import, _span


def test_tree_reader_returns_every_wanted_file(spark, tmp_path):
    names = ["pkg/__init__.py", "pkg/a.py", "pkg/__tests__/q.ts", "src/b.ts", "src/_app.tsx", "src/.hidden.ts", "top.py", "a b/ü.ts", "big.py"]
    for repo in ("one", "two"):
        for name in names:
            path = tmp_path / repo / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"x = 1\n" * (1000 if name == "big.py" else 1))
    tree = read_trees(spark, {"one": str(tmp_path / "one"), "two": f"file://{tmp_path}/two/"}, max_file_bytes=1000)
    found = {(row.repo_id, row.path) for row in tree.files.collect()}
    assert found == {(repo, name) for repo in ("one", "two") for name in names if name != "big.py"}
    for row in tree.report.collect():
        assert (row.listed, row.skipped, row.files) == (len(names), 1, len(names) - 1)


def test_trees_are_listed_folder_by_folder(spark, tmp_path):
    for at in range(60):
        (tmp_path / "src" / f"m{at}" / "deep").mkdir(parents=True)
        (tmp_path / "src" / f"m{at}" / "deep" / "a.py").write_text(f"x = {at}\n")
        (tmp_path / "src" / f"m{at}" / "node_modules" / "p").mkdir(parents=True)
        (tmp_path / "src" / f"m{at}" / "node_modules" / "p" / "no.js").write_text("")
    tree = read_trees(spark, {"one": str(tmp_path), "two": str(tmp_path / "src" / "m1")})
    assert {(row.repo_id, row.path) for row in tree.files.collect()} == {("one", f"src/m{at}/deep/a.py") for at in range(60)} | {("two", "deep/a.py")}
    assert {row.repo_id: row.files for row in tree.report.collect()} == {"one": 60, "two": 1}
    empty = read_trees(spark, {})
    assert empty.files.count() == 0 and empty.report.count() == 0


def test_budgets(spark):
    rows = [("a", f"p{at:02d}", "x" * (at + 1)) for at in range(10)] + [("b", "big", "x" * 100), ("c", "small", "x")]
    files = spark.createDataFrame(rows, "repo_id string, path string, text string")
    capped = cap_files(files, max_files=6, max_total=16)
    assert {(row.repo_id, row.path) for row in capped.files.collect()} == {("a", f"p{at:02d}") for at in range(5)} | {("c", "small")}
    assert {row.repo_id: (row.files, row.truncated) for row in capped.report.collect()} == {"a": (5, True), "b": (0, True), "c": (1, False)}
    assert cap_files(files).files.count() == 12


def test_two_documents_on_a_line_are_rejected(spark):
    one, two = _doc(_span()), _doc(_span(spanId="00000000000000ac", name="{ in } text \\\" {"))
    made = _import(spark, [one + two, two])
    assert [row.code for row in made.rejects.collect()] == ["syntax"] and made.spans.count() == 1


def test_limits_hold_only_when_given(spark):
    many = [{"key": f"k{at}", "value": {"stringValue": "x" * 20_000}} for at in range(200)]
    spans = [_span(spanId=f"{at:016x}", attributes=many if at == 1 else None) for at in range(1, 4)]
    assert _import(spark, [_doc(*spans)]).spans.count() == 3
    limited = lambda **limits: _import(spark, [_doc(*spans)], limits=limits)
    made = limited(maxAttributes=128, maxValueBytes=100, maxSpansPerTrace=5)
    assert {row.code for row in made.rejects.collect()} == {"limit"} and made.spans.count() == 2
    with pytest.raises(ValueError):
        limited(maxInvented=1)
    with pytest.raises(otlp.RuntimeImportError):
        limited(maxSpans=2)


def _links(spark, rows):
    return spark.createDataFrame([("r", "import", one, two) for one, two in rows], "repo_id string, type string, `from` string, to string")


def test_missing_nodes(spark):
    links = _links(spark, [("a", "b"), ("b", "gone"), ("gone", "c"), ("b", "c"), ("c", "d")])
    nodes = spark.createDataFrame([("r", name) for name in "abcd"], "repo_id string, id string")
    roots = spark.createDataFrame([("r", "a"), ("r", "nowhere")], "repo_id string, root string")
    reached = traverse.cone(links, roots, nodes=nodes)
    assert {(row.root, row.id, row.distance) for row in reached.collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)}
    crossed = traverse.cone_links(links, reached, nodes=nodes)
    assert {(row["from"], row.to) for row in crossed.collect()} == {("a", "b"), ("b", "c"), ("c", "d")}
    pairs = spark.createDataFrame([("r", "a", "d"), ("r", "a", "gone")], "repo_id string, source string, target string")
    paths = traverse.shortest_paths(links, pairs, nodes=nodes)
    assert [row.path for row in paths.collect()] == [["a", "b", "c", "d"]]
    steps = traverse.path_links(links, paths).orderBy("position").collect()
    assert [(row.position, row["from"], row.to) for row in steps] == [(1, "a", "b"), (2, "b", "c"), (3, "c", "d")]


@pytest.mark.parametrize("direction", ["dependencies", "dependents"])
def test_cones_of_many_roots(spark, direction):
    import random

    rng = random.Random(2)
    rows = sorted({(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(220)})
    links = _links(spark, rows)
    names = [f"n{at:03d}" for at in range(150)]
    roots = spark.createDataFrame([("r", name) for name in [*names, names[0]]] + [("other", "n000")], "repo_id string, root string")
    after = {}
    for one, two in rows:
        one, two = (one, two) if direction == "dependencies" else (two, one)
        after.setdefault(one, []).append(two)
    wanted = {("other", "n000", "n000", 0)}
    for root in names:
        far, level = {root: 0}, [root]
        while level:
            level = [two for one in level for two in after.get(one, []) if two not in far and not far.update({two: far[one] + 1})]
        wanted |= {("r", root, name, distance) for name, distance in far.items()}
    made = traverse.cone(links, roots, direction).collect()
    assert {tuple(row) for row in made} == wanted and len(made) == len(wanted)


def test_long_shortest_path(spark):
    links = _links(spark, [(f"{at:03d}", f"{at + 1:03d}") for at in range(40)])
    pairs = spark.createDataFrame([("r", "000", "040")], "repo_id string, source string, target string")
    assert len(traverse.shortest_paths(links, pairs).first().path) == 41


def test_correlation_by_repository(spark):
    def span(at, service):
        doc = json.loads(_doc(_span(spanId=f"{at:016x}", attributes=[{"key": "code.file.path", "value": {"stringValue": "src/a.ts"}}])))
        doc["resourceSpans"][0]["resource"] = {"attributes": [{"key": "service.name", "value": {"stringValue": service}}]}
        return json.dumps(doc)

    spans = _import(spark, [span(1, "shop"), span(2, "desk"), span(3, "other")]).spans
    known = spark.createDataFrame([("shop", "one"), ("desk", "two")], "service string, repo_id string")
    nodes = spark.createDataFrame(
        [("one", "n1", "file", "src/a.ts"), ("two", "n2", "file", "src/a.ts")], "repo_id string, id string, kind string, path string"
    )
    found = correlate.correlate(correlate.with_repository(spans, known), nodes).collect()
    assert {row.span_id[-1]: row.source.node_id if row.source else None for row in found} == {"1": "n1", "2": "n2", "3": None}


def test_search_without_questions(spark):
    nodes = spark.createDataFrame([("r", "n", "a", "a", "x", ["s"])], "repo_id string, id string, label string, path string, role string, symbols array<string>")
    assert focus.search(nodes, []).count() == 0


def test_escapes_and_braces_in_names(spark):
    names = ["GET /users/{id}", 'say "{', "a\\", 'b"}', "}{", "tab\t "]
    spelled = [json.dumps(name) for name in names]
    spelled[0] = spelled[0].replace("/", "\\/")
    spelled[1] = '"say \\u0022{"'
    text = [_doc(_span(spanId=f"{at + 1:016x}", name="NAME")).replace('"NAME"', said) for at, said in enumerate(spelled)]
    made = _import(spark, text)
    assert made.rejects.count() == 0
    assert [row.name for row in made.spans.orderBy("span_id").collect()] == names


def test_text_that_is_not_one_value(spark):
    good = _doc(_span())
    texts = [good + "}", good + "]", good + ",", good + " x", "[" + good, good[:-1], "", " ", good + ',"x"]', "{}" + good, '"' + good]
    made = _import(spark, texts)
    assert {row.code for row in made.rejects.collect()} == {"syntax"} and made.rejects.count() == len(texts)
    assert _import(spark, [" \n" + good + "\n "]).spans.count() == 1


def test_trace_files(spark, tmp_path):
    docs = [_doc(_span(spanId=f"{at:016x}", name=f"n{at} {{\\\" é")) for at in range(1, 41)]
    pretty = json.dumps(json.loads(docs[0]), indent=2)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "many.json").write_text("\n".join(docs[:20]) + "\n")
    (tmp_path / ".dots.jsonl").write_bytes(b"\xef\xbb\xbf" + "\r\n\r\n".join(docs[20:25]).encode())
    (tmp_path / "_hidden" / "_one.json").write_text(pretty)
    (tmp_path / "broken.json").write_text("{\n" + "\n".join(docs[25:30]))
    (tmp_path / "two.json").write_text(docs[30] + docs[31])
    (tmp_path / "empty.json").write_text("")
    wanted = sorted([*docs[:30], pretty, "{", docs[30] + docs[31]])
    for split in (50, 700, 1 << 20):
        read = otlp.read_otlp_texts(spark, str(tmp_path), split)
        rows = read.collect()
        assert sorted(row.text for row in rows) == wanted
        assert len({(row.doc_id, row.line) for row in rows}) == len(rows)
    assert otlp.read_otlp_texts(spark, str(tmp_path), 700).rdd.getNumPartitions() > 10
    alone = otlp.read_otlp_texts(spark, f"file://{tmp_path}/many.json", 1000)
    assert alone.count() == 20 and alone.rdd.getNumPartitions() >= 3
    made = otlp.import_traces(otlp.read_otlp_texts(spark, str(tmp_path), 5000))
    assert sorted(row.code for row in made.rejects.collect()) == ["syntax", "syntax"]
    assert made.report.first().duplicate_spans == 1 and made.spans.count() == 30
    empty = tmp_path / "none"
    empty.mkdir()
    assert otlp.read_otlp_texts(spark, str(empty)).count() == 0
