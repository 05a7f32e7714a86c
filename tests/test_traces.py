"""Forests, import and correlation on literal traces."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import correlate, forest, views
from loomgraph.sources import otlp

SPAN = "trace_id string, span_id string, parent_span_id string, start_ns bigint, end_ns bigint, status_code int"


def _forest(spark, rows):
    return forest.build_forest(spark.createDataFrame(rows, SPAN))


def test_relations_and_cycle_breaks(spark):
    rows = [("t", "1", None, 0, 1, 0), ("t", "2", "1", 0, 1, 0), ("t", "4", "9", 0, 1, 0),
            ("t", "5", "6", 0, 1, 0), ("t", "6", "5", 0, 1, 0), ("t", "7", "8", 0, 1, 0), ("t", "8", "7", 0, 1, 0),
            ("u", "3", "3", 0, 1, 0), ("u", "2", "3", 0, 1, 0)]
    got = {(r.trace_id, r.span_id): r.relation for r in _forest(spark, rows).spans.collect()}
    assert got == {
        ("t", "1"): "root", ("t", "2"): "child", ("t", "4"): "orphan", ("t", "5"): "child", ("t", "6"): "cycle-broken",
        ("t", "7"): "child", ("t", "8"): "cycle-broken", ("u", "3"): "cycle-broken", ("u", "2"): "child",
    }


def test_tied_paths(spark):
    rows = [("t", "1", None, 0, 10, 0), ("t", "9", None, 5, 10, 0), ("t", "2", "1", 0, 5, 2),
            ("t", "3", "1", 0, 3, 2), ("t", "4", "2", 0, 5, 2)]
    tree = _forest(spark, rows)
    assert [r.path for r in forest.hot_paths(tree).collect()] == [["1", "2", "4"]]
    assert [r.path for r in forest.error_paths(tree).orderBy("rank").collect()] == [["1", "3"], ["1", "2", "4"], ["1", "2"]]


def test_no_true_root(spark):
    rows = [("t", "1", "0", 0, 1, 0), ("t", "2", "1", 0, 1, 2), ("t", "3", "4", 0, 2, 2), ("t", "4", "3", 0, 9, 0)]
    tree = _forest(spark, rows)
    assert forest.hot_paths(tree).isEmpty()
    assert [r.path for r in forest.error_paths(tree).orderBy("rank").collect()] == [["1", "2"], ["4", "3"]]


def _random_rows(n, seed):
    import random

    pick = random.Random(seed)
    rows = []
    for i in range(n):
        roll = pick.random()
        parent = None if roll < 0.08 else "zz" if roll < 0.12 else f"{pick.randrange(n):03d}"
        start = pick.randrange(50)
        rows.append(("t", f"{i:03d}", parent, start, start + pick.randrange(4), 2 if pick.random() < 0.3 else 0))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = _random_rows(120, seed)
    by_id = {r[1]: r for r in rows}
    parent = {r[1]: r[2] if r[2] in by_id else None for r in rows}
    cuts = set()
    for start in parent:
        seen, at = [], start
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        if at is not None:
            cuts.add(max(seen[seen.index(at):]))
    derived = {s: None if s in cuts else p for s, p in parent.items()}

    def trail(s):
        out = []
        while s is not None:
            out.append(s)
            s = derived[s]
        return out[::-1]

    tree = _forest(spark, rows)
    got = {r.span_id: (r.relation == "cycle-broken", r.depth, r.top_span_id) for r in tree.spans.collect()}
    assert got == {s: (s in cuts, len(trail(s)), trail(s)[0]) for s in parent}
    key = lambda s: [(by_id[i][3], by_id[i][4], i) for i in trail(s)]
    kind = lambda s: "root" if by_id[s][2] is None else "cycle-broken" if s in cuts else "orphan"
    for name in ("root", "orphan", "cycle-broken"):
        want = sorted((s for s in parent if kind(trail(s)[0]) == name), key=key)
        rows_got = [r for r in forest.call_tree(tree).filter(F.col("forest") == name).orderBy("position").collect()]
        assert [r.span_id for r in rows_got] == want


@pytest.mark.parametrize("cell", [3, 64])
def test_ancestors_and_descendants(spark, monkeypatch, cell):
    monkeypatch.setattr(forest, "CELL", cell)
    tree = _forest(spark, _random_rows(80, 5) + [("u", "1", None, 0, 9, 0), ("u", "2", "1", 3, 4, 0), ("u", "3", "1", 1, 2, 0), ("u", "4", "3", 1, 2, 0)])
    rows = {(row.trace_id, row.span_id): row for row in tree.spans.collect()}
    children = {}
    for (trace, span), row in rows.items():
        children.setdefault((trace, row.derived_parent), []).append(span)
    order = lambda trace: lambda span: (rows[trace, span].start_ns, rows[trace, span].end_ns, span)
    up, below = {}, {}
    for trace, span in rows:
        path, at = [], rows[trace, span].derived_parent
        while at is not None:
            path.insert(0, at)
            at = rows[trace, at].derived_parent
        up[trace, span] = path
        found, level = [], [span]
        while level:
            level = [child for one in level for child in sorted(children.get((trace, one), []), key=order(trace))]
            found += level
        below[trace, span] = found
    numbered = forest.number_spans(tree)
    got = {}
    for row in forest.ancestors(tree, tree.spans).orderBy("position").collect():
        got.setdefault((row.trace_id, row.span_id), []).append(row.ancestor)
    assert got == {key: path for key, path in up.items() if path}
    got = {}
    for row in forest.descendants(numbered, tree.spans).orderBy("depth", "position").collect():
        got.setdefault((row.trace_id, row.span_id), []).append(row.descendant)
    assert got == {key: found for key, found in below.items() if found}
    some = spark.createDataFrame([("u", "1"), ("u", "nowhere"), ("u", "1")], "trace_id string, span_id string")
    assert [row.descendant for row in forest.descendants(numbered, some).orderBy("depth", "position").collect()] == ["3", "2", "4"]


def test_deep_chain(spark):
    n = 20000
    chain = spark.range(n).selectExpr(
        "'t' trace_id", "lpad(id, 6, '0') span_id", "CASE WHEN id > 0 THEN lpad(id - 1, 6, '0') END parent_span_id",
        "id start_ns", "id + 1 end_ns", f"CASE WHEN id = {n - 1} THEN 2 ELSE 0 END status_code",
    )
    tree = forest.build_forest(chain)
    assert len(forest.hot_paths(tree).first().path) == n
    assert len(forest.error_paths(tree).first().path) == n
    # every span failed: ranks are rows, no path is built
    failed = forest.Forest(tree.spans.withColumn("status_code", F.lit(2)).withColumn("end_ns", F.lit(5)), tree.levels)
    ranks = forest.error_ranks(failed).orderBy("rank").collect()
    assert [row.depth for row in ranks] == list(range(n, 0, -1))
    assert forest.call_tree(tree).filter("position = depth").count() == n


def _span(**over):
    base = {"traceId": "ab" * 16, "spanId": "00000000000000ab", "name": "n", "startTimeUnixNano": "5", "endTimeUnixNano": 9}
    return {k: v for k, v in {**base, **over}.items() if v is not None}


def _doc(*spans, **resource):
    return json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": list(spans)}]}]})


def _import(spark, texts, **kw):
    rows = [(f"d{i}", t) for i, t in enumerate(texts)]
    return otlp.import_traces(otlp.frame_texts(spark.createDataFrame(rows, "doc_id string, text string")), **kw)


def test_import_rejects_by_code(spark):
    value = {"stringValue": "x"}
    for _ in range(9):
        value = {"arrayValue": {"values": [value]}}
    ids = iter(range(1, 100))
    span = lambda **over: _span(**{"spanId": f"{next(ids):016x}", **over})
    texts = [
        _doc(span()), "{", _doc(span(endTimeUnixNano="4")), _doc(span(traceId="0" * 32)), _doc(span(name="")),
        _doc(span(attributes=[{"key": "a", "value": value}])), _doc(span(kind=6)),
        _doc(span(attributes=[{"key": "a", "value": {"intValue": 1}}, {"key": "a", "value": {"intValue": 2}}])),
        _doc(span(startTimeUnixNano="18446744073709551615", endTimeUnixNano="18446744073709551615")),
        json.dumps({"resourceSpans": [], "resourceLogs": []}),
        _doc(_span(spanId="f" * 16), _span(spanId="f" * 16, name="other")),
        _doc(_span(spanId="e" * 16)) + "\n" + _doc(_span(spanId="e" * 16)),
    ]
    made = _import(spark, texts)
    codes = sorted(r.code for r in made.rejects.collect())
    assert codes == sorted(["syntax", "time", "identity", "schema", "limit", "schema", "schema", "schema", "conflict"])
    assert made.spans.count() == 3
    report = made.report.first()
    assert report.duplicate_spans == 1 and report.spans == 3
    with pytest.raises(otlp.RuntimeImportError):
        _import(spark, texts[:2], mode="strict")


def test_redaction_reaches_nested_lists(spark):
    inner = {"kvlistValue": {"values": [{"key": "PassWord", "value": {"stringValue": "hush"}}, {"key": "k", "value": {"intValue": "7"}}]}}
    deep = {"arrayValue": {"values": [{"arrayValue": {"values": [inner]}}]}}
    made = _import(spark, [_doc(_span(attributes=[{"key": "d", "value": deep}, {"key": "Cookie", "value": {"stringValue": "hush"}}]))])
    row = made.spans.first()
    assert "hush" not in str(row) and "redacted" in str(row)
    assert made.report.first().redacted_attributes == 2


def test_deep_values(spark):
    inner = {"kvlistValue": {"values": [{"key": "PassWord", "value": {"stringValue": "hush"}}, {"key": "a\"", "value": {"bytesValue": "YQ=="}}, {"key": "B", "value": {"boolValue": True}}]}}
    value = inner
    for at in range(28):
        value = {"arrayValue": {"values": [{"intValue": str(at)}, value]}} if at % 2 else {"kvlistValue": {"values": [{"key": "k{", "value": value}]}}
    doc = _doc(_span(attributes=[{"key": "d", "value": value}, {"key": "e", "value": {"arrayValue": {}}}], events=[{"timeUnixNano": 1, "name": "x", "attributes": [{"key": "token", "value": inner}]}]))
    assert [row.code for row in _import(spark, [doc]).rejects.collect()] == ["limit"]
    made = _import(spark, [doc], limits={"maxAttributeDepth": 30})
    assert made.report.first().redacted_attributes == 3
    found = made.spans.select(F.posexplode("attributes").alias("nth", "a")).select("nth", F.to_json("a.value").alias("json"), otlp.value_text(F.col("a.value"), 30).alias("text")).orderBy("nth").collect()
    held, said = json.loads(found[0].json), found[0].text
    for at in reversed(range(28)):
        if at % 2:
            assert held["type"] == "array" and held["value"][0] == {"type": "int", "value": str(at)}
            held = held["value"][1]
        else:
            assert held["type"] == "kvlist" and held["value"][0]["key"] == "k{"
            held = held["value"][0]["value"]
    assert held == {"type": "kvlist", "value": [
        {"key": "B", "value": {"type": "bool", "value": True}}, {"key": "PassWord", "value": {"type": "redacted"}}, {"key": 'a"', "value": {"type": "bytes", "value": "YQ=="}}]}
    assert 'kvlist([{key:"B", value:bool(true)}, {key:"PassWord", value:redacted}, {key:"a\\"", value:bytes("YQ==")}])' in said and said.startswith('array([int(27), kvlist([{key:"k{", value:array([')
    assert json.loads(found[1].json) == {"type": "array", "value": []} and found[1].text == "array([])"
    event = made.spans.select(F.to_json(F.col("events")[0]["attributes"][0]["value"]).alias("json")).first()
    assert json.loads(event.json) == {"type": "redacted"}


def test_messages_are_opened_once(spark, monkeypatch):
    from loomgraph.functions import vocabulary as V

    odd = [{"key": "a", "value": 5}, {"key": "b", "value": {"intValue": None}}, {"key": "c", "value": {"arrayValue": 1}}, {"value": {"boolValue": True}}]
    texts = [_doc(_span(spanId=f"{i + 1:016x}", attributes=[entry])) for i, entry in enumerate(odd)]
    texts += [_doc(_span(events={})), _doc(_span(spanId="a" * 16, status=1)), _doc(_span(spanId="b" * 16, attributes=[], flags=1.5))]
    texts += [_doc(_span(spanId="c" * 16, events=[{"timeUnixNano": "1", "name": "e", "x": 1}], attributes=[{"key": "n", "value": {"intValue": 7.0}, "y": 0}]))]
    made = _import(spark, texts)
    assert sorted((row.doc_id, row.code) for row in made.rejects.collect()) == [(f"d{i}", "schema") for i in range(7)]
    assert {row.path for row in made.unknown_fields.collect()} == {
        "resourceSpans[].scopeSpans[].spans[].events[].x", "resourceSpans[].scopeSpans[].spans[].attributes[].y"
    }
    assert made.spans.select(F.col("attributes")[0]["scalar"].alias("n")).first().n == "7"

    lookups, look = [], F.try_variant_get
    monkeypatch.setattr(otlp.F, "try_variant_get", lambda *asked: (lookups.append(asked), look(*asked))[1])
    otlp.flatten_documents(spark.createDataFrame([("d", 0, "{}")], "doc_id string, line bigint, text string"), V.IMPORT_LIMITS)
    assert 0 < len(lookups) < 400  # 711 when every reader of a field looked it up


def test_values_are_read_once(spark, monkeypatch):
    lookups, look = [], F.try_variant_get
    monkeypatch.setattr(otlp.F, "try_variant_get", lambda *asked: (lookups.append(asked), look(*asked))[1])
    text = otlp.value_text(F.expr("try_parse_json(json)"))
    assert len(lookups) == 4  # 9 when each level looked up type, key and value again
    pair = lambda key, held: {"key": key, "value": held}
    single = [{"type": "int", "value": "7"}, {"type": "redacted"}, {"type": "string", "value": "array"}, {"type": "double", "value": 0.5}]
    nested = {"type": "array", "value": [single[0], {"type": "kvlist", "value": [pair("a", single[1]), pair("b", {"type": "array", "value": []})]}]}
    rows = [(json.dumps(value),) for value in (*single, nested, {"type": "kvlist", "value": []}, 5)] + [(None,)]
    assert [row.said for row in spark.createDataFrame(rows, "json string").select(text.alias("said")).collect()] == [
        "int(7)", "redacted", 'string("array")', "double(0.5)", 'array([int(7), kvlist([{key:"a", value:redacted}, {key:"b", value:array([])}])])',
        "kvlist([])", None, None,
    ]


def _varied_documents():
    """Plain documents, and one for each of many things that a plain document does not have."""
    list_of = lambda *held: {"arrayValue": {"values": list(held)}}
    values = [
        {"stringValue": 'q"\\\t\u0007é日\U0001f600'}, {"stringValue": ""}, {"intValue": "007"}, {"intValue": str(-(2**63))}, {"intValue": str(2**63)},
        {"intValue": 12}, {"intValue": 7.0}, {"intValue": 10**16}, {"doubleValue": 0.5}, {"doubleValue": 1.0}, {"doubleValue": 1e-7}, {"doubleValue": -3},
        {"boolValue": True}, {"boolValue": 1}, {"bytesValue": "YQ=="}, {"bytesValue": "Y"}, {"arrayValue": {}}, {"arrayValue": {"values": [], "w": 1}},
        {"kvlistValue": {"values": [{"key": "b", "value": {"boolValue": False}}, {"key": "PassWord", "value": list_of({"intValue": 1, "u": 2})}]}},
        list_of(list_of({"stringValue": "x"}), {"doubleValue": 2.25}), {"stringValue": "a", "intValue": 1}, {"stringValue": None}, {}, 5,
        list_of(list_of(list_of(list_of({"intValue": 1})))), {"stringValue": "s" * 13}, {"stringValue": "s", "more": {"a": 1}},
    ]
    spans = [_span(attributes=[{"key": "k", "value": value}, {"key": "a", "value": {"intValue": 1}, "y": 0}]) for value in values]
    pair = lambda key: {"key": key, "value": {"intValue": 1}}
    spans += [_span(attributes=found) for found in ([pair("a"), pair("a")], [pair("é")], [pair("")], [{"key": "a"}], [pair("b"), pair("a"), pair("Token")], {}, [1])]
    spans += [_span(**over) for over in (
        {"traceId": "0" * 32}, {"traceId": "AB" * 16}, {"spanId": "é" * 16}, {"spanId": "1"}, {"endTimeUnixNano": 4}, {"endTimeUnixNano": -1}, {"name": ""}, {"name": 5},
        {"parentSpanId": ""}, {"parentSpanId": "00000000000000AC"}, {"flags": 257}, {"flags": 1.5}, {"kind": 6}, {"kind": True}, {"status": {"code": 2, "message": "m", "w": 1}},
        {"status": {"code": 3}}, {"status": 1}, {"extra": 1}, {"extra": [1]}, {"droppedLinksCount": "4294967296"}, {"droppedEventsCount": "3"}, {"traceState": "s"},
        {"startTimeUnixNano": str(2**64 - 1), "endTimeUnixNano": str(2**64 - 1)}, {"links": {}}, {"spanId": "1", "endTimeUnixNano": 4},
        {"events": [{"timeUnixNano": "1", "name": "e", "x": 1, "attributes": [pair("n")], "droppedAttributesCount": 2}] * 3}, {"events": [{"name": "e"}]},
        {"links": [{"traceId": "ab" * 16, "spanId": "AC" * 8, "flags": 1, "traceState": "t", "attributes": [pair("cookie")]}] * 2}, {"links": [{"traceId": "ab" * 16, "spanId": "1"}]},
    )]
    scoped = lambda *held: {"resource": {"attributes": [pair("token"), pair("r")], "q": 1}, "schemaUrl": "u", "scopeSpans": list(held)}
    some = {"scope": {"name": "n", "version": "1", "droppedAttributesCount": "2", "attributes": [pair("s")]}, "spans": [_span(), _span(spanId="1")], "z": "é"}
    whole = [{"resourceSpans": [scoped(some, some), scoped(some)], "top": 1}, {"resourceSpans": []}, {"resourceSpans": [scoped()]}, {"resourceSpans": [scoped({"spans": []})]},
             {"resourceSpans": [{"resource": {"attributes": [pair("x" * 13)]}, "scopeSpans": [some]}]}, {"resourceSpans": [scoped(some)], "resourceLogs": 1}, [], 5]
    texts = [json.dumps(document, ensure_ascii=False) for document in whole] + [_doc(span) for span in spans]
    plain = texts[-1]
    return [*texts, None, "", plain + " ", plain + " 5", plain[:-1], plain.replace('"name"', '"name": "m", "name"'), json.dumps(json.loads(plain), indent=1)]


@pytest.mark.parametrize("limits", [{}, {"maxEventsPerSpan": 2, "maxLinksPerSpan": 1, "maxValueBytes": 12}, {"maxAttributes": 1, "maxAttributeDepth": 3, "maxInputBytes": 600}])
def test_plain_documents_are_read_in_one_pass(spark, limits):
    from loomgraph.functions import vocabulary as V
    from loomgraph.sources import trace_rows

    bounds = {**V.IMPORT_LIMITS, **limits}
    texts = _varied_documents()
    reader, plain = trace_rows.Reader(bounds), 0
    for text in texts:
        try:
            plain += len(list(reader.rows(text))) > 0
        except (ValueError, RecursionError):
            pass
    assert plain > len(texts) // 5 and plain < len(texts)
    rows = spark.createDataFrame([(f"d{i}", 0, text) for i, text in enumerate(texts)], "doc_id string, line bigint, text string")
    one_pass, columns = otlp.flatten_documents(rows, bounds), otlp.flatten_columns(rows, bounds)
    assert [(field.name, field.dataType.simpleString()) for field in one_pass.schema] == [(field.name, field.dataType.simpleString()) for field in columns.schema]

    def told(made):
        listed = made.withColumn("extras", F.array_sort("extras"))
        return sorted(row.told for row in listed.select(F.to_json(F.struct(*listed.columns)).alias("told")).collect())

    assert told(one_pass) == told(columns)


def test_correlation_flavours(spark):
    cases = {
        "src/a.ts": "src/a.ts", "./src/../src/a.ts": "src/a.ts", "/srv/app/src/a.ts": "src/a.ts", "/srv/other/src/a.ts": None,
        "../src/a.ts": None, "src\\a.ts": "src/a.ts", "C:/srv/app/src/a.ts": None, "/srv/app/../app/src/a.ts": None, "dup.ts": None,
    }
    rows = [(p, [("code.file.path", "string", "", p)]) for p in cases]
    spans = spark.createDataFrame(rows, "id string, attributes array<struct<key string, type string, text string, scalar string>>")
    nodes = spark.createDataFrame(
        [("src/a.ts", "src/a.ts", "file"), ("dup.ts", "1", "file"), ("dup.ts", "2", "file")], "path string, id string, kind string"
    )
    got = {r.id: r.source.node_id if r.source else None for r in correlate.correlate(spans, nodes, "/srv/app").collect()}
    assert got == cases


def test_filters(spark):
    rows = spark.createDataFrame(
        [("t", "1", "a", 0, 5, 2), ("t", "2", "b", 0, 1, 0), ("u", "3", "b", 0, 9, 0)],
        "trace_id string, span_id string, service string, start_ns bigint, end_ns bigint, status_code int",
    )
    shown = views.display_rows(rows, F.col("service"))
    ids = lambda df: sorted(r.span_id for r in df.collect())
    assert ids(views.visible_spans(shown, service="a")) == ["1", "3"]
    assert ids(views.visible_spans(shown, min_duration="5")) == ["1", "3"]
    assert ids(views.visible_spans(shown, min_duration="oops")) == ["1", "2", "3"]
    assert ids(views.visible_spans(shown, errors_only=True)) == ["1"]


def test_walks_that_ended_are_not_written_again(spark, monkeypatch):
    from loomgraph.operators import forest

    rows = [("t", f"r{i}", None, 1) for i in range(50)] + [("t", f"c{i}", f"c{i - 1}" if i else None, 1) for i in range(9)]
    links = spark.createDataFrame(rows, "trace_id string, span_id string, parent string, own_ns bigint")
    written, write = [], forest.materialize

    def counted(df):
        made = write(df)
        written.append(made.count())
        return made

    monkeypatch.setattr(forest, "materialize", counted)
    state = forest._double(links).state
    assert written == [8, 7, 5, 1]
    assert {r.span_id: r.steps for r in state.collect()} == {**{f"r{i}": 1 for i in range(50)}, **{f"c{i}": i + 1 for i in range(9)}}
