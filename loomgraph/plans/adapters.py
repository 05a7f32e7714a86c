"""Shape the star-schema test tables into files, import facts and spans.

Facts and code are row-local rules on `lineitem`; only the span adapter needs positions
inside a user, which it takes from `ranked` so a dominant user is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ranking import ranked
from loomgraph.session import materialize

REPO = "main"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- files ---------------------------------------------------------------------


def part_path() -> Column:
    """Path of the file a part stands for."""
    return F.expr(
        """lower(p_type) || '/' || replace(lower(p_brand), 'brand#', 'b') || '/' ||
           CASE p_size % 4 WHEN 0 THEN 'tests/' WHEN 1 THEN 'lib/' ELSE '' END ||
           replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) ||
           CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.sql' ELSE '.tsx' END"""
    )


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records without text, one per part."""
    rows = table(spark, sf_dir, "part").select(
        F.lit(REPO).alias("repo_id"), "p_partkey", part_path().alias("path"),
        (F.col("p_size") * 10).cast("bigint").alias("lines"), (F.col("p_size") * 300).cast("bigint").alias("bytes"),
        F.col("p_name"),
    )
    from loomgraph.functions import paths
    from loomgraph.operators.scan import extraction_mode

    path = F.col("path")
    return rows.select(
        "repo_id", "path", "p_partkey", paths.dir_of(path).alias("dir"), paths.name_of(path).alias("name"),
        paths.extension_of(path).alias("ext"), paths.area_of(path).alias("area"), "lines", "bytes",
        F.array("p_name").alias("excerpt"), F.split("p_name", " ").alias("symbols"),
        extraction_mode(path).alias("mode"),
    )


# --- facts -----------------------------------------------------------------------


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One import between two parts and one package import per line item.

    (src, dst, pkg, l_orderkey, l_linenumber): the target is a rule on the row, so no
    ordering inside an order is needed.
    """
    parts = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    dst = (F.col("l_partkey") + F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11) % F.col("n")
    return (
        lines.join(supplier, "l_suppkey")
        .crossJoin(F.broadcast(parts))  # a single counter row
        .select(
            F.col("l_partkey").alias("src"), dst.cast("bigint").alias("dst"), F.col("s_nationkey").alias("pkg"),
            "l_orderkey", "l_linenumber",
        )
    )


def resolved_part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in the shape the graph builder takes."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), part_path().alias("file"))
    facts = part_facts(spark, sf_dir)
    placed = (
        facts.join(names.select(F.col("key").alias("src"), F.col("file").alias("path")), "src")
        .join(names.select(F.col("key").alias("dst"), F.col("file").alias("target")), "dst")
    )
    base = placed.select(
        F.lit(REPO).alias("repo_id"), "path", "target", "pkg", "dst",
        F.col("l_orderkey").cast("int").alias("start_line"), F.col("l_linenumber").cast("int").alias("end_line"),
    )
    both = base.select(
        "repo_id", "path", "start_line", "end_line",
        F.explode(
            F.array(
                F.struct(
                    F.lit("internal").alias("res_kind"), F.col("target").alias("res_value"),
                    F.concat(F.lit("import m"), F.col("dst")).alias("statement"),
                    F.concat(F.lit("m"), F.col("dst")).alias("spec"),
                ),
                F.struct(
                    F.lit("external").alias("res_kind"), F.concat(F.lit("nation_"), F.col("pkg")).alias("res_value"),
                    F.concat(F.lit("import nation_"), F.col("pkg")).alias("statement"),
                    F.concat(F.lit("nation_"), F.col("pkg")).alias("spec"),
                ),
            )
        ).alias("f"),
    )
    return both.select(
        "repo_id", "path", "f.spec", "f.statement", F.lit("static").alias("kind"), "start_line", "end_line",
        F.lit("table-adapter").alias("extractor"),
        F.when(F.col("end_line") == 7, "heuristic").otherwise("exact").alias("confidence"),
        "f.res_kind", "f.res_value",
    )


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct non-self import links between files, unfolded."""
    return (
        part_facts(spark, sf_dir).filter("src <> dst").select("src", "dst").distinct()
        .select(
            F.lit(REPO).alias("repo_id"), F.lit("import").alias("type"),
            F.lpad(F.col("src").cast("string"), 9, "0").alias("from"), F.lpad(F.col("dst").cast("string"), 9, "0").alias("to"),
        )
    )


# --- code --------------------------------------------------------------------------


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated sources: a module per part, and a file per line item that imports some.

    A line item's file is written in the language its target can be imported from.
    """
    part = table(spark, sf_dir, "part")
    counter = part.agg(F.count("*").alias("n"))
    module = F.expr("'mods/g' || CAST(p_partkey % 50 AS STRING) || '/m' || CAST(p_partkey AS STRING)")
    modules = part.select(
        F.lit(REPO).alias("repo_id"),
        F.concat(module, module_extension(F.col("p_partkey"))).alias("path"),
        F.concat(F.lit("export const size = "), F.col("p_size"), F.lit("\n")).alias("text"),
    )
    users = (
        table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(counter))  # a single counter row
        .withColumn("dst", (F.col("l_partkey") + F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11) % F.col("n"))
        .select(
            F.lit(REPO).alias("repo_id"),
            user_path().alias("path"),
            F.concat(
                F.expr(
                    """CASE dst % 3
                       WHEN 0 THEN '/* generated\\n   import { no } from "./no" */\\nimport {\\n  m,\\n} from "../../mods/g'
                         || CAST(dst % 50 AS STRING) || '/m' || CAST(dst AS STRING) || CASE WHEN dst % 2 = 0 THEN '"' ELSE '.js"' END
                         || '\\nimport x from "nation_' || CAST(l_suppkey % 25 AS STRING) || '"; import fs from "node:fs"\\n'
                       WHEN 1 THEN '# generated\\nfrom mods.g' || CAST(dst % 50 AS STRING) || '.m' || CAST(dst AS STRING)
                         || ' import (\\n    one,  # first\\n    two as too,\\n)\\nimport nation_' || CAST(l_suppkey % 25 AS STRING) || '\\n'
                       ELSE 'use std::fmt;\\nuse crate::mods::g' || CAST(dst % 50 AS STRING) || '::{m' || CAST(dst AS STRING)
                         || '::{Thing}};\\n' END"""
                )
            ).alias("text"),
        )
    )
    crate = spark.range(1).select(
        F.lit(REPO).alias("repo_id"), F.lit("lib.rs").alias("path"), F.lit("mod mods;\n").alias("text")
    )
    return modules.unionByName(users.dropDuplicates(["path"])).unionByName(crate)


def module_extension(key: Column) -> Column:
    return F.when(key % 3 == 0, ".ts").when(key % 3 == 1, ".py").otherwise(".rs")


def user_path() -> Column:
    return F.expr(
        """'orders/o' || CAST(l_orderkey % 100 AS STRING) || '/l' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING)
           || '_' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING)
           || CASE dst % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.rs' END"""
    )


# --- texts ---------------------------------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of several areas and extensions; some paths must be ignored."""
    path = F.expr(
        """CASE doc_id % 11 WHEN 0 THEN './' WHEN 1 THEN 'dist/' ELSE '' END || source || '/' || lang || '/d' ||
           CAST(doc_id AS STRING) ||
           CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.md' WHEN 3 THEN '.sql' ELSE '.vue' END"""
    )
    return table(spark, sf_dir, "documents").select(
        F.lit(REPO).alias("repo_id"), path.alias("path"), "text"
    )


# --- spans -----------------------------------------------------------------------------


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per user, one span per event, with roots, orphans and two-span cycles."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    numbered = ranked(events, ["user_id"], [F.col("ts"), F.col("event_id")], "n")
    parent = F.expr(
        """CASE WHEN n = 1 THEN NULL WHEN n % 37 = 0 THEN -1 WHEN n % 29 = 0 THEN n + 1
                WHEN n % 29 = 1 THEN n - 1 WHEN n % 31 = 0 THEN NULL ELSE CAST(floor(n / 2) AS BIGINT) END"""
    )
    children = numbered.withColumn("pn", parent)
    parents = numbered.select("user_id", F.col("n").alias("pn"), F.col("event_id").alias("parent_event"))
    span = lambda column: F.lpad((F.col(column) + 1).cast("string"), 16, "0")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    spans = children.join(parents, ["user_id", "pn"], "left").select(
        F.lpad((F.col("user_id") + 1).cast("string"), 32, "0").alias("trace_id"),
        span("event_id").alias("span_id"),
        F.when(F.col("pn").isNotNull(), F.coalesce(span("parent_event"), F.lit("9999999999999999"))).alias("parent_span_id"),
        F.col("event_type").alias("service"),
        F.col("event_type").alias("name"),
        F.expr("CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END").alias("status_code"),
        start.alias("start_ns"),
        (start + F.round(F.col("value") * 1000000).cast("bigint")).alias("end_ns"),
        (F.col("event_id") % 2).cast("int").alias("flags"),
        "event_id",
    )
    return materialize(spans)


def recorded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans whose attributes name a part's file in several spellings."""
    counter = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    names = table(spark, sf_dir, "part").select("p_partkey", part_path().alias("file"))
    events = (
        table(spark, sf_dir, "events").select("event_id")
        .crossJoin(F.broadcast(counter))  # a single counter row
        .withColumn("p_partkey", F.col("event_id") * 13 % F.col("n"))
        .join(names, "p_partkey")
    )
    recorded = F.expr(
        """CASE event_id % 6 WHEN 0 THEN file WHEN 1 THEN './x/../' || file WHEN 2 THEN '/srv/app/' || file
           WHEN 3 THEN '/srv/other/' || file WHEN 4 THEN '../' || file ELSE replace(file, '/', '\\\\') END"""
    )
    kind = "type string, text string, scalar string"
    pair = lambda key, tag, value: F.struct(
        key.alias("key"), F.lit(tag).alias("type"), F.lit("").alias("text"), value.alias("scalar")
    )
    old = F.col("event_id") % 4 == 0
    named = pair(F.when(old, "code.filepath").otherwise("code.file.path"), "string", recorded)
    line = pair(F.lit("code.line.number"), "int", (F.col("event_id") % 50 - 3).cast("string"))
    function = pair(F.lit("code.function"), "string", F.concat(F.lit("fn"), F.col("event_id")))
    return events.select("event_id", F.array(named, line, function).cast(f"array<struct<key string, {kind}>>").alias("attributes"))


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OTLP JSON document per event; some repeat a span, some break a rule.

    Events whose id ends in 3 appear twice unchanged, those ending in 77 twice with different
    names (a conflict); ids divisible by 53 end before they start, by 59 have a bad id.
    """
    base = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    copies = F.expr("CASE WHEN event_id % 10 = 3 OR event_id % 100 = 77 THEN 2 ELSE 1 END")
    rows = base.withColumn("start", start).withColumn(
        "end", start + F.round(F.col("value") * 1000000).cast("bigint") * F.expr("CASE WHEN event_id % 53 = 0 THEN -1 ELSE 1 END")
    ).select("*", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
    text = F.expr(
        """'{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"' || event_type ||
           '"}},{"key":"Password","value":{"stringValue":"p' || event_id || '"}}]},"scopeSpans":[{"scope":{"name":"lib"},"spans":[{"traceId":"' ||
           CASE WHEN event_id % 59 = 0 THEN 'zz' ELSE lpad(CAST(user_id + 1 AS STRING), 32, '0') END || '","spanId":"' ||
           lpad(CAST(event_id + 1 AS STRING), 16, '0') || '","name":"' || event_type ||
           CASE WHEN event_id % 100 = 77 THEN CAST(copy AS STRING) ELSE '' END || '","kind":' || (event_id % 6) ||
           ',"flags":' || (event_id % 2) || ',"startTimeUnixNano":"' || start || '","endTimeUnixNano":"' || end ||
           '","attributes":[{"key":"n","value":{"intValue":"' || event_id || '"}},{"key":"list","value":{"arrayValue":{"values":[{"boolValue":true},{"stringValue":"' ||
           event_type || '"}]}}},{"key":"kv","value":{"kvlistValue":{"values":[{"key":"token","value":{"stringValue":"t"}},{"key":"a","value":{"intValue":1}}]}}}],' ||
           '"droppedEventsCount":' || (event_id % 3) || ',"events":[{"timeUnixNano":"' || start || '","name":"e"}],"status":{"code":' ||
           CASE event_type WHEN 'error' THEN '2' WHEN 'purchase' THEN '1' ELSE '0' END || '}' ||
           CASE WHEN event_id % 7 = 0 THEN ',"extra":1' ELSE '' END || '}]}]}]}'"""
    )
    return rows.select(
        F.concat(F.lit("e"), F.col("event_id"), F.lit("-"), F.col("copy")).alias("doc_id"), F.lit(0).cast("bigint").alias("line"),
        text.alias("text"),
    )


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OTLP document per order: a list in a list, up to seven levels, around a pair list with a secret."""
    text = F.expr(
        """'{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"' || lpad(CAST(o_custkey + 1 AS STRING), 32, '0') || '","spanId":"' ||
           lpad(CAST(o_orderkey + 1 AS STRING), 16, '0') || '","name":"order","startTimeUnixNano":"1","endTimeUnixNano":"2","attributes":[{"key":"deep","value":' ||
           repeat('{"arrayValue":{"values":[{"doubleValue":0.5},', CAST(o_orderkey % 7 AS INT)) ||
           '{"kvlistValue":{"values":[{"key":"token","value":{"stringValue":"t' || o_orderkey || '"}},{"key":"a\\\\"{","value":{"stringValue":"' || o_orderpriority || '"}}]}}' ||
           repeat(']}}', CAST(o_orderkey % 7 AS INT)) || '}]}]}]}]}'"""
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("doc_id"), F.lit(0).cast("bigint").alias("line"), text.alias("text")
    )


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OTLP document per order, a trace per customer: events with attributes, links to the order before and after.

    Links of orders divisible by 5 lead out of the import; status 2 is that of orders divisible by 4.
    """
    event = (
        """'{"timeUnixNano":"' || (o_orderkey * 10 + e) || '","name":"e' || e || '","droppedAttributesCount":' || e ||
           ',"attributes":[{"key":"secret","value":{"stringValue":"s"}},{"key":"n","value":{"intValue":' || e || '}},{"key":"prio","value":{"stringValue":"' || o_orderpriority || '"}}]}'"""
    )
    link = (
        """'{"traceId":"' || lpad(CAST(o_custkey + 1 AS STRING), 32, '0') || '","spanId":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'ffffffffffffffff' ELSE lpad(CAST(o_orderkey + 1 + l AS STRING), 16, '0') END ||
           '","traceState":"s' || l || '","flags":1,"attributes":[{"key":"kind","value":{"boolValue":true}}]}'"""
    )
    text = F.expr(
        f"""'{{"resourceSpans":[{{"scopeSpans":[{{"spans":[{{"traceId":"' || lpad(CAST(o_custkey + 1 AS STRING), 32, '0') || '","spanId":"' ||
           lpad(CAST(o_orderkey + 1 AS STRING), 16, '0') || '","name":"order","startTimeUnixNano":"1","endTimeUnixNano":"2","status":{{"code":' || CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 0 END ||
           '}},"events":[' || array_join(transform(sequence(1, 1 + CAST(o_orderkey % 3 AS INT)), e -> {event}), ',') ||
           '],"links":[' || array_join(transform(sequence(0, CAST(o_orderkey % 2 AS INT)), l -> {link}), ',') || ']}}]}}]}}]}}'"""
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("doc_id"), F.lit(0).cast("bigint").alias("line"), text.alias("text")
    )
