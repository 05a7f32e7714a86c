"""Plain SQL for the registered queries, over the same tables."""

from __future__ import annotations

from loomgraph.plans.workspace_sql import ORACLE as WORKSPACES

# Path patterns with role and contribution, first match wins.
ROLE_RULES = [
    (r"^app/.*/route\.(ts|js)$", "api endpoint", "http surface"),
    (r"^app/.*page\.(tsx|jsx|ts|js)$", "screen / route", "screen"),
    (r"^app/.*layout\.(tsx|jsx)$", "layout shell", "shell"),
    (r"^app/.*(error|not-found|loading)\.(tsx|jsx)$", "route boundary", "fallback ui"),
    (r"^(src/)?middleware\.(ts|js)$", "request gate", "edge gate"),
    (r"^(src/)?instrumentation\.(ts|js)$", "boot hook", "process init"),
    (r"^(src/)?pages/api/", "api endpoint", "http surface"),
    (r"^(src/)?pages/", "screen / route", "screen"),
    (r"^(app|server|main|__main__|manage|wsgi|asgi)\.py$", "entry point", "process entry"),
    (r"(^|/)(routes|handlers|views|endpoints)/", "route surface", "http surface"),
    (r"(^|/)(main|cmd)\.(go|rs)$", "entry point", "process entry"),
    (r"^(tests?|spec|__tests__|e2e)/", "test", "verification"),
    (r"\.(test|spec)\.[tj]sx?$", "test", "verification"),
    (r"^(src/)?hooks?/", "react hook", "client state"),
    (r"^(src/)?components?/", "ui component", "interface"),
    (r"^(src/)?(lib|services?|core|domain|server)/", "service logic", "business logic"),
    (r"^(src/)?(utils?|helpers?|shared|common)/", "utility", "support"),
    (r"^(src/)?(models?|schemas?|entities|types?)/", "data model", "shape"),
    (r"^(src/)?(api|controllers?)/", "api endpoint", "http surface"),
    (r"^(src/)?(store|state|redux|context)/", "app state", "client state"),
    (r"^(src/)?(workers?|jobs?|tasks?|queues?)/", "background job", "async work"),
    (r"\.sql$", "schema migration", "database"),
    (r"^(scripts?|bin|tools|ops)/", "ops script", "tooling"),
    (r"^(docs?|documentation)/", "document", "reference"),
    (r"^(migrations?|db|database)/", "schema migration", "database"),
    (r"\.(config|conf)\.[tjm]s$", "build config", "toolchain"),
    (r"^(next|vite|tailwind|postcss|webpack|rollup|vitest|playwright|jest)\.config\.", "build config", "toolchain"),
    (r"\.(sh|bash|zsh)$", "shell script", "tooling"),
    (r"\.(graphql|gql|proto)$", "interface schema", "contract"),
]
# Roles that fold, what known packages are, the report's metrics.
DENSE_ROLES = ["test", "document", "schema migration", "ops script"]
PACKAGE_GLOSSARY = {
    "pg": "Postgres", "postgres": "Postgres", "jose": "JWT", "react": "React", "hono": "HTTP framework",
    "axios": "HTTP client", "undici": "HTTP client", "node-fetch": "HTTP client", "node:fs": "filesystem", "fs": "filesystem",
}
METRICS = [
    "Nodes", "Source files", "Lines", "Links", "Packages", "Exact files",
    "Heuristic files", "Unsupported files", "Failed files", "Import facts", "Internal facts", "External facts",
    "System facts", "Unresolved facts", "Ignored facts", "Rolled-up files", "Hidden externals",
]
# What search_ranked asks for.
SEARCHES = ["small", "b7", "widget_1", "lib", "schema", "ring", ".tsx"]

_Q = lambda s: s.replace("'", "''")


def _role(column: str, position: int, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, '{_Q(rule[0])}') THEN '{_Q(rule[position])}'" for rule in ROLE_RULES)
    return f"CASE {whens} ELSE '{default}' END"


FILES = f"""
a AS (SELECT p_partkey, p_name, lower(p_type) AS area, CAST(p_size * 10 AS BIGINT) AS lines, CAST(p_size * 300 AS BIGINT) AS bytes,
  lower(p_type) || '/' || replace(lower(p_brand), 'brand#', 'b') || '/' ||
  CASE p_size % 4 WHEN 0 THEN 'tests/' WHEN 1 THEN 'lib/' ELSE '' END ||
  replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) ||
  CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.sql' ELSE '.tsx' END AS path FROM part),
files AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name,
  lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, {_role('path', 1, 'source module')} AS role,
  {_role('path', 2, 'logic')} AS contributes, length(path) - length(replace(path, '/', '')) AS dd FROM a)"""

FACTS = FILES + """,
raw AS (SELECT l_partkey AS src, (l_partkey + l_suppkey * 37 + l_linenumber * 11) % (SELECT count(*) FROM part) AS dst,
  s_nationkey AS pkg, l_orderkey AS ol, l_linenumber AS ln FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
facts AS (SELECT s.path, s.dir AS sdir, s.area AS sarea, t.path AS target, t.dir AS tdir, t.area AS tarea, r.* FROM raw r
  JOIN files s ON s.p_partkey = r.src JOIN files t ON t.p_partkey = r.dst),
imp AS (SELECT *, 'm' || dst AS spec, 'import m' || dst AS statement FROM facts),
links AS (SELECT DISTINCT lpad(CAST(src AS VARCHAR), 9, '0') AS f, lpad(CAST(dst AS VARCHAR), 9, '0') AS t FROM raw WHERE src <> dst),
deg AS (SELECT id, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT f AS id, 0 AS i, 1 AS o FROM links UNION ALL SELECT t, 1, 0 FROM links) GROUP BY id),
nodes AS (SELECT files.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM files LEFT JOIN deg USING (id)),
hub AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY fan_in + fan_out DESC, path, id) AS rank FROM nodes) WHERE rank <= 8)"""

# links of the unfolded graph: file to file and file to package
OPEN = FACTS + """,
flow AS (
  SELECT 'import' AS type, path AS f, target AS t, count(*) AS obs, min(ol * 100 + ln) AS pos, min_by(statement, ol * 100000000000 + ln * 1000000000) AS st0
  FROM imp WHERE path <> target GROUP BY path, target
  UNION ALL SELECT 'external', path, 'ext:nation_' || pkg, count(*), min(ol * 100 + ln), 'import nation_' || min(pkg) FROM imp GROUP BY path, pkg),
odeg AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT f AS id, 0 AS i, 1 AS o FROM flow UNION ALL SELECT t, 1, 0 FROM flow) GROUP BY id),
mr AS (SELECT area, role FROM (SELECT area, role, row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, role) AS rn FROM files GROUP BY area, role) WHERE rn = 1),
onodes AS (
  SELECT path AS id, name AS label, path AS npath, 'file' AS kind, area, role, lines, bytes, CAST(NULL AS BIGINT) AS items FROM files
  UNION ALL SELECT 'dir:' || area, area, area, 'dir', area, CASE WHEN role IN ('screen / route', 'api endpoint') THEN 'route surface' ELSE role END, l, b, n
    FROM (SELECT area, sum(lines) AS l, sum(bytes) AS b, count(*) AS n FROM files GROUP BY area) JOIN mr USING (area)
  UNION ALL SELECT 'ext:nation_' || pkg, 'nation_' || pkg, 'nation_' || pkg, 'external', 'dependencies', 'external dependency', 0, 0, NULL FROM (SELECT DISTINCT pkg FROM raw)),
full_nodes AS (SELECT n.*, coalesce(i, 0) AS fin, coalesce(o, 0) AS fout FROM onodes n LEFT JOIN odeg d ON d.id = n.id)"""

_DENSE = ", ".join(f"'{r}'" for r in DENSE_ROLES)
PLAN = FACTS + f""",
share AS (SELECT area, avg(CASE WHEN role IN ({_DENSE}) THEN 1.0 ELSE 0.0 END) AS share, count(*) AS files,
  count(*) FILTER (WHERE dd <= 1) AS loose, count(*) FILTER (WHERE dd = 1) + max(CASE WHEN dd > 1 THEN 1 ELSE 0 END) - 1 AS saves FROM files GROUP BY area),
base AS (SELECT f.*, s.share >= 0.7 AS dense FROM files f JOIN share s USING (area)),
grp AS (SELECT d, CASE WHEN dense THEN CASE WHEN dd > 0 THEN area END WHEN dd > d THEN array_to_string(list_slice(string_split(path, '/'), 1, d), '/') END AS g
  FROM base, (VALUES (1), (2), (3), (4)) v(d)),
vis AS (SELECT d, count(*) FILTER (WHERE g IS NULL) + count(DISTINCT g) AS visible FROM grp GROUP BY d),
res AS (SELECT (SELECT count(*) FROM share) + least(40, (SELECT count(DISTINCT pkg) FROM raw)) AS reserved),
fit AS (SELECT max(CASE WHEN visible + reserved <= 220 THEN d END) AS fit, min_by(visible, d) AS v1, any_value(reserved) AS reserved FROM vis, res),
elig AS (SELECT area, coalesce(sum(saves) OVER (ORDER BY round(share, 9) DESC, loose DESC, area ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM share WHERE share < 0.7 AND loose > 1),
plan AS (SELECT s.area, coalesce(fit, 1) AS depth, s.share >= 0.7 OR (fit IS NULL AND e.area IS NOT NULL AND (reserved > 220 OR v1 - e.before + reserved > 220)) AS dense, s.share, s.files
  FROM share s CROSS JOIN fit LEFT JOIN elig e ON e.area = s.area),
vis_id AS (SELECT f.path, f.area, f.role, f.lines, f.bytes, CASE WHEN p.dense THEN CASE WHEN dd > 0 THEN f.area END
  WHEN dd > p.depth THEN array_to_string(list_slice(string_split(f.path, '/'), 1, p.depth), '/') END AS g FROM files f JOIN plan p ON p.area = f.area),
vid AS (SELECT *, coalesce('dir:' || g, path) AS vid FROM vis_id),
local_n AS (SELECT count(DISTINCT vid) + (SELECT count(*) FROM share WHERE area NOT IN (SELECT g FROM vid WHERE g IS NOT NULL)) AS n FROM vid),
ext AS (SELECT * FROM (SELECT 'nation_' || pkg AS name, count(*) AS hits, row_number() OVER (ORDER BY count(*) DESC, 'nation_' || pkg) AS rank FROM raw GROUP BY pkg)
  WHERE rank <= 40 AND rank <= greatest(220 - (SELECT n FROM local_n), 0)),
vfacts AS (SELECT 'import' AS type, s.vid AS f, t.vid AS t, i.ln, i.path, i.ol, i.spec, i.statement FROM imp i JOIN vid s ON s.path = i.path JOIN vid t ON t.path = i.target
  UNION ALL SELECT 'external', s.vid, 'ext:nation_' || pkg, i.ln, i.path, i.ol, 'nation_' || pkg, 'import nation_' || pkg FROM imp i JOIN vid s ON s.path = i.path
    WHERE 'nation_' || pkg IN (SELECT name FROM ext)),
vlinks AS (SELECT type, f, t, count(*) AS obs, CASE WHEN bool_and(ln <> 7) THEN 'exact' ELSE 'heuristic' END AS conf FROM vfacts WHERE f <> t GROUP BY type, f, t)"""

SPANS = """
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT *, CASE WHEN n = 1 THEN NULL WHEN n % 37 = 0 THEN -1 WHEN n % 29 = 0 THEN n + 1 WHEN n % 29 = 1 THEN n - 1
  WHEN n % 31 = 0 THEN NULL ELSE CAST(floor(n / 2) AS BIGINT) END AS pn FROM e),
spans AS (SELECT lpad(CAST(c.user_id + 1 AS VARCHAR), 32, '0') AS trace_id, lpad(CAST(c.event_id + 1 AS VARCHAR), 16, '0') AS span_id,
  CASE WHEN c.pn IS NULL THEN NULL ELSE coalesce(lpad(CAST(q.event_id + 1 AS VARCHAR), 16, '0'), '9999999999999999') END AS parent,
  c.event_type AS service, CASE c.event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS code,
  epoch_us(c.ts) * 1000 AS start_ns, epoch_us(c.ts) * 1000 + CAST(round(c.value * 1000000) AS BIGINT) AS end_ns
  FROM p c LEFT JOIN p q ON c.user_id = q.user_id AND c.pn = q.n)"""

# cycles: walk up from every span; a span that meets itself is on a cycle, cut at the greatest id
TREE = SPANS + """,
up(trace_id, span_id, cur, big, steps) AS (
  SELECT s.trace_id, s.span_id, s.parent, s.parent, 1 FROM spans s JOIN spans q ON q.trace_id = s.trace_id AND q.span_id = s.parent
  UNION ALL SELECT u.trace_id, u.span_id, s.parent, greatest(u.big, s.parent), u.steps + 1 FROM up u JOIN spans s ON s.trace_id = u.trace_id AND s.span_id = u.cur
    JOIN spans q ON q.trace_id = s.trace_id AND q.span_id = s.parent WHERE u.cur <> u.span_id AND u.steps < 40),
cuts AS (SELECT DISTINCT trace_id, span_id FROM up WHERE cur = span_id AND big = span_id),
rel AS (SELECT s.*, CASE WHEN s.parent IS NULL THEN 'root' WHEN c.span_id IS NOT NULL THEN 'cycle-broken'
    WHEN q.span_id IS NULL THEN 'orphan' ELSE 'child' END AS relation FROM spans s
  LEFT JOIN cuts c ON c.trace_id = s.trace_id AND c.span_id = s.span_id LEFT JOIN spans q ON q.trace_id = s.trace_id AND q.span_id = s.parent),
walk(trace_id, span_id, top, forest, path, trail, total, depth) AS (
  SELECT trace_id, span_id, span_id, relation, [span_id], [{'s': start_ns, 'e': end_ns, 'i': span_id}], end_ns - start_ns, 1 FROM rel WHERE relation <> 'child'
  UNION ALL SELECT r.trace_id, r.span_id, w.top, w.forest, list_append(w.path, r.span_id), list_append(w.trail, {'s': r.start_ns, 'e': r.end_ns, 'i': r.span_id}),
    w.total + r.end_ns - r.start_ns, w.depth + 1 FROM walk w JOIN rel r ON r.trace_id = w.trace_id AND r.parent = w.span_id AND r.relation = 'child'),
hot AS (SELECT trace_id, total AS total_ns, path FROM (SELECT w.*, row_number() OVER (PARTITION BY w.trace_id ORDER BY w.total DESC, t.start_ns, w.path) AS rn
  FROM walk w JOIN rel t ON t.trace_id = w.trace_id AND t.span_id = w.top WHERE w.forest = 'root'
    AND NOT EXISTS (SELECT 1 FROM rel c WHERE c.trace_id = w.trace_id AND c.parent = w.span_id AND c.relation = 'child')) WHERE rn = 1),
err AS (SELECT w.trace_id, row_number() OVER (PARTITION BY w.trace_id ORDER BY r.end_ns, w.depth DESC, w.path) AS rank, w.span_id, w.path
  FROM walk w JOIN rel r ON r.trace_id = w.trace_id AND r.span_id = w.span_id WHERE r.code = 2),
tree AS (SELECT trace_id, forest, row_number() OVER (PARTITION BY trace_id, forest ORDER BY trail) AS position, span_id, depth FROM walk)"""

DOCS = r"""
d0 AS (SELECT doc_id, text, regexp_replace(CASE doc_id % 11 WHEN 0 THEN './' WHEN 1 THEN 'dist/' ELSE '' END || source || '/' || lang || '/d' || CAST(doc_id AS VARCHAR) ||
  CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.TS' WHEN 2 THEN '.md' WHEN 3 THEN '.sql' ELSE '.vue' END, '^\.?/', '') AS path FROM documents),
d AS (SELECT * FROM d0 WHERE path NOT LIKE 'dist/%' AND path NOT LIKE '%.md' AND length(text) <= 524288)"""

OTLP = """
x AS (SELECT event_id, user_id, event_type, epoch_us(ts) * 1000 AS s, round(value * 1000000) AS dur,
  CASE WHEN event_id % 10 = 3 OR event_id % 100 = 77 THEN 2 ELSE 1 END AS copies,
  CASE WHEN event_id % 59 = 0 THEN 'identity' WHEN event_id % 53 = 0 AND round(value * 1000000) > 0 THEN 'time' WHEN event_id % 100 = 77 THEN 'conflict' END AS bad FROM events),
good AS (SELECT * FROM x WHERE bad IS NULL), inputs AS (SELECT * FROM x WHERE bad IS NULL OR bad = 'conflict')"""


def _notices() -> str:
    return OTLP + """,
c AS (SELECT count(*) FILTER (WHERE event_id % 2 = 1) AS sampled, count(*) FILTER (WHERE event_id % 2 = 0) AS unsampled, sum(copies - 1) AS dups FROM good),
i AS (SELECT sum(copies) AS inputs, sum(copies * (event_id % 3)) AS ev, sum(CASE WHEN event_id % 7 = 0 THEN copies ELSE 0 END) AS extra FROM inputs)"""


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_records"] = f"""WITH {DOCS} SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name,
      lower(regexp_extract(path, '\\.([^.]*)$', 1)) AS ext, regexp_extract(path, '^([^/]*)', 1) AS area,
      CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS BIGINT) AS lines,
      CAST(length(text) AS BIGINT) AS bytes, CASE WHEN lower(path) LIKE '%.sql' THEN 'unsupported' ELSE 'heuristic' END AS mode FROM d"""
    q["excerpt_first_lines"] = f"""WITH {DOCS} SELECT path, array_to_string(list_transform(list_slice(list_filter(
      list_transform(string_split(text, chr(10)), lambda l: regexp_replace(replace(l, chr(9), '  '), '[\\s\\p{{Z}}]+$', '')), lambda l: l <> ''), 1, 10),
      lambda l: CASE WHEN length(l) > 96 THEN left(l, 95) || '…' ELSE l END), chr(10)) AS excerpt FROM d"""
    q["symbol_outline"] = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'f' || p_partkey || ',c' WHEN 1 THEN 'K' || p_partkey || ',run'
      WHEN 2 THEN 'Get' || p_partkey WHEN 3 THEN 'S' || p_partkey || ',go,app' ELSE 'a' || p_partkey || ',c' END AS symbols FROM part"""
    q["statement_text"] = """WITH f AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ';+$', '') AS s FROM conversations)
      SELECT conv_id, turn, CASE WHEN length(s) > 88 THEN left(s, 87) || '…' ELSE s END AS statement FROM f"""
    q["summary_text"] = """WITH f AS (SELECT doc_id, trim(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS s FROM documents),
      g AS (SELECT *, left(s, 700) AS cut FROM f),
      h AS (SELECT *, greatest(CASE WHEN strpos(reverse(cut), ' .') = 0 THEN -1 ELSE 699 - strpos(reverse(cut), ' .') END,
        CASE WHEN strpos(reverse(cut), ' !') = 0 THEN -1 ELSE 699 - strpos(reverse(cut), ' !') END,
        CASE WHEN strpos(reverse(cut), ' ?') = 0 THEN -1 ELSE 699 - strpos(reverse(cut), ' ?') END) AS stop, strpos(reverse(cut), ' ') AS sp FROM g)
      SELECT doc_id, CASE WHEN length(s) <= 700 THEN s WHEN stop > 350 THEN left(cut, stop + 1)
        WHEN sp = 0 THEN left(cut, 699) || '…' ELSE left(cut, 700 - sp) || '…' END AS summary FROM h"""
    cell = "html"
    for a, b in (("\\", "\\\\"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("[", "\\["), ("]", "\\]"), ("(", "\\("), (")", "\\)")):
        cell = f"replace({cell}, '{a}', '{b}')"
    q["report_cells"] = f"SELECT page_id, trim(regexp_replace({cell}, '[\\r\\n\\t]+', ' ', 'g')) AS cell FROM pages"
    q["classify_roles"] = f"WITH {FILES} SELECT path, role, contributes FROM files"
    q["modal_role_by_directory"] = f"""WITH {FILES} SELECT dir, CASE WHEN role IN ('screen / route', 'api endpoint') THEN 'route surface' ELSE role END AS role
      FROM (SELECT dir, role, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, role) AS rn FROM files GROUP BY dir, role) WHERE rn = 1"""
    q["node_heights"] = f"WITH {FILES} SELECT path, round(least(0.1::DOUBLE + log10(1 + lines) * 0.3::DOUBLE, 1.4::DOUBLE), 3) AS height FROM files"
    q["rollup_plan"] = f"WITH {PLAN} SELECT area, CAST(depth AS INTEGER) AS depth, dense, round(CAST(share AS DOUBLE), 9) AS share, files FROM plan"
    q["rolled_up_links"] = f"""WITH {PLAN} SELECT type, f AS "from", t AS "to", obs AS observations, conf AS confidence FROM vlinks
      UNION ALL SELECT 'containment', 'dir:' || area, vid, 0, 'exact' FROM vid WHERE g IS NULL
      UNION ALL SELECT DISTINCT 'containment', 'dir:' || area, vid, 0, 'exact' FROM vid WHERE g LIKE '%/%'"""
    q["rolled_up_nodes"] = f"""WITH {PLAN}, deg2 AS (SELECT id, sum(i) AS i, sum(o) AS o FROM (SELECT f AS id, 0 AS i, 1 AS o FROM vlinks UNION ALL SELECT t, 1, 0 FROM vlinks) GROUP BY id),
      members AS (SELECT g AS d, * FROM vid WHERE g IS NOT NULL UNION ALL SELECT area AS d, * FROM vid WHERE area NOT IN (SELECT g FROM vid WHERE g IS NOT NULL)),
      kids AS (SELECT area AS d, count(DISTINCT vid) AS k FROM vid WHERE g IS NULL OR g LIKE '%/%' GROUP BY area),
      mode2 AS (SELECT d, role FROM (SELECT d, role, row_number() OVER (PARTITION BY d ORDER BY count(*) DESC, role) AS rn FROM members GROUP BY d, role) WHERE rn = 1),
      n AS (SELECT path AS id, regexp_extract(path, '([^/]*)$', 1) AS label, 'file' AS kind, area, role, lines, bytes, CAST(NULL AS BIGINT) AS items FROM vid WHERE g IS NULL
        UNION ALL SELECT 'dir:' || m.d, regexp_extract(m.d, '([^/]*)$', 1), 'dir', regexp_extract(m.d, '^([^/]*)', 1), any_value(o.role), sum(m.lines), sum(m.bytes), coalesce(any_value(k.k), count(*))
          FROM members m JOIN mode2 o ON o.d = m.d LEFT JOIN kids k ON k.d = m.d GROUP BY m.d
        UNION ALL SELECT 'ext:' || name, name, 'external', 'dependencies', 'external dependency', 0, 0, NULL FROM ext)
      SELECT n.id, label, kind, area, role, CAST(lines AS BIGINT) AS lines, CAST(bytes AS BIGINT) AS bytes, items, CAST(coalesce(i, 0) AS BIGINT) AS "in", CAST(coalesce(o, 0) AS BIGINT) AS "out"
      FROM n LEFT JOIN deg2 ON deg2.id = n.id"""
    q["graph_nodes"] = f"""WITH {OPEN} SELECT id, label, kind, area, role, CAST(lines AS BIGINT) AS lines, items, CAST(fin AS BIGINT) AS "in", CAST(fout AS BIGINT) AS "out" FROM full_nodes"""
    q["containment_edges"] = f"""WITH {FILES} SELECT 'dir:' || area AS "from", path AS "to" FROM files"""
    q["area_counts"] = f"WITH {OPEN} SELECT area, count(*) AS count FROM onodes GROUP BY area"
    q["repository_stats"] = f"""WITH {OPEN} SELECT (SELECT count(*) FROM onodes) AS nodes, (SELECT count(*) FROM files) AS source_files,
      CAST((SELECT sum(lines) FROM files) AS BIGINT) AS lines, (SELECT count(*) FROM flow) AS links, (SELECT count(DISTINCT pkg) FROM raw) AS packages"""
    q["coverage_counters"] = f"""WITH {PLAN} SELECT CAST(0 AS BIGINT) AS exact_files, (SELECT count(*) FROM files WHERE path NOT LIKE '%.sql') AS heuristic_files,
      (SELECT count(*) FROM files WHERE path LIKE '%.sql') AS unsupported_files, CAST(0 AS BIGINT) AS failed_files, (SELECT 2 * count(*) FROM raw) AS import_facts,
      (SELECT count(*) FROM raw) AS internal_facts, (SELECT count(*) FROM raw) AS external_facts, CAST(0 AS BIGINT) AS system_facts, CAST(0 AS BIGINT) AS unresolved_facts,
      CAST(0 AS BIGINT) AS ignored_facts, (SELECT count(*) FROM vid WHERE g IS NOT NULL) AS rolled_up_files,
      (SELECT count(DISTINCT pkg) FROM raw) - (SELECT count(*) FROM ext) AS hidden_externals"""
    edge = 'sdir AS "from", tdir AS "to"'
    q["edge_aggregate"] = f"""WITH {FACTS} SELECT {edge}, count(*) AS observations, CASE WHEN bool_and(ln <> 7) THEN 'exact' ELSE 'heuristic' END AS confidence
      FROM imp WHERE sdir <> tdir GROUP BY sdir, tdir"""
    q["edge_samples"] = f"""WITH {FACTS}, f AS (SELECT sdir, tdir, statement, min(row(path, ol, ln, spec)) AS o FROM imp WHERE sdir <> tdir GROUP BY sdir, tdir, statement),
      r AS (SELECT *, row_number() OVER (PARTITION BY sdir, tdir ORDER BY o) AS n FROM f)
      SELECT {edge}, string_agg(statement, '; ' ORDER BY n) AS samples FROM r WHERE n <= 6 GROUP BY sdir, tdir"""
    q["edge_evidence"] = f"""WITH {FACTS}, f AS (SELECT DISTINCT sdir, tdir, path, ol, ln, spec FROM imp WHERE sdir <> tdir),
      r AS (SELECT *, row_number() OVER (PARTITION BY sdir, tdir ORDER BY path, ol, ln, spec) AS n FROM f)
      SELECT {edge}, string_agg(path || ':' || ol || ':' || ln || ':' || spec, '; ' ORDER BY n) AS evidence FROM r WHERE n <= 12 GROUP BY sdir, tdir"""
    q["externals_topk"] = f"""WITH {FACTS} SELECT * FROM (SELECT 'nation_' || pkg AS name, count(*) AS hits, CAST(row_number() OVER (ORDER BY count(*) DESC, 'nation_' || pkg) AS INTEGER) AS rank FROM raw GROUP BY pkg) WHERE rank <= 40"""
    q["fan_in_out"] = f"WITH {FACTS} SELECT id, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out FROM deg"
    q["dependency_hubs"] = f"WITH {FACTS} SELECT CAST(rank AS INTEGER) AS rank, path, CAST(fan_in AS BIGINT) AS fan_in, CAST(fan_out AS BIGINT) AS fan_out FROM hub"
    q["page_reference_graph"] = """WITH r AS (SELECT page_id, unnest(s) AS spec, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS s FROM pages)),
      f AS (SELECT page_id, spec, min(pos) AS pos FROM r GROUP BY page_id, spec)
      SELECT spec, count(*) AS pages, min(page_id) AS first_page, CAST(sum(pos) AS BIGINT) AS positions FROM f GROUP BY spec"""
    code = """u AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey + l_suppkey * 37 + l_linenumber * 11) % (SELECT count(*) FROM part) AS dst FROM lineitem),
      w AS (SELECT *, 'orders/o' || l_orderkey % 100 || '/l' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || CASE dst % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.rs' END AS path,
        'mods/g' || dst % 50 || '/m' || dst AS m, 'nation_' || l_suppkey % 25 AS pkg FROM u),
      r AS (
        SELECT path, '../../' || m || CASE WHEN dst % 2 = 0 THEN '' ELSE '.js' END AS spec, 'import { m, } from "../../' || m || CASE WHEN dst % 2 = 0 THEN '"' ELSE '.js"' END AS statement, 3 AS a, 5 AS b, 'internal' AS k, m || '.ts' AS v FROM w WHERE dst % 3 = 0
        UNION ALL SELECT path, pkg, 'import x from "' || pkg || '"', 6, 6, 'external', pkg FROM w WHERE dst % 3 = 0
        UNION ALL SELECT path, 'node:fs', 'import fs from "node:fs"', 6, 6, 'system', 'fs' FROM w WHERE dst % 3 = 0
        UNION ALL SELECT path, replace(m, '/', '.') || x, 'from ' || replace(m, '/', '.') || ' import ( one, two as too, )', 2, 5, 'internal', m || '.py' FROM w, (VALUES (''), ('.one'), ('.two')) t(x) WHERE dst % 3 = 1
        UNION ALL SELECT path, pkg, 'import ' || pkg, 6, 6, 'external', pkg FROM w WHERE dst % 3 = 1
        UNION ALL SELECT path, 'std::fmt', 'use std::fmt', 1, 1, 'system', 'std' FROM w WHERE dst % 3 = 2
        UNION ALL SELECT path, 'crate::' || replace(m, '/', '::') || '::Thing', 'use crate::' || replace(replace(m, 'mods/', 'mods::'), '/m', '::{m') || '::{Thing}}', 2, 2, 'internal', m || '.rs' FROM w WHERE dst % 3 = 2
        UNION ALL SELECT 'lib.rs', 'self::mods', 'mod mods', 1, 1, 'ignored', 'not a package or resolvable repository path')"""
    q["resolve_generated_code"] = f"WITH {code} SELECT path, spec, statement, a AS start_line, b AS end_line, k AS res_kind, v AS res_value FROM r"
    kinds = ", ".join(f"count(*) FILTER (WHERE k = '{k}') AS \"{k}\"" for k in ("internal", "external", "system", "unresolved", "ignored"))
    q["resolution_by_language"] = f"WITH {code} SELECT regexp_extract(path, '([^.]*)$', 1) AS language, {kinds} FROM r GROUP BY 1"
    q["resolution_ratio"] = f"WITH {code} SELECT count(*) FILTER (WHERE k = 'internal') AS internal, CAST(0 AS BIGINT) AS unresolved, CAST(1 AS DOUBLE) AS ratio FROM r"
    for name, near, far in (("cone_dependencies", "f", "t"), ("cone_dependents", "t", "f")):
        q[name] = f"""WITH RECURSIVE {FACTS}, c(root, id) AS (SELECT id, id FROM hub UNION SELECT c.root, l.{far} FROM c JOIN links l ON l.{near} = c.id) SELECT root, id FROM c"""
    q["shortest_path"] = f"""WITH RECURSIVE {FACTS}, pairs AS (SELECT a.id AS source, b.id AS target FROM hub a JOIN hub b ON b.rank = a.rank + 1),
      w(source, target, id, path, n) AS (SELECT source, target, source, source, 0 FROM pairs
        UNION ALL SELECT w.source, w.target, l.t, w.path || '>' || l.t, n + 1 FROM w JOIN links l ON l.f = w.id WHERE n < 4 AND w.id <> w.target)
      SELECT source, target, path FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY n, path) AS rn FROM w WHERE id = target) WHERE rn = 1"""
    q["cone_links"] = f"""WITH RECURSIVE {FACTS}, live AS (SELECT id FROM files WHERE lines >= 100),
      lk AS (SELECT f, t FROM links WHERE f IN (SELECT id FROM live) AND t IN (SELECT id FROM live)),
      c(root, id) AS (SELECT id, id FROM hub WHERE rank <= 3 AND id IN (SELECT id FROM live) UNION SELECT c.root, l.t FROM c JOIN lk l ON l.f = c.id)
      SELECT c.root, 'import' AS type, l.f AS "from", l.t AS "to" FROM c JOIN lk l ON l.f = c.id"""
    q["shortest_path_links"] = f"""WITH RECURSIVE {FACTS}, pairs AS (SELECT a.id AS source, b.id AS target FROM hub a JOIN hub b ON b.rank = a.rank + 1),
      w(source, target, id, path, n) AS (SELECT source, target, source, [source], 0 FROM pairs
        UNION ALL SELECT w.source, w.target, l.t, list_append(w.path, l.t), n + 1 FROM w JOIN links l ON l.f = w.id WHERE n < 4 AND w.id <> w.target),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY n, path) AS rn FROM w WHERE id = target) WHERE rn = 1)
      SELECT source, target, CAST(i AS INTEGER) AS position, 'import' AS type, path[i] AS "from", path[i + 1] AS "to"
      FROM (SELECT source, target, path, unnest(range(1, len(path))) AS i FROM best)"""
    q["induced_subgraph"] = f"""WITH {FACTS} SELECT f AS "from", t AS "to" FROM links WHERE f IN (SELECT id FROM files WHERE lines >= 400) AND t IN (SELECT id FROM files WHERE lines >= 400)"""
    order = "CASE type WHEN 'import' THEN 0 ELSE 1 END, o"
    near = OPEN + """,
fo AS (SELECT 'import' AS type, path AS f, target AS t, min(row(path, ol, ln, spec)) AS o, min_by(statement, row(path, ol, ln, spec)) AS s FROM imp WHERE path <> target GROUP BY 2, 3
  UNION ALL SELECT 'external', path, 'ext:nation_' || pkg, min(row(path, ol, ln, 'nation_' || pkg)), 'import nation_' || pkg FROM imp GROUP BY path, pkg)"""
    q["neighbour_context"] = f"""WITH {near}, i AS (SELECT f AS id, string_agg(n.npath, ';' ORDER BY rn) AS x FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY {order}, f, t) AS rn FROM fo) l JOIN onodes n ON n.id = l.t WHERE rn <= 12 GROUP BY f),
      b AS (SELECT t AS id, string_agg(n.npath, ';' ORDER BY rn) AS x FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {order}, f, t) AS rn FROM fo) l JOIN onodes n ON n.id = l.f WHERE rn <= 12 GROUP BY t)
      SELECT n.id, coalesce(i.x, '') AS imports, coalesce(b.x, '') AS imported_by FROM onodes n LEFT JOIN i ON i.id = n.id LEFT JOIN b ON b.id = n.id"""
    q["node_inspection"] = f"""WITH {near}, s AS (SELECT f AS id, 0 AS side, type, o, s, f, t FROM fo UNION ALL SELECT t, 1, type, o, s, f, t FROM fo),
      p AS (SELECT id, s AS packet FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side, {order}, f, t) AS rn FROM s) WHERE rn = 1)
      SELECT id, count(*) FILTER (WHERE side = 0) AS outgoing, count(*) FILTER (WHERE side = 1) AS incoming, any_value(packet) AS packet FROM s JOIN p USING (id) GROUP BY id"""
    wanted = ", ".join(f"('{s}')" for s in SEARCHES)
    q["search_ranked"] = f"""WITH {FACTS}, m AS (SELECT v.q AS query, n.id, n.path, CASE WHEN lower(name) = v.q THEN 0
        WHEN starts_with(lower(name), v.q) AND NOT regexp_matches(substr(lower(name), length(v.q) + 1), '^\\.[^./]+$') THEN 1
        WHEN len(list_filter(string_split(lower(path), '/'), lambda s: starts_with(s, v.q))) > 0 THEN 2
        WHEN contains(lower(path), v.q) THEN 3 WHEN contains(lower(role), v.q) THEN 4
        WHEN len(list_filter(string_split(lower(p_name), ' '), lambda s: contains(s, v.q))) > 0 THEN 5 END AS score FROM nodes n, (VALUES {wanted}) v(q)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, path, id) AS rank, count(*) OVER (PARTITION BY query) AS matches FROM m WHERE score IS NOT NULL)
      SELECT query, CAST(rank AS INTEGER) AS rank, CAST(score AS INTEGER) AS score, path, matches FROM r WHERE rank <= 50"""
    q["tour_chapters"] = f"""WITH {OPEN}, l AS (SELECT type, f, t FROM flow UNION ALL SELECT 'containment', 'dir:' || area, path FROM files),
      h AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY fin + fout DESC, npath, id) AS rn FROM full_nodes WHERE kind <> 'external') WHERE rn <= 8),
      hl AS (SELECT * FROM l WHERE type <> 'containment' AND (f IN (SELECT id FROM h) OR t IN (SELECT id FROM h))),
      el AS (SELECT * FROM l WHERE type = 'external')
      SELECT 'area:' || area AS chapter, count(*) AS nodes, (SELECT count(*) FROM l JOIN onodes a ON a.id = l.f JOIN onodes b ON b.id = l.t WHERE l.type <> 'containment' AND a.area = n.area AND b.area = n.area) AS links FROM onodes n GROUP BY area
      UNION ALL SELECT 'hubs', (SELECT count(*) FROM (SELECT id FROM h UNION SELECT f FROM hl UNION SELECT t FROM hl)), (SELECT count(*) FROM hl)
      UNION ALL SELECT 'boundary', (SELECT count(*) FROM (SELECT f FROM el UNION SELECT t FROM el)), (SELECT count(*) FROM el)
      UNION ALL SELECT 'all', (SELECT count(*) FROM onodes), (SELECT count(*) FROM l)"""
    gloss = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PACKAGE_GLOSSARY.items())
    q["link_sentences"] = f"""WITH {PLAN}, s AS (SELECT type, f, t, statement, min(row(path, ol, ln, spec)) AS o FROM vfacts WHERE f <> t GROUP BY type, f, t, statement),
      k AS (SELECT type, f, t, count(*) AS n, string_agg('`' || statement || '`', '; ' ORDER BY rn) AS said FROM (SELECT *, row_number() OVER (PARTITION BY type, f, t ORDER BY o) AS rn FROM s) WHERE rn <= 6 GROUP BY type, f, t),
      z AS (SELECT *, regexp_replace(f, '^dir:', '') AS fp, regexp_replace(t, '^(dir|ext):', '') AS tp FROM k)
      SELECT type, f AS "from", t AS "to", CASE WHEN type = 'external' THEN fp || ' pulls package ' || tp || '. ' || coalesce(CASE tp {gloss} END, 'It is an external package ' || tp) || '.'
        WHEN n = 1 THEN fp || ' imports ' || tp || '. The statement is ' || said || '.' ELSE fp || ' imports ' || tp || '. The statements are ' || said || '.' END AS sentence FROM z
      UNION ALL SELECT 'containment', 'dir:' || area, vid, area || ' contains ' || path || '. This is containment, not a runtime import.' FROM vid WHERE g IS NULL
      UNION ALL SELECT DISTINCT 'containment', 'dir:' || area, vid, area || ' contains ' || g || '. This is containment, not a runtime import.' FROM vid WHERE g LIKE '%/%'"""
    q["ask_lines"] = f"""WITH {OPEN} SELECT n.npath AS path, string_split(f.p_name, ' ')[1] AS fn, CASE WHEN fin = 0 THEN 'Entry or unreferenced.' WHEN fin >= 3 THEN 'Foundation: many files depend on it.'
      WHEN fout = 0 THEN 'Leaf in this slice.' ELSE 'A connector in this slice.' END || ' ' || n.npath || ' (' || n.role || ') names ' || string_split(f.p_name, ' ')[1] || '. Fan-in ' || format('{{:,}}', CAST(fin AS BIGINT)) ||
      ', fan-out ' || format('{{:,}}', CAST(fout AS BIGINT)) || '. This answer is heuristic.' AS line FROM full_nodes n JOIN files f ON f.path = n.id"""
    parts = "(SELECT count(*) FROM files WHERE path NOT LIKE '%.sql')", "(SELECT count(*) FROM files WHERE path LIKE '%.sql')"
    values = [
        "(SELECT count(*) FROM onodes)", "(SELECT count(*) FROM files)", "(SELECT sum(lines) FROM files)", "(SELECT count(*) FROM flow)",
        "(SELECT count(DISTINCT pkg) FROM raw)", "0", *parts, "0", "(SELECT 2 * count(*) FROM raw)", "(SELECT count(*) FROM raw)",
        "(SELECT count(*) FROM raw)", "0", "0", "0", "0", "(SELECT count(DISTINCT pkg) - least(40, count(DISTINCT pkg)) FROM raw)",
    ]
    q["report_metrics"] = f"WITH {OPEN} " + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{METRICS[i]}' AS metric, CAST({v} AS BIGINT) AS value" for i, v in enumerate(values)
    )
    q["span_relations"] = f"""WITH RECURSIVE {TREE} SELECT r.trace_id, r.span_id, relation, CASE WHEN relation = 'child' THEN parent END AS derived_parent, CAST(depth AS BIGINT) AS depth
      FROM rel r JOIN walk w ON w.trace_id = r.trace_id AND w.span_id = r.span_id"""
    q["cycle_breaks"] = f"WITH RECURSIVE {TREE} SELECT trace_id, span_id FROM rel WHERE relation = 'cycle-broken'"
    q["relation_lists"] = f"WITH RECURSIVE {TREE} SELECT trace_id, relation, CAST(row_number() OVER (PARTITION BY trace_id, relation ORDER BY start_ns, end_ns, span_id) AS BIGINT) AS position, span_id FROM rel WHERE relation <> 'child'"
    q["trace_bounds"] = f"WITH {SPANS} SELECT trace_id, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS spans FROM spans GROUP BY trace_id"
    q["hot_paths"] = f"WITH RECURSIVE {TREE} SELECT trace_id, CAST(total_ns AS BIGINT) AS total_ns, array_to_string(path, '>') AS path FROM hot"
    q["error_paths"] = f"WITH RECURSIVE {TREE} SELECT trace_id, rank, span_id, array_to_string(path, '>') AS path FROM err"
    q["call_tree"] = f"WITH RECURSIVE {TREE} SELECT trace_id, forest, position, span_id, CAST(depth AS BIGINT) AS depth FROM tree"
    q["error_ranks"] = f"WITH RECURSIVE {TREE} SELECT trace_id, rank, span_id, CAST(len(path) AS BIGINT) AS depth FROM err"
    q["subtree_sizes"] = f"WITH RECURSIVE {TREE} SELECT trace_id, up AS span_id, count(*) AS size FROM (SELECT trace_id, unnest(path) AS up FROM walk) GROUP BY trace_id, up"
    q["span_ancestors"] = f"""WITH RECURSIVE {TREE} SELECT trace_id, span_id, path[p] AS ancestor, p AS position FROM (SELECT trace_id, span_id, path, unnest(range(1, len(path))) AS p FROM err)"""
    q["span_descendants"] = f"""WITH RECURSIVE {TREE} SELECT trace_id, top AS span_id, span_id AS descendant, CAST(depth - 1 AS BIGINT) AS depth,
      row_number() OVER (PARTITION BY trace_id, top ORDER BY depth, trail) AS nth FROM walk WHERE forest = 'root' AND depth > 1"""
    q["trace_summary"] = f"""WITH {SPANS} SELECT trace_id, count(*) AS spans, max(end_ns) - min(start_ns) AS duration_ns, count(*) FILTER (WHERE code = 2) AS errors, count(DISTINCT service) AS services FROM spans GROUP BY trace_id"""
    label = "CASE code WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unset' END"
    q["visible_spans"] = f"""WITH {SPANS} SELECT trace_id, span_id, service, {label} AS status, CAST(end_ns - start_ns AS VARCHAR) || ' ns' AS duration_label FROM spans s
      WHERE end_ns - start_ns >= 50000000 AND (service = 'error' OR trace_id NOT IN (SELECT trace_id FROM spans WHERE service = 'error'))"""
    q["service_lanes"] = f"WITH {SPANS} SELECT DISTINCT trace_id, service, CAST(dense_rank() OVER (PARTITION BY trace_id ORDER BY service) - 1 AS BIGINT) AS lane FROM spans"
    q["span_ratios"] = f"""WITH {SPANS}, b AS (SELECT *, start_ns - min(start_ns) OVER w AS a, end_ns - min(start_ns) OVER w AS z, max(end_ns) OVER w - min(start_ns) OVER w AS d FROM spans WINDOW w AS (PARTITION BY trace_id))
      SELECT trace_id, span_id, a AS start_offset, CASE WHEN d <= 0 OR a <= 0 THEN 0.0::DOUBLE WHEN a >= d THEN 1.0::DOUBLE ELSE CAST(CAST(a AS HUGEINT) * 1000000 // d AS DOUBLE) / 1000000 END AS start_ratio,
      CASE WHEN d <= 0 OR z <= 0 THEN 0.0::DOUBLE WHEN z >= d THEN 1.0::DOUBLE ELSE CAST(CAST(z AS HUGEINT) * 1000000 // d AS DOUBLE) / 1000000 END AS end_ratio FROM b"""
    q["timeline_ticks"] = f"""WITH {SPANS}, b AS (SELECT trace_id, max(end_ns) - min(start_ns) AS d FROM spans GROUP BY trace_id), t AS (SELECT DISTINCT trace_id, d * i // 4 AS offset_ns FROM b, range(5) r(i))
      SELECT trace_id, offset_ns, '+' || format('{{:,}}', offset_ns) || ' ns' AS label FROM t"""
    q["first_visible_spans"] = f"""WITH RECURSIVE {TREE}, v AS (SELECT trace_id, span_id FROM spans WHERE end_ns - start_ns >= 50000000),
      h AS (SELECT trace_id, unnest(path) AS span_id, generate_subscripts(path, 1) AS pos FROM hot), h1 AS (SELECT trace_id, arg_min(span_id, pos) AS hot_span FROM h JOIN v USING (trace_id, span_id) GROUP BY trace_id),
      x AS (SELECT trace_id, rank, unnest(path) AS span_id, generate_subscripts(path, 1) AS pos FROM err), x1 AS (SELECT trace_id, arg_min(span_id, rank * 1000 - pos) AS error_span FROM x JOIN v USING (trace_id, span_id) GROUP BY trace_id)
      SELECT trace_id, hot_span, error_span FROM h1 FULL JOIN x1 USING (trace_id)"""
    q["tree_visibility"] = f"""WITH {SPANS} SELECT trace_id, count(*) FILTER (WHERE code = 2) AS shown, count(*) FILTER (WHERE code <> 2) AS hidden FROM spans GROUP BY trace_id"""
    src = FILES + r""",
ev AS (SELECT event_id, path AS file, CASE event_id % 6 WHEN 0 THEN path WHEN 1 THEN './x/../' || path WHEN 2 THEN '/srv/app/' || path WHEN 3 THEN '/srv/other/' || path
  WHEN 4 THEN '../' || path ELSE replace(path, '/', '\') END AS recorded_path FROM events JOIN files ON p_partkey = event_id * 13 % (SELECT count(*) FROM part))"""
    q["source_correlation"] = f"""WITH {src} SELECT event_id, recorded_path, 'fn' || event_id AS function_name, CASE WHEN event_id % 50 - 3 > 0 THEN CAST(event_id % 50 - 3 AS VARCHAR) END AS line_number,
      CASE WHEN event_id % 6 IN (0, 1, 2, 5) THEN file END AS node_id FROM ev"""
    q["source_warnings"] = f"WITH {src} SELECT count(*) FILTER (WHERE event_id % 6 IN (3, 4)) AS unmatched_source_spans, 'code.filepath,code.function' AS deprecated_attributes FROM ev"
    q["otlp_spans"] = f"""WITH {OTLP} SELECT lpad(CAST(user_id + 1 AS VARCHAR), 32, '0') AS trace_id, lpad(CAST(event_id + 1 AS VARCHAR), 16, '0') AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id,
      event_type AS name, CAST(event_id % 6 AS INTEGER) AS kind, s AS start_ns, CAST(CASE WHEN event_id % 53 = 0 THEN -dur ELSE dur END AS BIGINT) AS duration_ns, event_id % 2 = 1 AS sampled,
      CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS status_code,
      'kv=kvlist([{{key:"a", value:int(1)}}, {{key:"token", value:redacted}}]);list=array([bool(true), string("' || event_type || '")]);n=int(' || event_id || ')' AS attributes,
      event_type AS service, CAST(1 AS BIGINT) AS events FROM good"""
    q["otlp_nested_values"] = r"""SELECT lpad(CAST(o_orderkey + 1 AS VARCHAR), 16, '0') AS span_id, 'deep' AS key,
      repeat('{"type":"array","value":[{"type":"double","value":0.5},', CAST(o_orderkey % 7 AS BIGINT)) || '{"type":"kvlist","value":[{"key":"a\"{","value":{"type":"string","value":"' || o_orderpriority ||
      '"}},{"key":"token","value":{"type":"redacted"}}]}' || repeat(']}', CAST(o_orderkey % 7 AS BIGINT)) AS value,
      repeat('array([double(0.5), ', CAST(o_orderkey % 7 AS BIGINT)) || 'kvlist([{key:"a\"{", value:string("' || o_orderpriority || '")}, {key:"token", value:redacted}])' ||
      repeat('])', CAST(o_orderkey % 7 AS BIGINT)) AS text FROM orders"""
    q["otlp_rejects"] = f"""WITH {OTLP} SELECT bad AS code, CAST(sum(CASE WHEN bad = 'conflict' THEN 1 ELSE copies END) AS BIGINT) AS spans FROM x WHERE bad IS NOT NULL GROUP BY bad"""
    q["otlp_report"] = f"""WITH {_notices()} SELECT CAST(inputs AS BIGINT) AS documents, CAST(inputs AS BIGINT) AS resource_scope_groups, CAST(inputs AS BIGINT) AS input_spans,
      CAST(inputs * 2 AS BIGINT) AS redacted_attributes, CAST(0 AS BIGINT) AS dropped_attributes, CAST(ev AS BIGINT) AS dropped_events, CAST(0 AS BIGINT) AS dropped_links,
      CAST(extra AS BIGINT) AS unknown_field_count, (SELECT count(*) FROM good) AS spans, CAST(dups AS BIGINT) AS duplicate_spans, sampled AS sampled_spans, unsampled AS unsampled_spans,
      (SELECT count(DISTINCT user_id) FROM inputs) AS traces FROM c, i"""
    q["otlp_unknown_fields"] = f"WITH {_notices()} SELECT 'resourceSpans[].scopeSpans[].spans[].extra' AS path, CAST(extra AS BIGINT) AS count FROM i"
    q["otlp_notices"] = f"""WITH {_notices()} SELECT notice, CAST(value AS BIGINT) AS value FROM (SELECT 'sampling' AS notice, sampled AS value FROM c UNION ALL SELECT 'sampling-unsampled', unsampled FROM c
      UNION ALL SELECT 'dropped-events', ev FROM i UNION ALL SELECT 'unknown-fields', extra FROM i UNION ALL SELECT 'duplicates', dups FROM c UNION ALL SELECT 'redactions', inputs * 2 FROM i)"""
    q["report_nodes"] = f"""WITH {OPEN} SELECT npath AS path, id, kind, role, area, lines, CAST(fin AS BIGINT) AS "in", CAST(fout AS BIGINT) AS "out", items FROM full_nodes"""
    q["saved_graph_nodes"] = q["graph_nodes"]
    comma = lambda n: f"format('{{:,}}', CAST({n} AS BIGINT))"
    plural = lambda n, noun: f"{comma(n)} || ' {noun}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"
    human = lambda items: f"CASE len({items}) WHEN 0 THEN '' WHEN 1 THEN {items}[1] ELSE array_to_string({items}[1:len({items}) - 1], ', ') || ' and ' || {items}[len({items})] END"
    q["node_contributions"] = f"""WITH {OPEN} SELECT id, CASE kind WHEN 'external' THEN CAST(fin AS BIGINT) || ' references in this slice'
      WHEN 'dir' THEN items || ' items / ' || {comma('lines')} || ' lines' ELSE {comma('lines')} || ' lines / ' || {comma('bytes')} || ' bytes' END AS contribution FROM full_nodes"""
    q["link_chips"] = f"""WITH {PLAN} SELECT type, CASE conf WHEN 'exact' THEN 'Exact' ELSE 'Heuristic' END AS chip, count(*) AS links FROM vlinks GROUP BY 1, 2
      UNION ALL SELECT 'containment', 'Exact', count(*) FROM (SELECT DISTINCT vid FROM vid WHERE g IS NULL OR g LIKE '%/%') HAVING count(*) > 0"""
    q["scope_note"] = f"""WITH {PLAN}, d AS (SELECT coalesce(list(area ORDER BY area), []) AS a FROM plan WHERE dense),
      s AS (SELECT list_concat(a[1:4], CASE WHEN len(a) > 4 THEN [(len(a) - 4) || ' more'] ELSE [] END) AS shown, len(a) AS n FROM d),
      e AS (SELECT count(*) AS shown_packages, (SELECT count(DISTINCT pkg) FROM raw) AS packages FROM ext)
      SELECT 'This is a focused source slice of demo, not the whole checkout. node_modules, build outputs, lockfiles, .env files, and nested worktrees are excluded.' ||
        CASE WHEN n > 0 THEN ' ' || {human('shown')} || CASE WHEN n = 1 THEN ' is' ELSE ' are' END || ' rolled into single blocks.' ELSE '' END ||
        CASE WHEN packages > shown_packages THEN ' ' || shown_packages || ' of ' || packages || ' packages shown.' ELSE '' END || ' 1 workspace package' ||
        CASE packages % 3 WHEN 0 THEN '' WHEN 1 THEN ' and 1 cargo crate' ELSE ' and 2 cargo crates' END || ' omitted. Dots are import packets.' AS note FROM s, e"""
    q["report_links"] = f"""WITH {PLAN}, e AS (SELECT DISTINCT type, f, t, path, ol, ln, spec FROM vfacts WHERE f <> t),
      r AS (SELECT *, row_number() OVER (PARTITION BY type, f, t ORDER BY path, ol, ln, spec) AS rn FROM e),
      v AS (SELECT type, f, t, string_agg(path || ':' || ol || '-' || ln, ', ' ORDER BY path, ol, ln, spec) AS evidence FROM r WHERE rn <= 12 GROUP BY type, f, t)
      SELECT regexp_replace(f, '^dir:', '') AS "from", regexp_replace(t, '^(dir|ext):', '') AS "to", type, conf AS confidence, CAST(obs AS VARCHAR) AS observations, evidence
      FROM vlinks JOIN v USING (type, f, t)"""
    q["neighbour_lists"] = f"""WITH {near}, s AS (SELECT f AS id, 0 AS side, type, o, f, t, t AS other FROM fo UNION ALL SELECT t, 1, type, o, f, t, f FROM fo)
      SELECT id, CAST(side AS INTEGER) AS side, CAST(rank AS INTEGER) AS rank, type, other, greatest(n - 5, 0) AS more FROM (
        SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY {order}, f, t) AS rank, count(*) OVER (PARTITION BY id, side) AS n FROM s) WHERE rank <= 5"""
    q["ask_payloads"] = f"""WITH {near}, s AS (SELECT f AS id, type, o, s, f, t FROM fo UNION ALL SELECT t, type, o, s, f, t FROM fo),
      m AS (SELECT id, s, min(row({order.replace(', o', '')}, o, f, t)) AS place FROM s GROUP BY id, s),
      k AS (SELECT id, string_agg(s, '; ' ORDER BY rn) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, s) AS rn FROM m) WHERE rn <= 6 GROUP BY id),
      x AS (SELECT f.path, string_split(p.p_name, ' ') AS symbols, repeat(p.p_name || ' ', p.p_size * 10) AS text FROM files f JOIN part p USING (p_partkey))
      SELECT path, symbols[1] AS fn, coalesce(samples, '') AS samples, sha256(CASE WHEN length(text) <= 4000 THEN text
        ELSE text[1:4000] || chr(10) || '… (truncated)' || chr(10) || chr(10) || '/* also declares: ' || array_to_string(symbols, ', ') || ' */' END) AS source_sha256
      FROM x LEFT JOIN k ON k.id = x.path"""
    area_of = "CASE WHEN contains(n.npath, '/') THEN string_split(n.npath, '/')[1] ELSE '(root)' END"
    q["node_explanations"] = f"""WITH {near},
      b AS (SELECT t AS id, list_sort(list(DISTINCT {area_of}))[1:4] AS areas FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {order}, f, t) AS rn FROM fo) l
        JOIN onodes n ON n.id = l.f WHERE rn <= 12 GROUP BY t),
      z AS (SELECT n.*, coalesce(b.areas, []) AS areas FROM full_nodes n LEFT JOIN b ON b.id = n.id)
      SELECT id, CASE kind WHEN 'external' THEN CASE WHEN fin = 0 THEN 'A package that nothing in this slice imports.' ELSE 'A third-party package, pulled in by ' || {plural('fin', 'file')} || ' in this slice.' END
        WHEN 'dir' THEN 'A group of ' || {plural('lines', 'line')} || ' filed under ' || area || '. Dominant role: ' || role || '.' || CASE WHEN len(areas) > 0 THEN ' Work here is consumed by ' || {human('areas')} || '.' ELSE '' END
        ELSE CASE WHEN fin = 0 THEN 'Entry or unreferenced. ' WHEN fin >= 3 THEN 'Foundation: many files depend on it. ' WHEN fout = 0 THEN 'Leaf in this slice. ' ELSE '' END ||
          CASE WHEN lines > 1200 THEN 'One of the largest files here' WHEN lines > 400 THEN 'A substantial file' ELSE 'A small file' END || ', ' || {plural('lines', 'line')} || '. Role: ' || role || '. ' ||
          CASE WHEN fin = 0 THEN 'Nothing in this slice imports it, so it is either an entry point or unreferenced.' ELSE {plural('fin', 'other file')} || ' import' || CASE WHEN fin = 1 THEN 's' ELSE '' END || ' it' ||
            CASE WHEN len(areas) > 0 THEN ', across ' || {human('areas')} ELSE '' END || '.' END || ' ' ||
          CASE WHEN fout = 0 THEN 'It imports nothing, so it sits at the bottom of the graph.' ELSE 'It reaches for ' || {plural('fout', 'module')} || '.' END END AS summary FROM z"""
    phrase = "CASE WHEN fin = 0 THEN ', entry or unreferenced' WHEN fin >= 3 THEN ', foundation (many files depend on it)' WHEN fout = 0 THEN ', leaf in this slice' ELSE '' END"
    q["selection_texts"] = f"""WITH {near}, c AS (SELECT *, CASE kind WHEN 'external' THEN 'dependencies' ELSE area || ' ' || role END AS set_id FROM full_nodes WHERE kind <> 'dir'),
      h AS (SELECT set_id, count(*) AS total, list(npath || ' (' || role || {phrase} || ')' ORDER BY npath, id)[1:8] AS bits FROM c GROUP BY set_id),
      i AS (SELECT a.set_id, l.type, l.f, l.t, l.s, a.npath AS fp, b.npath AS tp, row_number() OVER (PARTITION BY a.set_id ORDER BY l.f, l.t, l.type) AS rn, count(*) OVER (PARTITION BY a.set_id) AS edges
        FROM fo l JOIN c a ON a.id = l.f JOIN c b ON b.id = l.t AND b.set_id = a.set_id),
      g AS (SELECT set_id, any_value(edges) AS edges, string_agg(fp || ' imports ' || tp || '.' || CASE WHEN rn <= 6 THEN ' The statement is `' || s || '`.' ELSE '' END, ' ' ORDER BY rn) AS said FROM i WHERE rn <= 12 GROUP BY set_id)
      SELECT set_id, {plural('total', 'block')} || ': ' || array_to_string(bits, '; ') || CASE WHEN total > 8 THEN '; and ' || {comma('total - 8')} || ' more' ELSE '' END || '.' ||
        CASE WHEN edges IS NULL THEN ' They share no import or external arc in this slice.' ELSE ' ' || said || CASE WHEN edges > 12 THEN ' and ' || {comma('edges - 12')} || ' more.' ELSE '' END END AS text
      FROM h LEFT JOIN g USING (set_id)"""
    q["explanation_cache"] = f"""WITH {OPEN} SELECT id, CASE WHEN kind = 'dir' THEN 'A group of ' || {plural('lines', 'line')} || ' filed under ' || area || '. Dominant role: ' || role || '.'
      WHEN length(npath) % 2 = 0 THEN 'Cached ' || npath ELSE 'Supplied for ' || npath END AS summary, kind = 'external' AND length(npath) % 2 = 1 AS fresh FROM full_nodes WHERE kind <> 'file'"""
    linked = """o AS (SELECT o_orderkey AS k, o_orderpriority AS prio, lpad(CAST(o_custkey + 1 AS VARCHAR), 32, '0') AS trace_id, lpad(CAST(o_orderkey + 1 AS VARCHAR), 16, '0') AS span_id FROM orders)"""
    q["span_event_rows"] = f"""WITH {linked} SELECT trace_id, span_id, CAST(e AS INTEGER) AS position, k * 10 + e AS time_ns, 'e' || e AS name,
      'n=int(' || e || ');prio=string("' || prio || '");secret=redacted' AS attributes, e AS dropped_attributes FROM (SELECT *, unnest(range(1, 2 + k % 3)) AS e FROM o)"""
    q["span_link_rows"] = f"""WITH {linked}, l AS (SELECT *, unnest(range(0, 1 + k % 2)) AS l FROM o), x AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'ffffffffffffffff' ELSE lpad(CAST(k + 1 + l AS VARCHAR), 16, '0') END AS target FROM l)
      SELECT x.trace_id, x.span_id, CAST(l + 1 AS INTEGER) AS position, x.trace_id AS linked_trace_id, target AS linked_span_id, 's' || l AS trace_state, CAST(1 AS BIGINT) AS flags,
        'kind=bool(true)' AS attributes, o.k IS NOT NULL AS local_target, coalesce(o.k % 4 = 0, false) AS selectable FROM x LEFT JOIN o ON o.trace_id = x.trace_id AND o.span_id = x.target"""
    q["otlp_limited"] = """SELECT 'limit' AS code, count(*) AS spans FROM orders WHERE o_orderkey % 3 = 2 OR o_orderkey % 2 = 1 OR length(o_orderpriority) > 12"""
    q["trace_sizes"] = f"""WITH {SPANS}, z AS (SELECT trace_id, CAST(sum(length('{{"trace_id":"","span_id":"","name":"","status_code":,"start_ns":}}') + length(trace_id) + length(span_id) + length(service) + length(CAST(code AS VARCHAR)) +
      length(CAST(start_ns AS VARCHAR))) AS BIGINT) AS bytes FROM spans GROUP BY trace_id) SELECT *, bytes > 6000 AS over FROM z"""
    q["otlp_file_spans"] = f"SELECT trace_id, span_id, name, start_ns, service FROM ({q['otlp_spans']})"
    return q | WORKSPACES
