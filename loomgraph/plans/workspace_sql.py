"""Plain SQL for the queries of `workspaces`: what the repositories must give, from the rule that deals them."""

from __future__ import annotations

# every import of a user file with its line, kind and answer
FACTS = """
p AS (SELECT p_partkey AS key, 'shop' || (p_partkey % 7) AS repo_id, p_partkey % 7 AS r, p_size % 10 AS k, p_partkey % 4 AS lang, p_size FROM part),
ts AS (SELECT *, 'src/users/u' || key || CASE WHEN p_size % 2 = 0 THEN '.ts' ELSE '.tsx' END AS path FROM p WHERE lang = 0),
go AS (SELECT *, 'cmd/u' || key || '.go' AS path FROM p WHERE lang = 1),
rs AS (SELECT *, 'src/u' || key || '.rs' AS path FROM p WHERE lang = 2),
py AS (SELECT *, 'app/u' || key || '.py' AS path FROM p WHERE lang = 3),
facts(repo_id, path, spec, kind, start_line, end_line, res_kind, res_value) AS (
  SELECT repo_id, path, '@/m' || k, 'static', 1, 1, CASE WHEN k < 8 THEN 'internal' ELSE 'unresolved' END, CASE WHEN k < 8 THEN 'src/m' || k || '.ts' ELSE '@/m' || k END FROM ts
  UNION ALL SELECT repo_id, path, '~' || k || '/extra', 'static', 2, 2, 'internal', 'packages/lib' || k || '/src/extra.ts' FROM ts
  UNION ALL SELECT repo_id, path, '@acme/lib' || k, 'static', 3, 3, 'internal', 'packages/lib' || k || '/src/index.ts' FROM ts
  UNION ALL SELECT repo_id, path, '@acme/lib' || k || '/sub', 'static', 4, 4, 'internal', 'packages/lib' || k || '/src/deep.ts' FROM ts
  UNION ALL SELECT repo_id, path, '../m' || k || '.js', 'reexport', 5, 5, CASE WHEN k < 8 THEN 'internal' ELSE 'unresolved' END, CASE WHEN k < 8 THEN 'src/m' || k || '.ts' ELSE '../m' || k || '.js' END FROM ts
  UNION ALL SELECT repo_id, path, '@acme/lib' || k || '/src/extra', 'dynamic', 6, 6, 'internal', 'packages/lib' || k || '/src/extra.ts' FROM ts
  UNION ALL SELECT repo_id, path, 'react', 'static', 7, 7, 'external', 'react' FROM ts
  UNION ALL SELECT repo_id, path, 'node:fs', 'static', 8, 8, 'system', 'fs' FROM ts
  UNION ALL SELECT repo_id, path, './gone' || k, 'static', 9, 9, 'unresolved', './gone' || k FROM ts
  UNION ALL SELECT repo_id, path, 'fmt', 'static', 4, 4, 'system', 'fmt' FROM go
  UNION ALL SELECT repo_id, path, 'example.com/shop' || r || '/pkg/p' || k, 'static', 5, 5, 'internal', 'pkg/p' || k || '/p' || k || '.go' FROM go
  UNION ALL SELECT repo_id, path, 'example.com/other' || r || '/pkg/p' || k, 'static', 6, 6, 'external', 'example.com/other' || r || '/pkg' FROM go
  UNION ALL SELECT repo_id, path, 'github.com/acme/tool/sub', 'static', 9, 9, 'external', 'github.com/acme/tool' FROM go
  UNION ALL SELECT repo_id, path, 'self::part', 'static', 1, 1, 'internal', 'src/u' || key || '/part.rs' FROM rs
  UNION ALL SELECT repo_id, path, 'crate::c' || k || '::inner::Thing', 'static', 2, 2, 'internal', 'src/c' || k || '/inner.rs' FROM rs
  UNION ALL SELECT repo_id, path, 'self::part::X', 'static', 3, 3, 'internal', 'src/u' || key || '/part.rs' FROM rs
  UNION ALL SELECT repo_id, path, 'super::c' || k || '::Other', 'static', 4, 4, 'internal', 'src/c' || k || '.rs' FROM rs
  UNION ALL SELECT repo_id, path, 'shop_util::deep::' || unnest(['Thing', 'Other']), 'static', 5, 5, 'internal', 'crates/util/src/deep.rs' FROM rs
  UNION ALL SELECT repo_id, path, 'std::fmt', 'static', 6, 6, 'system', 'std' FROM rs
  UNION ALL SELECT repo_id, path, 'serde::Serialize', 'static', 7, 7, 'external', 'serde' FROM rs
  UNION ALL SELECT repo_id, path, 'serde_json', 'static', 8, 8, 'external', 'serde_json' FROM rs
  UNION ALL SELECT repo_id, path, 'mystery', 'static', 9, 9, 'ignored', 'not a package or resolvable repository path' FROM rs
  UNION ALL SELECT repo_id, path, '.d' || k, 'static', 1, 1, 'internal', 'app/d' || k || '.py' FROM py
  UNION ALL SELECT repo_id, path, '.d' || k || '.thing', 'static', 1, 1, 'unresolved', '.d' || k || '.thing' FROM py
  UNION ALL SELECT repo_id, path, 'app.d' || k, 'static', 2, 2, 'internal', 'app/d' || k || '.py' FROM py
  UNION ALL SELECT repo_id, path, 'flask', 'static', 2, 2, 'external', 'flask' FROM py
  UNION ALL SELECT repo_id, path, '..gone', 'static', 3, 3, 'unresolved', '..gone' FROM py
  UNION ALL SELECT repo_id, path, '..gone.x', 'static', 3, 3, 'unresolved', '..gone.x' FROM py
  UNION ALL SELECT repo_id, path, 'os', 'static', 4, 4, 'external', 'os' FROM py)"""

_OF = lambda kind: f"count(*) FILTER (WHERE res_kind = '{kind}')"

ORACLE = {
    "workspace_facts": f"WITH {FACTS} SELECT repo_id, path, spec, kind, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, res_kind, res_value FROM facts",
    # 92 sources a repository without user files; a user file of Rust has a module file of its own
    "built_workspaces": f"""WITH {FACTS}, u AS (SELECT repo_id, count(*) FILTER (WHERE lang = 0) AS ts, count(*) FILTER (WHERE lang = 2) AS rs, count(*) FILTER (WHERE lang = 3) AS py FROM p GROUP BY repo_id),
        f AS (SELECT * FROM facts WHERE path NOT LIKE 'cmd/%'),
        c AS (SELECT repo_id, count(*) AS import_facts, {_OF('unresolved')} AS unresolved_facts, count(DISTINCT res_value) FILTER (WHERE res_kind = 'external') AS packages,
          count(DISTINCT (path, res_value)) FILTER (WHERE res_kind IN ('internal', 'external') AND path <> res_value) AS links FROM f GROUP BY repo_id)
        SELECT repo_id, 92 + ts + 2 * rs + py AS source_files, CAST(10 * ts + 9 * rs + 4 * py AS BIGINT) AS lines, links, packages, import_facts, unresolved_facts,
          'This is a focused source slice of ' || repo_id || ', not the whole checkout. node_modules, build outputs, lockfiles, .env files, and nested worktrees are excluded. Dots are import packets.' AS note
        FROM u JOIN c USING (repo_id)""",
    "workspace_kinds": f"""WITH {FACTS} SELECT repo_id, regexp_extract(path, '[^.]*$') AS language, {_OF('internal')} AS internal, {_OF('external')} AS external, {_OF('system')} AS system,
        {_OF('unresolved')} AS unresolved, {_OF('ignored')} AS ignored FROM facts GROUP BY 1, 2""",
    "workspace_ratio": f"""WITH {FACTS} SELECT repo_id, {_OF('internal')} AS internal, {_OF('unresolved')} AS unresolved,
        round({_OF('internal')} / ({_OF('internal')} + {_OF('unresolved')}), 9) AS ratio FROM facts GROUP BY repo_id""",
    "first_unresolved": f"""WITH {FACTS} SELECT repo_id, CAST(rank AS INTEGER) AS rank, path, CAST(start_line AS INTEGER) AS start_line, spec FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, start_line, spec) AS rank FROM facts WHERE res_kind = 'unresolved') WHERE rank <= 10""",
    "declared_things": """WITH repos AS (SELECT DISTINCT 'shop' || (p_partkey % 7) AS repo_id FROM part), tens AS (SELECT repo_id, k FROM repos, range(10) t(k))
        SELECT repo_id, 'go' AS kind, 'example.com/' || repo_id AS name, '' AS detail FROM repos
        UNION ALL SELECT repo_id, 'crate', repo_id || '_core', ' src src/lib.rs' FROM repos
        UNION ALL SELECT repo_id, 'crate', 'shop_util', 'crates/util crates/util/src crates/util/src/lib.rs' FROM repos
        UNION ALL SELECT repo_id, 'dependency', unnest(['serde', 'serde_json', 'insta']), '' FROM repos
        UNION ALL SELECT repo_id, 'package', '@acme/lib' || k, 'packages/lib' || k || ' packages/lib' || k || '/src/index.ts' FROM tens
        UNION ALL SELECT repo_id, 'export', '@acme/lib' || k || ' .', './src/index.ts' FROM tens
        UNION ALL SELECT repo_id, 'export', '@acme/lib' || k || ' ./sub', './src/deep.ts' FROM tens
        UNION ALL SELECT repo_id, 'alias', '@/*', '0  ./src/*' FROM repos
        UNION ALL SELECT repo_id, 'alias', '~' || k || '/*', (k + 1) || '  packages/lib' || k || '/src/*' FROM tens
        UNION ALL SELECT repo_id, 'name', repo_id, '' FROM repos""",
    # specifiers that live code names are called live_, all others dead; the text is read as it stands
    "extract_lexical": r"""WITH d AS (SELECT doc_id, translate(text, '`\$*/''"' || chr(10), '        ') AS plain FROM documents),
        t AS (SELECT doc_id, 'a ./live_a_' || doc_id || ' ' || plain || ' b ./live_b_' || doc_id || ' c ./live_c_' || doc_id || ' ' || plain || ' d ./live_d_' || doc_id || ' e ./live_e_' || doc_id AS said FROM d)
        SELECT 'src/d' || doc_id || '.tsx' AS path, spec, CASE substr(spec, 8, 1) WHEN 'a' THEN 'static' WHEN 'b' THEN 'dynamic' WHEN 'c' THEN 'require' WHEN 'd' THEN 'dynamic' ELSE 'reexport' END AS kind
        FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(said, '\./live_[a-e]_[0-9]+')) AS spec FROM t)""",
    "tree_filters": r"""WITH a AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'a/dist/' WHEN 2 THEN 'a/b/' ELSE '' END AS dir,
          CASE doc_id % 7 WHEN 0 THEN 'package.json' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'tsconfig.json' WHEN 3 THEN 'd' || doc_id || '.py' WHEN 4 THEN 'd.txt' WHEN 5 THEN 'x.d/readme' ELSE 'Main.TS' END AS name FROM documents)
        SELECT doc_id, dir || name AS path, dir NOT IN ('node_modules/', 'a/dist/') AND (doc_id % 7 IN (0, 1, 3, 6) OR (doc_id % 7 = 2 AND dir <> 'a/b/')) AS wanted,
          doc_id % 13 = 0 AS binary, doc_id % 7 IN (3, 6) AS source FROM a""",
    "oversized_files": """SELECT source AS repo_id, count(*) FILTER (WHERE length(text) > 2000) AS oversized, count(*) FILTER (WHERE length(text) <= 2000) AS kept FROM documents GROUP BY source""",
    "file_budgets": """WITH n AS (SELECT source AS repo_id, 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, row_number() OVER w AS nth, sum(length(text)) OVER w AS total
          FROM documents WINDOW w AS (PARTITION BY source ORDER BY 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        r AS (SELECT repo_id, count(*) FILTER (WHERE nth > 40 OR total > 60000) > 0 AS truncated FROM n GROUP BY repo_id)
        SELECT repo_id, path, truncated FROM n JOIN r USING (repo_id) WHERE nth <= 40 AND total <= 60000""",
    "recorded_paths": """WITH e AS (SELECT event_id, event_id % 9 AS kind, 'src/m' || (event_id % 10) || '.ts' AS file FROM events)
        SELECT event_id, CASE kind WHEN 2 THEN 'drive-absolute' WHEN 3 THEN 'drive-absolute' WHEN 4 THEN 'posix-absolute' WHEN 5 THEN 'unc' WHEN 6 THEN 'rooted' WHEN 7 THEN 'drive-relative' ELSE 'relative' END AS flavor,
          CASE kind WHEN 2 THEN 'C:' WHEN 3 THEN 'C:' WHEN 4 THEN '/' WHEN 5 THEN '//host/share' ELSE '' END AS prefix,
          CASE WHEN kind IN (2, 3, 4, 5) THEN 'srv/app/' || file WHEN kind = 7 THEN 'C:' || file ELSE file END AS segments, kind = 8 AS escaped FROM e""",
    # a root with a drive takes paths of that drive only, and none that leaves the root on its way
    "correlate_repositories": """SELECT event_id, CASE WHEN event_id % 8 < 7 THEN 'shop' || (event_id % 8) END AS repo_id,
        CASE WHEN event_id % 8 < 7 AND event_id % 10 < 8 AND event_id % 9 IN (0, 1, 2) THEN 'shop' || (event_id % 8) || ':src/m' || (event_id % 10) || '.ts' END AS node_id FROM events""",
    "text_outline": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        n AS (SELECT doc_id, name, min(pos) AS pos FROM (SELECT doc_id, pos, regexp_extract('class ' || line, '^\s*class\s+([A-Za-z_][0-9A-Za-z_]*)', 1) AS name FROM l) WHERE name <> '' GROUP BY doc_id, name)
        SELECT doc_id, symbols FROM documents LEFT JOIN (SELECT doc_id, string_agg(name, ',' ORDER BY pos) AS symbols FROM n GROUP BY doc_id) USING (doc_id)""",
}
