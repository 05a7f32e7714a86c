"""Fixed values that results depend on: word lists, extensions, patterns, limits."""

# --- files -----------------------------------------------------------------
# fixed values: directories whose content is never source
IGNORED_DIRS = [
    "node_modules", ".git", ".next", ".nuxt", ".svelte-kit", ".turbo", ".vercel",
    "dist", "build", "out", "coverage", "target", "vendor",
    ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".idea", ".vscode", ".cache", ".parcel-cache", ".gradle", "Pods",
    ".playwright-mcp", ".pnpm-store", "bower_components",
]
# fixed values: lock and metadata files
IGNORED_FILES = [
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "bun.lock",
    "poetry.lock", "Cargo.lock", "composer.lock", "Gemfile.lock",
    ".DS_Store", "tsconfig.tsbuildinfo",
]
# fixed values: source extensions
SOURCE_EXTENSIONS = [
    "ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts",
    "py", "pyi", "go", "rs", "rb", "java", "kt", "swift", "c", "h", "cc", "cpp", "hpp",
    "cs", "php", "ex", "exs", "scala", "sh", "bash", "zsh",
    "vue", "svelte", "astro", "sql", "graphql", "gql", "proto",
]
# fixed values: a second checkout below the tree
NESTED_CHECKOUT = r"(^|/)\.claude/worktrees/|(^|/)\.git/"
# fixed values: directories pruned while ingesting
INGEST_PRUNE = (
    r"(^|/)(node_modules|\.git|\.next|dist|build|out|coverage|target|vendor|venv|\.venv|"
    r"__pycache__|\.playwright-mcp|\.claude/worktrees)/"
)
# fixed value: results depend on it
TSCONFIG_NAME = r"(^|/)(tsconfig(\.\w+)?\.json|jsconfig\.json)$"
MANIFEST_NAME = r"(^|/)(package\.json|go\.mod|Cargo\.toml)$"
MAX_MANIFESTS = 200

# --- languages ---------------------------------------------------------------
# fixed values: extensions per extractor
SCRIPT_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"]
COMPONENT_EXTENSIONS = ["vue", "svelte", "astro"]
PYTHON_EXTENSIONS = ["py", "pyi"]
# fixed values: declaration patterns of the symbol outline, first match wins
OUTLINE_PATTERNS = [
    r"^\s*export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)",
    r"^\s*export\s+(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)",
    r"^\s*export\s+(?:const|let|var)\s+([A-Za-z_$][\w$]*)",
    r"^\s*export\s+(?:type|interface|enum)\s+([A-Za-z_$][\w$]*)",
    r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)",
    r"^\s*class\s+([A-Za-z_]\w*)",
    r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Z]\w*)",
    r"^\s*pub\s+(?:async\s+)?fn\s+([A-Za-z_]\w*)",
    r"^\s*pub\s+(?:struct|enum|trait)\s+([A-Za-z_]\w*)",
    r'(?i)^\s*create\s+(?:or\s+replace\s+)?(?:table|view|index|function|type)\s+(?:if\s+not\s+exists\s+)?["\w.]*?([A-Za-z_]\w*)',
]
# fixed value: results depend on it
EXPORT_LIST = r"^\s*export\s*\{([^}]*)\}"
# fixed values: runtime modules that are not packages
NODE_MODULES = [
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants",
    "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2",
    "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode",
    "querystring", "readline", "repl", "stream", "string_decoder", "sys", "test", "timers", "tls",
    "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib",
]
# fixed value: results depend on it
RUST_STD = ["std", "core", "alloc", "proc_macro", "test"]

# --- resolution ----------------------------------------------------------------
# fixed values: suffixes tried after a candidate path, in this order
PROBE_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte", ".astro",
    ".py", ".go", ".rs",
]
PROBE_INDEXES = [
    "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/__init__.py", "/mod.rs",
]
# fixed values: (extension on disk, extension written in the specifier, order)
PROBE_REWRITES = [
    (".ts", ".js", 0), (".tsx", ".js", 1), (".tsx", ".jsx", 0), (".mts", ".mjs", 0), (".cts", ".cjs", 0),
]

# --- roles -----------------------------------------------------------------------
# fixed values: (path pattern, role, contribution), first match wins
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
# fixed values: (content pattern, role, contribution)
CONTENT_HINTS = [
    (r"(?m)^\s*['\"]use client['\"]", "client component", "interface"),
    (r"\bimport\s+['\"]server-only['\"]", "server module", "business logic"),
]
# fixed value: results depend on it
DEFAULT_ROLE = ("source module", "logic")
DENSE_ROLES = ["test", "document", "schema migration", "ops script"]
DENSE_SHARE = 0.7
ROLLUP_DEPTH = 4
MAX_NODES = 220
MAX_EXTERNALS = 40

# --- explanations ------------------------------------------------------------------
# fixed values: package glossary and side-effect tags
PACKAGE_GLOSSARY = {
    "pg": "Postgres", "postgres": "Postgres", "jose": "JWT", "react": "React",
    "hono": "HTTP framework", "axios": "HTTP client", "undici": "HTTP client",
    "node-fetch": "HTTP client", "node:fs": "filesystem", "fs": "filesystem",
}
PACKAGE_TAGS = {
    "pg": "db", "postgres": "db", "hono": "network", "axios": "network", "undici": "network",
    "node-fetch": "network", "node:fs": "filesystem", "fs": "filesystem",
}

# --- traces ----------------------------------------------------------------------------
# fixed values: attribute keys whose value is never kept
SENSITIVE_KEYS = [
    "authorization", "cookie", "token", "secret", "password", "credential", "api-key", "api_key",
    "private-key", "private_key", "session", "db.statement", "db.query.text",
    "http.request.body", "http.response.body",
]
# fixed values: known keys per message
EXPORT_KEYS = ["resourceSpans"]
RESOURCE_SPANS_KEYS = ["resource", "scopeSpans", "schemaUrl"]
RESOURCE_KEYS = ["attributes", "droppedAttributesCount"]
SCOPE_SPANS_KEYS = ["scope", "spans", "schemaUrl"]
SCOPE_KEYS = ["name", "version", "attributes", "droppedAttributesCount"]
SPAN_KEYS = [
    "traceId", "spanId", "traceState", "parentSpanId", "flags", "name", "kind",
    "startTimeUnixNano", "endTimeUnixNano", "attributes", "droppedAttributesCount",
    "events", "droppedEventsCount", "links", "droppedLinksCount", "status",
]
EVENT_KEYS = ["timeUnixNano", "name", "attributes", "droppedAttributesCount"]
LINK_KEYS = ["traceId", "spanId", "traceState", "attributes", "droppedAttributesCount", "flags"]
STATUS_KEYS = ["message", "code"]
ATTRIBUTE_KEYS = ["key", "value"]
VALUE_KEYS = [
    "stringValue", "boolValue", "intValue", "doubleValue", "arrayValue", "kvlistValue", "bytesValue",
]
VALUE_LIST_KEYS = ["values"]
# fixed value: results depend on it
OTHER_SIGNALS = ["resourceMetrics", "resourceLogs", "resourceProfiles"]
UNKNOWN_SERVICE = "(unknown service)"
# import limits a caller may set; none holds unless given, but for the nesting depth of attribute values
IMPORT_LIMITS = dict.fromkeys([
    "maxInputBytes", "maxJsonLineBytes", "maxTraces", "maxSpans", "maxSpansPerTrace", "maxResourceScopeGroups",
    "maxAttributes", "maxEventsPerSpan", "maxLinksPerSpan", "maxValueBytes", "maxUnknownPaths",
]) | {"maxAttributeDepth": 8}
# fixed values: limits that suit one interactive process
SINGLE_PROCESS_LIMITS = {
    "maxInputBytes": 25 * 1024 * 1024,
    "maxJsonLineBytes": 8 * 1024 * 1024,
    "maxTraces": 10_000,
    "maxSpans": 50_000,
    "maxSpansPerTrace": 20_000,
    "maxResourceScopeGroups": 2_000,
    "maxAttributes": 128,
    "maxEventsPerSpan": 256,
    "maxLinksPerSpan": 128,
    "maxAttributeDepth": 8,
    "maxValueBytes": 16 * 1024,
    "maxUnknownPaths": 256,
}
# fixed values: (stable attribute, deprecated attribute)
SOURCE_ATTRIBUTES = {
    "path": ("code.file.path", "code.filepath"),
    "function": ("code.function.name", "code.function"),
    "line": ("code.line.number", "code.lineno"),
}
