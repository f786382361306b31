"""Registry of queries, and the SQL text their oracles share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import guard

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``; ``oracle`` is the DuckDB statement it must equal."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def guarded(spark: SparkSession, sf: str) -> DataFrame:
            guard(spark)
            return fn(spark, sf)

        QUERIES[name] = guarded
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return register


# The derived corpus of ``sources.derived`` in DuckDB SQL.
FILES = """
docs AS (
  SELECT source || '-' || lang AS project, doc_id, lang, text, doc_id // 20 AS k,
         ((doc_id % 20) * 4 + CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END) % 14 AS kind
  FROM documents
),
named_docs AS (
  SELECT project, doc_id, lang, text,
         CASE WHEN kind = 7 THEN 'docs/' ELSE
           CASE WHEN kind = 12 THEN substring('level0/level1/level2/level3/level4/level5/level6/level7/level8/', 1, (7 * (k % 10))::INT) ELSE '' END ||
           (['', 'src/', 'src/app/', 'src/utils/deep/', 'internal/service/', 'docs/', 'docs/api/', 'test/',
             'node_modules/react/', '.git/', 'src/vendor/lib/', 'dist/', 'src/app/core/'])[k % 13 + 1] END AS folder,
         (['main', 'index', 'app', 'view', 'user', 'styles', 'theme', 'page', 'config', 'settings', 'guide',
           'script', 'error', 'logo', 'util', '~$note', 'notes'])[(k // 3) % 17 + 1] AS stem,
         (['.go', '.js', '.spec.js', '.tsx', '.service.ts', '.css', '.scss', '.html', '.json', '.yaml', '.md',
           '.py', '.log', '.png', '.go', '.docx', '.txt'])[(k // 3) % 17 + 1] AS suffix
  FROM docs
),
bodies AS (
  SELECT project, folder || stem || '_' || doc_id || suffix AS path,
         CASE WHEN suffix = '.go' THEN
           'package p' || chr(10) || 'import (' || chr(10) || chr(9) || '"fmt"' || chr(10) || chr(9) || 'al "x/' ||
           lang || '"' || chr(10) || ')' || chr(10) || 'type T' || doc_id || ' struct {' || chr(10) || '}' ||
           chr(10) || 'func F' || doc_id || '(a int) {' || chr(10) || '}' || chr(10) || 'func hidden() {}' ||
           chr(10) || 'const Max = 1' || chr(10) || '// ' || text
         ELSE text END AS content
  FROM named_docs
  UNION ALL
  SELECT p.project, m.path, m.content
  FROM (SELECT DISTINCT project, kind FROM docs) p
  JOIN (VALUES
    (0, 'nx.json', '{}'), (0, 'apps/web/project.json', '{}'), (0, 'apps/web/inner/project.json', '{}'),
    (0, 'libs/ui/project.json', '{}'), (0, 'package.json', '{}'),
    (1, 'apps/a/main.ts', 'a'), (1, 'libs/b/main.ts', 'b'),
    (2, 'manifest.json', '{}'), (2, 'background.js', 'x'), (2, 'popup.html', '<p></p>'),
    (3, 'angular.json', '{}'), (3, 'src/main.ts', 'x'),
    (4, 'go.mod', 'module m' || chr(10)), (4, 'go.sum', 'h1' || chr(10)),
    (5, 'package.json', '{"dependencies":{"react":"1"}}'),
    (6, 'go.mod', 'module m' || chr(10)), (6, 'package.json', '{}'),
    (8, 'package.json', '{"dependencies":{"@angular/core":"1"}}'),
    (9, 'workspace.json', '{}'), (9, 'libs/core/project.json', '{}'), (9, 'packages/kit/project.json', '{}'), (9, 'tools/lint/project.json', '{}'),
    (10, 'package.json', '{}'), (10, 'vue.config.js', 'v'), (10, 'src/App.vue', '<template></template>'),
    (11, 'package.json', '{"devDependencies":{"svelte":"4"}}'),
    (12, 'go.mod', 'module deep' || chr(10)),
    (13, 'package.json', '{"dependencies":{"vue":"3"}}'), (13, 'svelte.config.js', 's'), (13, 'src/App.svelte', '<p/>')
  ) m(kind, path, content) ON p.kind = m.kind
),
files AS (
  SELECT project, path, content, octet_length(encode(content))::BIGINT AS size,
         string_split(path, '/') AS seg, string_split(path, '/')[-1] AS name,
         array_to_string(string_split(path, '/')[:-2], '/') AS parent
  FROM bodies
)
"""

LANGUAGE = """CASE lower(regexp_extract({path}, '\\.[^./]*$'))
  WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.cjs' THEN 'javascript'
  WHEN '.jsx' THEN 'jsx' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx'
  WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.scss' THEN 'scss' WHEN '.sass' THEN 'scss'
  WHEN '.css' THEN 'css' WHEN '.json' THEN 'json' WHEN '.yaml' THEN 'yaml' WHEN '.yml' THEN 'yaml'
  WHEN '.md' THEN 'markdown' WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.java' THEN 'java'
  WHEN '.c' THEN 'c' WHEN '.cpp' THEN 'cpp' WHEN '.cc' THEN 'cpp' WHEN '.cxx' THEN 'cpp'
  WHEN '.cs' THEN 'csharp' WHEN '.php' THEN 'php' WHEN '.rb' THEN 'ruby' WHEN '.rs' THEN 'rust'
  WHEN '.swift' THEN 'swift' WHEN '.kt' THEN 'kotlin' WHEN '.kts' THEN 'kotlin' WHEN '.sh' THEN 'bash'
  WHEN '.bash' THEN 'bash' WHEN '.xml' THEN 'xml' WHEN '.sql' THEN 'sql' ELSE 'text' END"""


def language_sql(path: str = "path") -> str:
    return LANGUAGE.format(path=path)


def fence_sql(path: str = "path") -> str:
    ext = f"lower(regexp_extract({path}, '\\.[^./]*$'))"
    return (
        f"CASE WHEN {ext} IN ('.scss', '.sass', '.less') THEN 'scss' "
        f"WHEN {ext} IN ('.html', '.htm') THEN 'html' ELSE {language_sql(path)} END"
    )


# Fixed values, stated again so that the oracle does not depend on the code under test:
# names excluded wherever they occur.
SYSTEM_NAMES = (
    "node_modules", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum",
    ".git", ".idea", ".vscode", "dist", "build", "out", "bin", "obj",
    "__pycache__", ".pytest_cache", "coverage", ".nyc_output",
    ".angular", ".nx", ".next", ".nuxt", "__tests__", "__snapshots__", "e2e",
    "*.log", "*.tmp", "*.bak",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.ico", "*.svg", "*.bmp", "*.webp",
    "project_structure.txt",
)
# Further names excluded as directories only.
SYSTEM_DIRS = ("vendor", "target", ".cache", "cypress")
# The default profile's own patterns.
DEFAULT_EXCLUDED = (".gitignore", ".DS_Store", "Thumbs.db", "*.log", "*.tmp", "*.bak")


def _any_name_sql(s: str, names: tuple[str, ...]) -> str:
    """``s`` is one of the names, or ends as a name with a leading star does."""
    tests = [f"ends_with({s}, '{n[1:]}')" if n.startswith("*") else f"{s} = '{n}'" for n in names]
    return f"({' OR '.join(tests)})"


def system_name_sql(s: str) -> str:
    """A name on the built-in list for files and directories."""
    return _any_name_sql(s, SYSTEM_NAMES)


def system_dir_sql(s: str) -> str:
    """A name on the built-in list for directories only."""
    return _any_name_sql(s, SYSTEM_DIRS)


def default_user_sql(s: str) -> str:
    """The default profile's own patterns."""
    return _any_name_sql(s, DEFAULT_EXCLUDED)


def excluded_sql(seg: str, extra: str = "false", important: str = "[]") -> str:
    """Default-profile name rules over a list of segments whose last one is a file.

    ``extra`` is a predicate on the segment ``s``; ``important`` a list of names.
    """
    entry = f"({system_name_sql('s')} OR {default_user_sql('s')} OR {extra})"
    keep = f"list_contains({important}::VARCHAR[], s)"
    return (
        f"(len(list_filter({seg}, lambda s: {entry} AND NOT {keep})) > 0 OR "
        f"len(list_filter({seg}[:-2], lambda s: {system_dir_sql('s')} AND NOT {keep})) > 0)"
    )


def pruned_sql(seg: str, extra: str = "false", important: str = "[]") -> str:
    """The same for a list of segments that are all directories."""
    entry = f"({system_name_sql('s')} OR {system_dir_sql('s')} OR {default_user_sql('s')} OR {extra})"
    return f"(len(list_filter({seg}, lambda s: {entry} AND NOT list_contains({important}::VARCHAR[], s))) > 0)"
