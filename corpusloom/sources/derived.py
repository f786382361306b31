"""A ``files`` corpus derived from the ``documents`` and ``pages`` tables.

Neither table holds paths or source code, so each document becomes one file
whose project, directory, name and text follow from its columns; each project
also gets the marker files of one project kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANG_NUMBER = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END"
KIND = f"((doc_id % 20) * 4 + {LANG_NUMBER}) % 14"

DIRS = (
    "", "src/", "src/app/", "src/utils/deep/", "internal/service/", "docs/", "docs/api/", "test/",
    "node_modules/react/", ".git/", "src/vendor/lib/", "dist/", "src/app/core/",
)
NAMES = (
    ("main", ".go"), ("index", ".js"), ("app", ".spec.js"), ("view", ".tsx"), ("user", ".service.ts"),
    ("styles", ".css"), ("theme", ".scss"), ("page", ".html"), ("config", ".json"), ("settings", ".yaml"),
    ("guide", ".md"), ("script", ".py"), ("error", ".log"), ("logo", ".png"), ("util", ".go"),
    ("~$note", ".docx"), ("notes", ".txt"),
)

# Marker files of each kind; kind 7 has none.
MARKERS = {
    0: (
        ("nx.json", "{}"),
        ("apps/web/project.json", "{}"),
        ("apps/web/inner/project.json", "{}"),
        ("libs/ui/project.json", "{}"),
        ("package.json", "{}"),
    ),
    1: (("apps/a/main.ts", "a"), ("libs/b/main.ts", "b")),
    2: (("manifest.json", "{}"), ("background.js", "x"), ("popup.html", "<p></p>")),
    3: (("angular.json", "{}"), ("src/main.ts", "x")),
    4: (("go.mod", "module m\n"), ("go.sum", "h1\n")),
    5: (("package.json", '{"dependencies":{"react":"1"}}'),),
    6: (("go.mod", "module m\n"), ("package.json", "{}")),
    8: (("package.json", '{"dependencies":{"@angular/core":"1"}}'),),
    9: (("workspace.json", "{}"), ("libs/core/project.json", "{}"), ("packages/kit/project.json", "{}"), ("tools/lint/project.json", "{}")),
    10: (("package.json", "{}"), ("vue.config.js", "v"), ("src/App.vue", "<template></template>")),
    11: (("package.json", '{"devDependencies":{"svelte":"4"}}'),),
    # A module whose files lie many levels down.
    12: (("go.mod", "module deep\n"),),
    13: (("package.json", '{"dependencies":{"vue":"3"}}'), ("svelte.config.js", "s"), ("src/App.svelte", "<p/>")),
}
DEEP_KIND, DEEP = 12, "".join(f"level{i}/" for i in range(9))


DOCUMENTS = "doc_id bigint, text string, lang string, source string"
PAGES = "page_id bigint, url string, html string"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def _array(values: list[str]) -> str:
    return f"array({', '.join(values)})"


FOLDER = (
    f"CASE WHEN kind = 7 THEN 'docs/' WHEN kind = {DEEP_KIND} THEN concat(substring('{DEEP}', 1, 7 * (k % 10)), "
    f"{_array([_literal(d) for d in DIRS])}[k % 13]) ELSE {_array([_literal(d) for d in DIRS])}[k % 13] END"
)
STEM = f"{_array([_literal(stem) for stem, _ in NAMES])}[(k div 3) % 17]"
EXT = f"{_array([_literal(ext) for _, ext in NAMES])}[(k div 3) % 17]"
GO_SOURCE = (
    """concat('package p\\nimport (\\n\\t"fmt"\\n\\tal "x/', lang, '"\\n)\\ntype T', doc_id, ' struct {\\n}\\nfunc F', """
    """doc_id, '(a int) {\\n}\\nfunc hidden() {}\\nconst Max = 1\\n// ', text)"""
)
MARKER_ARRAYS = "CASE kind {} END".format(
    " ".join(
        "WHEN {} THEN {}".format(
            kind,
            _array([f"named_struct('path', {_literal(p)}, 'content', {_literal(c)})" for p, c in entries]),
        )
        for kind, entries in MARKERS.items()
    )
)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` from the documents table: one file per document, plus markers."""
    docs = (
        spark.read.schema(DOCUMENTS)
        .parquet(f"{sf_dir}/documents.parquet")
        .selectExpr(
            "concat(source, '-', lang) AS project", "doc_id", "lang", "text",
            "CAST(doc_id div 20 AS INT) AS k", f"CAST({KIND} AS INT) AS kind",
        )
    )
    # As a generated column the path is computed once per row; as a projected one
    # every later filter would repeat its whole expression.
    own = docs.selectExpr(
        "project", "doc_id", "lang", "text", f"{EXT} AS ext",
        f"explode(array(concat({FOLDER}, {STEM}, '_', doc_id, {EXT}))) AS path",
    ).selectExpr("project", "path", f"CASE WHEN ext = '.go' THEN {GO_SOURCE} ELSE text END AS content")
    markers = (
        docs.select("project", "kind").distinct().selectExpr("project", f"inline({MARKER_ARRAYS})")
    )
    return own.unionByName(markers).selectExpr(
        "project", "path", "CAST(octet_length(content) AS BIGINT) AS size", "content"
    )


def page_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` from the pages table: host as project, page id and URL path as path."""
    pages = spark.read.schema(PAGES).parquet(f"{sf_dir}/pages.parquet")
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    bare = F.regexp_replace(rest, r"[?#][\s\S]*", "")
    return pages.select(
        F.regexp_extract(bare, "^([^/]*)", 1).alias("project"),
        F.concat(F.col("page_id").cast("string"), F.regexp_replace(bare, "^[^/]*", "")).alias("path"),
        F.octet_length("html").cast("bigint").alias("size"),
        F.col("html").alias("content"),
    )
