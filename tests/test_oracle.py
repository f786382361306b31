"""Each registered query equals its oracle statement on whole tables."""

from __future__ import annotations

import ast
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from corpusloom.queries import QUERIES
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, sf_dir, name):
    diff = difference(spark, con, sf_dir, contract.queries()[name], contract.oracle_sql()[name])
    assert diff is None, diff


LOOKUPS = (
    "select_list", "select_patterns", "bulk_select", "profile_decisions", "tree_last_sibling", "tree_lines",
    "subproject_files", "subproject_pick", "section_monorepo", "document_lines",
    "select_pattern_table", "document_pieces", "document_selected",
)


@pytest.mark.parametrize("name", LOOKUPS)
def test_plans_without_broadcasts_give_the_same(spark, con, sf_dir, name):
    """Every lookup takes the way it takes for tables beyond the limit."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        diff = difference(spark, con, sf_dir, contract.queries()[name], contract.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert diff is None, diff


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["project", "lang", "n_files", "n_bytes"] and df.count() > 0


def test_no_hints_and_no_collect_in_operators():
    """But for the module that counts what it collects and sends."""
    root = Path(__file__).parent.parent / "corpusloom"
    allowed = {"ranking.py"}
    for file in root.rglob("*.py"):
        if "llm" in file.relative_to(root).parts:
            continue
        nodes = [n.func for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, ast.Call)]
        calls = {f.attr for f in nodes if isinstance(f, ast.Attribute)}
        banned = calls & {"broadcast", "crossJoin", "localCheckpoint", "toPandas", "collect"}
        assert not banned or file.name in allowed, (file, banned)


def test_runs_from_another_folder(tmp_path):
    """Executors get the package sent; they do not find it in the working directory."""
    root = Path(__file__).parent.parent
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from corpusloom.session import build_session\n"
        "import __spark_entry__ as e\n"
        "spark = build_session('local[2]', spark__sql__shuffle__partitions=2)\n"
        "print('rows', e.queries()['profile_decisions'](spark, '/root/testdata/sf0.001').count())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
