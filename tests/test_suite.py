"""Every registered query against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import suite
from tests.conftest import DATA

SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(suite.SQL))
def test_like_sql(spark, con, name):
    df = entry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    found = con.execute(suite.SQL[name])
    names = [d[0] for d in found.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(want, key=str)


def test_entry(spark):
    assert entry.entry(spark).columns[-1] == "rank"
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(suite.QUERIES) == set(suite.SQL)


def test_without_the_optional_folders(tmp_path):
    root = Path(entry.__file__).resolve().parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'term_and' in q and not any(k.startswith('op') for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)
    # a part that is there but broken isn't passed over
    (tmp_path / "lodestone/llm").mkdir()
    (tmp_path / "lodestone/llm/__init__.py").write_text("")
    (tmp_path / "lodestone/llm/queries.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True).returncode
