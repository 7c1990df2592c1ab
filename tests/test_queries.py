"""Every registered query of the library runs, and agrees with its SQL where it has some."""

import oracle
import pytest

from evidora.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        oracle.same(rows, duck.execute(ORACLE_SQL[name]).fetch_df())
    else:
        assert len(rows.columns) > 0


def test_registry_is_complete():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_package(tmp_path):
    """The registry works where the optional package and pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "evidora", tmp_path / "evidora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'vector_topk' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
