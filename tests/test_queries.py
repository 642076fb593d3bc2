"""Every registered query runs on the smallest tables, and agrees with its SQL where there is one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from scholia.plans.more_oracle import MORE
from scholia.plans.oracle import ORACLE as FIRST
from scholia.plans.queries import QUERIES

ORACLE = FIRST | MORE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return str(value)
    try:
        return round(float(value), 5)
    except (TypeError, ValueError):
        return str(value)


def rows(names, values):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(v[i]) for i in at) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        con = duck.execute(ORACLE[name])
        assert got == rows([d[0] for d in con.description], con.fetchall())


def test_registry(spark):
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_library_stands_without_the_corpus_operators(tmp_path):
    """Nothing outside scholia.llm imports it but the entry's guard."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    (tmp_path / "scholia").mkdir()
    for p in (root / "scholia").iterdir():
        if p.name != "llm":
            (tmp_path / "scholia" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'] and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})
