"""Every query of the entry module against its SQL, where it has one."""

from __future__ import annotations

import math

import duckdb
import pytest

from densika.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(frame, con, name):
    df = frame(name)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    if name not in oracles.oracle_sql():
        assert got
        return
    want = con.sql(oracles.oracle_sql()[name])
    assert sorted(want.columns) == names
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert got == sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)


def test_every_sql_has_a_query():
    assert set(oracles.oracle_sql()) <= set(queries.queries())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["voxel", "mean", "std", "snr"] and df.count() > 0


def test_entry_without_the_subpackage(tmp_path):
    """With the subpackage and the pipeline gone the entry still imports and has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "densika", tmp_path / "densika", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bias_solve' in q and not any(k.startswith('op1_') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
