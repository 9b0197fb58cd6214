"""Every registered query of the library against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from gridloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, data):
    def plain(v):
        return round(float(v), 6) + 0.0 if isinstance(v, float) else v

    return sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_other_folders(tmp_path):
    """A copy of the repository without the subpackage and the pipeline still has all other queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "gridloom"), tmp_path / "gridloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; print(e.HERE, *sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True, timeout=120).stdout.split("\n")
    assert made[0].split() == [str(tmp_path), *sorted(registry.QUERIES)] and made[1].split() == sorted(registry.ORACLE_SQL)


def test_relation_plan_has_no_cross_join_and_prunes_columns(spark):
    plan = registry.QUERIES["box_relation"](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "l_extendedprice" not in plan.split("== Physical Plan ==")[1]


def test_every_frame_is_embedded(spark):
    frames = {(r.image_id, r.box_id) for r in registry.fx.frames(spark, DATA).collect()}
    out = registry.QUERIES["embed_boxes"](spark, DATA).groupBy("image_id", "box_idx").count().collect()
    assert len(frames) == 15 * 4 and {(r.image_id, r.box_idx) for r in out} == frames
    assert {r["count"] for r in out} == {64}
