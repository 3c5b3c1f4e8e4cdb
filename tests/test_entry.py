"""The driver contract, plus an oracle spot-check of a few registered queries at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from prepline.catalog import ORACLE, QUERIES
from prepline.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 6 and "potential_role" in df.columns


def test_every_query_has_callable_and_sql_names_match():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 150
    assert set(o) <= set(q)
    # the training-data queries come from their own subpackage, never from the catalogue
    assert not [n for n in QUERIES if "pipeline" in n.split("_")[0] or n.startswith("op")]


def test_entry_loads_without_the_training_data_folder(tmp_path):
    """A copy without prepline/llm, with and without corpus_pipeline.py, still has all other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "prepline"), tmp_path / "prepline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
    want = f"{len(QUERIES)} {len(ORACLE)}"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    for pipeline in ("from prepline.llm import line_dedup\n", None):
        if pipeline is not None:
            (tmp_path / "corpus_pipeline.py").write_text(pipeline)
        else:
            (tmp_path / "corpus_pipeline.py").unlink()
        got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
        assert got.stdout.split("\n")[-2] == want


@pytest.mark.parametrize("name", ["a9_column_profile_orders_missing", "r3_r4_types_and_roles_catalogue", "m1_classify_prompts_conversations", "f23_stratified_split", "e2_roc_auc", "t18_ses_daily_revenue", "w4_autocorrelation_daily_revenue"])
def test_oracle_spot(spark, name):
    import math

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 4)
        return str(v) if v is not None and not isinstance(v, (int, bool)) else v

    order = sorted(dcols)
    s = sorted(repr(tuple(norm(r[c]) for c in order)) for r in sdf.collect())
    d = sorted(repr(tuple(norm(dict(zip(dcols, r))[c]) for c in order)) for r in res.fetchall())
    assert s == d
