import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tests.conftest import SF
from vellumry.plans import catalog

ROOT = Path(__file__).resolve().parents[1]


def _rows(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["p16_newest_search", "w1_newest_wins", "r4_one_way_managed", "r7_expected_paths", "e2_committed", "j9_priority_match", "u6_key_changes", "a2_outbox_counters"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({catalog.ORACLE[name]})").fetchall()
    assert _rows(map(tuple, df.select(*names).collect())) == _rows(want)


def test_every_query_is_planned_with_distinct_names(spark):
    assert len(catalog.QUERIES) > 100 and set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_entry_without_the_subpackage(tmp_path):
    """The entry module imports and offers the other queries when corpus_pipeline.py and the llm folders are gone."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" not in rel.parts and rel.name != "corpus_pipeline.py":
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
