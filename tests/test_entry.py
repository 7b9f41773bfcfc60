import __spark_entry__ as entry


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns == ["spud_year", "wildcats", "discoveries", "success_rate"] and df.count() > 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


def test_scans_read_only_what_they_need(spark, sf):
    plan = entry.queries()["agreement_bands"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_discount:double>" in plan
    plan = entry.queries()["country_flows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan


def test_intermediate_tables_can_be_discarded(tmp_path):
    import subprocess
    import sys

    code = f"""
from pathlib import Path
from basinframe.session import discard_scratch, local_session, materialize
spark = local_session("2", "scratch", spark__checkpoint__dir="{tmp_path}")
assert materialize(spark.range(3)).count() == 3 and len(list(Path("{tmp_path}").rglob("*.parquet"))) > 0
discard_scratch(spark)
assert not list(Path("{tmp_path}").rglob("*.parquet"))
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
