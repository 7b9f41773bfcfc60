"""The registered screening runs the operator's own number of draws."""

from basinframe.operators import economics as ec
from __spark_entry__ import queries


def test_block_screening_draws(spark, sf):
    p = [r["p_emv_positive"] for r in queries()["block_screening"](spark, sf).collect() if r["p_emv_positive"] is not None]
    assert all(abs(x * 10_000 - round(x * 10_000)) < 1e-6 for x in p)
    assert any(abs(x * 50 - round(x * 50)) > 1e-6 for x in p)


def test_scenario_summary_draws(spark, sf):
    assert {r["n_draws"] for r in queries()["scenario_summary"](spark, sf).collect()} == {10_000}


def test_chance_without_points(spark):
    """The chance alone is that of the whole spread."""
    row = (1.0, 0.2, 50.0, 100.0, 200.0, 60.0, 0.1, 0.3, 8.0, 80.0, 700.0)
    names = "block_id pg p90 p50 p10 price_usd_bbl royalty_rate cit_rate opex_usd_bbl well_cost_musd dev_capex_musd".split()
    blocks = spark.createDataFrame([(float(i), *row[1:]) for i in range(4)], names).selectExpr("*", "p50 AS resource_mmbbl")
    whole = ec.scenario_spread(blocks, 500).select("block_id", "p_emv_positive", "n_draws")
    alone = ec.scenario_spread(blocks, 500, points=False)
    assert alone.columns == whole.columns
    assert sorted(alone.collect()) == sorted(whole.collect())
