import datetime as dt

import pytest
from pyspark.sql import functions as F

from basinframe.errors import ContractViolation, SourceUnavailable
from basinframe.operators import contracts as c
from basinframe.sources import store

SIMPLE = c.Contract(
    "demo",
    {
        "id": c.non_null("bigint", c.ge(0)),
        "code": c.non_null("string", c.isin(["a", "b"])),
        "x": c.nullable("double", c.in_range(0, 10)),
    },
    unique=("id",),
)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, code string, x double")


def test_all_failures_are_counted(spark):
    df = frame(spark, [(1, "a", 1.0), (1, "b", 11.0), (-2, "z", None), (3, None, float("nan"))])
    got = {r["check"]: r["n_failed"] for r in SIMPLE.failures(df).collect()}
    assert got["id:ge"] == 1
    assert got["code:isin"] == 1
    assert got["code:not_null"] == 1
    assert got["x:in_range"] == 2  # 11 and NaN, which is above every number
    assert got["x:not_nan"] == 1
    assert got["unique:id"] == 2
    with pytest.raises(ContractViolation, match="unique:id=2"):
        SIMPLE.enforce(df)


def test_good_rows_pass(spark):
    df = frame(spark, [(1, "a", 1.0), (2, "b", None)])
    assert SIMPLE.enforce(df).count() == 2


def test_split_and_offending(spark):
    good, bad = SIMPLE.split(frame(spark, [(1, "a", 1.0), (2, "z", 99.0)]))
    assert good.count() == 1
    assert set(bad.first()["failed_checks"]) == {"code:isin", "x:in_range"}


def test_hash_ignores_order_but_not_duplicates(spark):
    rows = [(i, "a", float(i)) for i in range(50)]
    a = c.content_hash(frame(spark, rows).repartition(7)).first()
    b = c.content_hash(frame(spark, rows[::-1]).coalesce(1)).first()
    twice = c.content_hash(frame(spark, rows + rows[:2] * 2)).first()
    assert a == b
    assert a["content_sha256"] != twice["content_sha256"]


def test_guards(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    value, junk = c.strict_double("v", ["-"])
    with pytest.raises(ContractViolation, match="junk"):
        c.guard(df, "s", [c.Guard("junk", junk)])
    c.guard(df, "s", [c.Guard("junk", junk, allowed=1)])
    with pytest.raises(SourceUnavailable):
        c.guard(df.where("false"), "s", [], empty="nothing")
    assert [r[0] for r in df.select(value).collect()] == [1.0, None]


def test_provenance_rules():
    with pytest.raises(ValueError, match="time zone"):
        c.Provenance("s", dt.datetime(2026, 1, 1), "u", "v")
    with pytest.raises(ValueError, match="blank"):
        c.Provenance(" ", dt.datetime(2026, 1, 1, tzinfo=dt.UTC), "u", "v")


def test_store_round_trip_and_rejection(spark, tmp_path):
    root = str(tmp_path)
    prov = c.Provenance("demo", dt.datetime(2026, 7, 18, tzinfo=dt.UTC), "https://x.example", "demo:1")
    store.run_source(frame(spark, [(1, "a", 1.0)]), SIMPLE, prov, "t", root)
    store.run_source(frame(spark, [(1, "a", 1.0), (2, "b", 2.0)]), SIMPLE, prov, "t", root)
    with pytest.raises(ContractViolation):
        store.run_source(frame(spark, [(1, "q", 1.0)]), SIMPLE, prov, "t", root)
    with pytest.raises(SourceUnavailable):
        store.run_source(frame(spark, []), SIMPLE, prov, "t", root)
    ledger = store.read_ledger(spark, root)
    assert ledger.count() == 2
    table = store.read_table(spark, root, "t")
    assert table.count() == 2
    assert set(c.PROVENANCE_COLUMNS) <= set(table.columns)
    assert store.read_table(spark, root, "other") is None
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2  # the rejected one is gone
    wanted = spark.createDataFrame([("t",), ("other",)], "table string")
    got = {r["table"]: r["available"] for r in store.availability(wanted, ledger).collect()}
    assert got == {"t": True, "other": False}
    assert store.data_mode(ledger, False).first()["mode"] == "LIVE"
    assert store.data_mode(ledger.where("false"), False).first()["mode"] == "SHELL"
    assert store.data_mode(ledger, True).first()["mode"] == "SNAPSHOT"


def test_monotone_rule(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 1, 1), ("b", 2, 1)], "g string, i int, v int")
    rule = c.Contract("m", {"v": c.non_null("int")}, monotone=(c.Monotone("v_rises", ("g",), "i", "v"),))
    got = {r["check"]: r["n_failed"] for r in rule.failures(df).collect()}
    assert got["group:v_rises"] == 1


def test_truncated(spark):
    df = spark.createDataFrame([("5", 3), ("3", 3), (None, 1)], "t string, n int")
    assert [r[0] for r in df.select(c.truncated(F.col("t"), F.col("n"))).collect()] == [True, False, False]


def test_guard_report_agrees_with_guard(spark):
    """A source stops in the report exactly when its own load raises."""
    rows = [("a", i, i % 4 == 0) for i in range(12)] + [("b", 1, False), ("c", None, True), (None, 5, True)]
    df = spark.createDataFrame(rows, "s string, v int, odd boolean")
    rules = [c.Guard("odd", F.col("odd"), allowed=2), c.Guard("no value", F.col("v").isNull())]
    sources = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s string")
    out = c.guard_report(df, "s", rules, expected=sources).collect()
    got = {(r["s"], r["rule"]): (r["n_bad"], r["stops"]) for r in out}
    assert got["a", "odd"] == (3, True) and got["a", "no value"] == (0, False) and got["c", "odd"] == (1, False)
    assert got["d", "no rows"] == (1, True) and got["d", "odd"] == (0, False) and len(got) == 12
    for s in "abcd":
        stops = any(r["stops"] for r in out if r["s"] == s)
        if stops:
            with pytest.raises(c.DataError):
                c.guard(df.where(F.col("s") == s), s, rules, empty="no rows")
        else:
            c.guard(df.where(F.col("s") == s), s, rules, empty="no rows")
    assert c.guard_report(df.where("false"), "s", rules).count() == 0
