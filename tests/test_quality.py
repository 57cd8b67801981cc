import json

import pytest
from pyspark.sql import functions as F

from tidemill.operators import quality as q

from .conftest import rows

FRAME = [(1, 100.0, "active"), (1, None, "active"), (3, 50.0, "inactive")]
SCHEMA = "customer_id int, amount double, status string"


def test_checks(spark):
    df = spark.createDataFrame(FRAME, SCHEMA)
    parent = spark.createDataFrame([(1,)], "id int")
    c = q.Checks(df).row_count(1, 10).null_share("amount", 0.2).value_range("amount", 60, None).schema(["customer_id", "z"]).duplicates(["customer_id"], 0.5).references("customer_id", parent, "id").completeness(0.8)
    got = {r["check"]: (r["passed"], round(r["value"], 4)) for r in c.results().collect()}
    assert got == {"row_count": (True, 3), "null_share:amount": (False, 0.3333), "value_range:amount": (False, 1), "schema": (False, 1), "duplicates:customer_id": (True, 0.3333), "references:customer_id": (False, 1), "completeness": (True, 0.8889)}
    s = q.summary(c.results()).first()
    assert (s["total"], s["passed"], s["failed"], s["all_passed"]) == (7, 3, 4, False)
    with pytest.raises(q.QualityError):
        q.gate(c.results())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    got = {r["check"]: r["passed"] for r in q.Checks(df).row_count(1).null_share("amount").value_range("amount", 0, 1).freshness("status", "2024-01-01", 1).duplicates(["customer_id"]).results().collect()}
    assert got == {"row_count": False, "null_share:amount": True, "value_range:amount": False, "freshness:status": False, "duplicates:customer_id": True}


def test_config(spark):
    df = spark.createDataFrame(FRAME, SCHEMA)
    out = q.run_checks(df, {"row_count": {"min": 1, "max": 2}, "null_checks": {"amount": 0.5}, "expected_columns": ["status"], "unique_keys": ["customer_id", "amount"]})
    assert {r["check"]: r["passed"] for r in out.collect()} == {"row_count": False, "null_share:amount": True, "schema": True, "duplicates:customer_id,amount": True}


def test_contract(spark):
    df = spark.createDataFrame(FRAME, SCHEMA)
    text = json.dumps({"required_columns": "customer_id, amount,extra", "unique_columns": ["customer_id"], "min_rows": 4, "max_null_ratio": 0.2, "allowed_values": {"status": ["active"]}, "note": "x"})
    contract = q.Contract.from_json(text)
    found = {(r["rule"], r["column"]) for r in q.contract_violations(df, contract).collect()}
    assert found == {("required_columns", "extra"), ("min_rows", ""), ("max_null_ratio", "amount"), ("allowed_values", "status"), ("unique_columns", "customer_id")}
    with pytest.raises(q.QualityError):
        q.enforce(df, contract)
    assert q.enforce(df, q.Contract(required_columns=("status",))) is df


@pytest.mark.parametrize(("values", "good"), [([None, None], False), (["", "   "], False), (["nan", " NaN "], False), ([None, "   "], False), (["C-100", "  "], True)])
def test_blank_keys(spark, values, good):
    df = spark.createDataFrame([(v, 1) for v in values], "customer_id string, x int")
    assert q.contract_violations(df, q.Contract(required_columns=("customer_id",))).isEmpty() is good


def test_repeated_nulls_are_duplicates(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "k int")
    assert rows(q.contract_violations(df, q.Contract(unique_columns=("k",))).select("rule", "found")) == [("unique_columns", 1.0)]


def test_split_is_a_partition(spark):
    df = spark.createDataFrame(FRAME, SCHEMA)
    good, bad = q.split_rows(df, {"amount": F.col("amount") > 60, "status": F.col("status") == "active"})
    assert good.count() + bad.count() == df.count()
    assert rows(bad.select("customer_id", "reasons")) == [(1, ["amount"]), (3, ["amount", "status"])]


def test_row_queries(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(q.failing_unique(df, "k")) == [(1, 2)] and q.failing_not_null(df, "k").count() == 1 and rows(q.failing_accepted(df, "k", [2])) == [(1, 2)]
