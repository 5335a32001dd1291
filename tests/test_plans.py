"""Plan properties that matter at scale: column pruning reaches the scans,
the line scan has no shuffle, and no Python operator sits in the hot path."""

import contextlib
import io
import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _read_schema(plan, table):
    m = re.search(rf"Location: \w+ \[[^\]]*{table}\.parquet\][^\n]*\n(?:.*\n)*?ReadSchema: struct<([^>]*)>", plan)
    return sorted(c.split(":")[0] for c in m.group(1).split(",")) if m else None


def test_pattern_scan_prunes_and_does_not_shuffle(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["pattern_scan"](spark, SF))
    assert _read_schema(p, "documents") == ["doc_id", "text"]
    assert "Exchange" not in p
    assert "Python" not in p and "ArrowEval" not in p


def test_order_quantities_read_two_lineitem_columns(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["clean_events"](spark, SF))
    assert _read_schema(p, "lineitem") == ["l_orderkey", "l_quantity"]


def test_ridge_backtest_has_no_python_operator(spark):
    import __spark_entry__ as E
    p = _plan(E.queries()["backtest_lag1"](spark, SF))
    assert "FlatMapGroupsInPandas" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p


@pytest.mark.parametrize("name,most", [("group_kfold_baseline", 12), ("allocation", 12), ("backtest_lag1", 15)])
def test_exchanges_of_the_last_plan(spark, name, most):
    """Of the plan that reads what the query wrote before (ranges, small tables)."""
    import __spark_entry__ as E
    tree = _plan(E.queries()[name](spark, SF)).split("\n\n(1)")[0]
    assert len(re.findall(r"[-+ ]Exchange \(", tree)) <= most
