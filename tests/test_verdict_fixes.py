"""Faults that the test tables do not show."""

import pytest
from pyspark.sql import functions as F

from panelkit import session
from panelkit.functions.text import coerce_double, strip_ws
from panelkit.operators import quality as Q
from panelkit.operators import stats
from panelkit.sources.readers import read_csv


def test_coerce_takes_plain_numbers_only(spark):
    df = spark.createDataFrame([("NaN",), ("12d",), ("1.5f",), (" 7 ",), ("-.5e2",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(coerce_double("v")).collect()] == [None, None, None, 7.0, -50.0, None, None]


def test_strip_takes_a_no_break_space(spark):
    df = spark.createDataFrame([("  Peru\t ",)], "v string")
    assert df.select(strip_ws("v")).first()[0] == "Peru"


def test_csv_with_breaks_and_quotes_in_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,n\n1,"line one\nline two",5\n2,"say ""hi"", ok",6\n')
    rows = read_csv(spark, str(tmp_path), "id int, t string, n int").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "line one\nline two", 5), (2, 'say "hi", ok', 6)]


def test_own_expression_under_a_fixed_label_finds_its_hits(spark):
    lines = spark.createDataFrame([(1, 1, "me at home dot org")], "doc_id long, line_no long, line string")
    own = [("personal_data", "email_address", r"\bat\b.*\bdot\b", None)]
    assert Q.pattern_scan(lines, own).count() == 1


def test_chi_square_of_huge_counts(spark):
    counts = spark.createDataFrame([(4 * 10**11,), (4 * 10**11 + 10**6,)], "o long")
    r = stats.chi2_gof_counts(counts).first()
    assert r.df == 1 and r.chi2 == pytest.approx(10**12 / (8 * 10**11 + 10**6), rel=1e-9)


def test_checkpoint_folder_is_required_off_local():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://x:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_copies_are_deleted(spark):
    before = list(session._WRITTEN)
    session._WRITTEN.clear()
    kept = dict(session._BUILT)
    path = session.cut_lineage(spark.range(3)).inputFiles()[0].replace("file://", "")
    import os
    assert os.path.exists(path) and session.drop_copies(spark) == 1 and not os.path.exists(path)
    session._WRITTEN.extend(before)
    session._BUILT.update(kept)


def test_histogram_keeps_empty_bins(spark):
    from panelkit.operators.describe import histogram
    df = spark.createDataFrame([(0.0,), (1.0,), (100.0,), (None,)], "v double")
    h = {r.bin: r.n for r in histogram(df, "v", 50).collect()}
    assert h == {b: 2 if b == 0 else 1 if b == 49 else 0 for b in range(50)}
    assert histogram(df.filter("v IS NULL"), "v", 50).count() == 0


def test_pivot_with_a_column_list_fails_on_other_values(spark):
    from panelkit.operators.describe import pivot_wide
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "r string, c string, v double")
    assert pivot_wide(df, "r", "c", "v", values=["x", "y"]).first().asDict() == {"r": "a", "x": 1.0, "y": 2.0}
    with pytest.raises(Exception, match="column list lacks"):
        pivot_wide(df, "r", "c", "v", values=["x"]).collect()


def test_calibration_scores_held_out_rows_only(spark):
    """Labels are coin flips: a classifier that saw a row knows its label, so
    calibrated in-sample scores would be near 0 and 1."""
    import numpy as np
    from panelkit.operators import models as MD
    rng = np.random.default_rng(5)
    rows = [(i % 3, float(a), float(rng.integers(2))) for i, a in enumerate(rng.normal(0, 1, 300))]
    _, x, _ = MD.design(spark.createDataFrame(rows, "__fold int, a double, y double"), ["a"])
    seen = []

    def fit(d):
        seen.append({r["__fold"] for r in d.select("__fold").distinct().collect()})
        return MD.forest_classifier(MD.balanced_weights(d, "y"), "y", trees=10)

    pairs = MD.isotonic_calibrate(x, "y", fit, 3)
    assert sorted(map(sorted, seen)) == [[0, 1], [0, 2], [1, 2]]
    out = MD.apply_calibration(x, pairs).select("proba_cal").collect()
    assert len(out) == 300 and all(0 <= r[0] <= 1 for r in out)
    # held-out maps of a classifier without signal stay near the base rate
    assert np.std([r[0] for r in out]) < 0.25
