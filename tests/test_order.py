"""Order statistics by ranges that follow the data: skewed values, ties, groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.operators import evaluate as EV
from panelkit.operators import stats as S
from panelkit.operators.order import order_table, placed, running
from panelkit.operators.prefix import prefix_sums


@pytest.fixture()
def ranges(spark):
    """Eight ranges, not merged because they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def skewed(n=4000, seed=1):
    r = np.random.default_rng(seed)
    v = np.exp(r.normal(0, 4, n)).round(4)  # log-normal, over many orders of magnitude
    v[r.random(n) < 0.3] = 1.5
    return v


def test_ranges_hold_equal_shares_of_skewed_values_and_ties(ranges):
    tied = np.where(np.random.default_rng(2).random(4000) < 0.9, 7.0, skewed())
    for v in (skewed(), tied):
        df = ranges.createDataFrame([(float(x),) for x in v], "v double")
        counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        parts = [r["count"] for r in placed(counts, ["v"]).groupBy("__pid").count().collect()]
        assert len(parts) > 4 and max(parts) <= 2 * sum(parts) / len(parts)


def test_order_table_counts_what_stands_before(ranges):
    r = np.random.default_rng(3)
    rows = [(None if i % 50 == 0 else "ab"[i % 2], float(x), int(r.integers(0, 3))) for i, x in enumerate(skewed(900))] + [("a", None, 1)]
    df = ranges.createDataFrame(rows, "g string, v double, c int")
    got = {(x.g, x.v, x.c): x for x in order_table(df, "v", ["g"], also=["c"]).collect()}
    clean = [x for x in rows if x[1] is not None]
    assert set(got) == set(clean)
    for (g, v, c), x in got.items():
        mine = [y for y in clean if y[0] == g]
        assert (x.n, x.n_ties, x.n_before, x.n_total) == (mine.count((g, v, c)), sum(y[1] == v for y in mine), sum(y[1] < v for y in mine), len(mine))
    assert order_table(df.limit(0), "v", ["g"]).count() == 0


def test_rank_statistics_on_skewed_values(ranges):
    v = skewed(1200)
    r = np.random.default_rng(5)
    w = v * np.exp(r.normal(0, 1, len(v)))
    y = (r.random(len(v)) < 1 / (1 + v)).astype(int)
    df = ranges.createDataFrame([(float(a), float(b), int(c), "xyz"[i % 3]) for i, (a, b, c) in enumerate(zip(v, w, y))], "v double, w double, y int, g string")
    p = pd.DataFrame({"v": v, "w": w, "y": y, "g": ["xyz"[i % 3] for i in range(len(v))]})
    assert S.spearman_pairs(df, ["v", "w"]).first().rho == pytest.approx(p.v.rank().corr(p.w.rank()), rel=1e-10)
    rank = p.v.rank()
    n, ties = len(p), p.v.value_counts()
    h = 12 / (n * (n + 1)) * sum(rank[p.g == g].sum() ** 2 / (p.g == g).sum() for g in "xyz") - 3 * (n + 1)
    assert S.kruskal(df, "g", "v").first().h_stat == pytest.approx(h / (1 - (ties**3 - ties).sum() / (n**3 - n)), rel=1e-9)
    pos, neg = v[y == 1], v[y == 0]
    pairs = (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2
    assert EV.roc_auc(df, "y", "v").first().auc == pytest.approx(pairs, rel=1e-10)
    for q in (0, 0.25, 0.5, 0.9, 1):
        got = {x.g: x.q for x in S.exact_quantiles(df, "v", {"q": q}, ["g"]).collect()}
        assert got == pytest.approx(p.groupby("g").v.quantile(q).to_dict(), rel=1e-12)
    curve = {x.score: (x.tp, x.k) for x in EV.pr_curve(df, "y", "v").collect()}
    assert curve == {s: (int(y[v >= s].sum()), int((v >= s).sum())) for s in np.unique(v)}


def test_fold_thresholds_equal_quantiles_of_the_other_folds(ranges):
    v, k = skewed(600, 9), 5
    fold = np.random.default_rng(1).integers(0, k, len(v))
    df = ranges.createDataFrame([(float(a), int(f)) for a, f in zip(v, fold)], "v double, fold int")
    got = EV.fold_thresholds(EV.fold_table(df, "v", "fold", k), "v", k, 0.75).first()
    for f in range(k):
        rest = v[fold != f]
        assert got.thresholds[f] == pytest.approx(np.quantile(rest, 0.75), rel=1e-12)
        assert (got.positives[f], got.negatives[f]) == ((rest >= got.thresholds[f]).sum(), (rest < got.thresholds[f]).sum())


def test_fold_without_training_rows(ranges):
    df = ranges.createDataFrame([(1.0, 0), (2.0, 0)], "v double, fold int")
    got = EV.fold_thresholds(EV.fold_table(df, "v", "fold", 2), "v", 2, 0.75).first()
    assert got.thresholds == [None, 1.75] and got.positives == [0, 1] and got.negatives == [0, 1]


def test_prefix_sums_with_null_keys_and_skew(ranges):
    v = skewed(500, 4)
    rows = [(None if i % 5 == 0 else "p", float(x), i, float(i % 7)) for i, x in enumerate(v)]
    got = {r.i: r.d_cum for r in prefix_sums(ranges.createDataFrame(rows, "p string, k double, i int, d double"), "p", "k", ["i"], ["d"]).collect()}
    for key in (None, "p"):
        total = 0.0
        for _, _, i, d in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total += d
            assert got[i] == pytest.approx(total)


def test_running_without_peers(ranges):
    df = ranges.createDataFrame([(i % 3, i, 1) for i in range(60)], "g int, i int, n int")
    got = running(placed(df, ["g", "i"]), ["g"], ["i"], ["n"], peers=False).collect()
    assert all(r.n_before == r.i // 3 and r.n_total == 20 for r in got)


def test_class_report_equals_counts(spark):
    rows = [(1, 1), (1, 0), (0, 0), (0, 0), (2, 1), (None, 1), (0, None)]
    got = {r["class"]: r for r in EV.class_report(spark.createDataFrame(rows, "y int, p int"), "y", "p").collect()}
    assert (got["1"].precision, got["1"].recall, got["1"].f1, got["1"].support) == (0.5, 0.5, 0.5, 2)
    assert (got["2"].precision, got["2"].recall, got["2"].f1, got["2"].support) == (0.0, 0.0, 0.0, 1)
    assert got["0"].precision == pytest.approx(2 / 3) and got["0"].recall == 1
    assert got["accuracy"].f1 == 0.6 and got["macro avg"].recall == 0.5 and got["weighted avg"].recall == pytest.approx(0.6)
