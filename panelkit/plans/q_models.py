"""Catalogue, part 9: MLlib models (no SQL oracle; checked by unit tests
and by orderings such as 'beats the majority baseline').

* P2 (nation x month, balanced) carries the multi-horizon forecasts.
* P1 (customer x year, balanced) carries classification, regression and
  clustering, so the fitting work grows with the number of customers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.numeric import expm1_inverse, flag, log1p_target, rnd, weighted_score
from ..operators import evaluate as EV
from ..operators import features as FT
from ..operators import models as MD
from ..operators.describe import entity_profile
from ..operators.joins import with_scalars
from ..operators.panel import balance_panel
from ..operators.ridge import fit_ridge_cv, predicted
from ..session import cut_lineage
from .q_build import P1_SQL
from .q_panel import FEATURES, balanced_group_panel, dense_features
from .registry import register
from .roles import p1_panel
from .q_stats import TRAIN_LAST_MONTH

HORIZONS = (1, 5, 10)
TARGETS = ("raw", "log1p")
# Forests have the operators' published sizes; ridge chooses among 25 penalties.


def _horizon_frame(spark, root, *more):
    """The design of the multi-horizon models, written once: MLlib's vector, the
    same as an array, and which features are numeric (ridge scales those by the
    training rows; one-hot columns stay 0/1)."""
    _, x, names = MD.design(dense_features(spark, root), FEATURES + ["month_idx"], ["region"], drop_first=False)
    x = x.select("n_name", "month_idx", "features", vector_to_array("features").alias("x"), *[f"y_plus{h}" for h in HORIZONS], *more)
    return x, [i < len(FEATURES) + 1 for i in range(len(names))]


def _target(df, label, target):
    return df.withColumn("__y", log1p_target(label) if target == "log1p" else F.col(label).cast("double"))


def _on_scale(df, upper, target):
    """Predictions on the scale of the counts: those of log1p targets, between 0
    and the largest training target, are transformed back; raw ones stay."""
    return df.withColumn("prediction", expm1_inverse(F.greatest(F.col("prediction"), F.lit(0.0)), upper)) if target == "log1p" else df


def direct_horizons(spark, root):
    """M22 + M9 + M15 + M16 + E1: one model per horizon, train <= the last
    training month, RMSE on later months, raw and log1p targets: a forest and a
    ridge on scaled features whose penalty is chosen by leave-one-out. The design
    frame is written once; the six (horizon, target) fits run concurrently."""
    x, scale = _horizon_frame(spark, root)
    x = cut_lineage(x)

    def run(job):
        h, target = job
        lab = f"y_plus{h}"
        d = _target(x.filter(F.col(lab).isNotNull()), lab, target)
        train, test = d.filter(F.col("month_idx") <= TRAIN_LAST_MONTH), d.filter(F.col("month_idx") > TRAIN_LAST_MONTH)
        n, upper = train.agg(F.count(F.lit(1)), F.max("__y")).first()
        ridge = fit_ridge_cv(train, "x", "__y", scale)
        scored = {"rf": MD.forest_regressor(train, "__y").transform(test),
                  "ridge": test.withColumn("prediction", predicted(ridge, "x"))}
        rmse = {m: EV.rmse_r2(_on_scale(p, upper, target), lab, "prediction").first().rmse for m, p in scored.items()}
        return rmse["rf"], rmse["ridge"], ridge[0].alpha, n, test.count()

    jobs = [(h, t) for h in HORIZONS for t in TARGETS]
    by = dict(zip(jobs, MD.parallel_fits(run, jobs)))
    rows = [(h, *by[h, "raw"][:2], *by[h, "log1p"][:2], by[h, "raw"][2], by[h, "log1p"][2], *by[h, "raw"][3:]) for h in HORIZONS]
    return spark.createDataFrame(rows, "horizon int, rmse_rf double, rmse_ridge double, rmse_rf_log_target double, "
                                       "rmse_ridge_log_target double, alpha double, alpha_log_target double, n_train long, n_test long")


register("direct_horizons")(direct_horizons)


def forward_forecast(spark, root):
    """Deploy one forest per horizon on all labelled rows and forecast
    every nation from its last month (fits run concurrently)."""
    f = dense_features(spark, root)
    _, x, _ = MD.design(f, FEATURES + ["month_idx"], ["region"])
    x = cut_lineage(x.select("n_name", "month_idx", "features", *[f"y_plus{h}" for h in HORIZONS]))
    anchor = x.agg(F.max("month_idx").alias("__a"))
    last = with_scalars(x, anchor).filter(F.col("month_idx") == F.col("__a"))
    models = MD.parallel_fits(
        lambda h: MD.forest_regressor(x.filter(F.col(f"y_plus{h}").isNotNull()), f"y_plus{h}"), HORIZONS)
    out = None
    for h, m in zip(HORIZONS, models):
        p = m.transform(last).select("n_name", F.col("month_idx").alias("anchor"), F.lit(h).alias("horizon"),
                                     (F.col("month_idx") + h).alias("forecast_period"),
                                     rnd(F.greatest(F.col("prediction"), F.lit(0.0)), 4).alias("forecast"))
        out = p if out is None else out.unionByName(p)
    return out


register("forward_forecast")(forward_forecast)


# ---------------------------------------------------------------- P1 models

P1_TRAIN_LAST_YEAR = 1999


def p1_features(spark, root):
    """Customer-year features, written once: quantiles, scaling, level lists and
    weights all read them."""
    p = p1_panel(spark, root)
    b = balance_panel(p, "c_custkey", "year", zero_cols=["n_events"], carry_cols=["amount", "qty"],
                      attr={"region": "r_name"})
    b = b.withColumn("risk_score", weighted_score("n_events", "qty"))
    return cut_lineage(FT.add_panel_features(b, "c_custkey", "year", "n_events",
                                             covariates={"qty_lag1": "qty", "amount_lag1": "amount", "risk_lag1": "risk_score"},
                                             logs={"log_amount_lag1": "amount_lag1"}, horizons=(1,)))


P1_FEATURES = ["n_events_lag1", "n_events_lag2", "n_events_roll3", "qty_lag1", "log_amount_lag1", "risk_lag1", "year"]


def _labelled(spark, root):
    """Customer-year design frame, label from the training years' q75;
    checkpointed so every MLlib pass reads it instead of recomputing the
    windows and quantiles behind it."""
    f = p1_features(spark, root)
    f = FT.label_train_quantile(f, "risk_score", "year", P1_TRAIN_LAST_YEAR, 0.75, out="high_risk")
    f = f.withColumn("high_risk", F.col("high_risk").cast("double"))
    scaled = MD.standardize(f, P1_FEATURES, fit_on=f.filter(F.col("year") <= P1_TRAIN_LAST_YEAR), suffix="_z")
    _, x, names = MD.design(scaled, [c + "_z" for c in P1_FEATURES], ["region"], drop_first=False)
    x = x.select("c_custkey", "year", "region", "high_risk", "features")
    # weights from the training years alone; test rows have none
    train = MD.balanced_weights(x.filter(F.col("year") <= P1_TRAIN_LAST_YEAR), "high_risk")
    x = train.unionByName(x.filter(F.col("year") > P1_TRAIN_LAST_YEAR), allowMissingColumns=True)
    return cut_lineage(x), [n[:-2] if n.endswith("_z") else n for n in names]


def classifier_metrics(spark, root):
    """E10 + E4 + E5 + E7 + M17-M21 + U1: temporal evaluation of the
    majority baseline, logistic regression, a tree and a forest (with the
    F1-tuned threshold and isotonic calibration) on the customer panel.
    All test predictions go into one frame; metrics are grouped by model."""
    x, _ = _labelled(spark, root)
    train, test = x.filter(F.col("year") <= P1_TRAIN_LAST_YEAR), x.filter(F.col("year") > P1_TRAIN_LAST_YEAR)
    builders = {"logistic": lambda: MD.logistic(train, "high_risk"), "tree": lambda: MD.tree(train, "high_risk"),
                "forest": lambda: MD.forest_classifier(train, "high_risk")}
    fits = dict(zip(builders, MD.parallel_fits(lambda b: b(), builders.values())))
    keep = ["c_custkey", "year", "high_risk"]
    maj = MD.majority(train, "high_risk")
    preds = [with_scalars(test, maj).select(F.lit("majority").alias("model"), *keep,
                                            F.lit(None).cast("double").alias("proba"), F.col("majority").alias("pred"),
                                            F.lit(None).cast("double").alias("threshold"))]
    rf = fits["forest"]
    pt = cut_lineage(MD.positive_probability(rf.transform(MD.spread(test))).select(*keep, "proba", "prediction"))  # two rows of the result read it
    for name, p in {**{n: MD.positive_probability(fits[n].transform(test)) for n in ("logistic", "tree")}, "forest": pt}.items():
        preds.append(p.select(F.lit(name).alias("model"), *keep, "proba", F.col("prediction").alias("pred"),
                              F.lit(None).cast("double").alias("threshold")))
    tr_scored = MD.positive_probability(rf.transform(MD.spread(train)))
    t = EV.best_f1_threshold(tr_scored, "high_risk", "proba").first().threshold  # one scalar
    preds.append(pt.select(F.lit("forest_tuned").alias("model"), *keep, "proba",
                           (F.col("proba") >= t).cast("double").alias("pred"), F.lit(t).alias("threshold")))
    folds = train.drop("w").withColumn("__fold", F.pmod(F.xxhash64("c_custkey", "year"), F.lit(3)))
    cal = MD.isotonic_calibrate(
        folds, "high_risk", lambda d: MD.forest_classifier(MD.balanced_weights(d, "high_risk"), "high_risk"), 3)
    pc = MD.apply_calibration(MD.spread(test), cal, "proba_cal")
    preds.append(pc.select(F.lit("forest_calibrated").alias("model"), *keep, F.col("proba_cal").alias("proba"),
                           (F.col("proba_cal") >= 0.5).cast("double").alias("pred"), F.lit(0.5).alias("threshold")))
    allp = preds[0]
    for p in preds[1:]:
        allp = allp.unionByName(p)
    allp = cut_lineage(allp)
    m = EV.binary_metrics(allp, "high_risk", "pred", by=["model"])
    a = EV.roc_auc(allp, "high_risk", "proba", by=["model"])
    th = allp.groupBy("model").agg(F.first("threshold", True).alias("threshold"))
    res = m.join(a, "model", "left").join(th, "model")
    return res.select("model", *[rnd(c, 6).alias(c) for c in ["accuracy", "precision", "recall", "f1", "auc"]],
                      "threshold")


register("classifier_metrics")(classifier_metrics)


def feature_importance(spark, root):
    """Forest importances with feature names, ranked."""
    x, names = _labelled(spark, root)
    rf = MD.forest_classifier(x.filter(F.col("year") <= P1_TRAIN_LAST_YEAR), "high_risk")
    return MD.importance_table(spark, names, rf.featureImportances)


register("feature_importance")(feature_importance)


def group_risk_rank(spark, root):
    """A22 + W14: mean predicted probability of high risk per region on the
    test years, ranked 1..n (one row per region)."""
    x, _ = _labelled(spark, root)
    rf = MD.forest_classifier(x.filter(F.col("year") <= P1_TRAIN_LAST_YEAR), "high_risk")
    p = MD.positive_probability(rf.transform(MD.spread(x.filter(F.col("year") > P1_TRAIN_LAST_YEAR))))
    g = cut_lineage(p.groupBy("region").agg(rnd(F.avg("proba"), 6).alias("mean_proba_high")))  # sampled, then ranked
    from ..operators.windows import dense_position
    return dense_position(g, [F.col("mean_proba_high").desc(), F.col("region")])


register("group_risk_rank")(group_risk_rank)


def driver_regression(spark, root):
    """M14 + O6: standardised least squares of the yearly order count on
    same-year severity measures plus region dummies; coefficients ranked."""
    p = p1_panel(spark, root).withColumn("n_events", F.col("n_events").cast("double"))
    cols = ["amount", "qty", "year"]
    s = MD.standardize(p, cols)
    _, x, names = MD.design(s, cols, ["r_name"], drop_first=True)
    m = MD.linear(x, "n_events")
    return MD.coefficient_table(spark, names, m.coefficients.toArray()).select(
        "feature", rnd("coefficient", 6).alias("coefficient"), rnd("abs_coefficient", 6).alias("abs_coefficient"))


# dummies take up the regions' means: slopes from differences to them by Cramer's rule, dummies from what is left of the means
register("driver_regression", f"""WITH {P1_SQL},
m AS (SELECT avg(amount) AS ma, stddev_pop(amount) AS da, avg(qty) AS mq, stddev_pop(qty) AS dq, avg(year) AS mt, stddev_pop(year) AS dt FROM p1),
z AS (SELECT r_name, CAST(n_events AS DOUBLE) AS y, (amount - ma) / da AS a, (qty - mq) / dq AS q, (year - mt) / dt AS t FROM p1 CROSS JOIN m),
g AS (SELECT r_name, avg(y) AS gy, avg(a) AS ga, avg(q) AS gq, avg(t) AS gt FROM z GROUP BY r_name),
s AS (SELECT sum((a - ga) * (a - ga)) AS aa, sum((a - ga) * (q - gq)) AS aq, sum((a - ga) * (t - gt)) AS at_, sum((q - gq) * (q - gq)) AS qq,
             sum((q - gq) * (t - gt)) AS qt, sum((t - gt) * (t - gt)) AS tt, sum((a - ga) * (y - gy)) AS ay, sum((q - gq) * (y - gy)) AS qy,
             sum((t - gt) * (y - gy)) AS ty FROM z JOIN g USING (r_name)),
d AS (SELECT *, aa * (qq * tt - qt * qt) - aq * (aq * tt - qt * at_) + at_ * (aq * qt - qq * at_) AS det FROM s),
b AS (SELECT (ay * (qq * tt - qt * qt) - aq * (qy * tt - qt * ty) + at_ * (qy * qt - qq * ty)) / det AS ba,
             (aa * (qy * tt - qt * ty) - ay * (aq * tt - qt * at_) + at_ * (aq * ty - qy * at_)) / det AS bq,
             (aa * (qq * ty - qy * qt) - aq * (aq * ty - qy * at_) + ay * (aq * qt - qq * at_)) / det AS bt FROM d),
l AS (SELECT r_name, gy - ba * ga - bq * gq - bt * gt AS level FROM g CROSS JOIN b),
c AS (SELECT 'amount' AS feature, ba AS c FROM b UNION ALL SELECT 'qty', bq FROM b UNION ALL SELECT 'year', bt FROM b
      UNION ALL SELECT 'r_name=' || r_name, level - (SELECT level FROM l ORDER BY r_name LIMIT 1) FROM l WHERE r_name > (SELECT min(r_name) FROM l))
SELECT feature, round(c, 6) AS coefficient, round(abs(c), 6) AS abs_coefficient FROM c""")(driver_regression)


def regression_models(spark, root):
    """M10 + M11 + M12 + M28 + E1: 80/20 hash split of customer-years; least
    squares on three feature sets, a degree-2 polynomial and boosted trees
    (raw and log1p target) of the published size, stopped early by a held-out
    tenth of the training rows; R2 and RMSE on both sides, and the boosting
    rounds kept. Fits run concurrently on one written frame."""
    p = p1_panel(spark, root).withColumn("n_events", F.col("n_events").cast("double"))
    row = F.col("c_custkey") * 100 + F.col("year") % 100
    p = FT.hash_split(p, row, 80).withColumn("held_out", F.pmod(FT.scramble(row * 31 + 7), F.lit(10)) == 0)
    s = MD.standardize(p, ["amount", "qty", "year"], fit_on=p.filter("is_train = 1"), suffix="_z")
    s = cut_lineage(s.select("c_custkey", "is_train", "held_out", "n_events", "amount_z", "qty_z", "year_z", "r_name"))
    designs = {"ols_severity": (["amount_z", "qty_z"], []), "ols_severity_period": (["amount_z", "qty_z", "year_z"], []),
               "grouped": (["amount_z", "qty_z", "year_z"], ["r_name"])}
    frames = {k: MD.design(s, num, cat)[1] for k, (num, cat) in designs.items()}
    specs = [("ols_severity", "ols_severity", lambda d: MD.linear(d, "n_events"), False),
             ("ols_severity_period", "ols_severity_period", lambda d: MD.linear(d, "n_events"), False),
             ("ols_severity_period_group", "grouped", lambda d: MD.linear(d, "n_events"), False),
             ("poly2", "grouped", lambda d: MD.poly2(d, "n_events"), False),
             ("gbt", "grouped", lambda d: MD.gbt(d, "n_events", validation_col="held_out"), False),
             ("gbt_log", "grouped", lambda d: MD.gbt(d.withColumn("__ly", F.log1p("n_events")), "__ly", validation_col="held_out"), True)]

    def run(spec):
        name, frame, fit, log = spec
        data = frames[frame]
        model = fit(data.filter("is_train = 1"))
        rounds = getattr(model, "getNumTrees", None)
        pr = model.transform(data)
        if log:
            pr = pr.withColumn("prediction", F.greatest(F.expm1("prediction"), F.lit(0.0)))
        rows = []
        for part, flagv in (("train", 1), ("test", 0)):
            e = EV.rmse_r2(pr.filter(F.col("is_train") == flagv), "n_events", "prediction").first()
            rows.append((name, part, e.rmse, e.r2, e.n, rounds))
        return rows

    rows = [r for rs in MD.parallel_fits(run, specs) for r in rs]
    out = spark.createDataFrame(rows, "model string, split string, rmse double, r2 double, n long, rounds int")
    return out.select("model", "split", rnd("rmse", 6).alias("rmse"), rnd("r2", 6).alias("r2"), "n", "rounds")


register("regression_models")(regression_models)


def _profiles(spark, root):
    e = entity_profile(p1_panel(spark, root), "c_custkey", "year", "n_events", "amount", 3)
    s = MD.standardize(e, ["mean_count", "mean_severity", "count_slope"])
    _, x, _ = MD.design(s, ["mean_count", "mean_severity", "count_slope"])
    return x


def kmeans(spark, root):
    """k = 4 on scaled customer profiles, best of 10 seeds."""
    x = cut_lineage(_profiles(spark, root).select("c_custkey", "features"))
    m = MD.kmeans_best(x, 4, restarts=10)
    return m.transform(x).select("c_custkey", "cluster")


register("kmeans")(kmeans)


def elbow(spark, root):
    """Inertia for k = 2..10 (10 seeds each)."""
    x = cut_lineage(_profiles(spark, root).select("features"))
    return MD.elbow(spark, x, range(2, 11), restarts=10)


register("elbow")(elbow)


K_FOLDS = 5


def group_kfold_models(spark, root):
    """Group k-fold of the direct forecasts - whole nations held out per
    fold - for each horizon, raw and log1p target: RMSE of a forest and of a
    ridge with its penalty chosen inside each training set, mean and population
    std over folds. The ridges of all folds share their passes over the rows."""
    x, scale = _horizon_frame(spark, root)
    x = cut_lineage(x.join(EV.group_folds(x, "n_name", K_FOLDS), "n_name"))

    def ridge(job):
        h, target = job
        d = _target(x.filter(F.col(f"y_plus{h}").isNotNull()), f"y_plus{h}", target)
        return fit_ridge_cv(d, "x", "__y", scale, fold="fold", k=K_FOLDS)

    jobs = [(h, t) for h in HORIZONS for t in TARGETS]
    ridges = dict(zip(jobs, MD.parallel_fits(ridge, jobs)))

    def run(job):
        h, target, k = job
        lab = f"y_plus{h}"
        d = _target(x.filter(F.col(lab).isNotNull()), lab, target)
        train, test = d.filter(F.col("fold") != k), d.filter(F.col("fold") == k)
        upper = train.agg(F.max("__y")).first()[0]
        scored = {"rf": MD.forest_regressor(train, "__y").transform(test),
                  "ridge": test.withColumn("prediction", predicted(ridges[h, target], "x", "fold"))}
        return [(h, target, m, k, EV.rmse_r2(_on_scale(p, upper, target), lab, "prediction").first().rmse) for m, p in scored.items()]

    res = [r for rs in MD.parallel_fits(run, [(*j, k) for j in jobs for k in range(K_FOLDS)]) for r in rs]
    per = spark.createDataFrame(res, "horizon int, target string, model string, fold int, rmse double")
    n_rows = x.select(F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_plus{h}").alias("y")) for h in HORIZONS]))) \
        .groupBy("horizon").agg(F.count("y").alias("n_rows"))
    out = EV.over_folds(per, {"rmse": "rmse"}, ["horizon", "target", "model"]).join(n_rows, "horizon")
    return out.select("horizon", "target", "model", rnd("rmse_mean", 6).alias("rmse_mean"), rnd("rmse_std", 6).alias("rmse_std"), "n_splits", "n_rows")


register("group_kfold_models")(group_kfold_models)


def _classifier_fits(train):
    """Majority, logistic regression, tree and forest on (features, y), as
    functions from a frame to (y, pred)."""
    weighted = MD.balanced_weights(train, "y")
    maj = MD.majority(train, "y").first().majority
    kinds = {"logistic": MD.logistic, "tree": MD.tree, "forest": MD.forest_classifier}
    fits = dict(zip(kinds, MD.parallel_fits(lambda fit: fit(weighted, "y"), kinds.values())))
    return {"majority": lambda d: d.withColumn("prediction", F.lit(maj))} | {m: f.transform for m, f in fits.items()}


def group_kfold_classifiers(spark, root):
    """E3 for the risk classifiers: whole regions, then whole nations, held out
    per fold; the label threshold (q75 of the risk score), scaling and class
    weights come from the training folds alone. Accuracy and F1 of the high class,
    mean and population std over the folds whose training rows have both classes."""
    d = dense_features(spark, root).withColumn("risk_score", weighted_score("n_events", "amount"))
    numeric = FEATURES + ["month_idx"]
    jobs, frames, n_rows = [], {}, {}
    for grouping in ("region", "n_name"):
        g = cut_lineage(d.join(EV.group_folds(d, grouping, K_FOLDS), grouping))
        told = EV.fold_thresholds(EV.fold_table(g, "risk_score", "fold", K_FOLDS), "risk_score", K_FOLDS, 0.75).first()
        frames[grouping], n_rows[grouping] = g, g.count()
        jobs += [(grouping, k, told.thresholds[k]) for k in range(K_FOLDS) if told.positives[k] and told.negatives[k]]

    def run(job):
        grouping, k, threshold = job
        g = frames[grouping].withColumn("y", flag(F.col("risk_score") >= threshold).cast("double"))
        z = MD.standardize(g, numeric, fit_on=g.filter(F.col("fold") != k), suffix="_z")
        _, x, _ = MD.design(z, [c + "_z" for c in numeric], ["region"], drop_first=False)
        x = cut_lineage(x.select("fold", "features", "y"))
        test = x.filter(F.col("fold") == k)
        scored = {m: f(test) for m, f in _classifier_fits(x.filter(F.col("fold") != k)).items()}
        return [(grouping, m, k, *p.agg(*EV.accuracy_f1(F.col("y"), F.col("prediction"))).first()) for m, p in scored.items()]

    res = [r for rs in MD.parallel_fits(run, jobs) for r in rs]
    per = spark.createDataFrame(res, "grouping string, model string, fold int, acc double, f1 double")
    sizes = spark.createDataFrame(sorted(n_rows.items()), "grouping string, n_rows long")
    out = EV.over_folds(per, {"acc": "accuracy", "f1": "f1_high_risk"}, ["grouping", "model"]).join(sizes, "grouping")
    return out.select("grouping", "model", *[rnd(c, 6).alias(c) for c in ("accuracy_mean", "accuracy_std", "f1_high_risk_mean", "f1_high_risk_std")],
                      "n_splits", "n_rows")


register("group_kfold_classifiers")(group_kfold_classifiers)


# ------------------------------------------------- entity and group level

GROUP_FEATURES = ["total_events_lag1", "total_events_lag2", "total_events_roll3", "amount_lag1", "log_amount_lag1", "price_lag1",
                  "conflict_lag1", "entities_lag1", "events_x_entities", "month_idx"]


def group_features(spark, root):
    """M4, group level: the balanced region-month panel with lagged totals, a
    log, a product of lags and the risk score of the month."""
    g = balanced_group_panel(spark, root).withColumn("risk_score", weighted_score("total_events", "total_amount"))
    return FT.add_panel_features(
        g, "r_name", "month_idx", "total_events",
        covariates={"amount_lag1": "total_amount", "price_lag1": "mean_price", "conflict_lag1": "conflict_share", "entities_lag1": "entities_reporting"},
        logs={"log_amount_lag1": "amount_lag1"}, interactions={"events_x_entities": ("total_events_lag1", "entities_lag1")}, horizons=(1,))


def _level_predictions(frame, level, keys, period, last_train, numeric, categorical):
    """Test predictions of every classifier on one panel level, threshold,
    scaling and weights from the training periods: (level, model, keys, y, pred,
    proba)."""
    f = FT.label_train_quantile(frame, "risk_score", period, last_train, 0.75, out="y").withColumn("y", F.col("y").cast("double"))
    z = MD.standardize(f, numeric, fit_on=f.filter(F.col(period) <= last_train), suffix="_z")
    _, x, _ = MD.design(z, [c + "_z" for c in numeric], categorical, drop_first=False)
    x = cut_lineage(x.select(*dict.fromkeys([*keys, period]), "features", "y"))
    test = MD.spread(x.filter(F.col(period) > last_train))
    out = []
    for m, score in _classifier_fits(x.filter(F.col(period) <= last_train)).items():
        p = score(test)
        proba = vector_to_array("probability")[1] if "probability" in p.columns else F.lit(None).cast("double")
        out.append(p.select(F.lit(level).alias("level"), F.lit(m).alias("model"), *keys, "y", F.col("prediction").alias("pred"), proba.alias("proba")))
    return out


def risk_predictions(spark, root):
    """M4 + U1: risk classifiers on the customer-year panel and on the
    region-month panel, tested on later periods: (level, model, keys of that
    level, y, pred, proba), predictions of both levels, whose keys differ, in one
    written frame."""
    levels = [(p1_features, "entity", ["c_custkey", "year"], "year", P1_TRAIN_LAST_YEAR, P1_FEATURES, ["region"]),
              (group_features, "group", ["r_name", "month_idx"], "month_idx", TRAIN_LAST_MONTH, GROUP_FEATURES, ["r_name"])]
    frames = MD.parallel_fits(lambda level: _level_predictions(level[0](spark, root), *level[1:]), levels)
    every, *others = [p for level in frames for p in level]
    for other in others:
        every = every.unionByName(other, allowMissingColumns=True)
    return cut_lineage(every)


def two_level_risk(spark, root):
    """Metrics of ``risk_predictions`` by (level, model)."""
    out = EV.metrics_by(risk_predictions(spark, root), ["level", "model"])
    return out.select("level", "model", "n", *[rnd(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])


register("two_level_risk")(two_level_risk)


def median_risk_forest(spark, root):
    """The panel risk forest: high = more orders than the median of observed
    customer-years, forest on the training years, per-class report of the test
    years (E8)."""
    f = p1_features(spark, root)
    median = F.col("threshold")
    t = FT.observed_median(f.filter("observed = 1"), "n_events")
    f = with_scalars(f, t).withColumn("y", flag(F.col("n_events") > median).cast("double"))
    _, x, _ = MD.design(f, P1_FEATURES, ["region"], drop_first=False)
    x = cut_lineage(x.select("year", "features", "y"))
    train = MD.balanced_weights(x.filter(F.col("year") <= P1_TRAIN_LAST_YEAR), "y")
    p = MD.forest_classifier(train, "y").transform(MD.spread(x.filter(F.col("year") > P1_TRAIN_LAST_YEAR)))
    p = cut_lineage(p.select(F.col("y").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred")))  # the report reads it twice
    return EV.class_report(p, "y", "pred")


register("median_risk_forest")(median_risk_forest)
