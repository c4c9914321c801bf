"""Classifier training, tuning and cross-validation on ``pyspark.ml``.

Methods (name -> Spark estimator; an equivalent role, not equal numbers):

* ``LogisticR`` -- L2 logistic regression; sklearn's ``C`` maps to
  ``regParam = 1 / (C * n_train)`` without standardisation.
* ``RF`` -- random forest.
* ``XGB`` -- gradient-boosted trees (``GBTClassifier``).
* ``SVM`` -- RBF kernel approximated by random Fourier features (a pandas UDF:
  one matrix product per Arrow batch), a ``LinearSVC`` and Platt scaling for
  probabilities.

Unset hyper-parameters take the defaults of the single-machine libraries the
analysis uses: an unset forest depth is unlimited (Spark's largest, 30), boosted
trees have depth 6 and learning rate 0.3, ``C`` is 1.  The boosted ``gamma`` is a
minimum loss reduction summed over the rows of a node, Spark's ``minInfoGain`` a
reduction per row, so it is divided by the training rows.

The driver only loops over configurations and folds; every fit, prediction
and metric is a distributed job.  Tuning scores specificity (recall of class
0) under subject-grouped folds.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut_lineage
from .boosting import boosted_scores
from .evaluation import auc, classification_metrics, interpolate_tpr, mean_auc, mean_roc, roc_points
from .folds import group_folds
from .reshape import _q
from .scaling import chained_impute, minmax_fit, minmax_apply

METHODS = ("LogisticR", "RF", "XGB", "SVM")

# --- Fixed values: hyper-parameter grids of the analysis -------------------
GRIDS = {
    "LogisticR": {"C": [1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1, 10, 100]},
    "RF": {"n_estimators": [50, 100, 250, 500], "max_depth": [1, 2, 3], "min_samples_leaf": [1, 2, 3]},
    "XGB": {"gamma": [0.5, 1, 3], "learning_rate": [0.01, 0.1, 0.3], "max_depth": [2, 3, 4],
            "min_child_weight": [1, 5, 10], "n_estimators": [100, 250, 500]},
    "SVM": {"C": [1, 10, 100], "gamma": [1, 0.1, 0.01, 0.001]},
}
# --- end fixed values -------------------------------------------------------
MAX_DEPTH = 30  # the deepest trees Spark grows
PARALLEL = 4  # steps or fits submitted at once; Spark shares the executors between them

def specificity_evaluator() -> MulticlassClassificationEvaluator:
    """Tuning score: recall of class 0."""
    return MulticlassClassificationEvaluator(metricName="recallByLabel", metricLabel=0.0, labelCol="label",
                                             predictionCol="prediction")


def assemble(df: DataFrame, features, label_col: str | None) -> DataFrame:
    """Add ``features`` vector and a double ``label``."""
    out = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df)
    return out.withColumn("label", F.col(_q(label_col)).cast("double")) if label_col else out


@dataclass
class RFF:
    """Random Fourier features for an RBF kernel exp(-gamma ||x - y||^2) (Rahimi & Recht 2007).

    The map z(x) = sqrt(2/D) cos(W x + b) is one matrix product per Arrow
    batch inside a pandas UDF (W is D x p, shipped with the closure).
    """

    gamma: float
    n_components: int = 100
    seed: int = 0

    def transform(self, df: DataFrame, features, out_col: str = "features") -> DataFrame:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0.0, math.sqrt(2 * self.gamma), size=(self.n_components, len(features)))
        b = rng.uniform(0.0, 2 * math.pi, size=self.n_components)
        scale = math.sqrt(2.0 / self.n_components)

        @pandas_udf("array<double>")
        def rff(x: pd.Series) -> pd.Series:
            m = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, w.shape[1]))
            z = scale * np.cos(m @ w.T + b)
            return pd.Series(list(z))

        arr = F.array(*[F.col(_q(f)).cast("double") for f in features])
        return df.withColumn(out_col, array_to_vector(rff(arr)))


def estimator(method: str, params: dict, n_train: int, seed: int):
    """Spark estimator for one method and one hyper-parameter point."""
    if method == "LogisticR":
        c = float(params.get("C", 1.0))
        # solver budget of the usual single-machine default: 100 iterations, tol 1e-4
        return LogisticRegression(regParam=1.0 / (c * max(n_train, 1)), elasticNetParam=0.0, standardization=False,
                                  maxIter=100, tol=1e-4)
    if method == "RF":
        return RandomForestClassifier(numTrees=int(params.get("n_estimators", 100)),
                                      maxDepth=int(params.get("max_depth") or MAX_DEPTH),
                                      minInstancesPerNode=int(params.get("min_samples_leaf", 1)), seed=seed)
    if method == "XGB":
        return GBTClassifier(maxIter=int(params.get("n_estimators", 100)), stepSize=float(params.get("learning_rate", 0.3)),
                             maxDepth=int(params.get("max_depth") or 6),
                             minInstancesPerNode=int(params.get("min_child_weight", 1)),
                             minInfoGain=float(params.get("gamma", 0.0)) / max(n_train, 1), seed=seed)
    if method == "SVM":
        c = float(params.get("C", 1.0))
        return LinearSVC(regParam=1.0 / (c * max(n_train, 1)), maxIter=100, tol=1e-4, standardization=False)
    raise ValueError(method)


@dataclass
class Fitted:
    method: str
    model: object
    features: list
    params: dict
    rff: RFF | None = None
    platt: object | None = None

    def transform(self, df: DataFrame, assembled: bool = False) -> DataFrame:
        """Predictions with ``y_pred`` and positive-class ``score`` columns; ``assembled`` rows have their ``features`` vector."""
        if self.rff is not None:
            p = self.model.transform(self.rff.transform(df, self.features))
            # hard label from the SVM decision; probability from the Platt model
            p = p.withColumn("_margin", vector_to_array("rawPrediction")[1]) \
                .withColumn("y_pred", F.col("prediction").cast("int")).drop("features", "rawPrediction", "prediction")
            p = self.platt.transform(assemble(p, ["_margin"], None))
            return p.withColumn("score", vector_to_array("probability")[1]) \
                .drop("features", "rawPrediction", "probability", "prediction", "_margin")
        p = self.model.transform(df if assembled else assemble(df, self.features, None))
        return p.withColumn("y_pred", F.col("prediction").cast("int")).withColumn(
            "score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit(df: DataFrame, features, label_col: str, method: str, params: dict | None = None, seed: int = 42,
        n_train: int | None = None, assembled: bool = False) -> Fitted:
    params = dict(params or {})
    n = n_train if n_train is not None else df.count()
    if method == "SVM":
        rff = RFF(gamma=float(params.get("gamma", 1.0 / max(len(features), 1))), seed=seed)
        # the feature map runs in Python: materialise it once, not on every solver iteration
        data = rff.transform(df, features).select("features", F.col(_q(label_col)).cast("double").alias("label"))
        data = data.persist()
        svm = estimator(method, params, n, seed).fit(data)
        margins = svm.transform(data).withColumn("_margin", vector_to_array("rawPrediction")[1]) \
            .select("_margin", "label")
        platt = LogisticRegression(regParam=0.0).fit(assemble(margins, ["_margin"], None))
        data.unpersist()
        return Fitted(method, svm, list(features), params, rff, platt)
    model = estimator(method, params, n, seed).fit(df if assembled else assemble(df, features, label_col))
    return Fitted(method, model, list(features), params)


def select_by_forest(df: DataFrame, features, label_col: str, seed: int = 42, num_trees: int = 100) -> list:
    """Features whose depth-1 forest importance is at least the mean importance."""
    rf = RandomForestClassifier(maxDepth=1, numTrees=num_trees, seed=seed).fit(assemble(df, features, label_col))
    imp = rf.featureImportances.toArray()
    keep = [f for f, v in zip(features, imp) if v >= imp.mean()]
    return keep or list(features)


def param_points(method: str, grid: dict | None = None) -> list:
    grid = grid or GRIDS[method]
    keys = list(grid)
    pts = [{}]
    for k in keys:
        pts = [dict(p, **{k: v}) for p in pts for v in grid[k]]
    return pts


#: Method -> the grid's number of trees: a larger ensemble holds the smaller ones as its first trees.
TREES = {"RF": "n_estimators", "XGB": "n_estimators"}
#: Fits of a boosted grid up to which each is one of its own; more are grown together.
SEPARATE = 16


def staged_scores(fitted: Fitted, df: DataFrame, sizes, label_col: str) -> dict:
    """{n: specificity} of an ensemble's first n trees, for all ``sizes``, in one pass over ``df``.

    The model names each row's leaf in every tree; the leaves' values are a constant of
    the model's size.  A forest votes with its mean probability, boosted trees with
    the sign of their weighted sum.
    """
    from .tree_attribution import model_trees

    values = []
    for nodes, weight in model_trees(df.sparkSession, fitted):  # leaves are numbered in the order of their ids
        values.append([nodes[i][4] * weight for i in sorted(nodes) if nodes[i][0] < 0])
    leaves = fitted.model.copy().setLeafCol("_leaf").transform(assemble(df, fitted.features, label_col)).select("label", vector_to_array("_leaf").alias("_leaf"))
    table = F.from_json(F.lit(json.dumps(values)), "array<array<double>>")
    votes = leaves.select("label", F.zip_with(table, "_leaf", lambda v, at: F.get(v, at.cast("int"))).alias("_votes"))
    middle = {n: n / (2.0 * len(values)) if fitted.method == "RF" else 0.0 for n in sizes}
    negative = F.col("label") == 0
    right = [F.sum((negative & (F.aggregate(F.slice("_votes", 1, n), F.lit(0.0), lambda acc, v: acc + v) <= middle[n])).cast("int")).alias(f"n{n}") for n in sizes]
    row = votes.agg(F.sum(negative.cast("int")).alias("all"), *right).first()
    return {n: (row[f"n{n}"] / row["all"] if row["all"] else 0.0) for n in sizes}


def _scored_together(data: DataFrame, features, label_col: str, pts: list, seed: int, folds: int) -> list:
    """[{point: specificity}] of every fold, by ``boosted_scores``."""
    points = []
    for p in pts:
        est = estimator("XGB", p, 1, seed)  # n_train of 1: minInfoGain is gamma
        points.append((est.getStepSize(), est.getMaxDepth(), est.getMinInfoGain(), est.getMinInstancesPerNode(), est.getMaxIter()))
    rows = cut_lineage(assemble(data, features, label_col).select("label", "fold", vector_to_array("features").alias("_x")))
    scores = boosted_scores(rows, len(features), points, folds)
    return [{json.dumps(p): s[f] for p, s in zip(pts, scores)} for f in range(folds)]


def tune(df: DataFrame, features, label_col: str, id_col: str, method: str, seed: int, grid: dict | None = None,
         inner_folds: int = 5, parallelism: int = PARALLEL) -> Fitted:
    """Grid search maximising specificity over subject-grouped inner folds, then refit on all rows.

    Logistic grids run through ``CrossValidator(foldCol=...)``.  Points of a tree grid that
    differ in the number of trees only are one fit of the most trees, scored at each
    number; a boosted grid of more than ``SEPARATE`` fits is grown together (``boosting``).
    The SVM grid varies the feature map too, so each point is scored directly.
    """
    folds = group_folds(df, id_col, label_col, inner_folds, seed).select(id_col, "fold")
    data = cut_lineage(df.join(folds, id_col, "inner"))
    n = data.count()
    pts = param_points(method, grid)
    if method == "LogisticR":
        est = estimator(method, pts[0], n, seed)
        points = ParamGridBuilder().addGrid(est.regParam, [1.0 / (p["C"] * n) for p in pts]).build()
        cv = CrossValidator(estimator=Pipeline(stages=[est]), estimatorParamMaps=points, evaluator=specificity_evaluator(), numFolds=inner_folds,
                            foldCol="fold", parallelism=parallelism, seed=seed)
        cvm = cv.fit(assemble(data, features, label_col).withColumn("fold", F.col("fold").cast("int")))
        best = cvm.bestModel.stages[0]
        return Fitted(method, best, list(features), {k.name: v for k, v in best.extractParamMap().items() if k.name == "regParam"})
    size = TREES.get(method)
    sizes = sorted({p[size] for p in pts}) if size else []
    shapes = [p for p in pts if p[size] == sizes[-1]] if size else pts

    def score(task):
        p, f = task
        model = fit(data.where(F.col("fold") != f), features, label_col, method, p, seed)
        held = data.where(F.col("fold") == f)
        if size:
            return {json.dumps({**p, size: m}): v for m, v in staged_scores(model, held, sizes, label_col).items()}
        return {json.dumps(p): classification_metrics(model.transform(held), [], label_col, "y_pred").first()["specificity"]}

    if method == "XGB" and len(shapes) * inner_folds > SEPARATE:
        scored = _scored_together(data, features, label_col, pts, seed, inner_folds)
    else:
        with ThreadPoolExecutor(parallelism) as pool:
            scored = list(pool.map(score, [(p, f) for p in shapes for f in range(inner_folds)]))
    total: dict = {}
    for part in scored:
        for point, v in part.items():
            total[point] = total.get(point, 0.0) + v / inner_folds
    # grid order decides between equal scores
    best = max(range(len(pts)), key=lambda i: (round(total[json.dumps({**pts[i]})], 12), -i))
    return fit(df, features, label_col, method, pts[best], seed, n)


def train_test(train: DataFrame, test: DataFrame, features, label_col: str, id_col: str, method: str, seed: int,
               params: dict | None = None, tuned: bool = False, select_feats: bool = False,
               impute: bool = True, oversample: bool = True, nominal=(), model_seed: int | None = None, ranges: dict | None = None, n_train: int | None = None, grid: dict | None = None, held: list | None = None):
    """One train/test step: impute -> oversample (SMOTE / SMOTE-NC) -> (select) -> scale (LR/SVM)
    -> fit/tune -> predict.

    Imputer, oversampler and scaler see the training frame only; synthetic rows
    keep their base row's subject id.  ``ranges`` are the training columns' (min, max) and
    ``n_train`` the number of training rows, if already known; ``grid`` replaces the method's grid of a tuned step.
    With ``held`` an untuned step keeps its training rows' vectors for the fit and the predictions; the caller unpersists what it appends.  Returns (train predictions, test predictions, fitted model,
    features used).
    """
    from .oversample import smote

    feats = list(features)
    if impute:
        nulls = train.agg(*[F.count(F.when(F.col(_q(c)).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(feats)]
                          ).first()
        if any(nulls):
            train, test = chained_impute(train, [train, test], feats)
    if oversample:
        noms = [c for c in nominal if c in feats]
        train = cut_lineage(smote(train.select(id_col, label_col, *[_q(f) for f in feats]), feats, label_col,
                                  id_col, k=5, seed=seed, nominal=noms).drop("synthetic"))
    if select_feats:
        feats = select_by_forest(train, feats, label_col, seed)
    if method in ("LogisticR", "SVM"):
        rng = {f: ranges[f] for f in feats} if ranges else minmax_fit(train, feats)
        train, test = minmax_apply(train, rng), minmax_apply(test, rng)
    keep = [id_col, F.col(_q(label_col)).cast("int").alias("y_true")]
    seed_of = seed if model_seed is None else model_seed
    if held is not None and not tuned and method != "SVM":
        rows = assemble(train, feats, label_col).select(*keep, "label", "features").persist()
        held.append(rows)
        model = fit(rows, feats, label_col, method, params, seed_of, n_train, assembled=True)
        tr = model.transform(rows, assembled=True)
    else:
        model = tune(train, feats, label_col, id_col, method, seed, grid) if tuned else fit(train, feats, label_col, method, params, seed_of, n_train)
        tr = model.transform(train.select(*keep, *[_q(f) for f in feats]))
    te = model.transform(test.select(*keep, *[_q(f) for f in feats]))
    return tr.select(id_col, "y_true", "y_pred", "score"), te.select(id_col, "y_true", "y_pred", "score"), model, feats


def cross_validate(df: DataFrame, features, label_col: str, id_col: str, method: str, seed: int, k: int = 5,
                   **kw) -> DataFrame:
    """Subject-grouped k-fold CV; pooled predictions with ``fold`` and ``type`` (train/test)."""
    folds = group_folds(df, id_col, label_col, k, seed).select(id_col, "fold")
    data = cut_lineage(df.join(folds, id_col, "inner"))  # read by every fold

    def step(f):
        tr, te = (data.where(F.col("fold") != f).drop("fold"), data.where(F.col("fold") == f).drop("fold"))
        ptr, pte, _, _ = train_test(tr, te, features, label_col, id_col, method, seed, **kw)
        part = ptr.withColumn("type", F.lit("train")).unionByName(pte.withColumn("type", F.lit("test")))
        return cut_lineage(part.withColumn("fold", F.lit(f)))

    with ThreadPoolExecutor(PARALLEL) as pool:
        parts = list(pool.map(step, range(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_fitted(df: DataFrame, features, label_col: str, id_col: str, method: str, runs: int, k: int, oversample: bool = True, nominal=(), **kw) -> list[DataFrame]:
    """``cross_validate`` of every run, with statistics, neighbours and synthetic rows of all training sides made together."""
    from .crossfit import CrossFit

    sides = CrossFit(df, features, label_col, id_col, runs, k, nominal=nominal, oversample=oversample)
    out = []
    for run in range(runs):
        made = sides.synthetic(run)
        made = made if made is None else cut_lineage(made)

        def step(f, run=run, made=made):
            train, test = sides.side(run, f, made)
            held = []
            if made is not None and (kw.get("tuned") or kw.get("select_feats") or method == "SVM"):  # the columns are read more than once
                train = train.persist()
                held.append(train)
            n = sides.sides[run, f]["n"] + sides.sides[run, f]["new"]
            ptr, pte, _, _ = train_test(train, test, features, label_col, id_col, method, run, impute=False, oversample=False, ranges=sides.ranges[run, f], n_train=n, held=held, **kw)
            part = cut_lineage(ptr.withColumn("type", F.lit("train")).unionByName(pte.withColumn("type", F.lit("test"))).withColumn("fold", F.lit(f)))
            for rows in held:
                rows.unpersist()
            return part

        with ThreadPoolExecutor(k) as pool:  # a run's sides at once: none waits for a second round
            parts = list(pool.map(step, range(k)))
        preds = parts[0]
        for part in parts[1:]:
            preds = preds.unionByName(part)
        out.append(preds)
    return out


def repeated_cv(df: DataFrame, features, label_col: str, id_col: str, method: str, runs: int = 5, k: int = 5, impute: bool = True, **kw):
    """Runs with seeds 0..runs-1.

    Returns (metrics per run and type, per-fold test AUCs, interpolated test
    ROC per run and fold).  Each fold's predictions are checkpointed once.  Rows
    with nulls are imputed per training side, which changes its neighbours; without
    nulls all sides share their statistics and one neighbour graph (``crossfit``).
    """
    nulls = impute and any(df.agg(*[F.count(F.when(F.col(_q(c)).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(features)]).first())
    if nulls:
        every = [cross_validate(df, features, label_col, id_col, method, run, k, **kw) for run in range(runs)]
    else:
        every = cross_fitted(df, features, label_col, id_col, method, runs, k, **kw)
    preds = None
    for run, part in enumerate(every):
        part = part.withColumn("run", F.lit(run))
        preds = part if preds is None else preds.unionByName(part)
    mets = classification_metrics(preds, ["run", "type"]).withColumn("random_state", F.col("run"))
    pts = roc_points(preds.where(F.col("type") == "test"), ["run", "fold"])
    aucs, rocs = auc(pts, ["run", "fold"]), interpolate_tpr(pts, ["run", "fold"])
    method_col = F.lit(method).alias("method")
    return mets.select(method_col, "*"), aucs.select(method_col, "*"), rocs.select(method_col, "*")


def final_model(df: DataFrame, features, label_col: str, id_col: str, method: str, seed: int = 42, **kw):
    """Final classifier on a 50/50 subject-grouped split (fold 0 held out); metric rows per side."""
    from .folds import first_fold_split

    tr, te = first_fold_split(df, id_col, label_col, seed=seed)
    ptr, pte, model, feats = train_test(tr, te, features, label_col, id_col, method, seed, **kw)
    preds = ptr.withColumn("type", F.lit("train")).unionByName(pte.withColumn("type", F.lit("test")))
    mets = classification_metrics(preds, ["type"]).select(F.lit(method).alias("method"), "*")
    pts = roc_points(pte)
    return mets, auc(pts).select(F.lit(method).alias("method"), "*"), pts, model, feats


def predict_all_methods(fs, methods=METHODS, tuned: bool = False, select_feats: bool = False, runs: int = 5,
                        k: int = 5, repeated: bool = True, params: dict | None = None):
    """Every method on one prepared feature set: repeated CV rows and the final model rows.

    Returns a dict of DataFrames (pred, auc, roc, final_pred, final_auc), each
    carrying the configuration columns used by the report layer.  ``roc`` is the
    mean curve over all runs and folds, ``auc`` its area and the spread of the
    folds' areas.
    """
    df = cut_lineage(fs.df)
    feats = [c for c in df.columns if c not in (fs.id_col, fs.target_col)]
    cfg = [F.lit(fs.name).alias("featureset"), F.lit(select_feats).alias("features_selected"),
           F.lit(tuned).alias("tuned"), F.lit(fs.n_lags).alias("n_lags")]
    out = {k_: None for k_ in ("pred", "auc", "roc", "final_pred", "final_auc")}

    def add(key, part):
        part = part.select(*cfg, "*")
        out[key] = part if out[key] is None else out[key].unionByName(part, allowMissingColumns=True)

    for method in methods:
        p = (params or {}).get(method)
        if repeated:
            mets, aucs, rocs = repeated_cv(df, feats, fs.target_col, fs.id_col, method, runs, k, params=p,
                                           tuned=tuned, select_feats=select_feats, impute=False,
                                           nominal=list(fs.nominal_cols))
            curve = cut_lineage(mean_roc(rocs))
            add("pred", mets)
            add("auc", mean_auc(curve, aucs).select(F.lit(method).alias("method"), "*"))
            add("roc", curve.select(F.lit(method).alias("method"), "*"))
        mets, a, _, _, _ = final_model(df, feats, fs.target_col, fs.id_col, method, params=p, tuned=tuned,
                                       select_feats=select_feats, impute=False, nominal=list(fs.nominal_cols))
        add("final_pred", mets)
        add("final_auc", a)
    return out


def tune_lags(fs, lag_range=None, depth_range=range(1, 6), runs: int = 5, k: int = 5, exclusion: dict | None = None,
              params: dict | None = None):
    """Lag-count x forest-depth sweep (random forest, untuned) on one horizon feature set.

    Drops the ramp-up periods first (``horizon > threshold``), prepares the lag
    frame per lag count (1-7, for months 1-4) and runs the repeated CV per depth.
    The split and SMOTE seeds are the CV's run numbers, the forest's seed is its
    depth.  Returns the metric rows with ``n_lags`` and ``max_depth`` for
    ``results.lag_tuning_curve``.  The input feature set is not modified.
    """
    from ..config import LAG_TUNING_EXCLUSION
    from .clock import horizon_exclusion
    from .lagging import prepare

    lag_range = lag_range or (range(1, 5) if fs.horizon == "study_month" else range(1, 8))
    thr = (exclusion or LAG_TUNING_EXCLUSION)[fs.horizon]
    base = fs.with_df(horizon_exclusion(fs.df, fs.horizon, thr))
    rows = None
    for n in lag_range:
        lagged = prepare(base, n_lags=n, check_nulls=False)
        df = cut_lineage(lagged.df)
        feats = [c for c in df.columns if c not in (fs.id_col, fs.target_col)]
        for depth in depth_range:
            mets, _, _ = repeated_cv(df, feats, fs.target_col, fs.id_col, "RF", runs, k, impute=False, nominal=list(lagged.nominal_cols),
                                     params={"n_estimators": 100, **(params or {}), "max_depth": depth}, model_seed=depth)
            part = mets.select(F.lit(fs.name).alias("featureset"), F.lit(n).alias("n_lags"), F.lit(depth).alias("max_depth"), "*")
            rows = part if rows is None else rows.unionByName(part)
    return rows


def save_fitted(model: Fitted, path: str) -> None:
    """Write a fitted model under ``path``: its Spark model(s), and one row of parameters and feature names."""
    spark = SparkSession.getActiveSession()
    model.model.write().overwrite().save(f"{path}/model")
    if model.platt is not None:
        model.platt.write().overwrite().save(f"{path}/platt")
    info = {"method": model.method, "features": list(model.features), "params": model.params, "kind": type(model.model).__name__,
            "rff": None if model.rff is None else vars(model.rff)}
    spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load_fitted(path: str) -> Fitted:
    """Read what ``save_fitted`` wrote."""
    from pyspark.ml import classification

    spark = SparkSession.getActiveSession()
    info = json.loads(spark.read.text(f"{path}/info").first()["value"])
    model = getattr(classification, info["kind"]).load(f"{path}/model")
    rff = RFF(**info["rff"]) if info["rff"] else None
    platt = classification.LogisticRegressionModel.load(f"{path}/platt") if rff else None
    return Fitted(info["method"], model, info["features"], info["params"], rff, platt)
