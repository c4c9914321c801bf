"""Feature attributions as Spark jobs.

* Linear models: closed form ``coef_j * (x_j - mean_background_j)``.
* Any model: permutation-sampled Shapley values (Strumbelj & Kononenko
  2014): for each explained row, a seeded random feature order, the same order
  reversed (antithetic) and a background row; the marginal change of the model
  score when feature j is switched from background to explained value, averaged
  over the pairs.  The spread of the pairs gives each value's standard error, and
  further batches are drawn until the largest one is small enough.  All coalition
  rows of a batch are built with ``explode`` and scored in one ``transform``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import seeded_hash, seeded_sample
from .reshape import _q


def background_means(background: DataFrame, features) -> dict:
    row = background.agg(*[F.avg(_q(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return {f: float(row[f"m{i}"] or 0.0) for i, f in enumerate(features)}


def linear_attribution(df: DataFrame, key_cols, coefs: dict, background: DataFrame) -> DataFrame:
    """Long table (keys..., feature, value, shap) with shap = coef * (x - background mean)."""
    feats = list(coefs)
    means = background_means(background, feats)
    stack = "stack({n}, {body}) AS (feature, value, shap)".format(
        n=len(feats), body=", ".join(
            f"'{f}', CAST({_q(f)} AS DOUBLE), {float(coefs[f])!r} * (CAST({_q(f)} AS DOUBLE) - {means[f]!r})"
            for f in feats))
    return df.selectExpr(*[_q(k) for k in key_cols], stack)


def _stride(n: int) -> int:
    """A step near the golden section of ``n`` that visits each of 0..n-1 once in n steps."""
    step = max(1, round(n * 0.6180339887))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def sampled_attribution(model, df: DataFrame, key_cols, features, background: DataFrame, n_samples: int = 32,
                        seed: int = 0, max_rows: int = 1000, max_error: float | None = None, max_samples: int = 256) -> DataFrame:
    """Permutation-sampled Shapley values of ``model.transform(...)['score']``.

    ``df`` and ``background`` are first reduced to seeded samples of at most
    ``max_rows`` rows, numbered in the sample's order, so equal rows stay apart.
    Each batch holds ``n_samples`` orders, in antithetic pairs.  Without ``max_error``
    there is one batch; with it, batches follow until no value's standard error
    exceeds it or ``max_samples`` orders are used.  Each row's pairs go round the whole
    background, so a linear score is exact after as many pairs as background rows.
    Returns (_rid, feature, shap, stderr, keys...) with ``_rid`` the number of the
    explained row; stderr is null for a single pair.
    """
    from ..session import cut_lineage

    feats = list(features)
    p, pairs = len(feats), max(1, n_samples // 2)
    keys = [k for k in key_cols if k not in feats]
    arr = F.array(*[F.col(_q(f)).cast("double") for f in feats])

    def numbered(frame, s, name, *cols):
        """The sample's rows with a number 0..; a window over at most max_rows rows."""
        sample = seeded_sample(frame, max_rows, s, key_cols).select(arr.alias(name), *cols)
        return sample.withColumn("_n", (F.row_number().over(Window.orderBy(name, *cols)) - 1).cast("long"))

    x = cut_lineage(numbered(df, seed, "_x", *[_q(k) for k in keys]).withColumnRenamed("_n", "_rid"))
    bg = cut_lineage(numbered(background, seed + 1, "_b").withColumnRenamed("_n", "_bid"))
    n_bg = max(bg.count(), 1)

    def batch(number):
        """(_rid, _fi, n, total, squares) over this batch's pairs."""
        rng = np.random.default_rng([seed, number])
        perms = np.array([rng.permutation(p) for _ in range(pairs)])
        pos = np.argsort(np.concatenate([perms, perms[:, ::-1]]), axis=1)  # pos[s][i] = position of feature i in order s
        pos_arr = F.array(*[F.array(*[F.lit(int(v)) for v in row]) for row in pos])
        s = x.select("_rid", "_x", F.explode(F.sequence(F.lit(0), F.lit(2 * pairs - 1))).alias("_s"))
        turn = F.col("_s") % pairs + number * pairs
        s = s.withColumn("_bid", (seeded_hash(seed, "_rid") % n_bg + turn * _stride(n_bg)) % n_bg)
        s = s.join(F.broadcast(bg), "_bid").withColumn("_pos", F.get(pos_arr, F.col("_s")))  # background: at most max_rows rows
        # coalition k (0..p): features at positions < k take the explained value, the rest the background
        c = s.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(p))))
        c = c.withColumn("_v", F.transform("_pos", lambda q, i: F.when(q < F.col("_k"), F.get("_x", i)).otherwise(F.get("_b", i))))
        # materialised (max_rows x n_samples x (p + 1)), so the model's vector expressions don't repeat the coalitions'
        coal = cut_lineage(c.select("_rid", "_s", "_k", "_pos", "_v"))
        rows = coal.select("_rid", "_s", "_k", "_pos", *[F.get("_v", i).alias(f) for i, f in enumerate(feats)])
        scored = cut_lineage(model.transform(rows).select("_rid", "_s", "_k", "_pos", "score"))
        nxt = scored.select("_rid", "_s", (F.col("_k") - 1).alias("_k"), F.col("score").alias("score_next"))
        d = scored.join(nxt, ["_rid", "_s", "_k"], "inner")
        # the feature switched between coalition k and k+1 is the one at position k
        d = d.withColumn("_fi", (F.array_position("_pos", F.col("_k")) - 1).cast("int"))
        pair = d.groupBy("_rid", "_fi", (F.col("_s") % pairs).alias("_pair")).agg(F.avg(F.col("score_next") - F.col("score")).alias("v"))
        return pair.groupBy("_rid", "_fi").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))

    spread = F.greatest(F.lit(0.0), F.col("squares") - F.col("total") * F.col("total") / F.col("n"))
    error = F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1) / F.col("n")))
    sums = cut_lineage(batch(0))
    number = 1
    while max_error is not None and (number + 1) * 2 * pairs <= max_samples:
        worst = sums.agg(F.max(F.coalesce(error, F.lit(float("inf"))))).first()[0]
        if worst is None or worst <= max_error:
            break
        both = sums.unionByName(batch(number)).groupBy("_rid", "_fi")
        sums = cut_lineage(both.agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]))
        number += 1
    names = F.array(*[F.lit(f) for f in feats])
    out = sums.select("_rid", F.get(names, F.col("_fi")).alias("feature"), (F.col("total") / F.col("n")).alias("shap"), error.alias("stderr"))
    return out.join(x.select("_rid", *[_q(k) for k in keys]), "_rid") if keys else out


def fitted_linear_attribution(fitted, df: DataFrame, key_cols, background: DataFrame) -> DataFrame:
    """``linear_attribution`` with the coefficients of a fitted logistic regression."""
    coefs = dict(zip(fitted.features, (float(c) for c in fitted.model.coefficients.toArray())))
    return linear_attribution(df, key_cols, coefs, background)
