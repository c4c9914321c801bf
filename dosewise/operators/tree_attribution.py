"""Exact Shapley values of tree ensembles from a table of leaf paths.

A leaf is reached when each feature on its path lies in an interval (low, high].
Against a background row z, feature j of the explained row x matters to a
leaf if only one of x_j, z_j lies in the interval: with a features that only x meets and b that
only z meets (and none that neither meets) the leaf's value v counts for a
coalition that holds all of the former and none of the latter.  The Shapley
values of that game are known: v (a-1)! b! / (a+b)! for each of the former,
-v a! (b-1)! / (a+b)! for each of the latter.

So rows are reduced to one bit mask per leaf (which of its intervals they
meet), background rows to counts per (leaf, mask), and the values to a table per (leaf,
mask of x, feature), which is as large as the model and its masks, not as
the data; explained rows meet it by one equi-join.  The values of a row sum to its score
minus the background's mean score.  Forests are explained on their probability of
class 1, boosted trees on their margin.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .reshape import _q

PATHS = "leaf int, value double, place int, feature int, low double, high double"
#: Most features on one path, as bits of a mask.
WIDEST = 60


def leaf_paths(spark: SparkSession, trees: list) -> DataFrame:
    """(leaf, value, place, feature, low, high): the intervals of each leaf's path; a tree is (nodes by id, weight), a
    node (feature, threshold, left, right, value) with feature -1 for a leaf.  A leaf at the root has one row without a feature."""
    rows, leaf = [], 0
    for nodes, weight in trees:
        stack = [(0, {})]
        while stack:
            at, held = stack.pop()
            feature, threshold, left, right, value = nodes[at]
            if feature < 0:
                spans = sorted(held.items()) or [(None, (None, None))]
                if len(spans) > WIDEST:
                    raise ValueError(f"a path has more than {WIDEST} features")
                rows += [(leaf, float(value) * weight, p if f is not None else None, f, *span) for p, (f, span) in enumerate(spans)]
                leaf += 1
                continue
            low, high = held.get(feature, (-math.inf, math.inf))
            stack.append((right, {**held, feature: (max(low, threshold), high)}))
            stack.append((left, {**held, feature: (low, min(high, threshold))}))
    return spark.createDataFrame(rows, PATHS)


def model_trees(spark: SparkSession, fitted) -> list:
    """The trees of a fitted forest (probability of class 1) or of boosted trees (margin), read from the saved model's node table."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    fitted.model.write().save(path)
    weights = fitted.model.treeWeights
    forest = fitted.method == "RF"
    trees = [({}, float(w) / (sum(weights) if forest else 1.0)) for w in weights]
    for row in spark.read.parquet(f"{path}/data").collect():  # the model, which the driver holds anyway
        n = row["nodeData"]
        value = n["impurityStats"][1] / sum(n["impurityStats"]) if forest else n["prediction"]
        split = n["split"]
        threshold = split["leftCategoriesOrThreshold"][0] if n["leftChild"] >= 0 else 0.0
        trees[row["treeID"]][0][n["id"]] = (split["featureIndex"] if n["leftChild"] >= 0 else -1, threshold, n["leftChild"], n["rightChild"], value)
    return trees


def _masks(rows: DataFrame, paths: list, *cols) -> DataFrame:
    """cols, leaf, mask: one row per row (``_x``) and leaf, with the bits of the intervals that the row meets."""
    leaves: dict = {}
    for r in paths:
        leaves.setdefault(r["leaf"], []).append(r)
    kind = "array<struct<leaf:int,spans:array<struct<f:int,low:double,high:double,bit:bigint>>>>"
    big = 1.7e308  # infinity has no JSON form
    text = json.dumps([{"leaf": k, "spans": [{"f": r["feature"], "low": max(r["low"], -big), "high": min(r["high"], big), "bit": 1 << r["place"]}
                                            for r in v if r["feature"] is not None]} for k, v in sorted(leaves.items())])
    model = F.from_json(F.lit(text), kind)  # folded to a constant

    def met(span) -> Column:
        x = F.get(F.col("_x"), span["f"])
        return F.when((x > span["low"]) & (x <= span["high"]), span["bit"]).otherwise(F.lit(0).cast("bigint"))

    mask = F.transform(model, lambda leaf: F.struct(leaf["leaf"].alias("leaf"), F.aggregate(
        leaf["spans"], F.lit(0).cast("bigint"), lambda acc, s: acc.bitwiseOR(met(s))).alias("mask")))
    return rows.select(*cols, F.explode(mask).alias("m")).select(*cols, "m.leaf", "m.mask")


def _tables(paths: DataFrame, features, background: DataFrame):
    listed = paths.collect()
    back = _masks(background.select(_array(features).alias("_x")), listed).groupBy("leaf", "mask").agg(F.count("*").alias("n"))
    return listed, cut_lineage(back.withColumn("share", F.col("n") / F.sum("n").over(_per_leaf()))).drop("n")


def _per_leaf():
    from pyspark.sql import Window
    return Window.partitionBy("leaf")  # masks of one leaf


def _array(features) -> Column:
    return F.array(*[F.col(_q(f)).cast("double") for f in features])


def base_value(paths: DataFrame, features, background: DataFrame) -> float:
    """The background's mean score."""
    _, back = _tables(paths, features, background)
    full = paths.groupBy("leaf", "value").agg(F.coalesce(F.sum(F.expr("shiftleft(1L, place)")), F.lit(0)).alias("mask"))
    return float(back.join(full, ["leaf", "mask"]).agg(F.sum(F.col("share") * F.col("value"))).first()[0] or 0.0)


def tree_attribution(paths: DataFrame, df: DataFrame, key_cols, features, background: DataFrame) -> DataFrame:
    """(keys..., feature, shap) of every row of ``df`` against all of ``background``; ``key_cols`` name a row."""
    features, keys = list(features), list(key_cols)
    listed, back = _tables(paths, features, background)
    rows = cut_lineage(_masks(df.select(*[_q(k) for k in keys], _array(features).alias("_x")), listed, *[_q(k) for k in keys]))
    seen = rows.groupBy("leaf", "mask").agg(F.lit(1).alias("_one")).drop("_one")
    full = paths.groupBy("leaf", "value").agg(F.coalesce(F.sum(F.expr("shiftleft(1L, place)")), F.lit(0)).alias("full"))
    # pairs of masks of one leaf: at most 4 to the length of its path, whatever the rows
    pairs = seen.join(back.withColumnRenamed("mask", "z"), "leaf").join(full, "leaf").where(F.col("mask").bitwiseOR(F.col("z")) == F.col("full"))
    pairs = pairs.withColumns({"a": F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not("z"))), "b": F.bit_count(F.col("z").bitwiseAND(F.bitwise_not("mask")))})
    fact = F.array(*[F.lit(float(math.factorial(i))) for i in range(WIDEST + 2)])

    def f(n) -> Column:
        return F.element_at(fact, n + 1)

    spot = paths.where("feature is not null").select("leaf", "feature", F.expr("shiftleft(1L, place)").alias("bit"))
    of_x, of_z = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("z").bitwiseAND(F.col("bit")) != 0
    share = F.when(of_x & ~of_z, f(F.col("a") - 1) * f(F.col("b")) / f(F.col("a") + F.col("b"))).when(
        of_z & ~of_x, -f(F.col("a")) * f(F.col("b") - 1) / f(F.col("a") + F.col("b")))
    table = pairs.join(spot, "leaf").withColumn("part", F.col("share") * F.col("value") * share).where("part is not null") \
        .groupBy("leaf", "mask", "feature").agg(F.sum("part").alias("part"))
    found = rows.join(cut_lineage(table), ["leaf", "mask"]).select(*[_q(k) for k in keys], "feature", "part")
    none = df.select(*[_q(k) for k in keys], F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("feature"), F.lit(0.0).alias("part"))
    names = F.array(*[F.lit(x) for x in features])
    return found.unionByName(none).groupBy(*[_q(k) for k in keys], "feature").agg(F.sum("part").alias("shap")).withColumn("feature", F.get(names, F.col("feature")))
