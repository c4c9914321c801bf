"""SMOTE / SMOTE-NC oversampling on exact nearest neighbours (``nearest``).

Neighbour search works on the *distinct* vectors of the minority class with
their multiplicities (a copy is a neighbour at distance 0); every minority row is
kept as base row.

Synthetic rows: the minority class is topped up to the majority size; base
rows are dealt round-robin in seeded-hash order, each synthetic row takes a
seeded neighbour among the base row's k nearest and a seeded gap u in [0, 1):
x + u (x_nn - x).  Continuous features are doubles in the result, so
interpolated values keep their fraction whatever the input type.  Nominal
columns (SMOTE-NC) take the most frequent value among the k neighbours (lowest
on ties; found once per list of neighbours) and add ``median_std^2`` to the squared distance per mismatch.  A
synthetic row keeps its base row's subject id, so grouped folds never split a
subject's synthetic rows from it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .folds import seeded_hash
from .nearest import ROWS, nearest
from .reshape import _q
from .scan import running_sums


def vector_id():
    """An id of the values of a vector (_v, _nv)."""
    return F.md5(F.concat_ws("|", F.transform("_v", lambda x: x.cast("string")), F.lit("#"), F.coalesce(F.to_json("_nv"), F.lit(""))))


def distinct_vectors(rows: DataFrame, *counts) -> DataFrame:
    """(_v, _nv, _m, ..., _vid): the distinct vectors, how many rows each has (and further aggregates), and an id of their values."""
    return rows.groupBy("_v", "_nv").agg(F.count(F.lit(1)).alias("_m"), *counts).withColumn("_vid", vector_id())


def neighbours(rows: DataFrame, k: int, seed: int = 0, penalty: float = 0.0, block: int = ROWS) -> DataFrame:
    """Per distinct vector of ``rows`` (_v, _nv): _vid, _v, _nv and ``_nb``, its k nearest rows' (_v, _nv), copies counted."""
    pts = cut_lineage(distinct_vectors(rows))
    near = nearest(pts, k, penalty, seed, block)
    other = pts.select(F.col("_vid").alias("nb"), F.struct("_v", "_nv").alias("_x"), "_m")
    lists = near.join(other, "nb").groupBy("_vid").agg(F.array_sort(F.collect_list(F.struct("dist2", "nb", "_x", "_m"))).alias("_l"))
    copies = F.array_repeat(F.struct("_v", "_nv"), F.least(F.col("_m") - 1, F.lit(k)).cast("int"))
    others = F.flatten(F.transform(F.coalesce("_l", F.array()), lambda x: F.array_repeat(x["_x"], F.least(x["_m"], F.lit(k)).cast("int"))))
    joined = pts.join(lists, "_vid", "left")
    return joined.select("_vid", "_v", "_nv", F.slice(F.concat(copies, F.when(F.col("_l").isNull(), F.array().cast(
        joined.select(copies.alias("c")).schema["c"].dataType)).otherwise(others)), 1, k).alias("_nb"))


def drawn_lists(lists: DataFrame, nominal) -> DataFrame:
    """``lists`` with what synthetic rows take of their ``_nb``: the neighbours' vectors, and ``_mode``, the most frequent value of each nominal (lowest on ties)."""
    def most(vals):
        return F.array_min(F.transform(F.array_distinct(vals), lambda v: F.struct((-F.size(F.filter(vals, lambda x: x.eqNullSafe(v)))).alias("n"), v.alias("v"))))["v"]

    def values(i):
        return F.transform("_nb", lambda x: F.get(x["_nv"], i))

    mode = F.transform(F.array(*[values(i) for i in range(len(nominal))]), most) if nominal else F.array().cast("array<string>")
    return lists.withColumns({"_nb": F.transform("_nb", lambda x: x["_v"]), "_mode": mode})


def synthetic_rows(base: DataFrame, dtypes, feats, nominal, own: dict) -> DataFrame:
    """Rows of the columns ``dtypes`` from base rows (_v), their neighbours' ``_mode``, the neighbour taken ``_to`` and the gap ``_gap``; ``own`` are columns given outright."""
    types = dict(dtypes)
    step = F.zip_with("_v", "_to", lambda a, b: (b - a))
    base = base.withColumn("_new", F.zip_with("_v", step, lambda a, d: a + F.col("_gap") * d))
    made = {f: F.get("_new", i) for i, f in enumerate(feats)}
    made |= {c: F.get("_mode", i).cast(types[c]) for i, c in enumerate(nominal)}
    made |= own
    return base.select(*[made[c].alias(c) if c in made else F.lit(None).cast(types[c]).alias(c) for c in types])


def feature_arrays(df: DataFrame, id_col: str, feats, nominal, *more) -> DataFrame:
    """(_id, _v, _nv, ...): the features travel as one array (two with nominals), without wide projections until the result."""
    return df.select(F.col(_q(id_col)).alias("_id"), F.array(*[F.col(_q(f)) for f in feats]).cast("array<double>").alias("_v"),
                     F.array(*[F.col(_q(c)).cast("string") for c in nominal]).cast("array<string>").alias("_nv"), *more)


def row_hash(seed):
    """Seeded hash of a row of ``feature_arrays``, which orders the base rows."""
    return seeded_hash(seed, "_id", F.concat_ws(",", F.transform("_v", lambda x: x.cast("string")), "_nv"))


def smote(df: DataFrame, features, label_col: str, id_col: str, k: int = 5, seed: int = 0,
          nominal=()) -> DataFrame:
    """Original rows plus synthetic minority rows so both classes have the same count.

    Adds ``synthetic`` (0/1); continuous features become doubles.  ``nominal``
    columns switch to SMOTE-NC.  When the minority class has at most ``k`` rows,
    ``k`` falls back to (minority - 1).
    """
    feats = [f for f in features if f not in nominal]
    nominal = list(nominal)
    types = dict(df.dtypes)
    df = df.withColumns({f: F.col(_q(f)).cast("double") for f in feats})
    counts = {r[label_col]: r["n"] for r in df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df.withColumn("synthetic", F.lit(0))
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[minority], max(counts.values())
    n_new = n_maj - n_min
    k_eff = min(k, n_min - 1)
    if n_new == 0 or k_eff < 1:
        return df.withColumn("synthetic", F.lit(0))
    mino = feature_arrays(df.where(F.col(label_col) == minority), id_col, feats, nominal)
    order = ["_id", "_v", "_nv"]
    mino = mino.withColumn("_h", row_hash(seed))
    mino = running_sums(mino.withColumn("_ord", F.struct("_h", *order)), [], "_ord", F.floor(F.col("_h") / F.lit(2 ** 22)).cast("int"), [],
                        descending=False, index_col="_pid")
    mino = cut_lineage(mino.select("_pid", "_id", "_v", "_nv"))
    penalty = 0.0
    if nominal:
        sds = mino.select(F.posexplode("_v")).groupBy("pos").agg(F.stddev_samp("col").alias("s")).collect()
        penalty = float(np.median([r["s"] or 0.0 for r in sds])) ** 2 if sds else 1.0
    nn = cut_lineage(drawn_lists(neighbours(mino, k_eff, seed, penalty), nominal))  # once per distinct vector, not per synthetic row
    # deal n_new synthetic rows round-robin over the minority rows (in seeded order = _pid)
    q, rem = divmod(n_new, n_min)
    reps = F.lit(q) + F.when(F.col("_pid") <= rem, 1).otherwise(0)
    base = mino.withColumn("_j", F.explode(F.when(reps > 0, F.sequence(F.lit(1), reps)).otherwise(F.array().cast("array<int>"))))
    base = base.withColumns({"_pick": (seeded_hash(seed, "_pid", "_j") % k_eff).cast("int"),
                             "_gap": seeded_hash(seed + 1, "_pid", "_j") / F.lit(float(2 ** 32))})
    syn = base.join(nn.drop("_vid"), ["_v", "_nv"])
    syn = syn.withColumn("_to", F.get("_nb", F.col("_pick") % F.size("_nb")))
    rows = synthetic_rows(syn, df.dtypes, feats, nominal, {id_col: F.col("_id"), label_col: F.lit(minority).cast(types[label_col])})
    return df.withColumn("synthetic", F.lit(0)).unionByName(rows.withColumn("synthetic", F.lit(1)))
