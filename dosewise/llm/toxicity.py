"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed 4- and 5-grams of letters, present or absent in a text.  The
log-count ratio r of each is counted over all labelled training rows; features
with a ratio of ``MIN_RATIO`` at least, either way, are kept, and a logistic
regression is fitted on the ratios of a bounded sample (``FIT_ROWS`` of each
label, by the id's hash).  A text's score is the sigmoid of its weighted ratios.

Scale: counts are pre-aggregated per task and bounded by ``BUCKETS`` rows; texts
are joined with labels by a broadcast of checked size, or by a shuffle beyond
it; scoring doesn't shuffle.

Defined cases: a null or empty text has no features and gets the score of the
intercept; without labels of both kinds every score is 0; several labels of one
id count as toxic if one is; null ids, labels and held-out rows don't train;
held_out is false for a null id; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import letters
from .language_id import HELD_OUT, remainder
from .store import keep, ship, small

SIZES = (4, 5)
BUCKETS = 1 << 19
#: Pseudo-documents added to each feature in proportion to the labels.
SMOOTH = 10.0
MIN_RATIO = 1.0
FIT_ROWS = 6000
THRESHOLD = 0.3
RIDGE = 1.0


def features(texts: list, known: np.ndarray | None = None):
    """(first row, bucket, row, rows) of the distinct features of each run of texts; with ``known``, of the features marked there."""
    for first, folded, row, n in letters.runs(texts):
        parts = [letters.grams(folded, row, size) for size in SIZES]
        bucket = np.concatenate([p[0] for p in parts]) & np.uint64(BUCKETS - 1)
        own = np.concatenate([p[1] for p in parts])
        bucket = bucket.astype(np.int64)
        if known is not None:
            use = known[bucket]
            bucket, own = bucket[use], own[use]
        key = np.unique(own.astype(np.int64) * BUCKETS + bucket)
        yield first, key % BUCKETS, key // BUCKETS, n


def _count(batches):
    counts = np.zeros((2, BUCKETS), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        rows += np.bincount(toxic, minlength=2)
        for first, bucket, row, n in features(batch.column("text").to_pylist()):
            label = toxic[first:first + n][row]
            for k in (0, 1):
                counts[k] += np.bincount(bucket[label == k], minlength=BUCKETS)
    used = np.flatnonzero(counts.sum(axis=0))
    # bucket -1 carries the number of rows
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, used)), pa.array(np.append(rows[0], counts[0, used])),
                                      pa.array(np.append(rows[1], counts[1, used]))], names=["bucket", "clean", "toxic"])


def _chosen(batches, ratios):
    """The kept features of each text."""
    known = ratios.value != 0
    for batch in batches:
        for first, bucket, row, n in features(batch.column("text").to_pylist(), known):
            bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(first, n), pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32)))],
                                             names=["toxic", "buckets"])


def _logistic(lists: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, weight: np.ndarray, steps: int = 400):
    """Weights and intercept of an L2 logistic regression on the present features' ratios, by Adam on the full sample."""
    used = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int64)
    col = np.searchsorted(used, np.concatenate(lists))
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    value = scale[used][col]
    theta, m, v = (np.zeros(len(used) + 1) for _ in range(3))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * theta[col], len(lists)) + theta[-1])))
        err = weight * (p - labels)
        grad = np.append(np.bincount(col, value * err[row], len(used)) + RIDGE * theta[:-1], err.sum()) / len(lists)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    out = np.zeros(len(scale))
    out[used] = theta[:-1] * scale[used]
    return out, theta[-1]


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic"):
    """(weights per bucket, intercept), learnt from the labelled rows that aren't held out; None without both labels."""
    spark = docs.sparkSession
    ship(spark)
    known = keep(labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(id_col) != HELD_OUT))
                 .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic")))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    train = own.join(small(known, 24), "id")
    counts = train.select("text", "toxic").mapInArrow(_count, "bucket long, clean long, toxic long").groupBy("bucket").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = keep(counts)
    rows = counts.where("bucket = -1").first()
    if rows is None or not rows["clean"] or not rows["toxic"]:
        return None
    n = np.array([rows["clean"], rows["toxic"]], float)
    prior = n / n.sum()
    ratio = F.log((F.col("toxic") + SMOOTH * float(prior[1])) / float(n[1])) - F.log((F.col("clean") + SMOOTH * float(prior[0])) / float(n[0]))
    # at most BUCKETS rows
    kept = counts.where("bucket >= 0").withColumn("r", ratio).where(F.abs("r") >= MIN_RATIO).select("bucket", "r").orderBy("bucket").toPandas()
    ratios = np.zeros(BUCKETS)
    ratios[kept["bucket"].to_numpy(np.int64)] = kept["r"].to_numpy(float)
    shared = spark.sparkContext.broadcast(ratios)
    picks = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS) for k in (0, 1)]
    sample = own.join(small(keep(picks[0].union(picks[1])), 24), "id").select("text", "toxic")
    got = sample.mapInArrow(lambda it: _chosen(it, shared), "toxic int, buckets array<int>").collect()  # 2 * FIT_ROWS at most
    got.sort(key=lambda r: (r["toxic"], r["buckets"]))  # one order whatever the tasks' order
    lists = [np.array(r["buckets"], np.int64) for r in got]
    label = np.array([r["toxic"] for r in got], float)
    if not len(label) or label.min() == label.max():
        return None
    weight = np.where(label > 0, prior[1] / label.mean(), prior[0] / (1 - label.mean()))
    return _logistic(lists, label, ratios, weight)


def predict(docs: DataFrame, model, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """Per input row: doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(id_col) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            score = np.zeros(len(batch))
            if shared.value is not None:
                weights, intercept = shared.value
                for first, bucket, row, n in features(batch.column("text").to_pylist(), weights != 0):
                    score[first:first + n] = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[bucket], n) + intercept, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> DataFrame:
    return predict(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
