"""A whole grid of boosted trees on all inner folds, grown together from binned rows.

The trees are those of ``GBTClassifier``: logistic loss on labels of -1 and 1, a first
tree of weight 1 on the labels, every further one of weight ``learning_rate`` on the
residuals, splits by variance between at most ``BINS`` bins of a column.  Bins are cut as
Spark cuts them, from all rows of the training side (Spark takes a sample beyond 10,000).

* A column's cuts follow from its values' counts per fold (one aggregate); the counts of a
  side are all minus the held-out fold's.
* A row is a few bytes per side: a byte holds the bin of one column, or those of several
  columns with few bins.
* A task grows the points of one (fold, learning rate, depth): it holds its fold's bytes and a
  margin per row.  Points that differ in ``gamma`` or ``min_child_weight`` share all trees up
  to the first node where they decide otherwise; from that tree on they are grown apart.
  Points that differ in the number of trees are scored on the way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship

#: Bins of a column at most, as ``GBTClassifier`` has them; values of a byte.
BINS = 32
BYTE = 256
#: Rows whose statistics are summed at a time.
CHUNK = 32768


def cuts_of(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts between the distinct ``values``: all middles, or those nearest to even counts."""
    if len(values) < 2:
        return np.zeros(0)
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= most:
        return middles
    upto = np.cumsum(counts, dtype=float)
    between = (upto[:-1] + upto[1:]) / 2.0  # a cut before value i + 1 is nearer to a target below this than one after it
    stride, found, at = upto[-1] / (most + 1), [], 0
    while True:
        at = max(at, int(np.searchsorted(between, stride * (len(found) + 1), side="right")))
        if at >= len(middles):
            return np.array(found)
        found.append(middles[at])
        at += 1


def layout(cuts: list) -> list:
    """Bytes of a row: per byte its columns as (column, cuts, factor); a column without cuts is left out."""
    out, size = [], BYTE
    for _, j in sorted((len(c), j) for j, c in enumerate(cuts) if len(c)):
        if size * (len(cuts[j]) + 1) > BYTE:
            out.append([])
            size = 1
        out[-1].append((j, cuts[j], size))
        size *= len(cuts[j]) + 1
    return out


def coded(x: np.ndarray, places: list) -> np.ndarray:
    """(bytes, rows): the rows of x in a layout."""
    out = np.zeros((len(places), len(x)), np.uint8)
    for code, columns in zip(out, places):
        for j, cuts, factor in columns:
            code += (np.searchsorted(cuts, x[:, j], side="left") * factor).astype(np.uint8)
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("_x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _counted(batches):
    """(feature, value, fold, n) of every batch."""
    for batch in batches:
        x, folds = _matrix(batch), batch.column("fold").to_numpy(zero_copy_only=False)
        for fold in np.unique(folds):
            for j in range(x.shape[1]):
                values, n = np.unique(x[folds == fold, j], return_counts=True)
                yield pa.RecordBatch.from_pydict({"feature": pa.array(np.full(len(n), j, "int32")), "value": pa.array(values.astype(float)),
                                                  "fold": pa.array(np.full(len(n), fold, "int32")), "n": pa.array(n.astype("int64"))})


def side_cuts(rows: DataFrame, width: int, folds: int) -> list:
    """[fold][column]: the cuts of each training side, from all its rows."""
    counts = rows.mapInArrow(_counted, "feature int, value double, fold int, n bigint").groupBy("feature", "value").agg(
        *[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"c{f}") for f in range(folds)])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        held = pdf[[f"c{f}" for f in range(folds)]].to_numpy()
        out = []
        for f in range(folds):
            n = held.sum(axis=1) - held[:, f]
            out.append((int(pdf["feature"].iloc[0]), f, list(cuts_of(pdf["value"].to_numpy()[n > 0], n[n > 0], min(BINS, int(n.sum())) - 1))))
        return pd.DataFrame(out, columns=["feature", "fold", "cuts"])

    found = [[np.zeros(0) for _ in range(width)] for _ in range(folds)]
    for r in counts.groupBy("feature").applyInPandas(cut, "feature int, fold int, cuts array<double>").collect():  # columns x folds
        found[r["fold"]][r["feature"]] = np.array(r["cuts"], float)
    return found


def _blocks(places: list):
    """Per batch and fold one row: its rows' bytes, labels and whether they are held out."""
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            x, folds = _matrix(batch), batch.column("fold").to_numpy(zero_copy_only=False)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
            for f, place in enumerate(places):
                yield pa.RecordBatch.from_pydict({"side": pa.array([f], pa.int32()), "part": pa.array([part], pa.int32()), "block": pa.array([i], pa.int32()), "label": pa.array([label], pa.binary()),
                                                  "held": pa.array([(folds == f).astype(np.uint8).tobytes()], pa.binary()), "codes": pa.array([coded(x, place).tobytes()], pa.binary())})
    return run


class Side:
    """The rows of a training side, its own first, then those held out."""

    def __init__(self, codes: np.ndarray, label: np.ndarray, held: np.ndarray, places: list):
        order = np.argsort(held, kind="stable")
        self.codes, self.n = np.ascontiguousarray(codes[:, order]), int(len(held) - held.sum())
        if not self.n:
            raise ValueError("a training side has no rows")
        self.y = np.where(label[order] > 0, 1.0, -1.0)
        self.negative = np.flatnonzero(self.y[self.n:] < 0) + self.n
        # cuts in the order of the columns: the byte, the byte's values that go left
        self.left, at = [], []
        for b, columns in enumerate(places):
            value, masks = np.arange(BYTE), []
            for j, cuts, factor in columns:
                bins = value // factor % (len(cuts) + 1)
                masks += [bins <= c for c in range(len(cuts))]
                at += [(j, c, b) for c in range(len(cuts))]
            self.left.append(np.array(masks, float).T)
        self.order = sorted(range(len(at)), key=lambda i: at[i][:2])
        self.byte = [at[i][2] for i in self.order]
        lefts = [row for m in self.left for row in m.T]
        self.right = [lefts[i] == 0 for i in self.order]
        self.order = np.array(self.order, int)
        self.rooted = self.sums(np.zeros(self.n, np.uint8), 1)  # counts at the root, the same for every tree

    def sums(self, node: np.ndarray, nodes: int, weights: np.ndarray | None = None) -> np.ndarray:
        """(nodes, cuts): per node the rows (or their weights) left of every cut."""
        total = np.zeros((len(self.codes), nodes * BYTE))
        for a in range(0, self.n, CHUNK):
            b = min(a + CHUNK, self.n)
            base = node[a:b].astype(np.intp) * BYTE
            at = np.empty(b - a, np.intp)
            for c, code in enumerate(self.codes):
                np.add(base, code[a:b], out=at)
                total[c] += np.bincount(at, None if weights is None else weights[a:b], nodes * BYTE)
        parts = [t.reshape(nodes, BYTE) @ m for t, m in zip(total, self.left)]
        return np.concatenate(parts, axis=1)[:, self.order] if parts else np.zeros((nodes, 0))

    def residuals(self, margin: np.ndarray | None) -> np.ndarray:
        y = self.y[:self.n]
        if margin is None:
            return y.copy()
        with np.errstate(over="ignore"):
            return 4.0 * y / (1.0 + np.exp(2.0 * y * margin[:self.n]))

    def decide(self, n: float, s: float, left: np.ndarray, weight: np.ndarray, limits: list) -> list:
        """Per (least gain, least rows) the best cut of a node, or -1."""
        if not len(left):
            return [-1] * len(limits)
        right = n - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (weight ** 2 / left + (s - weight) ** 2 / right - s ** 2 / n) / n
        found = []
        for least, rows in limits:
            allowed = np.where((left >= max(rows, 1)) & (right >= max(rows, 1)), gain, -np.inf)
            best = int(np.argmax(allowed))
            found.append(best if allowed[best] >= least and allowed[best] > 0 else -1)
        return found

    def tree(self, r: np.ndarray, depth: int, limits: list):
        """A tree as the first of ``limits`` grows it: each row's leaf, the leaves' values, and which of the limits grow the same."""
        node, same = np.zeros(len(self.y), np.uint8 if depth <= 7 else np.uint32), np.ones(len(limits), bool)
        values = np.zeros(1 << depth)
        live = {0: (float(self.n), float(r.sum()))}
        for level in range(depth):
            nodes = 1 << level
            left = self.rooted if level == 0 else self.sums(node, nodes)
            weight = self.sums(node, nodes, r)
            split, grown = {}, {}
            for p, (n, s) in live.items():
                found = self.decide(n, s, left[p], weight[p], limits)
                same &= np.array(found) == found[0]
                if found[0] < 0:
                    values[p << (depth - level)] = s / n
                    continue
                at = split[p] = found[0]
                grown[2 * p] = (left[p, at], weight[p, at])
                grown[2 * p + 1] = (n - left[p, at], s - weight[p, at])
            live = grown
            if not split:
                return node << (depth - level), values, same
            turned = np.zeros(len(node), bool)
            for p, at in split.items():
                turned |= (node == p) & self.right[at][self.codes[self.byte[at]]]
            node = (node << 1) + turned
        for p, (n, s) in live.items():
            values[p] = s / n
        return node, values, same

    def scores(self, rate: float, depth: int, limits: list, sizes: list) -> dict:
        """{(limit, size): specificity on the rows held out}."""
        out, waiting = {}, [(list(range(len(limits))), 0, None)]
        while waiting:
            points, done, margin = waiting.pop()
            while done < sizes[-1]:
                leaf, values, same = self.tree(self.residuals(margin), depth, [limits[p] for p in points])
                if not same.all():  # these decide otherwise somewhere: they go on apart from this tree on
                    waiting.append(([p for p, s in zip(points, same) if not s], done, None if margin is None else margin.copy()))
                    points = [p for p, s in zip(points, same) if s]
                if margin is None:
                    margin = values[leaf]
                else:
                    margin += (rate * values)[leaf]
                done += 1
                if done in sizes:
                    right = float((margin[self.negative] <= 0).mean()) if len(self.negative) else 0.0
                    out.update({(p, done): right for p in points})
        return out


def _search(tasks: list, places: list):
    """All tasks' scores from their blocks."""
    def run(parts):
        got: dict = {}
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                got.setdefault(r.task, []).append((r.part, r.block, r.label, r.held, r.codes))
        while got:
            task, blocks = got.popitem()
            fold, rate, depth, limits, sizes = tasks[task]
            blocks.sort(key=lambda b: b[:2])
            label, held = (np.concatenate([np.frombuffer(b[i], np.uint8) for b in blocks]) for i in (2, 3))
            codes = np.concatenate([np.frombuffer(b[4], np.uint8).reshape(len(places[fold]), len(b[2])) for b in blocks], axis=1)
            del blocks
            side = Side(codes, label, held, places[fold])
            del codes, label, held
            gamma = [(g / side.n, rows) for g, rows in limits]
            found = side.scores(rate, depth, gamma, sizes)
            yield pd.DataFrame([(task, p, size, v) for (p, size), v in found.items()], columns=["task", "point", "size", "score"])
    return run


def boosted_scores(rows: DataFrame, width: int, points: list, folds: int) -> list:
    """Per point (learning rate, depth, gamma, least rows, trees) its specificity on every fold held out.

    ``rows`` are (label, fold, _x), _x an array of ``width`` values, none missing, and are written down.
    """
    ship(rows.sparkSession)
    places = [layout(c) for c in side_cuts(rows, width, folds)]
    kinds: dict = {}
    for rate, depth, gamma, least, trees in points:
        limits, sizes = kinds.setdefault((rate, depth), (set(), set()))
        limits.add((gamma, least))
        sizes.add(trees)
    tasks = [(f, rate, depth, sorted(limits), sorted(sizes)) for (rate, depth), (limits, sizes) in sorted(kinds.items(), key=lambda k: -k[0][1]) for f in range(folds)]
    sides = [F.array(*[F.lit(i) for i, t in enumerate(tasks) if t[0] == f]) for f in range(folds)]
    blocks = cut_lineage(rows.mapInArrow(_blocks(places), "side int, part int, block int, label binary, held binary, codes binary"))
    dealt = blocks.withColumn("task", F.explode(F.get(F.array(*sides), F.col("side")))).repartitionById(len(tasks), F.col("task"))
    found = dealt.mapInPandas(_search(tasks, places), "task int, point int, size int, score double").collect()  # points x folds
    score = {}
    for r in found:
        f, rate, depth, limits, _ = tasks[r["task"]]
        score[rate, depth, *limits[r["point"]], r["size"], f] = r["score"]
    return [[score[*p, f] for f in range(folds)] for p in points]
