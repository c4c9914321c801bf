"""Exact k nearest neighbours of vectors by pivots and triangle inequalities.

The distance is Euclidean, plus ``penalty`` to its square for every nominal value
that differs; its root is a metric.

1. A seeded sample of the vectors are the pivots; every vector goes to the cell of
   its nearest pivot (a Voronoi partition).  A cell of more than ``rows`` vectors
   is cut into rings of like distance from its pivot, and a ring that holds more
   (equal distances) by a hash, so a block holds about ``rows`` vectors however
   they pile up.
2. A block is described by its least and greatest distance from ``REFERENCES`` of the
   pivots.  A vector x is at least max(d(x, p) - greatest, least - d(x, p)) from all of a block.
3. Each block compares its own vectors: their k-th distances there bound the true ones.
4. A vector opens the other blocks whose bound does not exceed its k-th distance
   so far.  Vectors that open a block meet it in groups of at most about ``QUERIES``,
   each with a copy of the block.  The lists are merged per vector.

Nothing is left out: a block not opened holds no vector at the k-th distance or
nearer.  Ties go to the smaller id.  The blocks' number is bounded
(``MOST_BLOCKS``: blocks grow beyond that many times ``rows`` vectors), and with it
what is collected and broadcast: pivots, ranges, counts of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship

#: Vectors of a block, vectors that meet a block in one group.
ROWS = 1024
QUERIES = 4096
#: Pivots at most; of these, the ones that blocks are described by.
PIVOTS = 2048
REFERENCES = 24
MOST_BLOCKS = 16384
#: Rows of a distance matrix held at a time.
STEP = 512

FOUND = "_vid string, nb string, dist2 double"


def distances(x, nom, y, nom_y, penalty: float) -> np.ndarray:
    """Squared distances of the rows of x from those of y, a mismatch of nominals as ``penalty``."""
    d2 = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d2 += (x[:, j, None] - y[None, :, j]) ** 2
    if penalty:
        for j in range(nom.shape[1]):
            codes = pd.factorize(np.concatenate([nom[:, j], nom_y[:, j]]), use_na_sentinel=False)[0]
            d2 += penalty * (codes[:len(x), None] != codes[None, len(x):])
    return d2


def vectors(pdf: pd.DataFrame, penalty: float):
    """Continuous values as a matrix, nominal ones as a matrix of objects (None without penalty)."""
    x = np.vstack(pdf["_v"].to_numpy()).astype(float) if len(pdf) and len(pdf["_v"].iloc[0]) else np.zeros((len(pdf), 0))
    nom = np.array([list(v) for v in pdf["_nv"]], object).reshape(len(pdf), -1) if penalty else None
    return x, nom


def nearest_of(x, nom, ids, y, nom_y, ids_y, k: int, penalty: float, within=None):
    """(row of x, row of y, dist2) of the k nearest rows of y per row of x, itself left out; y is in order of ids."""
    rows, cols, dist = [], [], []
    place = pd.Index(ids_y).get_indexer(ids)
    for at in range(0, len(x), STEP):
        own = np.arange(at, min(at + STEP, len(x)))
        d2 = distances(x[own], nom[own] if penalty else None, y, nom_y, penalty)
        same = np.flatnonzero(place[own] >= 0)
        d2[same, place[own][same]] = np.inf
        if d2.shape[1] > 8 * k:  # all that can be among the k nearest, then in order
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
        else:
            kth = np.full(len(own), np.inf)
        if within is not None:
            kth = np.minimum(kth, within[own])
        r, c = np.nonzero((d2 <= kth[:, None]) & np.isfinite(d2))
        order = np.lexsort((c, d2[r, c], r))
        r, c = r[order], c[order]
        first = np.searchsorted(r, np.arange(len(own)))
        held = np.arange(len(r)) - first[r] < k
        r, c = r[held], c[held]
        rows.append(own[r])
        cols.append(c)
        dist.append(d2[r, c])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def _compare(k: int, penalty: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_vid", ignore_index=True)
        x, nom = vectors(pdf, penalty)
        ids = pdf["_vid"].to_numpy()
        r, c, d = nearest_of(x, nom, ids, x, nom, ids, k, penalty)
        return pd.DataFrame({"_vid": ids[r], "nb": ids[c], "dist2": d})
    return run


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest per vector, ties to the smaller id."""
    w = Window.partitionBy("_vid").orderBy("dist2", "nb")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _cells(points: DataFrame, pivots: pd.DataFrame, penalty: float) -> DataFrame:
    """points with the number of the nearest pivot, the distance from it, and the distances from the reference pivots."""
    p, nom_p = vectors(pivots, penalty)
    shared = points.sparkSession.sparkContext.broadcast((p, nom_p))

    def run(parts):
        p, nom_p = shared.value
        for pdf in parts:
            if not len(pdf):
                continue
            x, nom = vectors(pdf, penalty)
            cell, far, ref = [], [], []
            for at in range(0, len(x), STEP):
                d = np.sqrt(distances(x[at:at + STEP], nom[at:at + STEP] if penalty else None, p, nom_p, penalty))
                cell.append(d.argmin(axis=1))
                far.append(d.min(axis=1))
                ref += list(d[:, :REFERENCES])
            yield pdf.assign(_cell=np.concatenate(cell).astype("int32"), _far=np.concatenate(far), _ref=ref)

    return points.mapInPandas(run, points.schema.simpleString()[7:-1] + ", _cell int, _far double, _ref array<double>")


def _blocks(cells: DataFrame, rows: int) -> DataFrame:
    """cells with ``_block``, the number of its block."""
    sizes = cells.groupBy("_cell").agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") * 2 / F.lit(rows)).cast("int")
    cuts = cells.groupBy("_cell").agg(F.percentile_approx("_far", [i / 64 for i in range(1, 64)], 10000).alias("_cuts"))
    ring = cells.join(F.broadcast(sizes.join(cuts, "_cell")), "_cell")  # a row per pivot
    place = F.size(F.filter("_cuts", lambda c: c < F.col("_far"))) / F.lit(64.0)
    ring = ring.withColumn("_ring", F.when(F.col("_n") <= rows, 0).otherwise(F.floor(place * F.least(parts, F.lit(64)))).cast("int")).drop("_n", "_cuts")
    held = ring.groupBy("_cell", "_ring").agg(F.count("*").alias("_n"))
    salts = F.ceil(F.col("_n") * 5 / F.lit(4 * rows))
    out = ring.join(F.broadcast(held), ["_cell", "_ring"])  # at most 64 rows per pivot
    salt = F.when(F.col("_n") <= rows, 0).otherwise(F.pmod(F.xxhash64("_vid"), salts))
    return out.withColumn("_block", F.concat_ws("/", "_cell", "_ring", salt.cast("string"))).drop("_cell", "_ring", "_n", "_far")


def _opened(k: int, penalty: float, names, low, high):
    """A block's vectors with their lists inside it and the other blocks that may hold nearer ones."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_vid", ignore_index=True)
        x, nom = vectors(pdf, penalty)
        ids, own = pdf["_vid"].to_numpy(), pdf["_block"].iloc[0]
        r, c, d = nearest_of(x, nom, ids, x, nom, ids, k, penalty)
        first = np.searchsorted(r, np.arange(len(ids) + 1))
        full = np.diff(first) == k
        kth = np.full(len(ids), np.inf)
        kth[full] = d[first[1:][full] - 1]
        ref, reach = np.vstack(pdf["_ref"].to_numpy()), np.sqrt(kth) * (1 + 1e-9) + 1e-12
        lists = []
        for at in range(0, len(ids), 128):
            part = ref[at:at + 128]
            bound = np.zeros((len(part), len(names)))
            for j in range(part.shape[1]):
                bound = np.maximum(bound, np.maximum(part[:, j, None] - high[None, :, j], low[None, :, j] - part[:, j, None]))
            lists += [[names[b] for b in np.flatnonzero(row) if names[b] != own] for row in bound <= reach[at:at + 128, None]]
        return pd.DataFrame({"_vid": ids, "_v": pdf["_v"], "_nv": pdf["_nv"] if penalty else [[]] * len(ids), "_kth": kth, "_open": lists,
                             "_nb": [list(ids[c[a:b]]) for a, b in zip(first[:-1], first[1:])], "_d": [list(d[a:b]) for a, b in zip(first[:-1], first[1:])]})
    return run


def _meet(k: int, penalty: float):
    """The nearest rows of a block for the vectors that opened it."""
    def run(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({"_vid": [], "nb": [], "dist2": []})
        block = block.sort_values("_vid", ignore_index=True)
        (x, nom), (y, nom_y) = vectors(asked, penalty), vectors(block, penalty)
        ids, ids_y = asked["_vid"].to_numpy(), block["_vid"].to_numpy()
        r, c, d = nearest_of(x, nom, ids, y, nom_y, ids_y, k, penalty, asked["_kth"].to_numpy())
        return pd.DataFrame({"_vid": ids[r], "nb": ids_y[c], "dist2": d})
    return run


def nearest(points: DataFrame, k: int, penalty: float = 0.0, seed: int = 0, rows: int = ROWS, only: DataFrame | None = None) -> DataFrame:
    """(_vid, nb, dist2): the k nearest other vectors of each of ``points`` (_vid, _v, _nv), which are distinct and written down.

    ``only`` (_vid) restricts the vectors that are asked about, not those that are found.
    """
    ship(points.sparkSession)
    points = points.select("_vid", "_v", "_nv")
    n = points.count()
    if n <= rows:  # one block
        found = points.withColumn("_block", F.lit(0)).groupBy("_block").applyInPandas(_compare(k, penalty), FOUND)
        return found if only is None else found.join(only, "_vid", "left_semi")
    rows = max(rows, -(-2 * n // MOST_BLOCKS))
    pivots = points.orderBy(F.xxhash64(F.lit(seed), "_vid"), "_vid").limit(min(PIVOTS, -(-2 * n // rows))).toPandas()
    blocks = cut_lineage(_blocks(_cells(points, pivots, penalty), rows))
    ranges = blocks.select("_block", F.posexplode("_ref")).groupBy("_block", "pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).toPandas()
    low, high = (ranges.pivot(index="_block", columns="pos", values=c) for c in ("low", "high"))
    names = low.index.to_numpy()
    own = blocks.groupBy("_block").applyInPandas(_opened(k, penalty, names, low.to_numpy(), high.to_numpy()),
                                                 "_vid string, _v array<double>, _nv array<string>, _kth double, _open array<string>, _nb array<string>, _d array<double>")
    own = cut_lineage(own if only is None else own.join(only, "_vid", "left_semi"))
    inside = own.select("_vid", F.explode(F.arrays_zip("_nb", "_d")).alias("x")).select("_vid", F.col("x._nb").alias("nb"), F.col("x._d").alias("dist2"))
    asked = own.select("_vid", "_v", "_nv", "_kth", F.explode("_open").alias("_block"))
    shares = asked.groupBy("_block").agg(F.ceil(F.count("*") * 5 / F.lit(4 * QUERIES)).cast("int").alias("_parts"))
    shares = F.broadcast(cut_lineage(shares))  # a row per block
    asked = asked.join(shares, "_block").withColumn("_part", F.pmod(F.xxhash64("_vid"), F.col("_parts")).cast("int"))
    copies = blocks.select("_block", "_vid", "_v", "_nv").join(shares, "_block").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    outside = asked.groupBy("_block", "_part").cogroup(copies.groupBy("_block", "_part")).applyInPandas(_meet(k, penalty), FOUND)
    return best(inside.union(outside), k)
