"""Co-moments of many columns in one pass: blocks of a masked matrix, summed.

A task turns its rows into matrices X (values, 0 where null) and M (1 where present)
and adds up M'M, X'M, (X*X)'M and X'X, so the pair (i, j) gets count, sums, squares
and product over the rows that hold both.  A task emits one row per pair, whatever
its rows; these are summed in one small shuffle.  The plan has a handful of expressions
however many columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .reshape import _q

SUMS = ("n", "x", "xx", "xy")
#: Rows of a matrix held at a time.
ROWS = 1 << 14


def _blocks(p: int, shift: list, complete: bool):
    def run(batches):
        total = {k: np.zeros((p, p)) for k in SUMS}
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                columns = [c.slice(at, ROWS) for c in batch.columns]
                m = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], float)
                x = np.array([pc.fill_null(c, s).to_numpy(zero_copy_only=False) - s for c, s in zip(columns, shift)])
                if complete:
                    held = m.all(axis=0)
                    m, x = m[:, held], x[:, held]
                x = x * m
                total["n"] += m @ m.T
                total["x"] += x @ m.T  # sum of i where j is present
                total["xx"] += (x * x) @ m.T
                total["xy"] += x @ x.T
        i, j = np.divmod(np.arange(p * p), p)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(total[k].ravel()) for k in SUMS]], names=["i", "j", *SUMS])
    return run


def co_moments(df: DataFrame, cols, shift=None, complete: bool = False) -> DataFrame:
    """(i, j, n, x, xx, xy) of every ordered pair of columns over the rows that hold both (``complete``: all columns); values less ``shift``."""
    ship(df.sparkSession)
    cols = list(cols)
    values = df.select(*[F.col(_q(c)).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    blocks = values.mapInArrow(_blocks(len(cols), [float(s) for s in shift or [0.0] * len(cols)], complete),
                               "i int, j int, " + ", ".join(f"{k} double" for k in SUMS))
    return blocks.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in SUMS])
