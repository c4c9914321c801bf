"""Min-max scaling and imputation fitted on one frame, applied as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reshape import _q


def minmax_fit(df: DataFrame, cols) -> dict:
    """{col: (min, max)} from one aggregate (bounded by the column count)."""
    cols = list(cols)
    row = df.agg(*[F.min(_q(c)).alias(f"mn{i}") for i, c in enumerate(cols)],
                 *[F.max(_q(c)).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(cols)}


def minmax_apply(df: DataFrame, ranges: dict) -> DataFrame:
    """(x - min) / (max - min) to [0, 1]; a constant column maps to 0."""
    exprs = {}
    for c, (mn, mx) in ranges.items():
        if mn is None:
            continue
        rng = float(mx) - float(mn)
        exprs[c] = (F.col(_q(c)).cast("double") - F.lit(float(mn))) / F.lit(rng if rng != 0 else 1.0)
    return df.withColumns(exprs)


def minmax(fit_df: DataFrame, df: DataFrame, cols) -> DataFrame:
    return minmax_apply(df, minmax_fit(fit_df, cols))


def mode_fill(df: DataFrame, cols, fit_df: DataFrame | None = None) -> DataFrame:
    """Fill NULLs with the column mode of ``fit_df`` (lowest value on ties)."""
    cols = list(cols)
    src = fit_df if fit_df is not None else df
    modes = {}
    for c in cols:  # counts per value, then the largest: no task holds all values
        top = src.where(F.col(_q(c)).isNotNull()).groupBy(F.col(_q(c)).alias("v")).agg(F.count(F.lit(1)).alias("n")) \
            .orderBy(F.col("n").desc(), "v").first()
        modes[c] = top["v"] if top else None
    return df.withColumns({c: F.coalesce(F.col(_q(c)), F.lit(v)) for c, v in modes.items() if v is not None})


def evidence_ridge(n: float, xx: np.ndarray, xy: np.ndarray, yy: float, rounds: int = 300, tol: float = 1e-3, hyper: float = 1e-6) -> np.ndarray:
    """Weights of a Bayesian linear regression, from centred moments X'X, X'y and y'y of ``n`` rows.

    The precisions of noise and weights are those that maximise the evidence
    (MacKay 1992, with flat Gamma priors ``hyper``), re-estimated through the
    eigenvalues of X'X until the weights move by less than ``tol`` in sum.
    """
    values, vectors = np.linalg.eigh(xx)
    values, along = np.maximum(values, 0.0), vectors.T @ xy
    noise, weight, last = 1.0 / (yy / n + np.finfo(float).eps), 1.0, None
    for _ in range(rounds):
        w = vectors @ (along / (values + weight / noise))
        determined = float(np.sum(noise * values / (weight + noise * values)))
        weight = (determined + 2 * hyper) / (float(w @ w) + 2 * hyper)
        noise = (n - determined + 2 * hyper) / (max(float(yy - 2 * (w @ xy) + w @ xx @ w), 0.0) + 2 * hyper)
        if last is not None and np.abs(w - last).sum() < tol:
            break
        last = w
    return vectors @ (along / (values + weight / noise))


def _regression(df: DataFrame, target: str, others, means: dict, seen: str) -> np.ndarray | None:
    """Intercept and weights of ``target`` on the other columns over the rows where it was observed; None without such rows.

    One aggregate of products of the columns less their ``means``, which keeps the centred moments accurate.
    """
    cols = [*others, target]
    v = [F.col(_q(c)) - F.lit(means[c]) for c in cols]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    row = df.where(F.col(seen)).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(v)],
                                    *[F.sum(v[i] * v[j]).alias(f"g{i}_{j}") for i, j in pairs]).first()
    if not row["n"]:
        return None
    total, n = np.array([row[f"s{i}"] for i in range(len(v))]), row["n"]
    gram = np.zeros((len(v), len(v)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] - total[i] * total[j] / n
    w = evidence_ridge(n, gram[:-1, :-1], gram[:-1, -1], max(gram[-1, -1], 0.0))
    centre = total / n + np.array([means[c] for c in cols])
    return np.append(centre[-1] - w @ centre[:-1], w)


def _predict(others, beta):
    pred = F.lit(float(beta[0]))
    for o, w in zip(others, beta[1:]):
        pred = pred + F.lit(float(w)) * F.col(_q(o))
    return pred


#: Rounds replayed on another frame between two checkpoints.
REPLAY = 5


def chained_impute(fit_df: DataFrame, apply_dfs, cols, rounds: int = 10, tol: float = 1e-3):
    """Round-robin regression imputation of numeric ``cols``.

    Start from the fit frame's column means; each round, for every column with
    missing values (fewest first), fit an evidence-maximised ridge regression on
    the other (current) columns over the fit frame's observed rows -- one distributed
    aggregate, a p x p solve on the driver -- and fill that column's gaps with the
    prediction, a column expression.  Rounds end when no filled value of the fit frame
    moves by more than ``tol`` times the largest observed magnitude.  The fit frame is
    checkpointed once per round and returned as it stands where it is among
    ``apply_dfs``; on other frames the fitted sequence is replayed as expressions.
    Columns with gaps in an apply frame only are regressed too; a column without any
    observed value stays at 0.  Returns the imputed ``apply_dfs`` (a list).
    """
    from ..session import cut_lineage

    cols = list(cols)
    number = {c: F.col(_q(c)).cast("double") for c in cols}
    empty = [F.count(F.when(F.col(_q(c)).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(cols)]
    stats = fit_df.agg(*[F.avg(number[c]).alias(f"a{i}") for i, c in enumerate(cols)], *empty,
                       F.greatest(F.lit(0.0), *[F.max(F.abs(number[c])) for c in cols]).alias("most")).first()
    means = {c: float(stats[f"a{i}"] or 0.0) for i, c in enumerate(cols)}
    gaps = [stats] + [d.agg(*empty).first() for d in apply_dfs if d is not fit_df]
    missing = sorted((c for i, c in enumerate(cols) if any(g[f"n{i}"] for g in gaps)), key=lambda c: stats[f"n{cols.index(c)}"])
    seen = {c: f"_obs_{i}" for i, c in enumerate(cols)}
    was = {c: f"_was_{i}" for i, c in enumerate(missing)}

    def start(df):
        d = df.withColumns({seen[c]: F.col(_q(c)).isNotNull() for c in cols})
        return d.withColumns({c: F.coalesce(number[c], F.lit(means[c])) for c in cols})

    def filled(df, c, others, beta):
        return df.withColumn(c, F.when(F.col(seen[c]), F.col(_q(c))).otherwise(_predict(others, beta)))

    cur, steps = start(fit_df), []
    for _ in range(rounds if missing and len(cols) > 1 else 0):
        cur, done = cur.withColumns({was[c]: F.col(_q(c)) for c in missing}), []
        for c in missing:
            others = [o for o in cols if o != c]
            beta = _regression(cur, c, others, means, seen[c])
            if beta is not None:
                done.append((c, others, beta))
                cur = filled(cur, c, others, beta)
        steps.append(done)
        cur = cut_lineage(cur)
        moved = cur.agg(F.greatest(F.lit(0.0), *[F.max(F.abs(F.col(_q(c)) - F.col(was[c]))) for c in missing])).first()[0]
        if moved <= tol * stats["most"]:
            break
    out = []
    for df in apply_dfs:
        d = cur if df is fit_df else start(df)
        for i, done in enumerate(steps if df is not fit_df else [], 1):
            for c, others, beta in done:
                d = filled(d, c, others, beta)
            if i % REPLAY == 0 or i == len(steps):
                d = cut_lineage(d)
        out.append(d.drop(*seen.values(), *was.values()))
    return out
