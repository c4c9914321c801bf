"""Training sides of a repeated cross-validation from one set of statistics and one neighbour graph.

A training side is all rows minus a fold, so what it needs is a total minus the
fold's part:

* class counts and column ranges are aggregated once per (run, fold) and combined
  over the other folds;
* a minority row's place in the seeded order of a side is its place among all
  minority rows minus the held-out fold's rows before it (one ordered scan);
* the neighbours of a minority vector on a side are found in one list per vector, the
  ``LISTS`` k nearest of *all* minority vectors, by dropping vectors that only the fold
  holds and counting copies of the others.

A side's nominal penalty differs from that of all rows, by which the lists were
made, so each entry keeps its continuous distance c and its mismatches m: with
a smaller penalty q than the lists' p, a vector not listed is still at (q / p) times the
list's reach or beyond.  Entries nearer than that are the true neighbours; where
fewer than k are, the list runs dry: such vectors are asked about again with longer
lists, and beyond ``LONGEST`` entries (ties) on the side itself.
The result equals ``oversample.smote`` of each side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .folds import group_folds, seeded_hash
from .nearest import nearest
from .oversample import distinct_vectors, drawn_lists, feature_arrays, row_hash, synthetic_rows, vector_id
from .reshape import _q
from .scan import running_sums

#: Length of a vector's list as a multiple of k; a list that runs dry is made so many times longer, up to so many entries.
LISTS = 4
LONGER = 6
LONGEST = 1000


class CrossFit:
    """The sides (run, fold) of ``runs`` x ``folds``; run r deals subjects and seeds its synthetic rows by r."""

    def __init__(self, df: DataFrame, features, label_col: str, id_col: str, runs: int = 5, folds: int = 5, k: int = 5, nominal=(), oversample: bool = True):
        self.features, self.label_col, self.id_col, self.runs, self.folds, self.k = list(features), label_col, id_col, runs, folds, k
        self.nominal = [c for c in nominal if c in self.features]
        self.continuous = [f for f in self.features if f not in self.nominal]
        dealt = df.select(id_col, label_col, *[F.col(_q(f)).cast("double").alias(f) if f in self.continuous else F.col(_q(f)) for f in self.features])
        for run in range(runs):
            deal = group_folds(df, id_col, label_col, folds, run).select(id_col, F.col("fold").alias(f"_fold{run}"))
            dealt = dealt.join(deal, id_col)
        self.data = cut_lineage(dealt)  # read by every step
        self._statistics()
        self.lists, self.points, self.dry = {}, {}, 0
        if oversample:
            for label in {s["minority"] for s in self.sides.values() if s["new"]}:
                self._graph(label)

    # --- statistics ---------------------------------------------------------------------------------------------------
    def _statistics(self):
        """Counts per (run, fold, class) and ranges per (run, fold): one aggregate, a row per fold and class."""
        at = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(f"_fold{r}").alias("fold")) for r in range(self.runs)]))
        rows = self.data.select(at.alias("at"), F.col(_q(self.label_col)).alias("label"), *[F.col(_q(f)).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)])
        found = rows.groupBy("at.run", "at.fold", "label").agg(
            F.count("*").alias("n"), *[g(f"x{i}").alias(f"{k}{i}") for i in range(len(self.features)) for k, g in (("low", F.min), ("high", F.max))]).collect()
        self.ranges, self.sides = {}, {}
        for run in range(self.runs):
            for fold in range(self.folds):
                held = [r for r in found if r["run"] == run and r["fold"] != fold]
                span = {}
                for i, f in enumerate(self.features):
                    low, high = [[r[f"{k}{i}"] for r in held if r[f"{k}{i}"] is not None] for k in ("low", "high")]
                    span[f] = (min(low), max(high)) if low else (None, None)
                self.ranges[run, fold] = span
                counts = {}
                for r in held:
                    counts[r["label"]] = counts.get(r["label"], 0) + r["n"]
                side = {"new": 0, "n": sum(counts.values())}
                if len(counts) > 1:
                    minority = min(counts, key=lambda c: (counts[c], c))
                    k = min(self.k, counts[minority] - 1)
                    if k > 0:
                        side |= {"minority": minority, "least": counts[minority], "new": max(counts.values()) - counts[minority], "k": k}
                self.sides[run, fold] = side

    def step(self, run: int, fold: int) -> int:
        return run * self.folds + fold

    def _penalties(self, rows: DataFrame) -> tuple[float, dict]:
        """Squared median of the standard deviations, of all rows and of each side, from sums per (run, fold)."""
        if not self.nominal:
            return 0.0, {}
        at = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col("_folds")[r].alias("fold")) for r in range(self.runs)]))
        parts = rows.select(at.alias("at"), F.posexplode("_v")).groupBy("at.run", "at.fold", "pos").agg(
            F.count("col").alias("n"), F.avg("col").alias("mean"), F.var_pop("col").alias("var")).toPandas()

        def penalty(held: pd.DataFrame) -> float:
            sds = []
            for _, g in held.groupby("pos"):
                n, mean = g["n"].sum(), np.average(g["mean"], weights=g["n"])
                spread = (g["n"] * (g["var"] + (g["mean"] - mean) ** 2)).sum()
                sds.append(np.sqrt(spread / (n - 1)) if n > 1 else 0.0)
            return float(np.median(sds)) ** 2 if sds else 1.0

        return penalty(parts[parts["run"] == 0]), {(r, f): penalty(parts[(parts["run"] == r) & (parts["fold"] != f)]) for r, f in self.sides}

    # --- neighbours ---------------------------------------------------------------------------------------------------
    def _graph(self, label):
        """Per distinct minority vector what synthetic rows take of its neighbours on each side: (_vid, steps, _nb, _mode), one row per different list."""
        rows = cut_lineage(feature_arrays(self.data.where(F.col(_q(self.label_col)) == label), self.id_col, self.continuous, self.nominal,
                                          F.array(*[f"_fold{r}" for r in range(self.runs)]).alias("_folds")).withColumn("_vid", vector_id()))
        base, penalties = self._penalties(rows)
        counts = F.array(*[F.sum((F.col("_folds")[r] == f).cast("int")).cast("int") for r in range(self.runs) for f in range(self.folds)])
        points = cut_lineage(distinct_vectors(rows, counts.alias("_held")))
        steps = [(self.step(r, f), s["k"], penalties.get((r, f), 0.0)) for (r, f), s in self.sides.items() if s["new"] and s["minority"] == label]
        other = points.select(F.col("_vid").alias("nb"), F.struct("_v", "_nv", "_m", "_held").alias("_x"))
        length, total, asked, ready = LISTS * self.k, points.count(), None, None
        while True:
            near = nearest(points, length, base, only=asked)
            listed = near.join(other, "nb").groupBy("_vid").agg(F.sort_array(F.collect_list(F.struct("dist2", "nb", "_x"))).alias("_l"))
            own = points if asked is None else points.join(asked, "_vid", "left_semi")
            chosen = cut_lineage(own.join(listed, "_vid", "left").mapInPandas(_choose(steps, base, total), "_vid string, steps array<int>, _ids array<string>"))
            # a vector whose list is too short for one side is asked about again with a longer list
            left = cut_lineage(chosen.where("_ids is null").select("_vid").distinct())
            n = left.count()
            last = not n or length * LONGER > LONGEST
            kept = chosen.where("_ids is not null") if last else chosen.join(left, "_vid", "left_anti")
            ready = kept if ready is None else ready.unionByName(kept)
            if last:
                break
            self.dry, length, asked = self.dry + n, length * LONGER, left
        dry = chosen.where("_ids is null").select("_vid", F.explode("steps").alias("step"))
        for step in sorted(r["step"] for r in dry.select("step").distinct().collect()) if n else []:  # lists full of ties: searched on the side itself
            run, fold = divmod(step, self.folds)
            side = points.where(F.col("_m") > F.col("_held")[step])
            own = nearest(cut_lineage(side), self.sides[run, fold]["k"], penalties.get((run, fold), 0.0), only=dry.where(F.col("step") == step).select("_vid"))
            ready = ready.unionByName(cut_lineage(self._searched(own, points, step, self.sides[run, fold]["k"], dry)))
        copies = ready.select("_vid", "steps", F.posexplode("_ids").alias("at", "nb"))
        full = points.select(F.col("_vid").alias("nb"), F.struct("_v", "_nv").alias("_x"))
        lists = copies.join(full, "nb").groupBy("_vid", "steps").agg(F.sort_array(F.collect_list(F.struct("at", "_x"))).alias("_l"))
        self.lists[label] = cut_lineage(drawn_lists(lists.select("_vid", "steps", F.transform("_l", lambda e: e["_x"]).alias("_nb")), self.nominal))
        self.points[label] = rows

    @staticmethod
    def _searched(own: DataFrame, points: DataFrame, step: int, k: int, dry: DataFrame) -> DataFrame:
        """Lists of the vectors searched again on one side, copies counted."""
        left = (F.col("_m") - F.col("_held")[step]).alias("_n")
        near = own.join(points.select(F.col("_vid").alias("nb"), left), "nb").groupBy("_vid").agg(F.sort_array(F.collect_list(F.struct("dist2", "nb", "_n"))).alias("_l"))
        asked = dry.where(F.col("step") == step).select("_vid").join(points.select("_vid", left), "_vid").join(near, "_vid", "left")
        mine = F.array_repeat("_vid", F.least(F.col("_n") - 1, F.lit(k)).cast("int"))
        others = F.flatten(F.transform(F.coalesce("_l", F.array().cast("array<struct<dist2:double,nb:string,_n:bigint>>")),
                                       lambda x: F.array_repeat(x["nb"], F.least(x["_n"], F.lit(k)).cast("int"))))
        return asked.select("_vid", F.array(F.lit(step)).alias("steps"), F.slice(F.concat(mine, others), 1, k).alias("_ids"))

    # --- synthetic rows -----------------------------------------------------------------------------------------------
    def synthetic(self, run: int) -> DataFrame | None:
        """The synthetic rows of the run's sides: the columns of the data, and ``_side``, the fold held out."""
        out = None
        for label in self.lists:
            sides = [(f, s["k"], s["new"] // s["least"], s["new"] % s["least"]) for (r, f), s in self.sides.items() if r == run and s["new"] and s["minority"] == label]
            if not sides:
                continue
            rows = self.points[label].withColumn("_f", F.col("_folds")[run]).withColumn("_h", row_hash(run))
            held = [f"_is{f}" for f in range(self.folds)]
            rows = rows.withColumns({h: (F.col("_f") == f).cast("int") for f, h in enumerate(held)}).withColumn("_ord", F.struct("_h", "_id", "_v", "_nv"))
            rows = running_sums(rows, [], "_ord", F.floor(F.col("_h") / F.lit(2 ** 22)).cast("int"), held, descending=False, index_col="_at")
            before = F.array(*[f"cum_{h}" for h in held])
            side = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(k).alias("k"), F.lit(q).alias("q"), F.lit(m).alias("m")) for f, k, q, m in sides]))
            rows = rows.withColumn("_s", side).where("_s.f <> _f").withColumn("_pid", F.col("_at") - F.get(before, F.col("_s.f")))
            reps = F.col("_s.q") + F.when(F.col("_pid") <= F.col("_s.m"), 1).otherwise(0)
            rows = rows.withColumn("_j", F.explode(F.when(reps > 0, F.sequence(F.lit(1), reps)).otherwise(F.array().cast("array<int>"))))
            rows = rows.withColumns({"_pick": (seeded_hash(run, "_pid", "_j") % F.col("_s.k")).cast("int"), "_gap": seeded_hash(run + 1, "_pid", "_j") / F.lit(float(2 ** 32))})
            step = F.lit(run * self.folds) + F.col("_s.f")
            lists = self.lists[label].select("_vid", F.explode("steps").alias("_step"), "_nb", "_mode").where(F.col("_step").between(run * self.folds, run * self.folds + self.folds - 1))
            base = rows.select("_id", "_v", "_pick", "_gap", F.col("_s.f").alias("_side"), "_vid", step.alias("_step")).join(lists, ["_vid", "_step"])
            base = base.withColumn("_to", F.get("_nb", F.col("_pick") % F.size("_nb")))
            names = [(c, t) for c, t in self.data.dtypes if not c.startswith("_fold")] + [("_side", "int")]
            types = dict(names)
            part = synthetic_rows(base, names, self.continuous, self.nominal,
                                  {self.id_col: F.col("_id"), self.label_col: F.lit(label).cast(types[self.label_col]), "_side": F.col("_side")})
            out = part if out is None else out.unionByName(part)
        return out

    def side(self, run: int, fold: int, synthetic: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(training rows with the synthetic ones, test rows)"""
        columns = [c for c in self.data.columns if not c.startswith("_fold")]
        train, test = self.data.where(F.col(f"_fold{run}") != fold), self.data.where(F.col(f"_fold{run}") == fold)
        train = train.select(*[_q(c) for c in columns])
        if synthetic is not None:
            train = train.unionByName(synthetic.where(F.col("_side") == fold).select(*[_q(c) for c in columns]))
        return train, test.select(*[_q(c) for c in columns])


def _choose(steps: list, base: float, total: int):
    """Per vector and side the ids of its k nearest rows, in rows of equal lists; null where the list runs dry."""
    def run(parts):
        for pdf in parts:
            out = []
            for vid, v, nv, copies, held, entries in zip(pdf["_vid"], pdf["_v"], pdf["_nv"], pdf["_m"], pdf["_held"], pdf["_l"]):
                entries = list(entries) if entries is not None else []
                ids = [e["nb"] for e in entries]
                found = [e["_x"] for e in entries]
                c, m = np.zeros(len(ids)), np.zeros(len(ids))
                for j in range(len(v)):
                    c += (np.array([x["_v"][j] for x in found], float) - v[j]) ** 2
                for j in range(len(nv)):
                    m += np.array([x["_nv"][j] != nv[j] for x in found], float)
                all_held = len(ids) >= total - 1
                reach = np.inf if all_held else entries[-1]["dist2"]
                groups: dict = {}
                for step, k, penalty in steps:
                    if copies <= held[step]:
                        continue  # not on this side
                    d2 = c + penalty * m
                    safe = reach if penalty >= base else reach * (penalty / base)
                    got = [vid] * min(int(copies - held[step]) - 1, k)
                    for i in sorted(range(len(ids)), key=lambda i: (d2[i], ids[i])):
                        if len(got) >= k or not d2[i] < safe * (1 - 1e-12):
                            break
                        got += [ids[i]] * min(int(found[i]["_m"] - found[i]["_held"][step]), k - len(got))
                    groups.setdefault(tuple(got) if len(got) >= k or all_held else None, []).append(step)
                out += [(vid, s, None if g is None else list(g)) for g, s in groups.items()]
            yield pd.DataFrame(out, columns=["_vid", "steps", "_ids"])
    return run
