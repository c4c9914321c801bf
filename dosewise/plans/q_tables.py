"""Reshape, cleaning, encoding, lag and column-statistics queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators.adherence import cohort_split, whole_study_adherence
from ..operators.collinearity import correlated_to_drop, histogram, mean_days_between, pearson, row_stats, vif
from ..operators.encoding import one_hot
from ..operators.reshape import wide_to_long
from ..session import ensure_checkpoint_dir
from ..sources.export import read_wide_csv, write_wide_csv
from ..sources.events import EXPORT_DATE_RE, EXPORT_SLOT_RE, daily_use, dose_events, wide_export
from . import oracle as O
from .featuresets import featureset, lagged_featureset
from .q_cohort import _period_sql
from .registry import SPEC, events, portable, r6, register, table


def _dq(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


# ---------------------------------------------------------------- step 2: reshape
@register("wide_to_long", O.with_cohort("""
SELECT user_id, strftime(enroll, '%Y-%m-%d') AS enroll, strftime(date, '%Y-%m-%d') AS date, day_idx, slot,
       strftime(datetime, '%H:%M:%S') AS time, datetime, numtimes, CAST(interval_s AS DOUBLE) AS interval_s,
       withinrange
FROM dose"""))
def q_wide_to_long(spark, sf_dir):
    ev = events(spark, sf_dir)
    wide = wide_export(ev, SPEC)
    long = wide_to_long(wide, "PtID", "DateEnroll", EXPORT_DATE_RE, EXPORT_SLOT_RE, date_fmt="M/d/yyyy")
    return portable(long.withColumnRenamed("PtID", "user_id"), doubles=("interval_s",), dates=("enroll", "date"))


@register("wide_csv", O.with_cohort("""
SELECT user_id, strftime(enroll, '%Y-%m-%d') AS enroll, strftime(date, '%Y-%m-%d') AS date, day_idx, slot,
       strftime(datetime, '%H:%M:%S') AS time, datetime, numtimes, CAST(interval_s AS DOUBLE) AS interval_s,
       withinrange, CAST(2 AS BIGINT) AS n_quarantined
FROM dose"""))
def q_wide_csv(spark, sf_dir):
    """The wide export written as CSV files, with a file of ragged rows among them, read back and unpivoted."""
    wide = wide_export(events(spark, sf_dir), SPEC)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wide-csv-{sf_dir.rstrip('/').split('/')[-1]}"
    write_wide_csv(wide, f"{base}/whole")
    header = ",".join(wide.columns)
    ragged = [header, "9999999,1/1/2020,too,few", ",".join(["8888888"] + ["1"] * len(wide.columns))]
    spark.createDataFrame([(x,) for x in ["\n".join(ragged)]], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/ragged")
    rows, quarantine = read_wide_csv(spark, f"{base}/whole", f"{base}/ragged")
    long = wide_to_long(rows, "PtID", "DateEnroll", EXPORT_DATE_RE, EXPORT_SLOT_RE, date_fmt="M/d/yyyy")
    long = long.select(F.col("PtID").cast(dict(wide.dtypes)["PtID"]).alias("user_id"), *[c for c in long.columns if c != "PtID"])
    counted = quarantine.agg(F.count("*").alias("n")).scalar()
    return portable(long, doubles=("interval_s",), dates=("enroll", "date")).withColumn("n_quarantined", counted)


_DROP_SQL = """
rk AS (
  SELECT user_id, date, strftime(date_trunc('second', ts), '%H:%M:%S') AS t,
         row_number() OVER (PARTITION BY user_id, date ORDER BY ts, event_id) AS slot FROM ev
),
st AS (
  SELECT CAST(date_diff('day', b.min_d, rk.date) + 1 AS INTEGER) AS day_idx, slot, COUNT(*) AS c,
         MIN(t) AS mn, MAX(t) AS mx
  FROM rk CROSS JOIN bnd b GROUP BY 1, 2
),
dgrid AS (SELECT unnest(generate_series(1, date_diff('day', min_d, max_d) + 1)) AS day_idx FROM bnd),
grid AS (SELECT day_idx, unnest(generate_series(1, (SELECT k FROM cap))) AS slot FROM dgrid)"""


@register("drop_constant_columns", O.with_cohort("""
SELECT 'MEMS_date' || lpad(CAST(g.day_idx AS VARCHAR), 3, '0') || '_time' || CAST(g.slot - 1 AS VARCHAR) AS col_name,
       CASE WHEN st.c IS NULL THEN 'empty' ELSE 'constant' END AS reason
FROM grid g LEFT JOIN st ON st.day_idx = g.day_idx AND st.slot = g.slot
WHERE st.c IS NULL OR st.mn = st.mx""", _DROP_SQL))
def q_drop_constant(spark, sf_dir):
    """Slot columns of the wide export that the empty/constant-column rule removes."""
    ev = events(spark, sf_dir)
    wide = wide_export(ev, SPEC)
    time_cols = [c for c in wide.columns if re.search(r"_time\d+$", c)]
    empty, const = C.empty_and_constant_columns(wide.select(*time_cols))
    rows = [(c, "empty") for c in empty] + [(c, "constant") for c in const]
    return spark.createDataFrame(rows, "col_name string, reason string")


# ---------------------------------------------------------------- step 4: cleaning
@register("clean_recode", """
SELECT c.c_custkey AS PtID, n.n_name AS nation, c.c_acctbal AS balance, c.c_mktsegment AS segment
FROM customer c LEFT JOIN nation n ON CAST(n.n_nationkey AS DOUBLE) = CAST(c.c_nationkey AS DOUBLE)""")
def q_clean_recode(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    df = C.rename(df, {"c_custkey": "PtID", "c_acctbal": "balance", "c_nationkey": "nation",
                       "c_mktsegment": "segment"})
    df = C.drop_columns(df, cols=["c_name"], contains=["_Name"])
    df = C.blank_to_null(df)
    df = C.drop_empty_and_constant(df, protect=["PtID"])
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return C.map_codes(df, "nation", nation)


_BIN_SRC = "CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END"


@register("binarize", f"""
SELECT c_custkey AS PtID,
  CASE WHEN ({_BIN_SRC}) IS NULL OR TRY_CAST(({_BIN_SRC}) AS DOUBLE) IS NOT NULL THEN ({_BIN_SRC}) ELSE '1' END
  AS code_or_text
FROM customer""")
def q_binarize(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("PtID"),
        F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise(F.col("c_nationkey").cast("string"))
        .alias("code_or_text"))
    return C.binarize(df, "code_or_text")


@register("reverse_onehot", "SELECT c_custkey AS PtID, c_mktsegment AS seg FROM customer")
def q_reverse_onehot(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("PtID"),
                                                 F.col("c_mktsegment").alias("seg_"))
    wide, _ = one_hot(df, ["seg_"])  # seg__<level> indicators, levels from the data
    return C.reverse_onehot(wide.withColumnsRenamed({c: "seg_" + c[5:] for c in wide.columns if c.startswith("seg__")}),
                            "seg_")


@register("bulk_lookup", """
SELECT c.c_custkey AS user_id, f.event_type
FROM customer c LEFT JOIN (
  SELECT user_id, event_type FROM (
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) x
  WHERE rn = 1) f ON f.user_id = c.c_custkey""")
def q_bulk_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return C.lookup_first(events(spark, sf_dir), keys, "user_id", "event_type", F.struct("ts", "event_id"))


@register("mean_days_between", O.with_cohort("""
SELECT user_id, ROUND(AVG(gap), 6) AS mean_days_between FROM (
  SELECT user_id, date_diff('day', LAG(date) OVER (PARTITION BY user_id ORDER BY date), date) AS gap FROM used) g
GROUP BY user_id"""))
def q_mean_days_between(spark, sf_dir):
    used = daily_use(events(spark, sf_dir), SPEC).where(F.col("numtimes") > 0)
    out = mean_days_between(used, ["user_id"], "date")
    return out.withColumn("mean_days_between", r6("mean_days_between"))


_ROW_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_ROW_MEAN = "(" + " + ".join(_ROW_COLS) + f") / {len(_ROW_COLS)}"


@register("row_stats", f"""
SELECT l_orderkey, l_linenumber, ROUND({_ROW_MEAN}, 6) AS row_mean,
  ROUND(sqrt(({' + '.join(f'({c} - {_ROW_MEAN}) * ({c} - {_ROW_MEAN})' for c in _ROW_COLS)}) / {len(_ROW_COLS) - 1}), 6)
  AS row_std
FROM lineitem""")
def q_row_stats(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_ROW_COLS)
    out = row_stats(df, _ROW_COLS, "row_")
    return out.select("l_orderkey", "l_linenumber", r6("row_mean").alias("row_mean"), r6("row_std").alias("row_std"))


# ---------------------------------------------------------------- step 5: encoding, lags, cohorts
_wk_ctes, _ = _period_sql("study_week", 7)
_LEVELS_TOD = SPEC.tod.labels
_WF_SQL = _wk_ctes + """,
wf AS (
  SELECT pf.user_id, pf.study_week, n_events, event_time_mean, event_time_std, between_event_time_mean,
         between_event_time_std, num_daily_events_mean, adherence_rate,
         CAST(adherence_rate > 0.8 AS INTEGER) AS adherent, md.mode_idx
  FROM pf LEFT JOIN md ON md.user_id = pf.user_id AND md.study_week = pf.study_week
)"""
_MODE_DUMMIES = ", ".join(f"CASE WHEN mode_idx = {i} THEN 1 ELSE 0 END AS event_time_of_day_mode_{lab}"
                          for i, lab in enumerate(_LEVELS_TOD))


@register("one_hot", O.with_cohort(f"SELECT user_id, study_week, {_MODE_DUMMIES} FROM wf", _WF_SQL))
def q_one_hot(spark, sf_dir):
    fs = featureset(events(spark, sf_dir), "study_week", SPEC, analyst_drops=False)
    out, new = one_hot(fs.df, ["event_time_of_day_mode"], {"event_time_of_day_mode": list(_LEVELS_TOD)})
    return out.select("user_id", "study_week", *new)


def _lag_sql(src: str, base, id_col: str, time_col: str, target: str, n: int) -> str:
    lags = [(f"{c} (t-{i})", f"LAG({_dq(c)}, {i}) OVER w") for i in range(n, 0, -1) for c in base]
    keep = [(name, e) for name, e in lags if time_col not in name]
    sel = ", ".join(f"{e} AS {_dq(name)}" for name, e in lags)
    cond = " AND ".join(f"{_dq(name)} IS NOT NULL" for name, _ in lags)
    outer = ", ".join(_dq(name) for name, _ in keep)
    return (f"SELECT {id_col}, {outer}, {target} FROM (SELECT {id_col}, {sel}, {target} FROM {src} "
            f"WINDOW w AS (PARTITION BY {id_col} ORDER BY {time_col})) x WHERE {cond}")


_WEEK_BASE = ["study_week", "event_time_mean", "event_time_std", "between_event_time_std", "adherent"] + \
    [f"event_time_of_day_mode_{lab}" for lab in _LEVELS_TOD]


@register("lagged_features_week", O.with_cohort(
    _lag_sql("wfo", _WEEK_BASE, "user_id", "study_week", "adherent", 3),
    _WF_SQL + f",\nwfo AS (SELECT *, {_MODE_DUMMIES} FROM wf)"))
def q_lagged_week(spark, sf_dir):
    return lagged_featureset(events(spark, sf_dir), "study_week", 3, SPEC).df


_DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
_DAY_BASE = ["study_day", "is_weekday"] + [f"time_of_day_{lab}" for lab in _LEVELS_TOD] + ["adherent"] + \
    [f"day_of_week_{d}" for d in _DAY_NAMES]
_DF_SQL = """
dfs AS (
  SELECT user_id, study_day, arg_min(is_weekday, slot) AS is_weekday, arg_min(day_of_week, slot) AS day_of_week,
         {flags}, CAST(MAX(withinrange) > 0.8 AS INTEGER) AS adherent
  FROM ded GROUP BY user_id, study_day
),
dfo AS (SELECT *, {dows} FROM dfs)""".format(
    flags=", ".join(f"MAX(CASE WHEN time_of_day_idx = {i} THEN 1 ELSE 0 END) AS time_of_day_{lab}"
                    for i, lab in enumerate(_LEVELS_TOD)),
    dows=", ".join(f"CASE WHEN day_of_week = '{d}' THEN 1 ELSE 0 END AS day_of_week_{d}" for d in _DAY_NAMES))


@register("lagged_features_day", O.with_cohort(
    _lag_sql("dfo", _DAY_BASE, "user_id", "study_day", "adherent", 3), _DF_SQL))
def q_lagged_day(spark, sf_dir):
    return lagged_featureset(events(spark, sf_dir), "study_day", 3, SPEC).df


@register("cohort_split", O.with_cohort("""
SELECT user_id, CAST(AVG(withinrange) >= 0.8 AS INTEGER) AS adherent,
       CAST(user_id IN (SELECT user_id FROM events WHERE event_type = 'signup') AS INTEGER) AS in_cohort
FROM dose GROUP BY user_id"""))
def q_cohort_split(spark, sf_dir):
    ev = events(spark, sf_dir)
    adh = whole_study_adherence(dose_events(ev, SPEC)).select("user_id", "adherent")
    inside, outside = cohort_split(adh, ev.where(F.col("event_type") == "signup"))
    return inside.withColumn("in_cohort", F.lit(1)).unionByName(outside.withColumn("in_cohort", F.lit(0)))


# ---------------------------------------------------------------- step 6: column statistics
_WK_NUM = ["user_id", "study_week", "n_events", "event_time_mean", "event_time_std", "between_event_time_mean",
           "between_event_time_std", "num_daily_events_mean", "adherence_rate"]


def _weekly_raw(spark, sf_dir):
    from ..operators.horizons import period_features
    from .cohort import analysis_events
    return period_features(analysis_events(events(spark, sf_dir), SPEC), "study_week")


def _pearson_sql(cols) -> str:
    parts = []
    for a in cols:
        for b in cols:
            f = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
            parts.append(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(covar_samp({a}, {b}) {f} / "
                f"NULLIF(stddev_samp({a}) {f} * stddev_samp({b}) {f}, 0), 6) + 0.0 AS r FROM wf")
    return "\nUNION ALL\n".join(parts)


@register("pearson_matrix", O.with_cohort(_pearson_sql(_WK_NUM), _WF_SQL))
def q_pearson(spark, sf_dir):
    out = pearson(_weekly_raw(spark, sf_dir), _WK_NUM)
    return out.withColumn("r", r6("r"))


_VIF_PAIR = ("event_time_mean", "between_event_time_std")


@register("vif", O.with_cohort("""
SELECT 'event_time_mean' AS feature, ROUND(1 / (1 - s_ab * s_ab / (s_aa * s_bb)), 6) AS vif FROM v
UNION ALL
SELECT 'between_event_time_std', ROUND(1 / (1 - s_ab * s_ab / (s_aa * s_bb)), 6) FROM v""",
                              _WF_SQL + """,
v AS (SELECT SUM(CAST(event_time_mean AS DOUBLE) * between_event_time_std) AS s_ab,
             SUM(CAST(event_time_mean AS DOUBLE) * event_time_mean) AS s_aa,
             SUM(CAST(between_event_time_std AS DOUBLE) * between_event_time_std) AS s_bb FROM wf)"""))
def q_vif(spark, sf_dir):
    return vif(_weekly_raw(spark, sf_dir), _VIF_PAIR).withColumn("vif", r6("vif"))


@register("correlated_columns", O.with_cohort("SELECT DISTINCT col_b AS column_name FROM (" + _pearson_sql(_WK_NUM) + ") p WHERE r > 0.85 AND list_position(["
                                               + ", ".join(f"'{c}'" for c in _WK_NUM) + "], col_a) < list_position([" + ", ".join(f"'{c}'" for c in _WK_NUM) + "], col_b)", _WF_SQL))
def q_correlated(spark, sf_dir):
    """Weekly columns that the collinearity rule drops (later column of each pair above 0.85)."""
    return spark.createDataFrame([(c,) for c in correlated_to_drop(_weekly_raw(spark, sf_dir), _WK_NUM)], "column_name string")


_VIF_THREE = ("event_time_mean", "event_time_std", "between_event_time_std")


@register("vif_three", O.with_cohort("""
SELECT 'event_time_mean' AS feature, ROUND(aa * (bb * cc - bc * bc) / det, 6) AS vif FROM vd
UNION ALL SELECT 'event_time_std', ROUND(bb * (aa * cc - ac * ac) / det, 6) FROM vd
UNION ALL SELECT 'between_event_time_std', ROUND(cc * (aa * bb - ab * ab) / det, 6) FROM vd""", _WF_SQL + """,
vv AS (SELECT CAST(event_time_mean AS DOUBLE) AS a, CAST(event_time_std AS DOUBLE) AS b, CAST(between_event_time_std AS DOUBLE) AS c FROM wf
      WHERE event_time_mean IS NOT NULL AND event_time_std IS NOT NULL AND between_event_time_std IS NOT NULL),
vg AS (SELECT SUM(a * a) AS aa, SUM(a * b) AS ab, SUM(a * c) AS ac, SUM(b * b) AS bb, SUM(b * c) AS bc, SUM(c * c) AS cc FROM vv),
vd AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM vg)"""))
def q_vif_three(spark, sf_dir):
    """VIF of three weekly columns (the diagonal of the Gram matrix times that of its inverse)."""
    return vif(_weekly_raw(spark, sf_dir), _VIF_THREE).withColumn("vif", r6("vif"))


@register("vif_weekly")
def q_vif_weekly(spark, sf_dir):
    """VIF of the weekly features kept after the analyst's review (no SQL matrix inverse)."""
    return vif(_weekly_raw(spark, sf_dir), ["study_week", "event_time_mean", "event_time_std",
                                            "between_event_time_std"])


_HIST_COLS = _WK_NUM[1:]


@register("histogram", O.with_cohort("""
SELECT g.feature, g.bin, ROUND(g.lo + g.bin * ((g.hi - g.lo) / 10.0), 6) AS bin_lo,
       ROUND(g.lo + (g.bin + 1) * ((g.hi - g.lo) / 10.0), 6) AS bin_hi, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
FROM (SELECT feature, lo, hi, CAST(unnest(generate_series(0, 9)) AS INTEGER) AS bin FROM rng) g
LEFT JOIN (
  SELECT u.feature, CAST(LEAST(floor((v - lo) * (10.0 / (hi - lo))), 9) AS INTEGER) AS bin, COUNT(*) AS n
  FROM u JOIN rng ON rng.feature = u.feature GROUP BY 1, 2) c
ON c.feature = g.feature AND c.bin = g.bin""", _WF_SQL + """,
wd AS (SELECT {cols} FROM wf),
u AS (UNPIVOT wd ON {names} INTO NAME feature VALUE v),
rng AS (
  SELECT feature, CASE WHEN MIN(v) = MAX(v) THEN MIN(v) - 0.5 ELSE MIN(v) END AS lo,
         CASE WHEN MIN(v) = MAX(v) THEN MAX(v) + 0.5 ELSE MAX(v) END AS hi
  FROM u GROUP BY feature
)""".format(cols=", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _HIST_COLS), names=", ".join(_HIST_COLS))))
def q_histogram(spark, sf_dir):
    out = histogram(_weekly_raw(spark, sf_dir), _HIST_COLS, 10)
    return out.withColumnRenamed("column", "feature").withColumns(
        {"bin_lo": r6("bin_lo"), "bin_hi": r6("bin_hi")})
