"""Result tables: persist, read back, summarise, rank and label.

Configuration (feature set, method, lags, depth, tuned, final) is carried as
columns and partition keys instead of being encoded in file names; a
``run_name`` expression reproduces the conventional name when one is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "sensitivity", "specificity", "f1_score")
CONFIG = ("featureset", "method", "features_selected", "tuned", "type")
#: Columns that name a run's configuration; results are laid out by those they have.
CONFIG_TYPES = {"featureset": "string", "method": "string", "features_selected": "boolean", "tuned": "boolean", "n_lags": "int", "max_depth": "int", "final": "boolean"}


def run_name(featureset="featureset", method="method", n_lags="n_lags", max_depth="max_depth", tuned="tuned",
             final="final") -> Column:
    """``{fs}_{method}_{n}_lags[_max_depth_{d}][_tuned][_final_clf]``."""
    c = [F.col(x) if isinstance(x, str) else x for x in (featureset, method, n_lags, max_depth, tuned, final)]
    return F.concat(c[0], F.lit("_"), c[1], F.lit("_"), c[2].cast("string"), F.lit("_lags"),
                    F.when(c[3].isNotNull(), F.concat(F.lit("_max_depth_"), c[3].cast("string"))).otherwise(F.lit("")),
                    F.when(c[4], F.lit("_tuned")).otherwise(F.lit("")),
                    F.when(c[5], F.lit("_final_clf")).otherwise(F.lit("")))


def _config_of(df: DataFrame) -> list[str]:
    return [c for c in CONFIG_TYPES if c in df.columns]


def write_results(df: DataFrame, path: str, kind: str, partition_by=None, csv: bool = False) -> None:
    """Write a result table (pred / roc / auc / attr) under ``path/kind`` as Parquet (and CSV under ``path/kind_csv``).

    Rows are laid out by *all* configuration columns they have.  Only the configurations
    written are replaced; Spark writes them to a staging folder and moves them at the
    job's commit, so a run that fails leaves the earlier results as they were.
    """
    by = _config_of(df) if partition_by is None else list(partition_by)
    writer = df.repartition(*by).write if by else df.write  # one file per configuration and task
    writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.parquet(f"{path}/{kind}")
    if csv:
        writer.option("header", True).csv(f"{path}/{kind}_csv")


def read_results(spark: SparkSession, path: str, kind: str, final: bool | None = None, csv: bool = False) -> DataFrame:
    """Read result files back, configuration columns in their own types; ``final`` routes on the ``final`` column (True, False or both)."""
    if csv:  # values stay text; a file whose header differs from the others' is an error, not a shift of columns
        df = spark.read.option("header", True).option("enforceSchema", False).csv(f"{path}/{kind}_csv")
    else:
        df = spark.read.option("mergeSchema", True).parquet(f"{path}/{kind}")
    df = df.drop("Unnamed: 0") if "Unnamed: 0" in df.columns else df
    df = df.withColumns({c: F.col(c).cast(CONFIG_TYPES[c]) for c in _config_of(df)})  # folder names hold text
    if final is not None and "final" in df.columns:
        df = df.where(F.col("final") == F.lit(final))
    return df


def tags_from_file_name(col: str = "file_stem") -> dict:
    """method = 3rd ``_`` token, featureset = first two tokens joined by ``_``."""
    parts = F.split(F.col(col), "_")
    return {"method": parts.getItem(2), "featureset": F.concat_ws("_", F.slice(parts, 1, 2))}


def read_csv_glob(spark: SparkSession, pattern: str, final: bool | None = None) -> DataFrame:
    """Stack every CSV matching ``pattern`` by column name, with its stem as ``file_stem``.

    Files with the same header are read together (Spark binds CSV columns by
    position); the groups are united by name, with NULL where a file has no such
    column.  ``final`` routes on the stem.  The stem of a part file is its folder's.
    """
    path = F.col("_metadata.file_path")
    heads = spark.read.text(pattern, lineSep="\n").select(path.alias("path"), "value", F.col("_metadata.file_block_start").alias("start"))
    # one row per result file: its first line
    heads = heads.where("start = 0").groupBy("path").agg(F.first("value").alias("head")).collect()
    groups: dict[str, list[str]] = {}
    for r in sorted(heads, key=lambda r: r["path"]):
        groups.setdefault(r["head"].rstrip("\r"), []).append(r["path"])
    name = F.element_at(F.split(path, "/"), -1)
    name = F.when(name.startswith("part-"), F.element_at(F.split(path, "/"), -2)).otherwise(name)
    out = None
    for paths in groups.values():
        df = spark.read.option("header", True).csv(paths).withColumn("file_stem", F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1))
        df = df.drop("Unnamed: 0", "_c0")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(pattern)
    return out if final is None else out.where(F.col("file_stem").contains("final") == F.lit(final))


def pretty_columns(df: DataFrame) -> DataFrame:
    """Column names for display: first letter upper-case, underscores as spaces."""
    return df.toDF(*[(c[:1].upper() + c[1:]).replace("_", " ") for c in df.columns])


def summarize(pred: DataFrame, auc: DataFrame | None = None, by=CONFIG, metrics=METRICS) -> DataFrame:
    """mean / std / var per configuration for every metric (x100 except f1) in ONE aggregate,
    full-outer-joined with the AUC table on the configuration, gaps filled with -1."""
    aggs = []
    for m in metrics:
        v = F.col(m) * 100 if m != "f1_score" else F.col(m)
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_std"), F.var_samp(v).alias(f"{m}_var")]
    out = pred.groupBy(*by).agg(*aggs)
    if auc is not None:
        out = out.join(auc.select(*by, "auc_mean", "auc_std"), list(by), "full")
    return out.fillna(-1)


def condense(summary: DataFrame, by=CONFIG, metrics=METRICS + ("auc",)) -> DataFrame:
    """``mean ± std`` text per metric."""
    return summary.select(*by, *[F.format_string("%.3f $\\pm$ %.3f", F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m)
                                 for m in metrics])


def rank_final(pred_final: DataFrame, by_col: str = "specificity") -> DataFrame:
    """Test rows ordered by feature set, then the metric descending."""
    return pred_final.where(F.col("type") == "test").orderBy(F.col("featureset").asc(), F.col(by_col).desc())


def with_final_auc(pred_final: DataFrame, roc_final: DataFrame) -> DataFrame:
    """Attach each final model's AUC (left join, one row per method and feature set)."""
    a = roc_final.groupBy("method", "featureset").agg(F.max("auc").alias("auc"))
    return pred_final.join(a, ["method", "featureset"], "left")


def legend_label(method="method", auc="auc") -> Column:
    return F.format_string("%s (AUC = %.3f)", F.col(method), F.col(auc))


def featureset_title(fs="featureset") -> Column:
    c = F.col(fs)
    horizon = F.when(c.contains("day"), "Day").when(c.contains("week"), "Week").when(c.contains("month"), "Month") \
        .otherwise("")
    kind = F.when(c.contains("all_scores"), "Full").otherwise("MEMS-Only")
    return F.concat(F.lit("Next-"), horizon, F.lit(" Prediction w/"), kind, F.lit(" Feature Set"))


def prettify(name) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.concat(F.upper(F.substring(c, 1, 1)), F.regexp_replace(F.substring(c, 2, 1 << 20), "_", " "))


def to_numeric(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})


def lag_tuning_curve(pred: DataFrame) -> DataFrame:
    """Specificity by (max_depth, n_lags, featureset, type): mean, std, count."""
    return pred.groupBy("max_depth", "n_lags", "featureset", "type").agg(
        F.avg("specificity").alias("specificity_mean"), F.stddev_samp("specificity").alias("specificity_std"),
        F.count(F.lit(1)).alias("n"))


def top_features(attr: DataFrame, by=(), n: int = 20) -> DataFrame:
    """Features ranked by mean |attribution| (the top ``n`` per group)."""
    from pyspark.sql import Window
    m = attr.groupBy(*by, "feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    if not by:
        return m.orderBy(F.col("mean_abs_shap").desc(), "feature").limit(n)
    w = Window.partitionBy(*by).orderBy(F.col("mean_abs_shap").desc(), "feature")
    return m.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
