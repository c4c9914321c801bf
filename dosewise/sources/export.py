"""Wide monitor exports as CSV files, with the rows that don't fit kept apart.

Columns are bound to names by the header and stay text (the parsers of the
following steps decide what a value is).  A file whose header differs from the
others' is an error.  A row with fewer or more values than the header names is
none that can be trusted: it goes to a quarantine table as the line it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RAW = "_corrupt_record"


def write_wide_csv(wide: DataFrame, path: str) -> None:
    """A wide table as CSV files with a header each; a null is an empty value."""
    wide.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_wide_csv(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of the files: all header columns as text; and (file, line) of the ragged rows."""
    names = spark.read.option("header", True).csv(list(paths)).columns
    schema = StructType([StructField(c, StringType()) for c in [*names, RAW]])
    # without column pruning, or a row would count as whole as far as it is read
    every = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", RAW).option("columnPruning", False).csv(list(paths))
    # always true: Spark refuses a query of the raw-line column alone
    read = F.length(F.concat_ws("", F.col(f"`{names[0]}`"))) >= 0
    rows = every.where(F.col(RAW).isNull() & read).drop(RAW)
    bad = every.where(F.col(RAW).isNotNull() & read)
    return rows, bad.select(F.col("_metadata.file_path").alias("file"), F.col(RAW).alias("line"))
