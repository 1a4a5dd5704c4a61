"""File sources and sinks (survey §2.1).

* ``read_customers``: parquet or CSV with an explicit schema (no inference),
  optional date columns parsed with ``to_timestamp``; a missing path raises
  ``FileNotFoundError``, any other read failure ``RuntimeError``; an empty
  table only warns.  Excel is not supported (parquet/CSV instead).
* ``write_scored``: scored customers written as parquet partitioned by the
  intervention flag (so a campaign reads only flagged rows: partition
  pruning).  Any Hadoop path works (HDFS, S3A, ...).
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_customers(spark: SparkSession, path: str, schema: StructType | str | None = None,
                   fmt: str = "parquet", date_cols: Sequence[str] | None = None,
                   date_format: str | None = None) -> DataFrame:
    try:
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        if fmt == "csv":
            reader = reader.option("header", "true")
        df = reader.load(path)
        for c in date_cols or ():
            df = df.withColumn(c, F.to_timestamp(F.col(c), date_format) if date_format
                               else F.to_timestamp(F.col(c)))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from e
        raise RuntimeError(f"Could not read {path}: {e}") from e
    except Exception as e:  # noqa: BLE001 - contract: anything else is RuntimeError
        raise RuntimeError(f"Could not read {path}: {e}") from e
    if df.isEmpty():
        warnings.warn(f"{path} has no rows", stacklevel=2)
    return df


def write_scored(df: DataFrame, path: str, flag: str = "intervention_flag",
                 mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(flag).parquet(path)


def read_scored(spark: SparkSession, path: str, flagged_only: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("intervention_flag") == 1) if flagged_only else df
