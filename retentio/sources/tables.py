"""Base-table readers.

Every reader selects only the columns a job needs, so the parquet scan's
``ReadSchema`` is pruned and filters written afterwards are pushed down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}; known: {TABLES}")
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one base table, projecting ``columns`` when given."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df
