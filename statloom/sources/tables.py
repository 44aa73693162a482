"""Tables in and out: missing values become NULL on the way in, results can be cut from their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLOATS = ("double", "float")
NUMERIC = (*FLOATS, "int", "bigint", "smallint", "tinyint")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def normalize(df: DataFrame) -> DataFrame:
    """NaN as NULL in every floating-point column: one kind of missing value from here on."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in df.dtypes if k in FLOATS}) if any(k in FLOATS for _, k in df.dtypes) else df


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, nan_to_null: bool = True, **options) -> DataFrame:
    """A table from parquet, orc, csv or json files; csv and json take a schema rather than guess one.

    nan_to_null=False for tables known to hold no NaN: then filters on their numbers reach the scan.
    """
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind in ("csv", "json"):
        raise ValueError("csv and json need a schema")
    df = reader.format(kind).load(path)
    return normalize(df) if nan_to_null else df


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` evaluated once and written to the session's checkpoint folder.

    Anything that later reads it twice sees the same rows in the same partitions, lost executors or not.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        # If unset, a folder of the warehouse, which the executors share too.
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()
