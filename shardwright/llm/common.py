"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Cuts the lineage without tying the data to executors: a lost executor costs
    the tasks it was running, never the table."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (an expression-level binding)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8(c: Column | str) -> Column:
    """UTF-8 bytes of a text; a null text counts as empty."""
    return F.encode(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "UTF-8")


def fold(col: Column | str, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``: the split that held-out rules are stated in."""
    return F.crc32(F.encode(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(-1)).cast("string"),
                            "UTF-8")) % modulus
