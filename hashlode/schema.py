"""Schemas of the registry, the search index and captured packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

REGISTRY = T.StructType(
    [
        T.StructField("info_hash", T.StringType()), T.StructField("title", T.StringType()), T.StructField("magnet", T.StringType()), T.StructField("seeders", T.LongType()),
        T.StructField("info_b64", T.StringType()), T.StructField("first_seen_ms", T.LongType()), T.StructField("last_seen_ms", T.LongType()),
    ]
)
INDEX = T.StructType([REGISTRY["info_hash"], REGISTRY["title"], REGISTRY["magnet"], REGISTRY["seeders"]])
PACKET = T.StructType(
    [
        T.StructField("recv_ts", T.TimestampType()), T.StructField("from_ip", T.StringType()), T.StructField("from_port", T.IntegerType()),
        T.StructField("family", T.IntegerType()), T.StructField("payload", T.BinaryType()),
    ]
)


def conforms(df: DataFrame, schema: T.StructType) -> bool:
    """Whether the named columns are there; a derived table that fails this is rebuilt."""
    return set(schema.names) <= set(df.columns)
