"""Rolling two-generation dedup (K4), exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROTATE_MS = 15 * 60 * 1000


def rolling_dedup(arrivals: DataFrame, key: str = "info_hash", ms: str = "ms", rotate_ms: int = ROTATE_MS) -> DataFrame:
    """The accepted (key, bucket) with the first arrival of each.

    An arrival is accepted if its key was not accepted in its bucket or the one before. In a run of consecutive
    buckets that makes the 1st, 3rd, 5th; an empty bucket starts a new run. Arrivals are first aggregated to one row
    per key and bucket, so a hot key brings at most one row per bucket to its window.
    """
    bucket = F.floor(F.col(ms) / rotate_ms).cast("long")
    seen = arrivals.groupBy(F.col(key), bucket.alias("bucket")).agg(F.min(ms).alias(ms))
    w = Window.partitionBy(key).orderBy("bucket")
    run = F.col("bucket") - F.row_number().over(w)
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy("bucket"))
    return seen.withColumn("run", run).withColumn("place", place).where("place % 2 = 1").select(key, "bucket", ms)
