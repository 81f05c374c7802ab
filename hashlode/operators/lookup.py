"""Joins of the discovery loop: requests with answers, frontier order, first arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashlode.functions.net import xor_distance


def match_inflight(requests: DataFrame, answers: DataFrame, timeout_ms: int = 900) -> DataFrame:
    """requests(tx, sent_ms), answers(tx, got_ms): each request with its first answer in time (E5, C14).

    A request is open until its answer, its timeout, or the next request of its tx, which takes its place; so an answer
    serves one request, the latest before it, and a request takes one answer.
    """
    until = F.least(F.col("sent_ms") + timeout_ms, F.coalesce(F.lead("sent_ms").over(Window.partitionBy("tx").orderBy("sent_ms")) - 1, F.col("sent_ms") + timeout_ms))
    r, a = requests.select("tx", "sent_ms").distinct().withColumn("until", until).alias("r"), answers.alias("a")
    pairs = r.join(a, (F.col("r.tx") == F.col("a.tx")) & (F.col("a.got_ms") >= F.col("r.sent_ms")) & (F.col("a.got_ms") <= F.col("r.until")))
    return pairs.groupBy(F.col("r.tx").alias("tx"), F.col("r.sent_ms").alias("sent_ms")).agg(F.min("a.got_ms").alias("got_ms"))


def frontier(nodes: DataFrame, target: str, limit: int) -> DataFrame:
    """nodes(id, ip_num, port): the closest by XOR distance to the target id, ties by largest address."""
    return nodes.withColumn("distance", xor_distance(F.col("id"), F.lit(target))).orderBy("distance", F.desc("ip_num"), F.desc("port")).limit(limit)


def first_arrivals(peers: DataFrame, key: str, item: str, order: str, cap: int) -> DataFrame:
    """Distinct items of each key in the order of first arrival, at most ``cap``."""
    first = peers.groupBy(key, item).agg(F.min(order).alias(order))
    w = Window.partitionBy(key).orderBy(order, item)
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
