"""Retention: time to live, low-popularity grace, row cap, in the order of one sweep (M1 to M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashlode.operators.registry import delete, missing_entries, ordered_scan


def ttl_expired(registry: DataFrame, now_ms: int, ttl_secs: int, batch: int | None = None) -> DataFrame:
    """The oldest ``batch`` rows with last_seen <= now - ttl (M1, C4: inclusive)."""
    return ordered_scan(registry, "last_seen_ms", now_ms - ttl_secs * 1000, batch)


def low_seed_expired(registry: DataFrame, now_ms: int, grace_secs: int, batch: int | None = None) -> DataFrame:
    """Among the oldest ``batch`` rows of few seeders up to the cutoff, those seen first over ``grace`` ago (M2, C5: strict)."""
    scanned = ordered_scan(registry.where("seeders < 2"), "first_seen_ms", now_ms - grace_secs * 1000, batch)
    return scanned.where(now_ms - F.col("first_seen_ms") > grace_secs * 1000)


def over_cap(registry: DataFrame, most: int) -> DataFrame:
    """Rows to evict, oldest first by (last_seen, hash), so that ``most`` stay (M3); 0: no cap.

    The excess may be most of the table: the last row to go is found by histograms, then a filter takes it and all
    before it, without a sort. Rows of equal time and hash go together.
    """
    excess = registry.count() - most if most > 0 else 0
    if excess <= 0:
        return registry.limit(0)
    seen = F.greatest("last_seen_ms", F.lit(0))
    ms, left = _nth(registry.select(F.lpad(F.hex(seen), 16, "0").alias("k")), excess, 16)
    at_ms = F.lpad(F.hex(seen), 16, "0")
    last, _ = _nth(registry.where(at_ms == ms).select(F.col("info_hash").alias("k")), left, 40)
    return registry.where((at_ms < ms) | ((at_ms == ms) & (F.col("info_hash") <= last)))


def _nth(keys: DataFrame, n: int, width: int) -> tuple[str, int]:
    """keys(k) of at most ``width`` hex digits: the n-th smallest, and n less the keys below it; a histogram of at most 65,536
    counts for every four digits."""
    prefix = ""
    while len(prefix) < width:
        part = keys.where(F.col("k").startswith(prefix)) if prefix else keys
        counts = part.groupBy(F.substring("k", len(prefix) + 1, 4).alias("d")).count().collect()
        for digits, m in sorted((r[0], r[1]) for r in counts):
            if n <= m:
                break
            n -= m
        prefix += digits
        if len(digits) < 4:  # a shorter key ends here
            break
    return prefix, n


def sweep(registry: DataFrame, now_ms: int, ttl_secs: int, grace_secs: int, most: int = 0, batch: int | None = None) -> DataFrame:
    """The registry with its action: ttl, low_seed, cap or keep. A batch bounds each of the first two phases."""
    ttl = F.col("last_seen_ms") <= now_ms - ttl_secs * 1000
    low = (F.col("seeders") < 2) & (now_ms - F.col("first_seen_ms") > grace_secs * 1000)
    if batch is None:
        marked = registry.withColumn("action", F.when(ttl, "ttl").when(low, "low_seed").otherwise("keep"))
    else:
        one = ttl_expired(registry, now_ms, ttl_secs, batch).select("info_hash", F.lit("ttl").alias("action"))
        two = low_seed_expired(delete(registry, one), now_ms, grace_secs, batch).select("info_hash", F.lit("low_seed").alias("action"))
        marked = registry.join(one.union(two), "info_hash", "left").withColumn("action", F.coalesce("action", F.lit("keep")))
    if most <= 0:
        return marked
    capped = over_cap(marked.where("action = 'keep'"), most).select("info_hash", F.lit(True).alias("evict"))
    out = marked.join(capped, "info_hash", "left")
    return out.withColumn("action", F.when(F.col("evict"), "cap").otherwise(F.col("action"))).drop("evict")


def sweep_counters(swept: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """what was scanned, deleted and kept; with an index(info_hash), also its entries that no row stands behind, which
    a sweep takes out (stale_fixed)."""
    told = swept.agg(F.count("*").alias("scanned"), F.count_if(F.col("action") != "keep").alias("deleted"), F.count_if(F.col("action") == "keep").alias("kept"))
    if index is None:
        return told
    return told.crossJoin(missing_entries(index, swept).agg(F.count("*").alias("stale_fixed")))  # one row each


def newest(arrivals: DataFrame, cap: int, by: list[str], order: list[str]) -> DataFrame:
    """A ring of the ``cap`` newest distinct entries by their first arrival."""
    first = arrivals.groupBy(*by).agg(F.min(F.struct(*order)).alias("at"))
    return first.orderBy(F.desc("at")).limit(cap)


def rotation(entries: DataFrame, by: str, order: list[str], groups: int) -> DataFrame:
    """Turn of each entry when the front is taken and put back, ``groups`` at a time (H10), per key ``by``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return entries.withColumn("turn", F.floor(rank / groups).cast("int"))
