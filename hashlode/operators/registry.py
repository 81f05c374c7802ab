"""The keyed registry: folds, merges, work lists, projections and derived index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashlode.functions.text import blank, short_hash, synthetic_magnet


def has_info(blob: Column) -> Column:
    """Not null and not blank."""
    return ~blank(blob)


def low_seed(seeders: Column) -> Column:
    return seeders < 2  # C2


def active(seeders: Column) -> Column:
    return seeders >= 2  # C3


def touch_fold(observed: DataFrame) -> DataFrame:
    """(info_hash, ms, seeders) to first and last sight and most seeders per hash: one partial aggregate."""
    return observed.groupBy("info_hash").agg(F.min("ms").alias("first_seen_ms"), F.max("ms").alias("last_seen_ms"), F.max(F.coalesce("seeders", F.lit(0))).alias("seeders"))


def merge(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Registry rows with change rows of the same columns folded in.

    The last non-blank title and magnet and the last blob win, by last_seen_ms; seeders only grow. Replaying changes
    alters nothing. One shuffle on the hash serves both sides.
    """
    both = registry.unionByName(changes, allowMissingColumns=True)
    # of rows last seen at the same time the greatest value, whatever the order of rows
    latest = lambda c, ok: F.max_by(F.when(ok, F.col(c)), F.when(ok, F.struct("last_seen_ms", c))).alias(c)
    return both.groupBy("info_hash").agg(
        latest("title", ~blank(F.col("title"))), latest("magnet", ~blank(F.col("magnet"))), F.max(F.coalesce("seeders", F.lit(0))).alias("seeders"),
        latest("info_b64", F.col("info_b64").isNotNull()), F.min("first_seen_ms").alias("first_seen_ms"), F.max("last_seen_ms").alias("last_seen_ms"),
    )


def delete(registry: DataFrame, gone: DataFrame) -> DataFrame:
    return registry.join(gone.select("info_hash"), "info_hash", "left_anti")  # B5, B10, G7


def point_get(registry: DataFrame, info_hash: str) -> DataFrame:
    """The row of a hash, exactly as written; pushed down to the scan (A1)."""
    return registry.where(F.col("info_hash") == info_hash).limit(1)


def detail(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for every key(info_hash), with defaults also where the registry has none."""
    found = keys.select("info_hash").join(registry.select("info_hash", "title", "magnet", "seeders"), "info_hash", "left")
    return found.select(
        "info_hash", F.coalesce("title", F.lit("Unknown Title")).alias("title"), F.coalesce("magnet", F.lit("")).alias("magnet"), F.coalesce("seeders", F.lit(0)).cast("long").alias("seeders")
    )


def ordered_scan(registry: DataFrame, column: str, cutoff: int, batch: int | None) -> DataFrame:
    """Rows up to and with the cutoff, oldest first, then by hash (A3, A4); all of them, unordered, without a batch."""
    found = registry.where(F.col(column) <= cutoff)
    return found if batch is None else found.orderBy(F.greatest(F.col(column), F.lit(0)), "info_hash").limit(batch)


def worklist(registry: DataFrame, limit: int = 200) -> DataFrame:
    """Rows without info, in the order of their hash (A5)."""
    return registry.where(~has_info(F.col("info_b64"))).orderBy("info_hash").limit(limit)


def backfill_counters(registry: DataFrame) -> DataFrame:
    """F5, F7 in one pass."""
    return registry.agg(
        F.count("*").alias("total"), F.count_if(~has_info(F.col("info_b64"))).alias("missing_info"), F.count_if(low_seed(F.col("seeders"))).alias("low_seed")
    )


def index_rows(registry: DataFrame) -> DataFrame:
    """What the search index holds: active rows, with title and magnet filled in."""
    return registry.where(active(F.col("seeders"))).select(
        "info_hash", F.coalesce("title", F.concat(F.lit("Torrent "), F.col("info_hash"))).alias("title"),
        F.when(blank(F.col("magnet")), synthetic_magnet(F.col("info_hash"))).otherwise(F.col("magnet")).alias("magnet"), "seeders",
    )


def missing_entries(index: DataFrame, registry: DataFrame) -> DataFrame:
    """Index entries whose record is gone."""
    return index.join(registry.select("info_hash"), "info_hash", "left_anti")


def result_card(hits: DataFrame) -> DataFrame:
    """D3: what a result list shows."""
    filled = F.coalesce("magnet", F.lit("")) != ""
    return hits.select("info_hash", F.coalesce("title", F.lit("(untitled)")).alias("title"), short_hash(F.col("info_hash")).alias("short_hash"), filled.alias("has_actions"), "seeders")


def decode_values(rows: DataFrame, value: str = "value") -> DataFrame:
    """Stored values of either format: ``SRM1|hash|seeders|first|last`` or JSON; others are null.

    A rewrite in the new format is one batch job: ``encode_values(decode_values(...))``.
    """
    fields = F.split(F.col(value), r"\|")
    new = F.col(value).startswith("SRM1|") & (F.size(fields) == 5)
    old = F.from_json(value, "info_hash string, seeders bigint, first_seen_ms bigint, last_seen_ms bigint")
    names = ("info_hash", "seeders", "first_seen_ms", "last_seen_ms")
    pick = lambda i, c: F.when(new, fields[i].try_cast("long" if i > 1 else "string")).otherwise(old[c]).alias(c)
    return rows.select(*(c for c in rows.columns if c not in (*names, value)), *(pick(i + 1, c) for i, c in enumerate(names)))


def encode_values(rows: DataFrame) -> DataFrame:
    """``SRM1|hash|seeders|first|last``; a null field is empty, and null again when decoded."""
    fields = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("info_hash", "seeders", "first_seen_ms", "last_seen_ms"))
    return rows.select("info_hash", F.concat_ws("|", F.lit("SRM1"), *fields).alias("value"))


def peer_popularity(peers: DataFrame, cap: int = 50, per_hash: int = 64) -> DataFrame:
    """Distinct peers per hash, at most ``cap`` (F3); the ``per_hash`` bound on arrivals is above it."""
    return peers.groupBy("info_hash").agg(F.least(F.count_distinct("peer"), F.lit(min(cap, per_hash))).alias("popularity"))


def tracker_seeders(answers: DataFrame) -> DataFrame:
    """The most any tracker says; null if none answers."""
    return answers.groupBy("info_hash").agg(F.max("complete").alias("seeders"))


def first_success(attempts: DataFrame) -> DataFrame:
    """Of each hash the result that was complete first."""
    return attempts.where("ok").groupBy("info_hash").agg(F.min_by("result", F.struct("done_ms", "result")).alias("result"))


def assemble_pieces(pieces: DataFrame, totals: DataFrame, piece_size: int) -> DataFrame:
    """pieces(key, idx, seq, data) to the payload of ``total`` bytes (G8, F9): the last copy of an index wins, short or
    missing pieces leave zero bytes."""
    last = pieces.groupBy("key", "idx").agg(F.max_by("data", "seq").alias("data"))
    width = piece_size * 2
    parts = last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("idx", F.substring(F.hex("data"), 1, width).alias("h")))).alias("parts"))
    count = F.ceil(F.col("total") / piece_size).cast("int")
    filled = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.rpad(F.coalesce(F.try_element_at("parts", i), F.lit("")), width, "0"))
    body = F.when(F.col("total") > 0, F.array_join(filled, "")).otherwise(F.lit(""))
    return totals.join(parts, "key", "left").select("key", "total", F.unhex(F.substring(body, F.lit(1), (F.col("total") * 2).cast("int"))).alias("payload"))
