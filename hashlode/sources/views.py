"""Registry-shaped views of the star-schema tables, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashlode.functions import bencode as B
from hashlode.functions.text import base64_line, millis, percent_encode, synthetic_magnet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(text) -> F.Column:
    return F.sha1(text.cast("string").cast("binary"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    h, key = _sha(F.col("p_partkey")), F.col("p_partkey")
    blob = F.when(key % 3 == 1, F.lit("\t\n ")).when(key % 3 == 2, base64_line(F.col("p_name").cast("binary")))
    return part.select(
        "p_partkey", h.alias("info_hash"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"), F.when(key % 5 != 0, synthetic_magnet(h)).alias("magnet"),
        (F.col("p_size") % 7).cast("long").alias("seeders"), blob.alias("info_b64"),
    )


CATALOG = """catalog AS (
  SELECT p_partkey, sha1(CAST(p_partkey AS VARCHAR)) AS info_hash, p_name || ' ' || p_type || ' ' || p_brand AS title,
         CASE WHEN p_partkey % 5 <> 0 THEN 'magnet:?xt=urn:btih:' || sha1(CAST(p_partkey AS VARCHAR)) END AS magnet,
         CAST(p_size % 7 AS BIGINT) AS seeders,
         CASE p_partkey % 3 WHEN 1 THEN chr(9) || chr(10) || ' ' WHEN 2 THEN to_base64(encode(p_name)) END AS info_b64
  FROM part)"""


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded before the join, so the join sees one row per part."""
    seen = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    joined = seen.join(catalog(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("info_hash", "seeders", millis(F.col("a")).alias("first_seen_ms"), millis(F.col("b")).alias("last_seen_ms"))


LIFECYCLE = (
    CATALOG
    + """, lifecycle AS (
  SELECT c.info_hash, c.seeders, epoch_us(min(l_shipdate)) // 1000 AS first_seen_ms, epoch_us(max(l_shipdate)) // 1000 AS last_seen_ms
  FROM lineitem JOIN catalog c ON l_partkey = p_partkey GROUP BY c.info_hash, c.seeders)"""
)


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed_of(table(spark, sf_dir, "events"))


def observed_of(events: DataFrame) -> DataFrame:
    h = F.sha1(F.concat_ws(":", "user_id", "event_type").cast("binary"))
    return events.select("event_id", h.alias("info_hash"), millis(F.col("ts")).alias("ms"), F.floor("value").cast("long").alias("seeders"))


OBSERVED = """obs AS (
  SELECT event_id, sha1(CAST(user_id AS VARCHAR) || ':' || event_type) AS info_hash, epoch_us(ts) // 1000 AS ms, CAST(floor(value) AS BIGINT) AS seeders
  FROM events)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _sha(F.col("doc_id")).alias("info_hash"), F.col("text").alias("title"), F.lit(None).cast("string").alias("magnet"), (F.col("doc_id") % 7).alias("seeders"))


CORPUS = """corpus AS (SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS info_hash, text AS title, doc_id % 7 AS seeders FROM documents)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses cut from hashes of events, with one row for each special range."""
    events = table(spark, sf_dir, "events")
    h = F.sha1(F.concat(F.lit("n"), F.col("event_id").cast("string")).cast("binary"))
    cut = events.select(
        "event_id", _sha(F.col("event_id")).alias("id"), F.substring(h, 1, 8).alias("v4_hex"), F.substring(h, 9, 32).alias("v6_hex"), (F.conv(F.substring(h, 37, 4), 16, 10).cast("int") % 500).alias("port"), millis(F.col("ts")).alias("ms")
    )
    special = [(-1 - i, "00" * 20, v4, v6, 1, 0) for i, (v4, v6) in enumerate(SPECIAL)]
    return cut.unionByName(spark.createDataFrame(special, cut.schema))


#: (v4, v6) in hex: one of each special range and one just outside (fixed values).
SPECIAL = (
    ("0a000001", "0" * 31 + "1"), ("ac100001", "0" * 32), ("ac200001", "fc" + "0" * 30), ("c0a80101", "fd" + "1" * 30), ("7f000001", "fe80" + "0" * 28), ("00000000", "febf" + "0" * 28),
    ("a9fe0001", "fec0" + "0" * 28), ("e0000001", "ff02" + "0" * 28), ("c0000201", "20010db8" + "0" * 24), ("c6336401", "20010db9" + "0" * 24), ("cb007101", "2" + "0" * 31), ("c6120001", "0" * 31 + "2"), ("c6140001", "3" * 32),
)
NODES = (
    """nodes AS (
  SELECT event_id, sha1(CAST(event_id AS VARCHAR)) AS id, substr(h, 1, 8) AS v4_hex, substr(h, 9, 32) AS v6_hex,
         CAST(('0x' || substr(h, 37, 4)) AS INTEGER) % 500 AS port, epoch_us(ts) // 1000 AS ms
  FROM (SELECT *, sha1('n' || CAST(event_id AS VARCHAR)) AS h FROM events)
  UNION ALL SELECT * FROM (VALUES """
    + ", ".join(f"({-1 - i}, '{'00' * 20}', '{v4}', '{v6}', 1, 0)" for i, (v4, v6) in enumerate(SPECIAL))
    + ") v)"
)


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of several kinds for every part, some malformed; kind tells which."""
    c = catalog(spark, sf_dir)
    h, tx, own = F.unhex("info_hash"), F.lit(b"aa"), F.lit(b"0" * 20)
    backwards = F.unhex(F.array_join(F.reverse(F.regexp_extract_all("info_hash", F.lit("(..)"), F.lit(1))), ""))
    good = B.get_peers(tx, own, h)
    announce = B.dictionary(("a", B.dictionary(("id", B.byte_string(own)), ("info_hash", B.byte_string(h)))), ("q", B.text("announce_peer")), ("t", B.byte_string(tx)), ("y", B.text("q")))
    sample = B.dictionary(("r", B.dictionary(("id", B.byte_string(own)), ("samples", B.byte_string(F.concat(h, backwards, F.substring(h, 1, 7)))))), ("t", B.byte_string(tx)), ("y", B.text("r")))
    kinds = [
        good, announce, sample, F.substring(good, F.lit(1), F.octet_length(good) - 1), F.concat(good, F.lit(b"xyz")),
        B.dictionary(("a", F.lit(b"l1:ae")), ("q", B.text("get_peers")), ("y", B.text("q"))), F.lit(b"i12e"), B.find_node(tx, own, h),
    ]
    kind = (F.col("p_partkey") % len(kinds)).cast("int")
    payload = F.coalesce(*(F.when(kind == i, k) for i, k in enumerate(kinds)))
    return c.select("p_partkey", "info_hash", kind.alias("kind"), payload.alias("payload"))


def magnets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url"))
    return catalog(spark, sf_dir).join(pages, F.col("p_partkey") == F.col("page_id")).select(
        "info_hash", F.concat(F.coalesce("magnet", F.lit("magnet:?xt=urn:btih:0")), F.lit("&tr="), percent_encode(F.col("url")), F.lit("&dn=x&tr="), F.lit("udp%3A%2F%2Ft%3A80")).alias("magnet")
    )


MAGNETS = (
    CATALOG
    + """, magnets AS (
  SELECT info_hash, coalesce(magnet, 'magnet:?xt=urn:btih:0') || '&tr=' || url_encode(url) || '&dn=x&tr=' || 'udp%3A%2F%2Ft%3A80' AS magnet, url
  FROM catalog JOIN pages ON p_partkey = page_id)"""
)
