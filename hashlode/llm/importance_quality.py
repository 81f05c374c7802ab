"""Quality selection by importance resampling (Xie et al. 2023): hashed n-gram models of target and raw text.

Word 1- and 2-grams of every whole document are hashed into a fixed number of buckets. The raw model counts all
documents; the target model counts the texts of labelled good documents (a bounded sample of at most
``target_rows`` ids, the ones of least hash). A document's log importance weight is the mean over its n-grams of
log p_target - log p_raw, at the evidence of ``EVIDENCE`` n-grams: the method compares examples of one length, and a
plain sum would choose by length. Adding Gumbel noise seeded by the id and keeping the k largest keys samples k
documents without replacement in proportion to their weights. k is the share of good rows among the labels times the
number of documents, or is given.

Null and empty texts have no n-grams, null weight and key, and are kept only where k asks for all rows. Rows with equal
id and text have equal keys; those that tie at the k-th key are all kept. Null ids draw the noise of the text "null".
Without labels nothing can be told from raw text: every weight is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashlode.llm.set_join import bucket_counts
from hashlode.llm.shared import stored, table
from hashlode.llm.spans import blocks, mix, tidy, word_hashes

BITS = 18
BUCKETS = 1 << BITS
EVIDENCE = 100


def _ngrams(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, payload index) of all word 1-grams and 2-grams."""
    h, owner = word_hashes(payloads)
    pair = mix(h[:-1] * np.uint64(3) + h[1:])
    same = owner[:-1] == owner[1:]
    bucket = np.concatenate((h, pair[same])) >> np.uint64(64 - BITS)
    return bucket.astype(np.int64), np.concatenate((owner, owner[:-1][same]))


def _payloads(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def ngram_counts(docs: DataFrame, good: DataFrame | None, text: str = "text", id_col: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all documents, and over those whose id is in ``good`` (a bounded list of ids)."""
    rows = docs.select(F.col(text).alias("text"), F.col(id_col).alias("id"))
    if good is None:
        rows = rows.withColumn("good", F.lit(False))
    else:
        rows = rows.join(F.broadcast(good.select(F.col(id_col).alias("id"), F.lit(True).alias("good"))), "id", "left")

    def counted(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        good_rows = np.array([bool(x) for x in batch.column(1).to_pylist()], bool)
        for first, held in blocks(_payloads(batch.column(0))):
            bucket, owner = _ngrams(held)
            yield bucket
            yield bucket[good_rows[first + owner]] + BUCKETS

    raw, target = bucket_counts(rows.select("text", "good"), counted, BUCKETS, 2)
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket; the target is smoothed with the raw distribution (one count a raw 1000)."""
    if not raw.sum() or not target.sum():
        return np.zeros(BUCKETS, np.float32)
    p_raw = (raw + 0.1) / (raw.sum() + 0.1 * BUCKETS)
    prior = max(1.0, target.sum() / 1000)
    p_target = (target + prior * p_raw) / (target.sum() + prior)
    return np.log(p_target / p_raw).astype(np.float32)


def weights(docs: DataFrame, ratio: np.ndarray, text: str = "text", id_col: str = "doc_id", seed: int = 11) -> DataFrame:
    """(id, n_grams, log_weight, key): log_weight reads whole texts; key adds the id's Gumbel noise."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS floats: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, held in blocks(_payloads(batch.column(1))):
                bucket, owner = _ngrams(held)
                total[first : first + len(held)] = np.bincount(owner, weights=table_[bucket], minlength=len(held))
                n[first : first + len(held)] = np.bincount(owner, minlength=len(held))
            weight = pa.array(np.round(total / np.maximum(n, 1) * EVIDENCE, 6), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), weight], names=["id", "n_grams", "log_weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"id {id_type}, n_grams long, log_weight double")
    h = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(seed))
    uniform = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return rows.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))).withColumnRenamed("id", id_col)


def _sortable(key: Column) -> Column:
    """Longs that order as the keys do: keys to 1/2^20, offset to be positive; null comes last."""
    bounded = (F.greatest(F.least(key, F.lit(2.0**39)), F.lit(-(2.0**39))) * 1048576).cast("long") + (1 << 60)
    return F.when(key.isNull(), F.lit(0)).otherwise(bounded)  # greatest and least skip nulls


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a column of longs of 0 to 2^62, by four histograms of at most 2^16 counts each."""
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        part = rows if shift == 48 else rows.where(F.shiftright(column, shift + 16) == prefix)
        counts = part.groupBy(F.shiftright(column, shift).bitwiseAND(0xFFFF).alias("d")).count().collect()  # 65,536 rows at most
        for digit, n in sorted(((r[0], r[1]) for r in counts), reverse=True):
            if left <= n:
                break
            left -= n
        prefix = (prefix << 16) | digit
    return prefix


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, target_rows: int = 20_000, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_grams, log_weight, key, kept. ``labels`` has the id and quality (1: good)."""
    told = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
    good = told.where("quality = 1").select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(target_rows)
    raw, target = ngram_counts(docs, good, text, id_col)
    scored = stored(weights(docs, log_ratio(raw, target), text, id_col).withColumn("rank_key", _sortable(F.col("key"))), "weights")
    if k is None:
        share = told.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
        k = round((1.0 if share is None else share) * scored.count())
    else:
        k = min(k, scored.count())
    kept = F.lit(False) if k < 1 else F.col("rank_key") >= kth_largest(scored, "rank_key", k)
    return scored.withColumn("kept", kept).drop("rank_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: weight, key and choice for every document."""
    return select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
