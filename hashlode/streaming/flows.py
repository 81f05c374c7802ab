"""The dataflows as streams. Each keyed result is the same as its batch form over what has arrived."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hashlode.functions import bencode as B
from hashlode.functions.net import chunks
from hashlode.operators.dedupe import ROTATE_MS
from hashlode.operators.registry import merge, touch_fold
from hashlode.operators.retention import sweep
from hashlode.schema import PACKET
from hashlode.sources.scratch import scratch_path
from hashlode.sources.views import observed_of

SAMPLES_PER_MESSAGE = 256
NONE_OPEN = -(1 << 62)
FOLD = "info_hash string, first_seen_ms long, last_seen_ms long, seeders long"


def packet_stream(spark: SparkSession, path: str) -> DataFrame:
    """Captured packets as they land in a folder."""
    return spark.readStream.schema(PACKET).parquet(path)


def harvest(packets: DataFrame, keep: list[str], most: int = SAMPLES_PER_MESSAGE) -> DataFrame:
    """A row per hash of each packet: up to ``most`` samples of an answer, or the hash of a query."""
    m = packets.select(*keep, B.message(F.col("payload")).alias("m"))
    samples = F.slice(F.coalesce(chunks(F.hex("m.samples"), 20), F.array().cast("array<string>")), 1, most)
    asked = F.when(F.col("m.info_hash").isNotNull(), F.array(F.hex("m.info_hash"))).otherwise(F.array().cast("array<string>"))
    return m.select(*keep, F.explode(F.transform(F.concat(samples, asked), F.lower)).alias("harvested"))


def learn_nodes(packets: DataFrame) -> DataFrame:
    """Compact node records of answers as hex, of both families."""
    m = packets.select(B.message(F.col("payload")).alias("m"))
    both = ((4, "nodes", 26), (6, "nodes6", 38))
    parts = [m.select(F.lit(f).alias("family"), F.explode(chunks(F.lower(F.hex(f"m.{c}")), n)).alias("record")) for f, c, n in both]
    return parts[0].unionByName(parts[1])


def write_folds(observed: DataFrame, path: str, checkpoint: str, **trigger: Any):
    """Each micro-batch folded to a row per hash and appended; a batch replayed after a failure replaces its own folder (K5, B1)."""

    def put(batch: DataFrame, n: int) -> None:
        touch_fold(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return observed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry that the folds written so far add up to."""
    folds = spark.read.parquet(path).drop("batch")
    empty = {c: F.lit(None).cast("string") for c in ("title", "magnet", "info_b64")}
    rows = folds.withColumns(empty)
    return merge(rows, rows.limit(0))


def maintain_registry(observed: DataFrame, path: str, checkpoint: str, ttl_secs: int, grace_secs: int, most: int = 0, every: int = 8, **trigger: Any):
    """The registry as a stream that keeps itself small (K5, K6, M1 to M3): each micro-batch appends its fold, and each
    ``every`` batches the last base and the folds since become the next base, swept as of the latest time seen.

    A base covers all batches up to its number and is read once it is whole; one older base and the folds after it stay,
    so a batch replayed after a failure writes the same again.
    """

    def put(batch: DataFrame, n: int) -> None:
        touch_fold(batch).write.mode("overwrite").parquet(f"{path}/folds/batch={n}")
        if (n + 1) % every:
            return
        spark = batch.sparkSession
        before = [b for b in _bases(spark, path) if b < n]
        rows = _maintained(spark, path, before[-1] if before else -1, n)
        now = rows.agg(F.max("last_seen_ms")).first()[0] or 0
        kept = sweep(rows, now, ttl_secs, grace_secs, most).where("action = 'keep'").drop("action")
        kept.write.mode("overwrite").parquet(f"{path}/base/upto={n}")
        for b in before[:-1]:
            _remove(spark, f"{path}/base/upto={b}")
        for b in _numbers(spark, f"{path}/folds/batch=*"):
            if before and b <= before[-1]:
                _remove(spark, f"{path}/folds/batch={b}")

    return observed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def read_maintained(spark: SparkSession, path: str) -> DataFrame:
    """The maintained registry: its last base with the folds since."""
    bases = _bases(spark, path)
    return _maintained(spark, path, bases[-1] if bases else -1, None)


def _maintained(spark: SparkSession, path: str, base: int, last: int | None) -> DataFrame:
    folds = spark.read.schema(f"{FOLD}, batch long").parquet(f"{path}/folds").where(F.col("batch") > base)
    rows = (folds if last is None else folds.where(F.col("batch") <= last)).drop("batch")
    if base >= 0:
        rows = rows.unionByName(spark.read.schema(FOLD).parquet(f"{path}/base/upto={base}"))
    return rows.groupBy("info_hash").agg(F.min("first_seen_ms").alias("first_seen_ms"), F.max("last_seen_ms").alias("last_seen_ms"), F.max("seeders").alias("seeders"))


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, pattern: str) -> list[int]:
    p, fs = _files(spark, pattern)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.globStatus(p) or ())


def _bases(spark: SparkSession, path: str) -> list[int]:
    p, fs = _files(spark, f"{path}/base/upto=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in fs.globStatus(p) or ())


def _remove(spark: SparkSession, path: str) -> None:
    p, fs = _files(spark, path)
    fs.delete(p, True)


def rolling_dedup_stream(observed: DataFrame, rotate_ms: int = ROTATE_MS, late: str = "1 hour") -> DataFrame:
    """Accepted (info_hash, bucket, ms). Arrival order decides between batches, time within one; the state of a hash is
    its accepted buckets that can still matter, dropped once the watermark is three rotations past them."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = set(state.get[0]) if state.exists else set()
        out = []
        for ms in sorted(int(x) for b in batches for x in b["ms"]):
            bucket = ms // rotate_ms
            if bucket not in accepted and bucket - 1 not in accepted:
                accepted.add(bucket)
                out.append((key[0], bucket, ms))
        last = max(accepted)
        state.update(([b for b in accepted if b >= last - 2],))
        state.setTimeoutTimestamp(max((last + 3) * rotate_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["info_hash", "bucket", "ms"])

    timed = observed.select("info_hash", "ms", F.timestamp_millis("ms").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("info_hash").applyInPandasWithState(
        step, "info_hash string, bucket long, ms long", "accepted array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def match_inflight_stream(requests: DataFrame, answers: DataFrame, timeout_ms: int = 900, late: str = "10 seconds") -> DataFrame:
    """requests(tx, sent_ts) and answers(tx, got_ts) as one stream: (tx, sent_ts, got_ts), match-once as in the batch form
    (K7). Arrival order decides between batches, time within one; the state is the open request of a tx."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_ = state.get[0] if state.exists else NONE_OPEN
        out = []
        rows = sorted((r.ts.value // 1000, bool(r.is_answer)) for b in batches for r in b.itertuples())
        for us, is_answer in rows:
            if not is_answer:
                open_ = us
            elif open_ != NONE_OPEN and open_ <= us <= open_ + timeout_ms * 1000:
                out.append((key[0], open_, us))
                open_ = NONE_OPEN
        state.update((open_,))
        state.setTimeoutTimestamp(max((open_ if open_ != NONE_OPEN else rows[-1][0]) // 1000 + timeout_ms + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["tx", "sent_us", "got_us"])

    kind = requests.schema["tx"].dataType.simpleString()
    sent = requests.select("tx", F.col("sent_ts").alias("ts"), F.lit(False).alias("is_answer"))
    both = sent.unionByName(answers.select("tx", F.col("got_ts").alias("ts"), F.lit(True).alias("is_answer"))).withWatermark("ts", late)
    found = both.groupBy("tx").applyInPandasWithState(step, f"tx {kind}, sent_us long, got_us long", "open long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("tx", F.timestamp_micros("sent_us").alias("sent_ts"), F.timestamp_micros("got_us").alias("got_ts"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a pattern, since a stream's plain path must be a folder
    return observed_of(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/event[s].parquet"))


def replay_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the registry stream."""
    path = scratch_path(spark, "registry")
    write_folds(_event_stream(spark, sf_dir), path, scratch_path(spark, "progress"), availableNow=True).awaitTermination()
    return read_registry(spark, path).select("info_hash", "first_seen_ms", "last_seen_ms", "seeders")


def replay_rolling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the dedup stream."""
    path = scratch_path(spark, "accepted")
    stream = rolling_dedup_stream(_event_stream(spark, sf_dir))
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def replay_maintained(spark: SparkSession, sf_dir: str, ttl_secs: int, grace_secs: int, most: int) -> DataFrame:
    """All events through the registry stream that sweeps itself."""
    path = scratch_path(spark, "maintained")
    maintain_registry(_event_stream(spark, sf_dir), path, scratch_path(spark, "progress"), ttl_secs, grace_secs, most, every=1, availableNow=True).awaitTermination()
    return read_maintained(spark, path)


def replay_nodes(spark: SparkSession, packets: DataFrame) -> DataFrame:
    """Packets written as a capture and read back as a stream, to the nodes they tell of."""
    captured, path = scratch_path(spark, "packets"), scratch_path(spark, "nodes")
    packets.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name not in packets.columns else F.col(f.name).cast(f.dataType) for f in PACKET.fields)).write.parquet(captured)
    stream = learn_nodes(packet_stream(spark, captured))
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
