r"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint: A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, shingles of ``words`` words joined by a space, repeats
included (fewer words: the whole sequence; none: zero), XXH64 with seed 42; a bit is 1 if set in over half of them.

Two fingerprints at ``radius`` or fewer differing bits agree in at least j of radius + j bit groups, so equal ones
of every choice of j groups bring each such pair together (j grows with the number of distinct fingerprints, so
that buckets stay small; every j is exact). Within a bucket, fingerprints are compared bit-sliced: bit planes are
stored vertically, 64 fingerprints to a word; for every (fingerprint, word) pair the differing bits of 64 partners
are counted at once in carry-save counters, plane by plane, and a pair is abandoned once all its 64 lanes exceed the
radius. A bucket over ``TILE`` is cut into tiles whose pairs are compared in different tasks. Tasks return a
spanning forest of their links, never all of them; components are joined across tasks afterwards.

Null text counts as empty. Null ids get fingerprints and take part; a component's id is its smallest non-null id.
Equal rows are linked like others. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashlode.llm.graph import components, local_labels
from hashlode.llm.near_copies import BROADCAST_ROWS, near_copies, text_mark
from hashlode.llm.shared import dealt_join, drop_all, drop_stored, free_names, stored, table
from hashlode.llm.spans import tidy

SEED = 42
RADIUS = 4
TILE = 1 << 14
PAIRS_AT_ONCE = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(payload: bytes, words: int = 4) -> int:
    from xxhash import xxh64_intdigest as h

    found = payload.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [h(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist()
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.array(hashes[lo : lo + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(_BIT[bits * 2 > len(hashes)].sum())


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp): fingerprints as signed longs."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.array([fingerprint(x.as_py() or b"", words) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"id {id_type}, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of 64 neighbouring fingerprints in each word of row b."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _close_words(fps: np.ndarray, planes: np.ndarray, q: np.ndarray, w: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, w, lanes): of the pairs fingerprint q[i] with word w[i], those with lanes within the radius."""
    levels = (radius + 1).bit_length()
    counters = [np.zeros(len(q), np.uint64) for _ in range(levels)]
    over = np.zeros(len(q), np.uint64)
    for b in range(64):
        carry = planes[b][w] ^ (np.uint64(0) - ((fps[q] >> np.uint64(b)) & np.uint64(1)))
        for k in range(levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            open_ = _within(counters, over, radius)
            alive = np.flatnonzero(open_)
            if len(alive) < len(q):
                q, w, over, counters = q[alive], w[alive], over[alive], [c[alive] for c in counters]
            if not len(q):
                break
    return q, w, _within(counters, over, radius)


def _within(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is at most the radius: compared bit by bit from the top."""
    less, equal = np.zeros_like(over), np.full_like(over, _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            less |= equal & ~counters[k]
            equal &= counters[k]
        else:
            equal &= ~counters[k]
    return (less | equal) & ~over


def links(fps: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): indices within the radius, where fps[i] is compared with all j of first[i] <= j < end[i]."""
    if not len(fps):
        return
    planes = bit_planes(fps)
    w0 = first // 64
    counts = np.where(end > first, (end - 1) // 64 - w0 + 1, 0)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        q = np.repeat(np.arange(lo, hi), counts[lo:hi])
        begin = np.repeat(np.cumsum(counts[lo:hi]) - counts[lo:hi], counts[lo:hi])
        w = w0[q] + np.arange(len(q)) - begin
        q, w, lanes = _close_words(fps, planes, q, w, radius)
        if len(q):
            hit = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            pair, lane = np.nonzero(hit)
            i, j = q[pair], w[pair] * 64 + lane
            ok = (j >= first[i]) & (j < end[i])
            yield i[ok], j[ok]
        lo = hi


def forest(fps: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, as (index, smallest index reachable)."""
    label = np.arange(len(fps))
    for i, j in links(fps, first, end, radius):
        open_ = label[i] != label[j]
        if open_.any():
            merged = local_labels(len(fps), np.concatenate((np.arange(len(fps)), i[open_])), np.concatenate((label, j[open_])))
            label = merged
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return moved, label[moved]


def choices(radius: int, n: int) -> tuple[int, list[int]]:
    """(number of agreeing groups, bit masks) so that buckets hold a few thousand of ``n`` fingerprints on average."""
    for j in range(1, 5):
        groups = radius + j
        if n / 2.0 ** (64 * j // groups) <= 4096 or j == 4:
            break
    edges = [64 * k // groups for k in range(groups + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(groups)]
    return j, [sum(parts[k] for k in some) for some in combinations(range(groups), j)]


def fingerprint_components(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fps(fp): distinct fingerprints. (node, component) for those with a neighbour within the radius."""
    n = fps.count()
    _, masks = choices(radius, n)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*map(F.lit, signed))).alias("m", "mask")).select("fp", "m", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"))
    large = keyed.groupBy("m", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > tile).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    large = stored(large, "large")
    # each large bucket holds over ``tile`` rows, so there are at most masks * n / tile of them
    few = large.count() <= 100_000
    told = keyed.join(F.broadcast(large) if few else large, ["m", "bucket"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    told = told.withColumn("tile", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    told = told.select("m", "bucket", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "fp")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // 500_000)
    dealt = told.repartition(parts, "m", "bucket", "ta", "tb").sortWithinPartitions("m", "bucket", "ta", "tb", "fp")

    def compare(m: np.ndarray, keys: list[np.ndarray], fp: np.ndarray) -> pa.RecordBatch:
        new = np.zeros(len(fp), bool)
        new[:1] = True
        for k in (m, *keys):
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        end = np.repeat(np.append(starts[1:], len(fp)), np.diff(np.append(starts, len(fp))))
        at, root = forest(fp.view(np.uint64), np.arange(1, len(fp) + 1), end, radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            same = np.ones(len(held[0]), bool)
            for k in held[:4]:
                same &= k == k[-1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last bucket may go on
            if cut >= 4096:
                yield compare(held[0][:cut], [k[:cut] for k in held[1:4]], held[4][:cut])
                held = [k[cut:] for k in held]
        if held is not None and len(held[0]):
            yield compare(held[0], held[1:4], held[4])

    found = dealt.mapInArrow(tidy(run), "a long, b long")
    return components(found.distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = 4, text: str = "text", id_col: str = "doc_id", tile: int = TILE) -> DataFrame:
    """Per document: id, fp (long), component_id (smallest id reachable)."""
    all_ = stored(fingerprints(docs, words, text, id_col), "fingerprints")
    distinct = stored(all_.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    grouped = stored(fingerprint_components(distinct.select("fp"), radius, tile).toDF("fp", "component"), "components")
    named = stored(distinct.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    drop_all(distinct, grouped)
    # one fingerprint or component may hold a third of all rows
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    by_fp = dealt_join(named.drop("least"), least, "component", ["fp"], "fps").drop("component")
    return dealt_join(all_, stored(by_fp, "by_fp"), "fp", ["id"]).select(F.col("id").alias(id_col), "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, found: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of each component of found(id, mark, component) the row of smallest id (null last, then by mark) stays."""
    id_, mark = free_names(docs, "id", "mark")
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("mark").alias("mark"))
    best = stored(found.groupBy("component").agg(F.min(place).alias("best"), F.count("*").alias("n")).where("n > 1"), "best")
    told = dealt_join(found, best, "component", [id_col, "mark"]).select(F.col(id_col).alias(id_), F.col("mark").alias(mark), (place == F.col("best")).alias("is_best"))
    told = stored(told.groupBy(id_, mark).agg(F.max("is_best").alias("is_best"), F.count("*").alias("n")).where("NOT is_best OR n > 1").drop("n"), "told")
    drop_stored(best)
    few = told.count() <= BROADCAST_ROWS  # else the texts are shuffled by id

    def rows(which: DataFrame, how: str) -> DataFrame:
        same = F.col(id_col).eqNullSafe(F.col(id_)) & (text_mark(text) == F.col(mark))
        which = which.select(id_, mark)
        return docs.join(F.broadcast(which) if few else which, same, how)

    again = rows(told.where("is_best"), "left_semi")  # rows of one id and one text: as one
    once = again.withColumn(mark, text_mark(text)).dropDuplicates([id_col, mark])
    return rows(told, "left_anti").unionByName(once.select(*docs.columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest id. SimHash of five-word shingle sets in 256
    bits finds the pairs, whole sets verify them at 0.8 (``near_copies``; not op7's 4 of 64 bits). Decided row by row: rows
    of equal ids and different texts are different documents."""
    return one_of_each_group(docs, near_copies(docs))
