"""Exact set-similarity joins, used by line dedup and by the join on shingles.

A set is a class (64-bit hash) with its size, a count signature and its prefix: of n words in order of rarity, the first
n - ceil(t n) + 1, of which two sets of Jaccard similarity t share one (prefix filter). Classes meet under prefix words.
Pairs that meet are dropped if sizes differ too much (length filter), if too few words follow (positional filter), or if
signatures differ by more than the sets may in words. What is left links classes into candidate groups; tasks pass on
spanning forests of it, never pairs. Every similar pair is within one group, and is verified there on whole sets.

The index crosses the shuffle in packs: the entries of a task for one range of words, as columns in one binary value.
Words of more than ``tile`` classes (by hash bucket) are cut into tiles, whose pairs meet in different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashlode.llm.graph import components, local_labels
from hashlode.llm.shared import broadcast_if_small, drop_stored, stored
from hashlode.llm.spans import mix, tidy

BITS = 18
BUCKETS = 1 << BITS
TILE = 1 << 15
INDEX_ROWS = 250_000
PACK_ROWS = 1 << 18
PAIRS_AT_ONCE = 1 << 18
COLUMNS_AT_ONCE = 1 << 12
CHUNK = 1 << 12
SMALL_GROUP = 48
TILE_WORDS = 1 << 21
PRODUCTS_AT_ONCE = 1 << 19
_ENTRY = (("word", "<u8"), ("cls", "<i8"), ("bits", "<u8"), ("bits2", "<u8"), ("size", "<i4"), ("pos", "<i4"))
_ENTRY_BYTES = sum(np.dtype(t).itemsize for _, t in _ENTRY)


def bucket_counts(rows: DataFrame, counted: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int = BUCKETS, kinds: int = 1) -> np.ndarray:
    """(kinds, size): how often each bucket comes, over all rows. ``counted`` gives arrays of kind * size + bucket.

    A task passes on its sums in chunks of ``CHUNK`` buckets, which are added by chunk; ``size`` bounds what returns.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(kinds * size, np.int64)
        for batch in batches:
            for at in counted(batch):
                sums += np.bincount(at, minlength=kinds * size)
        for c in range(0, kinds * size, CHUNK):
            part = sums[c : c + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(part, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "sums"])

    chunks = rows.mapInArrow(tidy(count), "chunk int, sums binary").repartition(min(-(-kinds * size // CHUNK), 32), "chunk").mapInArrow(tidy(add), "chunk int, sums binary").toArrow()
    out = np.zeros(kinds * size, np.int64)
    for c, part in zip(chunks["chunk"].to_pylist(), chunks["sums"].to_pylist(), strict=True):
        out[c * CHUNK : c * CHUNK + len(part) // 8] = np.frombuffer(part, np.int64)
    return out.reshape(kinds, size)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def rarity(counts: np.ndarray) -> np.ndarray:
    """The order of buckets in 10 bits: rarer ones first, by the logarithm of their count."""
    return np.minimum(np.log2(counts + 1.0) * 25, 1023).astype(np.uint64)


def prefix_size(size: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    num, den = threshold
    return size - -(-size * num // den) + 1


def class_hash(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One hash for each set of the flat word hashes, whatever their order."""
    return mix(np.add.reduceat(mix(h ^ np.uint64(0x5BD1E995)), first) + size.astype(np.uint64))


def signature(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thirty-two counts modulo 16, in two words: how many words of each set fall in each of 32 hash groups."""
    row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    counts = np.bincount(row * 32 + (h & np.uint64(31)).astype(np.int64), minlength=len(first) * 32).reshape(-1, 32).astype(np.uint64) & np.uint64(15)
    place = np.uint64(4) * np.arange(16, dtype=np.uint64)
    return (counts[:, :16] << place).sum(axis=1, dtype=np.uint64), (counts[:, 16:] << place).sum(axis=1, dtype=np.uint64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least so many words are in one set only: the sum of the circular distances of the counts."""
    low, one, total = np.uint64(0x0F0F0F0F0F0F0F0F), np.uint64(0x0101010101010101), 0
    for shift in (np.uint64(0), np.uint64(4)):
        d = (((a >> shift) & low) + np.uint64(0x1010101010101010) - ((b >> shift) & low)) & low
        over = (d >> np.uint64(3)) & one
        total = total + ((((d ^ (over * np.uint64(15))) + over) * one) >> np.uint64(56)).astype(np.int64)
    return total


def survivors(word: np.ndarray, size: np.ndarray, pos: np.ndarray, bits: np.ndarray, bits2: np.ndarray, threshold: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, that pass the filters under one word. Rows are sorted by (word, size)."""
    num, den = threshold
    n = len(word)
    group = np.cumsum(np.concatenate(([0], (word[1:] != word[:-1]).astype(np.int64)))) if n else np.zeros(0, np.int64)
    wide = int(size.max(initial=0)) + 2
    end = np.searchsorted(group * wide + size, group * wide + np.minimum(size * den // num, wide - 1), side="right")  # length filter
    counts = end - np.arange(n) - 1
    ends = np.cumsum(counts)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        c = counts[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        total = size[i] + size[j]
        need = -(-num * total // (num + den))
        ok = np.flatnonzero(np.minimum(size[i] - pos[i], size[j] - pos[j]) >= need)  # positional filter
        i, j, most = i[ok], j[ok], (total - 2 * need)[ok]
        far = apart(bits[i], bits[j])
        ok = np.flatnonzero(far <= most)
        i, j, most, far = i[ok], j[ok], most[ok], far[ok]
        ok = far + apart(bits2[i], bits2[j]) <= most
        yield i[ok], j[ok]
        lo = hi


def packed_index(classes: DataFrame, counts: np.ndarray, tile: int, packs: int) -> DataFrame:
    """classes(cls, size, bits, bits2, prefix): (pack, entries), an entry for each prefix word and class.

    Words of several tiles are keyed by pairs of tiles. ``counts``: prefix words by bucket.
    """
    shared = classes.sparkSession.sparkContext.broadcast(counts)  # BUCKETS numbers: bounded

    def entries(batch: pa.RecordBatch, counts: np.ndarray) -> list[np.ndarray]:
        prefix = batch.column(4)
        n = np.diff(prefix.offsets.to_numpy())
        word = prefix.flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(batch.num_rows), n)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        cls = batch.column(0).to_numpy()
        tiles = np.maximum(-(-counts[bucket(word)] // tile), 1)
        many = np.flatnonzero(tiles > 1)
        if len(many):
            k = tiles[many]
            mine = np.repeat((mix(cls[row[many]].view(np.uint64)) % k.astype(np.uint64)).astype(np.int64), k)
            other = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            at = np.repeat(many, k)
            t = np.minimum(mine, other) * np.repeat(k, k) + np.maximum(mine, other) + 1
            keyed = mix(word[at] + t.astype(np.uint64))
            one = tiles == 1
            word, row, pos = np.concatenate((word[one], keyed)), np.concatenate((row[one], row[at])), np.concatenate((pos[one], pos[at]))
        return [word, cls[row], batch.column(2).to_numpy()[row], batch.column(3).to_numpy()[row], batch.column(1).to_numpy()[row], pos]

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x).view(t) if np.dtype(t).itemsize == 8 else np.concatenate(x).astype(t) for (_, t), x in zip(_ENTRY, zip(*held, strict=True), strict=True)]
        pack = (columns[0] % np.uint64(packs)).astype(np.int64)
        order = np.argsort(pack, kind="stable")
        columns, pack = [c[order] for c in columns], pack[order]
        starts = np.flatnonzero(np.diff(pack, prepend=-1))
        ends = np.append(starts[1:], len(pack))
        for lo in range(0, len(starts), 1024):
            data = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(starts[lo : lo + 1024], ends[lo : lo + 1024], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(pack[starts[lo : lo + 1024]]), pa.array(data, pa.binary())], names=["pack", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, n = shared.value, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(entries(batch, counts))
                n += len(held[-1][0])
            if n >= PACK_ROWS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return classes.select("cls", "size", "bits", "bits2", "prefix").mapInArrow(tidy(run), "pack long, entries binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in _ENTRY]
    for batch in batches:
        for x in batch.column(1):
            data, at = x.as_buffer(), 0
            n = len(data) // _ENTRY_BYTES
            for held, (_, t) in zip(parts, _ENTRY, strict=True):
                held.append(np.frombuffer(data, t, n, at))
                at += n * np.dtype(t).itemsize
    return {name: np.concatenate(x) if x else np.zeros(0, t) for (name, t), x in zip(_ENTRY, parts, strict=True)}


def candidate_links(index: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): per task a spanning forest of the pairs that pass the filters. A pack's entries are together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        col = unpacked(batches)
        if not len(col["word"]):
            return
        order = np.lexsort((col["cls"], col["size"], col["word"]))
        w, c = col["word"][order], col["cls"][order]
        fresh = np.concatenate(([True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])))
        order, w = order[fresh], w[fresh]
        new = np.concatenate(([True], w[1:] != w[:-1], [True]))
        order = order[~(new[:-1] & new[1:])]  # a word of one class only links nothing
        col = {k: v[order].astype(np.int64) if k in ("size", "pos") else v[order] for k, v in col.items()}
        names, node = np.unique(col["cls"], return_inverse=True)
        label = np.arange(len(names))
        held: list[np.ndarray] = []
        for i, j in survivors(*(col[k] for k in ("word", "size", "pos", "bits", "bits2")), threshold):
            a, b = node[i], node[j]
            open_ = label[a] != label[b]
            held.append(np.stack((a[open_], b[open_])))
            if sum(x.shape[1] for x in held) > PAIRS_AT_ONCE:
                label, held = merged(label, *np.concatenate(held, axis=1)), []
        if held:
            label = merged(label, *np.concatenate(held, axis=1))
        yield forest(names, label)

    return index.mapInArrow(tidy(run), "a long, b long")


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest node reachable) once the links (a, b) are added."""
    if not len(a):
        return label
    return local_labels(len(label), np.concatenate((np.arange(len(label)), a)), np.concatenate((label, b)))


def forest(names: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], names=["a", "b"])


def candidate_groups(classes: DataFrame, threshold: tuple[int, int], tile: int = TILE) -> DataFrame:
    """Stored (cls, component): the classes that some other may be similar to. classes(cls, size, bits, bits2, prefix)."""

    def words(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield bucket(batch.column(0).flatten().to_numpy().view(np.uint64))

    counts = bucket_counts(classes.select("prefix"), words)[0]
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // INDEX_ROWS)
    index = packed_index(classes, counts, tile, parts).repartitionById(parts, F.col("pack").cast("int"))
    links = stored(candidate_links(index, threshold).distinct(), "links")
    found = stored(components(links).toDF("cls", "component"), "candidates")
    drop_stored(links)
    return found


def alike_pairs(group: np.ndarray, size: np.ndarray, flat: np.ndarray, threshold: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of similar sets of the same group. Rows come group by group, ``size`` values each in ``flat``."""
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(group))
    first = np.append(0, np.cumsum(size))
    small = ends - starts <= SMALL_GROUP
    cost = np.where(small, (ends - starts) * (first[ends] - first[starts]), 0)
    slices = np.cumsum(cost) // PRODUCTS_AT_ONCE
    for s in np.unique(slices[small]) if small.any() else ():
        of = np.flatnonzero(small & (slices == s))
        rows = np.concatenate([np.arange(a, b) for a, b in zip(starts[of], ends[of], strict=True)])
        yield from _by_products(rows, group, size, flat, first, threshold)
    for a, b in zip(starts[~small], ends[~small], strict=True):
        i, j = _by_matrix(size[a:b], flat[first[a] : first[b]], threshold)
        yield i + a, j + a


def _by_products(rows: np.ndarray, group: np.ndarray, size: np.ndarray, flat: np.ndarray, first: np.ndarray, threshold: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that hold the same value of the same group, counted."""
    num, den = threshold
    n = size[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    value = flat[np.repeat(first[rows], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]
    g = group[rows][owner]
    order = np.lexsort((owner, value, g))
    owner, value, g = owner[order], value[order], g[order]
    begin = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (g[1:] != g[:-1]))) if len(value) else np.zeros(0, bool))
    end = np.repeat(np.append(begin[1:], len(value)), np.diff(np.append(begin, len(value))))
    later = end - np.arange(len(value)) - 1
    i = np.repeat(owner, later)
    j = owner[np.repeat(np.arange(len(value)), later) + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)]
    pair, shared = np.unique(i * len(rows) + j, return_counts=True)
    i, j = rows[pair // len(rows)], rows[pair % len(rows)]
    ok = shared * (num + den) >= num * (size[i] + size[j])
    yield i[ok], j[ok]


def _by_matrix(size: np.ndarray, flat: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    num, den = threshold
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    _, value, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = times > 1
    kept = np.flatnonzero(common[value])
    value, owner = (np.cumsum(common) - 1)[value[kept]], owner[kept]
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    shared = np.zeros((n, n), np.int64)
    for lo in range(0, int(common.sum()), COLUMNS_AT_ONCE):
        a, b = np.searchsorted(value, (lo, lo + COLUMNS_AT_ONCE))
        part = np.zeros((n, min(COLUMNS_AT_ONCE, int(common.sum()) - lo)), np.float32)  # sums up to COLUMNS_AT_ONCE are exact
        part[owner[a:b], value[a:b] - lo] = 1
        shared += (part @ part.T).astype(np.int64)
    return np.nonzero(np.triu(shared * (num + den) >= num * (size[:, None] + size[None, :]), 1))


def key_groups(batches: Iterator[pa.RecordBatch], keys: int, least: int = 4096) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(number of the key of each row, rows): whole keys (the first columns), several together; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        number = _key_numbers(all_, keys)
        cut = int(np.searchsorted(number, number[-1]))  # the last key may go on
        if cut:
            yield number[:cut], all_.slice(0, cut)
        held = [all_.slice(cut)]
    if held:
        all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield _key_numbers(all_, keys), all_


def _key_numbers(rows: pa.RecordBatch, keys: int) -> np.ndarray:
    new = np.zeros(rows.num_rows, np.int64)
    for c in range(keys):
        k = rows.column(c).to_numpy(zero_copy_only=False)
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def tiles_of(groups: DataFrame, tile: int) -> DataFrame:
    """groups(component, size, ...) with tiles: into how many its component is cut, by classes and by words."""
    cuts = F.ceil(F.greatest(F.count("*") / tile, F.sum("size") / TILE_WORDS)).cast("int")
    large = groups.groupBy("component").agg(cuts.alias("tiles")).where("tiles > 1")
    return groups.join(broadcast_if_small(large), "component", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
