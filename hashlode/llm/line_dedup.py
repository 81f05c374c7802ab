r"""Line dedup by an exact set-similarity join.

A line (of a text cut at "\n") is the set of its words ``[^\x20\x09-\x0D]+``. A line goes if an earlier line, by
(document id, line number), has Jaccard similarity of at least ``threshold`` with it; equal sets have 1. Lines of
equal sets are one class, at the place of its earliest line. Words are ordered by rarity, from counts over all documents
in a fixed number of hash buckets (any one order is exact; rarity makes it fast). Classes are joined by ``set_join``:
prefix, length and positional filters and signatures link them into candidate groups, which hold every similar pair.

Then the whole word sets of those classes are fetched, and each group is verified by exact Jaccard similarity. A class
needs one earlier match only: groups of over ``tile`` classes are cut into tiles; within its tile most later classes
find a match, and only those still open meet the other tiles. A class is sent once more for each tile it is compared
with, so rows grow with the classes, and with the open ones of very large groups; never with pairs.

Lines without a word and rows of null id take no part and stay. Null text stays null. Rows of equal id hold their
lines at the same place: neither is the earlier one. No documents give no rows. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashlode.llm.set_join import TILE as WORD_TILE
from hashlode.llm.set_join import BUCKETS, alike_pairs, bucket, bucket_counts, candidate_groups, class_hash, key_groups, prefix_size, rarity, signature, tiles_of
from hashlode.llm.shared import drop_all, drop_stored, free_names, stored, table
from hashlode.llm.spans import blocks, flat_words, mix, tidy

THRESHOLD = (4, 5)  # 0.8
TILE = 1 << 10
MOST_SPOT_BITS = 27
PIECE_BYTES = 1 << 20
LINES_AT_ONCE = 1 << 16
_LINES = "doc {id}, line int, cls long, size int, bits long, bits2 long, prefix array<long>"


def _payloads(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def word_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Occurrences of words by hash bucket, over all documents."""

    def counted(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, held in blocks(_payloads(batch.column(0))):
            yield bucket(flat_words(b" ".join(held) + b" ")[0])

    return bucket_counts(docs.select(text), counted)[0]


def pieces(payloads: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Payloads cut at line ends to bounded size: (pieces, payload of each, number of its first line)."""
    out, owner, number = [], [], []
    for i, p in enumerate(payloads):
        lo = line = 0
        while True:
            cut = p.find(b"\n", lo + PIECE_BYTES) if len(p) - lo > PIECE_BYTES else -1
            part = p[lo:cut] if cut >= 0 else p[lo:]
            out.append(part)
            owner.append(i)
            number.append(line)
            if cut < 0:
                break
            line += part.count(b"\n") + 1
            lo = cut + 1
    return out, np.array(owner, np.int64), np.array(number, np.int64)


class Sets:
    """Word sets of the lines of a block of pieces, flat and in order of rarity within a line."""

    def __init__(self, held: list[bytes], rare: np.ndarray, owner: np.ndarray, number: np.ndarray):
        data = b"\n".join(held) + b"\n"
        h, starts, _ = flat_words(data)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        line = np.searchsorted(breaks, starts)
        r = rare[bucket(h)]
        # 22 bits of line, 10 of rarity, 32 of hash; ties of the last 32 are mended by the whole hash
        key = (line.astype(np.uint64) << np.uint64(42)) | (r << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        key, h, line = key[order], h[order], line[order]
        if len(h) and ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
            again = np.lexsort((h, key))
            h, line = h[again], line[again]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.h, line = h[new], line[new]
        self.first = np.flatnonzero(np.diff(line, prepend=-1))  # of each line that has words
        self.size = np.diff(np.append(self.first, len(line)))
        line = line[self.first]
        begin = np.cumsum([0, *(p.count(b"\n") + 1 for p in held)])
        piece = np.searchsorted(begin, line, side="right") - 1
        self.owner = owner[piece]
        self.number = line - begin[piece] + number[piece]


def _sets(column: pa.Array, rare: np.ndarray) -> Iterator[Sets]:
    cut, owner, number = pieces(_payloads(column))
    for first, held in blocks(cut):
        s = Sets(held, rare, owner[first : first + len(held)], number[first : first + len(held)])
        if len(s.first):
            yield s


def _dense(values: pa.Array) -> np.ndarray:
    """Ranks of the values, equal ones alike."""
    return pc.rank(values, sort_keys="ascending", tiebreaker="dense").to_numpy()


def line_sets(docs: DataFrame, counts: np.ndarray, threshold: tuple[int, int] = THRESHOLD, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per line with words: doc, line, cls (hash of the set), size, bits, and, once per class and block of lines, under
    its earliest line there, the prefix words."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity(counts))  # BUCKETS numbers: bounded
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        held: list[list] = [[] for _ in range(7)]
        docs_, lines, classes, sizes, low, high, words = held
        for batch in batches:
            for s in _sets(batch.column(1), rare):
                classes.append(class_hash(s.h, s.first, s.size))
                for kept, found in zip((low, high), signature(s.h, s.first), strict=True):
                    kept.append(found)
                place = np.arange(len(s.h)) - np.repeat(s.first, s.size)
                words.append(s.h[place < np.repeat(prefix_size(s.size, threshold), s.size)])
                docs_.append(batch.column(0).take(pa.array(s.owner)))
                lines.append(s.number)
                sizes.append(s.size)
            if sum(map(len, lines)) >= LINES_AT_ONCE:
                yield from rows(*held)
                for x in held:
                    x.clear()
        if docs_:
            yield from rows(*held)

    def rows(docs_: list, lines: list, classes: list, sizes: list, low: list, high: list, words: list) -> Iterator[pa.RecordBatch]:
        doc, line, cls, size, bits, bits2, flat = pa.concat_arrays(docs_), *map(np.concatenate, (lines, classes, sizes, low, high, words))
        order = np.lexsort((line, _dense(doc), cls))
        lead = np.zeros(len(cls), bool)
        lead[order] = np.concatenate(([True], cls[order][1:] != cls[order][:-1]))
        ends = np.cumsum(prefix_size(size, threshold))
        for lo in range(0, len(cls), 20_000):
            hi = min(lo + 20_000, len(cls))
            begin = int(ends[lo - 1]) if lo else 0
            offsets = pa.array(np.concatenate(([0], ends[lo:hi] - begin)).astype(np.int32))
            prefix = pa.ListArray.from_arrays(offsets, pa.array(flat[begin : int(ends[hi - 1])].view(np.int64)), mask=pa.array(~lead[lo:hi]))
            yield pa.RecordBatch.from_arrays(
                [doc.slice(lo, hi - lo), pa.array(line[lo:hi].astype(np.int32)), pa.array(cls[lo:hi].view(np.int64)), pa.array(size[lo:hi].astype(np.int32)), pa.array(bits[lo:hi].view(np.int64)), pa.array(bits2[lo:hi].view(np.int64)), prefix],
                names=["doc", "line", "cls", "size", "bits", "bits2", "prefix"],
            )

    return docs.where(F.col(id_col).isNotNull()).select(id_col, text).mapInArrow(tidy(run), _LINES.format(id=id_type))


def _bits_of(rows: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits over the hashes in column h."""
    spot = F.shiftrightunsigned("h", 64 - bits)
    word = rows.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - bits}) & 63 AS INT))")).alias("m")).toArrow()
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[word["w"].to_numpy()] = word["m"].to_numpy().view(np.uint64)
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(np.uint64) >> np.uint64(64 - (len(bitmap) * 64 - 1).bit_length())
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def fetch_words(docs: DataFrame, needed: DataFrame, n: int, text: str, id_col: str) -> DataFrame:
    """(doc, line, cls, words): word hashes of the ``n`` needed (doc, cls), and of what else the bitmaps let through."""
    bits = min(MOST_SPOT_BITS, max(16, (8 * n).bit_length()))  # at most 16 MB each
    h = F.xxhash64("doc")
    shared = docs.sparkSession.sparkContext.broadcast((_bits_of(needed.select(h.alias("h")), bits), _bits_of(needed.select(h.bitwiseXOR(F.col("cls")).alias("h")), bits)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = np.zeros(BUCKETS, np.uint64)
        for batch in batches:
            part = batch.take(pa.array(np.flatnonzero(_has(shared.value[0], batch.column(1).to_numpy()))))
            h = part.column(1).to_numpy()
            for s in _sets(part.column(2), rare):
                cls = class_hash(s.h, s.first, s.size).view(np.int64)
                wanted = _has(shared.value[1], h[s.owner] ^ cls)
                offsets = np.append(0, np.cumsum(s.size[wanted])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(s.owner[wanted])), pa.array(s.number[wanted].astype(np.int32)), pa.array(cls[wanted]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.h[np.repeat(wanted, s.size)].view(np.int64))),
                    ],
                    names=["doc", "line", "cls", "words"],
                )

    return docs.where(F.col(id_col).isNotNull()).select(id_col, F.xxhash64(id_col), text).mapInArrow(tidy(run), f"doc {id_type}, line int, cls long, words array<long>")


def matched_classes(sets: DataFrame, threshold: tuple[int, int], parts: int) -> DataFrame:
    """sets(component, tile, part, doc, line, cls, early, late, words): cls of the late ones that an early one of the
    same key at an earlier place is similar to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in key_groups(batches, 3):
            doc, line = rows.column(3), rows.column(4).to_numpy()
            new = np.ones(rows.num_rows, np.int64)
            new[1:] = pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False) | (line[1:] != line[:-1])
            place, words = np.cumsum(new), rows.column(8)
            early, late = (rows.column(c).to_numpy(zero_copy_only=False) for c in (6, 7))
            hit = np.zeros(rows.num_rows, bool)
            for i, j in alike_pairs(number, np.diff(words.offsets.to_numpy()).astype(np.int64), words.flatten().to_numpy(), threshold):
                hit[j[early[i] & late[j] & (place[i] < place[j]) & (number[i] == number[j])]] = True
            yield pa.RecordBatch.from_arrays([rows.column(5).filter(pa.array(hit))], names=["cls"])

    keys = ["component", "tile", "part"]
    dealt = sets.select(*keys, "doc", "line", "cls", "early", "late", "words").repartition(parts, *keys)
    return dealt.sortWithinPartitions(*keys, "doc", "line").mapInArrow(tidy(run), "cls long")


def later_classes(docs: DataFrame, classes: DataFrame, threshold: tuple[int, int], text: str, id_col: str, tile: int, word_tile: int) -> DataFrame:
    """Stored (cls): classes with a similar class at an earlier place. classes(cls, doc, line, size, bits, bits2, prefix)."""
    groups = candidate_groups(classes, threshold, word_tile)
    wanted = stored(tiles_of(groups.join(classes.select("cls", "doc", "line", "size"), "cls"), tile), "wanted")
    drop_stored(groups)
    n = wanted.count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 50_000)
    sets = fetch_words(docs, wanted, n, text, id_col).join(wanted.drop("size"), ["doc", "line", "cls"])
    mine = F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")
    sets = stored(sets.dropDuplicates(["cls"]).withColumn("tile", mine), "sets")
    yes, no = F.lit(True), F.lit(False)
    found = stored(matched_classes(sets.withColumns({"part": F.lit(0), "early": yes, "late": yes}), threshold, parts), "matched")
    if sets.where("tiles > 1").limit(1).count():
        large = sets.where("tiles > 1")
        open_ = stored(large.join(found, "cls", "left_anti"), "open")
        cuts = open_.groupBy("component").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"))
        asked = open_.join(cuts, "component").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("cuts")).cast("int"))
        asked = asked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("other != tile").drop("tile").withColumnRenamed("other", "tile")
        told = large.join(cuts, "component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        both = told.drop("cuts").withColumns({"early": yes, "late": no}).unionByName(asked.drop("cuts").withColumns({"early": no, "late": yes}))
        rest = stored(found.union(matched_classes(both, threshold, parts)).distinct(), "matched")
        drop_all(found, open_)
        found = rest
    drop_all(wanted, sets)
    return found


def later_matches(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, text: str = "text", id_col: str = "doc_id", tile: int = TILE, word_tile: int = WORD_TILE) -> DataFrame:
    """(doc, line) of every line that has an earlier match."""
    lines = stored(line_sets(docs, word_counts(docs, text), threshold, text, id_col), "lines")
    leads = lines.where("prefix IS NOT NULL").groupBy("cls").agg(F.min(F.struct("doc", "line")).alias("at"), *(F.first(c).alias(c) for c in ("size", "bits", "bits2", "prefix")))
    classes = stored(leads.select("cls", "at.doc", "at.line", "size", "bits", "bits2", "prefix"), "classes")
    slim = stored(lines.select("doc", "line", "cls"), "lines")
    drop_stored(lines)
    matched = later_classes(docs, classes, threshold, text, id_col, tile, word_tile)
    firsts = classes.select("cls", F.col("doc").alias("first_doc"), F.col("line").alias("first_line"))
    marks = firsts.join(slim.groupBy("cls").agg(F.count("*").alias("n")), "cls").join(matched.withColumn("matched", F.lit(True)), "cls", "left")
    marks = stored(marks.where("matched OR n > 1").withColumn("matched", F.coalesce("matched", F.lit(False))).drop("n"), "marks")
    drop_all(classes, matched)
    gone = slim.join(marks, "cls").where("matched OR doc != first_doc OR line != first_line")
    out = stored(gone.select("doc", "line").distinct(), "gone")
    drop_all(slim, marks)
    return out


def removed_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc, removed): ascending numbers of the lines that go, for documents that lose any."""
    return later_matches(docs, **options).groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def _without(text: pa.Array, removed: pa.Array) -> pa.Array:
    def left(t: str | None, gone: pa.ListScalar) -> str | None:
        if t is None or not gone.is_valid:
            return t
        keep = np.ones(t.count("\n") + 1, bool)
        at = gone.values.to_numpy()
        keep[at[at < len(keep)]] = False
        return "\n".join(x for x, k in zip(t.split("\n"), keep, strict=True) if k)

    return pa.array([left(t.as_py(), r) for t, r in zip(text, removed, strict=True)], pa.string())


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the lines removed from the text; all rows and other columns stay."""
    doc, removed = free_names(docs, "doc", "removed")
    gone = removed_lines(docs, text=text, id_col=id_col, **options).toDF(doc, removed)
    joined = docs.join(gone, F.col(id_col) == F.col(doc), "left")
    return joined.withColumn(text, F.arrow_udf(_without, "string")(F.col(text), F.col(removed))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: per document, the numbers of its lines that have an earlier match, over all lines of documents."""
    docs = table(spark, sf_dir, "documents")
    gone = removed_lines(docs).toDF("doc", "removed_lines")
    out = docs.select("doc_id", (F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0))).cast("long").alias("n_lines"))
    out = out.join(gone, F.col("doc_id") == F.col("doc"), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their later lines; n_chars follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
