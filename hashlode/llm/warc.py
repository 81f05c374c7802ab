r"""WARC archives: written with the text writer, read back in splits with boundary-chain verification.

Writing: one record per row. Of rows with equal payloads of at least ``revisit_from`` bytes the one of largest id
becomes a response, the others revisit it; smaller payloads are all responses. A record ends with CR LF CR LF, which
is the writer's line separator, so Spark's commit protocol writes the archives and a repeated task leaves no halves.

Reading: the text reader cuts the files at the magic line, in splits of any size. Within a split a task knows the
relative place of each piece; the lengths of the splits before it, summed per file, make that an offset. Each piece
is a candidate record with its successor: offset + header + Content-Length + 4. Magic inside a payload makes false
candidates; pointer jumping from offset 0 of every file, doubling each round, keeps the reachable ones only: in numpy
within a split, by joins across splits, where only a chain's entry to a split and its end there take part.
Records whose payload was cut by such magic are put together from the pieces they span.

Null payloads are empty ones. Null ids are written without an id and read back as null; they never are what others
refer to. A record cut off by the end of its file gives the payload that is there. Line breaks in URLs are percent-encoded, a null URL is left out. Equal ids give one record per row. No
rows give no records. Extra columns are not stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashlode.llm.shared import drop_all, drop_stored, new_path, stored, table
from hashlode.llm.spans import tidy

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
BROADCAST_ROWS = 100_000
LONGEST = 1 << 62  # no record is longer; offsets are 64-bit numbers
STRETCH = 1 << 20  # bytes of a file in which pieces meet the records that cover them
_RECORD = "file string, block long, rel long, size long, head long, length long, kind string, id long, digest string, stated long, refers_to long, payload_bytes long, payload_digest string"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _urn(id_: Column) -> Column:
    h = F.md5(F.concat(F.lit("record "), id_.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = REVISIT_FROM) -> None:
    """One record per row of ``pages`` under ``path``."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")}
    )
    equal = rows.where(F.col("n") >= revisit_from).groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("c")).where("c > 1 AND original IS NOT NULL")
    equal = stored(equal.drop("c"), "equal")
    few = equal.count() <= BROADCAST_ROWS  # else the payloads are shuffled by digest
    told = rows.join(F.broadcast(equal) if few else equal, "digest", "left")
    # of rows that share the largest id, every one is a response
    revisit = F.coalesce((F.col("n") >= revisit_from) & ~F.col("original").eqNullSafe(F.col("id")) & F.col("original").isNotNull(), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    http = F.when(revisit, F.lit("")).otherwise(http)
    url_line = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    original = F.when(revisit, F.col("original"))
    head = F.concat(
        F.lit(MAGIC), F.when(revisit, "WARC-Type: revisit\r\n").otherwise("WARC-Type: response\r\n"), _line("WARC-Record-ID", _urn(F.coalesce(F.col("id").cast("string"), F.col("digest")))),
        F.lit(f"WARC-Date: {DATE}\r\n"), _line("WARC-Target-URI", url_line), F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n").otherwise(""), _line("WARC-Refers-To", _urn(original)),
        _line("X-Refers-To-Id", original), _line("X-Row-Id", F.col("id")), _line("X-Payload-Length", F.col("n")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string"), F.lit(END), http,
    )
    record = F.concat(head.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    told.select(record.cast("string").alias("value")).write.option("lineSep", END).text(path)


def _fields(piece: bytes) -> tuple[int | None, dict[bytes, bytes]]:
    """Where the header ends in the piece, and its fields; None if it is no header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None, {}
    found = dict(x.split(b": ", 1) for x in piece[:end].split(b"\r\n") if b": " in x)
    length = _number(found.get(b"Content-Length"))
    return (end + 4, found) if length is not None and 0 <= length < LONGEST and b"WARC-Type" in found else (None, {})


def _number(value: bytes | None) -> int | None:
    """A decimal number of 64 bits, else null: a payload that looks like a header may state anything."""
    if not value or len(value) > 20 or not value.removeprefix(b"-").isdigit():
        return None
    return n if -(1 << 63) <= (n := int(value)) < 1 << 63 else None


def _payload(kind: bytes, block: bytes) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4 :] if kind == b"response" else b""


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, rel = None, 0
    for batch in batches:
        rows = []
        for value, file, block in zip(*(batch.column(i) for i in range(3)), strict=True):
            piece, place = value.as_py(), (file.as_py(), block.as_py())
            if place != at:
                at, rel = place, 0
            size = len(piece) + len(MAGIC)
            head, found = _fields(piece)
            row = [*place, rel, size] + [None] * 9
            if head is not None:
                length, kind = int(found[b"Content-Length"]), found[b"WARC-Type"]
                row[4:11] = [head, length, kind.decode("latin-1"), _number(found.get(b"X-Row-Id")), found.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha1:").decode("latin-1"), _number(found.get(b"X-Payload-Length")), _number(found.get(b"X-Refers-To-Id"))]
                if head + length <= len(piece):
                    payload = _payload(kind, piece[head : head + length])
                    row[11:] = [len(payload), hashlib.sha1(payload).hexdigest()]
            rows.append(row)
            rel += size
        names = [x.split()[0] for x in _RECORD.split(", ")]
        types = [pa.string() if x.endswith("string") else pa.int64() for x in _RECORD.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def reachable(links: DataFrame, start: int = 0) -> DataFrame:
    """links(file, offset, next): the offsets reachable from ``start`` in each file, by pointer jumping."""
    jump = stored(links.where("next IS NOT NULL"), "jump")
    reached = stored(links.where(F.col("offset") == start).select("file", "offset").distinct(), "reached")
    known = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        ahead = ahead.join(links.select("file", "offset"), ["file", "offset"], "left_semi")
        after = stored(reached.union(ahead).distinct(), "reached")
        drop_stored(reached)
        reached = after
        now = reached.count()
        if now == known:
            return reached
        known = now
        second = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("then"))
        doubled = stored(jump.join(second, ["file", "next"]).select("file", "offset", F.col("then").alias("next")), "jump")
        drop_stored(jump)
        jump = doubled


def _successors(offset: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Index of the candidate at next_[i], or the one past the end if none is there. ``offset`` ascends."""
    at = np.searchsorted(offset, next_)
    there = at < len(offset)
    there[there] = offset[at[there]] == next_[there]
    return np.where(there, at, len(offset))


def chain_ends(offset: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Per candidate of a split, the successor of the last one of its chain within the split, by pointer jumping."""
    n = len(offset)
    to = np.append(_successors(offset, next_), n)
    last = np.where(to < n, to, np.arange(n + 1))  # a chain's last candidate points at itself
    while not np.array_equal(last[last], last):
        last = last[last]
    return next_[last[:n]]


def chain_marks(offset: np.ndarray, next_: np.ndarray, entered: np.ndarray) -> np.ndarray:
    """Per candidate of a split, whether a chain from one of the ``entered`` passes it, by pointer jumping."""
    n = len(offset)
    to, marks = np.append(_successors(offset, next_), n), np.append(entered, False)
    while (to < n).any():
        marks[to[marks]] = True
        to = to[to]
    return marks[:n]


def _by_split(rows: DataFrame, added: Callable[..., np.ndarray], *columns: str, name: str, type_: str) -> DataFrame:
    """``rows`` with one more column, computed from ``columns`` of a split's rows in order of offset; a split bounds them."""

    def run(split: pa.Table) -> pa.Table:
        split = split.sort_by("offset")
        return split.append_column(name, pa.array(added(*(split[c].to_numpy() for c in columns))))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy("file", "block").applyInArrow(run, f"{types}, {name} {type_}")


def verified(records: DataFrame) -> DataFrame:
    """The candidates among ``records`` (file, block, offset, next, ...) that are reachable from the start of their file.

    Chains are first followed within each split. Only candidates that a chain from another split ends at, and those at
    offset 0, take part in the pointer jumping across splits: a few for each split. From those reached the chains of each
    split are followed again.
    """
    links = records.select("file", "block", "offset", "next")
    ends = stored(_by_split(links, chain_ends, "offset", "next", name="exit", type_="long"), "chains")
    entries = ends.select("file", F.col("exit").alias("offset")).distinct()
    entries = ends.select("file", "offset", F.col("exit").alias("next")).join(entries.withColumn("met", F.lit(True)), ["file", "offset"], "left")
    entries = stored(entries.where("met OR offset = 0").drop("met"), "entries")
    reached = reachable(entries)
    told = ends.drop("exit").join(reached.withColumn("met", F.lit(True)), ["file", "offset"], "left").withColumn("entered", F.coalesce("met", F.lit(False))).drop("met")
    passed = _by_split(told, chain_marks, "offset", "next", "entered", name="passed", type_="boolean")
    passed = stored(passed.where("passed").select("file", "offset"), "passed")
    drop_all(ends, entries, reached)
    return records.join(passed, ["file", "offset"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per verified record: file, offset, record_type, id, payload_bytes, payload_digest, refers_to.

    A revisit's payload length and digest are those it states.
    """
    found = stored(_pieces(spark, path).mapInArrow(tidy(_read_pieces), _RECORD), "pieces")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("file", "block").agg(F.sum("size").alias("s"))
    base = base.withColumns({"base": F.coalesce(F.sum("s").over(before), F.lit(0)), "total": F.sum("s").over(Window.partitionBy("file"))}).drop("s")
    base = stored(base, "splits")
    few = base.count() <= BROADCAST_ROWS
    placed = found.join(F.broadcast(base) if few else base, ["file", "block"]).withColumn("offset", F.col("base") + F.col("rel") - len(MAGIC))
    end = F.col("offset") + len(MAGIC) + F.col("head") + F.col("length")
    records = placed.where("head IS NOT NULL AND offset >= 0").withColumn("next", end + len(END))
    kept = stored(verified(records), "records")
    whole = kept.where("payload_digest IS NOT NULL")
    cut = kept.where("payload_digest IS NULL")
    columns = ["file", "offset", "kind", "id", "stated", "digest", "refers_to", "payload_bytes", "payload_digest"]
    out = whole.select(*columns)
    if cut.limit(1).count():
        out = out.union(_mend(spark, path, base, cut).select(*columns))
    revisit = F.col("kind") == "revisit"
    return out.select(
        "file", "offset", F.col("kind").alias("record_type"), "id", F.when(revisit, F.col("stated")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), F.when(revisit, F.col("refers_to")).alias("refers_to"),
    )


def _mend(spark: SparkSession, path: str, base: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose block holds the magic: their pieces in order, joined by it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel = None, 0
        for batch in batches:
            rels = []
            for value, file, block in zip(*(batch.column(i) for i in range(3)), strict=True):
                if (file.as_py(), block.as_py()) != at:
                    at, rel = (file.as_py(), block.as_py()), 0
                rels.append(rel)
                rel += len(value.as_buffer()) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rels, pa.int64())], names=["value", "file", "block", "rel"])

    pieces = _pieces(spark, path).mapInArrow(tidy(place), "value binary, file string, block long, rel long")
    pieces = pieces.join(base, ["file", "block"]).select("file", "value", (F.col("base") + F.col("rel") - len(MAGIC)).alias("piece"))
    # a record meets the pieces of the stretches of its file that it covers, not all of the file
    stretch = lambda at: F.floor(at / STRETCH).cast("long")
    spans = cut.drop("payload_bytes", "payload_digest").withColumn("part", F.explode(F.sequence(stretch(F.col("offset")), stretch(F.least("next", "total")))))
    pieces = pieces.withColumn("part", stretch(F.col("piece")))
    joined = spans.join(pieces, ["file", "part"]).where("piece >= offset AND piece < next")
    keys = ["file", "offset", "head", "length", "kind", "id", "stated", "digest", "refers_to"]
    parts = joined.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("piece", "value"))).alias("parts"))  # one record's own bytes

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for row in batch.select(["head", "length", "kind", "parts"]).to_pylist():
                body = MAGIC.encode().join(p["value"] for p in row["parts"])
                payload = _payload(row["kind"].encode(), body[row["head"] : row["head"] + row["length"]])
                sizes.append(len(payload))
                digests.append(hashlib.sha1(payload).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=[*keys, "payload_bytes", "payload_digest"])

    types = {f.name: f.dataType.simpleString() for f in parts.schema}
    return parts.mapInArrow(tidy(assemble), ", ".join(f"{k} {types[k]}" for k in keys) + ", payload_bytes long, payload_digest string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: pages to archives and back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), s AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), o AS (
  SELECT payload_digest, max(page_id) AS original FROM s WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT s.page_id, s.payload_bytes, s.payload_digest,
       CASE WHEN o.original IS NOT NULL AND o.original <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.original <> s.page_id THEN o.original END AS refers_to
FROM s LEFT JOIN o ON s.payload_digest = o.payload_digest AND s.payload_bytes >= 1000
"""
