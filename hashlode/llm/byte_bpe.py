"""Byte-level BPE encoding and decoding over Arrow batches with the tokenizers library.

A text is cut into the matches of the pre-token pattern. Every match is encoded separately, so equal matches
share their ids: each worker encodes a distinct match once (tokenizers, on byte-characters) and keeps its ids in
a bounded table. Ids of a text are the ids of its matches in order. Offsets follow from the tokens' byte lengths
and the text's byte-to-character mapping; decoding reverses the byte table, and a character split over several
tokens is put together again from their bytes.

Nulls and empty texts have no ids. A null id is kept as any other value. Very long texts are cut at pre-token
boundaries only by the pattern itself, so memory is a small multiple of the text.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hashlode.llm.shared import table
from hashlode.llm.spans import tidy

KEPT_MATCHES = 250_000
LONGEST_KEPT = 64
ROWS_AT_ONCE = 512
TOKENS_AT_ONCE = 1 << 18


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def split_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``, found by merging with lower ranks only."""
    parts = [token[i : i + 1] for i in range(len(token))]
    top = ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
        if rank >= top:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Matches(dict):
    """ids of pre-tokens as little-endian uint32 bytes; at most ``KEPT_MATCHES`` short ones are kept."""

    def __init__(self, codec: ByteBpe):
        super().__init__()
        self.codec = codec

    def __missing__(self, match: str) -> bytes:
        return self.codec.encode_matches([match])[0]


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        ranks = read_ranks(ranks_path)
        to_char = byte_characters()
        self.char_table = str.maketrans({chr(b): c for b, c in enumerate(to_char)})
        self.byte_of = np.zeros(max(map(ord, to_char)) + 1, np.uint8)  # the byte table reversed, by code point
        self.byte_of[[ord(c) for c in to_char]] = np.arange(256)
        named = lambda token: "".join(to_char[b] for b in token)
        merges = [split_of(t, ranks) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
        self.tokenizer = Tokenizer(
            BPE(vocab={named(t): r for t, r in ranks.items()}, merges=[(named(a), named(b)) for a, b in filter(None, merges)], cache_capacity=0)
        )
        self.names = {r: named(t) for t, r in ranks.items()}
        self.lengths = np.zeros(max(self.names) + 1, np.int64)
        for r, t in self.names.items():
            self.lengths[r] = len(t)  # a byte-character for each byte
        self.find = regex.compile(pattern).findall
        self.known = Matches(self)

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        byte_text = [m.encode("utf-8").decode("latin-1").translate(self.char_table) for m in matches]
        done = self.tokenizer.encode_batch_fast(byte_text, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        matches, known = self.find(text), self.known
        new = [m for m in {*matches} if m not in known and len(m) <= LONGEST_KEPT]
        if new:
            if len(known) + len(new) > KEPT_MATCHES:
                known.clear()
                new = [m for m in {*matches} if len(m) <= LONGEST_KEPT]
            known.update(zip(new, self.encode_matches(new), strict=True))
        return b"".join(map(known.__getitem__, matches))

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' byte-characters through the reversed byte table; parts of a split character meet again as bytes."""
        chars = "".join(map(self.names.__getitem__, ids.tolist()))
        return self.byte_of[np.frombuffer(chars.encode("utf-16-le"), "<u2")].tobytes()

    def offsets(self, ids: np.ndarray, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in characters; a token that holds part of a character covers all of it."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        flat = np.frombuffer(payload, np.uint8)
        char = np.cumsum((flat & 0xC0) != 0x80) - 1  # the character that each byte belongs to
        if not len(ids):
            return starts, ends
        return char[starts], char[ends - 1] + 1


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id", ids: bool = True, offsets: bool = True, offsets_digest: bool = False
) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids, character offsets (starts,
    ends) and offsets_sha256: of all starts, then all ends, as little-endian unsigned 32-bit integers.

    decoded_sha256 is of the bytes decoded from the ids. Null text is encoded as an empty one. Other columns of
    ``docs`` are not read.
    """
    id_type = docs.schema[id_col].dataType
    fields = [
        pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string()),
        *([pa.field("ids", pa.list_(pa.int32()))] if ids else []),
        *([pa.field("starts", pa.list_(pa.int32())), pa.field("ends", pa.list_(pa.int32()))] if offsets else []),
        *([pa.field("offsets_sha256", pa.string())] if offsets_digest else []),
    ]
    schema = f"{id_col} {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", starts array<int>, ends array<int>" * offsets + ", offsets_sha256 string" * offsets_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            rows, first, held = {f.name: [] for f in fields}, 0, 0
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py() or ""
                packed = bpe.encode(value)
                coded = np.frombuffer(packed, "<u4")
                rows["n_tokens"].append(len(coded))
                rows["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(bpe.decode(coded)).hexdigest())
                if ids:
                    rows["ids"].append(coded.astype(np.int32))
                if offsets or offsets_digest:
                    a, b = (x.astype("<u4") for x in bpe.offsets(coded, value.encode("utf-8")))
                if offsets:
                    rows["starts"].append(a.astype(np.int32))
                    rows["ends"].append(b.astype(np.int32))
                if offsets_digest:
                    rows["offsets_sha256"].append(hashlib.sha256(a.tobytes() + b.tobytes()).hexdigest())
                held += len(coded)
                if held >= TOKENS_AT_ONCE or i + 1 - first == ROWS_AT_ONCE or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, i + 1 - first), *(pa.array(rows[f.name], f.type) for f in fields)], names=[id_col, *(f.name for f in fields)]
                    )
                    rows, first, held = {f.name: [] for f in fields}, i + 1, 0

    return docs.select(id_col, text).mapInArrow(tidy(run), schema)


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, bytes, text): ids back to bytes, and to text with U+FFFD for bytes that make no character. Null ids: null."""
    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, bytes binary, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            data = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            text = [None if x is None else x.decode("utf-8", errors="replace") for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(text, pa.string())], names=[id_col, "bytes", "text"])

    return rows.select(id_col, ids).mapInArrow(tidy(run), schema)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: ids, decoded bytes and character offsets of every whole text of documents, as digests."""
    return encode_texts(table(spark, sf_dir, "documents"), *vocabulary(), ids=False, offsets=False, offsets_digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: per document its token ids, their character offsets and the digests of both ways."""
    return encode_texts(docs, *vocabulary())
