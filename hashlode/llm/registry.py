"""Queries of this subpackage and their SQL, for the driver."""

from __future__ import annotations

from hashlode.llm import byte_bpe, embedding_dedup, importance_quality, language_id, line_dedup, mixing, progressive_jpeg, sharding, simhash, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_line_dedup": line_dedup.query,
    "op4_embedding_dedup": embedding_dedup.query,
    "op5_progressive_jpeg": progressive_jpeg.query,
    "op6_sharding": sharding.query,
    "op7_simhash": simhash.query,
    "op8_language_id": language_id.query,
    "op9_mixing": mixing.query,
    "op10_importance_quality": importance_quality.query,
}
ORACLE_SQL: dict[str, str] = {"op1_warc": warc.ORACLE}
