"""The user's calls: search as rows or JSON, records with their times, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashlode.operators import registry as R
from hashlode.operators import search as S


def search_api(registry: DataFrame, q: str | None, offset: int | None = None, limit: int | None = None) -> list[dict]:
    """Hits as the JSON service returns them; what can't be searched is an empty list (T4)."""
    if not q or not q.strip():
        return []
    page = S.search(R.index_rows(registry), q, max(offset or 0, 0), S.page_limit(limit))
    return [r.asDict() for r in page.collect()]  # a page: 200 rows at most


def search_json(index: DataFrame, q: str, offset: int = 0, limit: int = 25) -> DataFrame:
    """One JSON object per hit, in rank order."""
    return S.search(index, q, offset, limit).select(F.to_json(F.struct(*S.HITS), {"ignoreNullFields": "false"}).alias("hit"))


def search_page(index: DataFrame, q: str, limit: int | None = None) -> tuple[list, bool]:
    """The hits of a list page and whether there are more: one row over the limit is fetched (H5)."""
    n = S.page_limit(limit)
    rows = S.search(index, q, 0, n + 1).collect()
    return rows[:n], len(rows) > n


def count_matches(index: DataFrame, q: str) -> DataFrame:
    """Total strict matches of a query."""
    return S.strict_matches(index, q.strip()).agg(F.count("*").alias("total"))


def get_record(registry: DataFrame, info_hash: str) -> DataFrame:
    """A record with first and last sight."""
    return R.point_get(registry, info_hash)
