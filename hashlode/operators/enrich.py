"""The enrichment loop as a batch job: rows without info are fetched in parallel and written back."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashlode.functions.bencode import parse_message
from hashlode.functions.text import blank

PARALLEL = 64


def enrich(work: DataFrame, fetch: Callable[[str], bytes | None], parallel: int = PARALLEL) -> DataFrame:
    """work(info_hash) to (info_hash, info_b64, title) of those that ``fetch`` answers, ``parallel`` at a time (K8, B2).

    ``fetch`` runs in the workers and is the only part that may touch a network. None or an exception leaves the row
    out, so that it is listed again; a failed task fetches its rows again. title is the name in the metadata, if any.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h in batch["info_hash"]:
                try:
                    info = fetch(h)
                except Exception:  # one answer that fails is one answer missing, whatever the reason
                    info = None
                if info is not None:
                    out.append((h, base64.b64encode(info).decode(), parse_message(info)["name"]))
            yield pd.DataFrame(out, columns=["info_hash", "info_b64", "title"])

    return work.select("info_hash").repartition(parallel).mapInPandas(run, "info_hash string, info_b64 string, title string")


def apply_enriched(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry with what was fetched: the blob, and the name unless it is blank; other columns as they were."""
    new = found.select("info_hash", F.col("info_b64").alias("new_info"), F.col("title").alias("new_title"))
    title = F.when(~blank(F.col("new_title")), F.col("new_title")).otherwise(F.col("title"))
    joined = registry.join(new, "info_hash", "left").withColumns({"title": title, "info_b64": F.coalesce("new_info", "info_b64")})
    return joined.select(*registry.columns)
