"""Byte-balanced shards by Karmarkar-Karp differencing.

Documents with equal text form one indivisible group (null counts as empty). Groups are dealt by hash into blocks of
about ``block_groups``; in each block the differencing method keeps a heap of partial partitions, each with one part
per shard, and repeatedly joins the two of largest spread in opposite order, largest part on smallest. A block ends
as one partition with its part sums. The blocks' partitions are then joined the same way, in a tree of at most
``fan_in`` at a time, until one is left; every level is a small table, and a group's shard follows from its part in
its block and the orders chosen above it. The law is ``bytes``: sizes near equal.

A document's size is the UTF-8 bytes of its text (null: none) plus 1. Slots count from 0 within a shard without
gaps, in order of hash; they come from counts of hash ranges, so no shard meets in one task. Null ids and repeated
rows are placed like others. No documents give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashlode.llm.shared import stored, table, text_crc32, utf8_size

SHARDS = 16
BLOCK_GROUPS = 20_000
FAN_IN = 1024
SLOT_ROWS = 1 << 12


def difference(parts: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Join partitions of k part sums each into one.

    Returns its sums in ascending order, and for each input the final part that each of its parts went to.
    """
    k = len(parts[0])
    heap: list[tuple[int, int, list[int], list[list[tuple[int, int]]]]] = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda j: (sums[j], j))
        sorted_sums = [sums[j] for j in order]
        heap.append((sorted_sums[0] - sorted_sums[-1], i, sorted_sums, [[(i, j)] for j in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, at_a = heapq.heappop(heap)
        _, _, b, at_b = heapq.heappop(heap)
        joined = [(a[x] + b[k - 1 - x], at_a[x], at_b[k - 1 - x]) for x in range(k)]
        joined.sort(key=lambda x: x[0])
        members = []
        for _, left, right in joined:  # the shorter list joins the longer
            if len(left) < len(right):
                left, right = right, left
            left.extend(right)
            members.append(left)
        sums = [x[0] for x in joined]
        heapq.heappush(heap, (sums[0] - sums[-1], i, sums, members))
    _, _, sums, members = heap[0]
    went = [[0] * k for _ in parts]
    for final, content in enumerate(members):
        for i, j in content:
            went[i][j] = final
    return sums, went


def difference_items(sizes: list[int], k: int) -> tuple[list[int], list[int]]:
    """The same for single items: sums of the k parts, and the part of each item."""
    if not sizes:
        return [0] * k, []
    sums, went = difference([[0] * (k - 1) + [s] for s in sizes])
    return sums, [w[k - 1] for w in went]


def assign_groups(groups: DataFrame, shards: int = SHARDS, block_groups: int = BLOCK_GROUPS, fan_in: int = FAN_IN) -> DataFrame:
    """groups(group, size) with column shard. Ids of groups must be distinct."""
    n = groups.count()
    blocks = max(1, -(-n // block_groups))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks)))
    group_type = groups.schema["group"].dataType.simpleString()

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "group"], ascending=[False, True], kind="stable")
        _, part = difference_items([int(x) for x in pdf["size"]], shards)
        return pdf.assign(part=np.array(part, np.int32))[["group", "size", "block", "part"]]

    placed = stored(dealt.groupBy("block").applyInPandas(in_block, f"group {group_type}, size long, block long, part int"), "parts")
    parts = ", ".join(f"sum(CASE WHEN part = {j} THEN size ELSE 0 END)" for j in range(shards))
    level = placed.groupBy("block").agg(F.expr(f"array({parts})").alias("sums")).withColumnRenamed("block", "node")
    to_final = None  # (block, node, went): the current node of a block and the part there of each of its parts
    count = blocks
    while True:
        def join_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node")
            sums, went = difference([[int(v) for v in x] for x in pdf["sums"]])
            return pd.DataFrame({"node": pdf["node"], "up": pdf["node"] // fan_in, "went": went, "sums": [sums] * len(pdf)})

        stepped = stored(
            level.withColumn("up", F.expr(f"node div {fan_in}")).groupBy("up").applyInPandas(lambda pdf: join_nodes(pdf.drop(columns="up")), "node long, up long, went array<int>, sums array<long>"),
            "tree",
        )
        if to_final is None:
            to_final = stepped.select(F.col("node").alias("block"), F.col("up").alias("node"), "went")
        else:
            above = stepped.select("node", F.col("up").alias("next"), F.col("went").alias("on"))
            to_final = to_final.join(above, "node").select("block", F.col("next").alias("node"), F.transform("went", lambda j: F.element_at("on", j + 1)).alias("went"))
        count = -(-count // fan_in)
        if count <= 1:
            break
        level = stepped.select(F.col("up").alias("node"), "sums").dropDuplicates(["node"])
    final = stored(to_final.select("block", "went"), "blocks")
    # one row per block: broadcast while few, which their count tells
    final = F.broadcast(final) if blocks <= 100_000 else final
    return placed.join(final, "block").select("group", "size", F.element_at("went", F.col("part") + 1).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text", id_col: str = "doc_id", block_groups: int = BLOCK_GROUPS, fan_in: int = FAN_IN) -> DataFrame:
    """Per document: id, size, text_crc32, law, shard, slot, grown_shard (null: the law is bytes)."""
    body = F.coalesce(F.col(text), F.lit(""))
    slim = stored(
        docs.select(
            F.col(id_col).alias("id"), (utf8_size(F.col(text)) + 1).alias("size"), text_crc32(F.col(text)).alias("text_crc32"), F.md5(body.cast("binary")).alias("group")
        ),
        "sizes",
    )
    groups = stored(slim.groupBy("group").agg(F.sum("size").alias("size")), "groups")
    shard = assign_groups(groups, shards, block_groups, fan_in).select("group", "shard")
    ranges = max(1, -(-slim.count() // SLOT_ROWS))
    # rows of a group spread over the hash ranges by id, so copies of one text don't meet in one task
    placed = stored(
        slim.join(shard, "group").drop("group").withColumn("h", F.xxhash64("id", "size", "text_crc32")).withColumn("r", F.pmod("h", F.lit(ranges))), "placed"
    )
    counts = placed.groupBy("shard", "r").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    base = F.broadcast(base) if ranges * shards <= 100_000 else base
    inside = Window.partitionBy("shard", "r").orderBy("h", "id")
    out = placed.withColumn("i", F.row_number().over(inside) - 1).join(base, ["shard", "r"])
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("i")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents into shards 0 to 15, sizes near equal."""
    return shard_documents(table(spark, sf_dir, "documents"))
