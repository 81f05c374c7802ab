r"""Mixing sources to target token shares by entropy balancing, with DataFrame functions only.

Sources ranked by code point (null last) weigh 5, 2, 1, repeating; by weight they share the words of all documents,
each at most ``most`` times its own words, the excess going to the others by weight. Within a source the document
rates r stay as close to 1 as they can (least relative entropy) with sum(r * size) on target and r <= most. The
convex dual has one unknown per source; its solution is the exponential tilt r = min(most, exp(lambda * size /
mean size)). Newton's method, safeguarded by a bracket, solves all sources at once: every step is one aggregate over
the distinct (source, size) cells, which stand for all documents. Rates become copies by systematic rounding over
the cells in order of size, which is off by half the longest document at most; two corrections of one cell each
take what they can of that. Within a cell the documents of least hash get the extra copy.

Size is the number of [^\x20\x09-\x0D]+ in the text, 0 for null; documents of size 0 are taken once and count for
nothing. Rows with equal id, source and size share their fate. Null ids hash as null. No documents give no rows.
Sources and cells are small next to documents but never assumed to fit: they stay tables, and are broadcast only
after their rows are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashlode.llm.shared import broadcast_if_small, drop_all, drop_stored, free_names, stored, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BUCKET_ROWS = 1 << 16
STEPS = 60
TOLERANCE = 1e-10


def source_key(source: Column) -> Column:
    """Never null: null and "" stay apart."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def source_targets(sources: DataFrame) -> DataFrame:
    """sources(key, source_size): adds weight and target. One row per source meets in one task."""
    w = Window.orderBy(F.substring("key", 1, 1) == "-", "key")
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(w) - 1) % len(WEIGHTS) + 1).cast("int")))
    cap = F.col("source_size") * float(MOST)
    by_fill = Window.orderBy(cap / F.col("weight"), "key")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    filled = ranked.withColumn("level", level).withColumn("capped", F.col("level") >= cap / F.col("weight"))
    shared = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return filled.withColumn("target", F.when(F.col("capped"), cap).otherwise(F.least(cap, F.col("weight") * shared))).drop("level", "capped")


def _solve(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with tilt (lambda): Newton on the dual, each step stored."""
    state = stored(
        sources.withColumns({"tilt": F.lit(0.0), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "off": F.lit(1.0)}), "tilt"
    )
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean_size")
        power = F.col("tilt") * x
        rate = F.exp(F.least(power, F.lit(math.log(MOST))))
        mass = F.col("n") * F.col("size")
        joined = cells.join(broadcast_if_small(state), "key")
        sums = joined.groupBy("key").agg(
            F.sum(mass * rate).alias("got"), F.sum(F.when(power < math.log(MOST), mass * x * rate).otherwise(0.0)).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        open_ = F.abs(gap) > TOLERANCE * F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("tilt") - gap / F.col("slope"))
        inside = (newton > F.coalesce(F.col("low2"), newton - 1)) & (newton < F.coalesce(F.col("high2"), newton + 1))
        span = F.greatest(F.lit(1.0), F.abs("tilt"))
        wide = F.abs(newton - F.col("tilt")) > 4 * span
        step = (
            F.when(F.coalesce(inside & ~wide, F.lit(False)), newton)
            .when(F.col("low2").isNotNull() & F.col("high2").isNotNull(), (F.col("low2") + F.col("high2")) / 2)
            .otherwise(F.col("tilt") - F.signum(gap) * 2 * span)
        )
        after = (
            state.join(sums, "key", "left")
            .withColumns({"low2": low, "high2": high, "open": F.coalesce(open_ & (F.col("target") < MOST * F.col("source_size") * (1 - 1e-12)), F.lit(False))})
            .withColumn("next", F.when(F.col("open"), step).otherwise(F.col("tilt")))
            .withColumn("off", F.when(F.col("open"), F.abs(gap) / F.col("target")).otherwise(0.0))
            .select(*sources.columns, F.col("next").alias("tilt"), F.col("low2").alias("low"), F.col("high2").alias("high"), "off")
        )
        after = stored(after, "tilt")
        drop_stored(state)
        state = after
        if not state.where("off > 0").limit(1).count():
            break
    return state


def plan(slim: DataFrame) -> DataFrame:
    """slim(key, size, h): one row per cell (key, size) with source_size, target, rate, base copies, and cuts.

    cuts[b] is the largest hash of bucket b (h modulo their number) that gets one copy more; null: none does.
    """
    cells = stored(slim.groupBy("key", "size").agg(F.count("*").alias("n")), "cells")
    sources = cells.groupBy("key").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled")
    )
    sources = source_targets(sources).withColumn("mean_size", F.greatest(F.col("source_size") / F.col("filled"), F.lit(1e-9))).drop("filled")
    solved = _solve(cells, sources)
    full = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)
    power = F.least(F.col("tilt") * F.col("size") / F.col("mean_size"), F.lit(math.log(MOST)))
    rate = F.when(F.col("size") == 0, 1.0).when(full, float(MOST)).otherwise(F.least(F.exp(power), F.lit(float(MOST))))
    by_size = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    end = F.floor(F.sum(F.round(F.col("n") * F.col("rate"), 9)).over(by_size) + 0.5)
    rated = cells.join(broadcast_if_small(solved), "key").withColumn("rate", rate)
    rounded = rated.withColumn("end", end).withColumn("start", F.coalesce(F.lag("end").over(Window.partitionBy("key").orderBy(F.desc("size"))), F.lit(0)))
    cut = F.least(F.greatest(F.col("end") - F.col("start"), F.lit(0)), MOST * F.col("n")).cast("long")
    rounded = stored(rounded.withColumn("copies", F.when(F.col("size") == 0, F.col("n")).otherwise(cut)).drop("end", "start", "low", "high", "off"), "copies")
    for _ in range(2):
        gap = rounded.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        tried = rounded.where("size > 0").join(broadcast_if_small(gap), "key")
        move = F.least(F.greatest(F.round(F.col("gap") / F.col("size")), -F.col("copies")), MOST * F.col("n") - F.col("copies")).cast("long")
        best = tried.withColumn("move", move).groupBy("key").agg(
            F.min(F.struct(F.abs(F.col("gap") - F.col("move") * F.col("size")).alias("left"), F.col("size").alias("at"), F.col("move"))).alias("best")
        )
        after = rounded.join(broadcast_if_small(best), "key", "left")
        moved = F.when(F.col("size") == F.col("best.at"), F.col("copies") + F.col("best.move")).otherwise(F.col("copies"))
        after = stored(after.withColumn("copies", moved).drop("best"), "copies")
        drop_stored(rounded)
        rounded = after
    drop_stored(solved)
    cells2 = rounded.withColumns({"base": F.expr("copies div n"), "extra": F.expr("copies % n"), "buckets": F.ceil(F.col("n") / BUCKET_ROWS)})
    bucket = F.pmod(F.col("h"), F.col("buckets"))
    some = slim.join(broadcast_if_small(cells2.where("extra > 0").select("key", "size", "extra", "buckets")), ["key", "size"]).withColumn("b", bucket)
    sizes = some.groupBy("key", "size", "b", "extra").agg(F.count("*").alias("m"))
    ahead = Window.partitionBy("key", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("take", F.col("extra") - F.coalesce(F.sum("m").over(ahead), F.lit(0))).where("take > 0")
    within = Window.partitionBy("key", "size", "b").orderBy("h")
    cuts = (
        some.drop("extra").join(sizes.select("key", "size", "b", "take"), ["key", "size", "b"])
        .withColumn("i", F.row_number().over(within)).where("i <= take")
        .groupBy("key", "size", "b").agg(F.max("h").alias("cut"))
        .groupBy("key", "size").agg(F.map_from_entries(F.collect_list(F.struct("b", "cut"))).alias("cuts"))
    )
    out = stored(
        cells2.join(cuts, ["key", "size"], "left").select("key", "size", "n", "source_size", "target", "rate", "base", "buckets", "cuts"), "mix"
    )
    drop_all(cells, rounded)
    return out


_OWN = ("key", "size", "h", "source_size", "target", "rate", "base", "buckets", "cuts", "copies", "copy")


def _names(docs: DataFrame) -> dict[str, str]:
    """Names for the columns added here that no column of ``docs`` has."""
    return dict(zip(_OWN, free_names(docs, *_OWN), strict=True))


def _keyed(docs: DataFrame, source: str, text: str, id_col: str) -> DataFrame:
    as_ = _names(docs)
    out = docs.withColumns({as_["key"]: source_key(F.col(source)), as_["size"]: word_count(F.col(text))})
    return out.withColumn(as_["h"], F.xxhash64(F.col(id_col).cast("string"), as_["key"], as_["size"]))


def _apply(keyed: DataFrame, mix: DataFrame, as_: dict[str, str]) -> DataFrame:
    cells = mix.select(*(F.col(c).alias(as_[c]) for c in ("key", "size", "source_size", "target", "rate", "base", "buckets", "cuts")))
    out = keyed.join(broadcast_if_small(cells), [as_["key"], as_["size"]])
    cut = F.try_element_at(F.col(as_["cuts"]), F.pmod(F.col(as_["h"]), F.col(as_["buckets"])))
    return out.withColumn(as_["copies"], F.col(as_["base"]) + F.coalesce((F.col(as_["h"]) <= cut).cast("long"), F.lit(0)))


def mix_rates(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: id, size, source_size, target, taken (words, repeats counted), copies and rate."""
    rows = docs.select(F.col(source).alias("s"), F.col(text).alias("t"), F.col(id_col).alias("i"))
    as_ = _names(rows)
    slim = stored(_keyed(rows, "s", "t", "i").select("i", "key", "size", "h"), "sizes")
    out = _apply(slim, plan(slim.select("key", "size", "h")), as_)
    return out.select(F.col("i").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mix_documents(docs: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: every row as often as its copies say, with the columns it had."""
    as_ = _names(docs)
    keyed = _keyed(docs, source, text, id_col)
    slim = stored(keyed.select(*(F.col(as_[c]).alias(c) for c in ("key", "size", "h"))), "sizes")
    out = _apply(keyed, plan(slim), as_).where(F.col(as_["copies"]) > 0)
    drop_stored(slim)
    return out.withColumn(as_["copy"], F.explode(F.array_repeat(F.lit(True), F.col(as_["copies"]).cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: what the mix takes of every document."""
    return mix_rates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)
