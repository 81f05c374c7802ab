"""Embedding near-duplicates by randomised-rotation binary codes (RaBitQ, Gao and Long 2024).

A unit vector o is rotated by a random orthogonal matrix; its code is the signs x, of unit length once scaled, and
its stored correction factor is f = <o, x>. For another rotated unit vector q, kept as bit planes of randomly rounded
levels, <x, q> comes from popcounts, and <x, q> / f estimates <o, q> without bias. A pair is recomputed in double
precision only if the upper confidence bound of its estimate, ``epsilon`` spreads up, reaches the threshold, both ways;
at 6 spreads a link is missed once in some 10^8, and where the spread is so wide that the bound is certain, never.

Codes, factors and planes are compared first, without vectors: a task compares two tiles of a label and passes on the
classes that have a pair to recompute. Only their vectors are sent, and the task of the second step recomputes those
pairs and returns link counts and a spanning forest, never pairs.

Only vectors of equal non-null label and equal length are compared. Equal vectors of a label are one class with a
multiplicity. Labels of over ``tile`` classes are cut by the nearest of sampled classes, one for each full tile and at
most ``pivots``, and by hash; two tiles are compared unless the triangle inequality on angles rules them out.

Vectors that are null, empty, zero, or hold null or non-finite components, and vectors of null label, link with
nothing and are their own component. Rows are identified by id; rows of a null id link, but name no component.
Repeated rows of one id count as separate vectors. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashlode.llm.graph import components, local_labels
from hashlode.llm.shared import broadcast_if_small, drop_all, drop_stored, stored, table
from hashlode.llm.spans import tidy

THRESHOLD = 0.93
TILE = 2048
PIVOTS = 64
PIVOT_NUMBERS = 1 << 21
LEVEL_BITS = 6
EPSILON = 6.0
SEED = 5


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: sign codes (rows, words), correction factors, and the rotated rows as bit planes
    (rows, LEVEL_BITS, words) of levels, with the value of level 0 and the step between levels."""
    dim = unit.shape[1]
    turned = unit @ rotation(dim).T
    f = np.abs(turned).sum(1) / np.sqrt(dim)
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << LEVEL_BITS) - 1), 1e-12)
    # rounded at random, so that the levels are right on average; the draw depends on the place only
    level = np.floor((turned - low[:, None]) / step[:, None] + np.random.default_rng(SEED + 1).random(dim)).astype(np.uint8)
    level = np.minimum(level, (1 << LEVEL_BITS) - 1)
    planes = np.stack([_words((level >> b) & 1) for b in range(LEVEL_BITS)], axis=1)
    return _words(turned > 0), f, planes, low, step


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row in 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def estimates(codes: np.ndarray, f: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, dim: int) -> np.ndarray:
    """(coded rows, level rows): unbiased estimates of the inner products, from popcounts of codes and planes."""
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)[:, None]
    inside, total = np.zeros((len(codes), len(planes)), np.float32), np.zeros(len(planes))
    for b in range(planes.shape[1]):
        for w in range(codes.shape[1]):
            inside += np.bitwise_count(codes[:, None, w] & planes[None, :, b, w]).astype(np.float32) * np.float32(1 << b)
            total += np.bitwise_count(planes[:, b, w]).astype(np.float64) * (1 << b)
    signed = 2 * (low * ones + step * inside) - (dim * low + step * total)  # sum over set bits less the sum over clear ones
    return signed / np.sqrt(dim) / f[:, None]


def margins(f: np.ndarray, step: np.ndarray, dim: int, threshold: float, epsilon: float) -> np.ndarray:
    """(coded rows, level rows): how far below the threshold the estimate of a link may be.

    For inner product r the estimate is off by sqrt(1 - r^2) sqrt(1 - f^2) / f times a coordinate of a random direction,
    of spread 1 / sqrt(dim - 1) and 1 at most, and by the rounding of levels; both are taken at ``epsilon`` spreads.
    """
    turn = np.sqrt(1 - threshold**2) * np.sqrt(np.maximum(1 - f * f, 0)) * min(1.0, epsilon / np.sqrt(max(dim - 1, 1)))
    return (turn[:, None] + step * min(np.sqrt(dim), epsilon / 2)) / f[:, None] + 1e-5


def near_pairs(a: "Codes", b: "Codes", threshold: float, epsilon: float) -> np.ndarray:
    """Whether the upper confidence bound reaches the threshold, estimated both ways."""
    one = estimates(a.codes, a.f, b.planes, b.low, b.step, a.dim) >= threshold - margins(a.f, b.step, a.dim, threshold, epsilon)
    two = estimates(b.codes, b.f, a.planes, a.low, a.step, a.dim) >= threshold - margins(b.f, a.step, a.dim, threshold, epsilon)
    return one & two.T  # a link stays within either margin


class Codes:
    def __init__(self, pdf: pd.DataFrame, dim: int):
        self.dim = dim
        words = -(-dim // 64)
        n = len(pdf)
        self.codes = np.frombuffer(b"".join(pdf["code"]), np.uint64).reshape(n, words)
        self.planes = np.frombuffer(b"".join(pdf["planes"]), np.uint64).reshape(n, LEVEL_BITS, words)
        self.f, self.low, self.step = (pdf[c].to_numpy() for c in ("f", "low", "step"))

    def __getitem__(self, at: np.ndarray | slice) -> "Codes":
        out = object.__new__(Codes)
        out.dim, out.codes, out.planes, out.f, out.low, out.step = self.dim, self.codes[at], self.planes[at], self.f[at], self.low[at], self.step[at]
        return out


def classes_of(rows: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with their class key or null, distinct classes): a class is a label and an equal vector."""
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(sound & F.exists(v, lambda x: x != 0) & F.col(label).isNotNull(), F.lit(False))
    doubles = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))  # -0.0 equals 0.0
    key = F.when(sound, F.xxhash64(F.lit(1), F.col(label).cast("string"), doubles))
    key2 = F.when(sound, F.xxhash64(F.lit(2), doubles, F.col(label).cast("string")))
    all_ = rows.select(F.col(id_col).alias("id"), key.alias("k1"), key2.alias("k2"), F.when(sound, F.col(label).cast("string")).alias("label"), F.when(sound, doubles).alias("v"))
    return all_, all_.where("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow of squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pivots(grouped: DataFrame, tile: int, pivots: int) -> dict[str, np.ndarray]:
    """Sampled unit classes of each label: about one per full tile. None for labels of one tile, or if they are too many."""
    sizes = grouped.groupBy("g").agg(F.count("*").alias("m"), F.first(F.size("v")).alias("dim")).where(F.col("m") > tile)
    wanted = stored(sizes.withColumn("p", F.least(F.ceil(F.col("m") / tile), F.lit(pivots)).cast("int")), "wanted")
    total = wanted.agg(F.sum(F.col("p") * F.col("dim"))).first()[0] or 0
    if not total or total > PIVOT_NUMBERS:
        return {}
    draw = F.shiftrightunsigned(F.xxhash64("c", F.lit(SEED)), 11) / float(1 << 53)
    some = grouped.join(broadcast_if_small(wanted), "g").where(draw < (F.col("p") * 4.0 + 40) / F.col("m"))  # a share comes to the window
    ranked = some.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("c"), "c"))).where("i <= p")
    out: dict[str, list] = {}
    for r in ranked.select("g", "v").orderBy("g", "i").collect():  # PIVOT_NUMBERS at most
        out.setdefault(r.g, []).append(r.v)
    drop_stored(wanted)
    return {g: _unit(np.array(v)) for g, v in out.items()}


def link_classes(classes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """classes(c, n, label, v): (c, links) partial counts of linked vectors of other classes, and forest edges (a, b)."""
    spark = classes.sparkSession
    grouped = classes.withColumn("g", F.concat_ws(":", F.size("v"), "label")).select("c", "n", "g", "v")
    shared = spark.sparkContext.broadcast(_pivots(grouped, tile, pivots))
    near = {g: np.arccos(np.clip(p @ p.T, -1, 1)) for g, p in shared.value.items()}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(2).to_pylist())
            for g in np.unique(names):
                part = batch.take(pa.array(np.flatnonzero(names == g)))
                unit = _unit(_matrix(part.column(3)))
                cell, angle = np.zeros(len(unit), np.int32), np.full(len(unit), np.pi)
                if g in shared.value:
                    cos = np.clip(unit @ shared.value[g].T, -1, 1)
                    cell, angle = cos.argmax(1).astype(np.int32), np.arccos(cos.max(1))
                codes, f, planes, low, step = encode(unit)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3], pa.array(cell), pa.array(angle), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array([x.tobytes() for x in planes], pa.binary()),
                        pa.array(f), pa.array(low), pa.array(step),
                    ],
                    names=["c", "n", "g", "cell", "angle", "code", "planes", "f", "low", "step"],
                )

    coded = stored(grouped.mapInArrow(tidy(code), "c string, n long, g string, cell int, angle double, code binary, planes binary, f double, low double, step double"), "codes")
    sizes = coded.groupBy("g", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts")).where("cuts > 1")
    cut = coded.join(broadcast_if_small(sizes), ["g", "cell"], "left").withColumn("cut", F.pmod(F.xxhash64("c"), F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts")
    tiles = stored(cut.groupBy("g", "cell", "cut").agg(F.max("angle").alias("radius")), "tiles")
    a, b = (tiles.select("g", *(F.col(c).alias(c + s) for c in ("cell", "cut", "radius"))) for s in "ab")
    reach = float(np.arccos(threshold)) + 1e-6
    pairs = a.join(b, "g").where(F.struct("cella", "cuta") <= F.struct("cellb", "cutb"))
    gaps = [(g, i, j, float(m[i, j])) for g, m in near.items() for i in range(len(m)) for j in range(len(m))]
    if gaps:
        apart = spark.createDataFrame(gaps, "g string, cella int, cellb int, gap double")  # pivots^2 of few labels
        pairs = pairs.join(broadcast_if_small(apart), ["g", "cella", "cellb"], "left")
        pairs = pairs.where((F.col("cella") == F.col("cellb")) | F.coalesce(F.col("gap") <= F.col("radiusa") + F.col("radiusb") + reach, F.lit(True)))
    pairs = stored(pairs.select("g", "cella", "cuta", "cellb", "cutb").withColumn("t", F.xxhash64("g", "cella", "cuta", "cellb", "cutb")), "pairs")
    side_a = pairs.select("t", "g", F.col("cella").alias("cell"), F.col("cuta").alias("cut"), F.lit(0).alias("side"))
    side_b = pairs.where("cella != cellb or cuta != cutb").select("t", "g", F.col("cellb").alias("cell"), F.col("cutb").alias("cut"), F.lit(1).alias("side"))
    work = cut.join(side_a.union(side_b), ["g", "cell", "cut"])
    columns = ["t", "side", "g", "c", "code", "planes", "f", "low", "step"]

    def blocks(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of the pairs to recompute, rows sorted by side."""
        codes, side = Codes(pdf, int(pdf["g"].iloc[0].partition(":")[0])), pdf["side"].to_numpy()
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1) if (side == 1).any() else first
        for lo in range(0, len(second), 256):
            cols = second[lo : lo + 256]
            i, j = np.nonzero(near_pairs(codes[first], codes[cols], threshold, epsilon))
            i, j = first[i], cols[j]
            if second is first:
                i, j = i[i < j], j[i < j]
            yield i, j

    def involved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "c"]).reset_index(drop=True)
        seen = np.zeros(len(pdf), bool)
        for i, j in blocks(pdf):
            seen[i] = seen[j] = True
        return pdf.loc[seen, ["t", "side", "c"]]

    asked = stored(work.select(*columns).groupBy("t").applyInPandas(involved, "t long, side int, c string"), "involved")
    exact = asked.join(coded.select("c", "n", "g", "code", "planes", "f", "low", "step"), "c").join(classes.select("c", "v"), "c")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "c"]).reset_index(drop=True)
        unit, n = _unit(np.array(pdf["v"].tolist())), pdf["n"].to_numpy()
        count, label, held = np.zeros(len(pdf), np.int64), np.arange(len(pdf)), []
        for i, j in blocks(pdf):
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                hit = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                x, y = x[hit], y[hit]
                np.add.at(count, x, n[y])
                np.add.at(count, y, n[x])
                held.append(np.stack((x, y)))
            if held:
                label, held = local_labels(len(pdf), np.concatenate((np.arange(len(pdf)), np.concatenate(held, axis=1)[0])), np.concatenate((label, np.concatenate(held, axis=1)[1]))), []
        at = np.flatnonzero(count)
        c = pdf["c"].to_numpy()
        return pd.DataFrame({"c": c[at], "links": count[at], "root": c[label[at]]})

    found = stored(exact.groupBy("t").applyInPandas(compare, "c string, links long, root string"), "links")
    drop_all(coded, tiles, pairs, asked)
    return found.select("c", "links"), found.where("c != root").select(F.col("c").alias("a"), F.col("root").alias("b"))


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS, epsilon: float = EPSILON
) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    all_, classes = classes_of(rows, id_col, vector, label)
    classes = stored(classes.withColumn("c", F.concat(F.hex("k1"), F.lit("."), F.hex("k2"))), "classes")
    links, edges = link_classes(classes.select("c", "n", "label", "v"), threshold, tile, pivots, epsilon)
    per_class = links.groupBy("c").agg(F.sum("links").alias("links"))
    joined = classes.select("c", "k1", "k2", "n", "least").join(components(edges).toDF("c", "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    joined = stored(joined.join(per_class, "c", "left"), "classes")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    out = all_.select("id", "k1", "k2").join(named, ["k1", "k2"], "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.col(id_col) == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: links and components of all vectors."""
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumn("component_id", F.col("component_id").cast("long"))
