"""Language identification by averaged hashed subword embeddings and a linear softmax.

A document is the mean of the embeddings of its hashed byte 2-, 3- and 4-grams (ASCII letters lower-cased, other
ASCII taken as space); a linear softmax over that mean gives the language. Embeddings and softmax are trained
together by stochastic gradient descent in numpy on a bounded sample (``per_language``, ``most_rows``); a part of
the sample held back sets the temperature and the rejection threshold. At prediction the embedding and softmax
matrices are multiplied once, so each n-gram costs one lookup of as many numbers as there are languages. Predictions
read whole texts, in blocks of a fixed size.

Null texts and texts without a letter get ``und`` with score 0 and are rejected. With no usable training row every
document gets ``und``. A null id is predicted like any other and is never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashlode.llm.shared import broadcast_if_small, drop_stored, free_names, stored, table
from hashlode.llm.spans import blocks, tidy

UNDETERMINED = "und"
BITS = 14
BUCKETS = 1 << BITS
ORDERS = (2, 3, 4)
#: ASCII letters to lower case, every other ASCII byte to a space.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Ends a payload: n-grams that touch a zero byte count for nothing.
_STOP = b"\0" * (max(ORDERS) - 1)
_BLOCK = 1 << 19
SALTS = 64


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _grams(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the joined payloads, one row per order (0: none starts here), and the payloads' starts."""
    flat = np.frombuffer(b"".join(payloads) + _STOP, np.uint8).astype(np.uint32)
    n = len(flat) - len(_STOP)
    out = np.zeros((len(ORDERS), n), np.int32)
    key = np.zeros(n, np.uint32)
    open_ = np.ones(n, bool)
    for k in range(max(ORDERS)):
        byte = flat[k : k + n]
        key = (key << np.uint32(8)) | byte
        open_ &= byte != 0
        if k + 1 in ORDERS:
            h = (key * np.uint32(0x9E3779B1) + np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
            out[ORDERS.index(k + 1)] = np.where(open_, (h >> np.uint32(32 - BITS)) | np.uint32(1), 0)
    return out, np.cumsum([0, *(len(p) for p in payloads[:-1])])


def _folded(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD)


def _pieces(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Payloads of at most a block each; a longer text gives several, that share the bytes an n-gram can span."""
    payloads, owner = [], []
    for i, t in enumerate(texts):
        whole = _folded(t)
        for lo in range(0, max(1, len(whole) - len(_STOP)), _BLOCK):
            payloads.append(whole[lo : lo + _BLOCK + len(_STOP)] + _STOP)
            owner.append(i)
    return payloads, np.array(owner, np.int64)


def logits(texts: list[str], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(texts, languages): the mean over the n-grams of each whole text."""
    payloads, owner = _pieces(texts)
    total = np.zeros((len(texts), weights.shape[1]))
    count = np.zeros(len(texts))
    for first, held in blocks(payloads, _BLOCK):
        grams, starts = _grams(held)
        who = owner[first : first + len(held)]
        for h in grams:
            np.add.at(total, who, np.add.reduceat(weights[h], starts, axis=0))
            np.add.at(count, who, np.add.reduceat(h > 0, starts, dtype=np.int64))
    return total / np.maximum(count, 1)[:, None] + bias


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    payloads, _ = _pieces([text])
    counts = np.zeros(BUCKETS, np.int64)
    for _, held in blocks(payloads, _BLOCK):
        for h in _grams(held)[0]:
            counts += np.bincount(h, minlength=BUCKETS)
    counts[0] = 0
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def _train(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int, epochs: int, rate: float, kept_right: float) -> Model:
    languages = sorted({r[0] for r in rows})
    code = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(1)
    held = [r for i, r in enumerate(rows) if i % 5 == 4] or rows
    used = [r for i, r in enumerate(rows) if i % 5 != 4] or rows
    embed = rng.normal(0, 1 / dim, (BUCKETS, dim))
    soft, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    touched = np.zeros(BUCKETS, bool)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(used)):
            lang, ids, counts = used[i]
            share = counts / counts.sum()
            mean = share @ embed[ids]
            p = np.exp((z := mean @ soft + bias) - z.max())
            p /= p.sum()
            p[code[lang]] -= 1
            back = soft @ p
            soft -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            embed[ids] -= step * np.outer(share, back) * len(ids) ** 0.5
            touched[ids] = True
    embed[~touched] = 0  # an n-gram never seen says nothing
    weights = embed @ soft
    # calibrated on draws of a few n-grams from each held-back row, as short texts give them
    z, y = [], []
    for lang, ids, counts in held:
        for n in (4, 8, 16, 32, 64, 128):
            z.append(weights[rng.choice(ids, n, p=counts / counts.sum())].mean(0) + bias)
            y.append(code[lang])
    z, y = np.array(z), np.array(y)

    def scores(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature = min(np.geomspace(0.02, 20, 61), key=lambda t: -np.log(np.maximum(scores(t)[np.arange(len(y)), y], 1e-12)).mean())
    p = scores(temperature)
    best, right = p.max(1), p.argmax(1) == y
    # the threshold under which hardly any right answer falls, and never above the point where a rival may win
    threshold = min(0.5, float(np.quantile(best[right], 1 - kept_right))) if right.any() else 0.0
    return Model(languages, weights.astype(np.float32), bias, float(temperature), threshold)


def fit(
    docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", per_language: int = 600, most_rows: int = 3600,
    dim: int = 16, epochs: int = 6, rate: float = 0.5, kept_right: float = 0.999,
) -> Model:
    """Train on a sample of rows with language and text: the ``per_language`` rows of least hash of the id of each
    language, at most ``most_rows`` in all, taken in turn. Only their n-gram counts (at most BUCKETS each) reach
    the driver."""
    w = Window.partitionBy("lang").orderBy("h", "id")
    told = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.xxhash64(id_col).alias("h")
    )
    # a share of each language by hash comes to the window, about twice what is wanted, however large the language is
    share = told.groupBy("lang").agg(F.count("*").alias("c")).select(F.col("lang").alias("l"), ((2.0 * per_language + 100) / F.col("c")).alias("share"))
    share = stored(share, "share")
    small = broadcast_if_small(share)
    if small is not share:
        shared = told.join(small, F.col("lang") == F.col("l"))
    else:  # more languages than fit a broadcast: salted, so that a large one meets in many tasks
        salted = share.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        shared = told.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, (F.col("lang") == F.col("l")) & (F.col("salt") == F.col("of")))
    draw = F.shiftrightunsigned("h", 11) / float(1 << 53)
    picked = (
        shared.where(draw < F.col("share"))
        .withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language)
        .orderBy("n", "h", "id").limit(most_rows).select("id").distinct()
    )
    sample = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, counts = _features(batch.column(2)[i].as_py())
                if len(ids):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([ids.astype(np.int32)]), pa.array([counts.astype(np.int32)])],
                        names=["id", "lang", "ids", "counts"],
                    )

    id_type = docs.schema[id_col].dataType.simpleString()
    # most_rows ids at most: a size proven by the limit above
    found = sample.join(F.broadcast(picked), "id").mapInArrow(tidy(run), f"id {id_type}, lang string, ids array<int>, counts array<int>").toArrow()
    drop_stored(share)
    rows = [(r, i.values.to_numpy(), c.values.to_numpy()) for r, i, c in zip(found["lang"].to_pylist(), found["ids"], found["counts"], strict=True)]
    order = sorted(range(len(rows)), key=lambda k: (hash_key(found["id"][k].as_py()), rows[k][0], len(rows[k][1])))
    rows = [rows[k] for k in order][:most_rows]
    if not rows:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    return _train(rows, dim, epochs, rate, kept_right)


def hash_key(value: object) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(value), 7)


def predict(docs: DataFrame, model: Model, text: str = "text", added: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with language, score (0 to 1) and rejection, named by ``added``; columns of these names are replaced."""
    import regex

    names = [c for c in docs.columns if c not in added]
    kept = docs.select(*names)
    where = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages: bounded
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, letter = shared.value, regex.compile(r"\p{L}").search
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(where).to_pylist()
                spoken = [i for i, t in enumerate(texts) if t is not None and letter(t)] if m.languages else []
                lang = [UNDETERMINED] * len(texts)
                score = np.zeros(len(texts))
                if spoken:
                    z = logits([texts[i] for i in spoken], m.table, m.bias) / m.temperature
                    e = np.exp(z - z.max(1, keepdims=True))
                    p = e / e.sum(1, keepdims=True)
                    score[spoken] = p.max(1)
                    for i, k in zip(spoken, p.argmax(1), strict=True):
                        lang[i] = m.languages[k]
                rejected = [x == UNDETERMINED or s < m.threshold for x, s in zip(lang, score, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected, pa.bool_())], names=[*names, *added]
                )

    return kept.mapInArrow(tidy(run), f"{fields}, `{added[0]}` string, `{added[1]}` double, `{added[2]}` boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: learn from the documents that are not held out, predict every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; their columns as they were. Null texts and texts without a letter go."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    lang, score, rejected = free_names(docs, "lang_pred", "score", "rejected")
    return predict(docs, model, added=(lang, score, rejected)).where(~F.col(rejected)).select(*docs.columns)
