"""The pipeline's stages, one after the other, against plain versions of each."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_operators import CLASHES, LONG, brute_components, brute_lines, five_words, plain_targets

from hashlode.llm import byte_bpe, language_id, mixing

STAGES = dict(corpus_pipeline.STAGES)
TEXT = "the quick brown fox jumps over the lazy dog and then it runs back to the forest where all of the other foxes live"
ODD = [
    (None, TEXT + " alone", "en", "a", 1), (9001, None, None, None, None), (9002, "", "en", "", 0), (9003, "1234 ... !!", "en", "a", 1),
    (9004, TEXT, "en", "a", 1), (9005, TEXT, "en", "b", 1), (9005, TEXT, "en", "b", 1), (9006, TEXT + " now", "en", None, 1), (9006, "another text that shares nothing but its number", "en", "a", 1),
    (9007, LONG, "en", "a", 1), (9008, TEXT + "\nTHE quick\n\n" + TEXT[::-1], None, "a", 1),
]


@pytest.fixture(scope="module")
def docs(spark, data):
    real = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return real.unionByName(odd, allowMissingColumns=True).withColumns({c: F.lit("mine") for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def steps(spark, docs, data):
    """What goes into each stage, and the result."""
    now, found = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        found[name] = now
        now = stage(spark, now, data).cache()
    return {**found, "result": now}


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def plain_language(model, text):
    """(language, score): one n-gram at a time."""
    folded = " " + text.lower()
    b = bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in folded.encode())
    total, n = np.zeros(len(model.languages)), 0
    for size in language_id.ORDERS:
        for i in range(len(b) - size + 1):
            key = int.from_bytes(b[i : i + size], "big")
            h = (key * 0x9E3779B1 + ((size - 1) * 0x85EBCA6B & 0xFFFFFFFF)) * 0xC2B2AE35 & 0xFFFFFFFF
            total += model.table[h >> (32 - language_id.BITS) | 1]
            n += 1
    z = (total / n + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return model.languages[int(z.argmax())], float((p / p.sum()).max())


def test_columns_stay(steps, docs):
    assert all(steps[name].columns == docs.columns for name in STAGES)
    assert all(r[c] == "mine" for r in steps["byte_bpe"].select(*CLASHES).collect() for c in CLASHES)


def test_language_stage(steps, docs):
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    want = Counter()
    for row, n in rows_of(docs).items():
        text = row[1]
        if text is not None and regex.search(r"\p{L}", text) and (len(text) > 30_000 or plain_language(model, text)[1] >= model.threshold):
            want[row] += n
    got = rows_of(steps["line_dedup"])
    assert got == want and not {9001, 9002, 9003} & {r[0] for r in got}
    real = docs.where("lang IS NOT NULL AND doc_id < 9000").count()
    assert sum(n for r, n in got.items() if r[0] is not None and r[0] < 9000) >= 0.98 * real
    some = docs.where("doc_id < 9000").limit(40)
    for r in language_id.predict(some.select("doc_id", "text"), model).collect():
        lang, score = plain_language(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_line_stage(steps):
    before = rows_of(steps["line_dedup"])
    gone = brute_lines([(r[0], r[1]) for r, n in before.items() for _ in range(n)])
    want = Counter()
    for (d, text, lang, source, _), n in before.items():
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone)
        want[d, left, lang, source, len(left)] += n
    assert rows_of(steps["simhash"]) == want and gone


def test_simhash_stage(steps):
    before, got = rows_of(steps["simhash"]), rows_of(steps["mixing"])
    rows = sorted(before, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = [five_words(r[1]) for r in rows]
    linked = lambda a, b: sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    group = brute_components(list(range(len(rows))), linked)
    kept = Counter(group[rows.index(r)] for r in got.elements())
    assert set(kept) == set(group.values()) and set(kept.values()) == {1}  # one row of each group, and of none more
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(group[i], r[0])
    assert all(r[0] == least[group[rows.index(r)]] for r in got) and len(got) < len(rows)


def plain_rates(sizes, target):
    """Rates of one source by bisection of the tilt."""
    positive = [s for s in sizes if s]
    mean, total = sum(positive) / max(len(positive), 1), sum(sizes)
    if not positive or target >= 3 * total * (1 - 1e-12):
        return {s: 3.0 if s else 1.0 for s in sizes}
    rate = lambda s, t: math.exp(min(t * s / mean, math.log(3)))
    low, high = -1e4, 1e4
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(s * rate(s, middle) for s in sizes) < target else (low, middle)
    return {s: rate(s, low) if s else 1.0 for s in sizes}


def test_mixing_stage(steps):
    before, after = rows_of(steps["mixing"]), rows_of(steps["byte_bpe"])
    assert set(after) <= set(before)
    size = lambda r: len((r[1] or "").encode().split())
    held = {}
    for r, n in before.items():
        held.setdefault(r[3], []).extend([size(r)] * n)
    targets = plain_targets({s: sum(x) for s, x in held.items()})
    rates = {s: plain_rates(x, targets[s]) for s, x in held.items()}
    for r in mixing.mix_rates(steps["mixing"]).join(steps["mixing"].select("doc_id", "source"), "doc_id").collect():
        assert r.rate == pytest.approx(rates[r.source][r.size], rel=1e-6)
    far = 0
    for s, x in held.items():
        taken = sum(size(r) * n for r, n in after.items() if r[3] == s)
        assert abs(taken - targets[s]) <= max(x) / 2 + 1
    for r, n in before.items():
        assert after[r] <= 3 * n and (size(r) or after[r] == n)
        far += size(r) > 0 and abs(after[r] / n - rates[r[3]][size(r)]) >= 1
    assert far <= 2 * len(held)  # the corrections, of one cell each


def test_bpe_stage(steps):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = byte_bpe.vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = Counter()
    for (d, text, *_), n in rows_of(steps["byte_bpe"]).items():
        ids = theirs.encode_ordinary(text or "")
        starts = theirs.decode_with_offsets(ids)[1] if text and text.isascii() else None
        want[d, tuple(ids), hashlib.sha256((text or "").encode()).hexdigest(), starts and tuple(starts)] += n
    ascii_ = {(w[0], w[1]): w[3] for w in want}
    got = Counter((r.doc_id, tuple(r.ids), r.decoded_sha256, ascii_[r.doc_id, tuple(r.ids)] and tuple(r.starts)) for r in steps["result"].collect())
    assert got == want


def test_run_and_empty(spark, data, docs, steps, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    digests = lambda df: Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert digests(corpus_pipeline.run(spark, str(tmp_path))) == digests(steps["result"])
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, data)
        assert now.count() == 0
