"""Operators on Spark: odd rows, empty tables, and brute-force results."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashlode.llm import byte_bpe, embedding_dedup, graph, importance_quality, language_id, line_dedup, mixing, near_copies, progressive_jpeg, sharding, simhash, warc
from hashlode.llm import shared
from hashlode.llm.shared import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long word list " * 20_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "", 0), (3, "one two three four five six seven", "en", "a", 1), (4, "one two three four five six seven", "en", "a", 1),
    (4, "one two three four five six seven", "en", "a", 1), (None, "one two three four five six eight", "fr", "b", 1), (7, LONG, "en", "b", 1), (8, "...\n\n!!", "fr", None, 1), (9, "été ÀÉ\nété ÀÉ", "fr", "b", 1),
]
CLASHES = ["id", "h", "key", "size", "line", "doc", "fp", "shard", "rejected", "score", "removed", "component", "copies", "__doc", "__gone", "__key", "__size", "__h", "__lang", "lang_pred", "mark", "target", "copy"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_bpe_rows(odd, none):
    rows = byte_bpe.encode_texts(odd, *byte_bpe.vocabulary()).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == 0 == by[2].n_tokens and by[7].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and by[9].ends[-1] == len("été ÀÉ\nété ÀÉ")
    back = {r.doc_id: r.text for r in byte_bpe.decode_ids(byte_bpe.encode_texts(odd, *byte_bpe.vocabulary()), *byte_bpe.vocabulary()).collect()}
    assert back[9] == "été ÀÉ\nété ÀÉ" and back[1] == ""
    assert byte_bpe.encode_texts(none, *byte_bpe.vocabulary()).count() == 0
    packed = lambda r: b"".join(x.to_bytes(4, "little") for x in (*r.starts, *r.ends))
    digests = byte_bpe.encode_texts(odd, *byte_bpe.vocabulary(), ids=False, offsets=False, offsets_digest=True).collect()
    assert sorted((str(r.doc_id), r.offsets_sha256) for r in digests) == sorted((str(r.doc_id), hashlib.sha256(packed(r)).hexdigest()) for r in rows)


def test_language_rows(odd, none, docs):
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    out = language_id.predict(docs, model).where(language_id.held_out(F.col("doc_id")))
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    rows = language_id.predict(odd, model).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 8)} == {"und"} and all(r.rejected for r in rows if r.doc_id in (1, 2, 8))
    assert language_id.predict(none, model).count() == 0
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)


def test_whole_texts_are_read(docs):
    model = language_id.fit(docs)
    long = docs.where("lang = 'fr'").orderBy(F.desc(F.length("text"))).first().text
    a = language_id.logits([long * 400], model.table, model.bias)
    b = language_id.logits([long], model.table, model.bias)
    assert np.abs(a - b).max() < 0.05


def brute_lines(rows):
    lines = [(d, n, frozenset(x.encode().split())) for d, t in rows if t is not None and d is not None for n, x in enumerate(t.split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    found, seen = set(), defaultdict(list)
    for k, (d, n, s) in enumerate(lines):
        shared = Counter(x for w in s for x in seen[w])
        if any(9 * o >= 4 * (len(s) + len(lines[x][2])) and lines[x][:2] < (d, n) for x, o in shared.items()):
            found.add((d, n))
        for w in s:
            seen[w].append(k)
    return found


def test_lines_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    words = [f"w{i}" for i in range(30)]
    rng = np.random.default_rng(0)
    rows += [(10_000 + i, "\n".join(" ".join(rng.choice(words, rng.integers(1, 14))) for _ in range(12))) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows)
    for options in ({}, {"tile": 4, "word_tile": 20}):
        assert {(r.doc, r.line) for r in line_dedup.later_matches(df, **options).collect()} == want


def test_lines_odd_rows(odd, none):
    assert {(r.doc, r.line) for r in line_dedup.later_matches(odd).collect()} == {(4, 0), (9, 1)}
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[1] is None and by[2] == "" and by[4] == "" and by[9] == "été ÀÉ" and by[8] == "...\n\n!!"
    assert line_dedup.dedup_lines(none).count() == 0


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_simhash_against_brute_force(docs):
    for tile in (simhash.TILE, 3):
        rows = simhash.near_duplicates(docs, tile=tile).collect()
        fp = {r.doc_id: r.fp for r in rows}
        want = brute_components(sorted(fp), lambda a, b: ((fp[a] ^ fp[b]) & (2**64 - 1)).bit_count() <= 4)
        assert {r.doc_id: r.component_id for r in rows} == want


def test_simhash_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: (r.fp, r.component_id) for r in rows}
    assert len(rows) == len(ODD) and by[1] == (0, 1) == by[2] and by[4] == (by[3][0], 3)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.stage(spark, odd, "")
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 7, 8, 9]


def five_words(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def test_near_copies_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rng = np.random.default_rng(2)
    for i in range(12):  # near copies with more and more words changed, to both sides of 0.8
        base = [f"b{i}w{x}" for x in rng.integers(0, 400, 120)]
        for k in range(6):
            words = list(base)
            for x in rng.choice(120, k, replace=False):
                words[x] = f"c{i}k{k}x{x}"
            rows.append((10_000 + i * 10 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: five_words(t) for d, t in rows}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return x == y or 9 * len(x & y) >= 4 * (len(x) + len(y))

    want = brute_components(sorted(sets), linked)
    for options in ({}, {"tile": 3, "word_tile": 40}):
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(df, **options).collect()} == want
    kept = {r.doc_id for r in simhash.stage(spark, df, "").collect()}
    assert kept == {d for d, c in want.items() if d == c}
    far = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert any(far[d] == d != c for d, c in want.items())  # op7's radius alone leaves some of them


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sizes = np.array([1, 4, 5, 255, 256, 700])
    h = rng.integers(0, 2**64, int(sizes.sum()), np.uint64)
    got = near_copies.fingerprints(h, sizes)
    for fp, some in zip(got, np.split(h, np.cumsum(sizes)[:-1]), strict=True):
        assert [int(fp[0]) >> b & 1 for b in range(64)] == [int(2 * sum(int(x) >> b & 1 for x in some) > len(some)) for b in range(64)]
    assert len(set(got[5].tolist())) == near_copies.LANES

    base, flips = rng.integers(0, 2**64, (40, 4), np.uint64), rng.integers(0, 2**64, (40, 4, 2), np.uint64)
    fps = np.concatenate((base, base ^ (flips[..., 0] & flips[..., 1]))).T  # 64 of 256 bits apart on average
    size = rng.integers(70, 100, 80)
    apart = lambda i, j: sum((int(a) ^ int(b)).bit_count() for a, b in zip(fps[:, i], fps[:, j], strict=True))
    want = {(i, j) for j in range(80) for i in range(j) if apart(i, j) <= 64 and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])}
    for at_once in (near_copies.PAIRS_AT_ONCE, 7):
        monkeypatch.setattr(near_copies, "PAIRS_AT_ONCE", at_once)
        assert want == {(int(a), int(b)) for i, j in near_copies.close_pairs(fps, size, 64, (4, 5)) for a, b in zip(i, j, strict=True)} and 10 < len(want) < 40
    monkeypatch.undo()

    assert [len(x) for x in near_copies.tables(2048, 2048)] == [0]
    some = near_copies.tables(200_000, 2048)
    assert len({int(b) for t in some for b in t}) == sum(map(len, some)) and (1 - (1 - near_copies.APART) ** len(some[0])) ** len(some) <= near_copies.MISS
    rows = []
    for g in range(40):
        words = [f"g{g}w{x}" for x in rng.integers(0, 1000, 150)]
        rows += [(g, " ".join(words)), (1000 + g, " ".join([*words[:60], "changed", *words[61:]])), (2000 + g, " ".join(words[:75] + words[::-1][:75]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "BUCKET_ROWS", 16)
    groups = lambda **o: {r.doc_id: r.component_id for r in near_copies.near_copies(df, **o).collect()}
    assert len(near_copies.tables(len(rows), 16)) > 1 and groups() == {d: d if d >= 2000 else d % 1000 for d, _ in rows}
    assert groups(radius=-1) == {d: d for d, _ in rows}  # the links come from fingerprints only


def test_sets_are_sent_in_rounds(spark, monkeypatch):
    by_tiles, budget = {1: 100, 7: 700, 30: 3000}, 8000
    found = list(near_copies.rounds(by_tiles, budget))
    assert [d for lo, hi in found for d in range(lo, hi)] == list(range(30)) and len(found) < 30
    assert all(hi == lo + 1 or sum(w * (min(t, hi) - lo) for t, w in by_tiles.items() if t > lo) <= budget for lo, hi in found)
    words = [f"w{x}" for x in range(200)]
    df = spark.createDataFrame([(i, " ".join([*words[:100], f"own{i}", *words[100:]])) for i in range(16)], "doc_id long, text string")
    verified, sent = near_copies.verified_links, []

    def counted(sets, threshold):
        sent.append(sets.count())
        return verified(sets, threshold)

    monkeypatch.setattr(near_copies, "verified_links", counted)
    assert {r.component_id for r in near_copies.near_copies(df, tile=4).collect()} == {0}
    assert sent == [16] * 4  # never all pairs of tiles at once


def test_hot_keys_meet_in_parts(spark, docs, monkeypatch):
    rows = spark.range(500).select("id", F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 40).alias("k"), F.lit(1).alias("part"))
    told = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    want = sorted(map(tuple, rows.join(told.drop("n"), "k").select("k", "id", "part", "s").collect()))
    texts = docs.unionByName(docs.limit(3)).withColumn("text", F.when(F.col("doc_id") % 3 == 0, "one text of a third of all rows").otherwise(F.col("text")))
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(texts).collect()}
    kept = sorted(r.doc_id for r in simhash.stage(spark, texts, "").collect())
    monkeypatch.setattr(shared, "PART_ROWS", 5)
    found = shared.dealt_join(rows, told, "k", ["id"])
    assert "parts" in found._jdf.queryExecution().analyzed().toString() and found.columns == ["k", "id", "part", "s"]
    assert sorted(map(tuple, found.collect())) == want
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(texts).collect()} == groups
    assert sorted(r.doc_id for r in simhash.stage(spark, texts, "").collect()) == kept
    assert shared.dealt_join(rows.limit(0), told.limit(0), "k", ["id"]).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    vectors = np.concatenate((base, base + rng.normal(size=base.shape) * 0.3, base[:5], base[:3] * 2.5)).astype(np.float32)
    rows = [(i, [float(x) for x in v], int(i % 2)) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, rows[0][1], None), (1004, [None] * 16, 0), (1005, [], 0), (1006, rows[0][1][:8], 0), (1007, [float("inf")] * 16, 1), (1008, [-x for x in rows[0][1]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "n", "c", "v", "k1")})
    good = {i: (np.array(v, float) / np.linalg.norm(v), y) for i, v, y in rows if i < 1000 or i in (1006, 1008)}

    def linked(a, b):
        (x, p), (y, q) = good[a], good[b]
        return p == q and len(x) == len(y) and x @ y >= 0.93

    want = brute_components(sorted(good), linked) | {i: i for i in (1000, 1001, 1002, 1003, 1004, 1005, 1007)}
    count = {i: sum(linked(i, j) for j in good if j != i) if i in good else 0 for i in want}
    for options in ({}, {"tile": 7, "pivots": 3}):
        got = embedding_dedup.near_duplicates(df, **options).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (count[i], want[i], want[i] == i) for i in want}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_codes_miss_no_link(spark):
    rng = np.random.default_rng(4)
    for dim in (8, 64, 100):
        base = rng.normal(size=(600, dim))
        unit = embedding_dedup._unit(np.concatenate((base, base + rng.normal(size=base.shape) * rng.uniform(0.05, 0.5, (600, 1)))))
        codes, f, planes, low, step = embedding_dedup.encode(unit)
        est, true = embedding_dedup.estimates(codes, f, planes, low, step, dim), unit @ unit.T
        other = ~np.eye(len(unit), dtype=bool)
        assert abs((est - true)[other].mean()) < 0.005  # without bias
        asked = est >= 0.93 - embedding_dedup.margins(f, step, dim, 0.93, embedding_dedup.EPSILON)
        assert asked[true >= 0.93].all() and (dim == 8 or asked.mean() < 0.02)


def test_warc(spark):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nWARC/1.1\r\nb", "x" * 1500), (4, "u", "x" * 1500), (5, "u", "é" * 400 + "\r\n\r\n" + magic + "z" * 5000), (6, "u", "WARC/1.1\r\n" * 30), (8, "u", "x" * 1500), (None, "u", "x" * 1500), (9, "u", "y" * 999), (10, "u", "y" * 999)]
    rows += [(100 + i, "u", "WARC/1.1\r\n" + "q" * i) for i in range(30)]
    said = ["Content-Length: " + "9" * 30, "Content-Length: " + "9" * 18, "Content-Length: 0\r\nX-Row-Id: --5", "Content-Length: 0\r\nX-Row-Id: " + "8" * 25, "Content-Length: -4"]
    rows += [(200 + i, "u", f"WARC/1.1\r\nWARC-Type: response\r\n{x}\r\n\r\n") for i, x in enumerate(said)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "n", "payload", "id")})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        path = new_path(spark, "warc")
        warc.write_archives(df.coalesce(2), path)
        got = sorted((r.id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    twice = lambda i, h: h == "x" * 1500 and i != 8
    body = lambda h: (h or "").encode()
    assert got == sorted((i or 0, len(body(h)), hashlib.sha1(body(h)).hexdigest(), "revisit" if twice(i, h) else "response", 8 if twice(i, h) else None) for i, _, h in rows)
    path = new_path(spark, "warc")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_warc_cut_off(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nX-Row-Id: {}\r\nContent-Length: {}\r\n\r\n"
    whole = head.format(1, 7) + "\r\n\r\nabc" + "\r\n\r\n"
    for stated in (2000, 1 << 61):
        path = tmp_path / f"{stated}.warc"
        path.write_bytes((whole + head.format(2, stated) + "\r\n\r\n" + head.format(3, 0)).encode())
        got = {r.id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, f"file://{path}").collect()}
        left = head.format(3, 0).encode()
        assert got == {1: (3, hashlib.sha1(b"abc").hexdigest()), 2: (len(left), hashlib.sha1(left).hexdigest())}


def test_warc_chains():
    rng = np.random.default_rng(3)
    for _ in range(200):
        offset = np.unique(rng.integers(0, 60, 25))
        next_ = offset + rng.integers(1, 12, len(offset))
        entered = rng.random(len(offset)) < 0.2
        to, ends, marks = dict(zip(offset.tolist(), next_.tolist(), strict=True)), [], set(offset[entered].tolist())
        for x in offset.tolist():
            if x in marks:
                marks.add(to[x])
            while x in to:
                x = to[x]
            ends.append(x)
        assert warc.chain_ends(offset, next_).tolist() == ends
        assert warc.chain_marks(offset, next_, entered).tolist() == [x in marks for x in offset.tolist()]
    empty = np.zeros(0, np.int64)
    assert not len(warc.chain_ends(empty, empty)) and not len(warc.chain_marks(empty, empty, empty > 0))


def test_media_rows(spark, odd, none):
    media = progressive_jpeg.store_texts(odd)
    got = {r.doc_id: r for r in progressive_jpeg.media_features(media).collect()}
    for i, t, *_ in ODD:
        p = progressive_jpeg.padded((t or "").encode())
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[3].media_sha256 == got[4].media_sha256 and got[1].feature == got[2].feature
    bad = media.union(spark.createDataFrame([(50, None), (51, b"no"), (52, b"\xff\xd8\xff\xda")], "doc_id long, media binary"))
    rows = progressive_jpeg.decode_media(bad).collect()
    assert sum(r.error is not None for r in rows) == 3 and all(len(r.rgb) == r.height * r.width * 3 for r in rows if r.error is None)
    assert progressive_jpeg.media_features(progressive_jpeg.store_texts(none)).count() == 0


def test_broken_media_spoil_no_other_row():
    rng = np.random.default_rng(5)
    texts = [("hello wörld %d " % i * int(rng.integers(1, 60))).encode() for i in range(8)]
    media = progressive_jpeg.store_payloads([progressive_jpeg.padded(t) for t in texts], [len(t) for t in texts])
    said = Counter()
    for k in range(500):
        m = bytearray(media[int(rng.integers(8))])
        if k % 3 == 1:
            m = m[: int(rng.integers(len(m)))]
        for _ in range(3 * (k % 3 != 1)):
            m[int(rng.integers(len(m) if k % 3 else min(len(m), 300)))] = int(rng.integers(256))
        ((_, found),) = progressive_jpeg._decoded(progressive_jpeg.pa.array([media[0], bytes(m), media[1]], "binary"))
        for x, t in ((found[0], texts[0]), (found[2], texts[1])):
            payload, n = progressive_jpeg.payload_of(*x)
            assert payload[:n] == t
        assert k % 3 != 1 or isinstance(found[1], str)  # a file that is cut off says so
        said[isinstance(found[1], str)] += 1
        if not isinstance(found[1], str):
            progressive_jpeg.to_rgb(*found[1])
    assert said[True] > 200


def test_broken_media_rows(spark):
    good = progressive_jpeg.store_payloads([progressive_jpeg.padded(b"abc")], [3])[0]
    rows = [(1, good), (2, good[: len(good) // 2]), (3, None), (4, b""), (5, good.replace(b"payload", b"PAYLOAD")), (6, good)]
    df = spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)
    out = {r.doc_id: r for r in progressive_jpeg.media_features(df).collect()}
    assert out[1].n_bytes == out[6].n_bytes == 3 and out[1].error is None and all(out[i].error and out[i].n_bytes is None for i in (2, 3, 4, 5))
    tensors = {r.doc_id: r for r in progressive_jpeg.decode_media(df).collect()}
    assert tensors[1].rgb == tensors[6].rgb == tensors[5].rgb and all(tensors[i].rgb is None and tensors[i].error for i in (2, 3, 4))


def test_shards(odd, none, docs):
    for options in ({}, {"block_groups": 20, "fan_in": 2}):
        rows = sharding.shard_documents(docs, **options).collect()
        assert len(rows) == docs.count()
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    text = {r.doc_id: r.text for r in docs.collect()}
    at = defaultdict(set)
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        at[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in at.values())
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == len(ODD) and {r.size for r in rows if r.doc_id in (1, 2)} == {1} and len({r.shard for r in rows if r.doc_id in (3, 4)}) == 1
    assert sharding.shard_documents(none).count() == 0


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_ = [s for s in order if s not in capped]
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return capped | target
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(odd, none, docs):
    df = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").when(F.col("doc_id") % 50 == 1, "a").when(F.col("doc_id") % 7 == 1, F.lit(None)).otherwise(F.col("source")))
    rows = mixing.mix_rates(df).join(df.select("doc_id", "source"), "doc_id").collect()
    words = {r.doc_id: len(r.text.encode().split()) for r in df.collect()}
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size and 0 <= r.rate <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    want = plain_targets(dict(sizes))
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix_rates(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    copies = Counter(r.doc_id for r in mixing.mix_documents(df).collect())
    assert copies == {r.doc_id: r.copies for r in rows if r.copies}
    assert len(mixing.mix_rates(odd).collect()) == len(ODD) and mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix_rates(none).count() == 0


def plain_weights(docs, good):
    """Counts of hashed 1- and 2-grams and mean log ratios, one text at a time."""
    grams = {d: importance_quality._ngrams([(t or "").encode()])[0].tolist() for d, t in docs}
    raw, target = Counter(x for g in grams.values() for x in g), Counter(x for d, g in grams.items() if d in good for x in g)
    n_raw, n_target, size = sum(raw.values()), sum(target.values()), importance_quality.BUCKETS
    prior = max(1.0, n_target / 1000)

    def ratio(x):
        p = (raw[x] + 0.1) / (n_raw + 0.1 * size)
        return np.log((target[x] + prior * p) / (n_target + prior) / p)

    return {d: 100 * sum(map(ratio, g)) / len(g) if g else None for d, g in grams.items()}


def test_quality(odd, none, docs, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = importance_quality.select(docs, labels).collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    want = plain_weights([(r.doc_id, r.text) for r in docs.collect()], good)
    assert all((r.log_weight is None and want[r.doc_id] is None) or abs(r.log_weight - want[r.doc_id]) < 1e-3 for r in rows) and len(rows) == len(want)
    k = 30
    top = importance_quality.select(docs, labels, k=k).collect()
    assert sum(r.kept for r in top) == k and min(r.key for r in top if r.kept) >= max(r.key for r in top if not r.kept)
    out = {r.doc_id: r for r in importance_quality.select(odd, labels, k=5).collect()}
    assert not out[1].kept and not out[2].kept and out[1].log_weight is None and out[1].n_grams == 0  # texts without words come last
    assert len(importance_quality.select(odd, labels).collect()) == len(ODD) and importance_quality.select(none, labels).count() == 0
    assert all(r.log_weight in (0, None) and r.kept for r in importance_quality.select(odd, labels.limit(0)).collect())


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = importance_quality.select(docs, labels.where(~held)).join(labels.where(held), "doc_id", "left").collect()
    good, bad = ([r.log_weight for r in rows if r.quality == q and r.log_weight is not None] for q in (1, 0))
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) > 0.9
    bands = defaultdict(list)
    for r in rows:
        bands[max(r.n_grams, 1).bit_length()].append(r.kept)
    assert all(0.5 < np.mean(x) < 1 for x in bands.values() if len(x) >= 50)  # no length is kept whole or left out
