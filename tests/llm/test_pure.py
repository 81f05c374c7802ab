"""Parts that need no Spark, against plain versions."""

import random

import numpy as np
import pytest

from hashlode.llm import byte_bpe, graph, line_dedup, progressive_jpeg, set_join, sharding, simhash, spans


def test_word_hashes_see_words_only():
    h, owner = spans.word_hashes([b"the cat", b"", b" cat\nthe\x0b a\xc2\xa0b", b"ca"])
    assert owner.tolist() == [0, 0, 2, 2, 2, 3] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 4


def test_components():
    assert graph.local_labels(6, np.array([5, 3, 1]), np.array([4, 5, 2])).tolist() == [0, 1, 1, 3, 3, 3]
    assert graph.local_labels(2, np.zeros(0, int), np.zeros(0, int)).tolist() == [0, 1]


def test_tokens_as_tiktoken():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = byte_bpe.vocabulary()
    own = byte_bpe.codec(path, pattern)
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "  \n\n a  b's 'LL \u0085\u001c x", "a😀é漢字🏳️‍🌈", "x" * 3000, "<|endoftext|>", "".join(map(chr, range(0x3000)))]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), 32, 10, rng.randrange(0xE000, 0x1FFFE)])) for _ in range(300)) for _ in range(50)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<u4")
        assert ids.tolist() == theirs.encode_ordinary(t) and own.decode(ids) == t.encode()
        a, b = own.offsets(ids, t.encode())
        assert (not t and not len(a)) or (a[0] == 0 and b[-1] == len(t) and (a < b).all())


def test_split_character_offsets():
    own = byte_bpe.codec(*byte_bpe.vocabulary())
    ids = np.frombuffer(own.encode("𒀀"), "<u4")
    a, b = own.offsets(ids, "𒀀".encode())
    assert len(ids) > 1 and set(a.tolist()) == {0} and set(b.tolist()) == {1}


def test_bit_sliced_links():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [base ^ sum((np.uint64(1) << np.uint64(x) for x in rng.choice(64, k, replace=False)), np.uint64(0)) for k in (1, 3, 4, 5, 6)]
    f = np.unique(np.concatenate([base, *near, np.array([0], np.uint64)]))
    n = len(f)
    got = {p for i, j in simhash.links(f, np.arange(1, n + 1), np.full(n, n)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if bin(int(f[i]) ^ int(f[j])).count("1") <= 4}


def test_every_choice_of_bits_is_exact():
    for n in (10, 10**8, 10**12, 10**15):
        j, masks = simhash.choices(4, n)
        assert all(any((m & d) == 0 for m in masks) for d in (sum(1 << b for b in random.Random(k).sample(range(64), 4)) for k in range(50)))
        assert 1 <= j <= 4


def test_fingerprint():
    import xxhash

    assert simhash.fingerprint(b"  \n") == 0
    assert simhash.fingerprint(b"Ab  cD") == xxhash.xxh64_intdigest(b"ab cd", 42)
    w = [b"w%d" % (i % 7) for i in range(50)]
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(47)]
    assert simhash.fingerprint(b"\t".join(w)) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_signature_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for size in (1, 5, 60, 700):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: size // 2], rng.integers(0, 1 << 63, size // 2 + 1, dtype=np.uint64))))
        first = np.zeros(1, int)
        pairs = zip(set_join.signature(a, first), set_join.signature(b, first), strict=True)
        assert sum(set_join.apart(x, y)[0] for x, y in pairs) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(line_dedup, "PIECE_BYTES", 10)
    text = b"\n".join(b"line %d" % i for i in range(9)) + b"\n\nend"
    cut, owner, number = line_dedup.pieces([b"a", text])
    assert b"\n".join(cut[1:]) == text and owner[0] == 0 and len(cut) > 3
    assert [x for p, n in zip(cut[1:], number[1:], strict=True) for x in range(n, n + p.count(b"\n") + 1)] == list(range(11))


def test_differencing():
    sums, part = sharding.difference_items([8, 7, 6, 5, 4], 2)
    assert sorted(sums) == [14, 16] and [sum(s for s, p in zip([8, 7, 6, 5, 4], part, strict=True) if p == k) for k in (0, 1)] == sums
    rng = random.Random(3)
    sizes = [rng.randrange(1, 1000) for _ in range(2000)]
    sums, part = sharding.difference_items(sizes, 16)
    assert max(sums) - min(sums) <= 2 and [sum(s for s, p in zip(sizes, part, strict=True) if p == k) for k in range(16)] == sums
    assert sharding.difference_items([], 3) == ([0, 0, 0], [])


class Bits:
    def __init__(self):
        self.out, self.n, self.acc = bytearray(), 0, 0

    def put(self, value, length):
        for k in reversed(range(length)):
            self.acc = self.acc << 1 | value >> k & 1
            self.n += 1
            if self.n == 8:
                self.out.append(self.acc)
                if self.acc == 255:
                    self.out.append(0)
                self.n = self.acc = 0

    def end(self):
        while self.n:
            self.put(1, 1)
        return bytes(self.out)


def slow_progressive(coef, bands):
    """A grey image of len(coef) blocks in one row, written symbol by symbol: DC at 1 and 0, each band at 2, 1, 0."""
    m = progressive_jpeg._marker
    lengths = dict.fromkeys(range(0xFB), 9)
    body, codes = progressive_jpeg.canonical(lengths)
    out = b"\xff\xd8" + m(0xDB, b"\0" + b"\2" * 64) + m(0xC4, b"\x00" + body) + m(0xC4, b"\x10" + body)
    out += m(0xC2, b"\x08" + (8).to_bytes(2, "big") + (8 * len(coef) - 3).to_bytes(2, "big") + b"\x01\x01\x11\x00")
    sos = lambda ss, se, a: m(0xDA, bytes((1, 1, 0, ss, se, a)))
    put = lambda w, s: w.put(*codes[s])
    w, last = Bits(), 0
    for c in coef:
        d = (int(c[0]) >> 1) - last
        last += d
        s = abs(d).bit_length()
        put(w, s)
        w.put(d if d >= 0 else d + (1 << s) - 1, s)
    out += sos(0, 0, 0x01) + w.end()
    w = Bits()
    for c in coef:
        w.put(int(c[0]) & 1, 1)
    out += sos(0, 0, 0x10) + w.end()
    for ss, se in bands:
        for al in (2, 1, 0):
            w, run, held = Bits(), 0, []

            def flush():
                nonlocal run, held
                if run:
                    k = run.bit_length() - 1
                    put(w, k << 4)
                    w.put(run - (1 << k), k)
                for b in held:
                    w.put(b, 1)
                run, held = 0, []

            for c in coef:
                size = [abs(int(x)) >> al for x in c]
                fresh = [k for k in range(ss, se + 1) if size[k] and (al == 2 or size[k] == 1)]
                end = max(fresh, default=-1)
                r, bits = 0, []
                for k in range(ss, end + 1):
                    if al < 2 and size[k] > 1:
                        bits.append(size[k] & 1)
                        continue
                    if not size[k]:
                        r += 1
                        if r == 16 and any(x > k for x in fresh):
                            flush()
                            put(w, 0xF0)
                            for b in bits:
                                w.put(b, 1)
                            r, bits = 0, []
                        continue
                    flush()
                    v = size[k] if c[k] > 0 else -size[k]
                    if al == 2:
                        s = size[k].bit_length()
                        put(w, r << 4 | s)
                        w.put(v if v > 0 else v + (1 << s) - 1, s)
                    else:
                        put(w, r << 4 | 1)
                        w.put(int(v > 0), 1)
                        for b in bits:
                            w.put(b, 1)
                    r, bits = 0, []
                if end < se:
                    run += 1
                    held += bits + [size[k] & 1 for k in range(max(end + 1, ss), se + 1) if al < 2 and size[k] > 1]
            flush()
            out += sos(ss, se, (0x00 if al == 2 else (al + 1) << 4) | al) + w.end()
    return out + b"\xff\xd9"


def test_general_progressive_files():
    rng = np.random.default_rng(5)
    images = []
    for blocks in (1, 3, 40):
        coef = np.where(rng.random((blocks, 64)) < 0.12, rng.integers(-40, 41, (blocks, 64)), 0)
        coef[::4, 1:] = 0
        images.append((coef, progressive_jpeg.parse(slow_progressive(coef, [(1, 5), (6, 63)]))))
    found = progressive_jpeg.coefficients([i for _, i in images])
    for (want, image), got in zip(images, found, strict=True):
        assert (got == want).all()
        rgb = progressive_jpeg.to_rgb(image, got)
        assert rgb.shape == (8, image.width, 3) and (rgb[..., 0] == rgb[..., 1]).all()
        y, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
        plain = np.zeros((8, 8))
        for k, at in enumerate(progressive_jpeg.ZIGZAG):
            v, u = divmod(int(at), 8)
            scale = (2**-0.5 if u == 0 else 1) * (2**-0.5 if v == 0 else 1) / 4
            plain += 2 * want[0, k] * scale * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
        assert np.abs(np.clip(plain + 128, 0, 255) - rgb[:, :8, 0][:, : image.width]).max() <= 1 if image.width >= 8 else True


def test_payloads_come_back():
    texts = [b"", b"hello " * 500, bytes(range(256)) * 9, "é漢".encode() * 3000, b"\xff" * 576]
    files = progressive_jpeg.store_payloads([progressive_jpeg.padded(t) for t in texts], [len(t) for t in texts])
    images = [progressive_jpeg.parse(f) for f in files]
    for t, i, c in zip(texts, images, progressive_jpeg.coefficients(images), strict=True):
        assert progressive_jpeg.payload_of(i, c) == (progressive_jpeg.padded(t), len(t)) and len(progressive_jpeg.padded(t)) % 576 == 0


def test_no_jpeg():
    for bad in (b"", b"abc", b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            progressive_jpeg.parse(bad)
