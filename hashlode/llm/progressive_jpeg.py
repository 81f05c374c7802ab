"""Progressive JPEG media columns in numpy.

Decoding: the scans of a file (spectral selection and successive approximation, first passes and refinements) are
accumulated into arrays of quantised coefficients; these are dequantised, inverse-transformed, cut to the image,
chroma is upsampled by repetition, and the full-resolution RGB tensor stored. Entropy-coded data is decoded in
lockstep: every restart interval of all files of a block is a lane, and one step of numpy operations decodes a symbol
of each lane (in refinements, up to the end of a coefficient run). Files are decoded in blocks of bounded size.

Lossless payloads: a file's unit is the quantised coefficient. ``store_payloads`` puts one byte into each, as a
signed value of magnitude 2 to 129 given by the byte's place in a fixed order, in a 4:2:0 image with unit
quantisation; the payload comes back bit by bit from the coefficients.

Null text is stored as an empty payload. Data that is null, or no baseline-DCT-precision progressive JPEG of 1 or 3
components, or is cut off, or whose tables or scans contradict themselves, decodes to nulls with the reason, and
spoils no other row. Equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashlode.llm.shared import stored, table
from hashlode.llm.spans import tidy

UNIT = 576
RESTART = 8
BLOCK_BYTES = 1 << 21
MAX_MCUS = 4000
#: Bytes in the order of their use in Western text, the common ones first; the others follow by value.
COMMON = b" e\xffntahiors\xc3dulc.gb,mf\xa9wypTvkqEANOSIz\n\xb3\xa8\xb1"
ORDER = COMMON + bytes(b for b in range(256) if b not in COMMON)


def zigzag() -> np.ndarray:
    """Natural index of each zigzag place."""
    walk = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([i * 8 + j for i, j in walk])


ZIGZAG = zigzag()
_RANK = np.empty(256, np.int64)
_RANK[list(ORDER)] = np.arange(256)
VALUE = (2 + _RANK // 2) * np.where(_RANK % 2, -1, 1)  # coefficient of each byte
_BYTE_OF = np.full(260, 0, np.uint8)
_BYTE_OF[VALUE + 130] = np.arange(256)


# Huffman tables of stored payloads: code lengths by symbol
DC_LENGTHS = {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7}
AC_LENGTHS = {1: 2, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
EOB_LENGTHS = {0x30: 1, 0x00: 3, 0x10: 3, 0x20: 3}


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(DHT body, (code, length) by symbol)."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, codes = 0, 0, {}
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)) + bytes(symbols), codes


def _signed_bits(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << s) - 1, v)


def _size(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1.0)).astype(np.int64)


def _coded(values: np.ndarray, codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(code with value bits, length) of each value, by its size category."""
    s = _size(values)
    base = np.array([codes[int(x)][0] for x in s])
    length = np.array([codes[int(x)][1] for x in s])
    return (base << s) | _signed_bits(values, s), length + s


_DC_BODY, _DC_CODES = canonical(DC_LENGTHS)
_AC_BODY, _AC_CODES = canonical(AC_LENGTHS)
_EOB_BODY, _EOB_CODES = canonical(EOB_LENGTHS)
_DIFFS = np.arange(-400, 401)
_DC_CODE, _DC_LEN = _coded(_DIFFS, _DC_CODES)
_AC_CODE, _AC_LEN = _coded(np.sign(VALUE) * (np.abs(VALUE) >> 1), _AC_CODES)
_LOW = (np.abs(VALUE) & 1).astype(np.int64)


def _marker(code: int, body: bytes) -> bytes:
    return bytes((0xFF, code)) + (len(body) + 2).to_bytes(2, "big") + body


_TABLES = (
    _marker(0xDB, b"\0" + b"\1" * 64) + _marker(0xC4, b"\x00" + _DC_BODY) + _marker(0xC4, b"\x10" + _AC_BODY) + _marker(0xC4, b"\x11" + _EOB_BODY) + _marker(0xDD, RESTART.to_bytes(2, "big"))
)
_SOS_DC = [_marker(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x00" + bytes((a,))) for a in (0x01, 0x10)]
_SOS_AC = [[_marker(0xDA, bytes((1, c, t, 1, 63, a))) for c in (1, 2, 3)] for t, a in ((0x00, 0x01), (0x01, 0x10))]


def _pack(codes: np.ndarray, lengths: np.ndarray, seg: np.ndarray, n_seg: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (of at most 33 bits) of each segment in order -> (bytes, bytes of each segment), padded by ones."""
    bits = np.bincount(seg, weights=lengths, minlength=n_seg).astype(np.int64)
    size = -(-bits // 8)
    base = (np.cumsum(size) - size) * 8
    before = np.cumsum(lengths) - lengths
    first = np.cumsum(bits) - bits
    pos = before - first[seg] + base[seg]
    pad = size * 8 - bits
    pos = np.concatenate((pos, base + bits))
    lengths = np.concatenate((lengths, pad))
    codes = np.concatenate((codes, (1 << pad) - 1)).astype(np.uint64)
    shifted = codes << (64 - (pos & 31) - lengths).astype(np.uint64) * (lengths > 0)
    word = pos >> 5
    n = int(size.sum()) // 4 + 3
    total = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n)
    total[1:] += np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[:-1]
    return np.frombuffer(total.astype(">u4").tobytes(), np.uint8)[: int(size.sum())], size


def _stuffed(packed: np.ndarray, size: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-stuffed segments, with restart markers after all that are not the last of their scan -> (bytes, sizes)."""
    ff = packed == 0xFF
    takes = 1 + ff.astype(np.int64)
    ends = np.cumsum(size) - 1
    takes[ends] += np.where(last, 0, 2)
    after = np.cumsum(takes)
    out = np.zeros(int(after[-1]) if len(after) else 0, np.uint8)
    at = after - takes
    out[at] = packed  # a stuffed zero follows by itself
    mark = after[ends][~last]
    out[mark - 2] = 0xFF
    out[mark - 1] = 0xD0 + number[~last] % 8
    return out, np.diff(np.concatenate(([0], after[ends])))


def store_payloads(payloads: list[bytes], stated: list[int]) -> list[bytes]:
    """Progressive JPEG files whose coefficients are the payloads' bytes; payload lengths are multiples of UNIT."""
    shapes, grids = [], []
    for p in payloads:
        mcus = -(-len(p) // 384)
        cols = -(-mcus // MAX_MCUS)
        rows = -(-mcus // cols)
        shapes.append((rows, cols))
        grids.append(rows * cols)
    n_mcu = np.array(grids)
    # blocks in the order Y, Cb, Cr of each image; what the payload leaves is filled with bytes 255
    flat = np.frombuffer(b"".join(p + b"\xff" * (g * 384 - len(p)) for p, g in zip(payloads, grids, strict=True)), np.uint8).reshape(-1, 64)
    first = np.concatenate(([0], np.cumsum(n_mcu * 6)))[:-1]
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # per scan: (bytes, end of each image)

    def scan(codes: np.ndarray, lengths: np.ndarray, seg: np.ndarray, segs_of: np.ndarray) -> None:
        packed, size = _pack(codes, lengths, seg, int(segs_of.sum()))
        ends = np.cumsum(segs_of)
        last = np.zeros(int(segs_of.sum()), bool)
        last[ends - 1] = True
        number = np.arange(len(last)) - np.repeat(ends - segs_of, segs_of)
        out, sizes = _stuffed(packed, size, number, last)
        parts.append((out, np.cumsum(sizes)[ends - 1]))

    # DC, interleaved: four luma blocks and two of chroma to an MCU
    order = []
    for f, (rows, cols) in zip(first, shapes, strict=True):
        luma = f + np.arange(4 * rows * cols).reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
        chroma = f + 4 * rows * cols + np.arange(rows * cols)[:, None]
        order.append(np.concatenate((luma, chroma, chroma + rows * cols), axis=1))
    order = np.concatenate(order)
    dc = VALUE[flat[order, 0]]  # (MCUs, 6)
    place = np.arange(len(order)) - np.repeat(np.cumsum(n_mcu) - n_mcu, n_mcu)
    starts = place % RESTART == 0
    segs_of = -(-n_mcu // RESTART)
    seg = np.cumsum(starts) - 1
    high = dc >> 1
    luma = high[:, :4].reshape(-1)
    diff = np.empty_like(high)
    before = np.concatenate(([0], luma[:-1]))
    before[np.flatnonzero(starts) * 4] = 0
    diff[:, :4] = (luma - before).reshape(-1, 4)
    for c in (4, 5):
        before = np.concatenate(([0], high[:-1, c]))
        before[starts] = 0
        diff[:, c] = high[:, c] - before
    scan(_DC_CODE[diff + 400].reshape(-1), _DC_LEN[diff + 400].reshape(-1), np.repeat(seg, 6), segs_of)
    # AC of each component: first pass without the lowest bit, then that bit
    components = []
    for c in range(3):
        n = n_mcu * (4 if c == 0 else 1)
        f = first + (0, 4, 5)[c] * n_mcu
        blocks = np.repeat(f - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        place = np.arange(len(blocks)) - np.repeat(np.cumsum(n) - n, n)
        components.append((blocks, np.cumsum(place % RESTART == 0) - 1, -(-n // RESTART)))
    for blocks, seg, segs in components:
        ac = flat[blocks, 1:]
        code, length = _AC_CODE[ac].reshape(-1, 21, 3), _AC_LEN[ac].reshape(-1, 21, 3)
        if length.sum(2).max() > 33:  # the rarest bytes: one by one
            scan(code.reshape(-1), length.reshape(-1), np.repeat(seg, 63), segs)
            continue
        joined = (((code[..., 0] << length[..., 1]) | code[..., 1]) << length[..., 2]) | code[..., 2]
        scan(joined.reshape(-1), length.sum(2).reshape(-1), np.repeat(seg, 21), segs)
    scan((dc & 1).reshape(-1), np.ones(dc.size, np.int64), np.repeat(np.cumsum(starts) - 1, 6), segs_of)
    powers = 1 << np.arange(20, -1, -1)
    for blocks, seg, segs in components:
        run = np.bincount(seg)
        category = np.floor(np.log2(run)).astype(np.int64)
        code = np.array([_EOB_CODES[int(c) << 4][0] for c in category]) << category | (run - (1 << category))
        length = np.array([_EOB_CODES[int(c) << 4][1] for c in category]) + category
        low = _LOW[flat[blocks, 1:]].reshape(-1, 3, 21) @ powers
        all_codes = np.concatenate((code[:, None], np.zeros((len(run), 3 * RESTART), np.int64)), axis=1)
        all_len = np.concatenate((length[:, None], np.zeros((len(run), 3 * RESTART), np.int64)), axis=1)
        inside = np.arange(len(seg)) - np.repeat(np.cumsum(run) - run, run)
        for k in range(3):
            all_codes[seg, 1 + 3 * inside + k] = low[:, k]
            all_len[seg, 1 + 3 * inside + k] = 21
        scan(all_codes.reshape(-1), all_len.reshape(-1), np.repeat(np.arange(len(run)), 1 + 3 * RESTART), segs)
    heads = [_SOS_DC[0], *_SOS_AC[0], _SOS_DC[1], *_SOS_AC[1]]
    cuts = [np.concatenate(([0], end)) for _, end in parts]
    data = [out.tobytes() for out, _ in parts]
    files = []
    for i, (rows, cols) in enumerate(shapes):
        sof = b"\x08" + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"
        comment = f"payload {len(payloads[i])} of {stated[i]}".encode()
        body = b"".join(h + d[c[i] : c[i + 1]] for h, d, c in zip(heads, data, cuts, strict=True))
        files.append(b"\xff\xd8" + _TABLES + _marker(0xC2, sof) + _marker(0xFE, comment) + body + b"\xff\xd9")
    return files


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    rows: int = 0  # blocks with image data
    cols: int = 0
    wide: int = 0  # blocks of a row, whole MCUs
    high: int = 0
    start: int = 0  # first block in the image's coefficients


@dataclass
class Scan:
    components: list[int]
    dc: list[bytes]
    ac: list[bytes]
    band: tuple[int, int, int, int]  # first, last, bit position before, after
    restart: int
    segments: list[bytes]


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    @property
    def blocks(self) -> int:
        return sum(c.wide * c.high for c in self.components)


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RST = re.compile(rb"\xff[\xd0-\xd7]")


def parse(data: bytes) -> Image:
    """Headers, tables and the restart intervals of every scan; raises ValueError for what is not handled."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, tables, restart, at = Image(), {}, 0, 2
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        code = data[at + 1] if at + 3 < len(data) else 0xD9
        if code == 0xD9:
            break
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : end]
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 << wide
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif code == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif code == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif code == 0xFE:
            image.comment = body
        elif code == 0xC2:
            if body[0] != 8 or body[5] not in (1, 3):
                raise ValueError("not 8 bits of 1 or 3 components")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            h, v = max(c.h for c in image.components), max(c.v for c in image.components)
            start = 0
            for c in image.components:
                c.cols, c.rows = -(-(-(-image.width * c.h // h)) // 8), -(-(-(-image.height * c.v // v)) // 8)
                c.wide, c.high = -(-image.width // (8 * h)) * c.h, -(-image.height // (8 * v)) * c.v
                c.start, start = start, start + c.wide * c.high
        elif code in (0xC0, 0xC1, 0xC3) or 0xC5 <= code <= 0xCF:
            raise ValueError("not a Huffman-coded progressive JPEG")
        elif code == 0xDA:
            found = _NEXT.search(data, end)
            stop = found.start() if found else len(data)
            ids = [c.id for c in image.components]
            named = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            ss, se, a = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            segments = [x.replace(b"\xff\x00", b"\xff") for x in _RST.split(data[end:stop])]
            image.scans.append(Scan([c for c, _ in named], [tables.get(t >> 4, b"") for _, t in named], [tables.get(0x10 | t & 15, b"") for _, t in named], (ss, se, a >> 4, a & 15), restart, segments))
            at = stop
            continue
        at = end
    if not image.components or not image.width or not image.height:
        raise ValueError("no progressive frame")
    if data[at : at + 2] != b"\xff\xd9":
        raise ValueError("cut off")
    _check(image, len(data))
    return image


def _check(image: Image, size: int) -> None:
    """Raises ValueError for whatever the decoding steps take for granted and the file does not hold."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    if any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 or h % c.h or v % c.v for c in image.components):
        raise ValueError("sampling factors not handled")
    if any(len(image.quant.get(c.quant, ())) != 64 for c in image.components):
        raise ValueError("no quantisation table")
    if image.blocks > 8 * size:  # a block takes a bit at least
        raise ValueError("more blocks than data")
    if not image.scans:
        raise ValueError("no scan")
    for scan in image.scans:
        first, last, before, after = scan.band
        one = len(scan.components) == 1
        if not 0 <= first <= last <= 63 or (first == 0) != (last == 0) or (first and not one) or after > 13 or before not in (0, after + 1) or not scan.components or len(set(scan.components)) < len(scan.components):
            raise ValueError("scan not handled")
        for table_ in scan.ac if first else [] if before else scan.dc:
            counts = table_[:16]
            if len(counts) < 16 or not sum(counts) or sum(counts) != len(table_) - 16 or sum(n << (15 - i) for i, n in enumerate(counts)) > 1 << 16:
                raise ValueError("broken Huffman table")
        blocks, _, per = _scan_blocks(image, scan)
        if len(scan.segments) < -(-len(blocks) // per):
            raise ValueError("restart intervals missing")


def lookup(table_: bytes) -> np.ndarray:
    """length * 256 + symbol for every 16 bits ahead; length 0: no code."""
    out, code, symbols = np.zeros(1 << 16, np.int32), 0, iter(table_[16:])
    for length in range(1, 17):
        for _ in range(table_[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | next(symbols)
            code += 1
        code <<= 1
    return out


def _scan_blocks(image: Image, scan: Scan) -> tuple[np.ndarray, np.ndarray, int]:
    """(block, component) in the scan's order, and the blocks between two restarts."""
    if len(scan.components) == 1:
        c = image.components[scan.components[0]]
        blocks = (c.start + np.arange(c.rows)[:, None] * c.wide + np.arange(c.cols)).reshape(-1)
        return blocks, np.full(len(blocks), scan.components[0]), scan.restart or len(blocks)
    parts, who = [], []
    for k in scan.components:
        c = image.components[k]
        grid = c.start + np.arange(c.wide * c.high).reshape(c.high // c.v, c.v, c.wide // c.h, c.h).transpose(0, 2, 1, 3)
        parts.append(grid.reshape(-1, c.v * c.h))
        who.append(np.full(c.v * c.h, k))
    blocks, who = np.concatenate(parts, axis=1), np.concatenate(who)
    return blocks.reshape(-1), np.tile(who, len(blocks)), (scan.restart or len(blocks)) * len(who)


class Lanes:
    """Restart intervals of one scan of many images, with the blocks that each fills."""

    def __init__(self, images: list[Image], starts: np.ndarray, k: int):
        self.band = images[0].scans[k].band
        blocks, who, first, count, luts, dc_table, ac_table, data, place = [], [], [], [], {}, [], [], [], []
        total = at = 0
        for image, start in zip(images, starts, strict=True):
            scan = image.scans[k]
            b, w, per = _scan_blocks(image, scan)
            blocks.append(b + start)
            who.append(w)
            need_dc = self.band[0] == 0 and not self.band[2]
            dc = [0, 0, 0]
            for c, t in zip(scan.components, scan.dc, strict=True):
                dc[c] = luts.setdefault(t, len(luts)) if need_dc else 0
            ac = luts.setdefault(scan.ac[0], len(luts)) if self.band[0] else 0
            for i, segment in enumerate(scan.segments[: -(-len(b) // per)]):
                first.append(total + i * per)
                count.append(min(per, len(b) - i * per))
                dc_table.append(dc)
                ac_table.append(ac)
                data.append(segment)
                place.append(at)
                at += len(segment) + 16
            total += len(b)
        self.blocks, self.who = np.concatenate(blocks), np.concatenate(who)
        self.first, self.count = np.array(first), np.array(count)
        self.luts = np.concatenate([lookup(t) for t in luts]) if luts else np.zeros(1 << 16, np.int32)
        self.dc_table, self.ac_table = np.array(dc_table), np.array(ac_table)
        self.data = np.frombuffer((b"\0" * 16).join(data) + b"\0" * 32, np.uint8)
        self.windows = np.ndarray((len(self.data) - 8,), ">u8", self.data, 0, (1,))
        self.pos = np.array(place) * 8
        self.end = self.pos + np.array([len(x) for x in data]) * 8 + 64

    def ahead(self, pos: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position, at the top of a word."""
        return self.windows[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def bits(self, pos: np.ndarray) -> np.ndarray:
        return (self.data[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1


def _take(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The top n bits of each word (0 for n = 0)."""
    return ((x >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << s) >> 1, v - (1 << s) + 1, v)


def _dc_first(lanes: Lanes, coef: np.ndarray) -> None:
    al = lanes.band[3]
    pos, lane = lanes.pos.copy(), np.arange(len(lanes.pos))
    before = np.zeros((len(lane), 3), np.int64)
    for step in range(int(lanes.count.max(initial=0))):
        live = lanes.count[lane] > step
        if not live.all():
            lane, pos = lane[live], pos[live]
        at = lanes.first[lane] + step
        c = lanes.who[at]
        x = lanes.ahead(pos)
        e = lanes.luts[(lanes.dc_table[lane, c] << 16) + (x >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, s = e >> 8, e & 255
        before[lane, c] += _extend(_take(x << length.astype(np.uint64), s), s)
        coef[lanes.blocks[at], 0] = before[lane, c] << al
        pos = np.minimum(pos + length + s, lanes.end[lane])


def _dc_refine(lanes: Lanes, coef: np.ndarray) -> None:
    inside = np.arange(int(lanes.count.sum())) - np.repeat(np.cumsum(lanes.count) - lanes.count, lanes.count)
    at = np.repeat(lanes.first, lanes.count) + inside
    pos = np.minimum(np.repeat(lanes.pos, lanes.count) + inside, np.repeat(lanes.end, lanes.count))
    coef[lanes.blocks[at], 0] |= lanes.bits(pos).astype(coef.dtype) << lanes.band[3]


def _ac_first(lanes: Lanes, coef: np.ndarray) -> None:
    ss, se, _, al = lanes.band
    flat = coef.reshape(-1)
    pos, at, stop, end = lanes.pos.copy(), lanes.first.copy(), lanes.first + lanes.count, lanes.end
    table_ = lanes.ac_table << 16
    k = np.full(len(pos), ss)
    while len(pos):
        x = lanes.ahead(pos)
        e = lanes.luts[table_ + (x >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, symbol = e >> 8, e & 255
        r, s = symbol >> 4, symbol & 15
        x <<= length.astype(np.uint64)
        value = s > 0
        eob = ~value & (r < 15)
        extra = np.where(value, s, np.where(eob, r, 0))
        bits = _take(x, extra)
        k += np.where(eob, 0, r)
        ok = value & (k <= se)
        if ok.all():
            flat[lanes.blocks[at] * 64 + k] = _extend(bits, s) << al
        else:
            i = np.flatnonzero(ok)
            flat[lanes.blocks[at[i]] * 64 + k[i]] = _extend(bits[i], s[i]) << al
        k += 1
        pos = pos + length + extra
        done = eob | (k > se)
        at = at + np.where(eob, (1 << r) + bits, done)
        k[done] = ss
        over = (at >= stop) | (pos >= end) | (length == 0)
        if over.any():
            live = ~over
            pos, at, stop, end, table_, k = pos[live], at[live], stop[live], end[live], table_[live], k[live]


def _ac_refine(lanes: Lanes, coef: np.ndarray) -> None:
    ss, se, _, al = lanes.band
    pos, at, stop, end = lanes.pos.copy(), lanes.first.copy(), lanes.first + lanes.count, lanes.end
    table_ = lanes.ac_table << 16
    k, run = np.full(len(pos), ss), np.zeros(len(pos), np.int64)
    places = np.arange(64)
    while len(pos):
        x = lanes.ahead(pos)
        reads = run == 0
        e = np.where(reads, lanes.luts[table_ + (x >> np.uint64(48)).astype(np.int64)].astype(np.int64), 0)
        length, symbol = e >> 8, e & 255
        broken = reads & (length == 0)
        r, s = symbol >> 4, symbol & 15
        x <<= length.astype(np.uint64)
        eob = reads & (s == 0) & (r < 15)
        extra = np.where(eob, r, np.where(reads & (s > 0), 1, 0))
        bits = _take(x, extra)
        run = np.where(eob, (1 << r) + bits, run)
        pos = pos + length + extra
        new = np.where(reads & (s > 0), np.where(bits == 1, 1 << al, -(1 << al)), 0)
        b = lanes.blocks[at]
        c = coef[b].astype(np.int64)
        inside = (places >= k[:, None]) & (places <= se)
        zero = inside & (c == 0)
        ends = run > 0
        reached = zero & (np.cumsum(zero, axis=1) == (r + 1)[:, None])
        target = np.where(ends | ~reached.any(axis=1), se + 1, reached.argmax(axis=1))
        fix = inside & (c != 0) & (places < target[:, None])
        nth = np.cumsum(fix, axis=1)
        row, col = np.nonzero(fix)
        where = np.minimum(pos[row] + nth[row, col] - 1, end[row])
        c[row, col] += np.sign(c[row, col]) * (lanes.bits(where).astype(np.int64) << al)
        hit = np.flatnonzero((new != 0) & (target <= se))
        c[hit, target[hit]] = new[hit]
        coef[b] = c
        pos = pos + nth[:, -1]
        k = target + 1
        run = np.maximum(run - ends, 0)
        done = ends | (k > se)
        at = at + done
        k[done] = ss
        over = (at >= stop) | (pos >= end) | broken
        if over.any():
            live = ~over
            pos, at, stop, end, table_, k, run = pos[live], at[live], stop[live], end[live], table_[live], k[live], run[live]


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """(blocks, 64) quantised coefficients of each image, in zigzag order."""
    starts = np.cumsum([0, *(i.blocks for i in images)])
    coef = np.zeros((int(starts[-1]), 64), np.int32)
    groups: dict[tuple, list[int]] = {}
    for n, image in enumerate(images):
        groups.setdefault(tuple((s.band, len(s.components)) for s in image.scans), []).append(n)
    for script, members in groups.items():
        chosen = [images[n] for n in members]
        for k, (band, _) in enumerate(script):
            lanes = Lanes(chosen, starts[members], k)
            step = (_dc_refine if band[2] else _dc_first) if band[0] == 0 else (_ac_refine if band[2] else _ac_first)
            step(lanes, coef)
    return [coef[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def inverse_matrix() -> np.ndarray:
    """(64 zigzag coefficients, 64 samples): the inverse DCT of a block as one matrix."""
    u = np.arange(8)
    one = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.einsum("uy,vx->uvyx", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


_INVERSE = inverse_matrix()
_LEVELS = np.arange(256)


def to_channels(image: Image, coef: np.ndarray) -> list[np.ndarray]:
    """The red, green and blue planes, (height, width) bytes each."""
    h, v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        part = coef[c.start : c.start + c.wide * c.high].astype(np.float32)
        if (image.quant[c.quant] != 1).any():
            part *= image.quant[c.quant].astype(np.float32)
        samples = part @ _INVERSE
        samples += 128
        np.clip(np.rint(samples, out=samples), 0, 255, out=samples)
        plane = samples.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)
        if (c.h, c.v) != (h, v):
            plane = plane.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return [planes[0].astype(np.uint8)] * 3
    y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
    colours = (y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)
    return [np.clip(np.rint(x, out=x), 0, 255, out=x).astype(np.uint8) for x in colours]


def to_rgb(image: Image, coef: np.ndarray) -> np.ndarray:
    """(height, width, 3) bytes."""
    return np.stack(to_channels(image, coef), axis=2)


def payload_of(image: Image, coef: np.ndarray) -> tuple[bytes, int]:
    """(payload, bytes of it that were stated) of a stored payload."""
    found = re.fullmatch(rb"payload (\d{1,18}) of (\d{1,18})", image.comment)
    if not found:
        raise ValueError("no stored payload")
    length, stated = map(int, found.groups())
    if length > coef.size or stated > length or np.abs(coef).max(initial=0) > 129:
        raise ValueError("broken payload")
    return _BYTE_OF[coef + 130].tobytes()[:length], stated


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _groups(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and held + s > limit:
            yield lo, i
            lo, held = i, 0
        held += s
    if lo < len(sizes):
        yield lo, len(sizes)


def store_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, media): every whole text as a progressive JPEG."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in texts]
            for lo, hi in _groups([s + UNIT for s in sizes], BLOCK_BYTES):
                part = [x or b"" for x in texts.slice(lo, hi - lo).to_pylist()]
                media = store_payloads([padded(x) for x in part], [len(x) for x in part])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(media, pa.binary())], names=["id", "media"])

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(tidy(run), f"id {id_type}, media binary").withColumnRenamed("id", id_col)


def decode_media(rows: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(id, height, width, rgb, error): full-resolution tensors, row by row, three bytes to a pixel."""
    id_type = rows.schema[id_col].dataType.simpleString()
    names = ["id", "height", "width", "rgb", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ok in _decoded(batch.column(1)):
                out = []
                for j, x in zip(i, ok, strict=True):
                    try:
                        rgb = None if isinstance(x, str) else to_rgb(*x)
                    except _BROKEN as e:
                        rgb, x = None, _reason(e)
                    out.append((None, None, None, x) if rgb is None else (rgb.shape[0], rgb.shape[1], rgb.tobytes(), None))
                h, w, data, error = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(h, pa.int32()), pa.array(w, pa.int32()), pa.array(data, pa.binary()), pa.array(error, pa.string())], names=names)

    return rows.select(id_col, media).mapInArrow(tidy(run), f"id {id_type}, height int, width int, rgb binary, error string").withColumnRenamed("id", id_col)


_BROKEN = (ValueError, IndexError, KeyError, StopIteration, OverflowError, ZeroDivisionError, AttributeError, TypeError, MemoryError)


def _reason(e: BaseException) -> str:
    return str(e) or type(e).__name__


def _decoded(column: pa.Array) -> Iterator[tuple[list[int], list[tuple[Image, np.ndarray] | str]]]:
    """(rows, image with coefficients or reason) in blocks of bounded size. A broken file spoils no other one."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in column]
    for lo, hi in _groups(sizes, BLOCK_BYTES):
        images: list[Image | str] = []
        for x in column.slice(lo, hi - lo).to_pylist():
            try:
                images.append("null" if x is None else parse(x))
            except _BROKEN as e:
                images.append(_reason(e))
        good = [x for x in images if isinstance(x, Image)]
        try:
            coef: list[np.ndarray | str] = coefficients(good) if good else []
        except _BROKEN:
            coef = [_alone(x) for x in good]
        found = iter(zip(good, coef, strict=True))
        told = [next(found) if isinstance(x, Image) else x for x in images]
        yield list(range(lo, hi)), [x if isinstance(x, str) else x[1] if isinstance(x[1], str) else x for x in told]


def _alone(image: Image) -> np.ndarray | str:
    try:
        return coefficients([image])[0]
    except _BROKEN as e:
        return _reason(e)


def feature(channels: list[np.ndarray]) -> str:
    """Mean and spread of each channel, from its histogram."""
    said = []
    for name, plane in zip("rgb", channels, strict=True):
        counts = np.bincount(plane.reshape(-1), minlength=256)
        mean = int(counts @ _LEVELS) / plane.size
        said.append(f"{name}={mean:.4f}/{max(int(counts @ (_LEVELS * _LEVELS)) / plane.size - mean**2, 0) ** 0.5:.4f}")
    return ";".join(said)


def media_features(rows: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """What op5 returns, from stored payloads; of media that hold none, nulls and the reason."""
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in _decoded(batch.column(1)):
                out = []
                for j, x in zip(i, found, strict=True):
                    data = batch.column(1)[j].as_py()
                    of_media = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                    try:
                        if isinstance(x, str):
                            raise ValueError(x)
                        payload, stated = payload_of(*x)
                        out.append((stated, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *of_media, feature(to_channels(*x)), None))
                    except _BROKEN as e:
                        out.append((None, None, None, None, *of_media, None, _reason(e)))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names=names)

    return rows.select(id_col, media).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every text of documents stored as media, read back, and described."""
    return media_features(stored(store_texts(table(spark, sf_dir, "documents")), "media"))
