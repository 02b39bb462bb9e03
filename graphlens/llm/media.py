"""Operator 4: media columns as baseline JPEG, read by their DC coefficients.

Storing: a payload of 576 n bytes becomes grey images of 24 x 24 n blocks whose
block DC is the byte and whose AC is empty; with a DC quantiser of 8 every pixel
of a block equals the byte in any decoder, so nothing is lost. Every block row
is a restart interval. Payloads beyond an image's largest height take several
images, one after the other.

Reading: markers are parsed, byte stuffing is undone, scans are Huffman-decoded
symbol by symbol with the file's own tables (AC coefficients skipped, restarts
honoured) and the luminance DC values give the thumbnail, one pixel a block.
The restart intervals of all grey images of a batch advance together, one symbol
a step, as numpy arrays; images of several components go one by one.

Edge cases: null or empty text is a payload of 576 bytes 255; very long texts
take several images; equal texts give equal values; null media gives null
features; media that is no readable baseline JPEG gives null features and the
reason in ``error``; a column named like an output gives way to it; an empty
table gives an empty result; other columns stay in ``read_column`` and are
ignored by ``store_column``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm.common import bounded_batches, table

UNIT, WIDE = 576, 24
_QDC = 8
_ROWS = 65535 // 8 // WIDE * WIDE  # block rows of the tallest image
#: Payload bytes, or scan bytes, handled together.
_GROUP = 1 << 19
#: Code lengths of the format's example table for luminance DC categories.
_DC = {0: 2, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7, 10: 8, 11: 9}
#: The only AC symbol that is written: end of block.
_AC = {0: 1}


_MARKER = re.compile(b"\xff[^\x00\xff\xd0-\xd7]", re.S)


class JpegError(ValueError):
    """Not a baseline JPEG that can be read."""


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length) in the format's canonical order."""
    out, code, at = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - at
        out[s], at = (code, n), n
        code += 1
    return out


def _block_words() -> tuple[np.ndarray, np.ndarray]:
    """Bits, and their number, of a block by its DC difference from -255 to 255: category, value, end of block."""
    codes = _canonical(_DC)
    words, sizes = np.zeros(511, dtype=np.uint64), np.zeros(511, dtype=np.uint64)
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        bits = diff if diff >= 0 else diff + (1 << s) - 1
        words[diff + 255] = ((codes[s][0] << s) | bits) << 1
        sizes[diff + 255] = codes[s][1] + s + 1
    return words, sizes


_WORDS, _SIZES = _block_words()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text's UTF-8 and that, padded."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _header(height: int, width: int) -> bytes:
    seg = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    huff = lambda kind, t: seg(0xC4, bytes([kind] + [sum(n == i for n in t.values()) for i in range(1, 17)] + sorted(t, key=t.get)))
    quant = seg(0xDB, bytes([0, _QDC] + [1] * 63))
    frame = seg(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0))
    scan = seg(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quant + frame + huff(0x00, _DC) + huff(0x10, _AC) + seg(0xDD, struct.pack(">H", WIDE)) + scan


def _scan_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each block row, padded with ones, in a row of a matrix each; their numbers."""
    n = len(rows)
    at = np.diff(rows.astype(np.int16) - 128, prepend=np.int16(0), axis=1) + 255
    wide = 56  # 24 blocks of at most 15 bits, and the 8 bytes that a write covers
    out, put, base = np.zeros(n * wide, dtype=np.uint8), np.zeros(n, dtype=np.int64), np.arange(n) * wide
    held, bits, eight, one = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64), np.arange(8), np.uint64(1)
    for j in range(WIDE):
        size = _SIZES[at[:, j]]
        held, bits = (held << size) | _WORDS[at[:, j]], bits + size
        if j % 3 == 2:  # at most 7 + 45 bits are held
            top = (held << (np.uint64(64) - bits)).astype(">u8").view(np.uint8).reshape(n, 8)
            out[(base + put)[:, None] + eight] = top
            put += (bits >> np.uint64(3)).astype(np.int64)
            bits &= np.uint64(7)
            held &= (one << bits) - one
    free = (np.uint64(8) - bits) & np.uint64(7)
    last = np.flatnonzero(bits)
    out[(base + put)[last]] = ((held << free) | ((one << free) - one))[last].astype(np.uint8)
    return out.reshape(n, wide), put + (bits > 0)


def store_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload as one or more grey baseline JPEG images."""
    parts = [(k, p[s : s + _ROWS * WIDE]) for k, p in enumerate(payloads) for s in range(0, len(p), _ROWS * WIDE)]
    out: list[list[bytes]] = [[] for _ in payloads]
    first = 0
    while first < len(parts):
        end, size = first, 0
        while end < len(parts) and (end == first or size + len(parts[end][1]) <= _GROUP):
            size += len(parts[end][1])
            end += 1
        rows = np.frombuffer(b"".join(p for _, p in parts[first:end]), dtype=np.uint8).reshape(-1, WIDE)
        buf, used = _scan_rows(rows)
        data = buf[np.arange(buf.shape[1]) < used[:, None]]
        # a zero after each byte 255, a marker after each row: a restart, or the end of the image
        ends = np.cumsum(used)
        at = np.arange(len(data)) + np.concatenate([[0], np.cumsum(data == 0xFF)[:-1]]) + 2 * np.repeat(np.arange(len(rows)), used)
        close = ends + np.cumsum(data == 0xFF)[ends - 1] + 2 * np.arange(len(rows))
        stream = np.zeros(int(close[-1]) + 2, dtype=np.uint8)
        stream[at], stream[close] = data, 0xFF
        tall = [len(p) // WIDE for _, p in parts[first:end]]
        within = np.concatenate([np.arange(t) for t in tall])
        stream[close + 1] = 0xD0 + within % 8
        last = np.cumsum(tall) - 1
        stream[close[last] + 1] = 0xD9
        raw, begin = stream.tobytes(), 0
        for (k, _), t, e in zip(parts[first:end], tall, (close[last] + 2).tolist()):
            out[k] += [_header(8 * t, 8 * WIDE), raw[begin:e]]
            begin = e
        first = end
    return [b"".join(x) for x in out]


def store(payload: bytes) -> bytes:
    """One payload as grey baseline JPEG images."""
    return store_all([payload])[0]


def _tables(body: bytes, into: dict) -> None:
    at = 0
    while at < len(body):
        counts = body[at + 1 : at + 17]
        symbols = body[at + 17 : at + 17 + sum(counts)]
        if len(counts) < 16 or len(symbols) < sum(counts):
            raise JpegError("short table")
        lengths, k = {}, 0
        for n, c in enumerate(counts, 1):
            for _ in range(c):
                lengths[symbols[k]] = n
                k += 1
        if sum(2 ** (16 - n) for n in lengths.values()) > 1 << 16:
            raise JpegError("bad table")
        into[body[at]] = lengths
        at += 17 + sum(counts)


def _frame(body: bytes) -> tuple:
    if len(body) < 6 or len(body) < 6 + 3 * body[5]:
        raise JpegError("short frame")
    h, w, n = struct.unpack(">HHB", body[1:6])
    comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if body[0] != 8 or not h or not w or not comps or any(not c[1] or not c[2] for c in comps):
        raise JpegError("unsupported frame")
    return h, w, comps


def _scan_end(data: bytes, at: int) -> int:
    """First marker from ``at`` on that is neither stuffing nor a restart."""
    found = _MARKER.search(data, at)
    return found.start() if found else len(data)


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Markers of the image that begins at ``at``: its parts, and where it ends.

    Of several scans the one with the first component, the luminance, is kept.
    """
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    img: dict = {"quant": {}, "huff": {}, "restart": 0, "frame": None, "data": None}
    quant, huff, restart = {}, {}, 0
    at += 2
    while at < len(data):
        if data[at] != 0xFF:
            raise JpegError("no marker where one is due")
        while at < len(data) and data[at] == 0xFF:  # fill bytes
            at += 1
        if at >= len(data):
            break
        mark = data[at]
        at += 1
        if mark == 0xD9:
            break
        if mark == 0x01 or 0xD0 <= mark <= 0xD7:
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        body = data[at + 2 : at + size]
        if size < 2 or len(body) < size - 2:
            raise JpegError("short segment")
        at += size
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 65 + 64 * wide
        elif mark in (0xC0, 0xC1):
            img["frame"] = _frame(body)
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC4, 0xC8):
            raise JpegError("not baseline")
        elif mark == 0xC4:
            _tables(body, huff)
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif mark == 0xDA:
            if img["frame"] is None:
                raise JpegError("scan before frame")
            if not body or len(body) < 1 + 2 * body[0]:
                raise JpegError("short scan header")
            select = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            end = _scan_end(data, at)
            if img["data"] is None and img["frame"][2][0][0] in dict(select):
                img |= {"scan": select, "data": data[at:end], "restart": restart, "huff": dict(huff), "quant": dict(quant)}
            at = end
    if img["data"] is None:
        raise JpegError("no scan")
    known = {c[0] for c in img["frame"][2]}
    if any(c not in known or s >> 4 not in img["huff"] or 0x10 | s & 15 not in img["huff"] for c, s in img["scan"]):
        raise JpegError("scan names what the file does not hold")
    return img, at


def _lookup(lengths: dict[int, int]) -> np.ndarray:
    """Symbol, and the code's length above 8 bits, by the next 16 bits; zero where no code begins so."""
    out = np.zeros(1 << 16, dtype=np.uint16)
    for s, (code, n) in _canonical(lengths).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = s | n << 8
    return out


def _intervals(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a scan without stuffing and restart markers; length of each interval; places of the markers."""
    raw = np.frombuffer(data, dtype=np.uint8)
    after = np.flatnonzero(raw[:-1] == 0xFF) + 1
    what = raw[after]
    mark = after[(what >= 0xD0) & (what <= 0xD7)]
    keep = np.ones(len(raw), dtype=bool)
    keep[after[what == 0]] = False
    keep[mark] = keep[mark - 1] = False
    gone = np.flatnonzero(~keep)
    at = np.concatenate([[0], mark - np.searchsorted(gone, mark), [len(raw) - len(gone)]])
    return raw[keep], np.diff(at), mark - 1


def _grey(images: list[dict]) -> list[np.ndarray | JpegError]:
    """DC values of grey images with equal tables and intervals, all their intervals decoded together."""
    sel = images[0]["scan"][0][1]
    dc_codes, ac_codes = _lookup(images[0]["huff"][sel >> 4]), _lookup(images[0]["huff"][0x10 | sel & 15])
    raw, sizes, marks = _intervals(b"\xff\xd0".join(img["data"] for img in images))  # between images as between intervals
    begin = np.cumsum([0] + [len(img["data"]) + 2 for img in images])[:-1]
    first = np.append(np.searchsorted(marks, begin), len(sizes))
    blocks = np.array([-(-img["frame"][0] // 8) * -(-img["frame"][1] // 8) for img in images])
    per = np.array([img["restart"] for img in images])
    per = np.where(per > 0, per, blocks)
    short = 8 * np.diff(np.append(begin, begin[-1] + len(images[-1]["data"]) + 2)) < 2 * blocks  # a block takes two bits at least
    bad = set(np.flatnonzero(short | (np.diff(first) < -(-blocks // per))).tolist())
    blocks = np.where(short, 0, blocks)
    owner = np.repeat(np.arange(len(images)), np.diff(first))
    count = np.clip(blocks[owner] - per[owner] * (np.arange(len(sizes)) - first[owner]), 0, per[owner])  # blocks of each interval
    raw = np.concatenate([raw, np.zeros(16, dtype=np.uint8)])
    window = np.ndarray(len(raw) - 8, dtype=">u8", buffer=raw, strides=(1,))  # the 8 bytes from each place on
    end = 8 * np.cumsum(sizes)
    order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    pos, end, left = (end - 8 * sizes)[order], end[order], count[order]
    out = np.zeros((len(order), int(left[0]) if len(left) else 0), dtype=np.int32)
    wrong = np.zeros(len(order), dtype=bool)
    u, top = np.uint64, len(window) - 1

    def peek(p):
        return window[np.minimum(p >> 3, top)].astype(u) << (p & 7).view(u)

    for j in range(out.shape[1]):
        n = int(np.searchsorted(-left, -j, side="left"))  # intervals with more than j blocks
        p = pos[:n]
        win = peek(p)
        code = dc_codes[(win >> u(48)).view(np.int64)].astype(np.int64)
        s, size = code & 255, code >> 8
        wrong[:n] |= (size == 0) | (s > 11)
        s = np.minimum(s, 11)
        value = ((win << size.view(u)) >> u(1) >> (63 - s).view(u)).view(np.int64)  # the next s bits
        full = 1 << s
        out[:n, j] = value - np.where(value << 1 < full, full - 1, 0)
        size += s
        p = p + size
        code = ac_codes[((win << size.view(u)) >> u(48)).view(np.int64)].astype(np.int64)  # of 57 bits at most 27 are used
        live, k = None, None
        while True:
            rs, size = code & 255, code >> 8
            step = size + (rs & 15)
            lost, more = size == 0, rs != 0
            if live is None:
                p += step
                wrong[:n] |= lost
                live, k = np.flatnonzero(more & ~lost), np.ones(n, dtype=np.int64)
                rs = rs[live]
            else:
                p[live] += step
                wrong[live[lost]] = True
                more &= ~lost
                live, rs = live[more], rs[more]
            k[live] += (rs >> 4) + 1
            live = live[k[live] < 64]
            if not len(live):
                break
            code = ac_codes[(peek(p[live]) >> u(48)).view(np.int64)].astype(np.int64)
        wrong[:n] |= p > end[:n]
        pos[:n] = p
    dc = np.zeros((len(sizes), out.shape[1]), dtype=np.int32)
    dc[order] = np.cumsum(out, axis=1)
    bad |= set(owner[order[wrong]].tolist())
    result: list = []
    for i, img in enumerate(images):
        if i in bad:
            result.append(JpegError("bad scan"))
            continue
        h, w, _ = img["frame"]
        rows, n = dc[first[i] : first[i + 1]], count[first[i] : first[i + 1]]
        if n.min() < rows.shape[1]:
            rows = rows[np.arange(rows.shape[1]) < n[:, None]]
        result.append(rows.reshape(-(-h // 8), -(-w // 8)))
    return result


def _by_symbol(img: dict) -> np.ndarray:
    """DC values of the first component, block rows by columns, decoded symbol by symbol."""
    h, w, comps = img["frame"]
    hm, vm = max(c[1] for c in comps), max(c[2] for c in comps)
    tall, wide = -(-(-(-h * comps[0][2] // vm)) // 8), -(-(-(-w * comps[0][1] // hm)) // 8)
    if len(img["scan"]) == 1:
        plan, mcus, across, named = [(0, 1, 1)], tall * wide, wide, comps[:1]
        grid = np.zeros((tall, wide), dtype=np.int64)
    else:
        named = [next(c for c in comps if c[0] == i) for i, _ in img["scan"]]
        across, down = -(-w // (8 * hm)), -(-h // (8 * vm))
        plan, mcus = [(i, c[1], c[2]) for i, c in enumerate(named)], across * down
        grid = np.zeros((down * comps[0][2], across * comps[0][1]), dtype=np.int64)
    first = next(i for i, c in enumerate(named) if c[0] == comps[0][0])
    look = {key: {(n, code): s for s, (code, n) in _canonical(lengths).items()} for key, lengths in img["huff"].items()}
    select = dict(img["scan"])
    raw, sizes, _ = _intervals(img["data"])
    ends = np.cumsum(sizes).tolist()
    per = img["restart"] or mcus
    if len(ends) * per < mcus:
        raise JpegError("bad scan")
    for p, (begin, end) in enumerate(zip([0, *ends], ends)):
        bits = np.unpackbits(raw[begin:end]).tolist()
        pos, pred = 0, [0] * len(named)

        def symbol(key):
            nonlocal pos
            code = 0
            for n in range(1, 17):
                if pos >= len(bits):
                    raise JpegError("bad scan")
                code = code << 1 | bits[pos]
                pos += 1
                if (n, code) in look[key]:
                    return look[key][n, code]
            raise JpegError("bad scan")

        for m in range(p * per, min(mcus, (p + 1) * per)):
            for c, ch, cv in plan:
                sel = select[named[c][0]]
                for y in range(cv):
                    for x in range(ch):
                        s = symbol(sel >> 4)
                        if s > 11 or pos + s > len(bits):
                            raise JpegError("bad scan")
                        v = 0
                        for _ in range(s):
                            v = v << 1 | bits[pos]
                            pos += 1
                        pred[c] += v if not s or v >> (s - 1) else v - (1 << s) + 1
                        k = 1
                        while k < 64:
                            rs = symbol(0x10 | sel & 15)
                            if rs == 0:
                                break
                            pos += rs & 15
                            k += (rs >> 4) + 1
                        if c == first:
                            grid[m // across * cv + y, m % across * ch + x] = pred[c]
    return grid[:tall, :wide]


def _pixels(img: dict, dc: np.ndarray) -> np.ndarray:
    """Luminance means of the blocks, 0 to 255, from the DC values alone."""
    quant = img["quant"].get(img["frame"][2][0][3], 1)
    return np.clip(np.round(dc * (quant / 8) + 128), 0, 255).astype(np.uint8)


def read_all(media: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]] | JpegError | None]:
    """``(height, width, thumbnail)`` of each image in each of ``media``, or why it can't be read."""
    out: list = [None if m is None else [] for m in media]
    grey: dict[tuple, list] = {}
    held: dict[tuple, int] = {}

    def keep(k, img, place, dc):
        if isinstance(out[k], JpegError):
            return
        if isinstance(dc, JpegError):
            out[k] = dc
        else:
            out[k][place] = (*img["frame"][:2], _pixels(img, dc))

    def flush(key):
        group = grey.pop(key)
        held.pop(key)
        for (k, place, img), dc in zip(group, _grey([img for _, _, img in group])):
            keep(k, img, place, dc)

    for k, m in enumerate(media):
        at = 0
        try:
            if m is not None and not m:
                raise JpegError("no start of image")
            while m is not None and at < len(m) and not isinstance(out[k], JpegError):
                img, at = parse(m, at)
                out[k].append(None)
                if len(img["frame"][2]) == 1:
                    sel = img["scan"][0][1]
                    per = img["restart"] or -(-img["frame"][0] // 8) * -(-img["frame"][1] // 8)
                    key = (per, *(tuple(sorted(img["huff"][t].items())) for t in (sel >> 4, 0x10 | sel & 15)))
                    grey.setdefault(key, []).append((k, len(out[k]) - 1, img))
                    held[key] = held.get(key, 0) + len(img["data"])
                    if held[key] > _GROUP:
                        flush(key)
                else:
                    keep(k, img, len(out[k]) - 1, _by_symbol(img))
        except JpegError as e:
            out[k] = e
    for key in list(grey):
        flush(key)
    return out


def read(media: bytes) -> list[tuple[int, int, np.ndarray]]:
    """``(height, width, thumbnail)`` of each image in ``media``."""
    (got,) = read_all([media])
    if isinstance(got, JpegError):
        raise got
    return got


def _mean_grid(t: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """``t`` averaged to rows x cols cells; small images are repeated first."""
    t = np.repeat(np.repeat(t, -(-rows // t.shape[0]), axis=0), -(-cols // t.shape[1]), axis=1).astype(np.float64)
    r, c = (np.linspace(0, n, k + 1).astype(int)[:-1] for n, k in ((t.shape[0], rows), (t.shape[1], cols)))
    cells = np.add.reduceat(np.add.reduceat(t, r, axis=0), c, axis=1)
    size = np.outer(np.diff(np.append(r, t.shape[0])), np.diff(np.append(c, t.shape[1])))
    return cells / size


def thumb_hashes(t: np.ndarray) -> str:
    """Average hash and difference hash of a thumbnail, 16 hexadecimal digits each."""
    a, d = _mean_grid(t, 8, 8), _mean_grid(t, 8, 9)
    hexed = lambda bits: np.packbits(bits.ravel()).tobytes().hex()
    return f"{hexed(a > a.mean())}:{hexed(d[:, 1:] > d[:, :-1])}"


def store_column(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text's payload as JPEG bytes."""

    def run(batches):
        for b in batches:
            got = [payload_of(t) for t in b.column(1).to_pylist()]
            media = pa.array(store_all([p for _, p in got]), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_READ = {
    "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(),
    "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string(),
}


def read_column(stored: DataFrame) -> DataFrame:
    """Payload digests, dimensions and thumbnail hashes read back from ``media``; other columns stay.

    ``error`` says why ``media`` can't be read; its size and digest are given all the same.
    """

    def one(media, images):
        if media is None:
            return (None,) * len(_READ)
        own = len(media), hashlib.sha256(media).hexdigest()
        if isinstance(images, JpegError):
            return None, None, None, *own, None, str(images)
        payload = b"".join(t.tobytes() for _, _, t in images)
        feature = ";".join(f"{w}x{h}:{thumb_hashes(t)}" for h, w, t in images)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, feature, None

    keep = [c for c in stored.columns if c != "media" and c not in _READ]

    def run(batches):
        for b in batches:
            media = b.column("media").to_pylist()
            got = list(zip(*map(one, media, read_all(media)))) or [()] * len(_READ)
            cols = [pa.array(c, kind) for c, kind in zip(got, _READ.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *_READ])

    kinds = {pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join([f"`{c}` {t}" for c, t in stored.dtypes if c in keep] + [f"{c} {kinds[t]}" for c, t in _READ.items()])
    return stored.select(*(f"`{c}`" for c in keep), F.col("media").cast("binary")).mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: store every document's text, read it back, return the features."""
    bounded_batches(spark)
    return read_column(store_column(table(spark, sf_dir, "documents")))
