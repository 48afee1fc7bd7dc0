"""A baseline JPEG codec on numpy arrays: cosine blocks as matrix products, Huffman codes fitted to each picture.

The encoder halves the chroma planes both ways (4:2:0). The decoder takes Huffman-coded baseline and extended pictures of
eight bits, grey or YCbCr, any whole sampling ratio, with or without restart intervals; chroma planes are enlarged by
repeating samples. Progressive, arithmetic-coded and four-channel pictures raise ValueError, and so do cut ones.
"""

import heapq
import re
import struct
from collections import Counter

import numpy as np

from .headers import ZIGZAG

K = np.arange(8)
COSINE = np.sqrt(np.where(K == 0, 1, 2) / 8)[:, None] * np.cos((2 * K + 1) * K[:, None] * np.pi / 16)
#: Weights of red, green and blue in luma (ITU-R BT.601).
RED, GREEN, BLUE = 0.299, 0.587, 0.114
MOST_PIXELS = 500_000_000


def _blocks(plane: np.ndarray) -> np.ndarray:
    """A plane of whole blocks as rows x columns x 8 x 8."""
    return plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).swapaxes(1, 2)


def _code(counts: Counter) -> tuple[list[int], list[int]]:
    """How many codes there are of each length from 1 to 16, and the symbols in the order of their codes."""
    length = dict.fromkeys([*counts, 256], 0)  # 256 takes the code of ones alone, which no symbol may have
    heap = [(n, s, [s]) for s, n in counts.items()] + [(0, 256, [256])]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]))
    sizes = Counter(length.values())
    for i in range(max(sizes), 16, -1):  # two codes too long become one, and a shorter code is split for the other
        while sizes[i]:
            j = next(x for x in range(i - 2, 0, -1) if sizes[x])
            for at, more in ((i, -2), (i - 1, 1), (j + 1, 2), (j, -1)):
                sizes[at] += more
    sizes[max(i for i in sizes if sizes[i])] -= 1
    return [sizes[i] for i in range(1, 17)], sorted(counts, key=lambda s: (length[s], s))


def _codes(sizes, symbols) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol."""
    out, code, rest = {}, 0, iter(symbols)
    for i, n in enumerate(sizes, 1):
        for _ in range(n):
            out[next(rest)] = (code, i)
            code += 1
        code <<= 1
    return out


def _symbols(block: list[int], before: int):
    """(is AC, symbol, further bits, their number) of a block in zigzag order."""
    bits = lambda v: (v if v > 0 else v + (1 << abs(v).bit_length()) - 1, abs(v).bit_length())
    more = bits(block[0] - before)
    out, run = [(0, more[1], *more)], 0
    for v in block[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            out.append((1, 0xF0, 0, 0))
            run -= 16
        more = bits(v)
        out.append((1, run << 4 | more[1], *more))
        run = 0
    if run:
        out.append((1, 0, 0, 0))
    return out


def jpeg_encode(pixels: np.ndarray, luma: np.ndarray, chroma: np.ndarray) -> bytes:
    """pixels (height x width x 3) with the given quantisation tables (8 x 8, natural order, 1 to 255)."""
    height, width, _ = pixels.shape
    if not 0 < height < 65536 or not 0 < width < 65536:
        raise ValueError("size")
    whole = np.pad(pixels, ((0, -height % 16), (0, -width % 16), (0, 0)), mode="edge").astype(np.float64)
    r, b = whole[:, :, 0], whole[:, :, 2]
    y = whole @ [RED, GREEN, BLUE]
    half = lambda p: np.rint(p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean((1, 3)))
    planes = [y - 128, half((b - y) / (2 - 2 * BLUE)), half((r - y) / (2 - 2 * RED))]
    tables = [np.asarray(t, np.int64).reshape(8, 8) for t in (luma, chroma)]
    steps = [tables[0], tables[1], tables[1]]
    coded = []
    for plane, table in zip(planes, steps):
        terms = np.rint(COSINE @ _blocks(plane) @ COSINE.T / table).astype(np.int64)
        coded.append(np.clip(terms, -1023, 1023).reshape(*terms.shape[:2], 64)[:, :, ZIGZAG].tolist())
    before, out, counts = [0, 0, 0], [], {}
    for row in range(len(coded[1])):
        for col in range(len(coded[1][0])):
            unit = [(0, 2 * row + i, 2 * col + j) for i in (0, 1) for j in (0, 1)] + [(1, row, col), (2, row, col)]
            for c, i, j in unit:
                block = coded[c][i][j]
                for ac, symbol, value, n in _symbols(block, before[c]):
                    out.append((min(c, 1), ac, symbol, value, n))
                before[c] = block[0]
    for c, ac, symbol, _, _ in out:
        counts.setdefault((c, ac), Counter())[symbol] += 1
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    head = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    head += [segment(0xDB, bytes([i, *t.ravel()[ZIGZAG].tolist()])) for i, t in enumerate(tables)]
    head.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])))
    codes = {}
    for (c, ac), own in sorted((k, counts.get(k) or Counter([0])) for k in [(0, 0), (0, 1), (1, 0), (1, 1)]):
        sizes, symbols = _code(own)
        codes[c, ac] = _codes(sizes, symbols)
        head.append(segment(0xC4, bytes([ac << 4 | c, *sizes, *symbols])))
    head.append(segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])))
    body, held, n = bytearray(), 0, 0
    for c, ac, symbol, value, more in out:
        code, size = codes[c, ac][symbol]
        held, n = (held << size | code) << more | value, n + size + more
        if n >= 64:
            keep = n % 8
            body += (held >> keep).to_bytes(n // 8, "big")
            held, n = held & (1 << keep) - 1, keep
    pad = -n % 8
    body += (held << pad | (1 << pad) - 1).to_bytes((n + pad) // 8, "big")
    return b"".join(head) + bytes(body).replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


class _Bits:
    def __init__(self, body: bytes):
        self.body, self.at, self.end = body + b"\xff" * 8, 0, 8 * len(body)

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.body[i : i + 3], "big") >> 8 - (self.at & 7) & 0xFFFF

    def symbol(self, table: list[tuple[int, int]]) -> int:
        found, size = table[self.peek()]
        self.at += size
        if not size or self.at > self.end:
            raise ValueError("cut or damaged scan")
        return found

    def number(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek() >> 16 - n
        self.at += n
        return v if v >> n - 1 else v - (1 << n) + 1


def _lookup(sizes: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length of its code) for each value of the next sixteen bits; length 0: no code."""
    out: list[tuple[int, int]] = []
    for s, (_, n) in _codes(sizes, range(len(symbols))).items():
        out += [(symbols[s], n)] * (1 << 16 - n)
    if len(out) > 1 << 16:
        raise ValueError("code table")
    return out + [(0, 0)] * ((1 << 16) - len(out))


def _scan(parts: list[bytes], frame: list[dict], across: int, down: int, every: int) -> None:
    """Fills the blocks of each component of the frame, unit by unit."""
    units = across * down
    for k, part in enumerate(parts):
        bits, first = _Bits(part), k * (every or units)
        for c in frame:
            c["before"] = 0
        for u in range(first, min(first + (every or units), units)):
            row, col = divmod(u, across)
            for c in frame:
                for i in range(c["v"]):
                    for j in range(c["h"]):
                        block = c["blocks"][row * c["v"] + i, col * c["h"] + j]
                        c["before"] += bits.number(bits.symbol(c["dc"]))
                        block[0], at = c["before"], 1
                        while at < 64:
                            s = bits.symbol(c["ac"])
                            if not s & 15 and s != 0xF0:
                                break
                            at += s >> 4
                            if s & 15:
                                if at > 63:
                                    raise ValueError("damaged block")
                                block[ZIGZAG[at]] = bits.number(s & 15)
                            at += 1


def jpeg_decode(body: bytes) -> np.ndarray:
    """Pixels as height x width x 3."""
    at, tables, codes, frame, every = 2, {}, {}, [], 0
    while True:
        if at + 4 > len(body) or body[at] != 0xFF:
            raise ValueError("cut or damaged segments")
        kind = body[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        length = struct.unpack_from(">H", body, at + 2)[0]
        part = body[at + 4 : at + 2 + length]
        if len(part) != length - 2:
            raise ValueError("cut segment")
        at += 2 + length
        if kind == 0xDB:
            while part:
                wide = part[0] >> 4
                table = np.zeros(64)
                table[ZIGZAG] = struct.unpack_from(">64H" if wide else ">64B", part, 1)
                tables[part[0] & 15] = table
                part = part[129 if wide else 65 :]
        elif kind == 0xC4:
            while part:
                n = sum(part[1:17])
                codes[part[0]] = _lookup(part[1:17], part[17 : 17 + n])
                part = part[17 + n :]
        elif kind in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", part)
            if depth != 8 or n not in (1, 3) or not height or not width or height * width > MOST_PIXELS:
                raise ValueError("kind or size")
            frame = [{"id": p[0], "h": p[1] >> 4, "v": p[1] & 15, "table": p[2]} for p in (part[6 + 3 * i : 9 + 3 * i] for i in range(n))]
            if n == 1:
                frame[0].update(h=1, v=1)
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif kind == 0xDD:
            every = struct.unpack(">H", part)[0]
        elif kind == 0xDA:
            break
    if not frame or part[0] != len(frame):
        raise ValueError("planes in scans of their own")
    for c, (own, use) in zip(frame, zip(part[1::2], part[2::2])):
        c.update(dc=codes[use >> 4], ac=codes[0x10 | use & 15])
        if c["id"] != own:
            raise ValueError("order of planes")
    most_h, most_v = max(c["h"] for c in frame), max(c["v"] for c in frame)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    for c in frame:
        if most_h % c["h"] or most_v % c["v"]:
            raise ValueError("sampling")
        c["blocks"] = np.zeros((down * c["v"], across * c["h"], 64), np.int64)
    end = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S).search(body, at)
    parts = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", body[at : end.start() if end else len(body)])]
    if len(parts) < (-(-across * down // every) if every else 1):
        raise ValueError("cut scan")
    _scan(parts, frame, across, down, every)
    planes = []
    for c in frame:
        terms = (c["blocks"] * tables[c["table"]]).reshape(*c["blocks"].shape[:2], 8, 8)
        plane = (COSINE.T @ terms @ COSINE).swapaxes(1, 2).reshape(8 * terms.shape[0], -1)
        plane = np.clip(np.rint(plane), -128, 127)  # samples have eight bits
        planes.append(plane.repeat(most_v // c["v"], 0).repeat(most_h // c["h"], 1)[:height, :width])
    y = planes[0] + 128
    if len(planes) == 1:
        out = np.stack([y] * 3, 2)
    else:
        r, b = y + (2 - 2 * RED) * planes[2], y + (2 - 2 * BLUE) * planes[1]
        out = np.stack([r, (y - RED * r - BLUE * b) / GREEN, b], 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
