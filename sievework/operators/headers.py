"""What the first bytes of a picture say: format, size and, for JPEG, the luma quantisation table.

No picture is unpacked, so this costs a walk over a few segments whatever the size. PNG, JPEG, WebP and BMP are known;
other bytes, a cut header or a null give a row with its error.
"""

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import LUMA, jpeg_quality

#: Places of the 64 values of a table in the order a JPEG file has them: diagonal by diagonal, turning at each end.
ZIGZAG = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))


def _jpeg(body: bytes) -> tuple[int, int, list[int]]:
    at, table, size = 2, [], None
    while at + 4 <= len(body):
        if body[at] != 0xFF:
            raise ValueError("segment")
        kind = body[at + 1]
        if kind == 0xFF:  # a fill byte
            at += 1
            continue
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:  # no length
            at += 2
            continue
        if kind in (0xD9, 0xDA):
            break
        length = struct.unpack_from(">H", body, at + 2)[0]
        part = body[at + 4 : at + 2 + length]
        if length < 2 or len(part) != length - 2:
            raise ValueError("cut segment")
        at += 2 + length
        if kind == 0xDB:
            while part:
                wide, number = part[0] >> 4, part[0] & 15
                step = 64 * (2 if wide else 1)
                if len(part) < 1 + step:
                    raise ValueError("cut table")
                if number == 0:
                    table = [0] * 64
                    for place, value in zip(ZIGZAG, struct.unpack_from(">64H" if wide else ">64B", part, 1)):
                        table[place] = value
                part = part[1 + step :]
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", part, 1)
            size = (width, height)
    if size is None:
        raise ValueError("no frame")
    return (*size, table)


def _webp(body: bytes) -> tuple[int, int, list[int]]:
    kind = body[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(body[24:27], "little"), 1 + int.from_bytes(body[27:30], "little"), []
    if kind == b"VP8L" and body[20] == 0x2F:
        bits = struct.unpack_from("<I", body, 21)[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), []
    if kind == b"VP8 " and body[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack_from("<HH", body, 26)
        return width & 0x3FFF, height & 0x3FFF, []
    raise ValueError("chunk")


def read_header(body: bytes | None) -> tuple[str, int, int, list[int]]:
    """(format, width, height, luma table in natural order, empty where there is none)."""
    try:
        if body and body[:8] == b"\x89PNG\r\n\x1a\n":
            form, found = "png", (*struct.unpack_from(">II", body, 16), [])
        elif body and body[:3] == b"\xff\xd8\xff":
            form, found = "jpeg", _jpeg(body)
        elif body and body[:4] == b"RIFF" and body[8:12] == b"WEBP":
            if len(body) < 30:
                raise ValueError("cut header")
            form, found = "webp", _webp(body)
        elif body and body[:2] == b"BM":
            width, height = struct.unpack_from("<ii", body, 18)
            form, found = "bmp", (width, abs(height), [])
        else:
            raise ValueError("unknown format")
    except struct.error:
        raise ValueError("cut header") from None
    if found[0] <= 0 or found[1] <= 0:
        raise ValueError("size")
    return form, *found


def image_headers(images: DataFrame, key: str, content: str) -> DataFrame:
    """key, format, width, height, file_bytes, jpeg_quality (-1: unknown) and error of each picture."""
    rows = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))

    def run(frames):
        for frame in frames:
            out = []
            for name, body in zip(frame["key"], frame["content"]):
                try:
                    out.append((name, *read_header(body), len(body), None))
                except ValueError as e:
                    out.append((name, None, None, None, [], len(body) if body is not None else 0, str(e)))
            yield pd.DataFrame(out, columns=["key", "format", "width", "height", "luma", "file_bytes", "error"]).astype({"width": "Int32", "height": "Int32"})

    found = rows.mapInPandas(run, "key string, format string, width int, height int, luma array<int>, file_bytes long, error string")
    return found.select("key", "format", "width", "height", "file_bytes", jpeg_quality(F.col("luma"), LUMA).alias("jpeg_quality"), "error")
