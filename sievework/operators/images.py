"""Image transforms on bytes: a PNG codec, evaluation conditions, training distortions, crops and views.

Pixels are uint8 arrays of height x width x 3. Transforms are pure functions of (pixels, parameters, seed), so a lost task
gives the same bytes again. Pictures come in as PNG or JPEG. `jpeg` gives the pixels after colour conversion, 4:2:0
subsampling and quantised 8x8 cosine blocks; `jpeg_bytes` makes a JPEG file. Conditions of the kind jpeg come out as
JPEG files, encoded once, all others as PNG.
"""

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import LUMA, jpeg_quality, native_history, uniform
from .headers import read_header
from .jpeg import COSINE, jpeg_decode, jpeg_encode

#: Kind and parameter of each evaluation condition, the last one outside the standard fifteen.
CONDITIONS = {
    "clean": ("clean", 0.0),
    "jpeg_90": ("jpeg", 90.0),
    "jpeg_70": ("jpeg", 70.0),
    "jpeg_50": ("jpeg", 50.0),
    "jpeg_30": ("jpeg", 30.0),
    "blur_05": ("blur", 0.5),
    "blur_10": ("blur", 1.0),
    "blur_20": ("blur", 2.0),
    "resize_050": ("resize", 0.5),
    "resize_025": ("resize", 0.25),
    "noise_002": ("noise", 0.02),
    "noise_005": ("noise", 0.05),
    "noise_010": ("noise", 0.1),
    "jitter_pm20": ("jitter", 0.2),
    "crop_80": ("crop", 0.8),
    "crop_80_area": ("crop", 0.8**0.5),
}
#: Shares of pictures with at most none, one and two distortions.
UP_TO = (0.30, 0.85, 1.0)
#: Weight of each family of distortions, and the range of its parameter.
DISTORTIONS = {
    "jpeg": (0.30, 25.0, 101.0),
    "resize": (0.20, 0.20, 1.00),
    "blur": (0.15, 0.0, 2.3),
    "noise": (0.15, 0.0, 0.11),
    "jitter": (0.10, 0.75, 1.25),
    "crop": (0.10, 0.75, 1.00),
}
#: Mean and standard deviation of the channels that tensors are scaled by.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: The standard chroma quantisation table is 99 but for this corner.
CHROMA_CORNER = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]
VERSION = "2.0"
MOST_PIXELS = 500_000_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class Unreadable(ValueError):
    """Bytes that are no PNG of eight bits a channel and no baseline JPEG."""


def png_encode(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    lines = np.zeros((height, 1 + 3 * width), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def png_size(content: bytes | None) -> tuple[int, int]:
    """Width and height from the header, before anything is unpacked; a picture of too many pixels is refused."""
    if not content or content[:8] != SIGNATURE or len(content) < 33:
        raise Unreadable("no PNG")
    width, height = struct.unpack(">II", content[16:24])
    if not width or not height or width * height > MOST_PIXELS:
        raise Unreadable("size")
    return width, height


def png_decode(content: bytes | None) -> np.ndarray:
    width, height = png_size(content)
    depth, colour, _, _, interlaced = content[24:29]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or not channels or interlaced:
        raise Unreadable("kind of PNG")
    at, body = 8, b""
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        if kind == b"IDAT":
            body += content[at + 8 : at + 8 + n]
        at += 12 + n
    try:
        raw = zlib.decompress(body)
    except zlib.error as e:
        raise Unreadable(str(e)) from e
    stride = width * channels
    if len(raw) != height * (stride + 1):
        raise Unreadable("length")
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(lines[y, 0], lines[y, 1:], above, channels)
    own = out.reshape(height, width, channels)
    return np.repeat(own[:, :, :1], 3, 2) if channels < 3 else own[:, :, :3].copy()


def decode(content: bytes | None) -> np.ndarray:
    """Pixels of a PNG or a baseline JPEG."""
    if not content or content[:2] != b"\xff\xd8":
        return png_decode(content)
    try:
        return jpeg_decode(content)
    except (ValueError, IndexError, KeyError, struct.error) as e:
        raise Unreadable(f"JPEG: {e}") from None


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), 0, np.uint8).ravel()
    if kind not in (3, 4):
        raise Unreadable("filter")
    out = [0] * step + line.tolist()
    up = [0] * step + above.tolist()
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (out[i] + guess) & 255
    return np.array(out[step:], np.uint8)


def _byte(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def blur(pixels: np.ndarray, sigma: float) -> np.ndarray:
    """Three box blurs a direction whose width has the Gaussian's variance; edges repeat."""
    if sigma < 1e-3:
        return pixels
    variance = sigma * sigma / 3
    half = int(((12 * variance + 1) ** 0.5 - 1) / 2)
    part = (2 * half + 1) * (half * (half + 1) - 3 * variance) / (6 * (variance - (half + 1) ** 2))
    whole = int((1 << 24) / (2 * (half + part) + 1))
    edge = ((1 << 24) - (2 * half + 1) * whole) // 2
    out = pixels.astype(np.int64)
    for axis in (1, 0):
        for _ in range(3):
            n, reach = out.shape[axis], half + 1
            wide = np.concatenate([np.repeat(out.take([0], axis), reach, axis), out, np.repeat(out.take([-1], axis), reach, axis)], axis)
            part_of = lambda k: wide.take(range(k, k + n), axis)  # noqa: E731, B023
            out = (whole * sum(part_of(k) for k in range(1, 2 * reach)) + edge * (part_of(0) + part_of(2 * reach)) + (1 << 23)) >> 24
    return _byte(out)


def _kernel(old: int, new: int) -> np.ndarray:
    """new x old weights of the bicubic kernel (a = -1/2), widened when shrinking, in 22-bit fixed point."""
    scale = old / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    low = np.maximum(0, (centre - 2 * wide + 0.5).astype(int))
    high = np.minimum(old, (centre + 2 * wide + 0.5).astype(int))
    at = np.arange(old)
    x = np.abs((at + 0.5 - centre[:, None]) / wide)
    w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
    w = np.where((at >= low[:, None]) & (at < high[:, None]), w, 0.0)
    return np.floor(w / w.sum(1, keepdims=True) * (1 << 22) + 0.5).astype(np.int64)


def scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    half = 1 << 21
    across = _byte((np.einsum("ow,hwc->hoc", _kernel(pixels.shape[1], width), pixels.astype(np.int64)) + half) >> 22)
    return _byte((np.einsum("oh,hwc->owc", _kernel(pixels.shape[0], height), across.astype(np.int64)) + half) >> 22)


def down_up(pixels: np.ndarray, factor: float) -> np.ndarray:
    height, width, _ = pixels.shape
    return scaled(scaled(pixels, max(1, round(width * factor)), max(1, round(height * factor))), width, height)


def noise(pixels: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    return _byte(np.rint(pixels.astype(np.float32) + rng.normal(0.0, sigma * 255.0, pixels.shape)))


def grey(pixels: np.ndarray) -> np.ndarray:
    r, g, b = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return (19595 * r + 38470 * g + 7471 * b + 32768) >> 16


def jitter(pixels: np.ndarray, brightness: float, contrast: float, saturation: float) -> np.ndarray:
    """Mixes with black, then with the mean grey, then with each pixel's own grey; the hue stays."""
    out = _byte(pixels * np.float32(brightness))
    mean = int(grey(out).mean() + 0.5)
    out = _byte(mean + np.float32(contrast) * (out.astype(np.float32) - mean))
    own = grey(out)[:, :, None].astype(np.float32)
    return _byte(own + np.float32(saturation) * (out - own))


def window(pixels: np.ndarray, width: int, height: int, x: int, y: int) -> np.ndarray:
    return pixels[y : y + height, x : x + width]


def part(pixels: np.ndarray, fraction: float, across: float = 0.5, down: float = 0.5) -> np.ndarray:
    """A window whose sides are `fraction` of the picture's; `across` and `down` share out the room beside it."""
    size = np.maximum(1, np.rint(np.array(pixels.shape[:2]) * fraction).astype(int))
    y, x = ((pixels.shape[:2] - size) * (down, across)).astype(int).tolist()
    return window(pixels, int(size[1]), int(size[0]), x, y)


def quantisation(quality: float, standard) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(standard).reshape(8, 8) * scale + 50) // 100, 1, 255)


def chroma_standard() -> np.ndarray:
    out = np.full((8, 8), 99)
    out[:4, :4] = CHROMA_CORNER
    return out


def jpeg(pixels: np.ndarray, quality: float, luma_standard) -> np.ndarray:
    """The loss of one JPEG compression at `quality`, without its entropy coder."""
    height, width, _ = pixels.shape
    p = np.pad(pixels, ((0, -height % 16), (0, -width % 16), (0, 0)), "edge").astype(np.float64)
    y = p @ [0.299, 0.587, 0.114]
    planes = [y, (p[:, :, 2] - y) / 1.772, (p[:, :, 0] - y) / 1.402]
    for i, plane in enumerate(planes):
        if i:
            plane = np.rint(plane.reshape(plane.shape[0] // 2, 2, -1, 2).mean((1, 3)))
        table = quantisation(quality, chroma_standard() if i else luma_standard)
        shift = 0.0 if i else 128.0
        blocks = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2) - shift
        kept = np.rint(COSINE @ blocks @ COSINE.T / table) * table
        plane = np.clip(np.rint((COSINE.T @ kept @ COSINE).swapaxes(1, 2).reshape(plane.shape)), -128, 127) + shift
        planes[i] = plane.repeat(2, 0).repeat(2, 1) if i else plane
    y, blue, red = planes
    green = y - (0.114 * 1.772 * blue + 0.299 * 1.402 * red) / 0.587
    return _byte(np.rint(np.stack([y + 1.402 * red, green, y + 1.772 * blue], 2)))[:height, :width]


def jpeg_bytes(pixels: np.ndarray, quality: float, luma_standard) -> bytes:
    return jpeg_encode(pixels, quantisation(quality, luma_standard), quantisation(quality, chroma_standard()))


def seed_of(key: str, condition: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{condition}|{key}".encode(), digest_size=4).digest(), "big")


def apply(pixels: np.ndarray, condition: str, seed: int) -> np.ndarray:
    kind, x = CONDITIONS[condition]
    rng = np.random.Generator(np.random.PCG64(seed))
    if kind == "jpeg":
        return jpeg(pixels, x, LUMA)
    if kind == "blur":
        return blur(pixels, x)
    if kind == "resize":
        return down_up(pixels, x)
    if kind == "noise":
        return noise(pixels, x, rng)
    if kind == "jitter":
        return jitter(pixels, *rng.uniform(1 - x, 1 + x, 3))
    return part(pixels, x) if kind == "crop" else pixels


def encoded(pixels: np.ndarray, condition: str, seed: int) -> tuple[bytes, int, int]:
    """The file of a condition, its width and height: JPEG, compressed once, for the kind jpeg, else PNG."""
    kind, x = CONDITIONS[condition]
    if kind == "jpeg":
        return jpeg_bytes(pixels, x, LUMA), pixels.shape[1], pixels.shape[0]
    got = apply(pixels, condition, seed)
    return png_encode(got), got.shape[1], got.shape[0]


def distortion_plan(key: Column, seed: int) -> Column:
    """What training does to a picture: an array of (family, value, a, b, c), drawn by keyed hashes, so that it is a plan like
    any other column. Families come by weighted order (the greatest log u / weight first); where noise and JPEG are both
    drawn, one hash decides which is first. a, b, c in [0, 1) are for what a family needs beside its value."""
    draw = lambda *purpose: uniform(key, F.lit("|".join(purpose)), F.lit(seed))
    steps = []
    for family, (weight, low, high) in DISTORTIONS.items():
        more = [draw(family, x).alias(x) for x in "abc"]
        value = F.lit(low) + draw(family, "value") * (high - low)
        steps.append(F.struct((-F.log(1 - draw(family, "order")) / weight).alias("late"), F.lit(family).alias("family"), value.alias("value"), *more))
    chance = draw("number")
    number = sum((F.when(chance >= share, 1).otherwise(0) for share in UP_TO), F.lit(0))
    picked = F.slice(F.array_sort(F.array(*steps)), 1, number)
    both = F.exists(picked, lambda x: x["family"] == "jpeg") & F.exists(picked, lambda x: x["family"] == "noise")
    early = F.when(draw("noise first") < 0.5, "noise").otherwise("jpeg")
    swapped = F.concat(F.filter(picked, lambda x: x["family"] == early), F.filter(picked, lambda x: x["family"] != early))
    ordered = F.when(both, swapped).otherwise(picked)
    return F.transform(ordered, lambda x: F.struct(x["family"].alias("family"), x["value"].alias("value"), *[x[c].alias(c) for c in "abc"]))


def _again(p, value, a, b, c):
    """One JPEG compression, or, for half of the pictures, a second one of another quality."""
    once = jpeg(p, int(value), LUMA)
    low, high = DISTORTIONS["jpeg"][1:]
    return jpeg(once, int(low + b * (high - low)), LUMA) if a < 0.5 else once


def _resized(p, value, a, b, c):
    """Smaller, and for half of the pictures back to the old size."""
    height, width = p.shape[:2]
    return down_up(p, value) if a < 0.5 else scaled(p, max(1, round(width * value)), max(1, round(height * value)))


def _grained(p, value, a, b, c):
    return noise(p, value, np.random.default_rng(int(a * (1 << 32))))


def _toned(p, value, a, b, c):
    low, high = DISTORTIONS["jitter"][1:]
    return jitter(p, value, low + a * (high - low), low + b * (high - low))


STEPS = {"jpeg": _again, "resize": _resized, "blur": lambda p, value, a, b, c: blur(p, value), "noise": _grained, "jitter": _toned, "crop": lambda p, value, a, b, c: part(p, value, a, b)}


def distort(pixels: np.ndarray, plan: list) -> np.ndarray:
    for family, *values in plan:
        pixels = STEPS[family](pixels, *values)
    return pixels


def distorted(images: DataFrame, key: str, content: str, seed: int = 17) -> DataFrame:
    """key, content (PNG), families (joined by +) and error of each picture under its own plan."""
    rows = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"), distortion_plan(F.col(key), seed).alias("plan"))

    def run(frames):
        for frame in frames:
            out = []
            for name, body, plan in zip(frame["key"], frame["content"], frame["plan"]):
                steps = [(x["family"], x["value"], x["a"], x["b"], x["c"]) for x in plan]
                families = "+".join(x[0] for x in steps)
                try:
                    out.append((name, png_encode(distort(decode(body), steps)), families, None))
                except Unreadable as e:
                    out.append((name, None, families, str(e)))
            yield pd.DataFrame(out, columns=["key", "content", "families", "error"])

    return rows.mapInPandas(run, "key string, content binary, families string, error string")


def normalised(images: DataFrame, key: str, content: str, plan: Column) -> DataFrame:
    """Each picture re-encoded by its plan (see `functions.keys.normalization_plan`): key, content, format, width, height,
    file_bytes, jpeg_quality, n_recompress and error. Lossless plans give PNG, others the JPEG file of the last quality."""
    rows = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"), plan.alias("plan")).select("key", "content", "plan.*")
    names = ["key", "content", "format", "width", "height", "file_bytes", "jpeg_quality", "n_recompress", "error"]

    def run(frames):
        for frame in frames:
            out = []
            for name, body, history, qualities in zip(frame["key"], frame["content"], frame["total_history"], frame["qualities"]):
                try:
                    pixels = decode(body)
                    *earlier, last = [int(q) for q in qualities] or [-1]
                    for quality in earlier:
                        pixels = jpeg(pixels, quality, LUMA)
                    done = png_encode(pixels) if last < 0 else jpeg_bytes(pixels, last, LUMA)
                    out.append((name, done, "png" if last < 0 else "jpeg", pixels.shape[1], pixels.shape[0], len(done), last, int(history), None))
                except Unreadable as e:
                    out.append((name, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names[3:8]})

    kinds = "key string, content binary, format string, width long, height long, file_bytes long, jpeg_quality long, n_recompress long, error string"
    return rows.mapInPandas(run, kinds)


def tensor(pixels: np.ndarray) -> np.ndarray:
    """Channels first, scaled to the channels' mean and standard deviation, as 32-bit floats."""
    x = pixels.astype(np.float32) / np.float32(255)
    return np.ascontiguousarray(((x - np.float32(CHANNEL_MEAN)) / np.float32(CHANNEL_STD)).transpose(2, 0, 1))


def tensors(images: DataFrame, key: str, content: str, side: int, seed: int | None = None) -> DataFrame:
    """key, error and the tensor (side x side, three channels, flat) of the middle of each picture, or, with a seed, of a
    window drawn by keyed hashes; smaller pictures are padded by reflection, none is resized."""
    place = [F.lit(0.5), F.lit(0.5)] if seed is None else [uniform(F.col(key), F.lit("crop " + x), F.lit(seed)) for x in "xy"]
    rows = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"), place[0].alias("x"), place[1].alias("y"))

    def run(frames):
        for frame in frames:
            out = []
            for name, body, x, y in zip(frame["key"], frame["content"], frame["x"], frame["y"]):
                try:
                    p = padded(decode(body), side)
                    out.append((name, tensor(window(p, side, side, int(x * (p.shape[1] - side)), int(y * (p.shape[0] - side)))).ravel(), None))
                except Unreadable as e:
                    out.append((name, None, str(e)))
            yield pd.DataFrame(out, columns=["key", "tensor", "error"])

    return rows.mapInPandas(run, "key string, tensor array<float>, error string")


def padded(pixels: np.ndarray, side: int) -> np.ndarray:
    """At least side x side, by reflection; as a side may be longer than the picture, reflection repeats."""
    height, width, _ = pixels.shape
    grow = lambda n: ((max(0, side - n)) // 2, max(0, side - n) - max(0, side - n) // 2)
    return np.pad(pixels, (grow(height), grow(width), (0, 0)), "reflect" if min(height, width) > 1 else "edge")


def views(pixels: np.ndarray, side: int) -> list[np.ndarray]:
    """The centre and the four corners, side x side."""
    p = padded(pixels, side)
    bottom, right = p.shape[0] - side, p.shape[1] - side
    return [window(p, side, side, x, y) for x, y in ((right // 2, bottom // 2), (0, 0), (right, 0), (0, bottom), (right, bottom))]


def registry(spark: SparkSession) -> DataFrame:
    """place, condition, kind, parameter and whether it is one of the fifteen."""
    rows = [(i, name, kind, float(x), i < 15) for i, (name, (kind, x)) in enumerate(CONDITIONS.items())]
    return spark.createDataFrame(rows, "place int, condition string, kind string, parameter double, standard boolean")


def fan_out(images: DataFrame, key: str, content: str, seed: int = 17, standard: bool = True) -> DataFrame:
    """Every image under every condition: key, condition, content (see `encoded`), width, height and error (null where it worked).

    The sixteen conditions are a broadcast table; images never shuffle. Null or unreadable content gives a row with its error."""
    known = registry(images.sparkSession)
    pairs = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).join(F.broadcast(known.where("standard") if standard else known).select("condition"))

    def run(frames):
        for frame in frames:
            rows, held, last, pixels = [], 0, None, None
            for name, body, condition in zip(frame["key"], frame["content"], frame["condition"]):
                try:
                    if last is None or body != last:
                        pixels, last = decode(body), body
                    rows.append((name, condition, *encoded(pixels, condition, seed_of(name, condition, seed)), None))
                    held += len(rows[-1][2])
                except Unreadable as e:
                    rows.append((name, condition, None, None, None, str(e)))
                if held > 32 << 20:
                    yield _frame(rows)
                    rows, held = [], 0
            yield _frame(rows)

    return pairs.mapInPandas(run, "key string, condition string, content binary, width int, height int, error string")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "condition", "content", "width", "height", "error"])
    return out.astype({"width": "Int32", "height": "Int32"})


def perceptual_hash(pixels: np.ndarray) -> int:
    """64 bits: which of the 8x8 lowest cosine terms of the 32x32 grey picture are above their median."""
    small = scaled(np.repeat(grey(pixels).astype(np.uint8)[:, :, None], 3, 2), 32, 32)[:, :, 0].astype(np.float64)
    k = np.arange(32)
    cosine = np.cos((2 * k + 1) * k[:, None] * np.pi / 64)
    low = (cosine @ small @ cosine.T)[:8, :8]
    return int("".join("1" if b else "0" for b in (low > np.median(low)).ravel()), 2)


def describe(images: DataFrame, key: str, content: str) -> DataFrame:
    """key, sha256, phash (16 hex digits), width, height, file_bytes and error of each image."""
    rows = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))

    def run(frames):
        for frame in frames:
            out = []
            for name, body in zip(frame["key"], frame["content"]):
                try:
                    pixels = decode(body)
                    out.append((name, hashlib.sha256(body).hexdigest(), f"{perceptual_hash(pixels):016x}", pixels.shape[1], pixels.shape[0], len(body), None))
                except Unreadable as e:
                    out.append((name, hashlib.sha256(body).hexdigest() if body is not None else None, None, None, None, len(body or b""), str(e)))
            yield pd.DataFrame(out, columns=["key", "sha256", "phash", "width", "height", "file_bytes", "error"]).astype({"width": "Int32", "height": "Int32"})

    return rows.mapInPandas(run, "key string, sha256 string, phash string, width int, height int, file_bytes long, error string")


def manifest_rows(images: DataFrame, key: str, content: str, **more: Column) -> DataFrame:
    """The thirteen columns of a manifest for each image; label, source, generator_family and split are given as columns."""
    own = images.select(F.col(key).cast("string").alias("path"), F.col(content).alias("content"), *[more.get(c, F.lit(None).cast(t)).cast(t).alias(c) for c, t in (("label", "tinyint"), ("source", "string"), ("generator_family", "string"), ("split", "string"))])

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                body = row.content
                form, width, height, luma, sha, phash = None, None, None, [], None, None
                if body is not None:
                    sha = hashlib.sha256(body).hexdigest()
                    try:
                        form, width, height, luma = read_header(body)
                        phash = f"{perceptual_hash(decode(body)):016x}"
                    except ValueError:
                        pass
                out.append((row.path, sha, phash, row.label, row.source, row.generator_family, width, height, form, None if body is None else len(body), luma, row.split))
            yield pd.DataFrame(out, columns=names).astype({"label": "Int8", "width": "Int32", "height": "Int32", "file_bytes": "Int64"})

    names = ["path", "sha256", "phash", "label", "source", "generator_family", "width", "height", "format", "file_bytes", "luma", "split"]
    kinds = "path string, sha256 string, phash string, label tinyint, source string, generator_family string, width int, height int, format string, file_bytes long, luma array<int>, split string"
    quality, history = jpeg_quality(F.col("luma"), LUMA).cast("smallint"), native_history(F.col("format")).cast("smallint")
    return own.mapInPandas(run, kinds).select(*names[:-2], quality.alias("jpeg_quality"), history.alias("n_recompress"), "split")


def five_views(images: DataFrame, key: str, content: str, side: int) -> DataFrame:
    """Five rows an image: key, view and content; unreadable images give none."""
    rows = images.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content"))

    def run(frames):
        for frame in frames:
            for name, body in zip(frame["key"], frame["content"]):
                try:
                    pixels = decode(body)
                except Unreadable:
                    continue
                yield pd.DataFrame([(name, i, png_encode(v)) for i, v in enumerate(views(pixels, side))], columns=["key", "view", "content"])

    return rows.mapInPandas(run, "key string, view int, content binary")


def synthetic(spark: SparkSession, n: int, side: int = 64, seed: int = 17) -> DataFrame:
    """n images made from their number: key, label and content."""

    def run(frames):
        for frame in frames:
            out = []
            for i in frame["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(i)]))
                flat = scaled(rng.integers(0, 256, (4, 4, 3), np.uint8), side, side)
                out.append((str(i), int(i) % 2, png_encode(flat)))
            yield pd.DataFrame(out, columns=["key", "label", "content"])

    return spark.range(n).mapInPandas(run, "key string, label int, content binary")
