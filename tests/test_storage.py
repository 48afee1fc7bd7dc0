"""Scans, sinks, archives, image transforms and rules on small files and pictures."""

import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.keys import LUMA, normalization_plan
from sievework.operators import headers, images, jpeg, validation
from sievework.sources import archives, scans, sinks, store


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a/x.PNG", b"12345")
        z.writestr("a/note.txt", b"no")
        z.writestr("a/", b"")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    whole = (tmp_path / "good.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "bad.zip").write_bytes(whole.replace(b"12345", b"12349"))
    paths = spark.createDataFrame([(str(tmp_path / f"{n}.zip"),) for n in ("good", "empty", "cut", "bad", "none")], "archive string")
    found = {(r.archive.rsplit("/")[-1], r.member, r.size, r.content and bytes(r.content), r.error is None) for r in archives.members(paths).collect()}
    assert found == {("good.zip", "a/x.PNG", 5, b"12345", True), ("bad.zip", "a/x.PNG", 5, None, False), ("cut.zip", None, None, None, False), ("none.zip", None, None, None, False)}
    state = {r.archive.rsplit("/")[-1]: (r.state, r.n) for r in archives.states(paths).collect()}
    assert state == {"good.zip": ("OK", 2), "empty.zip": ("EMPTY", 0), "cut.zip": ("INCOMPLETE", 0), "bad.zip": ("INCOMPLETE", 0), "none.zip": ("MISSING", 0)}
    checked = {r.archive.rsplit("/")[-1]: (r.ok, r.bad, r.bad_pct) for r in archives.verify(paths).collect()}
    assert checked == {"good.zip": (2, 0, 0.0), "empty.zip": (0, 0, 0.0), "cut.zip": (0, 1, 100.0), "bad.zip": (1, 1, 50.0), "none.zip": (0, 1, 100.0)}


def test_text_scans(spark, tmp_path):
    (tmp_path / "deny.txt").write_text("ab  some path with spaces.png\n\ncd\n")
    assert [tuple(r) for r in scans.deny_list(spark, str(tmp_path / "deny.txt")).orderBy("sha256").collect()] == [("ab", "some path with spaces.png"), ("cd", None)]
    (tmp_path / "list.txt").write_text("b.png\n\n a.png \n")
    assert [r.path for r in scans.input_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.png", "b.png"]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "one.csv").write_bytes(b"IsFake,Image_path\n1,x\xff.png\n0,\n")
    (tmp_path / "labels" / "two.csv").write_text("IsFake,Image_path\n0,y.png\n")
    read = lambda only: {(r.IsFake, r.Image_path, r.file) for r in scans.csv_labels(spark, str(tmp_path / "labels"), "IsFake string, Image_path string", "Image_path", only).collect()}
    assert read(None) == {("1", "x�.png", "one.csv"), ("0", "y.png", "two.csv")}
    assert read(["two.csv"]) == {("0", "y.png", "two.csv")}
    assert scans.config_hash({"b": 1, "a": 2}) == scans.config_hash({"a": 2, "b": 1})
    with pytest.raises(ValueError):
        scans.dispatch({}, "other")


def test_results_and_rules(spark, tmp_path):
    item = {"image_id": "1", "path": "p", "label": 1, "generator_family": "sd", "pred": 0.7}
    put = lambda name, **more: (tmp_path / name).write_text(json.dumps({"condition": "clean", "n": 1, "calibration": {"threshold": 0.4}, "predictions": [item], **more}))
    put("clean.json")
    put("clean.done.json")
    rows = scans.condition_results(spark, str(tmp_path))
    assert [(r.stem, r.condition, r.threshold, r.path, r.label, r.pred) for r in rows.collect()] == [("clean", "clean", 0.4, "p", 1, 0.7)]
    assert validation.result_findings(rows, F.col("condition")).count() == 0
    put("other.json", calibration={"threshold": 0.5}, predictions=[{**item, "label": 2, "pred": 1.5}])
    found = {r.rule: r.n for r in validation.result_findings(scans.condition_results(spark, str(tmp_path)), F.col("condition")).collect()}
    assert found == {"name": 1, "file": 1, "duplicate": 1, "threshold": 1, "label": 1, "pred": 1}
    with pytest.raises(validation.Refused):
        validation.require_none(validation.result_findings(scans.condition_results(spark, str(tmp_path)), F.col("condition")))


def test_refusals(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(validation.Refused):
        validation.training_gate(rows, rows.where("k = 'a'"), "k", {"complete": True})
    validation.training_gate(rows, rows.where("false"), "k", {"complete": True})
    assert validation.strict_build({"missing": 2}, False) is False
    for bad in (None, "", "0", "1", "x", "nan"):
        with pytest.raises(validation.Refused):
            validation.threshold_of(bad)
    assert validation.threshold_of(" 0.25\n") == 0.25
    for call, code in ((lambda: validation.protected_run(True, False, False), 2), (lambda: validation.protected_run(True, True, True), 3), (lambda: validation.denylist_state(1, False), 2)):
        with pytest.raises(validation.Refused) as e:
            call()
        assert e.value.code == code
    with pytest.raises(validation.Refused):
        validation.same_run({"a": 1}, {"a": 2})


def test_sinks(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, "x"), (1, "x"), (None, "n")], "k int, v string")
    assert sinks.append_new(df, path, "k") == 2
    assert sinks.append_new(df.union(spark.createDataFrame([(2, "y")], "k int, v string")), path, "k") == 1
    assert spark.read.parquet(path).count() == 3
    report = str(tmp_path / "r.csv")
    good = spark.createDataFrame([("b", 0.5), ("a", 1 / 3)], "c string, x double")
    sinks.write_report(good, report, ["c", "x"], ["c"])
    assert [tuple(r) for r in spark.read.csv(report, header=True).collect()] == [("a", "0.333333"), ("b", "0.500000")]
    sinks.write_threshold(spark, str(tmp_path / "tau"), 0.459366, report)
    assert store.read_text(spark, str(tmp_path / "tau")) == "0.459366\n"
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_report(good.withColumn("x", F.raise_error(F.lit("no")).cast("double")), report, ["c", "x"], ["c"])
    assert not store.exists(spark, report)
    with pytest.raises(FileNotFoundError):
        sinks.write_threshold(spark, str(tmp_path / "tau"), 0.5, report)
    assert json.loads(sinks.json_array(good, ["c"]).first()[0]) == [{"c": "a", "x": 1 / 3}, {"c": "b", "x": 0.5}]
    sinks.mark_done(spark, report, "f1")
    assert sinks.is_done(spark, report, "f1") and not sinks.is_done(spark, report, "f2")
    cache = str(tmp_path / "cache")
    source = spark.createDataFrame([("a",), ("b",)], "k string")
    for _ in range(2):
        assert sinks.cached(source, "k", lambda d: d.withColumn("v", F.upper("k")), cache).count() == 2
    moved = sinks.rewrite_paths(spark.createDataFrame([("p",), ("q",)], "path string"), spark.createDataFrame([("p", "z")], "path string, to string"), "path", "to")
    assert sorted(r.path for r in moved.collect()) == ["q", "z"]


def picture(h=37, w=29, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def filtered_png(p):
    """A PNG whose lines use all five filters in turn, made by the definition of each filter."""
    h, w, _ = p.shape
    flat, out = p.reshape(h, -1).astype(int), b""
    for y in range(h):
        kind = y % 5
        line = []
        for i, v in enumerate(flat[y]):
            a = flat[y][i - 3] if i >= 3 else 0
            b = flat[y - 1][i] if y else 0
            c = flat[y - 1][i - 3] if y and i >= 3 else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_png():
    p = picture()
    assert (images.png_decode(images.png_encode(p)) == p).all()
    assert (images.png_decode(filtered_png(p)) == p).all()
    for bad in (None, b"", b"x" * 40, images.png_encode(p)[:60]):
        with pytest.raises(images.Unreadable):
            images.png_decode(bad)


def test_transforms():
    p, flat = picture(), np.full((20, 24, 3), 77, np.uint8)
    for name in images.CONDITIONS:
        got = images.apply(p, name, 5)
        assert (got == images.apply(p, name, 5)).all() and got.dtype == np.uint8
        assert got.shape == ((30, 23, 3) if name == "crop_80" else (33, 26, 3) if name == "crop_80_area" else p.shape)
        if name.split("_")[0] in ("blur", "resize", "clean"):
            assert (images.apply(flat, name, 5) == flat).all()
    assert np.abs(images.apply(flat, "jpeg_90", 0).astype(int) - 77).max() <= 2
    errors = [np.abs(images.apply(p, f"jpeg_{q}", 0).astype(int) - p).mean() for q in (90, 70, 50, 30)]
    assert errors == sorted(errors)
    assert p.std() > images.blur(p, 0.5).std() > images.blur(p, 1.0).std() > images.blur(p, 2.0).std()
    assert abs(images.noise(np.full((200, 200, 3), 128, np.uint8), 0.05, np.random.default_rng(0)).std() - 12.75) < 0.2
    rng = np.random.default_rng(2)
    for family, (_, low, high) in images.DISTORTIONS.items():
        for _ in range(8):
            plan = [(family, rng.uniform(low, high), *rng.random(3))]
            got = images.distort(p, plan)
            assert got.dtype == np.uint8 and min(got.shape[:2]) >= 1
            assert got.tobytes() == images.distort(p, plan).tobytes()
    assert images.part(p, 0.8).shape == (30, 23, 3) and (images.part(p, 0.8) == p[3:33, 3:26]).all()
    whole = images.tensor(np.full((2, 3, 3), 255, np.uint8))
    assert whole.shape == (3, 2, 3) and np.allclose(whole[:, 0, 0], [(1 - m) / d for m, d in zip(images.CHANNEL_MEAN, images.CHANNEL_STD)])
    assert images.padded(p[:3, :2], 64).shape == (64, 64, 3) and images.padded(p[:1, :1], 8).shape == (8, 8, 3)
    assert [v.shape for v in images.views(p, 16)] == [(16, 16, 3)] * 5
    smooth = images.scaled(picture(4, 4), 64, 64)
    near = bin(images.perceptual_hash(smooth) ^ images.perceptual_hash(images.jpeg(smooth, 70, images.LUMA))).count("1")
    assert near <= 6


def test_distortion_plans(spark):
    plans = spark.range(4000).select(images.distortion_plan(F.col("id"), 17).alias("p")).collect()
    counts = np.bincount([len(r.p) for r in plans], minlength=3) / 4000
    assert np.abs(counts - [0.30, 0.55, 0.15]).max() < 0.03
    ones = [r.p[0].family for r in plans if len(r.p) == 1]
    for family, (weight, low, high) in images.DISTORTIONS.items():
        assert abs(ones.count(family) / len(ones) - weight) < 0.03
        values = [x.value for r in plans for x in r.p if x.family == family]
        assert low <= min(values) and max(values) <= high and abs(np.mean(values) - (low + high) / 2) < 0.05 * (high - low)
    both = [r.p[0].family for r in plans if {x.family for x in r.p} == {"jpeg", "noise"}]
    assert 0.3 < both.count("noise") / len(both) < 0.7


def test_normalised_and_tensors(spark):
    own = images.synthetic(spark, 12, 24).select("key", "content").union(spark.createDataFrame([("bad", bytearray(b"x"))], "key string, content binary"))
    plan = normalization_plan(F.col("key"), F.lit("png"), 17)
    wanted = {r.key: r.p for r in own.select("key", plan.alias("p")).collect()}
    for r in images.normalised(own, "key", "content", plan).collect():
        p = wanted[r.key]
        if r.key == "bad":
            assert r.error and r.content is None
            continue
        assert (r.format, r.jpeg_quality, r.n_recompress) == ("png" if p.lossless else "jpeg", p.final_quality, p.total_history)
        assert len(p.qualities) == p.n_extra and r.file_bytes == len(r.content) and (r.width, r.height) == (24, 24)
        head = headers.read_header(bytes(r.content))
        assert head[:3] == (r.format, 24, 24)
    found = headers.image_headers(images.normalised(own, "key", "content", plan).where("error is null").select("key", "content"), "key", "content").collect()
    assert all(r.jpeg_quality == -1 if wanted[r.key].lossless else abs(r.jpeg_quality - wanted[r.key].final_quality) <= 1 for r in found)
    found = images.tensors(own, "key", "content", 16).collect()
    assert all(r.error if r.key == "bad" else len(r.tensor) == 3 * 16 * 16 for r in found)
    drawn = {r.key: r.tensor for r in images.tensors(own, "key", "content", 16, 3).collect()}
    assert any(drawn[r.key] != r.tensor for r in found if r.key != "bad")
    files = images.fan_out(own.where("key = '1'"), "key", "content").collect()
    assert {r.condition: headers.read_header(bytes(r.content))[0] for r in files} == {c: "jpeg" if c.startswith("jpeg") else "png" for c in images.CONDITIONS if c != "crop_80_area"}
    rows = images.manifest_rows(own, "key", "content", label=F.lit(1), source=F.lit("s")).collect()
    assert len(rows[0]) == 13 and {(r.format, r.width, r.n_recompress, r.label) for r in rows} == {("png", 24, 0, 1), (None, None, 0, 1)}


def test_image_tables(spark):
    own = images.synthetic(spark, 3, 16).select("key", "content").union(spark.createDataFrame([("none", None), ("bad", bytearray(b"x"))], "key string, content binary"))
    done = images.fan_out(own, "key", "content")
    assert done.count() == 75 and done.where("error is not null").count() == 30
    assert [(r.n, r.e) for r in images.describe(own, "key", "content").agg(F.count("phash").alias("n"), F.count("error").alias("e")).collect()] == [(3, 2)]
    assert images.five_views(own, "key", "content", 8).count() == 15


def _segment(kind, body):
    return b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body


def test_headers(spark):
    assert headers.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and headers.ZIGZAG[-3:] == [55, 62, 63]

    def jpeg(quality, width, height, wide=False):
        scale = 5000 // quality if quality < 50 else 200 - 2 * quality
        table = [min(255, max(1, (x * scale + 50) // 100)) for x in LUMA]
        values = [table[p] for p in headers.ZIGZAG]
        body = struct.pack(">64H" if wide else ">64B", *values)
        return b"\xff\xd8" + _segment(0xE0, b"JFIF\0") + b"\xff" + _segment(0xDB, bytes([16 if wide else 0]) + body) + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 3)) + _segment(0xDA, b"") + b"\xff\xd9"

    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 639 | 479 << 14) + bytes(8)
    whole = {
        "j90": (jpeg(90, 640, 480), "jpeg", 640, 480, 90), "j30": (jpeg(30, 70000 % 65536, 9, True), "jpeg", 4464, 9, 30),
        "png": (images.png_encode(np.zeros((5, 7, 3), np.uint8)), "png", 7, 5, -1), "webp": (lossless, "webp", 640, 480, -1),
        "lossy": (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 320, 200), "webp", 320, 200, -1),
        "large": (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (999).to_bytes(3, "little") + (499).to_bytes(3, "little"), "webp", 1000, 500, -1),
        "bmp": (b"BM" + bytes(16) + struct.pack("<ii", 12, -34), "bmp", 12, 34, -1),
    }
    wrong = {"null": None, "empty": b"", "text": b"hello", "cut": jpeg(90, 640, 480)[:40], "none": b"\xff\xd8\xff\xd9", "short": b"BM"}
    rows = spark.createDataFrame([*[(k, bytearray(v[0])) for k, v in whole.items()], *[(k, v if v is None else bytearray(v)) for k, v in wrong.items()]], "key string, content binary")
    found = {r.key: r for r in headers.image_headers(rows, "key", "content").collect()}
    assert {k: (found[k].format, found[k].width, found[k].height, found[k].jpeg_quality, found[k].file_bytes, found[k].error) for k in whole} == {k: (*v[1:], len(v[0]), None) for k, v in whole.items()}
    assert all(found[k].error and found[k].format is None and found[k].jpeg_quality == -1 for k in wrong)
    assert headers.image_headers(rows.where("false"), "key", "content").count() == 0


def test_configurations(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b": [1, 2], "a": {"c": null}}')
    assert scans.load_config(spark, str(tmp_path / "a.json")) == {"b": [1, 2], "a": {"c": None}}
    (tmp_path / "b.json").write_text("[1]")
    with pytest.raises(ValueError):
        scans.load_config(spark, str(tmp_path / "b.json"))
    with pytest.raises(FileNotFoundError):
        scans.load_config(spark, str(tmp_path / "none.json"))
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a: 1\nb: [x, y]\n")
    assert scans.load_config(spark, str(tmp_path / "c.yaml")) == {"a": 1, "b": ["x", "y"]}


def _by_java(spark, body):
    """The pixels that the JVM's own reader gives."""
    jvm = spark.sparkContext._jvm
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(body))
    width, height = read.getWidth(), read.getHeight()
    rows = [[read.getRGB(x, y) & 0xFFFFFF for x in range(width)] for y in range(height)]
    return np.array([[(v >> 16, v >> 8 & 255, v & 255) for v in row] for row in rows])


def _from_java(spark, pixels):
    """The same picture as the JVM's own writer encodes it."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], 1)
    for y, row in enumerate(pixels.tolist()):
        for x, (r, g, b) in enumerate(row):
            image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def _alike(own, other):
    """The JVM's reader smooths the halved chroma planes; luma is the same wherever no channel met its end in either picture."""
    inside = ((own > 0) & (own < 255) & (other > 0) & (other < 255)).all(2)
    assert np.abs((own - other)[inside] @ [0.299, 0.587, 0.114]).max(initial=0) <= 3


def test_jpeg(spark):
    rng = np.random.default_rng(5)
    smooth = images.scaled(rng.integers(0, 256, (4, 5, 3), np.uint8), 37, 21)
    rough = rng.integers(0, 256, (33, 18, 3), np.uint8)
    for picture in (smooth, rough, np.full((1, 1, 3), 200, np.uint8), np.zeros((16, 16, 3), np.uint8)):
        for quality in (100, 90, 30, 1):
            body = images.jpeg_bytes(picture, quality, LUMA)
            own = jpeg.jpeg_decode(body).astype(int)
            assert headers.read_header(body)[:3] == ("jpeg", picture.shape[1], picture.shape[0]) and own.shape == picture.shape
            assert np.abs(own - images.jpeg(picture, quality, LUMA)).max() <= 1
            _alike(own, _by_java(spark, body))
            plain = images.jpeg_bytes(np.repeat(picture[:, :, :1], 3, 2), quality, LUMA)
            assert np.abs(jpeg.jpeg_decode(plain).astype(int) - _by_java(spark, plain)).max() <= 2
        grey = np.repeat(picture[:, :, :1], 3, 2)
        assert np.abs(jpeg.jpeg_decode(images.jpeg_bytes(grey, 100, LUMA)).astype(int) - grey).max() <= 2
    written = _from_java(spark, smooth)
    _alike(jpeg.jpeg_decode(written).astype(int), _by_java(spark, written))
    whole = images.jpeg_bytes(rough, 90, LUMA)
    for n in (0, 3, 30, 200, len(whole) // 2):
        with pytest.raises(images.Unreadable):
            images.decode(whole[:n])
    skewed = {s: 2 ** max(0, 30 - s) for s in range(60)}
    sizes, symbols = jpeg._code(jpeg.Counter(skewed))
    assert sum(sizes) == 60 and sum(n / 2**i for i, n in enumerate(sizes, 1)) < 1 and sorted(symbols) == list(range(60))
    rows = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(whole[:99]))], "key string, content binary")
    found = {r.key: (r.width, r.height, r.error is None) for r in images.describe(rows, "key", "content").collect()}
    assert found == {"a": (18, 33, True), "b": (None, None, False)}
