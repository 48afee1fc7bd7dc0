"""Zip archives: members, their bytes, state and verification. A task takes one archive and opens its own handle."""

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import open_shared

#: Suffixes of images.
IMAGES = (".bmp", ".jpeg", ".jpg", ".png", ".webp")
MEMBER = "archive string, member string, size long, content binary, error string"
BATCH_BYTES = 32 << 20
NAMES = ["archive", "member", "size", "content", "error"]


def _spread(archives: DataFrame) -> DataFrame:
    """One archive a task, as far as the session's partitions go."""
    return archives.select("archive").distinct().repartition("archive")


def members(archives: DataFrame, suffixes: tuple[str, ...] = IMAGES, content: bool = True) -> DataFrame:
    """archive, member, size, content and error of members with one of the suffixes; folders are skipped. A member that can't
    be read, and an archive that can't (its member is null), is a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name in (n for f in frames for n in f["archive"]):
            rows, held = [], 0
            try:
                with open_shared(name) as raw, zipfile.ZipFile(raw) as z:
                    for info in z.infolist():
                        if info.is_dir() or not info.filename.lower().endswith(suffixes):
                            continue
                        body = error = None
                        try:
                            body = z.read(info) if content else None
                        except Exception as e:  # noqa: BLE001  zlib, CRC, EOF: whatever a broken member raises
                            error = f"{type(e).__name__}: {e}"
                        rows.append((name, info.filename, info.file_size, body, error))
                        held += info.file_size if content else 100
                        if held > BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=NAMES)
                            rows, held = [], 0
            except Exception as e:  # noqa: BLE001
                rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=NAMES).astype({"size": "Int64"})

    return _spread(archives).mapInPandas(run, MEMBER)


def states(archives: DataFrame) -> DataFrame:
    """state: MISSING, EMPTY, OK or INCOMPLETE, from the directory and the first and last member; n members."""

    def run(frames):
        for name in (n for f in frames for n in f["archive"]):
            try:
                with open_shared(name) as raw, zipfile.ZipFile(raw) as z:
                    own = [i for i in z.infolist() if not i.is_dir()]
                    for info in own[:1] + own[-1:]:
                        z.read(info)
                state, n = ("OK", len(own)) if own else ("EMPTY", 0)
            except FileNotFoundError:
                state, n = "MISSING", 0
            except Exception:  # noqa: BLE001  zlib, struct, EOF: whatever a broken archive raises
                state, n = "INCOMPLETE", 0
            yield pd.DataFrame([(name, state, n)], columns=["archive", "state", "n"])

    return _spread(archives).mapInPandas(run, "archive string, state string, n long")


def verify(archives: DataFrame) -> DataFrame:
    """Every member read in pieces: ok, bad and bad_pct (two digits; 0 for none) of each archive; an unreadable archive has one bad."""

    def run(frames):
        for name in (n for f in frames for n in f["archive"]):
            ok = bad = 0
            try:
                with open_shared(name) as raw, zipfile.ZipFile(raw) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        try:
                            with z.open(info) as m:
                                while m.read(1 << 20):
                                    pass
                            ok += 1
                        except Exception:  # noqa: BLE001
                            bad += 1
            except Exception:  # noqa: BLE001
                bad += 1
            yield pd.DataFrame([(name, ok, bad)], columns=["archive", "ok", "bad"])

    return with_share(_spread(archives).mapInPandas(run, "archive string, ok long, bad long"))


def verify_shards(files: DataFrame) -> DataFrame:
    """Every row group of each parquet file (column archive) read: ok, bad and bad_pct, as `verify` gives them for zip archives."""

    def run(frames):
        import pyarrow.parquet as pq

        for name in (n for f in frames for n in f["archive"]):
            ok = bad = 0
            try:
                with open_shared(name) as raw:
                    shard = pq.ParquetFile(raw)
                    for group in range(shard.num_row_groups):
                        try:
                            for _ in shard.iter_batches(row_groups=[group]):
                                pass
                            ok += 1
                        except Exception:  # noqa: BLE001
                            bad += 1
            except Exception:  # noqa: BLE001
                bad += 1
            yield pd.DataFrame([(name, ok, bad)], columns=["archive", "ok", "bad"])

    return with_share(_spread(files).mapInPandas(run, "archive string, ok long, bad long"))


def with_share(rows: DataFrame) -> DataFrame:
    n = F.col("ok") + F.col("bad")
    return rows.withColumn("bad_pct", F.when(n == 0, 0.0).otherwise(F.round(100 * F.col("bad") / n, 2)))


def totals(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count("*").alias("archives"), F.sum("ok").alias("ok"), F.sum("bad").alias("bad"), F.count_if(F.col("bad") > 0).alias("damaged"))
