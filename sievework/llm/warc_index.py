"""WARC archives with a two-level capture index (operator 3).

Keys are URLs with their hosts reversed (com,example)/path). One range shuffle by (key, page_id, digest) brings the records
into key order; each task writes one archive of gzip members and beside it the sorted index lines in compressed blocks, and
returns one directory row a block (first and last key, place in the index file, place of its records in the archive).
The directory is the sparse level. A look-up routes each key to the archives whose range of keys holds it, by binary search
over one pair of keys an archive; there it finds its block by binary search over the directory's rows of that archive,
reads that byte range, searches the block, and reads the byte ranges of the records found. Keys are looked up in their
order, as a table of any size; the driver and the workers hold one pair of keys for each archive, one for each task that
wrote. A key that straddles archives goes to each of them.

Which record is the response and which revisit it is decided over digests and ids alone, before the payloads move: groups
with one id leave no trace, each later record of a group leaves one decision row, which meets its page in the range
shuffle. A task that runs again writes files of another name; only directory rows of tasks that succeeded are read.

Defined cases: a null payload is empty; a null URL is the empty key; a page without id is a response that none refers to;
pages that repeat id and payload are all responses; pages that share URL and id but not the payload are decided each by its
own payload; columns beside page_id, url and html don't travel; an empty table
gives an empty directory. Rows equal in URL, id and payload pass through one task, one at a time.
"""

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, open_read, open_write, slices

DIRECTORY = "cdx string, warc string, first_key string, last_key string, offset long, length long, warc_from long, warc_to long, lines long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture


def sort_key(url: Column) -> Column:
    """The URL without scheme, user, port and fragment, its host in lower case and reversed."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*:/*", "")
    place = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(place, r"^[^@]*@", ""), r":[0-9]*$", ""))
    host = F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www[0-9]*\.", ""), r"\.")), ",")
    path = F.substr(bare, F.length(place) + 1)
    return F.concat(host, F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))


def decisions(pages: DataFrame, min_bytes: int) -> DataFrame:
    """key, page_id and sha of each page that revisits an earlier one, with that one's id."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.where(F.octet_length(body) >= min_bytes).select("page_id", sort_key(F.col("url")).alias("key"), F.sha1(body).alias("sha"))
    first = slim.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    return slim.join(first, "sha").where("page_id > first").select("key", "page_id", "sha", "first").distinct()


def record(page_id, url, body: bytes, digest: str, first) -> bytes:
    """One WARC record; a revisit has the response's HTTP head, whose Content-Length still tells the payload's bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if first is not None else http + body
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes, level: int = 3) -> bytes:
    """A gzip member without time or name."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parsed(raw: bytes) -> tuple:
    """A row of RECORD from one record; checks the length and, of a response, the digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != "WARC/1.1" or len(block) != int(fields["Content-Length"]):
        raise ValueError("broken WARC record")
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    return number("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, digest, size, number("WARC-Refers-To"), body if kind == "response" else None


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, block_lines: int = 512) -> DataFrame:
    """Writes archives and index under `folder`; returns the directory, which is written there as well."""

    def run(batches):
        name, out = None, []
        lines: list[str] = []
        at = block_from = index_at = 0
        place = decided = None

        def close_block():
            nonlocal index_at, block_from, lines
            data = packed("\n".join(lines).encode(), 6)
            cdx.write(data)
            out.append((f"{name}.cdx.gz", f"{name}.warc.gz", json.loads(lines[0])[0], json.loads(lines[-1])[0], index_at, len(data), block_from, at, len(lines)))
            index_at, block_from, lines = index_at + len(data), at, []

        for batch in slices(batches):
            for key, page_id, kind, first, sha, url, body in zip(*[c.to_pylist() for c in batch.columns]):
                if name is None:
                    name = f"{folder}/{uuid.uuid4().hex}"
                    warc, cdx = open_write(f"{name}.warc.gz"), open_write(f"{name}.cdx.gz")
                if place != (key, page_id, sha):
                    place, decided = (key, page_id, sha), None
                if kind == 0:
                    decided = first
                    continue
                body, first = body or b"", decided
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = packed(record(page_id, url, body, digest, first))
                warc.write(data)
                lines.append(json.dumps([key, page_id, digest, at, len(data)], ensure_ascii=False))
                at += len(data)
                if len(lines) >= block_lines or at - block_from >= 8 << 20:
                    close_block()
        if name is not None:
            if lines:
                close_block()
            warc.close()
            cdx.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[x.split()[0] for x in DIRECTORY.split(", ")])

    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    page = pages.select(sort_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), F.sha1(body).alias("sha"), "url", body.alias("body"))
    decision = decisions(pages, min_bytes).select("key", F.col("page_id").cast("long").alias("page_id"), F.lit(0).alias("kind"), F.col("first").cast("long").alias("first"), "sha", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"))
    order = ("key", "page_id", "sha")
    rows = page.union(decision).repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    rows.mapInArrow(run, DIRECTORY).write.parquet(f"{folder}/directory")
    return directory(pages.sparkSession, folder)


def directory(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DIRECTORY).parquet(f"{folder}/directory")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORD.split(", ")])


def look_up(blocks: DataFrame, wanted: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of the URLs whose sort keys are in wanted (key): binary search over archives, blocks and lines, then range reads."""
    spark = blocks.sparkSession
    files = sorted(tuple(r) for r in blocks.groupBy("cdx", "warc").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).select("low", "high", "cdx", "warc").collect())
    sent = spark.sparkContext.broadcast(files)
    names = spark.createDataFrame([(i, f[2]) for i, f in enumerate(files)], "file int, cdx string")

    def route(batches):
        low, high = [f[0] for f in sent.value], [f[1] for f in sent.value]
        for batch in batches:
            keys, found = [], []
            for key in batch.column(0).to_pylist():
                for i in range(bisect.bisect_left(high, key), bisect.bisect_right(low, key)):
                    keys.append(key)
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(keys, pa.string())], names=["file", "key"])

    def run(batches):
        now, places, first = None, [], []
        lines, opened, cdx, warc = [], None, None, None
        out, size = [], 0
        for batch in batches:
            for i, is_key, offset, key, last, length in zip(*[c.to_pylist() for c in batch.columns]):
                if i != now:
                    for f in (cdx, warc):
                        if f is not None:
                            f.close()
                    now, places, first, opened = i, [], [], None
                    cdx, warc = (open_read(x) for x in sent.value[i][2:])
                if not is_key:
                    places.append((offset, length, last))
                    first.append(key)
                    continue
                k = max(0, bisect.bisect_left(first, key) - 1)  # the block before may end with the key
                while k < len(first) and first[k] <= key:
                    if places[k][2] >= key:
                        if opened != k:
                            cdx.seek(places[k][0])
                            lines, opened = [json.loads(x) for x in zlib.decompress(cdx.read(places[k][1]), 31).decode().split("\n")], k
                        n = bisect.bisect_left(lines, key, key=lambda x: x[0])
                        while n < len(lines) and lines[n][0] == key:
                            warc.seek(lines[n][3])
                            out.append(parsed(zlib.decompress(warc.read(lines[n][4]), 31)))
                            size += len(out[-1][6] or b"") + 256
                            n += 1
                            if size >= batch_bytes:
                                yield _batch(out)
                                out, size = [], 0
                    k += 1
        if out:
            yield _batch(out)

    asked = wanted.select("key").mapInArrow(route, "file int, key string").select("file", F.lit(1).alias("is_key"), F.lit(0).cast("long").alias("offset"), "key", F.lit("").alias("last_key"), F.lit(0).cast("long").alias("length"))
    sparse = blocks.join(names, "cdx").select("file", F.lit(0).alias("is_key"), "offset", F.col("first_key").alias("key"), "last_key", "length")
    rows = asked.union(sparse).repartition(max(1, len(files)), "file").sortWithinPartitions("file", "is_key", "offset", "key")
    return rows.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages into archives in the shared folder and looks every page up by its URL through the index."""
    blocks = write_archives(pages, new_path(pages.sparkSession, "warc"), min_bytes)
    return look_up(blocks, pages.select(sort_key(F.col("url")).alias("key")).distinct())
