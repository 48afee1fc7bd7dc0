"""Benchmark decontamination (operator 8): a broadcast hash set of normalised test windows.

Texts are lower-cased (A-Z) and cut into words of ASCII digits, ASCII letters and characters beyond ASCII. Every `n`
consecutive words of a benchmark item are a window; a shorter item is one window. The windows go to the executors as a
broadcast whose size is checked: about `block_bytes` of windows and item ids. A larger benchmark is scanned in blocks of
that size, dealt by window and item, so that a window of very many items is spread, too. Each block's finds are written
before its broadcast is released and the next one made; they meet the numbered documents beside their rows, without a
shuffle of texts. So nothing of unbounded size is broadcast and nothing is left out. A training
text is scanned with rolling hashes of its words (vectorised); every hash hit is verified against the window's words
before it counts.

Defined cases: a null or empty text has no words and no hits; a null item id counts as the empty id; items or texts that
repeat count each; an empty benchmark hits nothing; columns named like a result are replaced.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Beside, by_bytes, materialize, numbered, slices, trimming, without, write_beside

#: Lower-cases A-Z and turns every other ASCII character that is neither digit nor letter into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")


def words_of(body: bytes | None) -> list[bytes]:
    return body.translate(FOLD).split() if body else []


def rolling(words: list[bytes], lengths) -> dict[int, np.ndarray]:
    """For each length the hashes of all windows, by doubling: a window's hash is the front's times a power plus the back's."""
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = {}
    with np.errstate(over="ignore"):
        powers, doubled, size = {1: BASE}, {1: one}, 1
        while size * 2 <= min(len(words), max(lengths, default=0)):
            h = doubled[size]
            doubled[size * 2] = h[:-size] * powers[size] + h[size:]
            powers[size * 2] = powers[size] * powers[size]
            size *= 2
        for length in lengths:
            if length > len(words):
                continue
            acc, done, left = None, 0, length
            for p in sorted(doubled, reverse=True):
                if left >= p:
                    count = len(words) - length + 1
                    part = doubled[p][done : done + count]
                    acc = part if acc is None else acc * powers[p] + part
                    done, left = done + p, left - p
            out[length] = acc
    return out


def windows(benchmark: DataFrame, n: int, text: str) -> DataFrame:
    """One row for each distinct window: its words, joined by spaces, and the ids of its items."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                if words:
                    m = min(n, len(words))
                    rows += [(item, w) for w in {b" ".join(words[i : i + m]) for i in range(len(words) - m + 1)}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item", "window"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("binary").alias("body"))
    return items.mapInArrow(run, "item string, window binary").distinct()


class Scanner:
    """Finds windows in texts. Built once per worker and broadcast."""

    def __init__(self, found: dict[bytes, list[str]]):
        self.found = found
        self.by_length: dict[int, np.ndarray] = {}
        groups: dict[int, list[list[bytes]]] = {}
        for w in found:
            words = w.split(b" ")
            groups.setdefault(len(words), []).append(words)
        for length, group in groups.items():
            self.by_length[length] = np.unique(np.concatenate([rolling(w, [length])[length] for w in group]))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Places (start, end) of every verified window, and the items they belong to."""
        places, items = [], set()
        for length, hashes in rolling(words, self.by_length).items() if words else ():
            known = self.by_length[length]
            at = np.searchsorted(known, hashes)
            for i in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == hashes).tolist():
                if own := self.found.get(b" ".join(words[i : i + length])):
                    places.append((i, i + length))
                    items.update(own)
        return places, items


_SCANNERS: dict[str, Scanner] = {}
SCAN = "struct<n_words:bigint,places:array<struct<a:int,b:int>>,items:array<string>>"
PLACES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
FOUND = pa.struct([("n_words", pa.int64()), ("places", PLACES), ("items", pa.list_(pa.string()))])


def scanning(sent, token: str):
    """The Arrow function for one broadcast block; each worker builds the scanner once, under the block's token."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if token not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[token] = Scanner(sent.value)
        scanner = _SCANNERS[token]
        for texts in trimming(batches):
            out = []
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for lo, hi in by_bytes(sizes, 8 << 20):
                for body in texts.slice(lo, hi - lo).to_pylist():
                    words = words_of(body)
                    places, items = scanner.scan(words)
                    out.append({"n_words": len(words), "places": [{"a": a, "b": b} for a, b in merged(places)], "items": sorted(items)})
            yield pa.array(out, FOUND)

    return scan


def gathered(path: str):
    """The Arrow function that gives each numbered text what all blocks found in it."""

    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        beside = Beside(path)
        for texts, rows in trimming(batches):
            hits: dict[int, dict] = {}
            for a, _, places in beside.runs(np.asarray(rows)):
                at = np.flatnonzero(places >= 0)
                if len(at):
                    hits.update(zip((a + at).tolist(), beside.table.take(pa.array(places[at])).to_pylist()))
            out = []
            for k, body in enumerate(texts):
                hit = hits.get(k, {"places": [], "items": []})
                spans = merged((x["a"], x["b"]) for x in hit["places"])
                out.append({"n_words": len(words_of(body.as_py())), "places": [{"a": a, "b": b} for a, b in spans], "items": sorted(hit["items"])})
            yield pa.array(out, FOUND)

    return scan


def merged(places) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", block_bytes: int = 64 << 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted as strings), items_sha256, contaminated and spans (merged word ranges hit)."""
    spark = docs.sparkSession
    found = windows(benchmark, n, text)
    total = found.agg(F.sum(F.length("window") + F.octet_length("item") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    docs = without(docs, *[c for c in RESULTS if c != text])

    def sent_block(block: int):
        own = found.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == block) if blocks > 1 else found
        mine: dict[bytes, list[str]] = {}
        for r in own.toLocalIterator():
            mine.setdefault(bytes(r["window"]), []).append(r["item"])
        return spark.sparkContext.broadcast(mine)

    body = F.col(f"`{text}`").cast("binary")
    if blocks == 1:
        out = docs.withColumn("_all", F.arrow_udf(scanning(sent_block(0), uuid.uuid4().hex), SCAN)(body))
    else:
        docs, found, hits = numbered(docs), materialize(found, "windows"), None
        for block in range(blocks):
            sent = sent_block(block)
            scanned = docs.select("_row", F.arrow_udf(scanning(sent, uuid.uuid4().hex), SCAN)(body).alias("s"))
            own = materialize(scanned.where(F.size("s.places") > 0).select("_row", "s.places", "s.items"), "hits")
            sent.destroy()
            hits = own if hits is None else hits.union(own)
        path = write_beside(hits.groupBy("_row").agg(F.flatten(F.collect_list("places")).alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "found")
        out = docs.withColumn("_all", F.arrow_udf(gathered(path), SCAN)(body, F.col("_row"))).drop("_row")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["b"] - x["a"]))
    return (
        out.withColumns({"spans": F.col("_all.places"), "items": F.array_sort("_all.items"), "n_words": F.col("_all.n_words")})
        .withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("_all")
    )


def cut_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The texts without the words of their spans; what stands between words that stay is kept as it was."""
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, spans in batches:
            out = []
            for body, places in zip(bodies.to_pylist(), spans.to_pylist()):
                if body and places:
                    starts, ends, folded, at = [], [], body.translate(FOLD), 0
                    for w in folded.split():
                        at = folded.index(w, at)
                        starts.append(at)
                        at += len(w)
                        ends.append(at)
                    for p in reversed(places):
                        body = body[: starts[p["a"]]] + body[ends[p["b"] - 1] :]
                out.append(None if body is None else body.decode("utf-8"))
            yield pa.array(out, pa.string())

    return docs.withColumn(text, F.arrow_udf(cut, "string")(F.col(f"`{text}`").cast("binary"), F.col("spans")))
