"""SimHash near-duplicates (operator 10) by Golay-code fuzzy hashing.

A fingerprint's bit is 1 if it is set in more than half of the XXH64 values (seed 42) of the text's word shingles.
Candidates: the 64 bits are three segments of 22, 21 and 21 bits. If two fingerprints differ in at most 4 bits, the two
segments that differ least differ in at most 2 bits together. So for one of the three pairs of segments there is a
point at most one flipped bit away from both. Each segment is decoded, zero-padded, by the perfect (23,12) Golay code to
the index of its nearest codeword; a fingerprint gets, for each pair of segments, the pair of indices of itself and of
all its one-bit neighbours (about ten distinct keys a pair, since flips mostly decode alike). Two linked fingerprints
share a key for certain. All fingerprints of a key meet in a stream sorted by key, are verified by their Hamming
distance, and leave a spanning forest of the key's links: no more edges than members, however many pairs link. Edges
join over all keys by stars (`components`).

Distinct fingerprints, not documents, are keyed, so a group of copies is one row there. Texts are read once and not
shuffled.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words than a shingle are one
shingle; a null id counts only where a component has no other; rows repeat in the result as in the input; columns beside
doc_id and text don't travel; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_sets
from .common import by_bytes, doc_text, in_beside, key_runs, materialize, numbered, slices, trimming, write_beside
from .components import components

#: Fixed values of the (23,12) binary Golay code: its generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


def _syndrome(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the values of each of three bytes, and the error (of at most 3 bits) that each syndrome stands for."""
    by_byte = np.array([[_syndrome(v << 8 * k & 0x7FFFFF) for v in range(256)] for k in range(3)], np.int64)
    errors = np.zeros(2048, np.int64)
    single = [(1 << i, _syndrome(1 << i)) for i in range(23)]
    for i, (e, s) in enumerate(single):
        errors[s] = e
        for j, (f, t) in enumerate(single[:i]):
            errors[s ^ t] = e | f
            for g, u in single[:j]:
                errors[s ^ t ^ u] = e | f | g
    return by_byte, errors


BY_BYTE, ERRORS = _tables()


def decode(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit value."""
    s = BY_BYTE[0][v & 255] ^ BY_BYTE[1][v >> 8 & 255] ^ BY_BYTE[2][v >> 16 & 255]
    return (v ^ ERRORS[s]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (place in prints) and keys, distinct for each print."""
    at, near = [], []
    for start, size in SEGMENTS:
        v = (prints >> np.uint64(start) & np.uint64((1 << size) - 1)).astype(np.int64)
        at.append(decode(v))
        near.append(np.stack([decode(v ^ (1 << i)) for i in range(size)], 1))
    rows, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        all_keys = np.concatenate([(at[i] << 12 | at[j])[:, None], near[i] << 12 | at[j][:, None], at[i][:, None] << 12 | near[j]], 1)
        all_keys = np.sort(all_keys | p << 24, axis=1)
        fresh = np.ones(all_keys.shape, bool)
        fresh[:, 1:] = all_keys[:, 1:] != all_keys[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append(all_keys[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(hashes: np.ndarray) -> int:
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for long texts
        count += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def print_of(shingle: int = 4):
    """An Arrow function: the fingerprint of each text (as bytes), as a signed long."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in trimming(batches):
            out = np.zeros(len(texts), np.uint64)
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for a, b in by_bytes(sizes, 8 << 20):
                out[a:b] = np.fromiter((fingerprint(shingle_sets.hashes(x, shingle)) for x in texts.slice(a, b - a).to_pylist()), np.uint64, b - a)
            yield pa.array(out.view(np.int64))

    return F.arrow_udf(run, "bigint")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and print (the fingerprint as a signed long)."""
    return docs.select("doc_id", print_of(shingle)(F.col(f"`{text}`").cast("binary")).alias("print"))


def forest(prints: np.ndarray, most: int = 4) -> list[tuple[int, int]]:
    """Edges that connect just those prints that links connect. Each print once reached is compared no more as a target."""
    out, left = [], prints
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            new = []
            for x in front:
                near = np.bitwise_count(left ^ x) <= most
                if near.any():
                    new.append(left[near])
                    out += [(int(x), int(y)) for y in left[near]]
                    left = left[~near]
                    if not len(left):
                        break
            front = np.concatenate(new) if new else front[:0]
    return out


def links(prints: DataFrame, most: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints: a spanning forest of the links, key by key."""
    if most > 4:
        raise ValueError("the keys find up to 4 differing bits")

    def keyed(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                own = np.asarray(batch.column(0).slice(k, 20_000)).view(np.uint64)
                rows, keys = fuzzy_keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(own[rows].view(np.int64))], names=["key", "print"])

    def verified(batches):
        for batch in key_runs(batches):
            keys, own = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            two = starts[sizes == 2]
            two = two[np.bitwise_count(own[two] ^ own[two + 1]) <= most]
            a, b = own[two].tolist(), own[two + 1].tolist()
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                for x, y in forest(own[s : s + n], most):
                    a.append(x)
                    b.append(y)
            if a:
                a, b = np.array(a, np.uint64).view(np.int64), np.array(b, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    keys = prints.select("print").distinct().mapInArrow(keyed, "key int, print long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(verified, "a long, b long").distinct()


def grouped(own: DataFrame, most: int = 4) -> DataFrame:
    """own (doc_id, print) -> print, root (the component's name) and first (the print's smallest id)."""
    first = own.groupBy("print").agg(F.min("doc_id").alias("first"))
    nodes = components(links(own, most))
    return first.join(nodes, F.col("print") == F.col("node"), "left").select("print", F.coalesce("root", "print").alias("root"), "first")


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """doc_id, print and component_id (the smallest id that links reach) for each row of docs."""
    own = materialize(fingerprints(docs, text, shingle), "prints")
    roots = materialize(grouped(own, most), "roots")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(roots.join(least, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def sketches(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """doc_id, _row and print of each row of numbered docs, and name, keys and size (in bytes) of its shingle set (see `shingle_sets`)."""

    def run(batches):
        for batch in slices(batches, 1 << 20):
            prints, sets = [], []
            for body in batch.column(2).to_pylist():
                own = shingle_sets.hashes(body, shingle)
                prints.append(fingerprint(own))
                sets.append(np.unique(own))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array([shingle_sets.set_name(x) for x in sets], pa.int64())]
            columns += [pa.array([shingle_sets.band_keys(x) for x in sets], pa.list_(pa.int64())), pa.array([4 * len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "print", "name", "keys", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_text(docs, "_row", text=text).mapInArrow(run, f"doc_id {kind}, _row long, print long, name long, keys array<long>, size long")


def keep_one(docs: DataFrame, text: str = "text", shingle: int = 5, most: int = 4, least: float = 0.8) -> DataFrame:
    """docs with one row of each group: the one of the smallest id (no id comes first), then of the lowest row number.

    Texts link if their fingerprints differ in at most `most` bits, by the Golay keys, or if their sets of shingles have a
    similarity of at least `least` (`shingle_sets`): four bits of 64 reach few of the pairs near 0.8, whose fingerprints
    differ in ten bits on average. Rows meet the verdict by their numbers; texts are read once more but not shuffled.
    """
    docs = numbered(docs)
    own = materialize(sketches(docs, text, shingle), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "_row"))
    pairs = materialize(own.groupBy("name", "print").agg(first.alias("first")), "names")
    by_print = materialize(links(pairs, most), "print-links")
    node = lambda c: F.xxhash64(F.lit("print"), c)  # noqa: E731  prints and names are nodes of one graph
    shared = pairs.groupBy("print").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("print")
    needed = by_print.select(F.col("a").alias("print")).union(by_print.select("b")).union(shared).distinct()
    edges = pairs.join(needed, "print", "left_semi").select(F.col("name").alias("a"), node(F.col("print")).alias("b"))
    edges = edges.union(by_print.select(node(F.col("a")), node(F.col("b")))).union(shingle_sets.links(own, docs, text, shingle, least))
    nodes = components(edges)
    names = pairs.groupBy("name").agg(F.min("first").alias("first"))
    grouped = names.join(nodes, F.col("name") == F.col("node"), "left").select(F.coalesce("root", "name").alias("root"), "first")
    path = write_beside(grouped.groupBy("root").agg(F.min("first").alias("first")).select("first._row"), "kept")
    return docs.where(in_beside(path)(F.col("_row"))).drop("_row")
