"""Links by the similarity of word shingles, for operator 10: min-hash keys find candidates, whole shingle sets decide.

A text is the set of its windows of `shingle` words (lower case, as 64-bit hashes); texts of fewer words are one window.
Two texts link if their sets' Jaccard similarity is at least `least`. Each distinct set has 25 keys, each of 5 min-hashes;
two sets of similarity s share a key with probability 1 - (1 - s^5)^25, which is 0.99995 at 0.8 and grows with s. Sets
that share a key are compared item by item, so nothing below `least` links. A key leaves a spanning forest of its links:
no more edges than members, however many pairs link.

Distinct sets, not documents, are keyed, so a group of copies is one row there. Only sets that share a key are made again
from their texts, one row a set, and travel with their items (32 bits of each hash), once for each different group. A group of more than `BLOCK` sets, or of
more than `BLOCK_BYTES` of items, is dealt into blocks; each pair of blocks leaves a forest of its own, so no link is lost.

Defined cases: null and empty texts have the empty set, which has no keys: they are one set anyway.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_beside, key_runs, materialize, slices, write_beside

BANDS, ROWS = 25, 5
BLOCK, BLOCK_BYTES = 2048, 32 << 20
HOT = 1 << 18
_RANDOM = np.random.default_rng(42)
TIMES, PLUS = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(2))
MIX = _RANDOM.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def hashes(body: bytes | None, size: int) -> np.ndarray:
    """The XXH64 hashes (seed 42) of the windows of `size` words, repeats included; fewer words are one window, no words none."""
    words = body.lower().split() if body else []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    del words
    last = ends[size - 1 :] - 1
    start = np.concatenate([[0], ends[: len(last) - 1]])
    out = np.empty(len(last), np.uint64)
    for k in range(0, len(last), 1 << 15):  # bounded lists for long texts
        out[k : k + (1 << 15)] = [digest(joined[a:b], 42) for a, b in zip(start[k : k + (1 << 15)].tolist(), last[k : k + (1 << 15)].tolist())]
    return out


def set_name(items: np.ndarray) -> int:
    """A signed long that names the set; the empty set is 0."""
    return xxhash.xxh64_intdigest(items.tobytes(), 7) - (1 << 63) if len(items) else 0


def band_keys(items: np.ndarray) -> np.ndarray:
    """The keys of a set; the empty set has none, it is one row anyway."""
    if not len(items):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(items), 1024):  # bounded memory for long texts
        low = np.minimum(low, (items[None, k : k + 1024] * TIMES[:, None] + PLUS[:, None]).min(1))
    return ((low.reshape(BANDS, ROWS) >> np.uint64(7)) * MIX).sum(1, dtype=np.uint64).view(np.int64)


def packed(items: np.ndarray) -> bytes:
    """The sorted distinct low 32 bits of the hashes."""
    return np.unique(items.astype(np.uint32)).tobytes()


def forest(names: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that connect just those sets that links connect. Each set once reached is compared no more as a target."""
    sizes = np.array([len(s) for s in sets])
    out, left = [], np.arange(len(sets))
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            items = np.concatenate([sets[i] for i in left])
            at = np.minimum(np.searchsorted(sets[x], items), sizes[x] - 1)
            common = np.add.reduceat(sets[x][at] == items, np.concatenate([[0], np.cumsum(sizes[left])[:-1]]), dtype=np.int64)
            near = common >= least * (sizes[x] + sizes[left] - common) - 1e-9
            out += [(int(names[x]), int(names[y])) for y in left[near]]
            front += left[near].tolist()
            left = left[~near]
    return out


def runs_of(keys: np.ndarray, hot=None) -> list[tuple[int, int]]:
    """Start and size of each run of at least two equal keys; of the key `hot` a run of one counts too."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    more = sizes > 1 if hot is None else (sizes > 1) | (keys[starts] == hot)
    return list(zip(starts[more].tolist(), sizes[more].tolist()))


def sets_of(docs: DataFrame, text: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """name and items of the sets of the numbered rows that wanted (_row) names."""

    def run(batches):
        for batch in slices(batches, 1 << 20):
            names, items = [], []
            for body in batch.column(0).to_pylist():
                own = np.unique(hashes(body, shingle))
                names.append(set_name(own))
                items.append(packed(own))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(items, pa.binary())], names=["name", "items"])

    path = write_beside(wanted, "wanted")
    rows = docs.where(in_beside(path)(F.col("_row"))).select(F.col(f"`{text}`").cast("binary").alias("body"))
    return rows.mapInArrow(run, "name long, items binary")


def links(own: DataFrame, docs: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """own (name, keys, size and _row of numbered docs) -> edges (a, b) between the names of distinct sets: a spanning forest
    of the links, group by group."""

    def shared(batches):
        hot = None
        for batch in key_runs(batches, most=HOT):
            keys, names, sizes = (np.asarray(c) for c in batch.columns)
            groups, members = [], []
            if batch.num_rows > HOT and keys[0] == keys[-1]:
                hot = keys[0]
            for s, n in runs_of(keys, hot):
                name = keys[s] if keys[s] == hot else xxhash.xxh64_intdigest(names[s : s + n].tobytes()) - (1 << 63)
                groups.append(np.full(n, name, np.int64))
                members.append(np.arange(s, s + n))
            if groups:
                at = np.concatenate(members)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(groups)), pa.array(names[at]), pa.array(sizes[at])], names=["key", "name", "size"])

    def verified(batches):
        for batch in key_runs(batches):
            keys, names, items = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
            edges = []
            for s, n in runs_of(keys):
                edges += forest(names[s : s + n], [np.frombuffer(x, np.uint32) for x in items.slice(s, n).to_pylist()], least)
            if edges:
                a, b = np.array(edges, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    keyed = own.groupBy("name").agg(F.first("keys").alias("keys"), F.first("size").alias("size"), F.min("_row").alias("_row"))
    keyed = materialize(keyed, "keyed")
    keys = keyed.select(F.explode("keys").alias("key"), "name", "size")
    groups = materialize(keys.repartition("key").sortWithinPartitions("key", "name").mapInArrow(shared, "key long, name long, size long").distinct(), "groups")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    large = groups.groupBy("key").agg(blocks.alias("blocks")).where("blocks > 1")
    dealt = groups.join(large, "key", "left")
    block = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    split = dealt.where("blocks is not null").select("key", "name", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("block <> other")
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    members = dealt.where("blocks is null").select("key", "name").unionByName(split.select(pair.alias("key"), "name"))
    sets = sets_of(docs, text, shingle, keyed.join(groups.select("name").distinct(), "name", "left_semi").select("_row"))
    rows = members.join(sets, "name").select("key", "name", "items")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(verified, "a long, b long").distinct()
