"""Line deduplication (operator 7): a segment-partition edit join.

A line of at least `min_chars` characters is removed where an earlier line, by (doc_id, line number), is at most
`most` edits away (0: an exact repeat); exact repeats go from `exact_chars` characters on, `min_chars` if it is not
given. The least `min_chars` is most + 1, a character for each segment; the query and the pipeline take it, and 1 for
`exact_chars`. Lines are cut into most + 1 even segments; two lines within `most` edits have a
segment of one as a substring of the other, at nearly the same place. Each distinct line leaves its segments, keyed by
(length, segment number, content), and the substrings that lines of its own or a slightly smaller length could have as a
segment, at the places that the multi-match rule leaves. Keys meet in a stream sorted by key. A line's id holds, beside 40
bits of hash, the parities of its characters in 23 classes: an edit changes two at most, so a line stays in a key's group
only if the parities of another one there differ in at most 2 * most classes.

No pair becomes a row. The lines of a group meet again with their texts (from a second scan, through a bitmap of fixed
size of wanted ids), are verified there by a banded bit-parallel edit distance, and leave one row each: how many links
were counted there, and whether one leads to an earlier line. A pair that shares several keys counts in the least segment
that matches, which its two texts tell, so the sums over all groups are exact. A group of more than `BLOCK` lines is dealt
into blocks, and each pair of blocks is a group of its own. A line is named by its id and 64 more bits of hash.

Occurrences of common lines meet what is known of their line by a broadcast, of `COMMON` rows at most; all others by a join.
Which lines a row loses is written beside the numbered documents, so texts are not shuffled.

Defined cases: a null text has no lines; lines shorter than both limits are never removed, nor lines of white space
alone under 32 characters (they part paragraphs); rows that share a doc_id (or
have none) are one document for the order, and of lines at the same number the one of the lower row number is earlier;
each row (numbered in a written copy) loses its own lines only; a text whose lines all go is
empty, its row stays; columns named like a result are replaced, others pass through; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Beside, doc_text, key_runs, materialize, numbered, slices, trimming, without, write_beside

RESULTS = ("n_lines", "n_exact", "n_near", "n_links", "removed")
MAP_BITS = 1 << 24
SKETCH = np.int64(0xFFFFFE)
SEEN = 100_000
#: Lines of a key up to which their parities are compared in one task, and lines of a block beyond it.
HOT, BLOCK = 8192, 1024
#: A line is common if it makes at least one in so many of all occurrences.
COMMON = 10_000
#: The low bits of a key: the number of the segment.
SEGMENT = 7
BLANK = 32
#: The limits of the query and the pipeline: near repeats from most + 1 characters on, exact ones at every length.
WHOLE = {"most": 2, "min_chars": 3, "exact_chars": 1}


def line_ids(text: str) -> tuple[list[str], list[int]]:
    """The lines of a text, and for each 40 bits of hash, 23 character parities and a zero bit, as a signed long."""
    lines = text.split("\n")
    codes = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = np.where(codes == 10, 0, np.uint32(2) << (codes % 23)).astype(np.uint32)
    starts = np.cumsum([0, *[len(x) + 1 for x in lines[:-1]]])
    parity = np.bitwise_xor.reduceat(bits, starts).tolist()
    out = [(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) & ~0xFFFFFF) | p for x, p in zip(lines, parity)]
    return lines, [v - (1 << 64) if v >> 63 else v for v in out]


def counts(line: str, least: int) -> bool:
    return len(line) >= least and (len(line) >= BLANK or not line.isspace())


def segments(length: int, most: int) -> list[tuple[int, int]]:
    """Places and sizes of most + 1 even segments of a line of this length."""
    size, more = divmod(length, most + 1)
    out, at = [], 0
    for i in range(most + 1):
        n = size + (i > most - more)
        out.append((at, n))
        at += n
    return out


def probes(length: int, most: int, least: int = 1) -> list[tuple[int, int, int, bool]]:
    """(seed, start, size, is a segment of its own) of each substring that a line of this length leaves; no line is shorter than `least`."""
    out = []
    for short in range(max(length - most, least), length + 1):
        shift = length - short
        for i, (at, n) in enumerate(segments(short, most)):
            low, high = max(0, at - i, at + shift - (most - i)), min(length - n, at + i, at + shift + (most - i))
            out += [(short * (most + 1) + i, p, n, short == length and p == at) for p in range(low, high + 1)]
    return out


def common(a: str, b: str) -> int:
    """The length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def first_match(short: str, long: str, most: int, end: int) -> int:
    """The number of the first of the `end` first segments of `short` that is a substring of `long` at a permitted place; `end` if none is."""
    shift = len(long) - len(short)
    for i, (at, n) in enumerate(segments(len(short), most)[:end]):
        low, high = max(0, at - i, at + shift - (most - i)), min(len(long) - n, at + i, at + shift + (most - i))
        if long.find(short[at : at + n], low, high + n) >= 0:
            return i
    return end


def counts_here(owner: str, other: str, first: bool, segment: int, most: int) -> bool:
    """Whether the pair counts in this group: its least segment is the owner's `segment`. Of lines of one length the first
    goes before the other as owner."""
    if len(owner) > len(other):
        return False
    if first_match(owner, other, most, segment + 1) != segment:
        return False
    return len(owner) < len(other) or first_match(other, owner, most, segment + (not first)) == segment + (not first)


def within(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most `most`: bit-parallel over the 2 * most + 1 diagonals of the band."""
    if abs(len(a) - len(b)) > most:
        return None
    if a == b:
        return 0
    head = common(a, b)
    a, b = a[head:], b[head:]
    tail = common(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    full = (1 << 2 * most + 1) - 1
    reach = [0] * (most + 1)  # reach[e], bit k: with e edits, b read so far against k - most more characters of a
    reach[0] = 1 << most
    for e in range(1, most + 1):
        reach[e] = reach[e - 1] | reach[e - 1] << 1 & full
    for j, c in enumerate(b):
        match = valid = 0
        for k in range(2 * most + 1):
            i = j + k - most
            if 0 <= i < len(a) and a[i] == c:
                match |= 1 << k
            if 0 <= i + 1 <= len(a):
                valid |= 1 << k
        new = [reach[0] & match & valid]
        for e in range(1, most + 1):
            # take c as equal, as a substitution, as an insertion (one diagonal back), or drop a character of a after it
            new.append((reach[e] & match | reach[e - 1] | reach[e - 1] >> 1 | new[e - 1] << 1) & full & valid)
        reach = new
        if not reach[most]:
            return None
    goal = 1 << len(a) - len(b) + most
    return next((e for e in range(most + 1) if reach[e] & goal), None)


def occurrences(docs: DataFrame, least: int, text: str) -> DataFrame:
    """id, check (64 more bits of hash), doc_id, row and line_no of each line of at least `least` characters."""

    def run(batches):
        for batch in slices(batches, 1 << 20):
            rows = []
            for doc_id, row, body in zip(*[c.to_pylist() for c in batch.columns]):
                for n, (line, i) in enumerate(zip(*line_ids(body.decode("utf-8")))) if body else ():
                    if counts(line, least):
                        rows.append((i, check_of(line), doc_id, row, n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), kind_of(batch), pa.int64(), pa.int32()))], names=["id", "check", "doc_id", "row", "line_no"])

    kind_of = lambda batch: batch.schema.field(0).type
    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_text(docs, "_row", text=text).mapInArrow(run, f"id long, check long, doc_id {kind}, row long, line_no int")


def candidates(docs: DataFrame, min_chars: int, most: int, text: str) -> DataFrame:
    """key and id (its low bit: the key is of a segment of the line itself) of each line that fits another of the key by parities."""

    def keyed(batches):
        seen: set[int] = set()
        plans: dict[int, list] = {}
        digest = xxhash.xxh64_intdigest
        for batch in slices(batches, 1 << 19):
            keys, ids = [], []
            for body in batch.column(1).to_pylist():
                for line, i in zip(*line_ids(body.decode("utf-8"))) if body else ():
                    if i in seen or not counts(line, min_chars):
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(i)
                    wide = line.encode("utf-32-le", "surrogatepass")
                    plan = plans.get(len(line))
                    if plan is None:
                        if len(plans) >= 4096:
                            plans.clear()
                        plan = plans[len(line)] = [(seed, 4 * p, 4 * (p + n), own) for seed, p, n, own in probes(len(line), most, min_chars)]
                    for seed, p, q, own in plan:
                        keys.append(digest(wide[p:q], seed) & ~SEGMENT | seed % (most + 1))
                        ids.append(i | own)
                if len(keys) > 100_000:
                    yield key_batch(keys, ids)
                    keys, ids = [], []
            if keys:
                yield key_batch(keys, ids)

    def key_batch(keys, ids):
        return pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(ids, np.int64))], names=["key", "id"])

    def matched(batches):
        hot = np.int64(0)
        for batch in key_runs(batches, most=HOT):
            keys, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            own = np.add.reduceat(ids & 1, starts)
            stays = np.zeros(len(ids), bool)
            useful = (sizes > 1) & (own > 0)
            two = starts[useful & (sizes == 2)]
            x, y = ids[two] & ~np.int64(1), ids[two + 1] & ~np.int64(1)
            fits = (x != y) & (np.bitwise_count((x ^ y) & SKETCH) <= 2 * most)
            stays[two[fits]] = stays[two[fits] + 1] = True
            more = (sizes > 2) & (own > 0) | (sizes > HOT) | (keys[starts] == hot)
            for s, n in zip(starts[more].tolist(), sizes[more].tolist()):
                if n > HOT or keys[s] == hot:  # all stay, and meet block by block
                    hot = keys[s]
                    stays[s : s + n] = True
                    continue
                group = ids[s : s + n]
                index, probe = np.unique(group[(group & 1) == 1] & ~np.int64(1)), np.unique(group & ~np.int64(1))
                keep = np.zeros(len(probe), bool)
                for k in range(0, len(index), step := max(1, (1 << 20) // len(probe))):  # blocks of bounded size
                    part = index[k : k + step]
                    fit = (np.bitwise_count((part[:, None] ^ probe[None, :]) & SKETCH) <= 2 * most) & (part[:, None] != probe[None, :])
                    keep |= fit.any(0)
                    keep[np.searchsorted(probe, part[fit.any(1)])] = True
                stays[s : s + n] = keep[np.searchsorted(probe, group & ~np.int64(1))]
            if stays.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[stays]), pa.array(ids[stays])], names=["key", "id"])

    rows = doc_text(docs, text=text).mapInArrow(keyed, "key long, id long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(matched, "key long, id long").distinct()


def wanted_map(ids: DataFrame) -> np.ndarray:
    """A bitmap of MAP_BITS bits of the ids; at most MAP_BITS / 32 rows reach the driver."""
    place = F.shiftright(F.col("id"), 24).bitwiseAND(F.lit(MAP_BITS - 1))
    places = ids.select(place.alias("p")).distinct()
    words = places.groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("bits"))
    out = np.zeros(MAP_BITS // 32, np.uint32)
    for r in words.toLocalIterator():
        out[r["w"]] = r["bits"]
    return out


def wanted_lines(docs: DataFrame, ids: DataFrame, min_chars: int, text: str) -> DataFrame:
    """id, check, line and first (has_id, doc_id, line_no, row) of the distinct lines whose id is wanted; rows come from numbered docs."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted_map(ids))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def fetch(batches):
        bits = sent.value
        best: dict[tuple[int, int], tuple] = {}
        size, doc_kind = 0, None

        def out():
            rows = [(i, check, line, *place) for (i, check), (place, line) in best.items()]
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), doc_kind, pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["id", "check", "line", "has_id", "doc_id", "line_no", "row"])

        for batch in slices(batches, 1 << 20):
            doc_kind = batch.schema.field(0).type
            for doc_id, row, body in zip(*[c.to_pylist() for c in batch.columns]):
                for n, (line, i) in enumerate(zip(*line_ids(body.decode("utf-8")))) if body else ():
                    p = i >> 24 & MAP_BITS - 1
                    if bits[p >> 5] >> (p & 31) & 1 and counts(line, min_chars):
                        name, place = (i, check_of(line)), (doc_id is not None, doc_id, n, row)
                        held = best.get(name)
                        if held is None:
                            size += len(line)
                        if held is None or before(place, held[0]):
                            best[name] = (place, line)
                if size > 4 << 20 or len(best) > 50_000:
                    yield out()
                    best.clear()
                    size = 0
        if best:
            yield out()

    rows = doc_text(docs, "_row", text=text).mapInArrow(fetch, f"id long, check long, line string, has_id boolean, doc_id {kind}, line_no int, row long")
    wanted = rows.join(ids, "id", "left_semi")
    return wanted.groupBy("id", "check").agg(F.min(F.struct("has_id", "doc_id", "line_no", "row")).alias("first"), F.first("line").alias("line"))


def check_of(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"), 7) - (1 << 63)


def before(a: tuple, b: tuple) -> bool:
    """Whether a place is before another one; a document without id is before those with one."""
    return (a[:1] + a[2:] if a[1] is None else a) < (b[:1] + b[2:] if b[1] is None else b) if a[0] == b[0] else a[0] < b[0]


def line_links(docs: DataFrame, most: int = 2, min_chars: int = 32, text: str = "text") -> DataFrame:
    """id, check, near (an earlier line is within `most` edits) and links (how many distinct lines are) of each distinct line
    of numbered docs that has a link."""
    if not 0 < most < min(min_chars, SEGMENT + 1):
        raise ValueError("a line needs more characters than edits")
    members = materialize(candidates(docs, min_chars, most, text).withColumn("own", F.col("id").bitwiseAND(F.lit(1)) == 1).withColumn("id", F.col("id").bitwiseAND(F.lit(-2))), "members")
    lines = materialize(wanted_lines(docs, members.select("id").distinct(), min_chars, text), "lines")
    large = members.groupBy("key").count().where(F.col("count") > HOT).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(large, "key", "left").withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(0))
    small = dealt.where("blocks is null").select("key", "id", "own", "block", F.lit(False).alias("cross"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    split = dealt.where("blocks is not null").select("key", "id", "own", "block", other)
    name = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).bitwiseAND(F.lit(~SEGMENT)).bitwiseOR(F.col("key").bitwiseAND(F.lit(SEGMENT)))
    groups = small.unionByName(split.select(name.alias("key"), "id", "own", "block", (F.col("block") != F.col("other")).alias("cross")))

    def verified(batches):
        for batch in key_runs(batches):
            keys = np.asarray(batch.column(0))
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            out: list[tuple] = []
            for s, n in zip(starts.tolist(), sizes.tolist()):
                if n > 1:
                    out += verified_group(batch.slice(s, n), int(keys[s]) & SEGMENT, most)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=["id", "check", "near", "links"])

    rows = groups.join(lines, "id").select("key", "id", "own", "block", "cross", "check", "line", "first")
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(verified, "id long, check long, near boolean, links long")
    return found.groupBy("id", "check").agg(F.max("near").alias("near"), F.sum("links").alias("links"))


def verified_group(rows: pa.RecordBatch, segment: int, most: int) -> list[tuple]:
    """(id, check, near, links) of the lines of one key that have links counted there."""
    lines: dict[tuple[int, int], list] = {}
    for i, own, block, cross, check, line, first in zip(*[rows.column(k).to_pylist() for k in range(1, 8)]):
        held = lines.setdefault((i, check), [line, (first["has_id"], first["doc_id"], first["line_no"], first["row"]), block, cross, False])
        held[4] |= own
    names = list(lines)
    ids = np.array([i for i, _ in names], np.int64)
    links, near = [0] * len(names), [False] * len(names)
    for x, name in enumerate(names):
        owner, place, block, cross, own = lines[name]
        if not own:
            continue
        for y in np.flatnonzero(np.bitwise_count((ids ^ ids[x]) & SKETCH) <= 2 * most).tolist():
            line, other, its_block, _, _ = lines[names[y]]
            if x == y or (cross and block == its_block) or not counts_here(owner, line, name < names[y], segment, most) or within(owner, line, most) is None:
                continue
            links[x] += 1
            links[y] += 1
            near[y if before(place, other) else x] = True
    return [(*name, near[k], links[k]) for k, name in enumerate(names) if links[k]]


def repeats(docs: DataFrame, most: int = 2, min_chars: int = 32, text: str = "text", exact_chars: int | None = None) -> DataFrame:
    """_row, n_exact, n_near, n_links and removed (line numbers) of each row of numbered docs with a line that repeats or links."""
    seen = materialize(occurrences(docs, min(min_chars, exact_chars or min_chars), text), "occurrences")
    links = materialize(line_links(docs, most, min_chars, text), "links")
    place = F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "line_no", "row")
    exact = seen.groupBy("id", "check").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    marks = exact.join(links, ["id", "check"], "left").where("n > 1 or links is not null").select("id", "check", "n", "first", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("links", F.lit(0)).alias("links"))
    marks, total = materialize(marks, "marks"), seen.count()
    common = marks.where(F.col("n") * COMMON >= total)  # COMMON lines at most, whose occurrences would be hot keys
    rest = seen.join(F.broadcast(common.select("id", "check")), ["id", "check"], "left_anti").join(marks.where(F.col("n") * COMMON < total), ["id", "check"])
    hits = seen.join(F.broadcast(common), ["id", "check"]).unionByName(rest).withColumn("again", place != F.col("first"))
    return hits.groupBy(F.col("row").alias("_row")).agg(
        F.count_if("again").alias("n_exact"),
        F.count_if(F.expr("near and not again")).alias("n_near"),
        F.sum("links").alias("n_links"),
        F.array_sort(F.collect_set(F.when(F.col("again") | F.col("near"), F.col("line_no")))).alias("removed"),
    )


KEPT = "struct<text: string, n_lines: int, n_exact: bigint, n_near: bigint, n_links: bigint, removed: array<int>>"


def kept_lines(path: str):
    """An Arrow function: the text without the lines that `repeats`, written at `path`, names for its row, and the row's numbers."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        beside = Beside(path)
        for bodies, rows in trimming(batches):
            numbers = np.zeros((len(rows), 4), np.int64)
            gone: list[list[int]] = [[]] * len(rows)
            for a, b, places in beside.runs(np.asarray(rows)):
                hit = np.flatnonzero(places >= 0)
                if len(hit):
                    own = beside.table.take(pa.array(places[hit]))
                    numbers[a + hit, 1:] = np.stack([np.asarray(own[c]) for c in ("n_exact", "n_near", "n_links")], 1)
                    for k, lines in zip((a + hit).tolist(), own["removed"].to_pylist()):
                        gone[k] = lines
            texts = []
            for k, body in enumerate(bodies):
                body = body.as_py()
                if body is not None:
                    lines = body.split("\n")
                    numbers[k, 0] = len(lines)
                    if gone[k]:
                        drop = set(gone[k])
                        body = "\n".join(x for n, x in enumerate(lines) if n not in drop)
                texts.append(body)
            columns = [pa.array(texts, pa.string()), pa.array(numbers[:, 0].astype(np.int32)), *[pa.array(np.ascontiguousarray(numbers[:, c])) for c in (1, 2, 3)], pa.array(gone, pa.list_(pa.int32()))]
            yield pa.StructArray.from_arrays(columns, names=["text", "n_lines", "n_exact", "n_near", "n_links", "removed"])

    return F.arrow_udf(run, KEPT)


def dedup_lines(docs: DataFrame, most: int = 2, min_chars: int = 32, text: str = "text", exact_chars: int | None = None) -> DataFrame:
    """docs with the lines that stay, and n_lines, n_exact, n_near, n_links and removed (the line numbers taken out)."""
    docs = numbered(without(docs, *[c for c in RESULTS if c != text]))
    path = write_beside(repeats(docs, most, min_chars, text, exact_chars), "removed")
    passing = [F.col(f"`{c}`") for c in docs.columns if c not in ("_row", text)]
    found = docs.select(*passing, kept_lines(path)(F.col(f"`{text}`"), F.col("_row")).alias("_kept"))
    order = [F.col("_kept.text").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != "_row"]
    return found.select(*order, *[F.col(f"_kept.{c}") for c in RESULTS])
