"""LM scoring (operator 5): Brown class-based bigrams.

P(text) is the product over its tokens (words, then one end) of P(class | class before) * P(word | class).

Counts cover the whole training side: words by partial counts in each task, then one aggregate. Every word gets its class
by exchange. The most frequent words (about four times the root of the vocabulary, `units` at most) take part in all
rounds: their bigrams, bounded by units^2 numbers, meet in one task, where words move between classes as long as the
likelihood of the class bigrams grows. Then each other word makes one move, wherever it is: the classes that stand before
and after its occurrences, counted over the whole training side, tell which class gains most by taking it. The number of
classes grows with the third root of the vocabulary. Words that never stand beside a frequent one, and unknown ones, take
the commonest class of the words with their last two bytes. The end stays a class of its own.

Emissions: a known word has (count - d) / mass of its class; what the discount d = n1 / (n1 + 2 n2) frees, d times the
class's distinct words (and half a count), is the class's chance of an unknown word. Transitions are counted over every
bigram of the training side, once all words have classes, and smoothed by the classes' own shares (`prior` counts). So
probabilities sum to one over the known words and one unknown of each class.

Class sequences: the `head` most frequent words go to the workers as a bounded table with their classes; each text is read
once and becomes a byte a token, the class, with the sums that need no transitions. Each token outside the head leaves one
row with its place, which is joined to the counts and classes of all words and comes back to its text. The sequences are
written; the transitions are counted from those of the training side, and scores follow from them. Words outside the head are rare
by construction (at most N / head training tokens each); a word frequent only in texts that are scored, not in training,
is a hot key of one side of that join, which adaptive execution splits.

Defined cases: a null text is empty and has one token, the end; a null id counts as empty text for the fold; rows with
equal ids are scored and learned from apart; columns beside doc_id and text don't travel; an empty table gives no rows;
without training documents all words are unknown and classes equally likely.
"""

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, key_runs, materialize, slices, trimming

#: The end as a token; no word holds a space.
END = b" "
ROWS = "row long, place int, word binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double, emit double, classes binary"
#: Groups of words by their last two bytes, for words without a class of their own.
ENDINGS = 512


def words_of(body: bytes | None) -> list[bytes]:
    return body.lower().split() if body else []


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def training(docs: DataFrame, text: str) -> DataFrame:
    return docs.where(~is_held_out(F.col("doc_id"))).select(F.col(f"`{text}`").cast("binary").alias("body"))


def word_counts(train: DataFrame) -> DataFrame:
    """word and n of every training token, the end included."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for body in batch.column(0).to_pylist():
                counts.update(words_of(body))
                counts[END] += 1
            if len(counts) > 400_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return train.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def unit_bigrams(train: DataFrame, given: dict[bytes, int]) -> DataFrame:
    """code (unit * units + next unit) and n of neighbours that are both units; the end stands before each text and after it."""
    units = len(given)

    def run(batches):
        total = np.zeros(units * units, np.int64)
        for batch in slices(batches):
            line = [0]
            for body in batch.column(0).to_pylist():
                line += map(given.get, words_of(body), repeat(-1))
                line.append(0)
            at = np.array(line, np.int64)
            both = (at[:-1] >= 0) & (at[1:] >= 0)
            total += np.bincount(at[:-1][both] * units + at[1:][both], minlength=units * units)
        found = np.flatnonzero(total)
        for k in range(0, len(found), 100_000):
            part = found[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["code", "n"])

    return train.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def cluster(bigrams: DataFrame, units: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(the class of each unit, the class bigrams). The exchange runs in one task, over at most units^2 rows; units + classes^2
    numbers come to the driver."""

    def run(batches):
        counts = np.zeros(units * units)
        for batch in batches:
            counts[np.asarray(batch.column(0))] = np.asarray(batch.column(1))
        counts = counts.reshape(units, units)
        cls = exchange(counts, classes)
        one = np.zeros((units, classes))
        one[np.arange(units), cls] = 1
        pairs = (one.T @ counts @ one).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(units + classes**2, dtype=np.int32)), pa.array(np.concatenate([cls, pairs]).astype(np.int64))], names=["at", "value"])

    got = bigrams.repartition(1).mapInArrow(run, "at int, value long").toArrow()
    out = np.zeros(units + classes**2, np.int64)
    out[np.asarray(got["at"])] = np.asarray(got["value"])
    return out[:units], out[units:].reshape(classes, classes)


def neighbours(train: DataFrame, given: dict[bytes, int], cls: np.ndarray, classes: int) -> DataFrame:
    """word, code and n of every word that is no unit: code is the class of a unit after it, or `classes` plus the class of one before it."""
    of = {w: int(cls[u]) for w, u in given.items()}

    def run(batches):
        counts: Counter = Counter()

        def out():
            keys = list(counts)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "code", "n"])

        for batch in slices(batches):
            for body in batch.column(0).to_pylist():
                words = words_of(body)
                own = list(map(of.get, words, repeat(-1)))
                at = np.array([0, *own, 0])
                rare = at[1:-1] < 0
                after, before = at[2:], at[:-2]
                counts.update(zip([words[i] for i in np.flatnonzero(rare & (after >= 0)).tolist()], after[rare & (after >= 0)].tolist()))
                counts.update(zip([words[i] for i in np.flatnonzero(rare & (before >= 0)).tolist()], (before[rare & (before >= 0)] + classes).tolist()))
            if len(counts) > 300_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return train.mapInArrow(run, "word binary, code int, n long").repartition("word").groupBy("word", "code").agg(F.sum("n").alias("n"))


def weight(x):
    """x log x, with 0 for 0: the likelihood of class bigrams is a sum of these."""
    return x * np.log(np.maximum(x, 1))


def gains(codes: np.ndarray, counts: np.ndarray, starts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """What each class gains in likelihood by taking each word; a word's neighbours are the rows from its start on."""
    classes = len(pairs)
    cells = np.concatenate([pairs.T, pairs])  # cells[code, c]: bigrams of class c with that neighbour
    held = weight(cells)
    grown = (weight(cells + 1) - held)[codes]
    more = counts > 1
    grown[more] = weight(cells[codes[more]] + counts[more, None]) - held[codes[more]]
    out = np.add.reduceat(grown, starts, axis=0)
    for side, mass in ((codes < classes, pairs.sum(1)), (codes >= classes, pairs.sum(0))):
        number = np.add.reduceat(np.where(side, counts, 0), starts)[:, None]
        out -= weight(mass + number) - weight(mass)
    out[:, 0] = -np.inf
    return out


def assign(found: DataFrame, pairs: np.ndarray) -> DataFrame:
    """word and cls, the class that gains most by taking it; and rows without a word: cls, code and n, the bigrams so added."""
    classes = len(pairs)

    def run(batches):
        total = np.zeros((classes, 2 * classes), np.int64)
        for batch in key_runs(batches, "word"):
            words = batch.column(0)
            codes, counts = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            number = np.asarray(words.dictionary_encode().indices)
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            ends = np.append(starts[1:], len(codes))
            k = 0
            while k < len(starts):  # words of about 16,384 rows together; a word has 2 * classes at most
                last = max(k + 1, int(np.searchsorted(ends, starts[k] + 16_384, "right")))
                own, low, high = starts[k:last], starts[k], ends[last - 1]
                cls = np.argmax(gains(codes[low:high], counts[low:high].astype(float), own - low, pairs), 1)
                np.add.at(total, (np.repeat(cls, ends[k:last] - own), codes[low:high]), counts[low:high])
                n, k = len(own), last
                yield pa.RecordBatch.from_arrays([words.take(pa.array(own)), pa.array(cls.astype(np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=["word", "cls", "code", "n"])
        c, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.binary()), pa.array(c.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(total[c, code])], names=["word", "cls", "code", "n"])

    return found.sortWithinPartitions("word", "code").mapInArrow(run, "word binary, cls int, code int, n long")


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """A class for each unit; unit 0 (the end) stays in class 0 alone. Units move to the class that adds most to the
    likelihood of the class bigrams, the sum of n log n over class pairs less that over classes on both sides."""
    units = len(bigrams)
    n = bigrams.astype(np.float64)
    share = n.sum(1) + n.sum(0)
    order = [int(u) for u in np.argsort(-share, kind="stable") if u]
    cls = np.zeros(units, np.int64)
    for k, u in enumerate(order):
        cls[u] = 1 + k % (classes - 1)
    one = np.zeros((units, classes))
    one[np.arange(units), cls] = 1
    to, come, pairs = n @ one, n.T @ one, one.T @ n @ one  # to[u, c]: u before class c; come[u, c]: class c before u
    left, right = pairs.sum(1), pairs.sum(0)
    f = weight
    size = np.bincount(cls, minlength=classes)
    for _ in range(rounds):
        moved = 0
        for u in order:
            a = cls[u]
            if not share[u] or size[a] == 1:
                continue
            own = n[u, u]
            before, after = to[u].copy(), come[u].copy()
            before[a] -= own
            after[a] -= own
            out_all, in_all = n[u].sum(), n[:, u].sum()
            pairs[a] -= to[u]
            pairs[:, a] -= come[u]
            pairs[a, a] += own
            left[a] -= out_all
            right[a] -= in_all
            rows = f(pairs + before) - f(pairs)
            cols = f(pairs + after[:, None]) - f(pairs)
            diag = np.arange(classes)
            gain = rows.sum(1) - rows[diag, diag] + cols.sum(0) - cols[diag, diag]
            gain += f(pairs[diag, diag] + before + after + own) - f(pairs[diag, diag])
            gain -= f(left + out_all) - f(left) + f(right + in_all) - f(right)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pairs[b] += before
            pairs[:, b] += after
            pairs[b, b] += own
            left[b] += out_all
            right[b] += in_all
            if b != a:
                cls[u] = b
                size[a] -= 1
                size[b] += 1
                come[:, a] -= n[u]
                come[:, b] += n[u]
                to[:, a] -= n[:, u]
                to[:, b] += n[:, u]
                moved += 1
        if not moved:
            break
    return cls


def frequent(words: DataFrame, most: int) -> list:
    """The words of the highest counts, most frequent first: all whose count is in the bins (eighths of a power of two)
    that hold at most `most` words together. The driver gets some hundred bins, then those words, however many there are."""
    binned = words.withColumn("bin", F.floor(F.log2("n") * 8).cast("int"))
    total, least = 0, None
    for r in sorted(binned.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        total += r["count"]
        if total > most:
            break
        least = r["bin"]
    rows = [] if least is None else binned.where(F.col("bin") >= least).drop("bin").collect()
    return sorted(rows, key=lambda r: (-r["n"], bytes(r["word"])))


class ClassModel:
    """What training leaves: counts and classes of all words as a table (word, n, cls), the class sequences of docs, and
    numbers of bounded size. `pairs` are the class bigrams that hold a unit, which place words; `bigrams` are all."""

    def __init__(self, docs: DataFrame, text: str = "text", units: int = 2048, head: int = 200_000, prior: float = 50.0):
        train = training(docs, text)
        counted = materialize(word_counts(train), "counts")
        s = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.expr("n = 1")).alias("n1"), F.count_if(F.expr("n = 2")).alias("n2")).first()
        self.tokens, self.distinct = s["n"] or 0, s["v"]
        self.discount = min(0.9, max(0.1, s["n1"] / max(1, s["n1"] + 2 * s["n2"])))
        self.classes = min(256, max(16, round(self.distinct ** (1 / 3))))
        words = counted.where(F.col("word") != F.lit(END))
        own = [bytes(r["word"]) for r in frequent(words, min(units, max(4 * self.classes, int(4 * self.distinct**0.5))) - 1)]
        self.given = {END: 0} | {w: 1 + i for i, w in enumerate(own)}
        self.cls, pairs = cluster(unit_bigrams(train, self.given), len(self.given), self.classes)
        moved = materialize(assign(neighbours(train, self.given, self.cls, self.classes), pairs.astype(float)), "classes")
        self.pairs = pairs.copy()
        for r in moved.where("word is null").groupBy("cls", "code").agg(F.sum("n").alias("n")).toArrow().to_pylist():
            at = (r["cls"], r["code"]) if r["code"] < self.classes else (r["code"] - self.classes, r["cls"])
            self.pairs[at] += r["n"]
        self.vocabulary, self.by_ending = self.with_classes(counted, moved.where("word is not null").select("word", "cls"))
        mass, kinds = np.zeros(self.classes), np.zeros(self.classes)
        for r in self.vocabulary.groupBy("cls").agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds")).collect():
            mass[r["cls"]], kinds[r["cls"]] = r["tokens"], r["kinds"]
        self.unknown = self.discount * kinds + 0.5
        self.log_mass = np.log10(mass + 0.5)
        top = frequent(self.vocabulary.where(F.col("word") != F.lit(END)), head)
        self.head = {END: 0} | {bytes(r["word"]): 1 + i for i, r in enumerate(top)}
        counts = np.array([max(1, self.end_count()), *[r["n"] for r in top]], np.float64)
        self.head_cls = np.array([0, *[r["cls"] for r in top]], np.int64)
        self.head_base = np.log10((counts + (self.tokens > 0)) / self.base_mass)
        self.head_emit = np.log10(counts - self.discount) - self.log_mass[self.head_cls]
        self.head_emit[0] = 0.0  # the end is its class's only member
        if not self.tokens:
            self.head_base[0] = -math.log10(self.base_mass)
        self.docs, self.text, self.sequences = docs, text, sequences(docs, self, text)
        self.bigrams = class_bigrams(self.sequences.where("not held_out"), self.classes)
        share = (self.bigrams.sum(0) + 1) / (self.bigrams.sum() + self.classes)
        self.transitions = np.log10((self.bigrams + prior * share) / (self.bigrams.sum(1, keepdims=True) + prior))

    def with_classes(self, counted: DataFrame, moved: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """(word, n and cls of all words; the commonest class of each ending, from at most ENDINGS * classes counts)."""
        given, cls = self.given, self.cls

        def place(batches):
            for batch in batches:
                words = batch.column(0).to_pylist()
                own = np.fromiter((cls[given[w]] if w in given else -1 for w in words), np.int32, len(words))
                end = np.fromiter(map(ending, words), np.int32, len(words))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own), pa.array(end)], names=["word", "n", "unit_cls", "ending"])

        placed = counted.select("word", "n").mapInArrow(place, "word binary, n long, unit_cls int, ending int").join(moved, "word", "left")
        found = F.when(F.col("unit_cls") >= 0, F.col("unit_cls")).otherwise(F.col("cls"))
        known = materialize(placed.select("word", "n", "ending", found.alias("cls")), "placed")
        counts = np.zeros((ENDINGS, self.classes))
        for r in known.where("cls is not null").groupBy("ending", "cls").count().toArrow().to_pylist():
            counts[r["ending"], r["cls"]] = r["count"]
        counts[:, 0] = 0
        common = np.where(counts.sum(1) > 0, counts.argmax(1), max(1, counts.sum(0).argmax())).astype(np.int64)
        table = F.array(*[F.lit(int(c)) for c in common])
        return known.select("word", "n", F.coalesce("cls", F.element_at(table, F.col("ending") + 1)).cast("int").alias("cls")), common

    @property
    def base_mass(self) -> float:
        return self.tokens + self.distinct + 1

    def end_count(self) -> int:
        r = self.vocabulary.where(F.col("word") == F.lit(END)).first()
        return r["n"] if r else 0


def sequences(docs: DataFrame, model: ClassModel, text: str = "text") -> DataFrame:
    """doc_id (as long), held_out, n_tokens, n_known, base_score, emit (the sum over tokens of log10 P(word | class)) and
    classes (a byte a token, the end last) of each row of docs; written."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast({k: getattr(model, k) for k in ("head", "head_cls", "head_base", "head_emit")} | {"trained": model.tokens > 0})
    small = context.broadcast({k: getattr(model, k) for k in ("log_mass", "unknown", "by_ending", "discount", "base_mass")})

    def run(batches):
        m = sent.value
        head, head_cls = m["head"].get, m["head_cls"].astype(np.uint8)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        for batch in slices(batches, 2 << 20):
            out = []
            for doc_id, held_out, body in zip(*[c.to_pylist() for c in batch.columns]):
                words = words_of(body)
                words.append(END)
                at = np.fromiter(map(head, words, repeat(-1)), np.int64, len(words))
                known = at[at >= 0]
                out.append((row, -1, END + row.to_bytes(8, "big"), doc_id, held_out, len(words), int(len(known)) if m["trained"] else 0, float(m["head_base"][known].sum()), float(m["head_emit"][known].sum()), head_cls[at].tobytes()))
                out += [(row, i, words[i], None, None, 0, 0, 0.0, 0.0, None) for i in np.flatnonzero(at < 0).tolist()]
                row += 1
                if len(out) > 100_000:
                    yield batch_of(out, kinds)
                    out = []
            if out:
                yield batch_of(out, kinds)

    def batch_of(out, kinds):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in ROWS.split(", ")])

    def total(batches):
        m = small.value
        for batch in key_runs(batches, "row"):
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            row, place, n, cls = (np.asarray(column(c)) for c in ("row", "place", "n", "cls"))
            rare, seen = place >= 0, n > 0
            cls = cls.astype(np.int64)
            lost = np.flatnonzero(rare & (cls < 0))  # words that training does not know
            cls[lost] = m["by_ending"][[ending(w) for w in column("word").take(pa.array(lost)).to_pylist()]] if len(lost) else 0
            emit = np.where(seen, np.log10(np.maximum(n - m["discount"], 1e-9)), np.log10(m["unknown"][cls])) - m["log_mass"][cls]
            first = np.concatenate([[True], row[1:] != row[:-1]])
            starts = np.flatnonzero(first)
            flat, ends = flattened(column("classes").take(pa.array(starts)))
            flat = flat.copy()
            flat[(np.append(0, ends[:-1])[np.cumsum(first) - 1] + place)[rare]] = cls[rare]
            line = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat)])
            sums = lambda own, x: pa.array(np.asarray(column(own))[starts] + np.add.reduceat(np.where(rare, x, 0), starts))  # noqa: E731, B023
            columns = [column(c).take(pa.array(starts)) for c in ("doc_id", "held_out", "n_tokens")]
            columns += [sums("n_known", seen.astype(np.int64)), sums("base", np.log10((n + 1) / m["base_mass"])), sums("emit", emit), line]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emit", "classes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("body")).mapInArrow(run, ROWS)
    joined = rows.join(model.vocabulary, "word", "left").select("row", "place", F.when(F.col("n").isNull(), F.col("word")).alias("word"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", F.lit(-1)).alias("cls"), "doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "classes")
    done = joined.repartition("row").sortWithinPartitions("row", "place").mapInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emit double, classes binary")
    return materialize(done, "sequences")


def flattened(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of class sequences, one after the other, and where each ends."""
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    return np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def class_bigrams(held: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each other in all the sequences; classes^2 numbers come to the driver. Every sequence ends
    with the end, class 0, which so stands before the next one as well."""

    def run(batches):
        total = np.zeros(classes**2, np.int64)
        for batch in trimming(batches):
            if batch.num_rows:
                flat, _ = flattened(batch.column(0))
                total += np.bincount(np.append(0, flat[:-1]).astype(np.int64) * classes + flat, minlength=classes**2)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], names=["code", "n"])

    got = held.select("classes").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes**2, np.int64)
    out[np.asarray(got["code"])] = np.asarray(got["n"])
    return out.reshape(classes, classes)


def score(docs: DataFrame, model: ClassModel, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id as long)."""
    held = model.sequences if docs is model.docs and text == model.text else sequences(docs, model, text)
    sent = docs.sparkSession.sparkContext.broadcast(model.transitions)

    def run(batches):
        for batch in trimming(batches):
            if batch.num_rows:
                flat, ends = flattened(batch.column(6))
                moves = sent.value[np.append(0, flat[:-1]), flat]
                total = np.asarray(batch.column(5)) + np.add.reduceat(moves, np.append(0, ends[:-1]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(total)], names=[*batch.schema.names[:5], "score"])

    done = held.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Per fold: tokens, and the perplexity of the model and of the base."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
