"""Packing (operator 4): harmonic packing of documents into sequences of a fixed number of tokens.

Lengths fall into reciprocal-capacity classes: a piece of length r is of class k = capacity // r, and a bin of class k is
full at exactly k pieces. A document is cut into whole sequences and a rest; the rest is one piece where k of its length
leave at most `slack` tokens of a bin free, else the largest length of the next class is cut off and what remains is
looked at again. Each worker fills the bins of every class by itself while it streams over its partition, so nothing is
shuffled and no state is shared; it holds at most k - 1 pieces a class. At the end of a partition the pieces of the
unfinished bins (bounded by the number of classes, not by the data) go first-fit, longest first, into shared bins.

A sequence id is the partition's number times 2^33 plus a counter; a task that runs again on the same partition makes the
same sequences.

Defined cases: a null or empty text is the closing id alone; ids may be null or repeated, each row is a document of its
own; other columns of the input don't travel; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder
from .common import doc_text, slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def rest_pieces(rest: int, capacity: int, slack: int) -> list[int]:
    """The lengths that a rest of fewer than `capacity` ids is cut into."""
    out = []
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack:
            return [*out, rest]
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Harmonic:
    """Takes pieces (any tuple, with its length) and gives back full bins."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, {}

    def add(self, piece, length: int):
        k = self.capacity // length
        group = self.open.setdefault(k, [])
        group.append((piece, length))
        if len(group) == k:
            del self.open[k]
            return group
        return None

    def rest(self):
        """Bins of what is left: longest first, each piece into the first bin with room."""
        left = sorted((x for group in self.open.values() for x in group), key=lambda x: -x[1])
        self.open = {}
        bins, room = [], np.zeros(0, np.int64)
        for piece, length in left:
            fits = np.flatnonzero(room >= length)
            if len(fits):
                bins[fits[0]].append((piece, length))
                room[fits[0]] -= length
            else:
                bins.append([(piece, length)])
                room = np.append(room, self.capacity - length)
        return bins


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = 1024, slack: int = 16, end_id: int = 0) -> DataFrame:
    """One row for each piece, in `SCHEMA`: ids are little-endian unsigned 32-bit; doc_tokens counts the closing id."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = encoder(tokenizer).ids
        part, made, rows, held = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33, 0, [], 0
        bins = Harmonic(capacity)

        def emit(group):
            nonlocal made, held
            at = 0
            for (doc_id, start, ids, total), length in group:
                rows.append((doc_id, start, length, ids, total, part + made, at))
                at += length
                held += len(ids)
            made += 1

        def flush():
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            held = 0
            return out

        for batch in slices(batches):
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (ids_of(body.decode("utf-8")) if body else b"") + end
                total, start = len(ids) // 4, 0
                for length in (*[capacity] * (total // capacity), *rest_pieces(total % capacity, capacity, slack)):
                    if group := bins.add((doc_id, start, ids[4 * start : 4 * (start + length)], total), length):
                        emit(group)
                    start += length
                if held >= 4 << 20:
                    yield flush()
        for group in bins.rest():
            emit(group)
        if rows:
            yield flush()

    return doc_text(docs, text=text).mapInArrow(run, SCHEMA)
