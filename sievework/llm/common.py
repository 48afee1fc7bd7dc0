"""What the operators share: reading tables, the shared folder, written intermediate tables, Arrow helpers."""

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as `bytes.split()` has it: \x20 and \x09 to \x0D.
SPACE = b" \t\n\r\x0b\x0c"


#: Bytes of an Arrow batch between the JVM and Python; rows are whole texts, so their number bounds nothing.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's limit of an Arrow batch to `BATCH_BYTES`, unless a lower one is set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name, None) or ""
    if not (held.isdigit() and 0 < int(held) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set, else one made here, in local runs only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sievework-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sievework-{spark.sparkContext.applicationId}"


#: Lists that take the paths given out while they are in force.
_TAKERS: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for taker in _TAKERS:
        taker.append(path)
    return path


@contextlib.contextmanager
def taking(paths: list[str]):
    """Adds the paths of the intermediate tables made inside to a list."""
    _TAKERS.append(paths)
    try:
        yield
    finally:
        _TAKERS.remove(paths)


def read_paths(df: DataFrame) -> list[str]:
    """The root paths of the tables that df reads, without scheme."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        relation = leaves.apply(i).relation() if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation" else None
        if relation is not None and relation.getClass().getSimpleName() == "HadoopFsRelation":
            roots = relation.location().rootPaths()
            out += [roots.apply(k).toUri().getPath() for k in range(roots.size())]
    return out


def release(df: DataFrame, paths: list[str]) -> None:
    """Removes those of the paths that df doesn't read, from the store and from the list. Shuffle files of what nothing refers
    to any more go as well, and executors collect their garbage: a heap that earlier stages made large is given back, which
    leaves room for the Python workers of the next one."""
    spark = df.sparkSession
    held = read_paths(df)
    for path in list(paths):
        bare = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*:/*", "", path).lstrip("/")
        if not any(h == bare or h.startswith(bare + "/") for h in held):
            remove_path(spark, path)
            paths.remove(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).where("reflect('java.lang.System', 'gc') is not null").count()


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here and survives the loss of executors.

    The rows stay as long as the application; `clean_shared` removes them.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """docs, written, with a number for each row (`_row`) that later scans find again; its high bits name the written file."""
    return materialize(without(docs, "_row").withColumn("_row", F.monotonically_increasing_id()), "numbered")


def write_beside(rows: DataFrame, label: str) -> str:
    """Writes rows that have a `_row` of numbered documents, one folder for each file of those: so a scan of the documents
    finds what belongs to its rows by itself, and texts need not be shuffled to meet it. Returns the path."""
    path = new_path(rows.sparkSession, label)
    own = rows.withColumn("_part", F.shiftright("_row", 33))
    own.repartition("_part").sortWithinPartitions("_part", "_row").write.partitionBy("_part").parquet(path)
    return path


class Beside:
    """What `write_beside` left for the rows of a batch, read folder by folder in a task."""

    def __init__(self, path: str):
        self.path, self.part, self.rows, self.table = path, None, None, None

    def _load(self, part: int) -> None:
        import pyarrow.parquet as pq

        store, path = file_system(self.path)
        from pyarrow import fs

        files = store.get_file_info(fs.FileSelector(f"{path}/_part={part}", allow_not_found=True))
        found = [pq.read_table(f.path, filesystem=store, partitioning=None) for f in files if f.path.endswith(".parquet")]
        self.part, self.table = part, pa.concat_tables(found) if found else None
        if len(found) > 1:
            self.table = self.table.sort_by("_row")
        self.rows = np.asarray(self.table["_row"]) if found else np.zeros(0, np.int64)

    def places(self, rows: np.ndarray):
        """(place in `table` or -1) of each row number; `rows` are of one file."""
        at = np.searchsorted(self.rows, rows)
        at[at == len(self.rows)] = 0
        return np.where(self.rows[at] == rows, at, -1) if len(self.rows) else np.full(len(rows), -1)

    def runs(self, rows: np.ndarray):
        """(start, end, places) of each stretch of a batch that comes from one file."""
        parts = rows >> 33
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if self.part != parts[a]:
                    self._load(int(parts[a]))
                yield a, b, self.places(rows[a:b])


def in_beside(path: str):
    """An Arrow function: whether a row number was written there."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        beside = Beside(path)
        for rows in trimming(batches):
            out = np.zeros(len(rows), bool)
            for a, b, places in beside.runs(np.asarray(rows)):
                out[a:b] = places >= 0
            yield pa.array(out)

    return F.arrow_udf(run, "boolean")


def clean_shared(spark: SparkSession) -> None:
    """Removes every intermediate table of this application."""
    remove_path(spark, shared_dir(spark))


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a bare path; None for another store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def file_system(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if (path := local_path(uri)) else fs.FileSystem.from_uri(uri)


def open_read(uri: str):
    """A seekable file of the shared folder, for executors."""
    if path := local_path(uri):
        return open(path, "rb")
    store, path = file_system(uri)
    return store.open_input_file(path)


def open_write(uri: str):
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add (Spark compares names without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def doc_text(df: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """doc_id, further columns and the text as UTF-8 bytes; other columns of df, whatever their names, don't travel."""
    return df.select("doc_id", *more, F.col(text).cast("binary").alias("body"))


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system: workers stay, with what earlier tasks left free."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimming(batches):
    """The batches, then a `trim`."""
    try:
        yield from batches
    finally:
        trim()


def by_bytes(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive slices of rows of about `most` bytes; a longer row is a slice of its own."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def slices(batches, most: int = 8 << 20):
    """Record batches cut by the bytes of their column `body`, so that Python holds few rows of long texts at a time."""
    for batch in trimming(batches):
        body = batch.column(batch.schema.get_field_index("body"))
        sizes = np.asarray(pc.fill_null(pc.binary_length(body), 0))
        for a, b in by_bytes(sizes, most):
            yield batch.slice(a, b - a)


def key_runs(batches, key: str = "key", most: int | None = None):
    """Batches sorted by `key` come back cut where the key changes, so that no key straddles two batches; but a key of more
    than `most` rows comes in several batches that hold nothing else."""
    held: list[pa.RecordBatch] = []
    for batch in trimming(batches):
        if not batch.num_rows:
            continue
        if most and sum(b.num_rows for b in held) > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        keys = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cut = int(np.searchsorted(keys != keys[-1], False)) if keys[0] == keys[-1] else int(len(keys) - np.argmax((keys != keys[-1])[::-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = [batch.slice(cut)]
        elif held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def is_held_out(doc_id: Column) -> Column:
    """The fold of the language model: crc32 of the id as text, remainder 2 modulo 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2
