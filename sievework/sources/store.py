"""Files through Hadoop's file systems on the driver, and reads and writes of shared files on executors."""

import contextlib
import os

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """old takes the place of new. A file does so in one step, where the store can overwrite by renaming; a folder is moved
    aside first and removed last, so that at every moment the old or the new one is there under one of two names."""
    where, fs = _at(spark, old)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
    if not fs.exists(target):
        if not fs.rename(where, target):
            raise OSError(f"cannot rename {old} to {new}")
        return
    if not fs.getFileStatus(where).isDirectory():
        jvm = spark.sparkContext._jvm
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(where), fs.makeQualified(target), options)
        return
    aside = new.rstrip("/") + ".replaced"
    delete(spark, aside)
    if not fs.rename(target, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(aside)) or not fs.rename(where, target):
        raise OSError(f"cannot rename {old} to {new}")
    delete(spark, aside)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside path, then renamed, so that readers see the old file or the whole new one."""
    staged = path + ".staging"
    where, fs = _at(spark, staged)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename(spark, staged, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, or None where there is none."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@contextlib.contextmanager
def staged(spark: SparkSession, path: str):
    """A path to write to; it becomes `path` on success. On failure both it and an older `path` go, so none passes for new."""
    temp = path.rstrip("/") + ".staging"
    delete(spark, temp)
    try:
        yield temp
    except BaseException:
        delete(spark, temp)
        delete(spark, path)
        raise
    rename(spark, temp, path)


def open_shared(uri: str):
    """A seekable file for a task. Each task opens its own handle; handles are never shared."""
    if uri.startswith("file:"):
        return open("/" + uri[5:].lstrip("/"), "rb")
    if "://" not in uri:
        return open(uri, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def write_shared(uri: str, body: bytes) -> None:
    """A whole file from a task; a task that runs again writes the same bytes again."""
    if "://" in uri and not uri.startswith("file:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as out:
            out.write(body)
        return
    path = "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(body)
