"""Sinks: tables, idempotent appends, reports that appear whole or not at all, receipts and markers."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the table lacks; the number appended. Of rows that repeat a key, the one whose hash over all
    columns is least is taken, so any run takes the same. Running it twice changes nothing."""
    spark = df.sparkSession
    rows = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(F.xxhash64(*df.columns), F.hash(*df.columns))).alias("_row")).select("_row.*")
    if store.exists(spark, path):
        have = spark.read.parquet(path).select(F.col(key).alias("_have"))
        rows = rows.join(have, F.col(key).eqNullSafe(F.col("_have")), "left_anti")
    staging = path.rstrip("/") + ".new"
    rows.write.mode("overwrite").parquet(staging)  # the anti join reads the table that it extends
    fresh = spark.read.schema(rows.schema).parquet(staging)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    store.delete(spark, staging)
    return n


def write_report(df: DataFrame, path: str, columns: list[str], order: list[str], digits: int = 6) -> None:
    """A CSV folder with fixed columns, LF ends and a total order; doubles as %.6f. A failed run leaves no older report."""
    out = df.select(*[F.format_string(f"%.{digits}f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.select(*columns).dtypes])
    with store.staged(df.sparkSession, path) as temp:
        out.orderBy(*order).write.csv(temp, header=True, lineSep="\n")


def write_report_and_items(report: DataFrame, items: DataFrame, stem: str, order: list[str]) -> None:
    """The facts, then the aggregates, side by side under one stem."""
    write_table(items, f"{stem}.items.parquet")
    write_report(report, f"{stem}.csv", report.columns, order)


def write_threshold(spark: SparkSession, path: str, value: float, report: str) -> None:
    """Only after its report is there."""
    if not store.exists(spark, report):
        raise FileNotFoundError(report)
    store.write_text(spark, path, f"{value:g}\n")


def write_json_lines(df: DataFrame, path: str) -> None:
    with store.staged(df.sparkSession, path) as temp:
        df.write.json(temp)


def json_array(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: the rows as one JSON array, in order. For reports; large tables go out as JSON lines."""
    return df.select(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"])).alias("json"))


def error_summary(df: DataFrame, error: str, strict: bool, first: int = 20) -> DataFrame:
    """n_records, n_errors, strict and the `first` least error texts; the heap of an array aggregate never holds more."""
    least = df.where(F.col(error).isNotNull()).select(error).orderBy(error).limit(first).agg(F.array_sort(F.collect_list(error)).alias("examples"))
    return df.agg(F.count("*").alias("n_records"), F.count(error).alias("n_errors"), F.lit(strict).alias("strict")).join(least)


def write_receipt(df: DataFrame, path: str) -> dict:
    """A one-row table as sorted JSON; it is written whether or not the build then fails."""
    row = df.first().asDict(recursive=True)
    store.write_text(df.sparkSession, path, json.dumps(row, sort_keys=True, indent=1, default=str))
    return row


def mark_done(spark: SparkSession, path: str, print_: str) -> None:
    """Written last, so that a crash never looks complete."""
    store.write_text(spark, path + ".done.json", json.dumps({"fingerprint": print_}))


def is_done(spark: SparkSession, path: str, print_: str) -> bool:
    """True only for the same fingerprint; any other means the run must be made again."""
    text = store.read_text(spark, path + ".done.json")
    return text is not None and json.loads(text).get("fingerprint") == print_


def pending(items: DataFrame, markers: str, key: str, print_: str) -> DataFrame:
    """Items without a marker of this fingerprint: what a run that is taken up again still has to do."""
    spark = items.sparkSession
    if not store.exists(spark, markers):
        return items
    done = spark.read.parquet(markers).where(F.col("fingerprint") == print_).select(F.col(key).alias("_done")).distinct()
    return items.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")


def mark_items(items: DataFrame, markers: str, key: str, print_: str) -> None:
    """Written after the items' results, so that a crash leaves them pending."""
    items.select(key, F.lit(print_).alias("fingerprint")).distinct().write.mode("append").parquet(markers)


def extract_blobs(rows: DataFrame, wanted: DataFrame, on: list[str], content: str, path: str) -> DataFrame:
    """Bytes of the wanted rows, unchanged, appended to a table keyed by their SHA-256; gives `on`, and the sha256 of each."""
    own = rows.join(wanted.select(*on).distinct(), on, "left_semi").withColumn("sha256", F.sha2(content, 256))
    append_new(own.select("sha256", F.col(content).alias("content")), path, "sha256")
    return own.select(*on, "sha256")


def rewrite_paths(table: DataFrame, mapping: DataFrame, path: str, new: str) -> DataFrame:
    """Paths in the mapping take their new form; others stay."""
    own = mapping.select(F.col(path).alias("_old"), F.col(new).alias("_new"))
    return table.join(own, F.col(path) == F.col("_old"), "left").withColumn(path, F.coalesce("_new", path)).drop("_old", "_new")


def cached(source: DataFrame, key: str, transform, path: str) -> DataFrame:
    """transform(rows) of the keys that the cache lacks is appended to it; the whole cache comes back for the source's keys."""
    spark = source.sparkSession
    todo = source
    if store.exists(spark, path):
        todo = source.join(spark.read.parquet(path).select(key), key, "left_anti")
    append_new(transform(todo), path, key)
    return spark.read.parquet(path).join(source.select(key).distinct(), key, "left_semi")
